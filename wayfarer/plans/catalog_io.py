"""Sources and sinks: tables of the fixture, written and read again, with the SQL of what was written."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wayfarer.functions.time import micros
from wayfarer.operators.graph import shared_folder
from wayfarer.operators.locations import generate_locations
from wayfarer.operators.trips import generate_tours, generate_trips
from wayfarer.plans import fixtures as fx
from wayfarer.plans.catalog import query, r6
from wayfarer.plans.catalog_trips import _CENTRES, _DIST_CLOSE, _DIST_LINK, _component_sql, _tour_sql, trips_sql
from wayfarer.plans.fixtures import with_sql
from wayfarer.sources import tables


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/wayfarer-io-{uuid.uuid4().hex}"


def _csv(spark, df, table: str, **options):
    """df after a round trip through csv files."""
    path = _folder(spark)
    tables.write_csv(df, path, table, sep=";")
    zone = {} if table == "locations" else {"tz": "UTC"}
    return getattr(tables, f"read_{table}_csv")(spark, path, index_col="id", sep=";", **zone, **options)


_PFS = "select id, user_id, t, elevation, round(lon, 9) as lon, round(lat, 9) as lat from pfs"


def _pfs(df):
    return df.select("id", "user_id", micros("tracked_at").alias("t"), "elevation", r6("lon", 9).alias("lon"), r6("lat", 9).alias("lat"))


@query(with_sql("pfs", _PFS))
def csv_positionfixes(spark, sf):
    return _pfs(_csv(spark, fx.positionfixes(spark, sf), "positionfixes"))


@query(with_sql("pfs", _PFS))
def parquet_positionfixes(spark, sf):
    path = _folder(spark)
    fx.positionfixes(spark, sf).write.parquet(path)
    return _pfs(spark.read.parquet(path))


@query(with_sql("sp", "select id, user_id, t0, t1, round(lon, 9) as lon, round(lat, 9) as lat from sp"))
def csv_staypoints(spark, sf):
    sp = _csv(spark, fx.staypoints(spark, sf)[1], "staypoints")
    return sp.select("id", "user_id", micros("started_at").alias("t0"), micros("finished_at").alias("t1"), r6("lon", 9).alias("lon"), r6("lat", 9).alias("lat"))


@query(with_sql("tpl", "select id, user_id, ta as t0, tb as t1, n_points from tpl"))
def csv_triplegs(spark, sf):
    tpls = _csv(spark, fx.triplegs(spark, sf)[2], "triplegs")
    return tpls.select("id", "user_id", micros("started_at").alias("t0"), micros("finished_at").alias("t1"), F.size("geom").cast("bigint").alias("n_points"))


@query(_component_sql(True, _CENTRES))
def csv_locations(spark, sf):
    sp = fx.staypoints(spark, sf)[1].withColumn("lon", r6("lon", 9)).withColumn("lat", r6("lat", 9))
    locs = _csv(spark, generate_locations(sp)[1], "locations")
    return locs.select("user_id", "id", r6("center.x", 12).alias("x"), r6("center.y", 12).alias("y"))


def _trips(spark, sf):
    _, sp, tpls = fx.triplegs(spark, sf)
    return generate_trips(sp, tpls, fx.GAP)[2]


@query(trips_sql("select id, user_id, t0, t1, origin_staypoint_id, destination_staypoint_id, round(ox, 9) as ox, round(dy, 9) as dy from trips"))
def csv_trips(spark, sf):
    t = _csv(spark, _trips(spark, sf), "trips", geom_col="geom")
    return t.select("id", "user_id", micros("started_at").alias("t0"), micros("finished_at").alias("t1"), "origin_staypoint_id", "destination_staypoint_id", r6("start_geom.x", 9).alias("ox"), r6("end_geom.y", 9).alias("dy"))


@query(_tour_sql(_DIST_LINK, _DIST_CLOSE, "select t.id, any_value(t.user_id) as user_id, string_agg(cast(p.id as varchar), ',' order by p.n) as trips from tour t join ot p on p.user_id = t.user_id and p.n between t.na and t.nb group by t.id"))
def csv_tours(spark, sf):
    tours = _csv(spark, generate_tours(_trips(spark, sf), max_dist=1500, max_time="5D")[1], "tours")
    return tours.select("id", "user_id", F.concat_ws(",", "trips").alias("trips"))
