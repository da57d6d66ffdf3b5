"""The catalogue of queries: each operator over the derived fixture, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfarer.functions import geo, labelling, metrics
from wayfarer.functions.time import micros
from wayfarer.operators.staypoints import drop_duplicate_fixes, merge_staypoints
from wayfarer.operators.triplegs import generate_triplegs
from wayfarer.plans import fixtures as fx
from wayfarer.plans.fixtures import hav, with_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a query and its SQL under the function's name."""

    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def r6(c, digits: int = 6):
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


# -- fixes -----------------------------------------------------------------------------------------------------------


@query(with_sql("pfs", "select id, user_id, tracked_at, elevation, round(lon, 6) as lon, round(lat, 6) as lat from pfs"))
def pfs_scan(spark, sf):
    return fx.positionfixes(spark, sf).select("id", "user_id", "tracked_at", "elevation", r6("lon").alias("lon"), r6("lat").alias("lat"))


@query(with_sql("pfs", "select min(id) as id, user_id, tracked_at, round(lon, 6) as lon, round(lat, 6) as lat from (select * from pfs union all select id + 1000000000, * exclude (id) from pfs where id % 3 = 0) group by user_id, tracked_at, elevation, lon, lat"))
def pfs_dedupe(spark, sf):
    pfs = fx.positionfixes(spark, sf)
    again = pfs.where("id % 3 = 0").withColumn("id", F.col("id") + 1000000000)
    return drop_duplicate_fixes(pfs.union(again)).select("id", "user_id", "tracked_at", r6("lon").alias("lon"), r6("lat").alias("lat"))


@query(with_sql("pfs", f"select id, round({hav('lag(lon) over w', 'lag(lat) over w', 'lon', 'lat')}, 6) as metres from pfs window w as (partition by user_id order by t, id)"))
def haversine_consecutive(spark, sf):
    w = Window.partitionBy("user_id").orderBy("tracked_at", "id")
    return fx.positionfixes(spark, sf).select("id", r6(geo.haversine(F.lag("lon").over(w), F.lag("lat").over(w), F.col("lon"), F.col("lat"))).alias("metres"))


@query(
    with_sql(
        "pfs",
        f"""select id, round(case when k = 1 then lead(s) over w else s end, 6) as speed from (
        select *, row_number() over w as k, {hav('lag(lon) over w', 'lag(lat) over w', 'lon', 'lat')} / nullif((t - lag(t) over w) / 1e6, 0) as s from pfs window w as (partition by user_id order by t, id)) window w as (partition by user_id order by t, id)""",
    )
)
def speed_positionfixes(spark, sf):
    return labelling.get_speed_positionfixes(fx.positionfixes(spark, sf)).select("id", r6("speed").alias("speed"))


@query(with_sql("pfs", "select user_id, round(degrees(atan2(avg(sin(radians(lon))), avg(cos(radians(lon))))), 6) as lon, round(avg(lat), 6) as lat from (select distinct user_id, lon, lat from pfs) group by user_id"))
def circular_center(spark, sf):
    spots = fx.positionfixes(spark, sf).groupBy("user_id").agg(F.sort_array(F.collect_set(geo.point(F.col("lon"), F.col("lat")))).alias("p")).withColumn("c", geo.centre(F.col("p")))
    return spots.select("user_id", r6("c.x").alias("lon"), r6("c.y").alias("lat"))


@query(with_sql("pfs", "select id, round(250 / (111320.0 * cos(radians(lat))), 9) as degrees from pfs"))
def meters_to_degrees(spark, sf):
    return fx.positionfixes(spark, sf).select("id", r6(geo.metres_to_degrees(F.lit(250.0), F.col("lat")), 9).alias("degrees"))


# -- staypoints ------------------------------------------------------------------------------------------------------


@query(with_sql("sp", "select id, user_id, started_at, finished_at, round(lon, 9) as lon, round(lat, 9) as lat from sp"))
def staypoints_sliding(spark, sf):
    return fx.staypoints(spark, sf)[1].select("id", "user_id", "started_at", "finished_at", r6("lon", 9).alias("lon"), r6("lat", 9).alias("lat"))


_LAST = f"""select user_id, started_at, finished_at from (
    select user_id, started_at, finished_at from sp union all
    select w.user_id, s.tracked_at, c.tracked_at from walk w join rows c using (user_id, rn) join rows s on s.user_id = w.user_id and s.rn = w.start
    where w.rn = (select max(rn) from rows r where r.user_id = w.user_id) and c.t - s.t >= {fx.TIME * 60_000_000})"""


@query(with_sql("sp", _LAST))
def staypoints_include_last(spark, sf):
    return fx.staypoints(spark, sf, include_last=True)[1].select("user_id", "started_at", "finished_at")


@query(with_sql("sp", "select id, round(elevation, 6) as elevation from sp"))
def staypoints_elevation_median(spark, sf):
    return fx.staypoints(spark, sf)[1].select("id", r6("elevation").alias("elevation"))


@query(with_sql("sp", "select id, staypoint_id from member"))
def pfs_staypoint_link(spark, sf):
    return fx.staypoints(spark, sf)[0].select("id", "staypoint_id")


@query(with_sql("sp", "select id, t1 - t0 > 86400000000 as is_activity from sp"))
def activity_flag(spark, sf):
    return labelling.create_activity_flag(fx.staypoints(spark, sf)[1], time_threshold=1440.0).select("id", "is_activity")


@query(with_sql("sp", "select user_id, count(*) as n_staypoints, cast(sum(cast(t1 - t0 > 86400000000 as int)) as bigint) as n_activities, round(sum(t1 - t0) / 3.6e9, 6) as dwell_hours from sp group by user_id"))
def dwell_by_user(spark, sf):
    sp = labelling.create_activity_flag(fx.staypoints(spark, sf)[1], time_threshold=1440.0)
    hours = F.sum(micros("finished_at") - micros("started_at")) / F.lit(3.6e9)
    return sp.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_staypoints"), F.sum(F.col("is_activity").cast("int")).alias("n_activities"), r6(hours).alias("dwell_hours"))


@query(with_sql("sp", f"select id, round({hav('lon', 'lat', 'lead(lon) over w', 'lead(lat) over w')}, 6) as jump_length from sp window w as (partition by user_id order by t0, id)"))
def jump_length(spark, sf):
    return metrics.jump_length(fx.staypoints(spark, sf)[1]).select("id", r6("jump_length").alias("jump_length"))


def _gyration(weight: str) -> str:
    return with_sql(
        "sp",
        f"""select user_id, round(sqrt(sum(w * d * d) / sum(w)), 4) as radius_gyration from (select user_id, w, {hav('lon', 'lat', 'mx', 'my')} as d from (
        select *, sum(w * lon) over u / sum(w) over u as mx, sum(w * lat) over u / sum(w) over u as my from (select *, {weight} as w from sp) window u as (partition by user_id))) group by user_id""",
    )


@query(_gyration("1.0"))
def radius_gyration_count(spark, sf):
    return metrics.radius_gyration(fx.staypoints(spark, sf)[1]).select("user_id", r6("radius_gyration", 4).alias("radius_gyration"))


@query(_gyration("(t1 - t0) / 1e6"))
def radius_gyration_duration(spark, sf):
    return metrics.radius_gyration(fx.staypoints(spark, sf)[1], "duration").select("user_id", r6("radius_gyration", 4).alias("radius_gyration"))


# -- triplegs --------------------------------------------------------------------------------------------------------

_TPL = "select p.id, p.user_id, p.started_at, p.finished_at, p.n_points, round(l.length, 4) as length from tpl p join lengths l on l.tripleg_id = p.id"


def _shape(tpls: DataFrame) -> DataFrame:
    return tpls.select("id", "user_id", "started_at", "finished_at", F.size("geom").cast("bigint").alias("n_points"), r6(geo.line_length(F.col("geom")), 4).alias("length"))


@query(with_sql("tpl", _TPL))
def triplegs_between(spark, sf):
    return _shape(fx.triplegs(spark, sf)[2])


@query(with_sql("tpl", "select id, tripleg_id from tpfs"))
def pfs_tripleg_link(spark, sf):
    return fx.triplegs(spark, sf)[0].select("id", "tripleg_id")


@query(with_sql("tpl", _TPL))
def triplegs_case2(spark, sf):
    """Without staypoint ids on the fixes, their times say the same here."""
    pfs, sp = fx.staypoints(spark, sf)
    return _shape(generate_triplegs(pfs.drop("staypoint_id"), sp, gap_threshold=fx.GAP)[1])


_OVERLAP = f"""
    , base as (select id, user_id, t, tracked_at, rn, staypoint_id, z.lon, z.lat, m.lon as mx, m.lat as my, run as r0, n,
        case when run is not null and n >= 2 then user_id * 1000000 + run end as own, t - lag(t) over w > {fx.GAP * 60_000_000} as late from sized z left join mids m using (staypoint_id) window w as (partition by user_id order by t, id)),
    tied as (select *, case when staypoint_id is not null and rn > 1 and not late then lag(own) over w end as e, case when staypoint_id is not null and rn > 1 and not coalesce(lead(late) over w, false) then lead(own) over w end as b from base window w as (partition by user_id order by t, id)),
    parts as (select *, coalesce(own, e, b) as k, coalesce(own, e) is not null as timed, coalesce(mx, lon) as px, coalesce(my, lat) as py from tied),
    steps as (select *, {hav('lag(px) over w', 'lag(py) over w', 'px', 'py')} as d from parts where k is not null window w as (partition by k order by t, id))
    select any_value(user_id) as user_id, min(tracked_at) filter (timed) as started_at, max(tracked_at) filter (timed) as finished_at, count(*) as n_points, round(sum(d), 4) as length
    from steps group by k having count(distinct {{'x': px, 'y': py}}) >= 2"""


@query(with_sql("tpl", _OVERLAP.strip().replace(", base", ", base", 1)).replace("\n, base", ", base", 1))
def triplegs_overlap(spark, sf):
    return _shape(fx.triplegs(spark, sf, "overlap_staypoints")[2]).drop("id")


@query(with_sql("tpl", "select tripleg_id as id, round(length, 4) as length from lengths"))
def tripleg_length(spark, sf):
    return _shape(fx.triplegs(spark, sf)[2]).select("id", "length")


@query(with_sql("tpl", "select p.id, round(l.length / ((tb - ta) / 1e6), 8) as speed from tpl p join lengths l on l.tripleg_id = p.id"))
def tripleg_speed(spark, sf):
    return labelling.get_speed_triplegs(fx.triplegs(spark, sf)[2]).select("id", r6("speed", 8).alias("speed"))


@query(with_sql("tpl", "select tripleg_id as id, round(pf_speed, 8) as speed from lengths"))
def tripleg_speed_pfs_mean(spark, sf):
    pfs, _, tpls = fx.triplegs(spark, sf)
    return labelling.get_speed_triplegs(tpls, pfs, "pfs_mean_speed").select("id", r6("speed", 8).alias("speed"))


#: Bounds that divide the fixture's speeds.
MODES = {0.02: "slow_mobility", 0.1: "motorized_mobility", float("inf"): "fast_mobility"}
MODE_SQL = "case when length / ((tb - ta) / 1e6) < 0.02 then 'slow_mobility' when length / ((tb - ta) / 1e6) < 0.1 then 'motorized_mobility' else 'fast_mobility' end"


@query(with_sql("tpl", f"select p.id, {MODE_SQL} as mode from tpl p join lengths l on l.tripleg_id = p.id"))
def transport_mode(spark, sf):
    return labelling.predict_transport_mode(fx.triplegs(spark, sf)[2], categories=MODES).select("id", "mode")


# -- merging ---------------------------------------------------------------------------------------------------------

_MERGE = f"""
    select min(id) as id, user_id, arg_min(started_at, (t0, id)) as started_at, arg_max(finished_at, (t0, id)) as finished_at, arg_min(location_id, (t0, id)) as location_id, count(*) as n_merged from (
    select *, sum(case when lag_joins then 0 else 1 end) over (partition by user_id order by t0, id) as run from (select *, coalesce(lag(joins) over (partition by user_id order by t0, id), false) as lag_joins from (
    select s.*, coalesce(lead(s.location_id) over w = s.location_id and lead(s.t0) over w - s.t1 <= 21600000000 and coalesce(k.next_kind, '') <> 'tpl', false) as joins
    from (select *, {fx.LOC} as location_id from sp) s join (select * from (select id, kind, lead(kind) over (partition by user_id order by t0, kind, id) as next_kind from (
        select user_id, id, t0, 'sp' as kind from sp union all select user_id, id, ta, 'tpl' from tpl)) where kind = 'sp') k on k.id = s.id window w as (partition by s.user_id order by s.t0, s.id)))) group by user_id, run"""


@query(with_sql("tpl", _MERGE))
def staypoints_merged(spark, sf):
    _, sp, tpls = fx.triplegs(spark, sf)
    sp = fx.located(sp).withColumn("n_merged", F.lit(1))
    return merge_staypoints(sp, tpls, "6h", {"n_merged": "count"}).select("id", "user_id", "started_at", "finished_at", "location_id", "n_merged")


from wayfarer.plans import catalog_trips  # noqa: E402, F401  (adds its queries)
