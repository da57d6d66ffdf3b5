"""Tables of the model: in-memory adapters, csv and databases, in and out.

A table's geometry is plain columns: lon and lat (positionfixes, staypoints), geom (triplegs), center and extent (locations),
start_geom and end_geom (trips).
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfarer.sources import wkt

TIMES = {"positionfixes": ["tracked_at"], "staypoints": ["started_at", "finished_at"], "triplegs": ["started_at", "finished_at"], "locations": [], "trips": ["started_at", "finished_at"], "tours": ["started_at", "finished_at"]}
REQUIRED = {
    "positionfixes": ["user_id", "tracked_at", "lon", "lat"], "staypoints": ["user_id", "started_at", "finished_at", "lon", "lat"], "triplegs": ["user_id", "started_at", "finished_at", "geom"],
    "locations": ["user_id", "center"], "trips": ["user_id", "started_at", "finished_at", "origin_staypoint_id", "destination_staypoint_id"], "tours": ["user_id", "started_at", "finished_at"],
}


def localize(df: DataFrame, column: str, tz: str | None = None) -> DataFrame:
    """Times without a zone are taken to be in tz (UTC, with a warning, if none is given); instants stay as they are."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.StringType):
        zoned = F.col(column).rlike(r"(?:Z|[+-]\d\d:?\d\d)\s*$")
        naive = F.to_utc_timestamp(F.try_to_timestamp(F.col(column)), tz or "UTC")
        if tz is None:
            warnings.warn(f"{column}: times without a zone are taken as UTC", stacklevel=3)
        return df.withColumn(column, F.when(zoned, F.try_to_timestamp(F.col(column))).otherwise(naive))
    if isinstance(kind, T.TimestampNTZType):
        if tz is None:
            warnings.warn(f"{column} has no zone and is taken as UTC", stacklevel=3)
        return df.withColumn(column, F.to_utc_timestamp(F.col(column).cast("timestamp"), tz or "UTC"))
    if not isinstance(kind, T.TimestampType):
        raise TypeError(f"{column} is no time: {kind.simpleString()}")
    return df


def from_dataframe(df: DataFrame, table: str, columns: dict[str, str] | None = None, tz: str | None = None) -> DataFrame:
    """A DataFrame as a table of the model: columns renamed (theirs to ours), times localized, required columns checked. All
    other columns go along."""
    df = df.withColumnsRenamed(columns or {})
    for c in TIMES[table]:
        if c in df.columns:
            df = localize(df, c, tz)
    missing = [c for c in REQUIRED[table] if c not in df.columns]
    if missing:
        raise AttributeError(f"{table} need the columns {missing}")
    return df


def _read(spark: SparkSession, path: str, columns: dict[str, str] | None, sep: str, index_col: str | None, **options) -> DataFrame:
    df = spark.read.csv(path, sep=sep, header=True, inferSchema=options.pop("inferSchema", False), **options)
    df = df.withColumnsRenamed(columns or {})
    if index_col is None:
        warnings.warn("index_col is not given: a column named id, if any, is the key", stacklevel=3)
    elif index_col != "id":
        df = df.withColumnRenamed(index_col, "id")
    for c in df.columns:
        if c == "id" or c.endswith("_id") and c != "user_id":
            df = df.withColumn(c, F.col(c).try_cast("double").cast("bigint"))
        elif c in ("elevation", "accuracy", "longitude", "latitude", "speed"):
            df = df.withColumn(c, F.col(c).try_cast("double"))
    if "user_id" in df.columns and df.where(F.col("user_id").isNotNull() & F.col("user_id").try_cast("bigint").isNull()).isEmpty():
        df = df.withColumn("user_id", F.col("user_id").try_cast("bigint"))
    return df


def read_positionfixes_csv(spark: SparkSession, path: str, columns=None, tz=None, index_col=None, sep=",", **options) -> DataFrame:
    df = _read(spark, path, columns, sep, index_col, **options).withColumnsRenamed({"longitude": "lon", "latitude": "lat"})
    return from_dataframe(df, "positionfixes", None, tz)


def read_staypoints_csv(spark: SparkSession, path: str, columns=None, tz=None, index_col=None, geom_col="geom", sep=",", **options) -> DataFrame:
    df = _read(spark, path, columns, sep, index_col, **options).withColumn("_p", wkt.parse_point(F.col(geom_col)))
    return from_dataframe(df.withColumn("lon", F.col("_p.x")).withColumn("lat", F.col("_p.y")).drop("_p", geom_col), "staypoints", None, tz)


def read_triplegs_csv(spark: SparkSession, path: str, columns=None, tz=None, index_col=None, geom_col="geom", sep=",", **options) -> DataFrame:
    df = _read(spark, path, columns, sep, index_col, **options).withColumnRenamed(geom_col, "geom")
    return from_dataframe(df.withColumn("geom", wkt.parse_points(F.col("geom"))), "triplegs", None, tz)


def read_locations_csv(spark: SparkSession, path: str, columns=None, index_col=None, sep=",", **options) -> DataFrame:
    df = _read(spark, path, columns, sep, index_col, **options).withColumn("center", wkt.parse_point(F.col("center")))
    if "extent" in df.columns:
        df = df.withColumn("extent", wkt.parse_points(F.col("extent")))
    return from_dataframe(df, "locations")


def read_trips_csv(spark: SparkSession, path: str, columns=None, tz=None, index_col=None, geom_col=None, sep=",", **options) -> DataFrame:
    df = _read(spark, path, columns, sep, index_col, **options)
    if geom_col is not None:
        pts = wkt.parse_points(F.col(geom_col))
        df = df.withColumn("start_geom", F.element_at(pts, 1)).withColumn("end_geom", F.element_at(pts, -1)).drop(geom_col)
    return from_dataframe(df, "trips", None, tz)


def read_tours_csv(spark: SparkSession, path: str, columns=None, tz=None, index_col=None, sep=",", **options) -> DataFrame:
    df = _read(spark, path, columns, sep, index_col, **options)
    if "trips" in df.columns:
        df = df.withColumn("trips", F.from_json("trips", "array<bigint>"))
    return from_dataframe(df, "tours", None, tz)


def flat(df: DataFrame) -> DataFrame:
    """The table with geometry as text and lists as JSON, for csv and databases."""
    if {"start_geom", "end_geom"} <= set(df.columns):
        df = df.withColumn("geom", wkt.format_multipoint(F.col("start_geom"), F.col("end_geom"))).drop("start_geom", "end_geom")
    elif "geom" in df.columns and isinstance(df.schema["geom"].dataType, T.ArrayType):
        df = df.withColumn("geom", wkt.format_line(F.col("geom")))
    if "center" in df.columns:
        df = df.withColumn("center", wkt.format_point(F.col("center")))
    if "extent" in df.columns:
        df = df.withColumn("extent", wkt.format_polygon(F.col("extent")))
    for c in ("trips", "tour_id"):
        if c in df.columns and isinstance(df.schema[c].dataType, T.ArrayType):
            df = df.withColumn(c, F.to_json(c))
    for f in df.schema:
        if isinstance(f.dataType, T.TimestampType):
            df = df.withColumn(f.name, F.date_format(f.name, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"))
        elif isinstance(f.dataType, T.TimestampNTZType):  # whole microseconds, which the writer's own format cuts
            df = df.withColumn(f.name, F.date_format(f.name, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    return df


def write_csv(df: DataFrame, path: str, table: str, sep: str = ",", mode: str = "errorifexists") -> None:
    """Positionfixes keep longitude and latitude as columns; staypoints get a POINT; the rest see flat()."""
    if table == "positionfixes":
        df = df.withColumnsRenamed({"lon": "longitude", "lat": "latitude"})
    elif table == "staypoints":
        df = df.withColumn("geom", wkt.format_point(F.struct(F.col("lon").alias("x"), F.col("lat").alias("y")))).drop("lon", "lat")
    flat(df).write.mode(mode).csv(path, sep=sep, header=True)


def read_jdbc(spark: SparkSession, url: str, query: str, table: str, columns: dict[str, str] | None = None, tz: str | None = None, geom_col: str | None = "geom", **options) -> DataFrame:
    """A table from a query over JDBC; geometry as WKB (ST_AsBinary in the query). columns renames before anything else."""
    df = spark.read.format("jdbc").option("url", url).option("query", query).options(**options).load().withColumnsRenamed(columns or {})
    if geom_col and geom_col in df.columns:
        df = df.withColumn("_p", wkt.wkb_points(F.col(geom_col))).drop(geom_col)
        if table in ("positionfixes", "staypoints"):
            df = df.withColumn("lon", F.element_at("_p", 1)["x"]).withColumn("lat", F.element_at("_p", 1)["y"])
        elif table == "triplegs":
            df = df.withColumn("geom", F.col("_p"))
        elif table == "trips":
            df = df.withColumn("start_geom", F.element_at("_p", 1)).withColumn("end_geom", F.element_at("_p", -1))
        df = df.drop("_p")
    for c in ("center", "extent"):
        if c in df.columns and isinstance(df.schema[c].dataType, T.BinaryType):
            pts = wkt.wkb_points(F.col(c))
            df = df.withColumn(c, F.element_at(pts, 1) if c == "center" else pts)
    for c in ("trips", "tour_id"):
        if c in df.columns and isinstance(df.schema[c].dataType, T.StringType):
            df = df.withColumn(c, F.from_json(c, "array<bigint>"))
    return from_dataframe(df, table, None, tz)


def binary(df: DataFrame, srid: int | None = 4326) -> DataFrame:
    """The table with each geometry as one (E)WKB column (geom, center, extent), and lists as JSON."""
    cols = set(df.columns)
    if {"start_geom", "end_geom"} <= cols:
        both = F.when(F.col("start_geom").isNotNull() & F.col("end_geom").isNotNull(), F.array("start_geom", "end_geom"))
        df = df.withColumn("geom", wkt.points_wkb(4, srid)(both)).drop("start_geom", "end_geom")
    elif "geom" in cols and isinstance(df.schema["geom"].dataType, T.ArrayType):
        df = df.withColumn("geom", wkt.points_wkb(2, srid)(F.col("geom")))
    elif {"lon", "lat"} <= cols:
        spot = F.when(F.col("lon").isNotNull() & F.col("lat").isNotNull(), F.struct(F.col("lon").alias("x"), F.col("lat").alias("y")))
        df = df.withColumn("geom", wkt.points_wkb(1, srid)(spot)).drop("lon", "lat")
    if "center" in cols:
        df = df.withColumn("center", wkt.points_wkb(1, srid)(F.col("center")))
    if "extent" in cols:
        df = df.withColumn("extent", wkt.points_wkb(3, srid)(F.col("extent")))
    return df.withColumns({c: F.to_json(c) for c in ("trips", "tour_id") if c in cols and isinstance(df.schema[c].dataType, T.ArrayType)})


def write_jdbc(df: DataFrame, url: str, name: str, if_exists: str = "fail", srid: int | None = 4326, **options) -> None:
    """Geometry goes as (E)WKB, which read_jdbc takes, and a geometry column of the database too; lists go as JSON."""
    mode = {"fail": "errorifexists", "replace": "overwrite", "append": "append"}
    if if_exists not in mode:
        raise ValueError(f"if_exists unknown: {if_exists!r}")
    binary(df, srid).write.format("jdbc").option("url", url).option("dbtable", name).options(**options).mode(mode[if_exists]).save()
