"""Track collections: folders of plt files by user, and GPX."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_geolife(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(positionfixes, labels) from <path>/<user>/Trajectory/*.plt and <path>/<user>/labels.txt; elevations from feet to metres.

    Users are folders with numeric names. Six head lines are told by their shape. Ids follow user, file and time."""
    lines = spark.read.text(f"{path}/*/Trajectory/*.plt").select("value", F.col("_metadata.file_path").alias("file"))
    user = F.regexp_extract("file", r"([^/]+)/Trajectory/[^/]+$", 1)
    part = F.split("value", ",")
    rows = lines.where(F.size(part) == 7).where(part[5].rlike(r"^\d{4}-\d\d-\d\d$"))
    rows = rows.select(
        user.cast("bigint").alias("user_id"), F.to_timestamp(F.concat_ws(" ", part[5], part[6], F.lit("+00:00")), "yyyy-MM-dd HH:mm:ss XXX").alias("tracked_at"),
        (part[3].cast("double") * 0.3048).alias("elevation"), part[1].cast("double").alias("lon"), part[0].cast("double").alias("lat"), F.lit(None).cast("double").alias("accuracy"), "file",
    )
    from wayfarer.operators.ids import dense_ids

    return dense_ids(rows, ["file", "tracked_at"]).drop("file"), read_geolife_labels(spark, path)


def read_geolife_labels(spark: SparkSession, path: str) -> DataFrame:
    """(id, user_id, started_at, finished_at, mode) of all labels.txt; empty without any."""
    schema = "id bigint, user_id bigint, started_at timestamp, finished_at timestamp, mode string"
    try:
        lines = spark.read.text(f"{path}/*/labels.txt").select("value", F.col("_metadata.file_path").alias("file"))
    except Exception as e:  # no such file is Spark's error, not Python's
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    part = F.split("value", "\t")
    at = lambda k: F.to_timestamp(F.concat_ws(" ", part[k], F.lit("+00:00")), "yyyy/MM/dd HH:mm:ss XXX")
    rows = lines.where(part[0].rlike(r"^\d{4}/")).select(F.regexp_extract("file", r"([^/]+)/labels\.txt$", 1).cast("bigint").alias("user_id"), at(0).alias("started_at"), at(1).alias("finished_at"), F.trim(part[2]).alias("mode"))
    from wayfarer.operators.ids import dense_ids

    return dense_ids(rows, ["started_at", "finished_at"]).select("id", "user_id", "started_at", "finished_at", "mode")


_TRACK = "trkseg array<struct<trkpt:array<struct<_lat:double,_lon:double,ele:double,time:string,hdop:double>>>>"


def read_gpx(spark: SparkSession, path: str) -> DataFrame:
    """Positionfixes of all tracks of <path>/*.gpx, as one user (0); track_fid numbers tracks over files, in order of names."""
    tracks = spark.read.format("xml").option("rowTag", "trk").schema(_TRACK).load(f"{path}/*.gpx").select("trkseg", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    per_file = tracks.groupBy("file").agg(F.count(F.lit(1)).alias("n"))  # a row for each file
    before = F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tracks = tracks.withColumn("k", F.row_number().over(Window.partitionBy("file").orderBy("at")) - 1).join(per_file.select("file", before.alias("before")), "file")
    pts = tracks.select((F.col("before") + F.col("k")).alias("track_fid"), F.posexplode("trkseg").alias("track_seg_id", "seg")).select("track_fid", "track_seg_id", F.posexplode("seg.trkpt").alias("track_seg_point_id", "p"))
    rows = pts.select(F.lit(0).cast("bigint").alias("user_id"), F.to_timestamp("p.time").alias("tracked_at"), "track_fid", "track_seg_id", "track_seg_point_id", F.col("p.ele").alias("elevation"), F.col("p.hdop").alias("hdop"), F.col("p._lon").alias("lon"), F.col("p._lat").alias("lat"))
    from wayfarer.operators.ids import dense_ids

    return dense_ids(rows, ["track_fid", "track_seg_id", "track_seg_point_id"])
