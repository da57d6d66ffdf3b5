"""Triplegs: continuous movement between staypoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfarer.functions.time import duration, micros
from wayfarer.operators.graph import saved
from wayfarer.operators.ids import dense_ids


def generate_triplegs(pfs: DataFrame, staypoints: DataFrame | None = None, method: str = "between_staypoints", gap_threshold: float = 15) -> tuple[DataFrame, DataFrame]:
    """(positionfixes with tripleg_id, triplegs). A tripleg needs two fixes and two different points.

    Without a staypoint_id on the fixes, staypoints (with their times) say which fixes are no movement: those at or after a
    start and before its end; the first fix at or after an end begins a tripleg."""
    if method not in ("between_staypoints", "overlap_staypoints"):
        raise ValueError(f"method unknown: {method!r}")
    linked = "staypoint_id" in pfs.columns
    if staypoints is None and not linked:
        raise TypeError("either a staypoint_id or staypoints are needed")
    if method == "overlap_staypoints" and (staypoints is None or not linked):
        raise TypeError("overlap_staypoints needs a staypoint_id and staypoints")
    w = Window.partitionBy("user_id").orderBy("_t", "id")
    rows = pfs.drop("tripleg_id").withColumn("_t", micros("tracked_at"))
    if not linked:
        rows = _by_time(rows, staypoints, w)
    gap = duration(gap_threshold)
    late = F.coalesce(F.col("_t") - F.lag("_t").over(w) > gap, F.lit(False))
    rows = rows.withColumn("_new", F.lag("id").over(w).isNull()).withColumn("_late", late)
    after = F.lag("staypoint_id").over(w).isNotNull() if linked else F.coalesce(F.lag("staypoint_id").over(w).isNotNull(), F.lit(False)) | F.col("_after")
    rows = rows.withColumn("_starts", F.col("staypoint_id").isNull() & (F.col("_new") | F.col("_late") | after))
    rows = rows.withColumn("_run", F.when(F.col("staypoint_id").isNull(), F.sum(F.col("_starts").cast("int")).over(w)))
    size = F.count(F.lit(1)).over(Window.partitionBy("user_id", "_run"))
    rows = rows.withColumn("_run", F.when(F.col("_run").isNotNull() & (size >= 2), F.col("_run")))
    rows = saved(rows)  # read by the numbers, the triplegs and the fixes
    numbers = rows.where("_run is not null").groupBy("user_id", "_run").agg(F.min("_t").alias("_t0"))
    numbers = dense_ids(numbers, ["_t0", "_run"], "tripleg_id").drop("_t0")
    rows = rows.join(numbers, ["user_id", "_run"], "left")
    pt = F.struct(F.col("lon").alias("x"), F.col("lat").alias("y"))
    if method == "overlap_staypoints":
        rows, shape = _overlap(rows, staypoints, w)
    else:
        shape = rows.withColumn("_pt", pt).withColumn("_timed", F.lit(True))
    moved = shape.where("tripleg_id is not null").groupBy("tripleg_id").agg(
        F.first("user_id").alias("user_id"), F.min(F.when(F.col("_timed"), F.col("tracked_at"))).alias("started_at"), F.max(F.when(F.col("_timed"), F.col("tracked_at"))).alias("finished_at"),
        F.transform(F.array_sort(F.collect_list(F.struct("_t", "id", "_pt"))), lambda r: r["_pt"]).alias("geom"),
    )
    valid = moved.where(F.size(F.array_distinct("geom")) >= 2).withColumnRenamed("tripleg_id", "id").select("id", "user_id", "started_at", "finished_at", "geom")
    known = valid.select(F.col("id").alias("_valid"))
    out = rows.join(known, F.col("tripleg_id") == F.col("_valid"), "left").drop("tripleg_id").withColumnRenamed("_valid", "tripleg_id")
    keep = [*[c for c in pfs.columns if c != "tripleg_id"], "tripleg_id"]
    return out.select(*keep), valid


def _by_time(rows: DataFrame, staypoints: DataFrame, w) -> DataFrame:
    """staypoint_id from the staypoints' times, and _after at the first fix at or after an end: one pass over both, sorted."""
    sp = staypoints.select("user_id", F.col("id").alias("staypoint_id"), micros("started_at").alias("_s"), micros("finished_at").alias("_f"))
    marks = rows.select("user_id", F.col("_t"), F.lit(1).alias("_kind"), "id").unionByName(
        sp.select("user_id", F.col("_s").alias("_t"), F.lit(0).alias("_kind"), F.col("staypoint_id"), F.col("_f")), allowMissingColumns=True
    )
    order = Window.partitionBy("user_id").orderBy("_t", "_kind", "id")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    open_ = F.last(F.when(F.col("_kind") == 0, F.struct("staypoint_id", "_f")), ignorenulls=True).over(upto)
    marks = marks.withColumn("_open", open_).where("_kind = 1")
    marks = marks.withColumn("_in", F.col("_t") < F.col("_open._f")).withColumn("_done", F.when(~F.col("_in"), F.col("_open.staypoint_id")))
    first = F.row_number().over(Window.partitionBy("user_id", "_done").orderBy("_t", "id")) == 1
    marks = marks.select("id", F.when(F.col("_in"), F.col("_open.staypoint_id")).alias("staypoint_id"), (F.col("_done").isNotNull() & first).alias("_after"))
    return rows.join(marks, "id").drop("_kind")


def _overlap(rows: DataFrame, staypoints: DataFrame, w) -> tuple[DataFrame, DataFrame]:
    """The first fix of the next staypoint ends a tripleg, in time and shape; the last fix of the one before begins its shape."""
    stay, own = F.col("staypoint_id").isNotNull() & ~F.col("_new"), F.col("tripleg_id")
    ends = F.when(stay & ~F.col("_late"), F.lag("tripleg_id").over(w))
    begins = F.when(stay & ~F.coalesce(F.lead("_late").over(w), F.lit(False)), F.lead("tripleg_id").over(w))
    rows = rows.withColumn("_ends", ends).withColumn("_begins", begins)
    rows = rows.withColumn("_timed", F.coalesce(own, "_ends").isNotNull()).withColumn("tripleg_id", F.coalesce(own, "_ends", "_begins"))
    spots = staypoints.select(F.col("id").alias("staypoint_id"), F.struct(F.col("lon").alias("x"), F.col("lat").alias("y")).alias("_spot"))
    shape = rows.join(spots, "staypoint_id", "left").withColumn("_pt", F.coalesce("_spot", F.struct(F.col("lon").alias("x"), F.col("lat").alias("y"))))
    return rows, shape
