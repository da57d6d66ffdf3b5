"""Activity flags, speeds and transport modes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfarer.functions.geo import distance, line_length
from wayfarer.functions.time import duration, micros

#: Upper bounds in metres per second and the modes below them (fixed values).
SPEED_MODES = {15 / 3.6: "slow_mobility", 100 / 3.6: "motorized_mobility", math.inf: "fast_mobility"}


def create_activity_flag(sp: DataFrame, method: str = "time_threshold", time_threshold: float = 15.0, activity_column_name: str = "is_activity") -> DataFrame:
    """True where a staypoint is longer than the threshold (minutes)."""
    if method != "time_threshold":
        raise ValueError(f"method unknown: {method!r}")
    return sp.withColumn(activity_column_name, micros("finished_at") - micros("started_at") > duration(time_threshold))


def get_speed_positionfixes(pfs: DataFrame, planar: bool = False, compat: bool = False) -> DataFrame:
    """Metres per second since the fix before; a user's first fix takes the second's. compat: over all users, in order of id,
    which is one sequence by definition and therefore one task."""
    w = Window.orderBy("id") if compat else Window.partitionBy("user_id").orderBy("tracked_at", "id")
    d = distance(planar)
    seconds = (micros("tracked_at") - F.lag(micros("tracked_at")).over(w)) / F.lit(1e6)
    metres = d(F.lag("lon").over(w), F.lag("lat").over(w), F.col("lon"), F.col("lat"))
    rows = pfs.withColumn("_speed", F.when(seconds != 0, metres / seconds)).withColumn("_first", F.lag("id").over(w).isNull())
    return rows.withColumn("speed", F.when(F.col("_first"), F.lead("_speed").over(w)).otherwise(F.col("_speed"))).drop("_speed", "_first")


def get_speed_triplegs(tpls: DataFrame, pfs: DataFrame | None = None, method: str = "tpls_speed", planar: bool = False) -> DataFrame:
    """tpls_speed: length by duration. pfs_mean_speed: mean speed of a tripleg's fixes from the second on."""
    if method == "tpls_speed":
        seconds = (micros("finished_at") - micros("started_at")) / F.lit(1e6)
        return tpls.withColumn("speed", F.when(seconds != 0, line_length(F.col("geom"), planar) / seconds).otherwise(F.when(line_length(F.col("geom"), planar) > 0, F.lit(math.inf)).otherwise(F.lit(math.nan))))
    if method != "pfs_mean_speed":
        raise ValueError(f"method unknown: {method!r}")
    if pfs is None:
        raise ValueError("pfs_mean_speed needs positionfixes")
    if "tripleg_id" not in pfs.columns:
        raise AttributeError("positionfixes need a tripleg_id")
    w = Window.partitionBy("tripleg_id").orderBy("tracked_at", "id")
    seconds = (micros("tracked_at") - F.lag(micros("tracked_at")).over(w)) / F.lit(1e6)
    metres = distance(planar)(F.lag("lon").over(w), F.lag("lat").over(w), F.col("lon"), F.col("lat"))
    mean = pfs.where("tripleg_id is not null").select("tripleg_id", F.when(seconds != 0, metres / seconds).alias("s")).groupBy("tripleg_id").agg(F.avg("s").alias("speed"))
    return tpls.drop("speed").join(mean.withColumnRenamed("tripleg_id", "id"), "id", "left")


def predict_transport_mode(tpls: DataFrame, method: str = "simple-coarse", categories: dict | None = None, planar: bool = False) -> DataFrame:
    """The mode of the first bound above a tripleg's speed; none for infinite and undefined speeds."""
    if method != "simple-coarse":
        raise ValueError(f"method unknown: {method!r}")
    speed, mode = F.col("speed"), None
    for bound, name in sorted((categories or SPEED_MODES).items()):
        test = (speed < F.lit(float(bound))) & ~F.isnan(speed)
        mode = F.when(test, name) if mode is None else mode.when(test, name)
    had = "speed" in tpls.columns
    out = get_speed_triplegs(tpls.drop("speed"), planar=planar).withColumn("mode", mode)
    return out.drop("speed") if not had else out.drop("speed").join(tpls.select("id", "speed"), "id")
