"""Mobility metrics over staypoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfarer.functions.geo import distance
from wayfarer.functions.time import micros


def jump_length(sp: DataFrame, planar: bool = False) -> DataFrame:
    """Distance to the user's next staypoint; null for the last."""
    w = Window.partitionBy("user_id").orderBy("started_at", "id")
    return sp.withColumn("jump_length", distance(planar)(F.col("lon"), F.col("lat"), F.lead("lon").over(w), F.lead("lat").over(w)))


def radius_gyration(sp: DataFrame, method: str = "count", planar: bool = False) -> DataFrame:
    """user_id, radius_gyration: root of the weighted mean squared distance to the weighted mean position."""
    if method not in ("count", "duration"):
        raise ValueError(f"method unknown: {method!r}")
    weight = F.lit(1.0) if method == "count" else (micros("finished_at") - micros("started_at")) / F.lit(1e6)
    rows = sp.select("user_id", "lon", "lat", weight.alias("w"))
    mid = rows.groupBy("user_id").agg((F.sum(F.col("w") * F.col("lon")) / F.sum("w")).alias("_x"), (F.sum(F.col("w") * F.col("lat")) / F.sum("w")).alias("_y"))
    d = distance(planar)(F.col("lon"), F.col("lat"), F.col("_x"), F.col("_y"))
    return rows.join(mid, "user_id").groupBy("user_id").agg(F.sqrt(F.sum(F.col("w") * d * d) / F.sum("w")).alias("radius_gyration"))


def centre_of(df: DataFrame) -> tuple[float, float]:
    """Plain mean of longitude and latitude."""
    return tuple(df.agg(F.avg("lon"), F.avg("lat")).first())
