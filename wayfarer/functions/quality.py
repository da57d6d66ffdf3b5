"""Temporal tracking quality, and the splitting of periods at day and hour borders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.functions.time import DAY, HOUR, micros

_STEP = {"day": DAY, "hour": HOUR}


def split_overlaps(source: DataFrame, granularity: str = "day") -> DataFrame:
    """One row for each day or hour that a period touches; other columns are repeated, a duration (seconds) is made anew."""
    if granularity not in _STEP:
        raise ValueError(f"granularity unknown: {granularity!r}")
    step = _STEP[granularity]
    s, f = micros("started_at"), micros("finished_at")
    # borders strictly between start and end, then the slices between neighbouring times
    first = (F.floor(s / step) + 1).cast("bigint") * step
    inner = F.when(first < f, F.sequence(first, f - 1, F.lit(step))).otherwise(F.array().cast("array<bigint>"))
    starts, ends = F.concat(F.array(s), inner), F.concat(inner, F.array(f))
    kind = source.schema["started_at"].dataType.simpleString()
    rows = source.withColumn("_slice", F.explode(F.arrays_zip(starts.alias("a"), ends.alias("b"))))
    rows = rows.withColumn("started_at", F.timestamp_micros("_slice.a").cast(kind)).withColumn("finished_at", F.timestamp_micros("_slice.b").cast(kind))
    if "duration" in source.columns:
        rows = rows.withColumn("duration", (F.col("_slice.b") - F.col("_slice.a")) / F.lit(1e6))
    return rows.drop("_slice")


def temporal_tracking_quality(source: DataFrame, granularity: str = "all") -> DataFrame:
    """Tracked share of the time for each user and, unless "all", each day, week (labelled by its last day, a Sunday), weekday or
    hour of the day. Periods without duration count for nothing; without any, the result is empty."""
    for c in ("user_id", "started_at", "finished_at"):
        if c not in source.columns:
            raise KeyError(c)
    rows = source.select("user_id", "started_at", "finished_at").where(micros("finished_at") > micros("started_at"))
    seconds = F.sum(micros("finished_at") - micros("started_at")) / F.lit(1e6)
    if granularity == "all":
        return rows.groupBy("user_id").agg((seconds / ((F.max(micros("finished_at")) - F.min(micros("started_at"))) / F.lit(1e6))).alias("quality"))
    if granularity not in ("day", "week", "weekday", "hour"):
        raise ValueError(f"granularity unknown: {granularity!r}")
    rows = split_overlaps(rows, "day")
    if granularity == "hour":
        rows = split_overlaps(rows, "hour")
    day = (F.floor(micros("started_at") / DAY)).cast("bigint")
    date = F.to_date("started_at")
    rows = rows.withColumn("_day", day)
    if granularity == "day":
        return rows.groupBy("user_id", date.alias("day")).agg((seconds / 86400).alias("quality"))
    if granularity == "week":
        return rows.groupBy("user_id", F.next_day(F.date_sub(date, 1), "Sun").alias("week_monday")).agg((seconds / (86400 * 7)).alias("quality"))
    since = rows.agg(F.min("_day").alias("_first"))  # one row
    rows = rows.crossJoin(F.broadcast(since)).withColumn("_since", F.col("_day") - F.col("_first"))
    if granularity == "weekday":
        week = F.floor(F.col("_since") / 7)
        return rows.groupBy("user_id", F.weekday("started_at").alias("weekday")).agg((seconds / (86400 * (F.max(week) - F.min(week) + 1))).alias("quality"))
    return rows.groupBy("user_id", F.hour("started_at").alias("hour")).agg((seconds / (3600 * (F.max("_since") - F.min("_since") + 1))).alias("quality"))
