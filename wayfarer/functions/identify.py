"""What locations are for: filters, and home and work by dwell time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfarer.functions.time import duration, micros


def pre_filter_locations(sp: DataFrame, agg_level: str = "user", thresh_sp: int = 10, thresh_loc: int = 10, thresh_sp_at_loc: int = 10, thresh_loc_time="1h", thresh_loc_period="5h", name: str = "keep") -> DataFrame:
    """Adds a flag: the user has enough staypoints and locations, and the location enough visits, time and span."""
    if agg_level not in ("user", "dataset"):
        raise ValueError(f"agg_level unknown: {agg_level!r}")
    users = sp.groupBy("user_id").agg((F.count_distinct("started_at") >= thresh_sp).alias("_a"), (F.count_distinct("location_id") >= thresh_loc).alias("_b")).select("user_id", (F.col("_a") & F.col("_b")).alias("_user"))
    by = ["user_id", "location_id"] if agg_level == "user" else ["location_id"]
    t0, t1 = micros("started_at"), micros("finished_at")
    places = sp.where("location_id is not null").groupBy(*by).agg(F.count("started_at").alias("_n"), F.sum(t1 - t0).alias("_time"), (F.max(t1) - F.min(t0)).alias("_span"))
    places = places.select(*by, ((F.col("_n") >= thresh_sp_at_loc) & (F.col("_time") >= duration(thresh_loc_time)) & (F.col("_span") >= duration(thresh_loc_period))).alias("_place"))
    return sp.join(users, "user_id", "left").join(places, by, "left").withColumn(name, F.coalesce(F.col("_user") & F.col("_place"), F.lit(False))).drop("_user", "_place")


def freq_method(sp: DataFrame, *labels: str) -> DataFrame:
    """purpose: the labels, in order, for each user's locations with most time; ties go to the smaller location_id."""
    labels = labels or ("home", "work")
    length = F.col("duration").cast("double") if "duration" in sp.columns else (micros("finished_at") - micros("started_at")).cast("double")
    time = sp.where("location_id is not null").groupBy("user_id", "location_id").agg(F.sum(length).alias("_time"))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("_time"), "location_id"))
    named = time.withColumn("_r", rank).where(F.col("_r") <= len(labels)).select("user_id", "location_id", F.element_at(F.array(*map(F.lit, labels)), F.col("_r")).alias("purpose"))
    return sp.drop("purpose").join(named, ["user_id", "location_id"], "left")


def osna_method(sp: DataFrame) -> DataFrame:
    """purpose: home by weighted time at rest and leisure, work by time in working hours, on weekdays, by the time halfway.

    A user's home location can't be work too; work is then the next best. Ties go to the smaller location_id."""
    t0, t1 = micros("started_at"), micros("finished_at")
    mid = F.timestamp_micros((t0 + F.floor((t1 - t0) / 2)).cast("bigint"))
    hour, day = F.hour(mid), F.weekday(mid)
    time = (t1 - t0).cast("double")
    home = F.when((day < 5) & (hour >= 2) & (hour < 8), time * 0.739).when((day < 5) & ((hour < 2) | (hour >= 19)), time * 0.358)
    work = F.when((day < 5) & (hour >= 8) & (hour < 19), time)
    sums = sp.where("location_id is not null").groupBy("user_id", "location_id").agg(F.sum(home).alias("_home"), F.sum(work).alias("_work"))
    top = lambda c: F.row_number().over(Window.partitionBy("user_id").orderBy(F.coalesce(F.col(c), F.lit(0.0)).desc(), "location_id"))
    sums = sums.withColumn("_at_home", (top("_home") == 1) & F.col("_home").isNotNull())
    rest = F.when(F.col("_at_home"), F.lit(None)).otherwise(F.col("_work"))
    sums = sums.withColumn("_rest", rest)
    at_work = F.row_number().over(Window.partitionBy("user_id").orderBy(F.coalesce("_rest", F.lit(0.0)).desc(), "location_id"))
    named = sums.withColumn("_at_work", (at_work == 1) & F.col("_rest").isNotNull()).select("user_id", "location_id", F.when(F.col("_at_home"), "home").when(F.col("_at_work"), "work").alias("purpose"))
    return sp.drop("purpose").join(named, ["user_id", "location_id"], "left")


def location_identifier(sp: DataFrame, method: str = "FREQ", pre_filter: bool = True, **options) -> DataFrame:
    """purpose for the rows that pass the filter; null for the others."""
    if "location_id" not in sp.columns:
        raise KeyError("staypoints need a location_id")
    if method not in ("FREQ", "OSNA"):
        raise ValueError(f"method unknown: {method!r}")
    rows = pre_filter_locations(sp, name="_keep", **options) if pre_filter else sp.withColumn("_keep", F.lit(True))
    kept = rows.where("_keep").drop("_keep")
    named = freq_method(kept, "home", "work") if method == "FREQ" else osna_method(kept)
    return rows.drop("purpose").join(named.select("id", "purpose"), "id", "left").drop("_keep")
