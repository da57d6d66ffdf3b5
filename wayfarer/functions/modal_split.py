"""Modal split: how much is travelled by each mode."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.functions.geo import line_length
from wayfarer.functions.time import micros

MOST_MODES = 1000
_DAYS = {"MON": "Mon", "TUE": "Tue", "WED": "Wed", "THU": "Thu", "FRI": "Fri", "SAT": "Sat", "SUN": "Sun"}


def time_bin(column: str, freq: str):
    """The label of a period: days and hours by their start, weeks by their last day (W alone: Sunday), months by their last day."""
    date = F.to_date(column)
    if freq in ("D", "1D"):
        return F.date_trunc("day", column).cast("timestamp_ntz")
    if freq in ("h", "H"):
        return F.date_trunc("hour", column).cast("timestamp_ntz")
    if freq == "W" or freq.startswith("W-"):
        return F.next_day(F.date_sub(date, 1), _DAYS[freq[2:] or "SUN"]).cast("timestamp_ntz")
    if freq in ("M", "ME"):
        return F.last_day(date).cast("timestamp_ntz")
    raise ValueError(f"freq unknown: {freq!r}")


def calculate_modal_split(tpls: DataFrame, freq: str | None = None, metric: str = "count", per_user: bool = False, norm: bool = False, modes: list[str] | None = None, planar: bool = False) -> DataFrame:
    """A column for each mode (all that occur, or those given), a row for each user and period asked for; 0 where none."""
    if metric not in ("count", "distance", "duration"):
        raise ValueError(f"metric unknown: {metric!r}")
    value = {"count": F.lit(1), "distance": line_length(F.col("geom"), planar) if "geom" in tpls.columns else None, "duration": (micros("finished_at") - micros("started_at")) / F.lit(1e6)}[metric]
    if modes is None:
        modes = sorted(r["mode"] for r in tpls.where("mode is not null").select("mode").distinct().limit(MOST_MODES + 1).collect())
        if len(modes) > MOST_MODES:
            raise ValueError(f"more than {MOST_MODES} modes, each a column; name those that count")
    keys = ["user_id"] * per_user + ["timestamp"] * (freq is not None)
    rows = tpls.where("mode is not null").withColumn("_value", value)
    if freq is not None:
        rows = rows.withColumn("timestamp", time_bin("started_at", freq))
    out = rows.groupBy(*keys).pivot("mode", modes).agg(F.sum("_value")).na.fill(0, modes)
    if norm:
        total = sum((F.col(m) for m in modes), F.lit(0.0))
        out = out.select(*keys, *((F.col(m) / total).alias(m) for m in modes))
    return out
