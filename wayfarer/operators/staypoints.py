"""Staypoints: where someone stayed within a distance for a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfarer.functions.geo import EARTH
from wayfarer.functions.time import duration, micros
from wayfarer.operators.graph import saved
from wayfarer.operators.ids import dense_ids, user_offsets
from wayfarer.operators.streams import changes, joined, sorted_by_user


def drop_duplicate_fixes(pfs: DataFrame) -> DataFrame:
    """Of rows that are equal in all columns but the id, the one with the smallest id."""
    values = [c for c in pfs.columns if c != "id"]
    return pfs.groupBy(*values).agg(F.min("id").alias("id")).select(*pfs.columns)


def _scan(new: np.ndarray, t: np.ndarray, lon: np.ndarray, lat: np.ndarray, dist: float, gap: int, resume: int) -> tuple[list[int], list[bool]]:
    """Where stretches begin, and whether a fix at dist or more from the first one began each; the first row begins one. Rows
    before resume are known to belong to it."""
    lon, lat = np.radians(lon), np.radians(lat)
    cos = np.cos(lat)
    x, y, z = (v.tolist() for v in (cos * np.cos(lon), cos * np.sin(lon), np.sin(lat)))
    cut = new.copy()
    cut[1:] |= np.diff(t) > gap
    # 1 - cosine tells near from far but for a narrow band, where the distance itself decides
    most = 1 - np.cos(min(dist / EARTH, np.pi))
    low, high = 1 - most * 1.0001 - 1e-14, 1 - most * 0.9999 + 1e-14
    begins, far = [0], [False]
    start, sx, sy, sz = 0, x[0], y[0], z[0]
    for i, breaks in enumerate(cut[resume:].tolist(), resume):
        if not breaks:
            c = sx * x[i] + sy * y[i] + sz * z[i]
            if c > high or c >= low and EARTH * np.arccos(np.clip(np.cos(lat[i] - lat[start]) - cos[start] * cos[i] * (1 - np.cos(lon[i] - lon[start])), -1, 1)) < dist:
                continue
        begins.append(i)
        far.append(not breaks)
        start, sx, sy, sz = i, x[i], y[i], z[i]
    return begins, far


def _stretches(batches: Iterator[pa.RecordBatch], dist: float, least: int, gap: int, include_last: bool) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows in order of user and time, in whole stretches: the rows, where each begins (and the last ends), the time at which each
    ended as a staypoint (-1: it is none), and the number of staypoints of its user before it."""
    held, before, ended = None, 0, False
    source = iter(batches)
    while not ended:
        b = next(source, None)
        ended = b is None
        if b is not None and not b.num_rows:
            continue
        resume = 1 if held is None else held.num_rows
        rows = held if b is None else b if held is None else joined([held, b])
        if rows is None:
            return
        t = rows.column("_t").to_numpy(zero_copy_only=False)
        new = changes(rows.column("user_id"))
        begins, far = _scan(new, t, *(rows.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("lon", "lat")), dist, gap, resume)
        at = np.array([*begins, rows.num_rows])
        last_of_user = np.append(new[at[1:-1]], ended)
        close, whole = np.append(np.array(far[1:], bool), False), at[1:] if ended else at[1:-1]
        at = at if ended else at[:-1]
        n = len(whole)
        if n:
            first, stop = at[:-1], at[1:]
            finish = np.where(close[:n], t[np.minimum(stop, len(t) - 1)], t[stop - 1])
            stays = (close[:n] | include_last & last_of_user[:n]) & (finish - t[first] >= least)
            count = np.cumsum(stays) - stays + before
            user = np.maximum.accumulate(np.where(new[first] & (first > 0), np.arange(n), -1))  # the stretch with which a user began in here
            count -= np.where(user >= 0, count[user], 0)
            yield rows.slice(0, int(stop[-1])), at, np.where(stays, finish, -1), count
            nxt = int(stop[-1])
            before = 0 if nxt < rows.num_rows and new[nxt] else int(count[-1] + stays[-1])
            held = rows.slice(nxt) if nxt < rows.num_rows else None
        else:
            held = rows


def _marks(dist: float, least: int, gap: int, include_last: bool):
    """The rows themselves, with the rank of their staypoint among the user's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, at, end, rank in _stretches(batches, dist, least, gap, include_last):
            of = np.repeat(np.arange(len(end)), np.diff(at))
            got = pa.array(rank[of], mask=end[of] < 0)
            keep = [c for c in rows.schema.names if c != "_t"]
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in keep), got], names=[*keep, "_rank"])

    return run


def _stays(dist: float, least: int, gap: int, include_last: bool, planar: bool):
    """One row for each staypoint: user, rank, begin, end, median elevation, and the centre of its places, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, at, end, rank in _stretches(batches, dist, least, gap, include_last):
            on = np.flatnonzero(end >= 0)
            if not len(on):
                continue
            size = np.diff(at)[on]
            take = np.repeat(at[on] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            of = np.repeat(np.arange(len(on)), size)
            x, y = (rows.column(c).to_numpy(zero_copy_only=False).astype(float)[take] for c in ("lon", "lat"))
            order = np.lexsort((y, x, of))
            a, b, c = of[order], x[order], y[order]
            once = np.ones(len(order), bool)
            once[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])
            a, b, c = a[once], b[once], c[once]
            mean = lambda v: np.bincount(a, v, len(on)) / np.bincount(a, minlength=len(on))
            cx = mean(b) if planar else np.degrees(np.arctan2(mean(np.sin(np.radians(b))), mean(np.cos(np.radians(b)))))
            cols = [rows.column("user_id").take(pa.array(at[on])), pa.array(rank[on]), rows.column("_t").take(pa.array(at[on])), pa.array(end[on])]
            names = ["user_id", "_rank", "_begun", "_ended"]
            if "elevation" in rows.schema.names:
                col = rows.column("elevation").cast(pa.float64())
                e = col.to_numpy(zero_copy_only=False)[take]
                known = col.is_valid().to_numpy(zero_copy_only=False)[take]
                e, own = e[known], of[known]
                order = np.lexsort((e, own))
                e, n = e[order], np.bincount(own, minlength=len(on))
                first = np.cumsum(n) - n
                mid = np.full(len(on), np.nan)
                some = n > 0
                mid[some] = (e[(first + (n - 1) // 2)[some]] + e[(first + n // 2)[some]]) / 2
                cols.append(pa.array(mid, mask=~some)), names.append("elevation")
            yield pa.RecordBatch.from_arrays([*cols, pa.array(cx), pa.array(mean(c))], names=[*names, "lon", "lat"])

    return run


def generate_staypoints(
    pfs: DataFrame, method: str = "sliding", distance_metric: str = "haversine", dist_threshold: float = 100, time_threshold: float = 5.0, gap_threshold: float = 15.0,
    include_last: bool = False, exclude_duplicate_pfs: bool = True, planar: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(positionfixes with staypoint_id, staypoints). Thresholds are metres and minutes.

    A staypoint ends with the first fix at dist_threshold or more from its first one, provided at least time_threshold has
    passed; a pause longer than gap_threshold starts anew. Users' fixes are read as a sorted stream, of which a task holds a batch
    and the stretch that is still open; staypoints come out whole and numbered within their user, so no further shuffle of fixes
    follows. With include_last a user's last stretch may be a staypoint too."""
    if method != "sliding":
        raise ValueError(f"method unknown: {method!r}")
    if distance_metric != "haversine":
        raise ValueError(f"distance_metric unknown: {distance_metric!r}")
    pfs = pfs.drop("staypoint_id")
    if exclude_duplicate_pfs:
        pfs = drop_duplicate_fixes(pfs)
    options = dist_threshold, duration(time_threshold), duration(gap_threshold), include_last
    moving = sorted_by_user(pfs.withColumn("_t", micros("tracked_at")), ["_t", "id"])
    user_type, elevation = pfs.schema["user_id"].dataType.simpleString(), "elevation" in pfs.columns
    needed = moving.select("user_id", "_t", "lon", "lat", *["elevation"] * elevation)
    stays = needed.mapInArrow(_stays(*options, planar), f"user_id {user_type}, _rank bigint, _begun bigint, _ended bigint" + ", elevation double" * elevation + ", lon double, lat double")
    stays = saved(stays)  # one row for each staypoint, read by both results
    kind = pfs.schema["tracked_at"].dataType
    moment = lambda c: F.timestamp_micros(c) if isinstance(kind, T.TimestampType) else F.timestamp_micros(c).cast("timestamp_ntz")
    sp = dense_ids(stays, [], rank="_rank").select("id", "user_id", moment("_begun").alias("started_at"), moment("_ended").alias("finished_at"), *["elevation"] * elevation, "lon", "lat")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pfs.schema)
    marked = moving.mapInArrow(_marks(*options), f"{fields}, _rank bigint")
    offsets = user_offsets(stays.select("user_id"))
    linked = marked.join(offsets, F.col("user_id").eqNullSafe(F.col("_user")), "left").withColumn("staypoint_id", F.col("_before") + F.col("_rank")).drop("_user", "_before", "_rank")
    return linked.select(*pfs.columns, "staypoint_id"), sp


def merge_staypoints(sp: DataFrame, tpls: DataFrame, max_time_gap="10min", agg: dict | None = None) -> DataFrame:
    """Joins staypoints at one location that follow each other within max_time_gap without a tripleg between.

    agg maps further columns to first, last, min, max, sum, mean or count, or to a function of the column."""
    if not isinstance(max_time_gap, str) and not hasattr(max_time_gap, "total_seconds"):
        raise TypeError("max_time_gap must be text or a timedelta")
    if "location_id" not in sp.columns:
        raise AssertionError("staypoints need a location_id")
    gap = duration(max_time_gap)
    both = sp.select("user_id", "started_at", F.col("id"), F.lit("sp").alias("kind")).unionByName(tpls.select("user_id", "started_at", F.col("id"), F.lit("tpl").alias("kind")))
    follows = both.withColumn("next_kind", F.lead("kind").over(Window.partitionBy("user_id").orderBy("started_at", "kind", "id"))).where("kind = 'sp'").select("id", "next_kind")
    w = Window.partitionBy("user_id").orderBy("started_at", "id")
    s = sp.join(follows, "id")
    joins = (F.lead("location_id").over(w) == F.col("location_id")) & (F.lead(micros("started_at")).over(w) - micros("finished_at") <= gap) & (F.coalesce(F.col("next_kind"), F.lit("")) != "tpl")
    s = s.withColumn("_joins", F.coalesce(joins, F.lit(False)))
    s = s.withColumn("_run", F.sum(F.when(F.coalesce(F.lag("_joins").over(w), F.lit(False)), 0).otherwise(1)).over(w))
    own = {"id": "first", "started_at": "first", "finished_at": "last", "location_id": "first", **(agg or {})}
    order = F.struct(micros("started_at"), F.col("id"))

    def one(c: str, how) -> F.Column:
        col = F.col(c)
        if callable(how):
            return how(col).alias(c)
        return {"first": F.min_by(col, order), "last": F.max_by(col, order), "min": F.min(col), "max": F.max(col), "sum": F.sum(col), "mean": F.avg(col), "count": F.count(col)}[how].alias(c)

    return s.groupBy("user_id", "_run").agg(*(one(c, h) for c, h in own.items())).drop("_run").select("id", "user_id", *[c for c in own if c != "id"])
