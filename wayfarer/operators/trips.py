"""Trips between activities, and tours made of trips."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfarer.functions.geo import EARTH, np_haversine
from wayfarer.functions.time import duration, micros
from wayfarer.operators.graph import saved
from wayfarer.operators.ids import dense_ids
from wayfarer.operators.streams import per_user


def generate_trips(sp: DataFrame, tpls: DataFrame, gap_threshold: float = 15, add_geometry: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(staypoints with trip_id, prev_trip_id and next_trip_id; triplegs with trip_id; trips).

    A trip begins after the last of consecutive activities, after a gap (minutes), or with a user; it needs a tripleg. Its origin
    and destination are the activities right before and after it, unless a gap lies between."""
    if "is_activity" not in sp.columns:
        raise AttributeError("staypoints need is_activity")
    gap = duration(gap_threshold)
    drop = ("trip_id", "prev_trip_id", "next_trip_id")
    sp, tpls = sp.drop(*drop), tpls.drop("trip_id")
    spot = F.struct(F.col("lon").alias("x"), F.col("lat").alias("y"))
    here = [c for c in ("user_id", "started_at", "finished_at", "id")]
    ends = (lambda a, b: [a.alias("_from"), b.alias("_to")]) if add_geometry else (lambda a, b: [])
    rows = sp.select(*here, F.lit(0).alias("kind"), F.coalesce("is_activity", F.lit(False)).alias("act"), *ends(spot, spot)).unionByName(
        tpls.select(*here, F.lit(1).alias("kind"), F.lit(False).alias("act"), *ends(F.element_at("geom", 1), F.element_at("geom", -1)))
    )
    rows = rows.withColumn("t0", micros("started_at")).withColumn("t1", micros("finished_at"))
    w = Window.partitionBy("user_id").orderBy("t0", "kind", "id")
    late = F.coalesce(F.lead("t0").over(w) - F.col("t1") > gap, F.lit(False))
    rows = rows.withColumn("_gap", late)
    begins = F.lag("id").over(w).isNull() | (F.col("act") & ~F.coalesce(F.lead("act").over(w), F.lit(False))) | F.coalesce(F.lag("_gap").over(w), F.lit(False))
    rows = saved(rows.withColumn("run", F.sum(begins.cast("int")).over(w)))  # read by all three results
    order = F.struct("t0", "kind", "id")
    legs = F.col("kind") == 1
    aggs = [F.min("started_at").alias("started_at"), F.max("finished_at").alias("finished_at"), F.min("t0").alias("t0"), F.sum(legs.cast("int")).alias("legs")]
    if add_geometry:
        aggs += [F.min_by(F.when(legs, F.col("_from")), F.when(legs, order)).alias("first_at"), F.max_by(F.when(legs, F.col("_to")), F.when(legs, order)).alias("last_at")]
    trips = rows.where("not act").groupBy("user_id", "run").agg(*aggs).where("legs > 0")
    trips = saved(dense_ids(trips, ["run"]))
    line = trips.select("user_id", "t0", F.col("id").alias("trip_id"), F.lit(2).alias("what")).unionByName(
        rows.where("act").select("user_id", "t0", F.col("id").alias("sp_id"), F.lit(1).alias("what"), *(["_from"] if add_geometry else [])), allowMissingColumns=True
    ).unionByName(rows.where("_gap").select("user_id", (F.col("t1") + gap / 2).cast("bigint").alias("t0"), F.lit(3).alias("what")), allowMissingColumns=True)
    v = Window.partitionBy("user_id").orderBy("t0", "what", "sp_id")
    near = [F.lag("sp_id").over(v).alias("origin_staypoint_id"), F.lead("sp_id").over(v).alias("destination_staypoint_id"), F.lag("trip_id").over(v).alias("prev_trip_id"), F.lead("trip_id").over(v).alias("next_trip_id")]
    if add_geometry:
        near += [F.lag("_from").over(v).alias("o"), F.lead("_from").over(v).alias("d")]
    line = line.select("what", "trip_id", "sp_id", *near)
    ends_of = line.where("what = 2").drop("what", "sp_id", "prev_trip_id", "next_trip_id").withColumnRenamed("trip_id", "id")
    out = trips.join(ends_of, "id")
    geom = [F.coalesce("o", "first_at").alias("start_geom"), F.coalesce("d", "last_at").alias("end_geom")] if add_geometry else []
    out = out.select("id", "user_id", "started_at", "finished_at", "origin_staypoint_id", "destination_staypoint_id", *geom)
    of_row = rows.where("not act").join(trips.select("user_id", "run", F.col("id").alias("trip_id")), ["user_id", "run"]).select("kind", "id", "trip_id")
    links = line.where("what = 1").select(F.col("sp_id").alias("id"), "prev_trip_id", "next_trip_id")
    sp = sp.join(of_row.where("kind = 0").drop("kind"), "id", "left").join(links, "id", "left")
    return sp, tpls.join(of_row.where("kind = 1").drop("kind"), "id", "left"), out


class _ByPlace:
    """Openings of tours, in the order in which they were added, by the location they start from."""

    def __init__(self) -> None:
        self.latest: dict[object, int] = {}

    def add(self, place: object, opening: int) -> None:
        if place is not None:
            self.latest[place] = opening

    def last(self, place: object, least: int) -> int:
        """The latest opening at a place, if it is no earlier than least, or else -1."""
        got = -1 if place is None else self.latest.get(place, -1)
        return got if got >= least else -1


class _ByDistance:
    """The same for points, which are one place if they lie within reach: a grid of cells of that size. Degrees are taken to
    points on the sphere, where a distance along it is hardly longer than the chord."""

    def __init__(self, reach: float, planar: bool) -> None:
        self.reach, self.planar = reach, planar
        self.side = max(reach, 1e-6)
        self.cells: dict[tuple[int, ...], list[tuple[int, tuple[float, float]]]] = {}

    def _cell(self, p: tuple[float, float]) -> tuple[int, ...]:
        if self.planar:
            return int(p[0] // self.side), int(p[1] // self.side)
        lon, lat = math.radians(p[0]), math.radians(p[1])
        return tuple(int(EARTH * v // self.side) for v in (math.cos(lat) * math.cos(lon), math.cos(lat) * math.sin(lon), math.sin(lat)))

    def near(self, p: tuple[float, float], q: tuple[float, float]) -> bool:
        return bool((math.hypot(p[0] - q[0], p[1] - q[1]) if self.planar else np_haversine(*p, *q)) <= self.reach)

    def add(self, place: tuple[float, float], opening: int) -> None:
        if not math.isnan(place[0]):
            self.cells.setdefault(self._cell(place), []).append((opening, place))

    def last(self, place: tuple[float, float], least: int) -> int:
        best = least - 1
        if not math.isnan(place[0]):
            for step in itertools.product((-1, 0, 1), repeat=2 if self.planar else 3):
                for opening, other in reversed(self.cells.get(tuple(c + d for c, d in zip(self._cell(place), step, strict=True)), ())):
                    if opening <= best:
                        break
                    if self.near(other, place):
                        best = opening
                        break
        return best if best >= least else -1


def _closings(t0: np.ndarray, t1: np.ndarray, linked: np.ndarray, origin: list, destination: list, starts: np.ndarray, ends: np.ndarray, places: _ByPlace | _ByDistance, max_time: int, max_gaps: int) -> list[tuple[int, int]]:
    """(opening, closing) of one user's tours. A trip closes a tour with the latest opening at its destination that is admissible.

    Trips and the gaps between trips that don't meet are numbered through: trip k has number k + gaps[k]. Admissible are openings
    after the last max_gaps + 1 gaps, and of no more than max_time before the end; both bounds are known beforehand. A closing that
    finds nothing up to one of them forgets what lies before; for the bound by gaps, as many of the oldest numbers as the closing
    trip is away from the gap."""
    gaps = np.cumsum(~linked)  # linked[0] counts as linked
    first_after = np.flatnonzero(~linked)  # the trip right after each gap
    by_gaps = np.where(gaps > max_gaps, first_after[np.maximum(gaps - max_gaps - 1, 0)], 0) if len(first_after) else np.zeros(len(t0), np.int64)
    by_time = np.minimum(np.searchsorted(t0, t1 - max_time, "left"), np.arange(len(t0)) + 1)
    number = np.arange(len(t0)) + gaps
    forgotten, out = 0, []
    for k in range(len(t0)):
        if starts[k]:
            places.add(origin[k], k)
        if not ends[k] or (max_gaps == 0 and not linked[k]):
            continue
        least = max(int(by_gaps[k]), int(by_time[k]), int(np.searchsorted(number, forgotten, "left")) if forgotten else 0)
        opening = places.last(destination[k], least)
        if opening >= 0:
            out.append((opening, k))
        elif max_gaps and by_gaps[k] > by_time[k] - 1 and by_gaps[k] and number[by_gaps[k]] - 1 >= forgotten:
            forgotten += int(number[k] - number[by_gaps[k]]) + 2
            if forgotten > number[k] and k + 1 < len(t0):  # with nothing left to meet, the next trip follows no gap
                forgotten = int(number[k + 1])
        elif by_time[k] and number[by_time[k] - 1] >= forgotten:
            forgotten = int(number[by_time[k] - 1])
    return out


def _tours(max_dist: float, max_time: int, max_gaps: int, by_location: bool, planar: bool):
    def run(rows: pa.RecordBatch, at: np.ndarray) -> pa.RecordBatch:
        get = lambda c: rows.column(c).to_numpy(zero_copy_only=False)
        t0, t1, ids = get("t0"), get("t1"), get("id")
        starts, ends = (rows.column(c).is_valid().to_numpy(zero_copy_only=False) for c in ("o_sp", "d_sp"))
        linked = np.ones(len(t0), bool)
        if by_location:
            origin, destination = rows.column("o_loc").to_pylist(), rows.column("d_loc").to_pylist()
            linked[1:] = [a is not None and a == b for a, b in zip(destination[:-1], origin[1:], strict=True)]
        else:
            xy = [rows.column(c).cast(pa.float64()).fill_null(math.nan).to_numpy(zero_copy_only=False) for c in ("o_x", "o_y", "d_x", "d_y")]
            d = np.hypot(xy[2][:-1] - xy[0][1:], xy[3][:-1] - xy[1][1:]) if planar else np_haversine(xy[2][:-1], xy[3][:-1], xy[0][1:], xy[1][1:])
            linked[1:] = d <= max_dist
            origin, destination = (list(zip(xy[k].tolist(), xy[k + 1].tolist(), strict=True)) for k in (0, 2))
        linked[at[:-1]] = True
        found, seq, trips = [], [], []
        for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            places = _ByPlace() if by_location else _ByDistance(max_dist, planar)
            own = _closings(t0[lo:hi], t1[lo:hi], linked[lo:hi], origin[lo:hi], destination[lo:hi], starts[lo:hi], ends[lo:hi], places, max_time, max_gaps)
            found += [(a + lo, b + lo) for a, b in own]
            seq += range(len(own))
        a, b = np.array(found, np.int64).reshape(-1, 2).T
        trips = [ids[i : j + 1].tolist() for i, j in zip(a.tolist(), b.tolist(), strict=True)]
        cols = [rows.column("user_id").take(pa.array(a)), pa.array(trips, pa.list_(pa.int64())), pa.array(t0[a]), pa.array(t1[b]), rows.column("o_sp").cast(pa.int64()).take(pa.array(a)), rows.column("d_sp").cast(pa.int64()).take(pa.array(b))]
        cols += [rows.column("o_loc").cast(pa.int64()).take(pa.array(a)) if by_location else pa.nulls(len(a), pa.int64()), pa.array(seq, pa.int64())]
        return pa.RecordBatch.from_arrays(cols, names=["user_id", "trips", "t0", "t1", "origin_staypoint_id", "destination_staypoint_id", "location_id", "seq"])

    return run


def generate_tours(trips: DataFrame, staypoints: DataFrame | None = None, max_dist: float = 100, max_time="1D", max_nr_gaps: int = 0, planar: bool = False) -> tuple[DataFrame, DataFrame]:
    """(trips with tour_id, a list; tours). Tours are searched in each user's trips in time order.

    Ends meet if their staypoints have one location (with staypoints), or lie within max_dist metres."""
    longest = duration(max_time) if isinstance(max_time, str) or hasattr(max_time, "total_seconds") else None
    if longest is None:
        raise TypeError("max_time must be text or a timedelta")
    trips = trips.drop("tour_id")
    by_location = staypoints is not None
    cols = ["user_id", "id", micros("started_at").alias("t0"), micros("finished_at").alias("t1"), F.col("origin_staypoint_id").alias("o_sp"), F.col("destination_staypoint_id").alias("d_sp")]
    if by_location:
        if "location_id" not in staypoints.columns:
            raise AssertionError("staypoints need a location_id")
        rows = trips.select(*cols)
        for c in ("o", "d"):
            rows = rows.join(staypoints.select(F.col("id").alias(f"{c}_sp"), F.col("location_id").alias(f"{c}_loc")), f"{c}_sp", "left")
    else:
        if "start_geom" not in trips.columns:
            raise AttributeError("trips need geometry where no staypoints are given")
        rows = trips.select(*cols, *(F.col(f"{g}.{a}").alias(f"{c}_{a}") for c, g in (("o", "start_geom"), ("d", "end_geom")) for a in ("x", "y")))
    user = trips.schema["user_id"].dataType.simpleString()
    found = per_user(
        rows, ["t0", "id"], _tours(max_dist, longest, max_nr_gaps, by_location, planar),
        f"user_id {user}, trips array<bigint>, t0 bigint, t1 bigint, origin_staypoint_id bigint, destination_staypoint_id bigint, location_id bigint, seq bigint",
    )
    found = dense_ids(saved(found), [], rank="seq")
    kind = trips.schema["started_at"].dataType.simpleString()
    moment = lambda c: F.timestamp_micros(c).cast(kind)
    tours = found.select("id", "user_id", moment("t0").alias("started_at"), moment("t1").alias("finished_at"), "origin_staypoint_id", "destination_staypoint_id", "trips", "location_id")
    of_trip = found.select(F.explode("trips").alias("id"), F.col("id").alias("tour")).groupBy("id").agg(F.array_sort(F.collect_list("tour")).alias("tour_id"))
    return trips.join(of_trip, "id", "left"), tours


def get_trips_grouped(trips: DataFrame, tours: DataFrame) -> DataFrame:
    """One row for each trip of each tour, in order; group by tour_id as needed."""
    of = tours.select(F.col("id").alias("tour_id"), F.posexplode("trips").alias("position", "_trip"))
    return of.join(trips.drop("tour_id"), F.col("_trip") == F.col("id"), "left").drop("_trip")
