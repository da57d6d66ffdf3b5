"""Locations: density clusters of staypoints, by user or over all."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.functions.geo import EARTH, buffered_hull, centre, distance, hull, np_haversine, pairwise, point
from wayfarer.functions.time import micros
from wayfarer.operators.graph import components, saved
from wayfarer.operators.ids import dense_ids
from wayfarer.operators.streams import per_user


OFFSETS = range(-2, 3)


class _Plane:
    """Points for the search of neighbours: in a plane or in space (_x, _y, _z), where a chord stands for an arc. Cells are small enough
    that all points of one are within epsilon, and neighbours are in cells that differ by at most two in each direction. Arcs of less
    than half a metre are below what the formula tells apart; there the cells decide."""

    def __init__(self, epsilon: float, planar: bool):
        self.epsilon, self.planar = epsilon, planar
        self.reach = epsilon if planar else 2 * EARTH * float(np.sin(min(epsilon / (2 * EARTH), np.pi / 2)))
        self.side, self.margin = self.reach * 0.99 / 3**0.5, self.reach * 1e-6 + (0.0 if planar else 0.5)

    def placed(self, pts: DataFrame) -> DataFrame:
        if self.planar:
            at = {"_x": F.col("lon"), "_y": F.col("lat"), "_z": F.lit(0.0)}
        else:
            x, y = F.radians("lon"), F.radians("lat")
            at = {"_x": F.cos(y) * F.cos(x) * EARTH, "_y": F.cos(y) * F.sin(x) * EARTH, "_z": F.sin(y) * EARTH}
        pts = pts.withColumns(at)
        return pts.withColumns({f"_c{k}": F.floor(F.col(f"_{k}") / self.side).cast("bigint") for k in "xyz"})

    def near(self, a: str, b: str):
        return distance(self.planar)(F.col(f"{a}.lon"), F.col(f"{a}.lat"), F.col(f"{b}.lon"), F.col(f"{b}.lat")) <= self.epsilon

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        """Whether some point of a and some point of b (rows lon, lat, x, y, z) are neighbours. Halves that are too far apart are left
        out as a whole; only what is on the verge is measured pair by pair."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            (a0, a1), (b0, b1) = ((t[:, 2:].min(0), t[:, 2:].max(0)) for t in (a, b))
            if (np.maximum(0, np.maximum(a0 - b1, b0 - a1)) ** 2).sum() > (self.reach + self.margin) ** 2:
                continue
            few = len(a) * len(b) <= 65536
            p, q = (a, b) if few else (a[:16], b[:16])
            if (pairwise(p, q, self.planar) <= self.epsilon).any():
                return True
            if not few:
                split, other, wide = (a, b, a1 - a0) if len(a) >= len(b) else (b, a, b1 - b0)
                k, half = 2 + int(np.argmax(wide)), len(split) // 2
                split = split[np.argpartition(split[:, k], half)]
                todo += [(split[:half], other), (split[half:], other)]
        return False


def _user_kernel(epsilon: float, least: int, planar: bool):
    """DBSCAN of one user's staypoints in input order: breadth-first from each core point, so that a border point goes to the
    first cluster that reaches it."""

    def one(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        order = np.argsort(y, kind="stable")
        ys = y[order]
        reach = epsilon if planar else np.degrees(epsilon / 6371000.0) * 1.0001

        def near(i: int) -> np.ndarray:
            c = order[np.searchsorted(ys, y[i] - reach, "left") : np.searchsorted(ys, y[i] + reach, "right")]
            d = np.hypot(x[c] - x[i], y[c] - y[i]) if planar else np_haversine(x[i], y[i], x[c], y[c])
            return np.sort(c[d <= epsilon])

        label, k = np.full(len(x), -1, np.int64), 0
        memo: dict[int, np.ndarray] = {}
        for i in range(len(x)):
            if label[i] >= 0:
                continue
            own = memo[i] = near(i)
            if len(own) < least:
                continue
            label[i], queue = k, [i]
            while queue:
                p = queue.pop()
                around = memo.pop(p) if p in memo else near(p)
                if len(around) >= least:
                    fresh = around[label[around] < 0]
                    label[fresh] = k
                    queue += fresh.tolist()
            k += 1
        return label

    def run(rows: pa.RecordBatch, at: np.ndarray) -> pa.RecordBatch:
        x, y = (rows.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("lon", "lat"))
        label = np.concatenate([one(x[a:b], y[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])
        return pa.RecordBatch.from_arrays([rows.column("id"), rows.column("user_id"), pa.array(label)], names=["id", "user_id", "cluster"]).filter(pa.array(label >= 0))

    return run


HULLS_A_PIECE = 256


def _arrays(column: pa.ListArray) -> list[np.ndarray]:
    """The points of each row as (n, 2)."""
    flat, n = column.flatten(), column.value_lengths().to_numpy()
    xy = np.stack([flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1)], 1)
    return np.split(xy, np.cumsum(n)[:-1])


def _hulls(epsilon: float, planar: bool):
    """Piece by piece, in arrays: a ring has 64 corners or more, and a batch 10,000 rings."""

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, HULLS_A_PIECE):
                b = whole.slice(lo, HULLS_A_PIECE)
                mids = b.column("_lat").to_numpy()
                radii = [epsilon] * len(mids) if planar else epsilon / (111320.0 * np.cos(np.radians(mids)))
                rings = [buffered_hull(pts, float(r)) for pts, r in zip(_arrays(b.column("_spots")), radii, strict=True)]
                xy = np.concatenate(rings)
                corners = pa.StructArray.from_arrays([pa.array(xy[:, 0]), pa.array(xy[:, 1])], names=["x", "y"])
                ends = pa.array(np.cumsum([0, *map(len, rings)]), pa.int32())
                rest = [c for c in b.schema.names if c not in ("_spots", "_lat")]
                yield pa.RecordBatch.from_arrays([*map(b.column, rest), pa.ListArray.from_arrays(ends, corners)], names=[*rest, "extent"])

    return run


def _corners(batches):
    """Of a batch's points, only the corners of each location's hull: the hull of all of them has no others."""
    for b in batches:
        of, xy = b.column("location_id").to_numpy(), np.stack([b.column(c).to_numpy() for c in ("lon", "lat")], 1)
        kept = [(k, hull(xy[of == k])) for k in np.unique(of).tolist()]
        if kept:
            pts = np.concatenate([h for _, h in kept])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat([k for k, _ in kept], [len(h) for _, h in kept])), pa.array(pts[:, 0]), pa.array(pts[:, 1])], names=["location_id", "lon", "lat"])


def _dataset_centres(spots: DataFrame, planar: bool) -> DataFrame:
    """(location_id, center) of locations with any number of points, as centre() has it; sums of whole numbers are the same in any order."""
    scale = float(2**50)
    mean = lambda c: F.sum((c * scale).cast("decimal(38,0)")).cast("double") / scale / F.count(F.lit(1))
    x, y = mean(F.col("lon")), mean(F.col("lat"))
    if not planar:
        x = F.degrees(F.atan2(mean(F.sin(F.radians("lon"))), mean(F.cos(F.radians("lon")))))
    return spots.groupBy("location_id").agg(point(x, y).alias("center"))


def generate_locations(
    sp: DataFrame, method: str = "dbscan", epsilon: float = 100, num_samples: int = 1, distance_metric: str = "haversine", agg_level: str = "user",
    activities_only: bool = False, activity_column: str = "activity", extent: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """(staypoints with location_id, locations). Points within epsilon metres are neighbours; a cluster grows from points with
    num_samples neighbours (themselves included). Noise has no location. For agg_level "dataset" the clusters are found over all
    users by a grid join and connected components, and a location has a row for each user that was there."""
    if agg_level not in ("user", "dataset"):
        raise ValueError(f"agg_level unknown: {agg_level!r}")
    if method != "dbscan":
        raise ValueError(f"method unknown: {method!r}")
    planar = distance_metric != "haversine"
    sp = sp.drop("location_id")
    pts = sp
    if activities_only:
        if activity_column not in sp.columns:
            raise KeyError(f"staypoints need {activity_column!r} for activities_only")
        pts = sp.where(F.col(activity_column))
    pts = pts.select("id", "user_id", micros("started_at").alias("t"), "lon", "lat")
    if agg_level == "user":
        label = per_user(pts, ["t", "id"], _user_kernel(epsilon, num_samples, planar), f"id bigint, user_id {sp.schema['user_id'].dataType.simpleString()}, cluster bigint")
        label = saved(label)
        numbers = dense_ids(label.select("user_id", "cluster").distinct(), ["cluster"], "location_id")
        label = label.join(numbers, ["user_id", "cluster"]).select("id", F.col("user_id").alias("_u"), "location_id")
    else:
        label = _dataset(pts, epsilon, num_samples, planar).join(pts.select("id", F.col("user_id").alias("_u")), "id")
    gather = lambda t: t.groupBy("location_id").agg(F.sort_array(F.collect_set(F.struct(F.col("lon").alias("x"), F.col("lat").alias("y")))).alias("_spots"))
    spots = label.join(pts.select("id", "lon", "lat"), "id")
    user = sp.schema["user_id"].dataType.simpleString()
    if agg_level == "user":
        locs = gather(spots).withColumn("center", centre(F.col("_spots"), planar))
    else:
        spots = spots.select("location_id", "lon", "lat").distinct()
        locs = _dataset_centres(spots, planar)
        if extent:
            locs = locs.join(gather(spots.mapInArrow(_corners, "location_id bigint, lon double, lat double")), "location_id")
    locs = locs.withColumnRenamed("location_id", "id")
    if extent:
        shaped = locs.select("id", "center", "_spots", F.col("center.y").alias("_lat"))
        locs = shaped.mapInArrow(_hulls(epsilon, planar), "id bigint, center struct<x:double,y:double>, extent array<struct<x:double,y:double>>")
    # users come last: what a location has is made once, and not for each of its users
    users = label.select(F.col("_u").alias("user_id"), F.col("location_id").alias("id")).distinct()
    locs = users.join(locs, "id").select("id", "user_id", "center", *(["extent"] if extent else []))
    return sp.join(label.select("id", "location_id"), "id", "left"), locs


def _dataset(pts: DataFrame, epsilon: float, least: int, planar: bool) -> DataFrame:
    """(id, location_id) over all users, numbered by the first core point in order of user and time.

    Equal points are one spot that counts several times. Points of one cell are all neighbours, so cells are linked and not points: by a
    few of their points, and where these don't tell and other links don't either, by all of them. Only points of cells with fewer than
    least have their neighbours counted."""
    plane = _Plane(epsilon, planar)
    finite = lambda c: F.col(c).isNotNull() & (F.abs(c) < float("inf"))
    pts = pts.where(finite("lon") & finite("lat"))
    spots = pts.groupBy("lon", "lat").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("spot"), F.min(F.struct("user_id", "t", "id")).alias("first"))
    spots = saved(plane.placed(spots))
    box = [f(f"_{k}").alias(f"_{k}{e}") for k in "xyz" for e, f in enumerate((F.min, F.max))]
    keys = ["_cx", "_cy", "_cz"]
    cells = spots.groupBy(*keys).agg(F.sum("n").alias("w"), F.min("spot").alias("cell"), *box)
    spots = saved(spots.join(cells.select(*keys, "cell", "w"), keys))
    cells = saved(cells)
    moves = F.array(*(F.struct(*(F.lit(d).alias(f"d{k}") for k, d in zip("xyz", (i, j, l), strict=True))) for i in OFFSETS for j in OFFSETS for l in ([0] if planar else OFFSETS)))
    moved = cells.withColumn("_d", F.explode(moves)).select(F.col("cell").alias("a"), *((F.col(f"_c{k}") + F.col(f"_d.d{k}")).alias(f"_c{k}") for k in "xyz"), *(F.col(f"_{k}{e}").alias(f"_a{k}{e}") for k in "xyz" for e in (0, 1)))
    gap = lambda k: F.greatest(F.lit(0.0), F.col(f"_a{k}0") - F.col(f"_{k}1"), F.col(f"_{k}0") - F.col(f"_a{k}1"))
    apart = gap("x") * gap("x") + gap("y") * gap("y") + gap("z") * gap("z")
    around = saved(moved.join(cells, keys).where(apart <= (plane.reach + plane.margin) ** 2).select("a", F.col("cell").alias("b")))

    def met(few: DataFrame, many: DataFrame) -> DataFrame:
        """p of few and q of many that are neighbours."""
        p, q = few.select(F.struct(*few.columns).alias("p"), F.col("cell").alias("a")), many.select(F.struct(*many.columns).alias("q"), F.col("cell").alias("b"))
        return p.join(around, "a").join(q, "b").where(plane.near("p", "q"))

    core = spots
    if least > 1:
        sparse = spots.where(F.col("w") < least)
        counted = met(sparse, spots).groupBy(F.col("p.spot").alias("spot")).agg(F.sum("q.n").alias("_near")).where(F.col("_near") >= least)
        core = saved(spots.where(F.col("w") >= least).union(sparse.join(counted.select("spot"), "spot", "left_semi").select(*spots.columns)))
    core = core.join(_linked_cells(core, around, plane), "cell", "left").withColumn("cluster", F.coalesce("component", "cell"))
    core = saved(core.select("spot", "lon", "lat", "cell", "first", "cluster"))
    firsts = core.groupBy("cluster").agg(F.min("first").alias("first"))
    firsts = dense_ids(firsts.select("cluster", F.col("first.user_id").alias("user_id"), F.col("first.t").alias("t"), F.col("first.id").alias("i")), ["t", "i"], "location_id")
    core = core.join(firsts.select("cluster", "location_id"), "cluster")
    found = core.select("lon", "lat", "location_id")
    if least > 1:
        border = met(sparse.join(core, "spot", "left_anti"), core).groupBy(F.col("p.lon").alias("lon"), F.col("p.lat").alias("lat")).agg(F.min("q.location_id").alias("location_id"))
        found = found.union(border)
    return saved(pts.join(found, ["lon", "lat"]).select("id", "location_id"))


def _linked_cells(core: DataFrame, around: DataFrame, plane: _Plane) -> DataFrame:
    """(cell, component) of cells with core points that some link joins to another."""
    spot = F.struct("lon", "lat")
    some = core.groupBy("cell").agg(F.array(*(f(spot, w) for w in (spot, F.struct("lat", "lon")) for f in (F.min_by, F.max_by))).alias("_ends"))
    seen = lambda s: some.select(F.col("cell").alias(s), F.col("_ends").alias(f"_{s}"))
    d = distance(plane.planar)
    hit = F.exists("_a", lambda p: F.exists("_b", lambda q: d(p["lon"], p["lat"], q["lon"], q["lat"]) <= plane.epsilon))
    pairs = saved(around.where("a < b").join(seen("a"), "a").join(seen("b"), "b").select("a", "b", hit.alias("hit")))
    links = pairs.where("hit").select("a", "b")
    label = components(links)
    of = lambda s: label.select(F.col("node").alias(s), F.col("component").alias(f"_{s}"))
    open_ = pairs.where("not hit").join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select("a", "b")
    point_ = [F.col(c).cast("double") for c in ("lon", "lat", "_x", "_y", "_z")]
    sides = [open_.join(core.withColumnRenamed("cell", s), s).select("a", "b", F.lit(k).alias("side"), *point_) for k, s in enumerate("ab")]

    def test(t: pa.Table) -> pa.Table:
        side, pts = t.column("side").to_numpy(), np.stack([t.column(c).to_numpy() for c in ("lon", "lat", "_x", "_y", "_z")], 1)
        return t.select(["a", "b"]).slice(0, int(plane.linked(pts[side == 0], pts[side == 1])))

    more = saved(sides[0].union(sides[1]).groupBy("a", "b").applyInArrow(test, "a bigint, b bigint"))
    if not more.isEmpty():
        label = components(links.union(more))
    return label.select(F.col("node").alias("cell"), "component")
