"""Spatial filter, distance matrices, and the time overlap of labels with triplegs."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfarer.functions import geo
from wayfarer.functions.crs import to_crs
from wayfarer.functions.time import micros, overlap_ratio
from wayfarer.operators.graph import saved

#: A task of a distance matrix measures about so many points against as many, or so many lines (of so many points in all).
POINTS_A_TASK, LINES_A_TASK, VERTICES_A_TASK = 4096, 2048, 200_000


def spatial_filter(source: DataFrame, areas: list[list[list[tuple[float, float]]]], method: str = "within", re_project: bool = False, crs: int | None = None, areas_crs: int | None = None) -> DataFrame:
    """Rows whose point (lon, lat) or line (geom) is within, intersects, or crosses the union of polygons, given as closed rings
    (the outer one first). Areas are given as values, so they travel with the plan; a bounding box goes before the exact test.

    With re_project, the test is made in the areas' coordinate system; what passes comes back with its own coordinates."""
    if re_project:
        if crs is None or areas_crs is None:
            raise ValueError("re_project needs both coordinate systems")
        own = [c for c in ("lon", "lat", "geom") if c in source.columns]
        moved = to_crs(source.select(*own, F.struct(*source.columns).alias("_own")), crs, areas_crs)
        return spatial_filter(moved, areas, method).select("_own.*")
    if method not in ("within", "intersects", "crosses"):
        raise ValueError(f"method unknown: {method!r}")
    polygons = [[np.array(r, float) for r in p] for p in areas]
    line = "geom" in source.columns
    if not polygons:
        return source.where(F.lit(False))
    if not line and method == "crosses":
        return source.where(F.lit(False))  # a point has no part outside
    boxes = [(p[0][:, 0].min(), p[0][:, 0].max(), p[0][:, 1].min(), p[0][:, 1].max()) for p in polygons]
    if line:
        xs, ys = F.transform("geom", lambda p: p["x"]), F.transform("geom", lambda p: p["y"])
        x0, x1, y0, y1 = F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)
    else:
        x0, x1, y0, y1 = F.col("lon"), F.col("lon"), F.col("lat"), F.col("lat")
    near = F.lit(False)
    for a, b, c, d in boxes:
        near = near | ((x0 <= float(b)) & (x1 >= float(a)) & (y0 <= float(d)) & (y1 >= float(c)))

    if not line:

        @F.pandas_udf("boolean")
        def hit(x: pd.Series, y: pd.Series) -> pd.Series:
            x, y = x.to_numpy(float), y.to_numpy(float)
            found = np.zeros(len(x), bool)
            for p in polygons:
                within, edge = geo.inside(x, y, p)
                found |= within | edge if method == "intersects" else within
            return pd.Series(found)

        return source.where(near).where(hit("lon", "lat"))

    @F.pandas_udf("boolean")
    def hit_line(lines: pd.Series) -> pd.Series:
        out = []
        for pts in lines:
            xy = np.array([(p["x"], p["y"]) for p in pts], float)
            some, beyond = geo.line_in_areas(xy, polygons)
            touches = some or any(np.logical_or(*geo.inside(xy[:, 0], xy[:, 1], p)).any() for p in polygons)
            out.append({"within": some and not beyond, "intersects": touches, "crosses": some and beyond}[method])
        return pd.Series(out)

    return source.where(near).where(hit_line("geom"))


def _dealt(a: DataFrame, b: DataFrame, rows: int) -> DataFrame:
    """All rows of a with all of b, both of them written tables, in tasks of about rows x rows. Few bytes make many pairs, so tasks that Spark
    sizes by bytes get too many."""
    a, b = (t.repartition(max(1, -(-t.count() // rows))) for t in (a, b))
    return a.hint("shuffle_replicate_nl").crossJoin(b)


def _line_blocks(lines: DataFrame) -> DataFrame:
    """Lines in rows of many each: ids, numbers of points, and all coordinates. Equal lines are in one block if it holds them."""

    def run(batches):
        for b in batches:
            n = b.column("n").to_numpy()
            weight, lo = np.cumsum(n), 0
            while lo < len(n):
                hi = np.searchsorted(weight, weight[lo] - n[lo] + VERTICES_A_TASK, "right")
                hi = min(len(n), lo + LINES_A_TASK, max(int(hi), lo + 1))
                cut = b.slice(lo, hi - lo)
                columns = [cut.column("id"), cut.column("n"), cut.column("x").flatten(), cut.column("y").flatten()]
                rows = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns]
                yield pa.RecordBatch.from_arrays(rows, names=["ids", "n", "x", "y"])
                lo = hi

    side = lambda c: F.coalesce(F.transform("geom", lambda p: p[c].cast("double")), F.array().cast("array<double>"))
    flat = lines.select("id", side("x").alias("x"), side("y").alias("y")).withColumn("n", F.size("x"))
    flat = flat.repartition("x", "y").sortWithinPartitions("n", "x", "y")
    return saved(flat.mapInArrow(run, f"ids array<{lines.schema['id'].dataType.simpleString()}>, n array<int>, x array<double>, y array<double>"))


def _line_matrix(x: DataFrame, y: DataFrame | None, kind: str) -> DataFrame:
    """Python gets blocks of lines, not pairs of them, and gives back the distances of two blocks piece by piece."""
    a = _line_blocks(x)
    b = a if y is None else _line_blocks(y)

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                part = {c: batch.column(c).slice(k, 1).flatten() for c in batch.schema.names}
                ids = {s: part[f"{s}_ids"] for s in "ab"}
                sides = {s: geo.shapes(*(part[f"{s}_{c}"].to_numpy(zero_copy_only=False) for c in ("n", "x", "y"))) for s in "ab"}
                d, m = geo.line_matrix(sides["a"], sides["b"], kind), len(ids["b"])
                step = max(1, 65536 // m)
                for lo in range(0, len(d), step):
                    some = d[lo : lo + step]
                    i = ids["a"].take(pa.array(np.repeat(np.arange(lo, lo + len(some)), m)))
                    j = ids["b"].take(pa.array(np.tile(np.arange(m), len(some))))
                    yield pa.RecordBatch.from_arrays([i, j, pa.array(some.reshape(-1), from_pandas=True)], names=["i", "j", "distance"])

    named = lambda t, s: t.select(*(F.col(c).alias(f"{s}_{c}") for c in t.columns))
    types = [t.schema["ids"].dataType.elementType.simpleString() for t in (a, b)]
    return _dealt(named(a, "a"), named(b, "b"), 1).mapInArrow(run, f"i {types[0]}, j {types[1]}, distance double")


def distance_matrix(x: DataFrame, y: DataFrame | None = None, dist_metric: str | Callable[[Column, Column, Column, Column], Column] = "haversine", p: float = 2.0) -> DataFrame:
    """(i, j, distance) for all rows of x and y (or x itself): what a distance matrix is, so its size is the product of theirs.
    Points: haversine, euclidean (l2), manhattan (l1, cityblock), chebyshev, minkowski, sqeuclidean, canberra, braycurtis, cosine, or a function of
    the columns x1, y1, x2, y2 (which may call a pandas UDF). Lines: dtw, frechet."""
    if dist_metric in ("dtw", "frechet"):
        return _line_matrix(x, y, dist_metric)
    spots = lambda t: t.select("id", "lon", "lat")
    dx, dy = F.abs(F.col("_x1") - F.col("_x2")), F.abs(F.col("_y1") - F.col("_y2"))
    x1, y1, x2, y2 = map(F.col, ("_x1", "_y1", "_x2", "_y2"))
    share = lambda d, whole: F.when(whole == 0, F.when(d == 0, 0.0)).otherwise(d / F.when(whole != 0, whole))
    norms = F.sqrt(x1 * x1 + y1 * y1) * F.sqrt(x2 * x2 + y2 * y2)
    known = {
        "haversine": geo.haversine(F.col("_x1"), F.col("_y1"), F.col("_x2"), F.col("_y2")),
        "euclidean": geo.euclidean(F.col("_x1"), F.col("_y1"), F.col("_x2"), F.col("_y2")),
        "sqeuclidean": dx * dx + dy * dy, "manhattan": dx + dy, "cityblock": dx + dy, "chebyshev": F.greatest(dx, dy), "minkowski": F.pow(F.pow(dx, p) + F.pow(dy, p), F.lit(1 / p)),
        "l1": dx + dy, "l2": geo.euclidean(x1, y1, x2, y2), "canberra": share(dx, F.abs(x1) + F.abs(x2)) + share(dy, F.abs(y1) + F.abs(y2)), "braycurtis": share(dx + dy, F.abs(x1 + x2) + F.abs(y1 + y2)),
        "cosine": F.when(norms == 0, F.lit(1.0)).otherwise(F.lit(1.0) - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (x1 * x2 + y1 * y2) / F.when(norms != 0, norms)))),
    }
    if callable(dist_metric):
        known[dist_metric] = dist_metric(x1, y1, x2, y2)
    if dist_metric not in known:
        raise ValueError(f"dist_metric unknown: {dist_metric!r}")
    a = saved(spots(x))  # once for both sides, and for their number
    b = a if y is None else saved(spots(y))
    named = lambda t, *names: t.select(*(F.col(c).alias(n) for c, n in zip(t.columns, names, strict=True)))
    pairs = _dealt(named(a, "i", "_x1", "_y1"), named(b, "j", "_x2", "_y2"), POINTS_A_TASK)
    return pairs.select("i", "j", known[dist_metric].alias("distance"))


def add_modes_to_triplegs(tpls: DataFrame, labels: DataFrame, ratio_threshold: float = 0.5, max_triplegs: int = 20, max_duration_tripleg: float = 7 * 24 * 60 * 60) -> DataFrame:
    """mode and label_id of the label that covers the largest share of a tripleg, if that is at least ratio_threshold.

    Each label looks at the max_triplegs triplegs of its user with the nearest start and end, and none farther than
    max_duration_tripleg seconds. The range join is an equi-join on time slots of that length."""
    far = int(max_duration_tripleg * 1_000_000)
    t = tpls.select("user_id", F.col("id").alias("_tpl"), micros("started_at").alias("a0"), micros("finished_at").alias("a1"))
    b = labels.select("user_id", F.col("id").alias("label_id"), "mode", micros("started_at").alias("b0"), micros("finished_at").alias("b1"))
    t = t.withColumn("_slot", F.floor(F.col("a0") / far).cast("bigint"))
    slot = F.floor(F.col("b0") / far).cast("bigint")
    b = b.withColumn("_slot", F.explode(F.array(slot - 1, slot, slot + 1)))
    gap = F.greatest(F.abs(F.floor(F.col("a0") / 1e6) - F.floor(F.col("b0") / 1e6)), F.abs(F.floor(F.col("a1") / 1e6) - F.floor(F.col("b1") / 1e6)))
    near = t.join(b, ["user_id", "_slot"]).withColumn("_gap", gap).where(F.col("_gap") <= max_duration_tripleg)
    near = near.withColumn("_k", F.row_number().over(Window.partitionBy("user_id", "label_id").orderBy("_gap", "_tpl"))).where(F.col("_k") <= max_triplegs)
    near = near.withColumn("ratio", overlap_ratio(F.col("a0"), F.col("a1"), F.col("b0"), F.col("b1"))).where(F.col("ratio") >= ratio_threshold)
    best = near.groupBy(F.col("_tpl").alias("id")).agg(F.max_by(F.struct("label_id", "mode"), F.struct("ratio", F.col("label_id"))).alias("_l"))
    return tpls.drop("mode", "label_id").join(best.select("id", F.col("_l.label_id").alias("label_id"), F.col("_l.mode").alias("mode")), "id", "left")
