"""Near-duplicate vectors: spherical k-means cells, blocked cosine products within cells, one representative per group.

Equal vectors are one class, stood for by the smallest id, so that copies are never compared with each other. Centroids are
fitted on a bounded sample (fit_rows classes); every class is assigned to its nearest centroid's cell and visits the cells
whose cosine is at most `margin` below. In a cell, residents are compared with each other and with visitors. A pair that could be
found in both of its vectors' cells counts in the one with the smaller number, so numbers of links are exact for what is found.

A cell is dealt out in blocks of `block` vectors, each packed into one row. Each pair of a cell's blocks is multiplied by itself, so
no task holds a whole cell, and what is copied for the pairs are blocks, not vectors. The number of links of each vector in a dense
group is the number of its pairs, so that work grows with the square of such a group. What comes back of a pair of blocks is numbers
of links and a spanning forest of the links found, not the links.

How many links are found: two vectors with cosine 0.9 or more differ in their cosine with any third by little; a pair is missed
only if neither vector visits the other's cell. tests/llm/test_vectors.py measures that against brute force (0.9995 without
visits, all with them).

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and vectors with a null id, are
linked with nothing; vectors of different lengths aren't compared; rows that share an id count as that many vectors but get one
component. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.llm.common import written
from wayfarer.llm.components import components
from wayfarer.llm.langid import spherical_kmeans


def _unit(rows: np.ndarray) -> np.ndarray:
    x = rows.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # neither overflows nor underflows when squared
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return _unit(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Of links i - j between n things, as many as connect what they connect."""
    root, out = list(range(n)), []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        while root[a] != a:
            root[a] = a = root[root[a]]
        while root[b] != b:
            root[b] = b = root[root[b]]
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((a, b))
    return out


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.9, margin: float = 0.12, fit_rows: int = 20_000, per_cell: int = 1000, most_cells: int = 2048, block: int = 1500) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id (the smallest vec_id reachable by links) and kept."""
    spark = vectors.sparkSession
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    good = F.coalesce(F.col("vec_id").isNotNull() & finite & F.exists(x, lambda v: v != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), x.alias("x"), good.alias("good"))
    usable = rows.where("good").select("vec_id", F.transform("x", lambda v: v + F.lit(0.0)).alias("x")).select("vec_id", "x", F.xxhash64("x").alias("h1"), F.xxhash64(F.lit(7), "x").alias("h2"), F.size("x").alias("dim"))
    classes = written(usable.groupBy("h1", "h2", "dim").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min("x").alias("x")), "classes")
    sizes = classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    alone = rows.where(~F.col("good")).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not sizes:
        return alone
    dim, n = sizes[0]["dim"], sizes[0]["n"]  # the length that most vectors have; the others form a cell for each length
    sample = classes.where((F.col("dim") == dim) & (F.pmod(F.xxhash64(F.lit(3), "rep"), F.lit(1 << 20)) < F.lit((1 << 20) * fit_rows / n))).select("rep", "x").collect()  # about fit_rows
    fit = _unit(np.array([r["x"] for r in sorted(sample)])) if sample else np.zeros((0, dim))
    k = min(most_cells, max(1, -(-n // per_cell)))
    shared = spark.sparkContext.broadcast(spherical_kmeans(fit, k) if len(fit) else np.eye(1, dim))  # most_cells * dim numbers at most

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                b = whole.slice(lo, 2000)
                length = b.column("dim").to_numpy(zero_copy_only=False)
                home, visits = -length.astype(np.int32), [[] for _ in length]
                own = np.flatnonzero(length == dim)
                if len(own):
                    cos = _matrix(b.column("x").take(pa.array(own)), dim) @ c.T
                    home[own] = cos.argmax(1)
                    near = cos >= cos.max(1, keepdims=True) - margin
                    near[np.arange(len(own)), home[own]] = False
                    for i, row in zip(own.tolist(), near, strict=True):
                        visits[i] = np.flatnonzero(row).tolist()
                yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("copies"), b.column("x"), pa.array(home), pa.array(visits, pa.list_(pa.int32()))], names=["rep", "copies", "x", "home", "visits"])

    placed = written(classes.mapInArrow(assign, "rep bigint, copies bigint, x array<double>, home int, visits array<int>"), "placed")
    stays = placed.withColumn("cell", F.explode(F.concat(F.array("home"), "visits")))
    blocks = written(stays.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")), "blocks")
    dealt = stays.join(blocks, "cell").withColumn("mine", F.pmod(F.hash("rep"), "blocks"))

    def pack(table: pa.Table) -> pa.Table:
        """One row of lists of a block's rows; vectors lie one after another."""
        b = table.combine_chunks()
        flat = b.column("x").combine_chunks().flatten()
        lists = {c: pa.ListArray.from_arrays([0, b.num_rows], b.column(c).combine_chunks()) for c in ("rep", "copies", "home", "visits")}
        return pa.table({"cell": b.column("cell")[:1], "mine": b.column("mine")[:1], "blocks": b.column("blocks")[:1], **lists, "x": pa.ListArray.from_arrays([0, len(flat)], flat)})

    packed = dealt.groupBy("cell", "mine").applyInArrow(pack, "cell int, mine int, blocks int, rep array<bigint>, copies array<bigint>, home array<int>, visits array<array<int>>, x array<double>")
    packed = written(packed, "packed")
    dealt = packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("cell", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"), "mine", "rep", "copies", "home", "visits", "x")

    def compare(table: pa.Table) -> pa.Table:
        b = table.combine_chunks().sort_by("mine")
        size = b.column("rep").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
        rep, copies, home = (b.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("rep", "copies", "home"))
        mine = np.repeat(b.column("mine").to_numpy(), size)
        cell, p, q = (b.column(c)[0].as_py() for c in ("cell", "p", "q"))
        flat = b.column("x").combine_chunks().flatten()
        v = _unit(flat.to_numpy(zero_copy_only=False).reshape(len(rep), -1))
        visits = b.column("visits").combine_chunks().flatten()
        other = np.repeat(np.arange(len(rep)), visits.value_lengths().to_numpy(zero_copy_only=False))
        goes = set(zip(other.tolist(), visits.flatten().to_numpy(zero_copy_only=False).tolist(), strict=True))
        left, right = np.flatnonzero(mine == p), np.flatnonzero(mine == q)
        i, j = np.nonzero(v[left] @ v[right].T >= threshold)
        i, j = left[i], right[j]
        on = (i < j) if p == q else np.ones(len(i), bool)
        on &= (home[i] == cell) | (home[j] == cell)
        i, j = i[on], j[on]
        mixed = np.flatnonzero(home[i] != home[j])
        if len(mixed):  # found in the other's cell too? then the smaller cell counts it
            drop = []
            for m in mixed.tolist():
                a, z = (i[m], j[m]) if home[i[m]] == cell else (j[m], i[m])
                if home[z] < cell and (int(a), int(home[z])) in goes:
                    drop.append(m)
            i, j = np.delete(i, drop), np.delete(j, drop)
        links = np.bincount(i, copies[j], len(rep)) + np.bincount(j, copies[i], len(rep))
        some = np.flatnonzero(links)
        tree = _forest(i, j, len(rep))
        a, z = ([rep[t[k]] for t in tree] for k in (0, 1))
        return pa.table(
            {
                "rep": pa.array([*rep[some], *[None] * len(tree)], pa.int64()), "links": pa.array([*links[some].astype(np.int64), *[None] * len(tree)], pa.int64()),
                "a": pa.array([*[None] * len(some), *a], pa.int64()), "b": pa.array([*[None] * len(some), *z], pa.int64()),
            }
        )

    found = dealt.groupBy("cell", "p", "q").applyInArrow(compare, "rep bigint, links bigint, a bigint, b bigint")
    found = written(found, "found")
    numbers = found.where("rep is not null").groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(found.where("a is not null").select("a", "b")).withColumnsRenamed({"node": "rep", "component": "root"})
    known = classes.select("h1", "h2", "dim", "rep", "copies").join(numbers, "rep", "left").join(roots, "rep", "left")
    known = known.select("h1", "h2", "dim", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("root"))
    out = usable.drop("x").join(known, ["h1", "h2", "dim"]).select("vec_id", "n_links", "root")
    shared_ids = out.groupBy("vec_id").agg(F.min("root").alias("component_id"))
    out = out.join(shared_ids, "vec_id").select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    return out.union(alone)
