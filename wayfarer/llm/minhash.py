"""Near-duplicate documents by MinHash with tensored banding; every link is confirmed on full shingle sets.

Signatures. Each set gets two collections of `tables` hashes, each made of `rows` minima. A table key combines one hash of the
first collection with one of the second, so tables ** 2 keys come from 2 * tables * rows minima rather than from
2 * tables ** 2 * rows. Two sets meet unless they differ in all of one collection: at similarity s with probability
(1 - (1 - s ** rows) ** tables) ** 2. The defaults (14 and 3) lose 9 of 100,000 pairs at s = 0.8, and far fewer above.

Minima can miss a pair: those of no common key are never compared, about 1 in 10,000 at the threshold.

Groups. Documents with equal sets are one class, stood for by its smallest doc_id, before anything is compared. The classes
that share a key are a bucket; buckets are read in sorted order with no state but the first class, the bucket's hub, and each
class is compared with its hub only. That connects nearly everything without ever making all pairs of a group. Then the classes
that did not end in their hub's component are compared with all classes that met under that component: block by block, and on full
sets wherever two agree in size and in a sketch of their minima (which a pair at the threshold fails once in 100,000).

Comparisons are dealt out by hub, in portions of `portion` classes, so that a hub with very many classes is many tasks' work.

Defined results: null and empty texts, and texts without a word, have an empty set and are linked with nothing; null ids are
linked with nothing and have a null component; rows that share a doc_id are one document (compared by the set with the smallest
digest, if their texts differ) and get one component. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.llm.common import dropped, mix64, slices, written
from wayfarer.llm.components import components
from wayfarer.llm.terms import word_hashes

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
NIBBLES = 16  #: 4-bit pieces of minima in a word of the sketch


def shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashed shingles of each row (sorted within the row), all in one array, and the number of each row's.

    A row with fewer words than a shingle has one: all of its words."""
    h, count, *_ = word_hashes(column, lower=True)
    size = np.where(count >= width, count - width + 1, (count > 0).astype(np.int64))
    row = np.repeat(np.arange(len(count)), size)
    first = (np.cumsum(count) - count)[row] + np.arange(len(row)) - (np.cumsum(size) - size)[row]
    words = np.minimum(count, width)[row]
    g = words.astype(np.uint64)
    for k in range(width):
        on = words > k
        g = np.where(on, mix64(g * MULTIPLIER + h[np.where(on, first + k, 0)]) if len(h) else g, g)
    order = np.lexsort((g, row))
    g, row = g[order], row[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
    return g[new], np.bincount(row[new], minlength=len(count)).astype(np.int64)


def minima(sets: np.ndarray, count: np.ndarray, number: int, seed: int = 20) -> np.ndarray:
    """`number` minima of each set that isn't empty, one row for each."""
    rng = np.random.default_rng(seed)
    a, b = rng.integers(1, 1 << 63, number, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, number, dtype=np.uint64)
    at = (np.cumsum(count) - count)[count > 0]
    out = np.empty((len(at), number), np.uint64)
    for j in range(number if len(at) else 0):
        out[:, j] = np.minimum.reduceat((sets * a[j] + b[j]) ^ ((sets * a[j] + b[j]) >> np.uint64(32)), at)
    return out


def _combined(x: np.ndarray) -> np.ndarray:
    h = np.zeros(x.shape[:-1], np.uint64)
    for c in range(x.shape[-1]):
        h = mix64(h * MULTIPLIER + x[..., c])
    return h


def _sketch_words(number: int) -> int:
    return -(-number // NIBBLES)


def sketches(docs: DataFrame, width: int, tables: int, rows: int) -> DataFrame:
    """For each row: doc_id, the digest of its set (d1, d2), n_shingles, the two collections (a, b) and the sketch (e0, e1, ...)."""
    number = 2 * tables * rows
    words = _sketch_words(number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2_000_000):
            sets, count = shingle_sets(b.column("text"), width)
            full = count > 0
            sig = np.zeros((len(count), number), np.uint64)
            sig[full] = minima(sets, count, number)
            ab = _combined(sig.reshape(len(count), 2 * tables, rows)).view(np.int64)
            e = np.zeros((len(count), words), np.uint64)
            for j in range(number):
                e[:, j // NIBBLES] |= (mix64(sig[:, j]) & np.uint64(15)) << np.uint64(4 * (j % NIBBLES))
            ends = np.cumsum(count)
            raw = np.frombuffer(b"".join(xxhash.xxh3_128_digest(sets[t - n : t].tobytes()) for n, t in zip(count.tolist(), ends.tolist(), strict=True)), "<i8").reshape(-1, 2)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(count) + 1) * tables, pa.int32()), pa.array(np.ascontiguousarray(ab[:, lo : lo + tables]).ravel())) for lo in (0, tables)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()), pa.array(raw[:, 0].copy()), pa.array(raw[:, 1].copy()), pa.array(count), *lists, *(pa.array(e[:, k].copy().view(np.int64)) for k in range(words))],
                names=["doc_id", "d1", "d2", "n", "a", "b", *(f"e{k}" for k in range(words))],
            )

    schema = "doc_id bigint, d1 bigint, d2 bigint, n bigint, a array<bigint>, b array<bigint>" + "".join(f", e{k} bigint" for k in range(words))
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _keys(batches: Iterator[pa.RecordBatch], tables: int) -> Iterator[pa.RecordBatch]:
    """tables ** 2 rows for each class: key, rep, n and the number of the table."""
    for whole in batches:
        for lo in range(0, whole.num_rows, 500):
            b = whole.slice(lo, 500)
            a, c = (b.column(x).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, tables) for x in ("a", "b"))
            number = np.arange(tables * tables)
            key = mix64(mix64(a[:, :, None] * MULTIPLIER + c[:, None, :]).reshape(len(a), -1) + number.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
            rep, n = (np.repeat(b.column(x).to_numpy(zero_copy_only=False), len(number)) for x in ("rep", "n"))
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(rep), pa.array(n * 1024 + np.tile(number, len(a)))], names=["key", "rep", "tag"])


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and rep; those of keys with one row fall out, the others get the key's first row as hub."""
    held = [np.empty(0, np.int64)] * 3  # the last row, if it may begin a bucket
    key0 = hub0 = tag0 = None
    for b in batches:
        key, rep, tag = (np.concatenate([h, b.column(c).to_numpy(zero_copy_only=False)]) for h, c in zip(held, ("key", "rep", "tag"), strict=True))
        if not len(key):
            continue
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        if key0 is not None and key[0] == key0:
            new[0] = False
        head = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
        hub = np.where(head >= 0, rep[head], hub0 if hub0 is not None else 0)
        hub_tag = np.where(head >= 0, tag[head], tag0 if tag0 is not None else 0)
        follows = np.append(~new[1:], False)
        keep = ~new | follows
        if new[-1]:  # whether it has company shows in the next batch
            held, keep = [key[-1:], rep[-1:], tag[-1:]], np.append(keep[:-1], False)
            key0 = hub0 = tag0 = None
        else:
            held = [np.empty(0, np.int64)] * 3
            key0, hub0, tag0 = key[-1], hub[-1], hub_tag[-1]
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (key, tag % 1024, rep, tag // 1024, hub, hub_tag // 1024)], names=["key", "tab", "rep", "n", "hub", "hub_n"])


def _confirm(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by a and portion, the hub's own row (b = a) first: the pairs whose sets are similar enough."""
    own, hub = None, np.empty(0, np.uint64)
    for b in slices(batches, 2_000_000):
        sets, count = shingle_sets(b.column("text"), width)
        ends = np.cumsum(count)
        left, right = [], []
        for k, (a, portion, c) in enumerate(zip(*(b.column(x).to_pylist() for x in ("a", "portion", "b")), strict=True)):
            s = sets[ends[k] - count[k] : ends[k]]
            if a == c:
                own, hub = (a, portion), s.copy()
            elif own == (a, portion) and len(hub) and len(s):
                at = np.searchsorted(hub, s)
                both = int((hub[np.minimum(at, len(hub) - 1)] == s).sum())
                if 100 * both >= percent * (len(hub) + len(s) - both):
                    left.append(a), right.append(c)
        if left:
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int, portion: int = 256) -> DataFrame:
    """Of pairs (a, b) of classes, those with 100 * intersection >= percent * union, on the full sets of their texts (rep, text)."""
    hubs = written(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / portion).cast("int").alias("portions")), "hubs")  # written, so that joins with a hub of very many pairs can be split
    dealt = pairs.join(hubs, "a").select("a", F.pmod(F.hash("b"), "portions").alias("portion"), "b")
    others = dealt.join(texts.withColumnRenamed("rep", "b"), "b").select("a", "portion", "b", "text")
    own = hubs.join(texts.withColumnRenamed("rep", "a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("portions") - 1)).alias("portion"), F.col("a").alias("b"), "text")
    rows = own.union(others).repartition("a", "portion").sortWithinPartitions("a", "portion", F.col("a") != F.col("b"))
    return rows.mapInArrow(lambda it: _confirm(it, width, percent), "a bigint, b bigint")


def _across(placed: DataFrame, classes: DataFrame, texts: DataFrame, sketch: list[str], width: int, percent: int, most: int, block: int = 128, portion: int = 256) -> DataFrame:
    """Links between classes that met in a bucket but ended in different components.

    What met under hubs of one component is a gathering; its strays are the classes of other components. Strays are compared
    with the whole gathering, a block of strays and a portion of the gathering in a task, which gives back links only: no pair
    is written or shuffled, and no gathering is held by one task."""
    unsettled = placed.where("own != hubs").select("key").distinct()
    met = placed.join(unsettled, "key", "left_semi").select(F.col("hubs").alias("h"), "rep", "own").distinct()
    met = written(met, "met")
    stray = F.col("own") != F.col("h")
    sizes = met.groupBy("h").agg(F.greatest(F.lit(1), F.ceil(F.sum(stray.cast("int")) / block)).cast("int").alias("blocks"), F.ceil(F.count(F.lit(1)) / portion).cast("int").alias("portions"))
    of = met.join(written(sizes, "sizes"), "h")
    mine, yours = F.pmod(F.hash("rep"), "blocks").alias("block"), F.pmod(F.hash("rep", F.lit(1)), "portions").alias("portion")
    left = of.where(stray).select("h", "rep", "own", mine, F.explode(F.sequence(F.lit(0), F.col("portions") - 1)).alias("portion"), F.lit(True).alias("first"))
    right = of.select("h", "rep", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), yours, F.lit(False).alias("first"))
    rows = left.union(right).join(classes.select("rep", *sketch), "rep").join(texts, "rep")

    def compare(table: pa.Table) -> pa.Table:
        b = table.combine_chunks()
        sets, count = shingle_sets(b.column("text").combine_chunks(), width)
        ends = np.cumsum(count)
        e = np.stack([b.column(c).to_numpy().view(np.uint64) for c in sketch], 1)
        rep, own, first = (b.column(c).to_numpy() for c in ("rep", "own", "first"))
        x, y = np.flatnonzero(first), np.flatnonzero(~first)
        h, a, z = b.column("h")[0].as_py(), [], []
        for i in x.tolist():
            n = count[y]
            ok = (own[y] != own[i]) & ((own[y] == h) | (rep[y] > rep[i])) & (100 * np.minimum(n, count[i]) >= percent * np.maximum(n, count[i]))
            ok &= np.bitwise_count(e[y] ^ e[i]).sum(1) <= most
            hub = sets[ends[i] - count[i] : ends[i]]
            for j in y[ok].tolist():
                s = sets[ends[j] - count[j] : ends[j]]
                at = np.searchsorted(hub, s)
                both = int((hub[np.minimum(at, len(hub) - 1)] == s).sum())
                if 100 * both >= percent * (len(hub) + len(s) - both):
                    a.append(rep[i]), z.append(rep[j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(z, pa.int64())})

    return rows.groupBy("h", "block", "portion").applyInArrow(compare, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, tables: int = 14, rows: int = 3) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links) and kept."""
    made = written(sketches(docs, width, tables, rows), "sketches")
    usable = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    reps = written(made.where(usable).groupBy("d1", "d2").agg(F.min("doc_id").alias("rep")), "reps")  # written, so that a join with a class of very many copies can be split
    member = made.where(usable).join(reps, ["d1", "d2"])
    sketch = [f"e{k}" for k in range(_sketch_words(2 * tables * rows))]
    classes = member.where("doc_id = rep").groupBy("rep").agg(F.min(F.struct("d1", "d2", "n", "a", "b", *sketch)).alias("s")).select("rep", "s.*")
    classes = written(classes, "classes")

    keys = classes.select("rep", "n", "a", "b").mapInArrow(lambda it: _keys(it, tables), "key bigint, rep bigint, tag bigint")
    buckets = keys.repartition("key").sortWithinPartitions("key", "rep").mapInArrow(_buckets, "key bigint, tab bigint, rep bigint, n bigint, hub bigint, hub_n bigint")
    buckets = written(buckets, "buckets")
    fits = lambda x, y: (100 * F.least(x, y) >= percent * F.greatest(x, y))  # noqa: E731  no similarity is above the ratio of sizes
    met = buckets.select("rep").distinct().join(classes.select("rep", "d1"), "rep")

    def same_set(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(it, 2_000_000):
            sets, count = shingle_sets(b.column("text"), width)
            ends = np.cumsum(count)
            d1 = np.array([int.from_bytes(xxhash.xxh3_128_digest(sets[t - n : t].tobytes())[:8], "little", signed=True) for n, t in zip(count.tolist(), ends.tolist(), strict=True)], np.int64)
            yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("text")], names=["rep", "text"]).filter(pa.array(d1 == b.column("d1").to_numpy(zero_copy_only=False)))

    texts = docs.select(F.col("doc_id").cast("bigint").alias("rep"), "text").join(met, "rep").mapInArrow(same_set, "rep bigint, text string")
    texts = written(texts.dropDuplicates(["rep"]), "texts")

    pairs = written(buckets.where((F.col("rep") != F.col("hub")) & fits(F.col("n"), F.col("hub_n"))).select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")
    links = written(confirmed(pairs, texts, width, percent), "links")
    found = written(components(links), "found")

    def label(df: DataFrame, column: str, to: str) -> DataFrame:
        named = found.select(F.col("node").alias(column), F.col("component").alias(to))
        return df.join(named, column, "left").withColumn(to, F.coalesce(to, column))

    placed = written(label(label(buckets, "rep", "own"), "hub", "hubs"), "placed")
    more = written(_across(placed, classes, texts, sketch, width, percent, far_apart(2 * tables * rows, percent)), "more")
    dropped(buckets, texts, pairs, links, placed)  # all that is read from here on is written
    bridges = label(label(more, "a", "ca"), "b", "cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    joined = components(bridges).select(F.col("node").alias("c1"), F.col("component").alias("c2"))

    roots = label(classes.select("rep"), "rep", "c1").join(joined, "c1", "left").select("rep", F.coalesce("c2", "c1").alias("component_id"))
    kept = member.select("doc_id", "n", "rep").join(roots, "rep").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    shared = kept.groupBy("doc_id").agg(F.min("component_id").alias("least"))  # rows that share an id
    kept = kept.join(shared, "doc_id").select("doc_id", "n_shingles", F.col("least").alias("component_id"))
    alone = made.where(F.col("doc_id").isNull() | (F.col("n") == 0)).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return kept.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def far_apart(number: int, percent: int) -> int:
    """Bits in which two sketches may differ: at similarity percent / 100, more has a chance of under one in 100,000."""
    differ = number * (1 - percent / 100)
    differ += 4.5 * (differ * percent / 100) ** 0.5
    return int(np.ceil(differ * 2 + 4.5 * (differ * 1.0) ** 0.5))
