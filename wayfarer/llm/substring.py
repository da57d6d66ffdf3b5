"""Removal of repeated passages: seed and extend.

Every window of `window` words has one anchor: of the SEED-word seeds in it, the last of those with the smallest hash (winnowing).
Equal windows have equal anchors at equal places, so equal windows are found by joining documents on anchors alone, a few for
each hundred words. An anchor's context is all windows that have it as their anchor.

- Anchors that occur once are dropped: no window around them is repeated.
- Occurrences of an anchor with equal contexts form a class. All but the first of a class match it as far as the context goes. A
  passage found in a third of all documents is so reduced to a few rows.
- Where an anchor has several classes, because the texts part ways near it, the first of each class is paired with the anchor's
  earliest occurrence, and the match is extended left and right, word by word, until words differ. A match of `window` words or
  more is a repeat. Occurrences that part from the earliest one at the same word can have more in common with each other than with
  it; so those that share the word at which they part, on the left or on the right, are paired with the earliest of them in the
  same way, and so on. Only windows that reach beyond that word are still looked for, so each round adds a word at least to what
  is common and takes one away at the other end: there are window - SEED rounds at most, and few occurrences after the first. The
  rounds of keys with at most LOCAL occurrences are made within a task, from which nothing but matches comes back; those of keys
  with more are joins between written tables, which Spark can split.

Matches merge into maximal repeats, and their words are removed. They are judged on the input, so the result does not depend on
the order of work. Words are compared by 64-bit hashes, one by one.

Defined results: "earlier" means a smaller doc_id or, in the same document, an earlier start; a null doc_id comes before all
others. Rows that share a doc_id are no earlier than each other at the same start. Null and empty texts have no words and give
the hash of the empty text. Texts shorter than a window are left alone. Repeated rows give repeated results. Extra columns are
ignored, unless kept by the caller.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.llm.common import mix64, slices, written
from wayfarer.llm.terms import word_hashes

SEED = 5  #: words of a seed
LOCAL = 256  #: occurrences of a key that one task works on alone
SLICE = 3_000_000  #: bytes of text in which repeats are marked before anything is written
PIECE = 500_000  #: bytes of text in which anchors are found at once
BASE = 0x2545F4914F6CDD1D  #: odd, so that its powers have inverses modulo 2**64
FIRST = -(1 << 63)


class Ranges:
    """Hashes of ranges of words, from prefix sums of the word hashes times powers of BASE."""

    def __init__(self, h: np.ndarray):
        powers, self.inverse = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(h), b, np.uint64)]), dtype=np.uint64) for b in (BASE, pow(BASE, -1, 1 << 64)))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers[:-1], dtype=np.uint64)])

    def of(self, lo: np.ndarray, hi: np.ndarray, more: np.ndarray) -> np.ndarray:
        return mix64((self.sums[hi] - self.sums[lo]) * self.inverse[lo] + mix64((hi - lo).astype(np.uint64) * np.uint64(1 << 20) + more.astype(np.uint64)))


def anchors(h: np.ndarray, count: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Of word hashes of many texts: (text, anchor hash, context hash, first word, end word, seed's first word) of each anchor, words counted in h."""
    n, none = len(h), np.empty(0, np.int64)
    if n < window:
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none, none
    g = np.zeros(n - SEED + 1, np.uint64)
    for k in range(SEED):
        g = mix64(g * np.uint64(0x9E3779B97F4A7C15) + h[k : n - SEED + 1 + k])
    width, span = window - SEED + 1, 1
    low, at = g, np.arange(len(g))
    while span * 2 <= width:  # the last of the smallest in span, 2 span, 4 span ... seeds
        right = low[span:] <= low[: len(low) - span]
        low, at = np.where(right, low[span:], low[: len(low) - span]), np.where(right, at[span:], at[: len(at) - span])
        span *= 2
    gap = width - span
    if gap:
        right = low[gap:] <= low[: len(low) - gap]
        at = np.where(right, at[gap:], at[: len(at) - gap])
    ends = np.cumsum(count)
    starts = np.repeat(ends - count, np.maximum(count - window + 1, 0))
    s = starts + np.arange(len(starts)) - np.repeat(np.cumsum(np.maximum(count - window + 1, 0)) - np.maximum(count - window + 1, 0), np.maximum(count - window + 1, 0))
    text = np.repeat(np.arange(len(count)), np.maximum(count - window + 1, 0))
    if not len(s):
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none, none
    at = at[s]
    new = np.ones(len(s), bool)
    new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    i = np.flatnonzero(new)
    last = np.concatenate([i[1:], [len(s)]]) - 1
    lo, hi, p = s[i], s[last] + window, at[i]
    return text[i], g[p], Ranges(h).of(lo, hi, p - lo), lo, hi, p


_SEEDS = "anchor bigint, context bigint, doc bigint, tid int, lo int, hi int, at int, again boolean"


def _keyed(docs: DataFrame) -> DataFrame:
    """doc (the id, or the least value for null) and tid (a hash that tells apart rows that share an id)."""
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(FIRST)).alias("doc"), F.hash("text").alias("tid"), "text")


def _seeded(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Anchors are found in pieces of a slice, as that takes many arrays of the length of the words; what repeats is marked over
    all anchors of the slice, which are few."""
    for b in slices(batches, SLICE):
        parts = []
        for piece in slices(iter([b]), PIECE):
            h, count, *_ = word_hashes(piece.column("text"))
            text, anchor, context, lo, hi, at = anchors(h, count, window)
            base = (np.cumsum(count) - count)[text]
            ids = [piece.column(c).to_numpy(zero_copy_only=False)[text] for c in ("doc", "tid")]
            parts.append((anchor, context, *ids, *(x.astype(np.int32) for x in (lo - base, hi - base, at - base))))
        anchor, context, doc, tid, lo, hi, at = map(np.concatenate, zip(*parts, strict=True))
        order = np.lexsort((lo, doc, context, anchor))
        a, c, d, s = anchor[order], context[order], doc[order], lo[order]
        same = np.zeros(len(order), bool)
        same[1:] = (a[1:] == a[:-1]) & (c[1:] == c[:-1])
        head = np.maximum.accumulate(np.where(~same, np.arange(len(order)), 0))
        again = np.zeros(len(order), bool)
        again[order] = (d != d[head]) | (s != s[head])
        yield pa.RecordBatch.from_arrays(
            [pa.array(anchor.view(np.int64)), pa.array(context.view(np.int64)), pa.array(doc), pa.array(tid), pa.array(lo), pa.array(hi), pa.array(at), pa.array(again)],
            names=["anchor", "context", "doc", "tid", "lo", "hi", "at", "again"],
        )


def seeds(docs: DataFrame, window: int) -> DataFrame:
    """The anchors of all texts. Within a slice of the input, `again` marks those whose context starts earlier in the slice."""
    return _keyed(docs).mapInArrow(lambda it: _seeded(it, window), _SEEDS)


_ROWS = "key bigint, anchor bigint, known_left int, known_right int, doc bigint, tid int, at int, left binary, right binary"
_STEP = ["key", "anchor", "known_left", "known_right", "doc", "tid", "at", "left", "right", "lo", "hi"]
_C = np.uint64(0x9E3779B97F4A7C15)


def _words(h: np.ndarray, start: np.ndarray, n: np.ndarray, step: int) -> pa.Array:
    """Word hashes as binary values: n[i] of them from start[i] on, going right (step 1) or left (step -1)."""
    sums = np.cumsum(n)
    index = np.repeat(start, n) + step * (np.arange(int(n.sum())) - np.repeat(sums - n, n))
    return pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((8 * np.concatenate([[0], sums])).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(h[index]))])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each anchor listed in `seeds` of a text: the words of its context to the left and to the right of the seed."""
    for b in slices(batches):
        h, count, *_ = word_hashes(b.column("text"))
        lists = b.column("seeds")
        row = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
        flat = lists.flatten()
        anchor, lo, hi, at = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4))
        base, none = (np.cumsum(count) - count)[row], pa.array(np.zeros(len(row), np.int32))
        yield pa.RecordBatch.from_arrays(
            [pa.array(anchor), pa.array(anchor), none, none, b.column("doc").take(pa.array(row)), b.column("tid").take(pa.array(row)), pa.array(at.astype(np.int32)), _words(h, base + at - 1, at - lo, -1), _words(h, base + at + SEED, hi - at - SEED, 1)],
            names=_STEP[:9],
        )


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of word hashes (0 beyond their end), and the number of each row's."""
    column = column.cast(pa.large_binary())
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    n = np.diff(offs) // 8
    out = np.zeros((len(n), width), np.uint64)
    if data is not None and n.sum():
        out[np.arange(width) < n[:, None]] = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]].view(np.uint64)
    return out, n


def _common(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How many words from the seed on are equal."""
    (x, n), (y, m) = a, b
    differ = (x != y) | (np.arange(x.shape[1]) >= np.minimum(n, m)[:, None])
    return np.where(differ.any(1), differ.argmax(1), x.shape[1])


def _prefixes(words: np.ndarray) -> np.ndarray:
    """Hashes of the first 0, 1, 2 ... words of each row."""
    out = np.zeros((words.shape[0], words.shape[1] + 1), np.uint64)
    for k in range(words.shape[1]):
        out[:, k + 1] = mix64(out[:, k] * _C + words[:, k])
    return out


def _cells(words: np.ndarray, n: np.ndarray) -> pa.Array:
    """_matrix() the other way round."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((8 * np.concatenate([[0], np.cumsum(n)])).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(words[np.arange(words.shape[1]) < n[:, None]]))])


def _prefixes(words: np.ndarray) -> np.ndarray:
    """Hashes of the first 0, 1, 2 ... words of each row."""
    out = np.zeros((words.shape[0], words.shape[1] + 1), np.uint64)
    for k in range(words.shape[1]):
        out[:, k + 1] = mix64(out[:, k] * _C + words[:, k])
    return out


@dataclass
class Rows:
    """Occurrences of seeds: key, anchor, how many words are known to be common with all of the key (left, right), doc, tid, at; and
    the words of the context on either side, nearest first, with their numbers."""

    numbers: list[np.ndarray]
    sides: list[tuple[np.ndarray, np.ndarray]]

    def take(self, i: np.ndarray) -> Rows:
        return Rows([x[i] for x in self.numbers], [(w[i], n[i]) for w, n in self.sides])

    def __len__(self) -> int:
        return len(self.numbers[0])


def _loaded(b: pa.RecordBatch, width: int) -> Rows:
    kinds = (np.uint64, np.uint64, np.int64, np.int64, np.int64, np.int64, np.int64)
    numbers = [b.column(c).to_numpy(zero_copy_only=False).astype(np.int64).view(k) for c, k in zip(_STEP[:7], kinds, strict=True)]
    return Rows(numbers, [_matrix(b.column(c), width) for c in ("left", "right")])


def _extended(rows: Rows, hubs: tuple[list[np.ndarray], list[tuple[np.ndarray, np.ndarray]]], window: int) -> tuple[list[np.ndarray], list[Rows]]:
    """Of occurrences, each with its hub (doc, tid and at, and both sides' words) in the same place: matches of window words or more
    (doc, tid, lo, hi), and the rows of occurrences that part from their hub within their context, under the keys of what is common
    with those that part there with the same word."""
    width, (key, anchor, left, right, doc, tid, at), known = window - SEED, rows.numbers, rows.numbers[2:4]
    same = (doc == hubs[0][0]) & (at == hubs[0][2])
    own = same & (tid == hubs[0][1])
    common = [_common(x, y) for x, y in zip(rows.sides, hubs[1], strict=True)]
    hit = np.flatnonzero(~same & (common[0] + SEED + common[1] >= window))
    found = [doc[hit], tid[hit], at[hit] - common[0][hit], at[hit] + SEED + common[1][hit]]
    before, out = [_prefixes(words) for words, _ in rows.sides], []
    for side in (0, 1):
        on = np.flatnonzero(~own & (common[side] < rows.sides[side][1]))
        part = rows.take(on)
        k = [known[0][on], known[1][on]]
        k[side] = common[side][on] + 1
        part.numbers[0] = mix64(mix64(anchor[on] * _C + before[0][on, k[0]]) + before[1][on, k[1]] * _C + (k[0] * 64 + k[1]).astype(np.uint64))
        part.numbers[2:4] = k
        words, n = part.sides[1 - side]
        part.sides[1 - side] = words, np.minimum(n, width - k[side])  # of a window that reaches beyond the parting word
        out.append(part)
    return found, out


def _extend(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """One round for rows with their hub: matches (lo, hi), and rows for the next round."""
    for b in slices(batches, column="left"):
        hub = b.column("hub")
        own = [hub.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc", "tid", "at")]
        found, more = _extended(_loaded(b, window - SEED), (own, [_matrix(hub.field(c), window - SEED) for c in ("left", "right")]), window)
        yield _matches(found)
        for part in more:
            none = pa.nulls(len(part), pa.int32())
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([*(pa.array(x.view(np.int64), k) for x, k in zip(part.numbers, kinds, strict=True)), *(_cells(*s) for s in part.sides), none, none], names=_STEP)


def _matches(found: list[np.ndarray]) -> pa.RecordBatch:
    n, (doc, tid, lo, hi) = len(found[0]), found
    none = [pa.nulls(n, k) for k in (pa.int64(), pa.int64(), pa.int32(), pa.int32())]
    return pa.RecordBatch.from_arrays([*none, pa.array(doc), pa.array(tid, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], names=_STEP)


def _all_rounds(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """All rounds for rows that come sorted by key, each key with a bounded number of them."""
    held: list[pa.RecordBatch] = []

    def settle(rows: Rows) -> Iterator[pa.RecordBatch]:
        while len(rows):
            key, doc, tid, at = (rows.numbers[k] for k in (0, 4, 5, 6))
            order = np.lexsort((tid, at, doc, key))
            same = [np.zeros(len(order), bool) for _ in range(2)]
            same[0][1:] = key[order][1:] == key[order][:-1]
            same[1][1:] = same[0][1:] & (doc[order][1:] == doc[order][:-1]) & (at[order][1:] == at[order][:-1]) & (tid[order][1:] == tid[order][:-1])
            order, new = order[~same[1]], ~same[0][~same[1]]  # the same occurrence on two ways to a key
            head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
            several = ~(new & np.append(new[1:], True))
            rows, hubs = rows.take(order[several]), rows.take(order[head[several]])
            found, more = _extended(rows, ([hubs.numbers[k] for k in (4, 5, 6)], hubs.sides), window)
            yield _matches(found)
            rows = Rows([np.concatenate(x) for x in zip(*(m.numbers for m in more), strict=True)], [tuple(np.concatenate(x) for x in zip(*(m.sides[k] for m in more), strict=True)) for k in (0, 1)])

    for b in slices(batches, column="left"):
        key = b.column("key").to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(key, key[-1], "left"))
        if held and last == 0 and held[-1].column("key")[-1].as_py() == key[0]:
            held.append(b)
            continue
        whole = pa.Table.from_batches([*held, b.slice(0, last)]).combine_chunks()
        held = [b.slice(last)]
        for part in whole.to_batches():
            yield from settle(_loaded(part, window - SEED))
    if held:
        for part in pa.Table.from_batches(held).combine_chunks().to_batches():
            yield from settle(_loaded(part, window - SEED))


def _settled(rows: DataFrame, window: int) -> DataFrame:
    """Matches (doc, tid, lo, hi) of all rounds for written rows."""
    spans, schema = None, _ROWS + ", lo int, hi int"
    while True:
        large = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LOCAL).select("key"), "large")  # fewer than one for LOCAL rows
        small = rows.join(large, "key", "left_anti").repartition("key").sortWithinPartitions("key")
        got = written(small.mapInArrow(lambda it: _all_rounds(it, window), schema).select("doc", "tid", "lo", "hi"), "matches")
        spans = got if spans is None else spans.union(got)
        if large.isEmpty():
            return spans
        rows = rows.join(large, "key")
        hubs = written(rows.groupBy("key").agg(F.min(F.struct("doc", "at", "tid", "left", "right")).alias("hub")), "hubs")
        step = written(rows.join(hubs, "key").mapInArrow(lambda it: _extend(it, window), schema), "step")
        spans = spans.union(step.where("lo is not null").select("doc", "tid", "lo", "hi"))
        rows = written(step.where("key is not null").drop("lo", "hi").dropDuplicates(["key", "doc", "at", "tid"]), "rows")


def repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """Ranges of words (doc, tid, lo, hi) that match words which start earlier elsewhere, of a window at least."""
    found = written(seeds(docs, window), "seeds")
    once = found.where(~F.col("again")).drop("again")
    shared = once.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    near = written(once.join(shared, "anchor"), "shared")
    first = F.min(F.struct("doc", "lo", "tid", "hi", "at")).alias("first")
    classes = written(near.groupBy("anchor", "context").agg(first).select("anchor", "context", "first.*"), "classes")
    by_class = near.join(classes.select("anchor", "context", "doc", "lo"), ["anchor", "context", "doc", "lo"], "left_anti").select("doc", "tid", "lo", "hi")
    several = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    of_text = classes.join(several, "anchor").groupBy("doc", "tid").agg(F.collect_list(F.struct("anchor", "lo", "hi", "at")).alias("seeds"))  # no longer than the text
    rows = written(_keyed(docs).join(of_text, ["doc", "tid"]).mapInArrow(_contexts, _ROWS), "contexts")
    spans = found.where("again").select("doc", "tid", "lo", "hi").union(by_class)
    return spans.union(_settled(rows, window))


def remove_repeats(docs: DataFrame, window: int = 20, keep: list[str] | None = None, with_text: bool = True) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 and, if with_text, the kept words joined by spaces; then
    the columns named in keep, as they are."""
    keep = keep or []
    spans = repeats(docs, window).groupBy("doc", "tid").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("spans"))  # of one text
    spans = written(spans, "spans")  # before the texts are shuffled, so that not both take up disk
    rows = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(FIRST)).alias("doc"), F.hash("text").alias("tid"), *(F.col(c).alias(f"keep_{c}") for c in keep))
    rows = rows.join(spans, ["doc", "tid"], "left").drop("doc", "tid")
    fields = {f.name: f for f in docs.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            n_words, n_removed, digest, texts = [], [], [], []
            for text, spans in zip(b.column("text").to_pylist(), b.column("spans"), strict=True):
                words = (text or "").encode().split()
                cut = np.zeros(len(words) + 1, np.int32)
                if spans.is_valid:
                    pairs = spans.values
                    np.add.at(cut, pairs.field(0).to_numpy(zero_copy_only=False), 1)
                    np.add.at(cut, pairs.field(1).to_numpy(zero_copy_only=False), -1)
                    left = [words[i] for i in np.flatnonzero(np.cumsum(cut)[:-1] == 0).tolist()]
                else:
                    left = words
                joined = b" ".join(left)
                n_words.append(len(words)), n_removed.append(len(words) - len(left)), digest.append(hashlib.sha256(joined).hexdigest())
                if with_text:
                    texts.append(None if text is None else joined.decode())
            out = [b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string())]
            out += [pa.array(texts, pa.string())] * with_text + [b.column(f"keep_{c}") for c in keep]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_words", "n_removed", "kept_sha256", *["kept_text"] * with_text, *keep])

    kinds = "".join(f", `{c}` {fields[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"doc_id {fields['doc_id'].dataType.simpleString()}, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * with_text + kinds)
