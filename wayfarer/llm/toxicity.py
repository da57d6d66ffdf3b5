"""Toxicity by a factorization machine over hashed terms.

The logit of a text is a bias, a weight for each of its distinct terms, and the product of two terms' factor vectors for each
pair of its terms, so that a pair such as an insult and the mention of a group can count for more than the two alone. Terms
are runs of letters and digits, hashed. The machine is fitted by AdaGrad on a bounded sample of labelled texts
(fit_rows of each class, weighted by the classes' true sizes), for terms that are frequent or telling by themselves; on top of
that, all terms but the rarest have factors of a second kind, for pairs of terms that tell nothing alone.

Defined results: null and empty texts have no term and get the bias alone; null ids and repeated rows pass through; without
labels of both classes the score is the share of toxic labels, and next to 0 without any label, as nothing then speaks
against a text. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfarer.llm.common import held_out, mix64, slices
from wayfarer.llm.terms import term_hashes

BITS = 18
SCALE = 1.0  #: of the pairs


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashed terms of each row, all in one array, and the number of each row's."""
    h, count = term_hashes(column)
    key = np.unique((np.repeat(np.arange(len(count)), count) << BITS) | (h >> np.uint64(64 - BITS)).astype(np.int64))
    return key & ((1 << BITS) - 1), np.bincount(key >> BITS, minlength=len(count)).astype(np.int64)


def _pairs(v: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The products of all pairs of rows' vectors, summed from each start to the next."""
    total, squares = np.add.reduceat(v, at, axis=0), np.add.reduceat((v * v).sum(1), at)
    return ((total * total).sum(1) - squares) / 2


@dataclass(frozen=True)
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    scale: float  #: of the pairs
    weak: np.ndarray  #: factors of all terms but the rarest, for pairs that neither term's frequency nor its own signal tells of

    def logits(self, term: np.ndarray, count: np.ndarray) -> np.ndarray:
        out, full = np.full(len(count), self.bias), np.flatnonzero(count)
        ends = np.cumsum(count[full])
        lo = 0
        while lo < len(full):  # about 100,000 terms at a time, so that memory doesn't follow the rows
            first = int(ends[lo] - count[full[lo]])
            hi = max(lo + 1, int(np.searchsorted(ends, first + 100_000, "right")))
            rows, t = full[lo:hi], term[first : int(ends[hi - 1])]
            n = count[rows]
            at = np.cumsum(n) - n
            out[rows] += np.add.reduceat(self.weights[t], at) + self.scale * (_pairs(self.factors[t], at) + _pairs(self.weak[t], at) / n)
            lo = hi
        return out

    def score(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(*features(column)), -30, 30)))


def fit(texts: list[str], labels: np.ndarray, weight: np.ndarray, rank: int = 6, epochs: int = 15, rate: float = 0.2, batch: int = 64, decay: float = 1e-3, common: float = 0.1, telling: float = 4.0, seed: int = 7, least: int = 5, shrink: float = 2.0) -> Machine:
    """Weighted logistic loss, AdaGrad over the terms that are common (that share of the texts has them) or
    telling (the two classes' shares differ by that many standard errors); the others keep weight 0. Then fit_weak gives factors to
    every term that at least `least` texts have.

    A term's value is its inverse document frequency in the sample, scaled to 1 at most, so that the commonest words, which
    stand in nearly all texts, can't drown the telling ones. It is folded into the term's weight and factors at the end."""
    size = 1 << BITS
    if not len(labels) or labels.min() == labels.max():
        p = float(np.clip(labels.mean() if len(labels) else 0.0, 1e-3, 1 - 1e-3))
        return Machine(float(np.log(p / (1 - p))), np.zeros(size, np.float32), np.zeros((size, rank), np.float32), 0.0, np.zeros((size, rank), np.float32))
    parts = [features(pa.array(texts[lo : lo + 500], pa.large_string())) for lo in range(0, len(texts), 500)]
    term, count = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    of = np.repeat(np.arange(len(count)), count)
    df = np.bincount(term, minlength=size)
    toxic = np.bincount(term[labels[of] == 1], minlength=size)
    n_toxic = int((labels == 1).sum())
    rate_in, rate_out = toxic / n_toxic, (df - toxic) / (len(labels) - n_toxic)
    mean = df / len(labels)
    z = (rate_in - rate_out) / np.sqrt(np.maximum(mean * (1 - mean), 1e-12) * (1 / n_toxic + 1 / (len(labels) - n_toxic)))
    used = np.flatnonzero((df >= max(2, common * len(labels))) | (np.abs(z) >= telling) & (df >= 5))
    value = np.log((1 + len(texts)) / (1 + df[used])) / np.log(1 + len(texts))
    all_terms, all_count = term, count
    number = np.full(size, -1, np.int64)
    number[used] = np.arange(len(used))
    keep = number[term] >= 0
    doc = np.repeat(np.arange(len(count)), count)[keep]
    term, count = number[term[keep]], np.bincount(doc, minlength=len(count))
    start = np.cumsum(count) - count
    rng = np.random.default_rng(seed)
    p = float(np.average(labels, weights=weight))
    bias, w, v = float(np.log(p / (1 - p))), np.zeros(len(used)), rng.normal(0, 0.03, (len(used), rank))
    sum_b, sum_w, sum_v = 1e-8, np.full(len(used), 1e-8), np.full((len(used), rank), 1e-8)
    weight = weight / weight.mean()
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for lo in range(0, len(order), batch):
            rows = order[lo : lo + batch]
            n = count[rows]
            at = np.repeat(start[rows] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            t, d = term[at], np.repeat(np.arange(len(rows)), n)
            x = value[t]
            vx = v[t] * x[:, None]
            total = np.stack([np.bincount(d, vx[:, f], len(rows)) for f in range(rank)], 1)
            squares = np.bincount(d, (vx * vx).sum(1), len(rows))
            z = bias + np.bincount(d, w[t] * x, len(rows)) + SCALE * ((total * total).sum(1) - squares) / 2
            g = weight[rows] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[rows])
            touched, which = np.unique(t, return_inverse=True)
            gx = g[d] * x
            gw = np.bincount(which, gx, len(touched)) + decay * len(rows) * w[touched]
            gv = SCALE * (total[d] - vx) * gx[:, None]
            gv = np.stack([np.bincount(which, gv[:, f], len(touched)) for f in range(rank)], 1) + decay / 10 * len(rows) * v[touched]
            sum_b += float(g.sum()) ** 2
            sum_w[touched] += gw * gw
            sum_v[touched] += gv * gv
            bias -= rate * float(g.sum()) / sum_b**0.5
            w[touched] -= rate * gw / np.sqrt(sum_w[touched])
            v[touched] -= rate / 4 * gv / np.sqrt(sum_v[touched])
    weights, factors = np.zeros(size, np.float32), np.zeros((size, rank), np.float32)
    weights[used], factors[used] = w * value, v * value[:, None]
    machine = Machine(bias, weights, factors, SCALE, np.zeros((size, rank), np.float32))
    weak = fit_weak(machine.logits(all_terms, all_count), all_terms, all_count, df >= least, labels, weight, rank, shrink, rng)
    machine = replace(machine, weak=weak)
    logit = machine.logits(all_terms, all_count)
    inside, outside = np.quantile(logit[labels == 1], 0.02), np.quantile(logit[labels == 0], 0.999)
    return replace(machine, bias=bias - float(inside + outside) / 2)  # 0.5 stands midway between the classes' edges


def telling_pairs(term: np.ndarray, count: np.ndarray, known: np.ndarray, pull: np.ndarray, least: float = 6.0, bits: int = 20, block: int = 250_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (a, b, z) of known terms whose texts are pulled to one side by least standard errors, while the texts with one of the two
    alone are pulled to the other side by two. pull: what each text's logit lacks, whose mean is taken off.

    Pairs are first summed up in 2**bits bins by their hash, and then one by one in the bins that stand out."""
    keep, pull = known[term], pull - pull.mean()
    of, t = np.repeat(np.arange(len(count)), count)[keep], term[keep]
    single, spread = np.bincount(t, pull[of], len(known)), np.bincount(t, pull[of] ** 2, len(known))
    n = np.bincount(of, minlength=len(count))
    rest = n[of] - 1 - (np.arange(len(of)) - (np.cumsum(n) - n)[of])  # terms of the text after each one
    ends = np.cumsum(rest)

    def blocks() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        lo = 0
        while lo < len(t):
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - rest[lo] + block, "right")))
            r = rest[lo:hi]
            left = np.repeat(np.arange(lo, hi), r)
            right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(r) - r, r)
            key = t[left] << BITS | t[right]  # a text's terms are sorted, so that a pair has one order
            yield key, (mix64(key.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64), pull[of[left]]
            lo = hi

    total, square = np.zeros(1 << bits), np.zeros(1 << bits)
    for _, bin_, p in blocks():
        total += np.bincount(bin_, p, 1 << bits)
        square += np.bincount(bin_, p * p, 1 << bits)
    high = np.abs(total) >= (least - 1) * np.sqrt(np.maximum(square, 1e-12))
    key, both, wide = np.empty(0, np.int64), np.empty(0), np.empty(0)
    for k, bin_, p in blocks():  # summed up at once, so that memory follows the different pairs in those bins
        on = high[bin_]
        if on.any():
            key, which = np.unique(np.concatenate([key, k[on]]), return_inverse=True)
            both, wide = (np.bincount(which, np.concatenate([sums, x]), len(key)) for sums, x in ((both, p[on]), (wide, p[on] ** 2)))
    z, a, b = both / np.sqrt(np.maximum(wide, 1e-12)), key >> BITS, key & ((1 << BITS) - 1)
    on = np.abs(z) >= least
    for one in (a, b):
        on &= np.sign(z) * (single[one] - both) <= -2 * np.sqrt(np.maximum(spread[one] - wide, 0))
    return a[on], b[on], z[on]


def fit_weak(logit: np.ndarray, term: np.ndarray, count: np.ndarray, known: np.ndarray, labels: np.ndarray, weight: np.ndarray, rank: int, shrink: float, rng: np.random.Generator, steps: int = 80, start: float = 2.0) -> np.ndarray:
    """Factors, on top of the given logits, of all known terms, by descent over the whole sample. A text's pairs count for 1 in all,
    and decay is the same for every term, so that a pair must stand in some texts of one class more than of the other to grow from its
    small start, and the noise of rare terms and long texts shrinks to nothing. Pairs of terms in a hundredth of the texts or more whose
    texts are pulled to one side start with factors of their own, and their terms decay less: what all other pairs pull at random
    would hide them from descent."""
    used = np.flatnonzero(known)
    number = np.full(len(known), -1, np.int64)
    number[used] = np.arange(len(used))
    keep = number[term] >= 0
    d, t = np.repeat(np.arange(len(count)), count)[keep], number[term[keep]]
    per = 1 / np.maximum(count, 1)

    hold = np.full((len(used), 1), shrink)

    def loss(v: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        total = np.stack([np.bincount(d, v[t, f], len(count)) for f in range(rank)], 1)
        z = logit + SCALE * per * ((total * total).sum(1) - np.bincount(d, (v * v).sum(1)[t], len(count))) / 2
        return float((weight * (np.logaddexp(0, z) - labels * z)).sum() + (hold / 2 * v * v).sum()), z, total

    v = rng.normal(0, 0.03, (len(used), rank))
    frequent = known & (np.bincount(term, minlength=len(known)) >= len(count) / 100)
    pull = weight * (labels - 1 / (1 + np.exp(-np.clip(logit, -30, 30))))
    for a, b, side in zip(*telling_pairs(term, count, frequent, pull), strict=True):
        along = rng.normal(size=rank)
        along *= start / np.linalg.norm(along)
        hold[number[[a, b]]] = shrink / 10
        v[number[a]] += along
        v[number[b]] += np.sign(side) * along
    (now, z, total), rate = loss(v), 0.1
    for _ in range(steps):
        g = SCALE * per * weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels)
        own = np.bincount(t, g[d], len(used))
        step = np.stack([np.bincount(t, (g * total[:, f])[d], len(used)) for f in range(rank)], 1) - own[:, None] * v + hold * v
        ahead = v - rate * step
        got = loss(ahead)
        if got[0] <= now:
            v, (now, z, total), rate = ahead, got, rate * 1.3
        else:
            rate /= 3
    weak = np.zeros((len(known), rank), np.float32)
    weak[used] = v
    return weak


def fit_on_labels(docs: DataFrame, labels: DataFrame, fit_rows: int = 2500, fit_chars: int = 50_000) -> Machine:
    """Learns from a sample of the labelled documents that aren't held out: about fit_rows ids of each class, one text of each and none of
    more than fit_chars characters."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    share = {k: min(1.0, fit_rows / n) for k, n in sizes.items()}
    chance = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20))
    limit = F.when(F.col("toxic") == 1, F.lit(share.get(1, 0) * (1 << 20))).otherwise(F.lit(share.get(0, 0) * (1 << 20)))
    picked = known.where(chance < limit)  # about 2 * fit_rows rows at most
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.char_length("text") <= fit_chars)).join(F.broadcast(picked), "doc_id")
    rows = sorted((r["doc_id"], r["text"], r["toxic"]) for r in rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect())
    got = np.array([r[2] for r in rows], np.int64)
    weight = np.array([1 / share[k] for k in got.tolist()]) if len(rows) else np.zeros(0)
    return fit([r[1] for r in rows], got, weight)


SCHEMA = "doc_id bigint, score double, predicted int"


def _sent(spark: SparkSession, machine: Machine):
    """The machine for tasks: only the terms it uses, 2**BITS at most."""
    used = np.flatnonzero((machine.weights != 0) | (machine.factors != 0).any(1) | (machine.weak != 0).any(1)).astype(np.int32)
    parts = spark.sparkContext.broadcast((machine.bias, used, machine.weights[used], machine.factors[used], machine.scale, machine.weak[used]))

    def load() -> Machine:
        bias, at, w, v, scale, u = parts.value
        weights, factors, weak = np.zeros(1 << BITS, np.float32), np.zeros((1 << BITS, v.shape[1]), np.float32), np.zeros((1 << BITS, u.shape[1]), np.float32)
        weights[at], factors[at], weak[at] = w, v, u
        return Machine(bias, weights, factors, scale, weak)

    return load


def toxicity(docs: DataFrame, machine: Machine) -> DataFrame:
    """One row per document: doc_id, score and predicted."""
    load = _sent(docs.sparkSession, machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load()
        for b in slices(batches, 1_000_000):
            s = m.score(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def without_toxic(docs: DataFrame, machine: Machine) -> DataFrame:
    """The rows of docs, with all their columns, that are not predicted toxic."""
    load = _sent(docs.sparkSession, machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load()
        for b in slices(batches, 1_000_000):
            yield b.filter(pa.array(m.score(b.column("text").cast(pa.string())) < 0.5))

    return docs.mapInArrow(run, docs.schema)
