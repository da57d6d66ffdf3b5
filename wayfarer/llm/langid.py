"""Language identification by nearest centroid.

A text becomes a TF-IDF vector of hashed character n-grams (one to three characters of the lower-case text, anything but
letters being one separator), of unit length. Each language has several centroids, from spherical k-means over its own
training vectors; a text gets the language of the centroid with the largest cosine. It is rejected if that cosine is far
below what training texts of about its length have.

The centroids are fitted on a bounded sample (fit_rows texts for each language); document frequencies are counted over all
training documents.

Defined results: null texts and texts without a letter are "und" with score 0 and are rejected; null ids and repeated rows
pass through; without any training document, all are "und". Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.llm.common import held_out, mix64, slices, texts

DIM = 1 << 12
UNKNOWN = "und"
LENGTHS = np.array([16, 64, 256])  #: letters at which a new class of lengths begins
_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def term_counts(batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-gram counts of each text as a dense matrix, and each text's number of letters."""
    low = [t.lower() for t in batch]
    size = np.fromiter(map(len, low), np.int64, len(low))
    code = np.frombuffer("".join(f"{t} " for t in low).encode("utf-32-le", "surrogatepass"), np.uint32)  # the last word ends like the others
    doc = np.repeat(np.arange(len(low)), size + 1)
    is_letter = letters()[code]
    n_letters = np.bincount(doc, is_letter, len(low)).astype(np.int64)
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # one separator after each word; the text's own first word begins without
    code, doc = np.where(is_letter, code, 0)[keep].astype(np.uint64), doc[keep]
    out = np.zeros(len(low) * DIM, np.float32)
    for n in (1, 2, 3):
        if len(code) < n:
            break
        h = np.full(len(code) - n + 1, n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + code[k : len(code) - n + 1 + k]
        same = doc[: len(h)] == doc[n - 1 :]
        out += np.bincount((doc[: len(h)] * DIM + (mix64(h) >> np.uint64(52)).astype(np.int64))[same], minlength=len(out)).astype(np.float32)
    return out.reshape(len(low), DIM), n_letters


@dataclass(frozen=True)
class Model:
    langs: list[str]  #: of each centroid
    idf: np.ndarray
    centroids: np.ndarray
    floors: np.ndarray  #: for each class of lengths, the cosine below which a text is rejected

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        v = np.log1p(counts) * self.idf
        return v / np.maximum(np.sqrt(np.einsum("ij,ij->i", v, v)), 1e-12)[:, None]

    def predict(self, batch: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and rejection of each text."""
        counts, n = term_counts(batch)
        if not self.langs:
            return [UNKNOWN] * len(batch), np.zeros(len(batch)), np.ones(len(batch), bool)
        cos = self.vectors(counts) @ self.centroids.T
        best = cos.argmax(1)
        score = np.where(n > 0, np.clip(cos[np.arange(len(best)), best], 0, 1), 0.0)
        away = (n == 0) | (score < self.floors[np.searchsorted(LENGTHS, n, "right")])
        return [self.langs[c] if k else UNKNOWN for c, k in zip(best.tolist(), n.tolist(), strict=True)], score.astype(np.float64), away


def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of bounded text and rows, as each row takes a dense vector."""
    for b in slices(batches, 1_000_000):
        for i in range(0, b.num_rows, 200):
            yield b.slice(i, 200)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k centroids of unit length of rows of unit length; each further start is the row that is worst off so far."""
    c = x[:1]
    best = x @ c[0]
    while len(c) < min(k, len(x)):
        far = x[int(best.argmin())]
        c, best = np.vstack([c, far]), np.maximum(best, x @ far)
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        sums = np.stack([x[near == j].sum(0) if (near == j).any() else c[j] for j in range(len(c))])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return c


def fit(train: DataFrame, fit_rows: int = 1000, centroids: int = 4, slack: float = 0.6, fit_chars: int = 50_000) -> Model:
    """Learns from columns doc_id, text and lang (not null) of all rows of train. Centroids are fitted on about fit_rows ids of each
    language, one text of each and none of more than fit_chars characters; frequencies count whole texts of all rows."""
    train = train.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIM, np.int64), 0
        for b in small(batches):
            counts, _ = term_counts(texts(b))
            df += (counts > 0).sum(0)
            n += len(counts)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIM), pa.int32()), pa.array(np.concatenate([[n], df]))], names=["term", "n"])

    seen = np.zeros(DIM + 1, np.int64)
    for r in train.select("text").mapInArrow(frequencies, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect():  # DIM + 1 rows
        seen[r["term"] + 1] = r["n"]
    idf = (np.log((1 + seen[0]) / (1 + seen[1:])) + 1).astype(np.float32)
    sizes = train.groupBy("lang").count()
    share = sizes.select("lang", (F.lit(float(fit_rows)) / F.col("count")).alias("share"))
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    chosen = train.select("doc_id", "lang").join(share, "lang").where(chance < F.col("share") * (1 << 20)).select("doc_id").distinct()  # ids only: texts aren't dealt out by language
    picked = train.where(F.char_length("text") <= fit_chars).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("r"))  # about fit_rows ids for each language
    rows = sorted(((r["r"]["lang"], r["doc_id"], r["r"]["text"]) for r in picked.collect()))
    names, cents, own = [], [], []
    model = Model([], idf, np.zeros((0, DIM), np.float32), np.zeros(len(LENGTHS) + 1))
    for lang in sorted({r[0] for r in rows}):
        batch = [r[2] for r in rows if r[0] == lang]
        parts, sizes_ = zip(*[term_counts(batch[i : i + 500]) for i in range(0, len(batch), 500)], strict=True)
        n = np.concatenate(sizes_)
        x = np.concatenate([model.vectors(p) for p in parts])[n > 0]
        if not len(x):
            continue
        c = spherical_kmeans(x, centroids)
        names += [lang] * len(c)
        cents.append(c)
        own.append((x, n[n > 0]))
    if not names:
        return model
    c = np.concatenate(cents)
    cos = np.concatenate([(x @ c.T).max(1) for x, _ in own])
    kind = np.searchsorted(LENGTHS, np.concatenate([n for _, n in own]), "right")
    floors = [float(np.quantile(cos[kind == j], 0.001)) * slack if (kind == j).sum() >= 20 else 0.02 for j in range(len(LENGTHS) + 1)]
    return Model(names, idf, c.astype(np.float32), np.array(floors))


SCHEMA = "doc_id bigint, lang_pred string, score double, rejected boolean"


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, lang_pred, score (the cosine) and rejected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            lang, score, away = model.predict(texts(b))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(lang, pa.string()), pa.array(score), pa.array(away)], names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def fit_on_documents(docs: DataFrame, **options) -> Model:
    return fit(docs.where(~held_out(F.col("doc_id"))), **options)


def without_rejected(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, with all their columns, whose text isn't rejected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            yield b.filter(pa.array(~model.predict(texts(b))[2]))

    return docs.mapInArrow(run, docs.schema)
