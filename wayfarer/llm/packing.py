"""Best-fit packing of tokenised documents into sequences of bounded length.

Bulk-synchronous best-fit. Documents and gaps (what open sequences have left) are kept sorted by size. In a round, a sweep from
the largest size down gives each document its successor, the smallest gap that holds it and that no larger document has taken;
documents of one length that want the same gaps are told apart by rank. Then all gaps that were taken are updated at once, and
the round is repeated for the documents that are left. Where the longest find no gap, as many new sequences are opened as they
need at least: one for each document of more than half of max_len, or else one for each max_len tokens of the documents that no
gap holds and that are longer than half of the longest.

Sizes are whole numbers of at most max_len tokens, so a sorted side is described completely by its run lengths: how many documents
have each length, how many sequences have each gap. A document is known by its length and its rank among those of that length, a
sequence by its gap and its rank among those of that gap; a sweep matches intervals of ranks, of which there are at most
4 * max_len in a round whatever the input, and says where the intervals of sequences go in the next round. So the sweeps take a
moment on the driver, whose state is two arrays of max_len counts and the rounds' intervals. What is as large as the input stays
distributed: tokenisation, the ranks within each length (a count for each task and length, then a prefix sum over tasks for each
length apart, so that one very common length is no single task's load), and the placement of every piece, which follows its
interval and then its sequence through the rounds.

Defined results: null and empty texts are one piece, the end id; null and repeated ids pass through as pieces of their own;
an empty table gives an empty result; extra columns are ignored. A document longer than max_len is cut into pieces of
max_len, the last of which may be shorter; no other document is cut.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfarer.llm.bpe import encoder
from wayfarer.llm.common import slices, written

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, local_rank bigint"


def pieces(docs: DataFrame, path: str, max_len: int, end_id: int) -> DataFrame:
    """One row per piece, with the task that made it and its rank among the pieces of its length in that task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen, part = encoder(path), np.zeros(max_len + 1, np.int64), TaskContext.get().partitionId()
        for b in slices(batches):
            flat, count = enc.encode_arrow(b.column("text"))
            total = count + 1
            ids = np.full(int(total.sum()), end_id, "<u4")
            keep = np.ones(len(ids), bool)
            keep[np.cumsum(total) - 1] = False
            ids[keep] = flat
            n = -(-total // max_len)
            doc = np.repeat(np.arange(len(n)), n)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * max_len
            length = np.minimum(max_len, total[doc] - start)
            at = (np.cumsum(total) - total)[doc] + start
            crc = [zlib.crc32(ids[a : a + m]) for a, m in zip(at.tolist(), length.tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            sizes, first, many = np.unique(length[order], return_index=True, return_counts=True)
            rank = np.empty(len(length), np.int64)
            rank[order] = np.arange(len(order)) - np.repeat(first, many) + np.repeat(seen[sizes], many)
            seen[sizes] += many
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), part, np.int32)), pa.array(rank)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "local_rank"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


@dataclass
class Rounds:
    """The result of all rounds. Places of sequences are numbers gap * wide + rank; documents are length * wide + rank."""

    wide: int
    docs: np.ndarray  #: rows (first document, round, documents to a sequence, first sequence's place), sorted
    moves: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  #: of each round: first place, places, and where the first goes; sorted

    def place(self, length: np.ndarray, rank: np.ndarray, max_len: int) -> tuple[np.ndarray, np.ndarray]:
        """The sequence and the offset of each document."""
        if not len(length):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        own = self.docs[np.searchsorted(self.docs[:, 0], length * self.wide + rank, "right") - 1]
        which = length * self.wide + rank - own[:, 0]
        offset = max_len - own[:, 3] // self.wide + which % own[:, 2] * length
        at, began = own[:, 3] + which // own[:, 2], own[:, 1]
        order = np.argsort(began, kind="stable")
        at, began = at[order], began[order]
        for k, (first, n, to) in enumerate(self.moves):
            upto = int(np.searchsorted(began, k, "right"))
            if upto and len(first):
                i = np.searchsorted(first, at[:upto], "right") - 1
                on = (i >= 0) & (at[:upto] < first[i] + n[i])
                at[:upto] = np.where(on, to[i] + at[:upto] - first[i], at[:upto])
        out = np.empty_like(at)
        out[order] = at
        return out, offset


def sweep(docs: np.ndarray, gaps: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """One sweep over numbers of documents and of gaps by size. Rows (length, documents, documents to a gap, gap, gaps): so many of
    that length go to so many of the gaps of that size, which are taken from the highest rank down. Both arrays are updated, but
    for the gaps that come out of it."""
    stack: list[int] = []  # gaps that are left, the smallest last
    out = []
    for size in range(len(docs) - 1, 0, -1):
        if gaps[size]:
            stack.append(size)
        while docs[size] and stack:
            gap = stack[-1]
            each = gap // size
            n = min(int(gaps[gap]), int(docs[size]) // each)
            if n:
                out.append((size, n * each, each, gap, n))
            elif docs[size]:  # too few to fill one as far as they could
                n, each = 1, int(docs[size])
                out.append((size, each, each, gap, 1))
            docs[size] -= n * each
            gaps[gap] -= n
            if not gaps[gap]:
                stack.pop()
    return out


def rounds(counts: dict[int, int], max_len: int) -> Rounds:
    """All rounds for so many documents of each length."""
    docs, gaps = np.zeros(max_len + 1, np.int64), np.zeros(max_len + 1, np.int64)
    for length, n in counts.items():
        docs[length] = n
    wide = int(docs.sum()) + 1
    sizes, used, rows, moves = np.arange(max_len + 1), np.zeros(max_len + 1, np.int64), [], []
    while docs.any():
        longest = int(np.flatnonzero(docs)[-1])
        if not gaps[longest:].any():
            big = sizes > max(longest // 2, int(np.flatnonzero(gaps)[-1]) if gaps.any() else 0)
            alone = sizes > max_len // 2
            gaps[max_len] += int(docs[alone].sum()) or -(-int((docs * sizes)[big].sum()) // max_len)
        left = gaps.copy()
        found, moved = sweep(docs, gaps), []
        for length, n, each, gap, taken in found:
            left[gap] -= taken
            rows.append((length * wide + int(used[length]), len(moves), each, gap * wide + int(left[gap])))
            used[length] += n
            moved.append((gap * wide + int(left[gap]), taken, gap - each * length))
        first, number, to = [], [], []
        for place, taken, gap in moved:
            first.append(place), number.append(taken), to.append(gap * wide + int(gaps[gap]))
            gaps[gap] += taken
        order = np.argsort(np.array(first, np.int64))
        moves.append(tuple(np.array(x, np.int64)[order] for x in (first, number, to)))
    return Rounds(wide, np.array(sorted(rows), np.int64).reshape(-1, 4), moves)


def pack(docs: DataFrame, path: str, max_len: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset."""
    made = written(pieces(docs, path, max_len, end_id), "pieces")
    per_task = made.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = per_task.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
    counts = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()}  # at most max_len rows
    plan = docs.sparkSession.sparkContext.broadcast(rounds(counts, max_len))  # 4 * max_len intervals a round at most

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = plan.value.place(length, rank, max_len)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in _OUT[:5]), pa.array(sequence), pa.array(offset)], names=_OUT)

    ranked = made.join(offsets, ["length", "part"]).select(*_OUT[:5], (F.col("local_rank") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")


_OUT = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
