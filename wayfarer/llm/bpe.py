"""Byte-pair encoding by speculation and verification, and decoding, in numpy over the bytes of many texts at once.

A pretoken is first cut greedily into longest matches of the vocabulary (the speculation). A sequence of tokens is what
byte-pair merging gives if and only if every two neighbours are compatible, that is, if merging the text of the two alone
gives back the two. That test depends on the pair only, so it is run once for each pair of a batch, for all of them at once:
going back in time along the right edge of the left token's merge tree and the left edge of the right one's, a pair fails if
two nodes that stood side by side would have merged before either was taken up by its own token. Only pretokens with a
failing pair undergo exact merging, again many at a time.

A text is cut into chunks, each the white space before a word and the word; a chunk's ids depend on nothing else. A bounded
table, keyed by a chunk's own bytes and not by a hash alone, remembers the ids of chunks. What isn't plain letters and signs is
normalised and cut into pretokens by the tokenizer file's own rules, run by the library that the file is for, so that letters,
numbers and white space are what that library takes for them.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from wayfarer.llm.common import kept, mix64

#: White space beyond ASCII (fixed by Unicode).
WIDE_SPACES = frozenset("\x85\xa0                　")
NEVER = 1 << 30
SHORT = 24  #: bytes of the chunks that the table keeps
PAD = 32  #: bytes after the last text
MERGED = 48  #: bytes of the longest pretoken that is merged in a matrix; longer ones are merged with a heap
AREA = 1_000_000  #: bytes of a matrix of pretokens
CELLS = 400_000  #: cells of a matrix in which pretokens are merged
PRIME = np.uint64(0x9E3779B97F4A7C15)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in vocabulary files: itself if it shows, else the next from 256."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class HashMap:
    """A fixed map from distinct int64 keys to int64 values (-1: absent), probed for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(4 * len(keys) + 1))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.zeros(1 << bits, np.int64), np.full(1 << bits, -1, np.int64)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.values[slot[todo]] < 0
            at, first = np.unique(slot[todo[free]], return_index=True)
            won = todo[free][first]
            self.keys[at], self.values[at] = keys[won], values[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        x = keys.astype(np.uint64)
        return ((x ^ (x >> np.uint64(31))) * PRIME >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        out = self.values[slot]
        todo = np.flatnonzero((self.keys[slot] != keys) & (out >= 0))
        while len(todo):
            slot[todo] = s = (slot[todo] + 1) & self.mask
            out[todo] = v = self.values[s]
            todo = todo[(self.keys[s] != keys[todo]) & (v >= 0)]
        return out


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The indices starts[0], starts[0]+1, ... of all runs, one after another."""
    total = int(lens.sum())
    before = np.cumsum(lens) - lens
    return np.repeat(starts - before, lens) + np.arange(total)


def distinct(hashes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each different key, and for each row the number of its key. Rows are told apart by hash, then by key."""
    _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    if (keys[first][which] != keys).any():
        wide = np.ascontiguousarray(keys)
        _, first, which = np.unique(wide.view(f"V{wide.shape[1] * wide.itemsize}").ravel(), return_index=True, return_inverse=True)
    return first, which


class SpeculativeBPE:
    """An encoder for a tokenizer file of the tokenizers library with a byte-level BPE model."""

    def __init__(self, path: str, table_bits: int = 20, pool_ids: int = 6_000_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self._special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.words_only = bool(spec.get("normalizer"))
        self._rules = (spec.get("normalizer"), spec.get("pre_tokenizer"))
        self._byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        self.size = 1 + max([*vocab.values(), *self.special.values()])
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self._tables(vocab, model["merges"])
        self.bits, self.pool_ids = table_bits, pool_ids
        self._forget()
        self.merged_exactly = self.proposed = 0

    def _forget(self) -> None:
        self.table = np.zeros((1 << self.bits, 4), np.uint64)
        self.pool, self.used = np.empty(1 << 16, self.dtype), 0
        self.long: dict[bytes, tuple[int, int, bool]] = {}

    # -- the vocabulary: merges and the tree of each token -------------------------------------------------------------

    def _tables(self, vocab: dict[str, int], merges: list) -> None:
        alphabet, n, end = byte_alphabet(), self.size, self.suffix
        back = {c: bytes([b]) for b, c in enumerate(alphabet)}
        self.token_bytes: list[bytes] = [b""] * n
        ends = np.zeros(n, bool)
        for s, i in vocab.items():
            core = s.removesuffix(end) if end and s != end else s
            ends[i] = core != s
            self.token_bytes[i] = b"".join(back.get(c, c.encode()) for c in core)
        for s, i in self.special.items():
            self.token_bytes[i] = s.encode()
        self.of_byte = np.array([vocab[c] for c in alphabet], np.int64)
        self.of_last = np.array([vocab[c + end] for c in alphabet], np.int64)
        pairs: dict[tuple[int, int], int] = {}
        result = np.zeros(len(merges), np.int64)
        for k, m in enumerate(merges):
            a, b = m.split(" ") if isinstance(m, str) else m
            pairs.setdefault((vocab[a], vocab[b]), k)
            result[k] = vocab[a + b]
        self.pairs, self.result = pairs, result
        self.merge_of = HashMap(np.array([(a << 32) | b for a, b in pairs], np.int64), np.array([*pairs.values()], np.int64))
        self.left, self.right, self.born = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -1, np.int64)
        plain = [t for t in vocab.values() if t not in set(self.special.values())]
        out, count, last = self._merge_many(*self._matrix([self.token_bytes[t] for t in plain], ends[plain]))
        whole = count == 1
        whole[whole] = out[(np.cumsum(count) - count)[whole]] == np.array(plain)[whole]
        good = np.array(plain)[whole]  # only these can come out of merging
        made = last[whole] >= 0
        first = {k: p for p, k in pairs.items()}
        for t, k in zip(good[made].tolist(), last[whole][made].tolist(), strict=True):
            self.left[t], self.right[t] = first[k]
            self.born[t] = k
        some = [t for t in good.tolist() if self.token_bytes[t]]
        lens = np.fromiter((len(self.token_bytes[t]) for t in some), np.int64, len(some))
        self.sizes = np.unique(lens)  # the lengths that tokens have, fewer than 53: a set of them is a float's whole number
        if len(self.sizes) > 52:
            raise ValueError("tokens of too many lengths")
        self.powers = np.cumprod(np.concatenate([[1], np.full(int(lens.max(initial=1)), 0x100000001B3, np.uint64)]).astype(np.uint64))
        self.salts = np.arange(len(self.powers), dtype=np.uint64) * PRIME
        keys, bits = np.zeros(len(some), np.uint64), np.zeros(1 << 16, np.uint64)
        few = np.uint64((1 << int(np.searchsorted(self.sizes, 4))) - 1)  # lengths under 4 are always tried
        for lo in range(0, len(some), 20_000):
            part = some[lo : lo + 20_000]
            mat, n = self._bytes_matrix([self.token_bytes[t] for t in part])
            keys[lo : lo + len(part)] = self._prefixes(mat)[np.arange(len(part)), n] + self.salts[n] ^ np.where(ends[part], _END, np.uint64(0))
            long = np.flatnonzero(n >= 4)
            np.bitwise_or.at(bits, _begin(mat[long, :4]), np.uint64(1) << np.searchsorted(self.sizes, n[long]).astype(np.uint64))
        self.tries = bits | few  # by how a rest begins, which lengths may match there
        self.upto = np.array([(1 << int(np.searchsorted(self.sizes, n, "right"))) - 1 for n in range(len(self.powers))], np.uint64)
        self.token_of = HashMap(keys.view(np.int64), np.array(some, np.int64))

    def _bytes_matrix(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lens = np.fromiter(map(len, words), np.int64, len(words))
        width = int(lens.max(initial=1))
        return np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width), lens

    def _matrix(self, words: list[bytes], ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Single-byte tokens; the last has the suffix where ends says so."""
        mat, lens = self._bytes_matrix(words)
        return self._matrix_of(mat, lens, ends & (lens > 0))

    def _matrix_of(self, mat: np.ndarray, lens: np.ndarray, ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        mat = mat[:, : int(lens.max(initial=1))]
        ids = self.of_byte[mat]
        if self.suffix:
            at = np.arange(len(mat)) if ends is None else np.flatnonzero(ends)
            ids[at, lens[at] - 1] = self.of_last[mat[at, lens[at] - 1]]
        return ids, lens

    # -- exact merging ---------------------------------------------------------------------------------------------------

    def _merge_many(self, ids: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Merges each row (lowest rank first, then leftmost): all tokens in one array, the number of each, and the last merge of each (-1: none).

        Tokens stay where they begin and are linked to their neighbours, so a merge touches three cells of a row."""
        last, count, parts = np.full(len(ids), -1, np.int64), np.zeros(len(ids), np.int64), []
        order = np.argsort(lens, kind="stable")
        order = order[int(np.searchsorted(lens[order], 1)) :]
        lo = 0
        while lo < len(order):  # as many rows as an area holds; they are sorted by length
            fits = np.arange(1, min(20_000, len(order) - lo) + 1) * lens[order[lo : lo + 20_000]] <= CELLS
            rows = order[lo : lo + max(1, int(np.count_nonzero(fits)))]
            lo += len(rows)
            n = lens[rows]
            width = int(n.max())
            t = np.where(np.arange(width) < n[:, None], ids[rows, :width], -1).astype(np.int32)
            rank = np.full((len(rows), width), NEVER, np.int32)
            pairs = self.merge_of.get(((t[:, :-1].astype(np.int64) << 32) | t[:, 1:]).ravel()).reshape(len(rows), width - 1)
            rank[:, :-1] = np.where((pairs >= 0) & (t[:, 1:] >= 0), pairs, NEVER)
            cells, of = t.ravel(), np.arange(len(rows))
            after, before = (np.tile(np.arange(width, dtype=np.int32) + k, len(rows)) for k in (1, -1))
            while len(of):
                m = rank.argmin(1)
                k = rank[np.arange(len(of)), m]
                on = np.flatnonzero(k < NEVER)
                if len(on) < len(of):  # the others are done
                    rank, of, m, k = rank[on], of[on], m[on], k[on]
                    if not len(of):
                        break
                last[rows[of]] = k
                i, base = np.arange(len(of)), of * width
                at = base + m
                gone = after[at]
                new = self.result[k]
                cells[at], cells[base + gone], rank[i, gone] = new, -1, NEVER
                nxt = after[base + gone]
                after[at] = nxt
                inside = np.flatnonzero(nxt < n[of])
                before[base[inside] + nxt[inside]] = m[inside]
                rank[i, m] = NEVER
                r = self.merge_of.get((new[inside] << 32) | cells[base[inside] + nxt[inside]])
                rank[inside, m[inside]] = np.where(r >= 0, r, NEVER)
                p = before[at]
                inside = np.flatnonzero(p >= 0)
                r = self.merge_of.get((cells[base[inside] + p[inside]].astype(np.int64) << 32) | new[inside])
                rank[inside, p[inside]] = np.where(r >= 0, r, NEVER)
            left = t >= 0
            count[rows] = left.sum(1)
            parts.append((rows, t[left]))
        out, begin = np.empty(int(count.sum()), np.int64), np.cumsum(count) - count
        for rows, got in parts:
            out[ragged(begin[rows], count[rows])] = got
        return out, count, last

    def merge_one(self, word: bytes) -> np.ndarray:
        """Exact merging of one pretoken of any length, with a heap."""
        n, pairs = len(word), self.pairs
        ids = self.of_byte[np.frombuffer(word, np.uint8)].tolist()
        if self.suffix and n:
            ids[-1] = int(self.of_last[word[-1]])
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(k, i, ids[i], ids[i + 1]) for i in range(n - 1) if (k := pairs.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            k, i, a, b = heapq.heappop(heap)
            j = nxt[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j], nxt[i] = int(self.result[k]), -1, nxt[j]
            for p, q in ((prv[i], i), (i, nxt[i])):
                if q < n and q > i:
                    prv[q] = i
                if p >= 0 and q < n and (k := pairs.get((ids[p], ids[q]))) is not None:
                    heapq.heappush(heap, (k, p, ids[p], ids[q]))
        return np.array([t for t in ids if t >= 0], np.int64)

    # -- speculation and verification ------------------------------------------------------------------------------------

    def _prefixes(self, mat: np.ndarray) -> np.ndarray:
        """Polynomial hashes of all prefixes of each row."""
        out = np.zeros((mat.shape[0], mat.shape[1] + 1), np.uint64)
        for c in range(mat.shape[1]):
            out[:, c + 1] = out[:, c] * np.uint64(0x100000001B3) + mat[:, c].astype(np.uint64) + np.uint64(1)
        return out

    def propose(self, mat: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest matches of each row: a matrix of tokens and their number (-1 tokens: no match).

        A round tries one length in each row: the longest that some token with the rest's first bytes has and that hasn't failed."""
        n, width = mat.shape
        pre, count, out = self._prefixes(mat), np.zeros(n, np.int64), np.full((n, width), -1, np.int64)
        begin = np.zeros((n, width), np.int64)
        if width >= 4:
            begin[:, : width - 3] = _begin(np.lib.stride_tricks.sliding_window_view(mat, 4, axis=1))
        most = len(self.powers) - 1
        row, at, left = np.flatnonzero(lens > 0), np.zeros(int((lens > 0).sum()), np.int64), lens[lens > 0]
        todo = self.tries[begin[row, at]] & self.upto[np.minimum(left, most)]
        while len(row):
            some = todo > 0
            place = np.frexp(todo.astype(np.float64))[1] - 1
            k = np.where(some, self.sizes[np.maximum(place, 0)], left)
            h = pre[row, at + k] - pre[row, at] * self.powers[np.minimum(k, most)] + self.salts[np.minimum(k, most)]
            if self.suffix:
                h ^= np.where(left == k, _END, np.uint64(0))
            t = self.token_of.get(h.view(np.int64))
            t[~some] = -1  # a byte without a match: exact merging will do
            hit = (t >= 0) | ~some
            i = np.flatnonzero(hit)
            r = row[i]
            out[r, count[r]] = t[i]
            count[r] += 1
            at[i] += k[i]
            left[i] -= k[i]
            todo = todo & ~(np.uint64(1) << np.maximum(place, 0).astype(np.uint64))
            i = i[left[i] > 0]
            todo[i] = self.tries[begin[row[i], at[i]]] & self.upto[np.minimum(left[i], most)]
            keep = left > 0
            row, at, left, todo = row[keep], at[keep], left[keep], todo[keep]
        return out, count

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each i, whether tokens a[i] and b[i] can stand side by side in a result of merging."""
        x, y = a.astype(np.int64), b.astype(np.int64)
        px, py = np.full(len(x), NEVER), np.full(len(x), NEVER)
        good, on = (x >= 0) & (y >= 0), np.arange(len(x))
        on = on[good]
        while len(on):
            u, v = x[on], y[on]
            r = self.merge_of.get((u << 32) | v)
            bad = (r >= 0) & (r < px[on]) & (r <= py[on])
            good[on[bad]] = False
            bu, bv = self.born[u], self.born[v]
            go = ~bad & ((bu >= 0) | (bv >= 0))
            later = bu > bv  # the younger of the two is undone; of two of an age, the right one
            i = on[go & later]
            px[i], x[i] = self.born[x[i]], self.right[x[i]]
            i = on[go & ~later]
            py[i], y[i] = self.born[y[i]], self.left[y[i]]
            on = on[go]
        return good

    def encode_words(self, mat: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of many pretokens, given as rows of bytes: all in one array, and the number of each."""
        guess, count = self.propose(mat, lens)
        rows, cols = np.nonzero(np.arange(max(0, guess.shape[1] - 1)) < (count - 1)[:, None])
        keys = (guess[rows, cols] << 32) | (guess[rows, cols + 1] & 0xFFFFFFFF)
        pairs, which = np.unique(keys, return_inverse=True)
        ok = self.compatible(pairs >> 32, ((pairs & 0xFFFFFFFF) ^ 0x80000000) - 0x80000000)
        wrong = np.zeros(len(mat), bool)
        wrong[rows[~ok[which]]] = True
        wrong |= (count == 1) & (guess[:, 0] < 0)
        redo = np.flatnonzero(wrong)
        self.proposed += len(mat)
        self.merged_exactly += len(redo)
        if len(redo):
            short = redo[lens[redo] <= MERGED]
            flat, n, _ = self._merge_many(*self._matrix_of(mat[short], lens[short]))
            long = redo[lens[redo] > MERGED]
            more = [self.merge_one(mat[r, : lens[r]].tobytes()) for r in long.tolist()]
            redo, n = np.concatenate([short, long]), np.concatenate([n, np.fromiter(map(len, more), np.int64, len(more))])
            count[redo] = n
            guess[np.repeat(redo, n), ragged(np.zeros(len(n), np.int64), n)] = np.concatenate([flat, *more])
        return guess[np.arange(guess.shape[1]) < count[:, None]], count

    # -- chunks and pretokens --------------------------------------------------------------------------------------------

    def _cut(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all chunks, and the number of each text's. buf has padding after offs[-1]."""
        n = int(offs[-1])
        space = _SPACE[buf[:n]]
        edge = np.zeros(n + 1, bool)
        edge[offs] = True
        word_end = np.empty(n + 1, bool)
        word_end[0] = False
        word_end[1:n] = space[1:] | edge[1:n]
        word_end[n] = True
        word_end[1:] &= ~space
        if self.words_only:
            begin = ~space & edge[:n]
            begin[1:] |= space[:-1] & ~space[1:]
            starts, stops = np.flatnonzero(begin), np.flatnonzero(word_end)
        else:
            last = offs[1:][offs[1:] > offs[:-1]]
            word_end[last[space[last - 1]]] = True  # white space at the end of a text
            stops = np.flatnonzero(word_end)
            starts = np.empty_like(stops)
            starts[:1] = 0
            starts[1:] = stops[:-1]
        upto = np.searchsorted(stops, offs, "right")
        return starts, stops, np.diff(upto)

    def _pretokens(self, text: str) -> list[bytes]:
        if not hasattr(self, "_library"):
            from tokenizers import Tokenizer

            rules = {"version": "1.0", "added_tokens": [], "normalizer": self._rules[0], "pre_tokenizer": self._rules[1], "model": {"type": "BPE", "vocab": {}, "merges": []}}
            self._library = Tokenizer.from_str(json.dumps(rules))  # no vocabulary: for the classes of characters only
        if self._library.normalizer is not None:
            text = self._library.normalizer.normalize_str(text)
        return [bytes(map(self._byte_of.__getitem__, p)) for p, _ in self._library.pre_tokenizer.pre_tokenize_str(text)]

    def _encode_lists(self, lists: list[list[bytes]]) -> list[np.ndarray]:
        """The ids of texts given as their pretokens."""
        words = sorted({w for ws in lists for w in ws if w}, key=len)
        ids: dict[bytes, np.ndarray] = {b"": np.empty(0, np.int64)}
        lo = 0
        while lo < len(words):  # words of about a length, as many as an area holds
            hi = lo + 1
            while hi < len(words) and hi - lo < 50_000 and (hi - lo + 1) * len(words[hi]) <= AREA:
                hi += 1
            flat, count = self.encode_words(*self._bytes_matrix(words[lo:hi]))
            ids.update(zip(words[lo:hi], np.split(flat, np.cumsum(count)[:-1]), strict=True))
            lo = hi
        return [np.concatenate([ids[w] for w in ws]) if ws else np.empty(0, np.int64) for ws in lists]

    def _simple(self, mat: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which rows are an optional space, letters (ASCII or Latin-1) and then punctuation; and where the latter begins."""
        n, width = mat.shape
        cols = np.arange(width)
        kind = _KIND[mat]  # 1 letter, 2 lead byte of a Latin-1 letter, 3 continuation byte, 4 punctuation
        nxt = np.zeros_like(mat)
        nxt[:, :-1] = mat[:, 1:]
        two = (kind == 2) & (nxt >= 0x80) & (nxt != 0x97) & (nxt != 0xB7)
        letter = (kind == 1) | two
        letter[:, 1:] |= two[:, :-1]
        lead = (mat[:, 0] == 0x20).astype(np.int64) if not self.words_only else np.zeros(n, np.int64)
        body = cols >= lead[:, None]
        inside = cols < lens[:, None]
        cut = np.where(body & inside & ~letter, cols, width).min(1)
        cut = np.minimum(cut, lens)
        tail = (cols >= cut[:, None]) & inside
        ok = ~(tail & (kind != 4)).any(1) & (lens > lead)
        return ok, np.where(cut <= lead, lens, cut)  # without letters, the space goes with the punctuation

    def _learn(self, mat: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of new short chunks: all in one array, the number of each, and which of them depend on what follows."""
        if not self.words_only and (line := (mat[:, 0] == 10) & (lens > 1) & ~_SPACE[mat[:, 1]] & (mat[:, 1] < 0x80)).any():
            return self._learn_lines(mat, lens, line)
        ok, cut = self._simple(mat, lens)
        if self.words_only:
            mat = mat.copy()
            mat += ((mat >= 0x41) & (mat <= 0x5A)).astype(np.uint8) << 5
            up = np.zeros(mat.shape, bool)
            up[:, 1:] = (mat[:, :-1] == 0xC3) & (mat[:, 1:] >= 0x80) & (mat[:, 1:] <= 0x9E)
            low = mat + (up.astype(np.uint8) << 5)
        else:
            low = mat
        i = np.flatnonzero(ok)
        width = mat.shape[1]
        two = i[cut[i] < lens[i]]
        head = np.where(np.arange(width) < cut[i, None], low[i], 0)
        tail = np.zeros((len(two), width), np.uint8)
        at = np.minimum(np.arange(width) + cut[two, None], width - 1)
        tail_len = lens[two] - cut[two]
        tail = np.where(np.arange(width) < tail_len[:, None], np.take_along_axis(mat[two], at, 1), 0).astype(np.uint8)
        words, wl = np.concatenate([head, tail]).astype(np.uint8), np.concatenate([cut[i], tail_len])
        rest = np.flatnonzero(~ok)
        raw = [bytes(mat[r, : lens[r]] if not self.words_only else mat[r, : lens[r]]) for r in rest.tolist()]
        text = [b.decode() for b in raw]
        odd = np.zeros(len(mat), bool)
        if not self.words_only:
            odd[rest] = [t[-1] in WIDE_SPACES for t in text]
        others = self._encode_lists([self._pretokens(t) for t in text])
        flat, count = self._unique_words(words, wl)
        n = np.zeros(len(mat), np.int64)
        n[i] = count[: len(i)]
        n[two] += count[len(i) :]
        n[rest] = np.fromiter(map(len, others), np.int64, len(others))
        start = np.cumsum(n) - n
        out = np.zeros(int(n.sum()), np.int64)
        begin = np.cumsum(count) - count
        out[ragged(start[i], count[: len(i)])] = flat[: int(count[: len(i)].sum())]
        k = np.searchsorted(i, two)
        out[ragged(start[two] + count[: len(i)][k], count[len(i) :])] = flat[int(begin[len(i)]) if len(two) else len(flat) :]
        if len(rest):
            out[ragged(start[rest], n[rest])] = np.concatenate(others)
        return out, n, odd

    def _learn_lines(self, mat: np.ndarray, lens: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """_learn() where some chunks are a line feed, which is a pretoken, and a word without a space before it."""
        bare = mat.copy()
        bare[line, :-1], bare[line, -1] = mat[line, 1:], 0
        ids, n, odd = self._learn(bare, lens - line)
        out = np.insert(ids, (np.cumsum(n) - n)[line], self.of_byte[10])
        return out, n + line, odd

    def _unique_words(self, mat: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(mat):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        wide = np.zeros((len(mat), SHORT + 8), np.uint8)
        wide[:, : mat.shape[1]] = mat
        wide[:, -1] = lens
        key = wide.view(np.uint64)
        first, which = distinct(mix64(key[:, 0] * PRIME ^ (key[:, 1] + np.uint64(0x7F4A7C15)) * np.uint64(0xC2B2AE3D27D4EB4F) ^ (key[:, 2] + key[:, 3]) * np.uint64(0x165667B19E3779F9)), key)
        flats, counts = [], []
        for lo in range(0, len(first), 50_000):
            part = first[lo : lo + 50_000]
            f, c = self.encode_words(mat[part], lens[part])
            flats.append(f), counts.append(c)
        flat, count = np.concatenate(flats), np.concatenate(counts)
        begin = np.cumsum(count) - count
        return flat[ragged(begin[which], count[which])], count[which]

    def _store(self, ids: np.ndarray) -> int:
        at = self.used
        if at + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty(max(len(self.pool), len(ids)), self.dtype)])
        self.pool[at : at + len(ids)] = ids
        self.used += len(ids)
        return at

    def _encode_buffer(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts (bytes buf[offs[k]:offs[k+1]], 32 bytes of padding after them): all in one array, and the number of each."""
        if offs[-1] == 0:
            return np.empty(0, self.dtype), np.zeros(len(offs) - 1, np.int64)
        if self.used > self.pool_ids:
            self._forget()
        starts, stops, chunks = self._cut(buf, offs)
        lens = stops - starts
        words = np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))
        short = np.minimum(lens, SHORT)
        w = [words[starts + 8 * k] & _MASK[np.clip(short - 8 * k, 0, 8)] for k in range(3)]
        h = mix64(w[0] * PRIME ^ (w[1] + np.uint64(0x7F4A7C15)) * np.uint64(0xC2B2AE3D27D4EB4F) ^ (w[2] + lens.astype(np.uint64)) * np.uint64(0x165667B19E3779F9))
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        row = np.take(self.table, slot, axis=0)
        meta = row[:, 3]
        hit = (row[:, 0] == w[0]) & (row[:, 1] == w[1]) & (row[:, 2] == w[2]) & ((meta & np.uint64(31)) == lens.astype(np.uint64)) & (lens <= SHORT)
        at, n, odd = (meta >> np.uint64(16)).astype(np.int64), ((meta >> np.uint64(6)) & np.uint64(1023)).astype(np.int64), ((meta >> np.uint64(5)) & np.uint64(1)).astype(bool)
        miss = np.flatnonzero(~hit & (lens <= SHORT))
        if len(miss):
            key = np.stack([w[0][miss], w[1][miss], w[2][miss], lens[miss].astype(np.uint64)], 1)
            first, which = distinct(h[miss], key)
            new = miss[first]
            mat = buf[starts[new, None] + np.arange(SHORT)]
            mat = np.where(np.arange(SHORT) < lens[new, None], mat, 0).astype(np.uint8)
            ids, count, dep = self._learn(mat, lens[new])
            base = self._store(ids) + np.cumsum(count) - count
            self.table[slot[new], :3] = key[first, :3]
            self.table[slot[new], 3] = (base.astype(np.uint64) << np.uint64(16)) | (count.astype(np.uint64) << np.uint64(6)) | (dep.astype(np.uint64) << np.uint64(5)) | lens[new].astype(np.uint64)
            at[miss], n[miss], odd[miss] = base[which], count[which], dep[which]
        raws = [(c, bytes(buf[starts[c] : stops[c]])) for c in np.flatnonzero(lens > SHORT).tolist()]
        fresh = list({raw for _, raw in raws if raw not in self.long})
        if fresh:
            words = [raw.decode() for raw in fresh]
            for raw, word, ids in zip(fresh, words, self._encode_lists([self._pretokens(w) for w in words]), strict=True):
                self.long[raw] = (self._store(ids), len(ids), not self.words_only and word[-1] in WIDE_SPACES)
        for c, raw in raws:
            at[c], n[c], odd[c] = self.long[raw]
        of_chunk = np.repeat(np.arange(len(chunks)), chunks)
        flat = self.pool[ragged(at, n)]
        per_text = np.bincount(of_chunk, n, len(chunks)).astype(np.int64) if len(n) else np.zeros(len(chunks), np.int64)
        redo = np.unique(of_chunk[odd])
        if len(redo):  # wide white space before a gap: the text is cut as a whole
            parts = np.split(flat, np.cumsum(per_text)[:-1])
            for t, ids in zip(redo.tolist(), self._encode_lists([self._pretokens(bytes(buf[offs[t] : offs[t + 1]]).decode()) for t in redo.tolist()]), strict=True):
                parts[t], per_text[t] = ids.astype(self.dtype), len(ids)
            flat = np.concatenate(parts)
        return flat, per_text

    def encode_flat(self, data: bytes | np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of UTF-8 texts data[offs[k]:offs[k+1]]: all in one array, and the number of each."""
        buf = np.concatenate([np.frombuffer(data, np.uint8)[int(offs[0]) : int(offs[-1])], np.zeros(PAD, np.uint8)])
        offs = offs.astype(np.int64) - int(offs[0])
        marks = [m.start() for m in regex.finditer(b"<\\|", bytes(buf))] if self._special is not None and b"<|" in bytes(buf) else []
        held = np.unique(np.searchsorted(offs, marks, "right") - 1).tolist() if marks else []
        held = [t for t in held if self._special.search(bytes(buf[offs[t] : offs[t + 1]]).decode())]
        if not held:
            return self._encode_buffer(buf, offs)
        parts = [p for p in np.split(*(lambda f, c: (f, np.cumsum(c)[:-1]))(*self._encode_buffer(buf, offs)))]
        for t in held:
            text, out, at = bytes(buf[offs[t] : offs[t + 1]]).decode(), [], 0
            for m in self._special.finditer(text):
                out += [*self._encode_lists([self._pretokens(text[at : m.start()])]), np.array([self.special[m[0]]])]
                at = m.end()
            parts[t] = np.concatenate([*out, *self._encode_lists([self._pretokens(text[at:])])]).astype(self.dtype)
        return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))

    def encode_arrow(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a string column (null: empty): all in one array, and the number of each row's."""
        if not len(column):
            return np.empty(0, self.dtype), np.empty(0, np.int64)
        column = column.cast(pa.large_string()).fill_null("") if column.null_count else column.cast(pa.large_string())
        _, offs, data = column.buffers()
        offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
        return self.encode_flat(data if data is not None else b"", offs)

    def encode_batch(self, batch: list[str]) -> list[np.ndarray]:
        flat, count = self.encode_arrow(pa.array(batch, pa.large_string()))
        return np.split(flat, np.cumsum(count)[:-1]) if batch else []

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids of a byte-level vocabulary; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.token_bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")

    def decode_flat(self, flat: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of many texts' ids: all in one array, and the number of each text's."""
        if not hasattr(self, "_text"):
            self._text = np.frombuffer(b"".join(self.token_bytes), np.uint8)
            self._text_len = np.fromiter(map(len, self.token_bytes), np.int64, self.size)
            self._text_at = np.cumsum(self._text_len) - self._text_len
        n = self._text_len[flat]
        sums = np.concatenate([[0], np.cumsum(n)])
        ends = np.cumsum(count)
        return self._text[ragged(self._text_at[flat], n)], sums[ends] - sums[ends - count]


def _begin(four: np.ndarray) -> np.ndarray:
    """16 bits of hash of four bytes."""
    w = four.astype(np.uint32)
    x = w[..., 0] | w[..., 1] << np.uint32(8) | w[..., 2] << np.uint32(16) | w[..., 3] << np.uint32(24)
    return ((x ^ x >> np.uint32(15)) * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.int64)


_END = np.uint64(0x5851F42D4C957F2D)  #: goes into the hashes of tokens that end a word
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_KIND[0xC3] = 2
_KIND[0x80:0xC0] = 3
_KIND[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) != "'"]] = 4
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def encoder(path: str) -> SpeculativeBPE:
    """The encoder of a file, kept by a worker process as long as its tasks ask for it."""
    return kept(path, lambda: SpeculativeBPE(path))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def bpe_round_trip(docs: DataFrame, path: str, keep_ids: bool = True) -> DataFrame:
    """One row per document: n_tokens, digests of the ids and of the decoded text and, if keep_ids, both themselves.

    Defined results: null texts count as empty, which have no ids; null ids and repeated rows pass through; extra columns
    are ignored. Very long texts, also without any space, are encoded whole.
    """
    from wayfarer.llm.common import slices

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in slices(batches):
            flat, count = enc.encode_arrow(b.column("text"))
            back, size = enc.decode_flat(flat, count)
            wide, ends, back_ends = flat.astype("<u4"), np.cumsum(count), np.cumsum(size)
            text = [back[e - n : e].tobytes().decode("utf-8", "replace") for n, e in zip(size.tolist(), back_ends.tolist(), strict=True)]
            cols = [
                b.column("doc_id").cast(pa.int64()),
                pa.array(count, pa.int64()),
                pa.array([hashlib.sha256(wide[e - n : e]).hexdigest() for n, e in zip(count.tolist(), ends.tolist(), strict=True)]),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in text]),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                cols += [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(wide.astype(np.int32))), pa.array(text)]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids)
