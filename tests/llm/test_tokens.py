"""Encoding, packing and the token store against the tokenizers library and brute force."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.util import odd_docs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return {n: Tokenizer.from_file(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")}


def ids_of(library, name, text):
    return library[name].encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_any_text(library, name):
    from wayfarer.llm.bpe import encoder, tokenizer_path

    enc = encoder(tokenizer_path(name))

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.text(st.one_of(st.sampled_from("aeiou thnrsl'.,!\n\t0123éüñßAB日<|>\xa0×Σ"), st.characters(exclude_categories=["Cs"], max_codepoint=0x2FFF)), max_size=60), max_size=8))
    def check(batch):
        assert [g.tolist() for g in enc.encode_batch(batch)] == [ids_of(library, name, t) for t in batch]

    check()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_every_code_point(library, name):
    """Each code point of planes 0 to 2 (and every 17th of the others, which hold unassigned and private ones) between letters, several
    to a text, and those of the scripts with most classes also between spaces. All of the others gave no difference either."""
    from wayfarer.llm.bpe import encoder, tokenizer_path

    points = [chr(c) for c in [*range(1, 0x30000), *range(0x30000, 0x110000, 17)] if not 0xD800 <= c < 0xE000]
    batch = ["".join(f"a{c}b{c}" for c in points[lo : lo + 64]) for lo in range(0, len(points), 64)]
    batch += [" ".join(points[lo : lo + 64]) for lo in range(0, 0x3100, 64)]
    enc = encoder(tokenizer_path(name))
    for lo in range(0, len(batch), 1000):
        want = [e.ids for e in library[name].encode_batch(batch[lo : lo + 1000], add_special_tokens=False)]
        got = [g.tolist() for g in enc.encode_batch(batch[lo : lo + 1000])]
        wrong = [lo + k for k, (a, b) in enumerate(zip(got, want, strict=True)) if a != b]
        assert wrong == []


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("batch", [[""], ["", ""], [None, ""], [None]])
def test_empty_slices(library, name, batch):
    import pyarrow as pa

    from wayfarer.llm.bpe import encoder, tokenizer_path

    flat, count = encoder(tokenizer_path(name)).encode_arrow(pa.array(batch, pa.string()))
    assert len(flat) == 0
    assert count.tolist() == [0] * len(batch)


def test_long_pretokens(library):
    """Words of one class of letters, far longer than any token, by the same proposals and checks as short ones."""
    from wayfarer.llm.bpe import encoder, tokenizer_path

    rng = np.random.default_rng(4)
    texts = ["x" * 5000, "ab" * 700, "-" * 999, "".join(rng.choice(list("etaoinshrd"), 3000)), "".join(rng.choice(list("etaoin日é"), 400)), "!" * 80 + "=" * 300]
    for name in library:
        assert [g.tolist() for g in encoder(tokenizer_path(name)).encode_batch(texts)] == [ids_of(library, name, t) for t in texts]


def test_compatible_pairs(library):
    from wayfarer.llm.bpe import encoder, tokenizer_path

    enc = encoder(tokenizer_path("byte_bpe_50k.json"))
    rng = np.random.default_rng(3)
    good = [t for t in rng.integers(0, 50_000, 4000) if len(enc.token_bytes[t]) < 10 and enc.merge_one(enc.token_bytes[t]).tolist() == [t]]
    a, b = np.array(good[: len(good) // 2]), np.array(good[len(good) // 2 :][: len(good) // 2])
    want = [enc.merge_one(enc.token_bytes[x] + enc.token_bytes[y]).tolist() == [x, y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    assert enc.compatible(a, b).tolist() == want
    assert 0 < sum(want) < len(want)


@pytest.mark.parametrize("odd", [False, True])
def test_round_trip(spark, library, odd):
    from wayfarer.llm.bpe import bpe_round_trip, tokenizer_path

    docs = odd_docs(spark) if odd else spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted(map(tuple, bpe_round_trip(docs, tokenizer_path("byte_bpe_50k.json")).collect()), key=str)
    want = []
    for r in docs.collect():
        ids = ids_of(library, "byte_bpe_50k.json", r["text"])
        text = library["byte_bpe_50k.json"].decode(ids, skip_special_tokens=False)
        want.append((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), ids, text))
    assert got == sorted(want, key=str)


@pytest.mark.parametrize("odd", [False, True])
def test_packing(spark, library, odd):
    from wayfarer.llm.bpe import tokenizer_path
    from wayfarer.llm.packing import pack

    docs = odd_docs(spark) if odd else spark.read.parquet(f"{SF}/documents.parquet")
    rows = pack(docs, tokenizer_path("word_bpe_49k.json")).collect()
    want = []
    for r in docs.collect():
        ids = [*ids_of(library, "word_bpe_49k.json", r["text"]), 0]
        for p, s in enumerate(range(0, len(ids), 2048)):
            part = ids[s : s + 2048]
            want.append((r["doc_id"], p, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((tuple(r)[:5] for r in rows), key=str) == sorted(want, key=str)
    seqs = defaultdict(list)
    for r in rows:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in seqs.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 2048
    bins: list[int] = []  # best-fit decreasing, one document at a time
    for n in sorted((w[3] for w in want), reverse=True):
        fit = min((g for g in bins if g >= n), default=None)
        if fit is None:
            bins.append(2048 - n)
        else:
            bins.remove(fit)
            bins.append(fit - n)
    assert len(seqs) <= len(bins) * 1.01 + 1


def test_packing_empty(spark):
    from wayfarer.llm.bpe import tokenizer_path
    from wayfarer.llm.packing import pack

    assert pack(odd_docs(spark, []), tokenizer_path("word_bpe_49k.json")).collect() == []


@pytest.mark.parametrize("odd", [False, True])
def test_store(spark, library, odd):
    from wayfarer.llm.bpe import tokenizer_path
    from wayfarer.llm.wavelet import token_store

    docs = odd_docs(spark) if odd else spark.read.parquet(f"{SF}/documents.parquet")
    got = [tuple(r) for r in token_store(docs, tokenizer_path("byte_bpe_50k.json")).collect()]
    want, at = [], 0
    for r in sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "")):
        ids = [*ids_of(library, "byte_bpe_50k.json", r["text"]), 2]
        want.append((r["doc_id"], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(got, key=str) == sorted(want, key=str)


def test_store_empty(spark):
    from wayfarer.llm.bpe import tokenizer_path
    from wayfarer.llm.wavelet import token_store

    assert token_store(odd_docs(spark, []), tokenizer_path("byte_bpe_50k.json")).collect() == []


@pytest.mark.parametrize("n", [0, 1, 511, 32_767, 32_768, 32_769, 100_000])
def test_wavelet_matrix(n):
    from wayfarer.llm.wavelet import from_bytes, to_bytes

    rng = np.random.default_rng(n)
    ids = rng.integers(0, 37, n).astype(np.uint16)
    shard = from_bytes(to_bytes(np.array([7, 0]), np.array([False, True]), np.array([n, 0]), ids, 16))
    (names, count), wm = shard.documents(), shard.ids
    assert (names, count.tolist(), wm.decode().tolist()) == ([7, None], [n, 0], ids.tolist())
    for i in rng.integers(0, max(n, 1), 20).tolist() if n else []:
        assert wm.access(i) == ids[i]
    for token in (0, 5, 36, 37, 70_000):
        at = np.flatnonzero(ids == token).tolist()
        assert wm.count(token) == len(at)
        assert wm.rank(token, n // 2) == sum(x < n // 2 for x in at)
        assert [wm.select(token, k) for k in range(min(50, len(at)))] == at[:50]
        with pytest.raises(IndexError):
            wm.select(token, len(at))


def test_look_ups_read_blocks(tmp_path):
    """One look-up in a file reads the directory and a block of each plane or two, a small part of the file."""
    from wayfarer.llm.wavelet import BLOCK, Shard, open_shard, to_bytes

    rng = np.random.default_rng(1)
    ids = rng.integers(0, 50_000, 60 * BLOCK).astype(np.uint16)
    blob = to_bytes(np.arange(3), np.zeros(3, bool), np.array([len(ids) - 2, 1, 1]), ids, 16)
    (tmp_path / "x.wavm").write_bytes(blob)
    read = []

    def part(at, size):
        read.append(size)
        return blob[at : at + size]

    shard = Shard(part)
    assert shard.ids.access(1_234_567) == ids[1_234_567]
    assert sum(read) < len(blob) / 20
    assert shard.ids.rank(77, 1_000_000) == int((ids[:1_000_000] == 77).sum())
    assert sum(read) < len(blob) / 6
    far = open_shard(f"file://{tmp_path}/x.wavm")
    at = np.flatnonzero(ids == 4321)
    assert (far.ids.count(4321), far.ids.select(4321, 5), far.ids.access(99)) == (len(at), at[5], ids[99])


def test_store_hot_id(spark, library, tmp_path):
    """An id that most rows share is dealt out over several ranges."""
    from wayfarer.llm.bpe import tokenizer_path
    from wayfarer.llm.wavelet import read_shards, write_shards

    rows = [(5, f"row {k}") for k in range(300)] + [(k, f"other {k}") for k in range(40)]
    out = f"file://{tmp_path}/store"
    made = write_shards(odd_docs(spark, rows), tokenizer_path("byte_bpe_50k.json"), out, shard_ids=64)
    assert made.select("part").distinct().count() > 2
    got = sorted(((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in read_shards(spark, out).collect()))
    ids = [[*ids_of(library, "byte_bpe_50k.json", t), 2] for _, t in rows]
    assert sorted(g[1:] for g in got) == sorted((d, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for (d, _), i in zip(rows, ids, strict=True))
    assert [g[1] for g in got] == sorted(g[1] for g in got)
    assert [g[0] for g in got] == [0, *np.cumsum([g[2] for g in got])[:-1].tolist()]


def test_tables_are_given_up(spark):
    """Workers are handed from operator to operator, and keep a tokenizer's tables only while their tasks use them."""
    import pyarrow as pa

    from wayfarer.llm.bpe import bpe_round_trip, tokenizer_path
    from wayfarer.llm.common import slices

    docs = spark.createDataFrame([(i, "some words of a text") for i in range(40)], "doc_id bigint, text string").repartition(4)
    bpe_round_trip(docs, tokenizer_path("byte_bpe_50k.json")).collect()

    def held(batches):
        import gc

        from wayfarer.llm.bpe import SpeculativeBPE

        for _ in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([sum(isinstance(x, SpeculativeBPE) for x in gc.get_objects())], pa.int32())], names=["n"])

    assert {r["n"] for r in docs.select("text").mapInArrow(held, "n int").collect()} == {0}


def test_store_slices():
    """What encoding takes beside the encoder is bounded by the store's slices, not by the rows in a batch."""
    import tracemalloc

    import pyarrow as pa

    from wayfarer.llm import wavelet
    from wayfarer.llm.bpe import encoder, tokenizer_path
    from wayfarer.llm.common import slices

    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 3000, 400)) for _ in range(2200)]
    batch, enc = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"]), encoder(tokenizer_path("byte_bpe_50k.json"))
    whole = enc.encode_arrow(batch.column("text"))
    tracemalloc.start()
    parts = [enc.encode_arrow(b.column("text")) for b in slices(iter([batch]), wavelet.SLICE)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(parts) > 2 and all(np.array_equal(np.concatenate(x), y) for x, y in zip(zip(*parts, strict=True), whole, strict=True))
    assert peak < 60_000_000, peak
