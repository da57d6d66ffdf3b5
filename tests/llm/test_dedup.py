"""Substring removal, near duplicates and components against brute force."""

import hashlib
import random

import pytest

from tests.llm.util import odd_docs


def brute_removal(rows, window):
    first = {}
    texts = [(-(1 << 63) if i is None else i, (t or "").encode().split()) for i, t in rows]
    for i, w in texts:
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            first[key] = min(first.get(key, (i, s)), (i, s))
    out = []
    for (orig, _), (i, w) in zip(rows, texts, strict=True):
        cut = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < (i, s):
                cut.update(range(s, s + window))
        out.append((orig, len(w), len(cut), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in cut)).hexdigest()))
    return sorted(out, key=str)


def planted(seed):
    """Texts of few words that share passages, repeat themselves and copy each other with edits."""
    rng = random.Random(seed)
    passages = [[rng.choice("abcdefghij") + rng.choice("xyz") for _ in range(rng.randint(10, 60))] for _ in range(6)]
    rows = []
    for k in range(60):
        w = []
        for _ in range(rng.randint(0, 5)):
            w += rng.choice(passages) if rng.random() < 0.6 else [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(1, 40))]
        for _ in range(rng.randint(0, 2)):
            if w:
                w[rng.randrange(len(w))] = "edit"
        if rng.random() < 0.1:
            w = ["same"] * rng.randint(15, 60)
        rows.append((rng.randint(0, 45) if rng.random() < 0.9 else None, rng.choice([" ", "\n", "  "]).join(w)))
    return rows + rows[:5]


@pytest.mark.parametrize("seed", [1, 2])
def test_removal_planted(spark, seed):
    from wayfarer.llm.substring import remove_repeats

    rows = planted(seed)
    docs = odd_docs(spark, rows).repartition(5)
    assert sorted((tuple(r)[:4] for r in remove_repeats(docs).collect()), key=str) == brute_removal(rows, 20)


def test_removal_documents(spark):
    from wayfarer.llm.queries import op6_substring_dedup

    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, op6_substring_dedup(spark, "/root/testdata/sf0.01").collect()), key=str) == brute_removal(rows, 20)


def test_removal_odd(spark):
    from tests.llm.util import ODD
    from wayfarer.llm.substring import remove_repeats

    got = remove_repeats(odd_docs(spark), keep=["score"]).collect()
    assert sorted((tuple(r)[:4] for r in got), key=str) == brute_removal(ODD, 20)
    assert {r["score"] for r in got} == {"extra"}
    assert remove_repeats(odd_docs(spark, [])).collect() == []


def brute_components(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {(x, find(x)) for x in list(root)}


@pytest.mark.parametrize("kind", ["random", "path", "star", "none"])
def test_components(spark, kind):
    from wayfarer.llm.components import components

    rng = random.Random(5)
    ids = rng.sample(range(-500, 5000), 300)
    links = {"random": [(rng.choice(ids), rng.choice(ids)) for _ in range(220)], "path": list(zip(ids, ids[1:80], strict=False)), "star": [(ids[0], x) for x in ids[1:]], "none": []}[kind]
    links = [(a, b) for a, b in links if a != b]
    df = spark.createDataFrame([*links, (7, 7), (None, 3)], "a long, b long")
    assert {tuple(r) for r in components(df).collect()} == brute_components(links)


def brute_near(rows, width, percent=80):
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, frozenset(zip(*(w[k:] for k in range(width)), strict=False)) if len(w) >= width else frozenset([tuple(w)] if w else [])))
    links, usable = [], [(i, s) for i, s in sets if s and i is not None]
    where = {}
    for i, s in usable:
        for x in s:
            where.setdefault(x, []).append((i, s))
    done = set()
    for i, s in usable:
        for j, o in {(j, o) for x in s for j, o in where[x]}:
            if i < j and (i, j, s, o) not in done:
                done.add((i, j, s, o))
                both = len(s & o)
                if 100 * both >= percent * (len(s) + len(o) - both):
                    links.append((i, j))
    root = dict(brute_components(links))
    return sorted(((i, len(s), root.get(i, i), root.get(i, i) == i) for i, s in sets), key=str)


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_documents(spark, width):
    from wayfarer.llm.minhash import near_duplicates

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, near_duplicates(docs, width).collect()), key=str) == brute_near(rows, width)


def test_near_duplicates_chains(spark):
    """Copies of copies: neighbours are similar, ends are not, and hubs are similar to some of their buckets only."""
    from wayfarer.llm.minhash import near_duplicates

    rng = random.Random(4)
    rows, w = [], [f"w{rng.randint(0, 9999)}" for _ in range(120)]
    for k in rng.sample(range(1000), 150):
        rows.append((k, " ".join(w)))
        w = list(w)
        for _ in range(rng.choice([0, 2, 3, 4, 5])):
            w[rng.randrange(len(w))] = f"w{rng.randint(0, 9999)}"
    docs = odd_docs(spark, rows).repartition(4)
    assert sorted(map(tuple, near_duplicates(docs, 2).collect()), key=str) == brute_near(rows, 2)


def test_near_duplicates_odd(spark):
    from tests.llm.util import ODD
    from wayfarer.llm.minhash import near_duplicates

    rows = [r for r in ODD if r[0] != 3] + [(3, "one two three"), (3, "one two three"), (20, "ONE two\tthree"), (21, "one"), (22, "One "), (23, "x y")]
    assert sorted(map(tuple, near_duplicates(odd_docs(spark, rows), 2).collect()), key=str) == brute_near(rows, 2)
    assert near_duplicates(odd_docs(spark, []), 2).collect() == []


def test_seeds_in_pieces():
    """Anchors and marks of a slice are the same however it is cut into pieces, and the pieces bound what a task holds."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from wayfarer.llm.substring import _seeded, anchors
    from wayfarer.llm.terms import word_hashes

    rng = np.random.default_rng(4)
    shared = " ".join(f"p{k}" for k in range(60))
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 3000, 400)) + (" " + shared) * (i % 3 == 0) for i in range(1200)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array([0] * len(texts), pa.int32()), pa.array(texts)], names=["doc", "tid", "text"])
    h, count, *_ = word_hashes(batch.column("text"))
    text, anchor, context, lo, hi, at = anchors(h, count, 20)
    base = (np.cumsum(count) - count)[text]
    tracemalloc.start()
    got = list(_seeded(iter([batch]), 20))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    rows = pa.Table.from_batches(got).to_pylist()
    assert [(r["anchor"], r["context"], r["doc"], r["lo"], r["hi"], r["at"]) for r in rows] == list(zip(anchor.view(np.int64).tolist(), context.view(np.int64).tolist(), text.tolist(), (lo - base).tolist(), (hi - base).tolist(), (at - base).tolist(), strict=True))
    first: dict = {}
    for r in sorted(rows, key=lambda r: (r["doc"], r["lo"])):
        key = (r["anchor"], r["context"])
        assert r["again"] == (key in first and first[key] != (r["doc"], r["lo"]))
        first.setdefault(key, (r["doc"], r["lo"]))
    assert any(r["again"] for r in rows) and peak < 25_000_000
