"""Vector links against brute force in double precision."""

import numpy as np
import pytest

from tests.llm.test_dedup import brute_components

SCHEMA = "vec_id long, embedding array<float>, label string, x string, n_links string"


def brute(rows, threshold=0.9):
    good = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    number, links = {}, []
    for dim in {len(v) for _, v in good}:
        ids = [i for i, v in good if len(v) == dim]
        x = np.stack([v for _, v in good if len(v) == dim])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        hit = x @ x.T >= threshold
        np.fill_diagonal(hit, False)
        for k, i in enumerate(ids):
            number[i] = int(hit[k].sum())
        links += [(ids[a], ids[b]) for a, b in zip(*np.nonzero(hit), strict=True)]
    root = dict(brute_components(links)) if links else {}
    return sorted(((i, number.get(i, 0), root.get(i, i), root.get(i, i) == i) for i, _ in rows), key=str)


def test_documents(spark):
    from wayfarer.llm.queries import op5_embedding_dedup

    sf = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(map(tuple, op5_embedding_dedup(spark, sf).collect()), key=str) == brute(rows)


@pytest.mark.parametrize(("margin", "least"), [(0.12, 0.999), (0.0, 0.9)])
def test_recall_over_many_cells(spark, margin, least):
    from wayfarer.llm.embeddings import near_duplicate_vectors

    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 32))
    x = np.concatenate([base, base[rng.integers(0, 300, 500)] + rng.normal(size=(500, 32)) * rng.uniform(0, 0.5, (500, 1)), np.repeat(base[:1], 40, 0)])
    rows = [(int(i), [float(np.float32(c)) for c in v]) for i, v in zip(rng.permutation(len(x)) * 3, x, strict=True)]
    df = spark.createDataFrame([(i, v, "l", "x", "n") for i, v in rows], SCHEMA)
    got = {r["vec_id"]: r["n_links"] for r in near_duplicate_vectors(df, margin=margin, per_cell=40, block=25).collect()}
    want = {i: n for i, n, *_ in brute(rows)}
    assert all(got[i] <= want[i] for i in want)
    assert sum(got.values()) >= least * sum(want.values())


def test_odd(spark):
    from wayfarer.llm.embeddings import near_duplicate_vectors

    nan, inf = float("nan"), float("inf")
    rows = [(5, [1.0, 0.0]), (3, [1.0, 0.1]), (9, [2.0, 0.0]), (1, [0.0, 1.0]), (2, None), (4, []), (6, [0.0, 0.0]), (7, [1.0, None]), (8, [nan, 1.0]), (10, [inf, 0.0]), (11, [1.0, 0.0, 0.0]), (12, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (13, [-1.0, -0.0]), (14, [-1.0, 0.0]), (15, [1e-30, 0.0]), (16, [3e38, 0.0])]
    df = spark.createDataFrame([(i, v, "l", "x", "n") for i, v in rows], SCHEMA)
    got = near_duplicate_vectors(df).collect()
    assert sorted(map(tuple, got), key=str) == sorted(((i, n, c, True if i is None else k) for i, n, c, k in brute(rows)), key=str)
    assert near_duplicate_vectors(df.where("false")).collect() == []
