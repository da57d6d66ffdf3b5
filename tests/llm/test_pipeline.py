"""The pipeline's stages, each on its own input, against brute force."""

from tests.llm.test_dedup import brute_near
from tests.llm.util import ODD
from wayfarer.llm.common import table, written

SF = "/root/testdata/sf0.01"


def brute_cut(rows, window=20):
    """Kept words of each row, as tests.llm.test_dedup.brute_removal finds them."""
    first, texts = {}, [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in texts:
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            first[key] = min(first.get(key, (i, s)), (i, s))
    out = {}
    for i, w in texts:
        cut = {p for s in range(len(w) - window + 1) if first[tuple(w[s : s + window])] < (i, s) for p in range(s, s + window)}
        out[i] = b" ".join(x for k, x in enumerate(w) if k not in cut).decode()
    return out


def test_stages(spark):
    import corpus_pipeline as cp
    from wayfarer.llm.langid import fit_on_documents
    from wayfarer.llm.toxicity import fit_on_labels

    docs = table(spark, SF, "documents")
    schema = docs.schema
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    import pyarrow as pa

    machine = fit_on_labels(docs, table(spark, SF, "labels"))
    calm = written(cp.drop_toxic(spark, docs, SF), "calm")
    left = {r["doc_id"]: r["text"] for r in calm.collect()}
    ids = list(text)
    score = machine.score(pa.array([text[i] for i in ids]))
    assert left == {i: text[i] for i, s in zip(ids, score, strict=True) if s < 0.5}

    model = fit_on_documents(calm)
    known = written(cp.drop_unknown_language(spark, calm, SF), "known")
    ids = list(left)
    away = model.predict([left[i] for i in ids])[2]
    text = {r["doc_id"]: r["text"] for r in known.collect()}
    assert text == {i: left[i] for i, a in zip(ids, away, strict=True) if not a}

    single = written(cp.drop_near_duplicates(spark, known, SF), "single")
    left = {r["doc_id"]: r["text"] for r in single.collect()}
    assert left == {i: text[i] for i, _, _, kept in brute_near(list(text.items()), 5) if kept}

    cut = written(cp.cut_repeated_passages(spark, single, SF), "cut")
    assert [(f.name, f.dataType) for f in cut.schema] == [(f.name, f.dataType) for f in schema]
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == brute_cut(list(left.items()))
    assert all(r["n_chars"] == len(r["text"]) for r in cut.collect())

    packed = cp.pack_sequences(spark, cut, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == set(left)


def test_odd(spark, tmp_path):
    import corpus_pipeline as cp

    rows = [(i, t, "en", "s", len(t or ""), "more") for i, t in ODD]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for name, df in (("full", docs), ("none", docs.where("false"))):
        sf = f"file://{tmp_path}/{name}"
        df.write.parquet(f"{sf}/documents.parquet")
        labels.write.parquet(f"{sf}/labels.parquet")
        out = cp.run(spark, sf).collect()
        assert bool(out) == (name == "full")
