"""The queries of the training-data operators, over whole tables and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfarer.llm.common import held_out, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayfarer.llm.langid import fit_on_documents, identify

    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit_on_documents(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayfarer.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayfarer.llm.quality import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"), with_text=False)


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayfarer.llm.bpe import bpe_round_trip, tokenizer_path

    return bpe_round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), keep_ids=False)


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayfarer.llm.embeddings import near_duplicate_vectors

    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayfarer.llm.substring import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), window=20, with_text=False)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayfarer.llm.toxicity import fit_on_labels, toxicity

    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, fit_on_labels(docs, table(spark, sf_dir, "labels"))).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayfarer.llm.bpe import tokenizer_path
    from wayfarer.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), max_len=2048, end_id=0)


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayfarer.llm.extraction import extract

    return extract(table(spark, sf_dir, "pages"))


def op10_wavelet_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayfarer.llm.bpe import tokenizer_path
    from wayfarer.llm.wavelet import token_store

    return token_store(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=2)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_language_id, op2_minhash_near_dedup, op3_quality_rules, op4_bpe_round_trip, op5_embedding_dedup, op6_substring_dedup, op7_toxicity, op8_best_fit_packing, op9_html_extraction, op10_wavelet_store)}
ORACLE_SQL: dict[str, str] = {
    "op2_minhash_near_dedup": r"""
        with recursive words as (
            select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
        sets as (
            select doc_id, case when len(w) = 0 then [] when len(w) = 1 then w else list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) end as s from words),
        items as (select doc_id, unnest(s) as x from sets),
        met as (select a.doc_id as a, b.doc_id as b, count(*) as n from items a join items b using (x) where a.doc_id < b.doc_id group by 1, 2),
        links as (
            select a, b from met join sets sa on sa.doc_id = a join sets sb on sb.doc_id = b where 100 * n >= 80 * (len(sa.s) + len(sb.s) - n)),
        both_ways as (select a, b from links union select b, a from links),
        reach as (select a, b from both_ways union select r.a, l.b from reach r join both_ways l on r.b = l.a),
        least_of as (select a, min(b) as b from reach group by a)
        select s.doc_id, cast(len(s.s) as bigint) as n_shingles, least(s.doc_id, coalesce(l.b, s.doc_id)) as component_id, s.doc_id = least(s.doc_id, coalesce(l.b, s.doc_id)) as kept
        from sets s left join least_of l on l.a = s.doc_id""",
    "op5_embedding_dedup": """
        with recursive v as (
            select vec_id, cast(embedding as double[]) as x from embeddings where embedding is not null and len(embedding) > 0
            and list_bool_and(list_transform(embedding, lambda e: e is not null and isfinite(e))) and list_bool_or(list_transform(embedding, lambda e: e <> 0))),
        both_ways as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.x) = len(b.x) and list_cosine_similarity(a.x, b.x) >= 0.9),
        reach as (select a, b from both_ways union select r.a, l.b from reach r join both_ways l on r.b = l.a),
        least_of as (select a, min(b) as b from reach group by a),
        n as (select a, count(*) as n from both_ways group by a)
        select e.vec_id, coalesce(n.n, 0) as n_links, least(e.vec_id, coalesce(l.b, e.vec_id)) as component_id, e.vec_id = least(e.vec_id, coalesce(l.b, e.vec_id)) as kept
        from embeddings e left join n on n.a = e.vec_id left join least_of l on l.a = e.vec_id""",
    "op6_substring_dedup": r"""
        with words as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
        starts as (select doc_id, w, unnest(range(1, len(w) - 18)) as s from words where len(w) >= 20),
        numbered as (select doc_id, s, row_number() over (partition by array_to_string(w[s:s + 19], ' ') order by doc_id, s) as k from starts),
        cut as (select distinct doc_id, unnest(range(s, s + 20)) as pos from numbered where k > 1),
        places as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as pos from words),
        kept as (select p.doc_id, string_agg(p.word, ' ' order by p.pos) as t, count(*) as n from places p left join cut c on c.doc_id = p.doc_id and c.pos = p.pos where c.pos is null group by p.doc_id)
        select w.doc_id, cast(len(w.w) as bigint) as n_words, cast(len(w.w) - coalesce(k.n, 0) as bigint) as n_removed, sha256(coalesce(k.t, '')) as kept_sha256
        from words w left join kept k on k.doc_id = w.doc_id""",
}
