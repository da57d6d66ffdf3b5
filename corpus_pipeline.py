"""From raw documents to packed training sequences.

Five stages, each calling one operator on all that the stage before it kept: toxic documents go; documents whose language is
rejected go; of each group of near duplicates (five-word shingles, similarity 0.8 or more) one stays; passages of 20 words or
more that occur earlier are cut out of the text; what is left is packed into sequences of 2048 tokens. A stage's result is
written as Parquet and read again by the next.

Rows with null ids go through all stages; null and empty texts are rejected with the language; extra columns go along up to
the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfarer.llm.bpe import tokenizer_path
from wayfarer.llm.common import table, written
from wayfarer.llm.langid import fit_on_documents, without_rejected
from wayfarer.llm.minhash import near_duplicates
from wayfarer.llm.packing import pack
from wayfarer.llm.substring import remove_repeats
from wayfarer.llm.toxicity import fit_on_labels, without_toxic


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, fit_on_labels(docs, table(spark, sf_dir, "labels")))


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_rejected(docs, fit_on_documents(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = near_duplicates(docs, width=5, percent=80).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    cut = remove_repeats(docs, window=20, keep=others).withColumn("n_chars", F.char_length("kept_text").cast("bigint"))
    return cut.withColumnRenamed("kept_text", "text").select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, tokenizer_path("word_bpe_49k.json"), max_len=2048, end_id=0)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeated_passages),
    ("packing", pack_sequences),
]

#: The first two stages are learned models, which SQL can't express; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
