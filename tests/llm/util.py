"""Documents for the tests: nulls, empty and long texts, ties, repeated rows, odd white space, and clashing extra columns."""

from pyspark.sql import types as T

ODD = [
    (0, None), (1, ""), (2, " \n\t "), (3, "one two three"), (3, "one two three"), (None, "a text without an id"), (4, "A  b\n\nc \t d\x85e\xa0 f\x1cg"),
    (5, "word " * 3000), (6, "x" * 30_000), (7, "I'm we'll don't 12 3.5 <|endoftext|> ok <|startoftext|>"), (8, "日本語 テキスト été ÀÉ ΣΑΣ İ ×÷"), (9, "!!! ??? ... | | |"),
    (10, "# $ % & * | < >\n" * 5), (11, "same line\nsame line\nother\nsame line"), (12, "the cat sat on the mat and the cat sat on the rug"),
]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_words", T.StringType()), T.StructField("score", T.StringType()), T.StructField("kept", T.StringType()), T.StructField("length", T.StringType())])


def odd_docs(spark, rows=ODD):
    return spark.createDataFrame([(i, t, "extra", "extra", None, "extra") for i, t in rows], SCHEMA)
