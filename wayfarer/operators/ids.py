"""Dense ids from 0, ordered by user and then within the user, without a window over all rows or all users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 4096


def _bucketed(counts: DataFrame, user: str) -> DataFrame:
    """counts with _bucket, which never falls as the user rises: a slice of the range of numbers, or the first letters of a text."""
    if not isinstance(counts.schema[user].dataType, T.NumericType):
        return counts.withColumn("_bucket", F.substring(F.col(user).cast("string"), 1, 3))
    ends = counts.agg(F.min(user).cast("double").alias("_low"), F.max(user).cast("double").alias("_high"))  # one row
    share = (F.col(user).cast("double") - F.col("_low")) / (F.col("_high") - F.col("_low") + 1) * BUCKETS
    return counts.join(F.broadcast(ends)).withColumn("_bucket", F.floor(share)).drop("_low", "_high")


def user_offsets(df: DataFrame, user: str = "user_id") -> DataFrame:
    """(_user, _before): the number of rows of all smaller users. Users are summed up within buckets, and then the buckets."""
    counts = _bucketed(df.groupBy(user).agg(F.count(F.lit(1)).alias("_n")), user)
    ahead = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    buckets = counts.groupBy("_bucket").agg(F.sum("_n").alias("_n"))  # for numbers, BUCKETS rows at most
    buckets = buckets.select(F.col("_bucket").alias("_b"), ahead(Window.orderBy("_bucket")).alias("_base"))
    inside = counts.withColumn("_in", ahead(Window.partitionBy("_bucket").orderBy(user)))
    return inside.join(buckets, F.col("_bucket").eqNullSafe(F.col("_b"))).select(F.col(user).alias("_user"), (F.col("_base") + F.col("_in")).alias("_before"))


def dense_ids(df: DataFrame, order: list[str | Column], name: str = "id", user: str = "user_id", rank: str | None = None) -> DataFrame:
    """Rows are numbered for each user, by order or by the column rank (from 0), which is dropped; what comes before a user is added."""
    if rank is None:
        df, rank = df.withColumn("_rank", F.row_number().over(Window.partitionBy(user).orderBy(*order)) - 1), "_rank"
    numbered = df.join(user_offsets(df.select(user), user), F.col(user).eqNullSafe(F.col("_user")))
    return numbered.withColumn(name, (F.col("_before") + F.col(rank)).cast("bigint")).drop(rank, "_user", "_before")
