"""Tables that are computed once and written, and connected components for clusters over all users."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names. Where it is unset, one machine alone uses its own temporary folder; a cluster can't."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "wayfarer-scratch")
    return root.rstrip("/")


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/wayfarer-{spark.sparkContext.applicationId}"


def drop_scratch(spark: SparkSession) -> None:
    """Deletes all tables that this application has saved, once no result that reads them is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def saved(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: computed once for all that reads it, and not again if an executor is lost. drop_scratch()
    deletes it."""
    path = f"{_own_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(links: DataFrame) -> DataFrame:
    """(node, component: its smallest node) for links (a, b), by smallest labels of neighbours and then labels of labels."""
    both = saved(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = saved(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")))
    while True:
        near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        step = label.join(near, "node").select("node", F.least("component", "m").alias("component"), F.col("component").alias("before"))
        jump = step.select(F.col("node").alias("component"), F.col("component").alias("up"))
        new = saved(step.join(jump, "component", "left").select("node", F.least("component", "up").alias("component"), "before"))
        if new.where("component != before").isEmpty():
            return new.select("node", "component")
        label = new.select("node", "component")
