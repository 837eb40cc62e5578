"""Cutting lineage with tables written to the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``.

    A session on one machine (master ``local``) that names none gets a temporary folder. On a cluster no folder of one machine will do,
    so there the setting is required.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = spark.conf.get("quillstack.shared.dir", None)
    if not own:
        own = tempfile.mkdtemp(prefix="quillstack-shared-")
        spark.conf.set("quillstack.shared.dir", own)
    return own


class Scratch:
    """Tables of one run below the shared folder. ``drop`` removes single tables when a later one replaces them."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.made = 0

    def keep(self, df: DataFrame, partitions: int | None = None) -> DataFrame:
        """Write ``df`` as Parquet and read it back: the lineage ends here and survives lost executors."""
        path = f"{self.root}/{self.made}"
        self.made += 1
        if partitions:
            df = df.coalesce(partitions)
        schema = df.schema
        df.write.parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._scratch_path = path
        return out

    def keep_and_count(self, df: DataFrame, **what: Column) -> tuple[DataFrame, dict]:
        """As ``keep``, with aggregates of the written table."""
        out = self.keep(df)
        return out, out.agg(*[c.alias(n) for n, c in what.items()]).first().asDict()

    def drop(self, df: DataFrame) -> None:
        """Delete the files of a table that ``keep`` returned and nothing reads any more."""
        path = getattr(df, "_scratch_path", None)
        if path:
            jvm = self.spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def scratch(spark: SparkSession, label: str) -> Scratch:
    return Scratch(spark, label)
