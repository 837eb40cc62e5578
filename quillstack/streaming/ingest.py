"""Incremental jobs on file streams. Every job can be stopped and started again: its checkpoint is the cursor."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillstack.operators.upserts import written


def arriving(spark: SparkSession, folder: str, schema: StructType | str, files_per_batch: int = 64) -> DataFrame:
    """Parquet files that land in ``folder``, each once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Work off what has arrived since the last run, batch by batch, then stop."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()


def updates(out: str) -> Callable[[DataFrame, int], None]:
    """Sink for the update mode: the changed rows of each batch in a folder of its own, which a repeated batch writes anew."""
    return lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}")


def latest_updates(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """The last update of every key."""
    rows = spark.read.option("basePath", out).parquet(f"{out}/batch=*")
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("last")).select(*keys, "last.*")


def sync_mails(spark: SparkSession, folder: str, schema: StructType | str, out: str, checkpoint: str, late: str = "30 days") -> None:
    """Append new mails to ``out``, each message id once within the watermark; rows that break a rule go to ``out``/rejected with the reason."""
    stream = arriving(spark, folder, schema).withColumn("arrived", F.coalesce(F.col("created_at").cast("timestamp"), F.lit("1970-01-01").cast("timestamp")))
    fault = F.when(F.col("message_id").isNull(), "no message id").when(F.trim(F.coalesce("content", F.lit(""))) == "", "empty")
    marked = stream.withColumn("fault", fault)

    def sink(batch: DataFrame, n: int) -> None:
        batch.persist()
        written(batch.where("fault is null").drop("fault"), f"{out}/mails", n)
        written(batch.where("fault is not null"), f"{out}/rejected", n)
        batch.unpersist()

    run_available(marked.withWatermark("arrived", late).dropDuplicatesWithinWatermark(["message_id", "fault"]), sink, checkpoint)


def windowed_counts(stream: DataFrame, at: str, by: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts per window and kind over a stream, late rows admitted up to ``late``."""
    timed = stream.withColumn("at", F.col(at).cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), by, "n")


def sessions(stream: DataFrame, at: str, by: str, gap: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Sessions of a key: stretches without a gap of ``gap``."""
    timed = stream.withColumn("at", F.col(at).cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.session_window("at", gap).alias("w"), by).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("first_at"), F.col("w.end").alias("ends_at"), "n")
