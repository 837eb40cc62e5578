"""Texts as vectors: by a model that the user hands over, or by hashed words."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts given to a model at once.
BATCH = 256


def encoded(texts: DataFrame, load: Callable[[], Callable[[list[str]], np.ndarray]], dim: int) -> DataFrame:
    """(id, vector) of texts (id, text) by a model: ``load`` is called once a task and gives a function from texts to rows of ``dim`` numbers.

    Null and blank texts have a null vector and do not reach the model. Rows of another length are an error.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for part in parts:
            vectors: list = [None] * len(part)
            where = [k for k, t in enumerate(part["text"]) if t and t.strip()]
            for lo in range(0, len(where), BATCH):
                some = where[lo : lo + BATCH]
                rows = np.asarray(model([part["text"].iat[k] for k in some]), np.float32)
                if rows.shape != (len(some), dim):
                    raise ValueError(f"the model gave {rows.shape} for {len(some)} texts of {dim} numbers")
                for k, row in zip(some, rows):
                    vectors[k] = row
            yield pd.DataFrame({"id": part["id"], "vector": vectors})

    return texts.select("id", "text").mapInPandas(run, f"id {texts.schema['id'].dataType.simpleString()}, vector array<float>")


def bucket(word: Column, dim: int) -> Column:
    """Place of a word among ``dim`` numbers, by its MD5."""
    return (F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("bigint") % dim).cast("int")


def hashed_words(texts: DataFrame, dim: int = 64) -> DataFrame:
    """(id, bucket, n): how many words of texts (id, text) fall into each of ``dim`` buckets, empty ones left out. Texts without words have no rows."""
    words = texts.select("id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).alias("word"))
    return words.groupBy("id", "word").agg(F.count(F.lit(1)).alias("n")).groupBy("id", bucket(F.col("word"), dim).alias("bucket")).agg(F.sum("n").alias("n"))


def hashed_similarity(texts: DataFrame, query: str, dim: int = 64) -> DataFrame:
    """(id, sim): cosine between hashed words of texts (id, text) and of a query; texts that share no bucket are left out."""
    spark = texts.sparkSession
    asked = hashed_words(spark.createDataFrame([(0, query)], "id int, text string"), dim).select("bucket", F.col("n").alias("m"))
    size = asked.agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("own"))
    both = hashed_words(texts, dim).join(F.broadcast(asked), "bucket", "left").groupBy("id").agg(F.sum(F.col("n") * F.col("m")).alias("dot"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("size"))
    return both.where("dot > 0").crossJoin(F.broadcast(size)).select("id", (F.col("dot") / (F.col("size") * F.col("own"))).alias("sim"))
