"""Vectors by content: a text is encoded once per encoder version, whatever table it comes in.

The ledger is a Parquet table below ``path``, one folder per version, of ``(key, vector)``; the key is
the SHA-256 of the text. A corpus that changed in a few rows sends only those texts to the encoder.

Null texts have no vector. An encoder that leaves a key out leaves it unseen, so the next run tries it
again. A batch is appended as a whole or not at all; of keys that two writers appended at once, one vector counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "key string, vector array<float>"


def text_key(text: Column | str) -> Column:
    return F.sha2(F.encode(F.col(text) if isinstance(text, str) else text, "UTF-8"), 256)


def read_ledger(spark: SparkSession, path: str, version: str) -> DataFrame:
    """All vectors of a version; none if nothing was encoded with it yet."""
    try:
        return spark.read.schema(SCHEMA).parquet(f"{path}/version={version}")
    except PySparkException as error:
        if "PATH_NOT_FOUND" in str(error.getCondition() or ""):
            return spark.createDataFrame([], SCHEMA)
        raise


def unseen(corpus: DataFrame, path: str, version: str, text: str = "text") -> DataFrame:
    """``(key, text)``: the distinct texts of a corpus that this version has not encoded.

    Keys alone meet the ledger; a text repeated in a third of the rows is reduced to one before the shuffle.
    """
    texts = corpus.filter(F.col(text).isNotNull()).select(text_key(text).alias("key"), F.col(text).alias("text"))
    texts = texts.groupBy("key").agg(F.first("text").alias("text"))
    return texts.join(read_ledger(corpus.sparkSession, path, version).select("key"), "key", "left_anti")


def encode_unseen(
    corpus: DataFrame, encode: Callable[[DataFrame], DataFrame], path: str, version: str, text: str = "text",
) -> None:
    """Append the vectors of unseen texts. ``encode`` maps ``(key, text)`` to ``(key, vector)``."""
    made = encode(unseen(corpus, path, version, text)).select("key", F.col("vector").cast("array<float>").alias("vector"))
    made.write.mode("append").parquet(f"{path}/version={version}")


def with_vectors(corpus: DataFrame, path: str, version: str, text: str = "text", name: str = "embedding") -> DataFrame:
    """The corpus with the vector of each text, null where there is none."""
    ledger = read_ledger(corpus.sparkSession, path, version).groupBy("key").agg(F.first("vector").alias(name))
    keyed = corpus.drop(name).withColumn("_key", text_key(text))
    return keyed.join(ledger.withColumnRenamed("key", "_key"), "_key", "left").drop("_key")
