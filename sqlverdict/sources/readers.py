"""Benchmark files, stored tables, vectors and result sinks."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sqlverdict.operators.examples import complete
from sqlverdict.operators.numbering import dense_index
from sqlverdict.operators.reports import class_breakdown, class_report

# The four datasets with their evaluation and retrieval source.
SOURCES = {
    "ambrosia": ("ambrosia", "ambrosia"),
    "ambiqt": ("ambiqt", "ambiqt"),
    "bird": ("bird_dev", "bird_train"),
    "spider": ("spider_dev", "spider_train"),
}

#: Settings with these in their names are never written.
SECRET_WORDS = ("key", "token", "secret", "password", "credential")


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """A header CSV with quoted multi-line cells, every value text, rows numbered by file name and place.

    Multi-line CSV cannot be split, so land it once with ``land_examples`` and read
    the table from then on.
    """
    csv = spark.read.options(
        header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8", inferSchema=False, nullValue="\x00",
        emptyValue="").csv(path)
    placed = csv.select("*", F.col("_metadata.file_path").alias("_file")).withColumn("_at", F.monotonically_increasing_id())
    return complete(dense_index(placed, "row_idx", "_file", "_at").drop("_file", "_at"))


def land_examples(raw: DataFrame, path: str) -> None:
    """The raw table as Parquet by split; row numbers are kept."""
    raw.write.mode("overwrite").partitionBy("split").parquet(path)


def source_for(dataset: str, paths: Mapping[str, str], retrieval: bool = False) -> str:
    """Path of a dataset's evaluation or retrieval source."""
    if dataset not in SOURCES:
        raise ValueError(f"unknown dataset {dataset}; known: {', '.join(SOURCES)}")
    return paths[SOURCES[dataset][1 if retrieval else 0]]


def read_sources(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """All landed datasets in one table with a ``dataset`` column."""
    parts = [
        complete(spark.read.parquet(source_for(name, paths))).withColumn("dataset", F.lit(name))
        for name, (evaluation, _) in SOURCES.items() if evaluation in paths]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def public_config(config: Mapping | None) -> str:
    """A run's settings as JSON, without those whose names speak of secrets."""
    return json.dumps({k: v for k, v in (config or {}).items() if not any(w in k.lower() for w in SECRET_WORDS)}, sort_keys=True)


def write_results(scores: DataFrame, summary: DataFrame, path: str, config: Mapping | None = None, mode: str = "append") -> None:
    """Detailed rows (by dataset if there is one) and a one-row summary.

    Batches append; nothing written before is rewritten. Keys naming a secret are
    left out of the config.
    """
    rows = scores.withColumn("written_at", F.unix_micros(F.current_timestamp()))
    writer = rows.write.mode(mode)
    (writer.partitionBy("dataset") if "dataset" in scores.columns else writer).json(f"{path}/detailed")
    summary.withColumns({
        "config": F.lit(public_config(config)), "written_at": F.current_timestamp(),
    }).coalesce(1).write.mode("overwrite").json(f"{path}/summary")


def write_classification_report(df: DataFrame, truth: str, pred: str, path: str, split: str = "test") -> None:
    """Report, per-class breakdown and predictions as JSON tables."""
    class_report(df, truth, pred).coalesce(1).write.mode("overwrite").json(f"{path}/report_{split}")
    class_breakdown(df, truth, pred).coalesce(1).write.mode("overwrite").json(f"{path}/breakdown_{split}")
    df.write.mode("overwrite").json(f"{path}/predictions_{split}")


def write_split(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """A re-split table as CSV with header, or as Parquet by split."""
    if fmt == "csv":
        df.write.mode("overwrite").options(
            header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    elif fmt == "parquet":
        df.write.mode("overwrite").partitionBy("split").parquet(path)
    else:
        raise ValueError(f"unknown format {fmt}")


def content_hash(df: DataFrame) -> str:
    """An order-free hash of a table's rows, from sums made on the cluster."""
    row = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    h = F.xxhash64(row)
    low, high = h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32)
    got = df.agg(F.count("*"), F.sum(low.cast("decimal(20,0)")), F.sum(high.cast("decimal(20,0)"))).first()
    return hashlib.sha256("|".join(str(v) for v in got).encode()).hexdigest()


def save_vectors(vectors: DataFrame, path: str, source: str, split: str, version: str) -> None:
    """Vectors with their rows, keyed by source, split and content version."""
    vectors.write.mode("overwrite").parquet(f"{path}/source={source}/split={split}/version={version}")


def load_vectors(spark: SparkSession, path: str, source: str, split: str, version: str, rebuild: bool = False) -> DataFrame | None:
    """Stored vectors of exactly this content, or None (also when a rebuild is forced)."""
    if rebuild:
        return None
    try:
        return spark.read.parquet(f"{path}/source={source}/split={split}/version={version}")
    except PySparkException as error:
        if "PATH_NOT_FOUND" in str(error.getCondition() or ""):
            return None
        raise


def write_stage_results(stages: DataFrame, path: str, config: Mapping | None = None) -> None:
    """Sample counts and best rewards per stage, with the run's config but no keys."""
    stages.withColumn("config", F.lit(public_config(config))).coalesce(1).write.mode("overwrite").json(path)


def empty(spark: SparkSession, ddl: str) -> DataFrame:
    return spark.createDataFrame([], T.StructType.fromDDL(ddl))
