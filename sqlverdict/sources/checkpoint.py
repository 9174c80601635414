"""Result checkpoints: appended rows per batch, resume by anti-join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def read_checkpoint(spark: SparkSession, path: str, schema: str, key: str = "id") -> DataFrame:
    """Earlier detailed rows, the last one per key; empty if the path is missing.

    Rows carry ``written_at``; among rows without it, or of one time, the row of the latest
    file, and further down in it, stays.
    """
    wanted = spark.createDataFrame([], schema)
    try:
        rows = spark.read.schema(wanted.schema).json(path).select("*", F.struct(
            "_metadata.file_modification_time", "_metadata.file_path", "_metadata.file_block_start").alias("_file"))
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error.getCondition() or error):
            return wanted
        raise
    time = F.coalesce("written_at", F.lit(0)) if "written_at" in wanted.columns else F.lit(0)
    rows = rows.withColumn("_at", F.struct(time.alias("time"), "_file", F.monotonically_increasing_id().alias("place")))
    rows = rows.filter(F.col(key).isNotNull())
    rest = [c for c in wanted.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "_at").alias("r")).select(key, "r.*").select(*wanted.columns)


def pending(examples: DataFrame, done: DataFrame, key: str = "example_id", done_key: str = "id") -> DataFrame:
    """Examples not finished yet."""
    return examples.join(done.select(F.col(done_key).alias(key)), key, "left_anti")
