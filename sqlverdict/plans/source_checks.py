"""Registered round trips: tables written by a sink, read back by a source, next to SQL over the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlverdict.operators import reports
from sqlverdict.plans import fixtures as fx
from sqlverdict.plans import score_checks
from sqlverdict.session import cut_lineage, scratch_path
from sqlverdict.sources import checkpoint, readers, vector_ledger


def csv_round_trip(spark, sf):
    """A split written as CSV and read as an example file: quotes, line ends and blanks stay."""
    path = scratch_path(spark, "split")
    readers.write_split(fx.raw_rows(spark, sf).withColumnRenamed("row_idx", "place"), path)
    back = readers.read_examples(spark, path)
    return back.select(F.col("place").cast("bigint").alias("place"), "split", F.md5("question").alias("question"), "db_dump", F.md5("gold_queries").alias("gold"))


def dense_rows(spark, sf):
    """Rows of an example file are numbered from 0 without a gap."""
    path = scratch_path(spark, "rows")
    readers.write_split(fx.raw_rows(spark, sf).withColumnRenamed("row_idx", "place"), path)
    return readers.read_examples(spark, path).agg(
        F.count("*").alias("n"), F.count_distinct("row_idx").alias("places"), F.min("row_idx").cast("bigint").alias("first"), F.max("row_idx").cast("bigint").alias("last"))


def landed_sources(spark, sf):
    """Two datasets landed by split and read as one table."""
    paths = {}
    for source, rest in (("ambrosia", 0), ("spider_dev", 1)):
        paths[source] = scratch_path(spark, source)
        readers.land_examples(fx.raw_rows(spark, sf).filter(F.col("row_idx") % 2 == rest), paths[source])
    back = readers.read_sources(spark, paths)
    return back.groupBy("dataset", "split").agg(F.count("*").alias("n"), F.sum(F.length("question")).alias("chars"))


def results_round_trip(spark, sf):
    """Results of two batches, the second with some rows again: the later row of an id counts."""
    path = scratch_path(spark, "results")
    rows = fx.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), (F.col("doc_id") % 100 / 100).alias("f1"), "doc_id")
    again = rows.filter("doc_id % 4 = 1").withColumn("f1", F.col("f1") + 1)
    for batch in (rows, again):
        readers.write_results(batch.drop("doc_id"), batch.agg(F.count("*").alias("n")), path, {"seed": 1, "api_key": "x"})
    back = checkpoint.read_checkpoint(spark, path + "/detailed", "id string, f1 double, written_at long")
    return back.select("id", F.round("f1", 6).alias("f1"))


def report_files(spark, sf):
    """A classification report written as JSON and read again."""
    path = scratch_path(spark, "reports")
    readers.write_classification_report(fx.examples(spark, sf).select("gt_category", "pred_category"), "gt_category", "pred_category", path)
    back = spark.read.schema("ord int, label string, precision double, recall double, f1 double, support bigint").json(path + "/report_test")
    return back.withColumns({m: F.round(m, 6) for m in ("precision", "recall", "f1")})


def stage_files(spark, sf):
    """Stage results written with the settings of a run, of which secrets are left out."""
    path = scratch_path(spark, "stages")
    readers.write_stage_results(reports.reward_stages(fx.rewards(spark, sf)), path, {"seed": 1, "hf_token": "x"})
    return spark.read.json(path).groupBy("config").agg(F.count_distinct("stage").alias("stages"))


def vector_versions(spark, sf):
    """Vectors kept under the hash of their content: found for the same rows in any order, not for others."""
    path, rows = scratch_path(spark, "vectors"), fx.table(spark, sf, "embeddings")
    readers.save_vectors(rows, path, "ambrosia", "train", readers.content_hash(rows))
    same = readers.load_vectors(spark, path, "ambrosia", "train", readers.content_hash(rows.repartition(5)))
    other = readers.load_vectors(spark, path, "ambrosia", "train", readers.content_hash(rows.withColumn("label", F.lit("x"))))
    return same.agg(F.count("*").alias("n"), F.sum(F.size("embedding")).cast("bigint").alias("numbers")).withColumn("other", F.lit(other is not None))


def _shape(texts: DataFrame) -> DataFrame:
    """A stand-in for an encoder: two numbers of a text."""
    return texts.select("key", F.array(F.length("text"), F.size(F.split("text", " "))).cast("array<float>").alias("vector"))


def vector_ledger_runs(spark, sf):
    """Three corpora after each other: how many texts each sends to the encoder, and the sum of what its rows get."""
    path = scratch_path(spark, "ledger")
    docs, turns = (fx.table(spark, sf, t).select("text") for t in ("documents", "conversations"))
    runs = []
    for name, corpus in (("documents", docs), ("again", docs), ("with_turns", docs.unionByName(turns))):
        before = vector_ledger.read_ledger(spark, path, "v1").count()
        vector_ledger.encode_unseen(corpus, _shape, path, "v1")
        after = vector_ledger.read_ledger(spark, path, "v1").count()
        rows = vector_ledger.with_vectors(corpus, path, "v1")
        # One plan must not read the ledger before and after a run: scans of one path count as the same.
        sums = cut_lineage(rows.agg(F.count("*").alias("rows"), F.sum(F.element_at("embedding", 1).cast("double")).cast("bigint").alias("chars")))
        runs.append(sums.select(F.lit(name).alias("run"), F.lit(after - before).alias("encoded"), "rows", "chars"))
    return reduce(DataFrame.unionByName, runs)


QUERIES = {
    "csv_round_trip": csv_round_trip, "dense_rows": dense_rows, "landed_sources": landed_sources, "results_round_trip": results_round_trip,
    "report_files": report_files, "stage_files": stage_files, "vector_versions": vector_versions, "vector_ledger_runs": vector_ledger_runs,
}


def _raw(tail: str) -> str:
    return f"WITH {fx.SQL_RAW}\n{tail}"


ORACLE = {
    "csv_round_trip": _raw("SELECT row_idx AS place, split, md5(coalesce(question, '')) AS question, coalesce(db_dump, '') AS db_dump, md5(gold_queries) AS gold FROM raw"),
    "dense_rows": "SELECT count(*) AS n, count(*) AS places, 0 AS first, count(*) - 1 AS last FROM documents",
    "landed_sources": _raw("""SELECT CASE row_idx % 2 WHEN 0 THEN 'ambrosia' ELSE 'spider' END AS dataset, split, count(*) AS n, sum(length(question)) AS chars
FROM raw GROUP BY 1, 2"""),
    "results_round_trip": "SELECT CAST(doc_id AS VARCHAR) AS id, round(doc_id % 100 / 100 + CASE WHEN doc_id % 4 = 1 THEN 1 ELSE 0 END, 6) AS f1 FROM documents",
    "report_files": score_checks.ORACLE["class_report"],
    "stage_files": f"SELECT '{{\"seed\": 1}}' AS config, count(DISTINCT stage) AS stages FROM ({score_checks.ORACLE['reward_stages']})",
    "vector_versions": "SELECT count(*) AS n, sum(len(embedding)) AS numbers, false AS other FROM embeddings",
    "vector_ledger_runs": """WITH d AS (SELECT text FROM documents), t AS (SELECT text FROM conversations)
SELECT 'documents' AS run, count(DISTINCT text) AS encoded, count(*) AS rows, sum(length(text)) AS chars FROM d
UNION ALL SELECT 'again', 0, count(*), sum(length(text)) FROM d
UNION ALL SELECT 'with_turns', (SELECT count(DISTINCT text) FROM t WHERE text NOT IN (SELECT text FROM d WHERE text IS NOT NULL)), count(*), sum(length(text))
FROM (SELECT text FROM d UNION ALL SELECT text FROM t)""",
}
