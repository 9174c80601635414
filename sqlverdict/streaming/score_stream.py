"""Incremental scoring: arriving runs and cells become appended scores.

Runs and cells are flat files, a row per statement and a row per cell, so a result may be
of any size. They are written first, below ``runs/part=<p>`` and ``cells/part=<p>``; then a
marker per example and part says how many there should be, and of how many pieces (parts) the
example consists. Markers are what is streamed. A state per example collects its pieces: it is
handed on once, when all have come, whatever is announced again or later; one that stays
without some of them for too long becomes an error row. A micro-batch reads only the parts it names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sqlverdict.operators.score import evaluate
from sqlverdict.session import cut_lineage

MARKERS = "example_id STRING, part STRING, n_runs BIGINT, n_cells BIGINT, pieces INT"
READY = "example_id STRING, parts ARRAY<STRING>, n_runs BIGINT, n_cells BIGINT, pieces INT, complete BOOLEAN"
_STATE = "parts ARRAY<STRING>, n_runs BIGINT, n_cells BIGINT, pieces INT, done BOOLEAN"
RUNS = ("example_id STRING, side STRING, query_id STRING, pos INT, sql STRING, ordered BOOLEAN, ok BOOLEAN, error STRING, part STRING")
CELLS = ("example_id STRING, side STRING, query_id STRING, row_idx BIGINT, col_idx INT, kind STRING, num DOUBLE, str STRING, part STRING")
#: Statuses of examples whose scores stand.
SCORED = ("ok", "unanswerable")


def arrived(markers: DataFrame, runs: DataFrame, cells: DataFrame) -> DataFrame:
    """(example_id, error): NULL where as many runs and cells are there as the marker says."""
    counted = [df.groupBy("example_id").agg(F.count("*").alias(name)) for df, name in ((runs, "_r"), (cells, "_c"))]
    both = markers.join(counted[0], "example_id", "left").join(counted[1], "example_id", "left").fillna(0, ["_r", "_c"])
    short = (F.col("_r") != F.col("n_runs")) | (F.col("_c") != F.col("n_cells"))
    return both.select("example_id", F.when(short, F.format_string(
        "%d of %d runs, %d of %d cells", "_r", "n_runs", "_c", "n_cells")).alias("error"))


def score_batch(markers: DataFrame, runs: DataFrame, cells: DataFrame, dedup: bool = True) -> tuple[DataFrame, DataFrame]:
    """(scores, errors) of one batch; examples that could not be scored go to errors, not away.

    An example with missing or surplus rows has the status ``incomplete`` and no score; one
    whose gold cannot be used has a zero score and an error row; so has any other status.
    """
    markers = markers.dropDuplicates(["example_id"])
    mine = [df.join(markers.select("example_id"), "example_id", "left_semi") for df in (runs, cells)]
    state = arrived(markers, *mine)
    complete = state.filter("error IS NULL").select("example_id")
    scores = evaluate(*[df.join(complete, "example_id", "left_semi").drop("part") for df in mine], dedup)
    failed = scores.filter(~F.col("status").isin(*SCORED)).select("example_id", "status", "error")
    return scores, failed.unionByName(state.filter("error IS NOT NULL").select("example_id", F.lit("incomplete").alias("status"), "error"))


def collected(markers: DataFrame, patience: int = 3_600_000) -> DataFrame:
    """A row per example (``READY``) once its announced pieces are in, or ``patience`` milliseconds after the last one that came.

    A marker for a part that has come, or for an example that was handed on, changes nothing.
    What the state holds of an example that was handed on goes after the same time.
    """
    def collect(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts, n_runs, n_cells, pieces, done = state.get if state.exists else ([], 0, 0, 1, False)
        parts = list(parts)

        def row(complete: bool) -> pd.DataFrame:
            return pd.DataFrame([(key[0], parts, n_runs, n_cells, pieces, complete)], columns=["example_id", "parts", "n_runs", "n_cells", "pieces", "complete"])

        if state.hasTimedOut:
            state.remove()
            if not done:
                yield row(False)
            return
        for frame in frames:
            for part, runs, cells, of in zip(frame["part"], frame["n_runs"], frame["n_cells"], frame["pieces"]):
                if not done and part not in parts:
                    parts.append(part)
                    n_runs, n_cells = n_runs + int(runs), n_cells + int(cells)
                    pieces = max(pieces, 1 if pd.isna(of) else int(of))
        if not done and len(parts) >= pieces:
            done = True
            yield row(True)
        state.update((parts, n_runs, n_cells, pieces, done))
        state.setTimeoutDuration(patience)

    return markers.groupBy("example_id").applyInPandasWithState(collect, READY, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def score_stream(markers: DataFrame, path: str, out: str, checkpoint: str, dedup: bool = True, patience: int = 3_600_000) -> StreamingQuery:
    """Scores whatever has arrived below ``path``, then stops; a restart goes on after the last batch.

    Each micro-batch overwrites its own folder, so a repeated batch leaves no
    second copy. An infrastructure failure fails the query.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = cut_lineage(batch)  # the state runs once
        ready = batch.filter("complete")
        named = ready.select("example_id", F.explode("parts").alias("part"))
        parts = [r["part"] for r in named.select("part").distinct().toLocalIterator()]
        runs, cells = (spark.read.schema(schema).json(f"{path}/{kind}").filter(F.col("part").isin(parts)).join(named, ["example_id", "part"], "left_semi")
                       for kind, schema in (("runs", RUNS), ("cells", CELLS)))
        scores, errors = score_batch(ready.select("example_id", "n_runs", "n_cells"), runs, cells, dedup)
        late = batch.filter("NOT complete").select("example_id", F.lit("incomplete").alias("status"), F.format_string(
            "%d of %d pieces", F.size("parts"), F.col("pieces")).alias("error"))
        scores.write.mode("overwrite").parquet(f"{out}/scores/batch={batch_id}")
        errors.unionByName(late).write.mode("overwrite").parquet(f"{out}/errors/batch={batch_id}")

    # Timeouts are looked at when something arrives; batches without data would go on for ever.
    conf, name = markers.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        return collected(markers, patience).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(name, before)


def read_markers(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """The JSON markers below ``path/markers`` as a stream; ``max_files`` is a rate per batch."""
    return spark.readStream.schema(MARKERS).option("maxFilesPerTrigger", max_files).json(f"{path}/markers")


def running_totals(spark: SparkSession, out: str) -> DataFrame:
    """Counts and means over every batch so far, re-aggregated from the appended rows; an example counts once, as scored last."""
    rows = spark.read.parquet(f"{out}/scores")
    last = rows.groupBy("example_id").agg(F.max_by(F.struct("status", "f1", "f1_flex"), "batch").alias("r")).select("r.*")
    return last.groupBy("status").agg(
        F.count("*").alias("n"), F.avg("f1").alias("avg_f1"), F.avg("f1_flex").alias("avg_f1_flex"))


def error_totals(spark: SparkSession, out: str) -> DataFrame:
    """Examples by the kind of error that kept them from a score."""
    return spark.read.parquet(f"{out}/errors").groupBy("status").agg(F.count_distinct("example_id").alias("n"))
