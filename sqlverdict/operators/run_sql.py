"""Execute statements and keep their results as cells.

Statements are Spark SQL. Each distinct (database, text) runs once; equal statements of
other examples share the result. Statements are planned one by one on the driver, where
``guard`` lets only queries over the given tables pass, and run together: the results
of a part of a chunk are one union, numbered by one sort and written by one job, so jobs grow with chunks
and not with statements. Where a chunk fails, its halves run, down to the statement whose fault
it is. What is not allowed, and whatever fails, is an ``error`` row with the whole message.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from itertools import islice

from pyspark.errors import PySparkException, UnknownException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sqlverdict.functions.cells import EXACT, LONG, norm_value, raw_value, sort_key
from sqlverdict.functions.pytext import has_order_by, is_statement
from sqlverdict.operators.guard import checked
from sqlverdict.operators.numbering import grouped_rank
from sqlverdict.session import scratch_path

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType, T.BooleanType)
_CELLS = "stmt STRING, row_idx BIGINT, col_idx INT, kind STRING, num DOUBLE, str STRING"
_OUTCOME = "stmt STRING, ok BOOLEAN, error STRING, chunk STRING"
# Result rows, with their sort keys, that one task sorts.
SORT_ROWS = 100_000
_TABLE_NAME = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")


def cell_of(value: Column, kind: T.DataType) -> Column:
    """(kind, num, str) of a result value; dates and times as ISO text, nested values as JSON."""
    null_d, null_s = F.lit(None).cast("double"), F.lit(None).cast("string")
    if isinstance(kind, _NUMERIC):
        num = value.cast("int").cast("double") if isinstance(kind, T.BooleanType) else value.cast("double")
        exact = isinstance(kind, (T.LongType, T.DecimalType))
        whole = value == F.floor(value) if isinstance(kind, T.DecimalType) else F.lit(True)
        large = (F.abs(num) >= EXACT) & (F.abs(num) < LONG) & whole
        tag, text = "num", F.when(large, value.try_cast("bigint").cast("string")) if exact else null_s
    elif isinstance(kind, T.StringType):
        tag, num, text = "str", null_d, value.cast("string")
    elif isinstance(kind, T.BinaryType):
        tag, num, text = "bin", null_d, F.hex(value)
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        tag, num, text = "str", null_d, F.to_json(value)
    else:
        tag, num, text = "str", null_d, value.cast("string")
    return F.struct(F.when(value.isNull(), "null").otherwise(tag).alias("kind"), num.alias("num"), text.alias("str"))


def result_rows(result: DataFrame, ordered: bool, stmt: str) -> DataFrame:
    """(stmt, place, t, o, tie, cells): the rows of a query result with what orders them.

    Rows of an ordered statement keep their order. An unordered result has none in
    Spark, so its rows are put in the order of their normalised cells, texts before
    other values, which makes positional rules repeatable and lines up grouped
    results whatever the place of their key columns.
    """
    fields = result.schema.fields
    safe = result.toDF(*[f"c{i}" for i in range(len(fields))])
    row = safe.select(F.array(*[cell_of(F.col(f"c{i}"), f.dataType) for i, f in enumerate(fields)]).alias("cells"))
    keys = F.transform("cells", lambda c: sort_key(norm_value(raw_value(c["kind"], c["num"], c["str"]))))
    row = row.withColumn("place", F.monotonically_increasing_id() if ordered else F.lit(0).cast("long"))
    row = row.withColumn("k", F.slice(keys, 1, 0) if ordered else keys)
    tie = F.lit("") if ordered else F.to_json("cells")
    return row.select(F.lit(stmt).alias("stmt"), "place", F.filter("k", lambda k: k["rank"] == 2).alias("t"),
                      F.filter("k", lambda k: k["rank"] < 2).alias("o"), tie.alias("tie"), "cells")


def result_cells(rows: DataFrame) -> DataFrame:
    """(stmt, row_idx, col_idx, kind, num, str) of the results of many statements, numbered by one sort."""
    numbered = grouped_rank(rows, "stmt", "_r", "place", "t", "o", "tie", each=SORT_ROWS)
    return numbered.select("stmt", (F.col("_r") - 1).alias("row_idx"), F.posexplode("cells").alias("col_idx", "c")).select(
        "stmt", "row_idx", "col_idx", "c.*")


def run_statements(
    spark: SparkSession, statements: DataFrame, db_views: Callable[[str], Mapping[str, DataFrame]] | None = None,
    out: str | None = None, parallel: int = 4, chunk: int = 64,
) -> tuple[DataFrame, DataFrame]:
    """Runs ``statements(example_id, side, query_id, pos, sql, db_id)``.

    Returns (query_runs, result_cells). ``db_views(db_id)`` names the tables of a
    database; each database gets a session of its own, so that equal table names
    do not meet. Without it, statements see the tables of the current session.

    Cells are written below ``out`` in ``parallel`` jobs per ``chunk`` statements, then their outcomes, which name
    the job's part; cells of a part without outcomes do not count. A run on the same ``out`` skips statements with an
    outcome, so a broken run resumes. The driver holds only ``chunk`` statement texts at a time.
    """
    out = out or scratch_path(spark, "runs")
    todo = statements.select("db_id", "sql").distinct().withColumn(
        "stmt", F.sha2(F.concat_ws("\x01", "db_id", "sql"), 256)).withColumns({
            "readable": is_statement(F.col("sql")), "ordered": has_order_by(F.col("sql"))})
    done = _outcomes(spark, out)
    todo = todo.join(done.select("stmt"), "stmt", "left_anti")
    sessions: dict[str, tuple[SparkSession, set[str] | None]] = {}
    shared: list[str] = []

    def session_for(db_id: str) -> tuple[SparkSession, set[str] | None]:
        if db_views is None:
            return spark, None
        if db_id not in sessions:
            fresh, names = spark.newSession(), set()
            for name, df in db_views(db_id).items():
                if not _TABLE_NAME.match(name):
                    raise ValueError(f"bad table name {name}")
                shared.append(_share(df, fresh, db_id, name))
                names.add(name)
            sessions[db_id] = fresh, names
        return sessions[db_id]

    def plan(row) -> DataFrame | str:
        try:
            if not row["readable"]:
                raise ValueError("only select statements run")
            session, names = session_for(row["db_id"])
            return result_rows(checked(session, row["sql"].strip().rstrip(";"), names), row["ordered"], row["stmt"])
        except UnknownException:
            raise  # not the statement's fault: stop, and resume later
        except (PySparkException, ValueError) as problem:
            return str(problem)

    def write(planned: list[tuple[str, DataFrame]]) -> list[tuple[str, bool, str | None, str]]:
        """Outcomes of planned statements; their cells are written by one job, or by those of both halves where it fails."""
        if not planned:
            return []
        name = hashlib.sha256("".join(stmt for stmt, _ in planned).encode()).hexdigest()
        try:
            result_cells(reduce(DataFrame.union, [rows for _, rows in planned])).write.mode("overwrite").parquet(f"{out}/cells/chunk={name}")
        except UnknownException:
            raise
        except PySparkException as problem:
            if len(planned) == 1:
                return [(planned[0][0], False, str(problem), name)]
            half = len(planned) // 2
            return write(planned[:half]) + write(planned[half:])
        return [(stmt, True, None, name) for stmt, _ in planned]

    rows = todo.orderBy("db_id", "stmt").toLocalIterator()
    with ThreadPoolExecutor(parallel) as pool:
        while batch := list(islice(rows, chunk)):
            for db_id in dict.fromkeys(row["db_id"] for row in batch):
                session_for(db_id)
            plans = list(pool.map(lambda row: (row["stmt"], plan(row)), batch))
            outcomes = [(stmt, False, error, None) for stmt, error in plans if isinstance(error, str)]
            good = [(stmt, df) for stmt, df in plans if not isinstance(df, str)]
            outcomes += [o for part in pool.map(write, [good[k::parallel] for k in range(parallel)]) for o in part]
            spark.createDataFrame(outcomes, _OUTCOME).coalesce(1).write.mode("append").parquet(f"{out}/outcomes")
            for view in shared:
                spark.catalog.dropGlobalTempView(view)
            sessions.clear()
            shared.clear()
    return _collect_runs(spark, statements, out)


def _share(df: DataFrame, session: SparkSession, db_id: str, name: str) -> str:
    """Makes a DataFrame visible in another session under its plain name."""
    shared = "v_" + hashlib.sha256(f"{db_id}|{name}".encode()).hexdigest()[:24]
    df.createOrReplaceGlobalTempView(shared)
    session.sql(f"SELECT * FROM global_temp.{shared}").createOrReplaceTempView(name)
    return shared


def _read(spark: SparkSession, schema: str, path: str) -> DataFrame:
    """The table at ``path``, empty if nothing is there; any other failure is one."""
    try:
        return spark.read.schema(schema).parquet(path)
    except PySparkException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _outcomes(spark: SparkSession, out: str) -> DataFrame:
    return _read(spark, _OUTCOME, f"{out}/outcomes")


def _collect_runs(spark: SparkSession, statements: DataFrame, out: str) -> tuple[DataFrame, DataFrame]:
    named = statements.withColumn("stmt", F.sha2(F.concat_ws("\x01", "db_id", "sql"), 256))
    outcomes = _outcomes(spark, out)
    runs = named.join(outcomes, "stmt").select(
        "example_id", "side", "query_id", F.col("pos").cast("int").alias("pos"), "sql",
        has_order_by(F.col("sql")).alias("ordered"), "ok", "error")
    cells = _read(spark, _CELLS + ", chunk STRING", f"{out}/cells").join(outcomes.where("ok").select("stmt", "chunk"), ["stmt", "chunk"])
    return runs, cells.join(named.select("stmt", "example_id", "side", "query_id"), "stmt").drop("stmt", "chunk")
