"""Schema correctness and interpretation quality of statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlverdict.functions.entities import SQL_WORDS, schema_tables, statement_columns, statement_tables
from sqlverdict.operators.numbering import grouped_rank


def schema_entities(dumps: DataFrame) -> DataFrame:
    """(db_id, table, column) from ``dumps(db_id, db_dump)``; column NULL for a table without any."""
    tables = dumps.select("db_id", F.explode(schema_tables(F.col("db_dump"))).alias("t"))
    return tables.select("db_id", F.col("t.table").alias("table"), F.explode_outer("t.columns").alias("column"))


def statement_entities(statements: DataFrame) -> DataFrame:
    """(id, kind, name) for tables and columns named in ``statements(id, sql)``."""
    named = statements.select("id", F.explode(F.array(
        F.struct(F.lit("table").alias("kind"), statement_tables(F.col("sql")).alias("names")),
        F.struct(F.lit("column").alias("kind"), statement_columns(F.col("sql")).alias("names")))).alias("e"))
    return named.select("id", "e.kind", F.explode("e.names").alias("name"))


def unknown_entities(statements: DataFrame, entities: DataFrame) -> DataFrame:
    """Names in ``statements(id, db_id, sql)`` that their database does not have."""
    named = statement_entities(statements).join(statements.select("id", "db_id"), "id")
    known = entities.select("db_id", F.explode(F.array(
        F.struct(F.lit("table").alias("kind"), F.col("table").alias("name")),
        F.struct(F.lit("column").alias("kind"), F.col("column").alias("name")))).alias("k")).select("db_id", "k.*")
    words = F.lit(list(SQL_WORDS))
    return named.filter(~((F.col("kind") == "column") & F.array_contains(words, F.col("name")))).join(
        known, ["db_id", "kind", "name"], "left_anti").select("id", "kind", "name")


def schema_correctness(statements: DataFrame, dumps: DataFrame, first_columns: int = 5) -> DataFrame:
    """Adds ``schema_correctness`` and ``issues`` to ``statements(id, db_id, sql)``.

    0.6 x share of known tables (0 without tables) + 0.4 x share of known columns (1
    without columns), SQL words left out. Names in issues are sorted. Entities are
    extracted once per dump; of several dumps of a database the smallest text counts.
    Statements without a dump get 0.5. ``first_columns`` limits the names in an issue.
    """
    dumps = dumps.groupBy("db_id").agg(F.min("db_dump").alias("db_dump"))
    schemas = dumps.select("db_id", schema_tables(F.col("db_dump")).alias("s")).select(
        "db_id", F.col("s.table").alias("_tables"), F.flatten(F.col("s.columns")).alias("_columns"))
    out = statements.join(schemas, "db_id", "left").withColumns({
        "_st": statement_tables(F.col("sql")),
        "_sc": F.array_except(statement_columns(F.col("sql")), F.lit(list(SQL_WORDS))),
    }).withColumns({
        "_bad_t": F.array_sort(F.array_except("_st", "_tables")), "_bad_c": F.array_sort(F.array_except("_sc", "_columns"))})

    def share(bad: str, whole: str, empty: float) -> Column:
        return F.when(F.size(whole) == 0, empty).otherwise(1 - F.try_divide(F.size(bad), F.size(whole)))

    score = 0.6 * share("_bad_t", "_st", 0.0) + 0.4 * share("_bad_c", "_sc", 1.0)
    missing = F.col("_tables").isNull()
    issues = F.array_compact(F.array(
        F.when(F.size("_bad_t") > 0, F.concat(F.lit("Invalid tables: "), F.array_join("_bad_t", ", "))),
        F.when(F.size("_bad_c") > 0, F.concat(
            F.lit("Potentially invalid columns: "), F.array_join(F.slice("_bad_c", 1, first_columns), ", ")))))
    return out.select(
        *statements.columns, F.when(missing, 0.5).otherwise(score).alias("schema_correctness"),
        F.when(missing, F.array(F.lit("Schema validation error: no dump"))).otherwise(issues).alias("issues"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; NULL if either is missing or zero."""
    def dot(x, y):
        return F.aggregate(
            F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def interpretation_quality(statements: DataFrame, dumps: DataFrame, max_error: int | None = None) -> DataFrame:
    """Overall score 0..10: 4 x similarity + 3 x schema correctness + 3 if it ran.

    ``statements(id, db_id, sql, ok, error, question_vec, interpretation_vec)``; a
    missing vector counts as similarity 0.5. Error texts are whole unless ``max_error`` sets a length.
    """
    out = schema_correctness(statements, dumps).withColumn(
        "semantic_similarity", F.coalesce(cosine(F.col("question_vec"), F.col("interpretation_vec")), F.lit(0.5)))
    said = F.coalesce("error", F.lit(""))
    failed = F.concat(F.lit("Execution error: "), said if max_error is None else F.substring(said, 1, max_error))
    return out.withColumns({
        "execution_success": F.col("ok"),
        "overall_score": 4.0 * F.col("semantic_similarity") + 3.0 * F.col("schema_correctness")
        + F.when(F.col("ok"), 3.0).otherwise(0.0),
        "issues": F.when(F.col("ok"), F.col("issues")).otherwise(F.array_append("issues", failed)),
    })


def rank_by_score(df: DataFrame, by: str, score: str = "overall_score", key: str = "id") -> DataFrame:
    """Position of each row by descending score within its question."""
    return grouped_rank(df, by, "rank", F.col(score).desc(), F.col(key))
