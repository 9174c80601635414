"""Prompt and request tables for model runs outside this engine."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlverdict.functions.text import strip_inserts
from sqlverdict.operators.curate import capped_sample
from sqlverdict.functions.pytext import strip
from sqlverdict.schema import CATEGORY_NAMES

# The texts of few-shot, retry and repair prompts, and the place for error lists.
CLASSIFICATION_HEAD = "**Question Classification:**\n\nClassification probabilities:\n"
PROBABILITY_LINE = "  - {name}: %.4f\n"
LIKELY_HEAD, LIKELY_TAIL = "\nThe question is most likely: **", "**\n\n"
SHOWN_SAME, SHOWN_OTHER, SHOWN_TAIL = "Showing {n} example(s) from **", "** category and {n} example(s) from **", "** category.\n\n"
HEADER_END = "---\n\n"
EXAMPLE_HEAD, EXAMPLE_CATEGORY, EXAMPLE_TYPE = "**Example ", "** (Category: ", ", Ambiguity Type: "
EXAMPLE_SCHEMA, EXAMPLE_QUESTION = "):\n\nDatabase Schema:\n", "\n\nQuestion: "
MANY_QUERIES_HEAD, MANY_QUERIES_TAIL = "\n\n**This question has ", " valid SQL queries:**"
ONE_QUERY = "\n\n**This question has 1 valid SQL query:**"
EXAMPLE_SQL = "\n\nSQL "
RETRY_HEAD = "\n\n**RETRY CONTEXT - Previous Attempt Failed:**\n"
RETRY_ERRORS = "\n**Previous SQL Execution Errors:**\n"
RETRY_GUIDANCE = "\n**Failure Analysis and Guidance:**\n"
RETRY_TAIL = ("\n**IMPORTANT:** Use the schema and error information above to avoid making the same mistakes. "
              "Generate corrected SQL queries.\n")
NO_EXAMPLES = "No examples provided."
ERRORS_HEAD = "The following execution errors occurred:\n\nExecution Errors:\n"
ERRORS_BEFORE = "Review the question, interpretations and queries thoroughly"


def fill(template: str, **fields: Column) -> Column:
    """A format-style template with columns as fields."""
    parts = []
    for text, field, _, _ in Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if field is not None:
            parts.append(F.coalesce(fields[field].cast("string"), F.lit("")))
    return F.concat(*parts) if parts else F.lit("")


def _category_name(c: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in CATEGORY_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, c), c)


def _header(k_same: int | None, k_other: int | None) -> Column:
    rows = [F.lit(CLASSIFICATION_HEAD)]
    for cat, col in (("U", "p_u"), ("AA", "p_aa"), ("AU", "p_au")):
        rows.append(F.format_string(PROBABILITY_LINE.format(name=CATEGORY_NAMES[cat]), F.coalesce(F.col(col), F.lit(0.0))))
    name = _category_name(F.col("category"))
    other = F.when(F.col("category") == "AA", "AU").when(F.col("category") == "AU", "AA").otherwise("AA/AU")
    rows.append(F.concat(F.lit(LIKELY_HEAD), name, F.lit(LIKELY_TAIL)))
    if k_same and k_other:
        rows.append(F.concat(
            F.lit(SHOWN_SAME.format(n=k_same)), name, F.lit(SHOWN_OTHER.format(n=k_other)), _category_name(other), F.lit(SHOWN_TAIL)))
    return F.concat(*rows, F.lit(HEADER_END))


def fewshot_text(
    neighbours: DataFrame, corpus: DataFrame, include_sql: bool = False, probs: DataFrame | None = None,
    k_same: int | None = None, k_other: int | None = None,
) -> DataFrame:
    """One text per query from its ranked neighbours: (query_id, examples_text).

    ``probs(query_id, category, p_u, p_aa, p_au)`` adds a classification header.
    Queries without neighbours have no row. A query's list is as long as its k.
    """
    near = neighbours.select("query_id", "rank", "vec_id").join(
        corpus.select("vec_id", "question", "category", "ambig_type", "db_dump", "gold_queries"), "vec_id")
    typed = (F.col("category") == "AA") & (F.coalesce(F.col("ambig_type"), F.lit("")) != "")
    part = F.concat(
        F.lit(EXAMPLE_HEAD), F.col("rank").cast("string"), F.lit(EXAMPLE_CATEGORY), _category_name(F.col("category")),
        F.when(typed, F.concat(F.lit(EXAMPLE_TYPE), "ambig_type")).otherwise(""), F.lit(EXAMPLE_SCHEMA),
        strip(strip_inserts(F.coalesce("db_dump", F.lit("")), any_case=False)), F.lit(EXAMPLE_QUESTION), "question")
    if include_sql:
        n = F.coalesce(F.size("gold_queries"), F.lit(0))
        count = F.when(n > 1, F.concat(F.lit(MANY_QUERIES_HEAD), n.cast("string"), F.lit(MANY_QUERIES_TAIL))).otherwise(ONE_QUERY)
        numbered = F.transform("gold_queries", lambda q, i: F.concat(
            F.lit(EXAMPLE_SQL), (i + 1).cast("string"), F.lit(": "), q))
        part = F.concat(part, F.when(n > 0, F.concat(count, F.array_join(numbered, ""))).otherwise(""))
    texts = near.select("query_id", F.struct("rank", part.alias("text")).alias("p")).groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list("p")), lambda p: p["text"]).alias("parts"))
    if probs is None:
        return texts.select("query_id", F.array_join("parts", "\n\n").alias("examples_text"))
    head = probs.select("query_id", _header(k_same, k_other).alias("head"))
    whole = F.when(F.col("head").isNotNull(), F.concat(F.array("head"), "parts")).otherwise(F.col("parts"))
    return texts.join(head, "query_id", "left").select("query_id", F.array_join(whole, "\n\n").alias("examples_text"))


def generation_request(df: DataFrame, template: str, system: str = "", max_errors: int | None = 5) -> DataFrame:
    """Adds ``system`` and ``user`` texts; the first ``max_errors`` earlier errors or guidance come in front.

    ``df(id, question, db_schema, examples_text, previous_errors, retry_guidance)``.
    """
    user = fill(template, db_schema=F.col("db_schema"), question=F.col("question"), examples_text=F.col("examples_text"))
    errors = F.col("previous_errors") if max_errors is None else F.slice("previous_errors", 1, max_errors)
    listed = F.transform(errors, lambda e, i: F.concat((i + 1).cast("string"), F.lit(". "), e, F.lit("\n")))
    has_errors = F.coalesce(F.size("previous_errors") > 0, F.lit(False))
    has_guidance = F.coalesce(F.col("retry_guidance") != "", F.lit(False))
    retry = F.concat(
        F.lit(RETRY_HEAD),
        F.when(has_errors, F.concat(F.lit(RETRY_ERRORS), F.array_join(listed, ""))).otherwise(""),
        F.when(has_guidance, F.concat(F.lit(RETRY_GUIDANCE), "retry_guidance", F.lit("\n"))).otherwise(""),
        F.lit(RETRY_TAIL))
    return df.withColumns({
        "system": F.lit(system), "user": F.when(has_errors | has_guidance, F.concat(retry, user)).otherwise(user)})


def correction_request(df: DataFrame, template: str, system: str = "", anchor: str = ERRORS_BEFORE) -> DataFrame:
    """Adds ``system`` and ``user`` texts for a repair round; errors go in before the anchor.

    ``df(id, question, db_schema, sql_queries, execution_errors, examples_text)``.
    """
    queries = F.array_join(F.transform("sql_queries", lambda q, i: F.concat(
        F.lit("Query "), (i + 1).cast("string"), F.lit(":\n"), q)), "\n\n")
    shown = F.coalesce(F.nullif(F.col("examples_text"), F.lit("")), F.lit(NO_EXAMPLES))
    user = fill(template, db_schema=F.col("db_schema"), question=F.col("question"), examples_text=shown, queries_text=queries)
    errors = F.filter("execution_errors", lambda e: e.isNotNull() & (e != ""))
    block = F.concat(
        F.lit(ERRORS_HEAD),
        F.array_join(F.transform(errors, lambda e: F.concat(F.lit("- "), e)), "\n"), F.lit("\n\n" + anchor))
    has = F.coalesce(F.size("execution_errors") > 0, F.lit(False))
    return df.withColumns({
        "system": F.lit(system), "user": F.when(has, F.replace(user, F.lit(anchor), block)).otherwise(user)})


def training_rows(df: DataFrame, template: str, system: str = "", n: int | None = None, seed: int = 42) -> DataFrame:
    """Prompt table: chat prompt, gold interpretations and their count, dump, question, type.

    ``df(id, question, db_dump, interpretations, ambig_type)``; dumps go into the
    prompt without data lines.
    """
    rows = df if n is None else capped_sample(df, n, (), seed)
    user = fill(template, db_dump=strip_inserts(F.col("db_dump")), question=F.col("question"))

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return rows.select(
        "id", F.array(message("system", F.lit(system)), message("user", user)).alias("prompt"),
        F.col("interpretations").alias("ground_truth_interpretations"), F.size("interpretations").alias("num_ground_truth"),
        "db_dump", "question", "ambig_type")
