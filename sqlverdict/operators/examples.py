"""From raw benchmark rows to evaluation examples and retrieval corpora.

Raw tables have the RAW_COLUMNS as text and ``row_idx``, the row's number in its
file. Missing columns count as NULL.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sqlverdict.functions.pytext import blank_to_null, collapse_spaces, strip
from sqlverdict.functions.text import kind_of, parse_json
from sqlverdict.operators.numbering import first_per_group
from sqlverdict.schema import RAW_COLUMNS


def complete(raw: DataFrame) -> DataFrame:
    """Adds absent raw columns as NULL text."""
    return raw.withColumns({c: F.lit(None).cast("string") for c in RAW_COLUMNS if c not in raw.columns})


def split_is(split: str, trimmed: bool = True) -> Column:
    return (strip(F.col("split")) if trimmed else F.col("split")) == split


def present(*columns: str) -> Column:
    """True where all the columns are non-blank."""
    test = F.lit(True)
    for c in columns:
        test = test & blank_to_null(F.col(c)).isNotNull()
    return test


def first_nonblank(*columns: str) -> Column:
    return F.coalesce(*[blank_to_null(F.col(c)) for c in columns], F.lit(""))


def derive_category(mode: str = "column") -> Column:
    """Question category, NULL where it cannot be told.

    ``column`` trusts a given category first; ``flags`` ignores it; ``default``
    trusts it and falls back to AU.
    """
    flag = F.upper(F.coalesce(strip(F.col("is_ambiguous")), F.lit("")))
    flags = (
        F.when(strip(F.col("question_type")) == "unanswerable", "U").when(flag == "TRUE", "AA")
    )
    if mode == "default":
        flags = flags.otherwise("AU")
    else:
        flags = flags.when(flag == "FALSE", "AU")
    return flags if mode == "flags" else F.coalesce(blank_to_null(F.col("question_category")), flags)


def split_gold(c: Column) -> Column:
    """Statements separated by blank lines, each on one line."""
    return F.filter(F.transform(F.split(strip(c), "\n\n"), collapse_spaces), lambda q: q != "")


def split_interpretations(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != "")


def raw_interpretations(c: Column) -> Column:
    """Lines as they are; an empty cell has none."""
    none = F.array().cast("array<string>")
    return F.when(F.coalesce(F.length(c), F.lit(0)) > 0, F.split(strip(c), "\n")).otherwise(none)


def type_label(category: Column, ambig_type: Column) -> Column:
    """Corpus rule: a type only for ambiguous questions."""
    return F.when(category == "AA", strip(ambig_type))


def result_type(category: Column, ambig_type: Column) -> Column:
    """Result rule: the text ``null`` for unambiguous questions."""
    return F.when(category == "AU", "null").otherwise(ambig_type)


def type_or_unknown(ambig_type: Column) -> Column:
    return F.lower(F.coalesce(blank_to_null(ambig_type), F.lit("unknown")))


def lda_rows(train: bool) -> Column:
    """Rows for fitting (train split) or testing (all other splits) the type classifier."""
    in_train = F.col("split") == "train"
    return (F.col("question_type") == "ambig") & (F.col("ambig_type") != "unanswerable") & (
        in_train if train else ~in_train)


def question_with_suffix() -> Column:
    return F.when(F.col("ambig_type") == "attachment", F.concat("question", F.lit(" Show them in one table."))).otherwise(
        F.col("question"))


def first_rows(df: DataFrame, n: int | None) -> DataFrame:
    """The first n rows; no limit, and also a limit of 0, keeps all. A large n stays in as many partitions as it fills."""
    return df if not n else first_per_group(df, n, [], "row_idx")


def load_examples(
    raw: DataFrame, split: str, limit: int | None = None, exclude_u: bool = False, trim_split: bool = False,
    dataset: str | None = None,
) -> DataFrame:
    """Evaluation examples; ids number the rows of the whole file."""
    rows = complete(raw).filter(split_is(split, trim_split)).withColumn("category", derive_category())
    rows = rows.filter(F.col("category").isNotNull() & present("db_file_full"))
    if exclude_u:
        rows = rows.filter("category <> 'U'")
    return first_rows(rows, limit).select(
        F.concat(F.lit(split + "_"), F.col("row_idx").cast("string")).alias("example_id"),
        (F.lit(dataset) if dataset else F.lit(None).cast("string")).alias("dataset"), "row_idx", "split", "question",
        "question_type", "category", "ambig_type", strip(F.col("db_file_full")).alias("db_id"),
        first_nonblank("db_dump_processed", "db_dump").alias("db_dump"),
        F.coalesce(split_gold(F.col("gold_queries")), F.array().cast("array<string>")).alias("gold_queries"),
        raw_interpretations(F.col("nl_interpretations")).alias("interpretations"))


def load_corpus(raw: DataFrame, ambiguous_only: bool = False, check: bool = True) -> DataFrame:
    """Retrieval corpus: always the train split; an empty corpus is an error."""
    rows = complete(raw).filter(split_is("train") & present("question")).withColumns({
        "category": derive_category(), "db_dump": first_nonblank("db_dump_processed", "db_dump")})
    rows = rows.filter(F.col("category").isNotNull() & (F.col("db_dump") != ""))
    if ambiguous_only:
        rows = rows.filter("category = 'AA'")
    out = parse_gold_list(rows).select(
        F.col("row_idx").alias("vec_id"), strip(F.col("question")).alias("question"), "category",
        type_label(F.col("category"), F.col("ambig_type")).alias("ambig_type"), "db_dump", "gold_list",
        F.coalesce(split_interpretations(F.col("nl_interpretations")), F.array().cast("array<string>")).alias("interpretations"))
    if check and out.select("vec_id").isEmpty():
        raise ValueError("the corpus is empty")
    return out.withColumnRenamed("gold_list", "gold_queries")


def load_training(raw: DataFrame, split: str = "train", ambiguous_only: bool = True, types=None) -> DataFrame:
    """Training questions with interpretations; types lower-cased, blank ones ``unknown``."""
    rows = complete(raw).filter(split_is(split) & present("question", "nl_interpretations"))
    if ambiguous_only:
        rows = rows.filter(F.upper(strip(F.col("is_ambiguous"))) == "TRUE")
    out = rows.select(
        F.col("row_idx").alias("id"), strip(F.col("question")).alias("question"),
        first_nonblank("db_dump_processed").alias("db_dump"), derive_category("default").alias("category"),
        type_or_unknown(F.col("ambig_type")).alias("ambig_type"),
        split_interpretations(F.col("nl_interpretations")).alias("interpretations"))
    return out.filter(F.col("ambig_type").isin(*types)) if types else out


def _literal_udf():
    """List literals the JSON parser cannot read, by the standard library."""
    import ast
    import json

    def read(texts: pd.Series) -> pd.DataFrame:
        found, items = [], []
        for text in texts:
            value, ok = None, False
            for attempt in (ast.literal_eval, json.loads):
                try:
                    value, ok = attempt(text), text is not None
                    break
                except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
                    continue
            found.append(bool(ok and value))
            items.append([str(v) for v in value] if ok and isinstance(value, (list, tuple)) else [])
        return pd.DataFrame({"found": found, "items": items})

    return F.pandas_udf(read, T.StructType([
        T.StructField("found", T.BooleanType()), T.StructField("items", T.ArrayType(T.StringType()))]))


def parse_gold_list(df: DataFrame, ambig: str = "ambig_queries", gold: str = "gold_queries") -> DataFrame:
    """Adds ``gold_list`` from two text columns.

    The first column is a list literal or JSON; unreadable text gives nothing. If
    that leaves nothing, the second is a list when it opens with ``[`` (unreadable:
    the whole text), else statements separated by blank lines. JSON lists of strings,
    and lists in single quotes that hold neither double quotes nor backslashes, are read by
    built-in functions; only other literals (mixed quotes, numbers) go to one helper.
    """
    a, g = blank_to_null(F.col(ambig)), blank_to_null(F.col(gold))

    def plain(c: Column) -> Column:
        text = F.when(~c.contains("\\"), F.when(c.contains('"'), c).otherwise(F.translate(c, "'", '"')))
        items = F.try_variant_get(parse_json(text), "$", "array<variant>")
        return F.when(F.forall(items, lambda v: kind_of(v) == "STRING"), F.transform(
            items, lambda v: F.try_variant_get(v, "$", "string")))

    read = _literal_udf()
    none = F.array().cast("array<string>")
    out = df.withColumns({"_a": a, "_g": g}).withColumns({
        "_pa": plain(F.col("_a")), "_pg": plain(F.when(F.col("_g").startswith("["), F.col("_g")))})
    out = out.withColumns({
        "_ua": read(F.when(F.col("_pa").isNull(), F.col("_a"))),
        "_ug": read(F.when(F.col("_pg").isNull() & F.col("_g").startswith("["), F.col("_g")))})
    first_has = F.coalesce(F.size("_pa") > 0, F.lit(False)) | F.coalesce(F.col("_ua.found"), F.lit(False))
    first = F.coalesce("_pa", "_ua.items", none)
    blocks = F.filter(F.transform(F.split("_g", "\n\n"), strip), lambda q: q != "")
    second = (
        F.when(F.col("_g").isNull(), F.when(F.col("_a").isNull(), none).otherwise(first))
        .when(F.col("_g").startswith("["), F.coalesce(
            "_pg", F.when(F.col("_ug.found"), F.col("_ug.items")),
            F.when(F.regexp_replace("_g", r"\s", "").isin("[]"), none).otherwise(F.array("_g"))))
        .otherwise(F.when(F.size(blocks) > 0, blocks).otherwise(F.array("_g")))
    )
    return out.withColumn("gold_list", F.when(first_has, first).otherwise(second)).drop("_a", "_g", "_pa", "_pg", "_ua", "_ug")
