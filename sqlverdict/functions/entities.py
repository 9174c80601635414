"""Tables and columns named in dumps and in statements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that define what counts as a table or a column name.
CREATE_TABLE = r"""(?isU)CREATE TABLE (?:IF NOT EXISTS )?["']?(\w+)["']?\s*\((.*?)\);"""
TYPED_COLUMN = (
    r"""(?iU)["']?(\w+)["']?\s+(?:INTEGER|TEXT|REAL|BLOB|NUMERIC|VARCHAR|CHAR|INT"""
    r"""|FLOAT|DOUBLE|BOOLEAN|DATE|DATETIME|TIMESTAMP)"""
)
FROM_TABLE = r"""(?dU)from\s+["']?(\w+)["']?(?:\s+(?:as\s+)?["']?\w+["']?)?"""
JOIN_TABLE = r"""(?dU)join\s+["']?(\w+)["']?(?:\s+(?:as\s+)?["']?\w+["']?)?"""
COLUMN_PLACES = (
    r"(?dU)\b(\w+)\s*[=<>!]|\bselect\s+(?:distinct\s+)?(.+?)\s+from"
    r"|\bgroup\s+by\s+(.+?)(?:\s+having|\s+order|\s+limit|$)"
    r"|\border\s+by\s+(.+?)(?:\s+limit|$)"
)
# Words never taken for columns, and words left out when columns are judged.
NOT_COLUMNS = ("as", "distinct", "from", "where", "and", "or")
SQL_WORDS = (
    "select", "from", "where", "join", "on", "group", "order", "by", "having", "limit", "count", "sum", "avg",
    "max", "min", "desc", "asc", "distinct", "as", "and", "or", "not", "in", "like", "between", "case", "when",
    "then", "else", "end",
)


def schema_tables(dump: Column) -> Column:
    """Array of (table, columns) from the create statements of a dump, in lower case."""
    names = F.regexp_extract_all(dump, F.lit(CREATE_TABLE), 1)
    bodies = F.regexp_extract_all(dump, F.lit(CREATE_TABLE), 2)
    return F.transform(F.arrays_zip(names.alias("n"), bodies.alias("b")), lambda t: F.struct(
        F.lower(t["n"]).alias("table"),
        F.array_distinct(F.transform(F.regexp_extract_all(t["b"], F.lit(TYPED_COLUMN), 1), F.lower)).alias("columns")))


def statement_tables(sql: Column) -> Column:
    low = F.lower(sql)
    return F.array_distinct(F.concat(
        F.regexp_extract_all(low, F.lit(FROM_TABLE), 1), F.regexp_extract_all(low, F.lit(JOIN_TABLE), 1)))


def statement_columns(sql: Column) -> Column:
    """Column-like words: before comparisons, in select lists, group by and order by.

    Parts with parentheses are skipped and qualifiers dropped.
    """
    low = F.lower(sql)
    found = F.concat(*[F.regexp_extract_all(low, F.lit(COLUMN_PLACES), g) for g in (1, 2, 3, 4)])
    parts = F.flatten(F.transform(F.filter(found, lambda g: g != ""), lambda g: F.split(F.trim(g), r"(?U)[,\s]+")))
    plain = F.filter(parts, lambda p: ~p.contains("(") & ~p.contains(")"))
    named = F.transform(plain, lambda p: F.regexp_replace(
        F.when(p.contains("."), F.get(F.split(p, r"\."), 1)).otherwise(p), r"(?U)[^\w]", ""))
    return F.array_distinct(F.filter(named, lambda w: (w != "") & ~w.isin(*NOT_COLUMNS)))
