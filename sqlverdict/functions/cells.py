"""Result cells: raw and normalised values, and order-free fingerprints of results.

A cell is ``kind`` (null | num | str | bin), ``num`` and ``str``; for ``num``
cells ``str`` may carry the exact text of an integer beyond 2^53. A value is the
pair ``(n, x)``: a number, or a text, or neither (NULL). Equal values are equal
pairs. NaN equals nothing, so its ``x`` is made unique to the cell.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlverdict.functions.pytext import strip, strip_cell, stripped_to_float, to_float

EXACT, LONG = float(2**53), float(2**63)
BYTES_MARK = "\x00"

# Texts read as true and as false, and texts read as NULL.
TRUE_WORDS = ("1", "true", "yes", "t", "y")
FALSE_WORDS = ("0", "false", "no", "f", "n")
NULL_WORDS = ("null", "none", "")

KEYS = ("example_id", "side", "query_id")


def value(n: Column, x: Column) -> Column:
    return F.struct(n.alias("n"), x.alias("x"))


def _big(num: Column) -> Column:
    """Exact digits of integral doubles too large for exact comparison as doubles."""
    return F.when((F.abs(num) >= EXACT) & (F.abs(num) < LONG), num.try_cast("bigint").cast("string"))


def raw_value(kind: Column, num: Column, text: Column) -> Column:
    return value(
        F.when(kind == "num", num),
        F.when(kind == "str", text).when(kind == "num", F.coalesce(text, _big(num)))
        .when(kind == "bin", F.concat(F.lit(BYTES_MARK), text)),
    )


def norm_number(n: Column, x: Column) -> Column:
    return F.when(n.isNotNull(), n).otherwise(to_float(x))


def norm_text(n: Column, x: Column) -> Column:
    low = F.lower(strip(x))
    return F.when(
        n.isNotNull() | x.startswith(BYTES_MARK), x
    ).when(low.isin(*NULL_WORDS), F.lit(None)).otherwise(
        F.when(to_float(x).isNull(), low).otherwise(_big(to_float(x)))
    )


def norm_value(raw: Column) -> Column:
    """Numeric text becomes a number, null words become NULL, other text is lower-cased."""
    return value(norm_number(raw["n"], raw["x"]), norm_text(raw["n"], raw["x"]))


def number_of(n: Column, x: Column) -> Column:
    """The number in a raw value; text may carry ``%`` and ``,``."""
    return F.when(n.isNotNull(), n).otherwise(to_float(F.translate(strip(x), "%,", "")))


def bool_value(n: Column, x: Column) -> Column:
    """Words for true and false become 1 and 0; everything else stays raw."""
    low = strip(F.lower(x))
    text = n.isNull()
    none = F.lit(None).cast("string")
    return (
        F.when(text & low.isin(*TRUE_WORDS), value(F.lit(1.0), none))
        .when(text & low.isin(*FALSE_WORDS), value(F.lit(0.0), none))
        .otherwise(value(n, x))
    )


def same(an: Column, ax: Column, bn: Column, bx: Column) -> Column:
    return an.eqNullSafe(bn) & ax.eqNullSafe(bx)


def sort_key(v: Column) -> Column:
    """Mixed-type ordering: NULL, then numbers by value, then text."""
    rank = F.when(v["n"].isNotNull(), 1).when(v["x"].isNull(), 0).otherwise(2)
    return F.struct(rank.alias("rank"), v["n"].alias("num"), v["x"].alias("str"))


def normalize_row(values: Column) -> Column:
    """``norm_value`` over an array of raw values."""
    return F.transform(values, norm_value)


def sort_row(values: Column) -> Column:
    """An array of values in mixed-type order."""
    keyed = F.transform(values, lambda v: F.struct(sort_key(v).alias("k"), v.alias("v")))
    return F.transform(F.array_sort(keyed), lambda s: s["v"])


def with_values(cells: DataFrame) -> DataFrame:
    """Replaces kind, num and str by raw (``rn``, ``rx``) and normalised (``nn``, ``nx``) values.

    Built in steps, each naming what the next uses more than once, so that no
    text is trimmed or parsed twice.
    """
    here = F.concat_ws("|", "side", "query_id", "row_idx", "col_idx")
    keep = [c for c in cells.columns if c not in ("kind", "num", "str")]
    raw = raw_value(F.col("kind"), F.col("num"), F.col("str"))
    rn, rx, t, nn = (F.col(c) for c in ("rn", "rx", "t", "nn"))
    is_text = rn.isNull() & rx.isNotNull() & ~rx.startswith(BYTES_MARK)
    out = cells.select(*keep, raw["n"].alias("rn"), raw["x"].alias("rx"))
    out = out.select(*keep, rn, rx, F.when(is_text, F.lower(strip_cell(rx))).alias("t"))
    out = out.select(*keep, rn, rx, t, F.when(t.isNull(), rn).otherwise(stripped_to_float(t)).alias("nn"))
    text = (
        F.when(F.isnan(nn), here).when(t.isNull(), rx).when(nn.isNotNull(), _big(nn))
        .when(~t.isin(*NULL_WORDS), t)
    )
    return out.select(*keep, rn, F.when(F.isnan(rn), here).otherwise(rx).alias("rx"), nn, text.alias("nx"))


# --- fingerprints ---------------------------------------------------------
#
# A multiset is summarised by sums of hash slices over its members. The sums are
# partially aggregated on the map side, so a result of any size shrinks to one
# row before the shuffle, and equal multisets give equal sums. Two seeded 64-bit
# hashes are cut into 21-bit slices: six sums, 126 bits, no overflow below 2^42
# members.

_SEEDS = (101, 211)
_SLICES = 3 * len(_SEEDS)


def _hashes(name: str, *parts: Column) -> list[Column]:
    return [F.xxhash64(F.lit(seed), *parts).alias(f"{name}_h{i}") for i, seed in enumerate(_SEEDS)]


def _member_sums(name: str) -> list[Column]:
    """Sums over the slices of the hash columns made by ``_hashes``."""
    mask = F.lit((1 << 21) - 1)
    slices = []
    for i in range(len(_SEEDS)):
        h = F.col(f"{name}_h{i}")
        slices += [h.bitwiseAND(mask), F.shiftright(h, 21).bitwiseAND(mask), F.shiftrightunsigned(h, 42)]
    return [F.sum(s).alias(f"{name}_{i}") for i, s in enumerate(slices)]


def _columns(name: str) -> list[Column]:
    return [F.col(f"{name}_{i}") for i in range(_SLICES)]


def _carry(name: str) -> list[Column]:
    return [F.sum(c).alias(f"{name}_{i}") for i, c in enumerate(_columns(name))]


def profile_results(
    valued: DataFrame, prints: Sequence[str], keys: Sequence[str] = KEYS
) -> DataFrame:
    """One row per result: shape, ``odd`` and the requested fingerprints.

    ``bag``         raw cells, order and structure ignored
    ``row_bags``    rows by position, cell order inside a row ignored (raw)
    ``raw_cells``   rows by position, cells by position (raw)
    ``norm_cells``  rows by position, cells by position (normalised)
    ``norm_rows``   rows in any order, cells by position (normalised)

    ``norm_rows`` first sums up the cells of each row, then the rows; the others then follow from the
    same rows. Without it all take one aggregation, whose groups are results and not rows. Prints are
    compared with prints of the same call only. ``odd`` counts cells whose number may not be finite.
    """
    raw, norm = (F.col("rn"), F.col("rx")), (F.col("nn"), F.col("nx"))
    row, col = F.col("row_idx"), F.col("col_idx")
    by_row = {  # print -> (sums over the cells of a row, does the row's place count)
        "row_bags": ("rb", True), "raw_cells": ("rc", True), "norm_cells": ("nc", True), "norm_rows": ("nc", False),
    }
    if "norm_rows" not in prints:
        return _profile_cells(valued, prints, keys)
    by_row = {p: how for p, how in by_row.items() if p in prints}
    members = {"rb": raw, "rc": (col, *raw), "nc": (col, *norm)}
    used = {s for s, _ in by_row.values()} | ({"rb"} if "bag" in prints else set())
    members = {m: parts for m, parts in members.items() if m in used}
    want_odd = "norm_cells" in prints
    hashed = valued.select(
        *keys, row, col, *([_odd().alias("is_odd")] if want_odd else []),
        *[h for m, parts in members.items() for h in _hashes(m, *parts)],
    )
    sums = [s for m in members for s in _member_sums(m)]
    shape = [(F.max(row) + 1).cast("bigint").alias("n_rows")]
    odd_count = [F.count_if("is_odd").alias("odd")] if want_odd else []
    rows = hashed.groupBy(*keys, "row_idx").agg((F.max(col) + 1).alias("n_cols"), *odd_count, *sums)
    again = rows.select(
        *keys, row, "n_cols", *(["odd"] if want_odd else []), *(_columns("rb") if "bag" in prints else []),
        *[h for p, (m, placed) in by_row.items() for h in _hashes(p, *([row] if placed else []), *_columns(m))],
    )
    out = again.groupBy(*keys).agg(
        *shape, F.max("n_cols").alias("n_cols"), *([F.sum("odd").alias("odd")] if want_odd else []),
        *(_carry("rb") if "bag" in prints else []), *[s for p in by_row for s in _member_sums(p)],
    )
    bag = [F.array(*_columns("rb")).alias("bag")] if "bag" in prints else []
    return out.select(
        *keys, "n_rows", F.col("n_cols").cast("int").alias("n_cols"), *(["odd"] if want_odd else []), *bag,
        *[F.array(*_columns(p)).alias(p) for p in by_row],
    )


def _odd() -> Column:
    return (
        F.isnan("nn") | (F.abs("nn") == float("inf"))
        | (F.col("nn").isNull() & (F.col("nx").contains("nan") | F.col("nx").contains("inf")
                                   | (F.length("nx") > 300) | F.col("nx").rlike(r"e[+]?[0-9_]{3}")))
    )


def _profile_cells(valued: DataFrame, prints: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Fingerprints as multisets of cells with their places, in one aggregation: a task holds results, no rows."""
    raw, norm = (F.col("rn"), F.col("rx")), (F.col("nn"), F.col("nx"))
    row, col = F.col("row_idx"), F.col("col_idx")
    members = {"bag": raw, "row_bags": (row, *raw), "raw_cells": (row, col, *raw), "norm_cells": (row, col, *norm)}
    members = {p: parts for p, parts in members.items() if p in prints}
    odd = [_odd().alias("is_odd")] if "norm_cells" in members else []
    hashed = valued.select(*keys, row, col, *odd, *[h for p, parts in members.items() for h in _hashes(p, *parts)])
    out = hashed.groupBy(*keys).agg(
        (F.max(row) + 1).cast("bigint").alias("n_rows"), (F.max(col) + 1).cast("int").alias("n_cols"),
        *([F.count_if("is_odd").alias("odd")] if odd else []), *[s for p in members for s in _member_sums(p)])
    return out.select(*keys, "n_rows", "n_cols", *(["odd"] if odd else []), *[F.array(*_columns(p)).alias(p) for p in members])


def column_prints(valued: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """``print`` of each column of each result: its normalised cells by row. Equal for equal columns."""
    hashed = valued.select(*keys, "col_idx", *_hashes("cp", F.col("row_idx"), F.col("nn"), F.col("nx")))
    return hashed.groupBy(*keys, "col_idx").agg(*_member_sums("cp")).select(*keys, "col_idx", F.array(*_columns("cp")).alias("print"))
