"""Bulk comparison of gold and predicted result tables.

Inputs are ``pairs(example_id, pred_id, gold_id, ordered[, similarity])`` and
``cells`` in the RESULT_CELLS layout; every rule is decided for all pairs at
once. Whole-result rules compare fingerprints (see functions/cells.py), so only
pairs they cannot settle ever touch cells again, through equi-joins on position.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sqlverdict.functions.cells import (
    bool_value, column_prints, number_of, profile_results, same, with_values,
)
from sqlverdict.session import cut_lineage

PAIR = ("example_id", "pred_id", "gold_id")
# Rows of a result that meet their pairs in one join partition.
ROW_BLOCK = 4096
BROADCAST_PAIRS = 100_000
PRINTS = ("bag", "raw_cells", "norm_cells", "row_bags", "norm_rows")
STRICT_PRINTS = ("bag", "raw_cells", "row_bags")


def pair_up(runs: DataFrame) -> DataFrame:
    """Gold x predicted statements of one example; failed statements are never compared."""
    ok = runs.filter("ok")
    gold = ok.filter("side = 'gold'").select(
        "example_id", F.col("query_id").alias("gold_id"), "ordered"
    )
    pred = ok.filter("side = 'pred'").select(
        "example_id", F.col("query_id").alias("pred_id"),
        *([F.col("similarity")] if "similarity" in runs.columns else []),
    )
    return gold.join(pred, "example_id")


def _side(profiles: DataFrame, side: str, id_name: str, prefix: str) -> DataFrame:
    keep = [c for c in profiles.columns if c not in ("example_id", "side", "query_id")]
    return profiles.filter(F.col("side") == side).select(
        "example_id", F.col("query_id").alias(id_name), *[F.col(c).alias(prefix + c) for c in keep]
    )


def stored_profiles(cells: DataFrame, prints=PRINTS) -> DataFrame:
    """All fingerprints of all results from one pass over the cells, checkpointed.

    One narrow row per result; every whole-result rule can then share it.
    """
    return cut_lineage(profile_results(with_values(cells), prints))


def with_profiles(pairs: DataFrame, valued: DataFrame, prints, profiles: DataFrame | None = None) -> DataFrame:
    """Pairs with shapes and fingerprints of both results (``p_`` and ``g_`` columns).

    Both sides come from one pass over the cells: the profiles, one narrow row per
    result, are checkpointed before they are joined twice.
    """
    profiles = cut_lineage(profile_results(valued, prints)) if profiles is None else profiles
    out = pairs.join(_side(profiles, "pred", "pred_id", "p_"), ["example_id", "pred_id"], "left").join(
        _side(profiles, "gold", "gold_id", "g_"), ["example_id", "gold_id"], "left"
    )
    zero = ["p_n_rows", "g_n_rows", "p_n_cols", "g_n_cols"]
    return out.fillna(0, zero + [c for c in ("p_odd", "g_odd") if c in out.columns])


def _both_empty() -> Column:
    return (F.col("p_n_rows") == 0) & (F.col("g_n_rows") == 0)


def _one_empty() -> Column:
    return (F.col("p_n_rows") == 0) | (F.col("g_n_rows") == 0)


def _same_rows() -> Column:
    return F.col("p_n_rows") == F.col("g_n_rows")


def _same_shape() -> Column:
    return _same_rows() & (F.col("p_n_cols") == F.col("g_n_cols"))


def _equal_print(name: str) -> Column:
    return F.coalesce(F.col("p_" + name) == F.col("g_" + name), F.lit(False))


def _bag_equal() -> Column:
    return (
        F.when(_both_empty(), True).when(_one_empty(), False)
        .otherwise(_equal_print("bag"))
    )


def _rows_equal() -> Column:
    return (
        F.when(_both_empty(), True).when(_one_empty(), False)
        .otherwise(_same_shape() & _equal_print("row_bags"))
    )


def _norm_equal(ordered: Column) -> Column:
    equal = F.when(ordered, _equal_print("norm_cells")).otherwise(
        _equal_print("norm_rows")
    )
    return F.when(_both_empty(), True).otherwise(_same_shape() & equal)


def match_unordered(pairs: DataFrame, cells: DataFrame, exact: bool = False) -> DataFrame:
    """Strict rule without order: equal multisets of raw cells. Adds ``strict``.

    Here and in the other rules over fingerprints, ``exact`` confirms matches from the values.
    """
    return _decided(pairs, cells, "strict", _bag_equal(), {"bag": F.lit(True)}, exact)


def match_ordered(pairs: DataFrame, cells: DataFrame, exact: bool = False) -> DataFrame:
    """Strict rule with order: row by row equal bags of raw cells. Adds ``strict``."""
    return _decided(pairs, cells, "strict", _rows_equal(), {"row_bags": F.lit(True)}, exact)


def match_strict(pairs: DataFrame, cells: DataFrame, exact: bool = False) -> DataFrame:
    """Ordered rule where the gold statement is ordered, else the unordered one."""
    ordered = F.col("ordered")
    return _decided(pairs, cells, "strict", F.when(ordered, _rows_equal()).otherwise(_bag_equal()),
                    {"row_bags": ordered, "bag": ~_true(ordered)}, exact)


def match_normalized(pairs: DataFrame, cells: DataFrame, exact: bool = False) -> DataFrame:
    """Normalised rows equal: in order, or as a multiset of rows. Adds ``normalized``."""
    ordered = F.col("ordered")
    return _decided(pairs, cells, "normalized", _norm_equal(ordered), {"norm_cells": ordered, "norm_rows": ~_true(ordered)}, exact)


def _true(flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False))


def _decided(pairs: DataFrame, cells: DataFrame, name: str, equal: Column, rules: dict[str, Column], exact: bool) -> DataFrame:
    """Pairs with ``name``: whether the fingerprints ``rules``, each for the pairs of its condition, are equal."""
    valued = with_values(cells)
    out = with_profiles(pairs, valued, list(rules)).withColumn(name, equal)
    if not exact:
        return out.select(*pairs.columns, name)
    out = cut_lineage(out.select(*pairs.columns, name, "p_n_rows", "g_n_rows"))
    wrong = [unequal(out.filter(F.col(name) & _true(where)), valued, rule) for rule, where in rules.items()]
    wrong = reduce(DataFrame.unionByName, wrong).withColumn("_wrong", F.lit(True))
    return out.join(wrong, list(PAIR), "left").withColumn(name, F.col(name) & F.col("_wrong").isNull()).select(*pairs.columns, name)


# What two results must hold equally often to be equal under a fingerprint.
MEMBERS = {
    "bag": ["rn", "rx"], "row_bags": ["row_idx", "rn", "rx"], "raw_cells": ["row_idx", "col_idx", "rn", "rx"],
    "norm_cells": ["row_idx", "col_idx", "nn", "nx"], "norm_rows": ["whole"],
}


def unequal(pairs: DataFrame, valued: DataFrame, rule: str) -> DataFrame:
    """Of pairs with equal fingerprints under ``rule``, those whose values differ: exact counts, no hashes.

    Members of a result are counted before they meet the pairs, and only results of the given pairs are read.
    """
    members = MEMBERS[rule]
    if rule == "norm_rows":  # one row of a result is as wide as its columns, however many rows there are
        row = F.array_sort(F.collect_list(F.struct("col_idx", "nn", "nx")))
        valued = valued.groupBy("example_id", "side", "query_id", "row_idx").agg(row.alias("whole"))
    block = F.floor(F.col("row_idx") / ROW_BLOCK)
    slim = valued.groupBy("example_id", "side", "query_id", block.alias("_b"), *members).agg(F.count("*").alias("d"))
    if "row_idx" not in members:
        slim = slim.withColumn("row_idx", F.col("_b") * ROW_BLOCK)
    slim = slim.drop("_b")
    signed = _attach(slim, pairs, "pred").unionByName(_attach(slim.withColumn("d", -F.col("d")), pairs, "gold"))
    gaps = signed.groupBy(*PAIR, *members).agg(F.sum("d").alias("d"))
    return gaps.filter("d <> 0").select(*PAIR).distinct()


def confirm_bags(pairs: DataFrame, cells: DataFrame) -> DataFrame:
    """The unordered rule by exact value counts, with no hashing. Adds ``exact``.

    Costs a shuffle of all distinct cells; an independent check of the
    fingerprint answer.
    """
    gaps = _count_gaps(pairs, with_values(cells), "rn", "rx")
    exact = gaps.groupBy(*PAIR).agg(F.bool_and(F.col("d") == 0).alias("exact"))
    return pairs.join(exact, list(PAIR), "left").withColumn("exact", F.coalesce("exact", F.lit(True)))


def _count_gaps(pairs: DataFrame, valued: DataFrame, n: str, x: str) -> DataFrame:
    """Per pair and value: occurrences in pred minus occurrences in gold."""
    slim = valued.select("example_id", "side", "query_id", "row_idx", n, x)
    signed = _attach(slim, pairs, "pred").withColumn("d", F.lit(1)).unionByName(
        _attach(slim, pairs, "gold").withColumn("d", F.lit(-1))
    )
    return signed.groupBy(*PAIR, n, x).agg(F.sum("d").alias("d"))


# --- positional rules -----------------------------------------------------


def _attach(valued: DataFrame, pairs: DataFrame, side: str, carry=(), small: bool = False) -> DataFrame:
    """Cells of one side, once per pair that needs them.

    ``small`` says the pairs were counted and may be broadcast, so cells stay where
    they are. Otherwise a result is joined in blocks of ``ROW_BLOCK`` rows, as many as it
    has, so one that holds a large share of all cells is spread in proportion to its size.
    Pairs without row counts are joined whole, where the adaptive skew join splits them.
    """
    id_name = "pred_id" if side == "pred" else "gold_id"
    want = pairs.select(*PAIR, *carry)
    mine = valued.filter(F.col("side") == side).drop("side").withColumnRenamed("query_id", id_name)
    if small:
        return mine.join(F.broadcast(want), ["example_id", id_name])
    rows = side[0] + "_n_rows"
    if rows not in pairs.columns:
        return mine.join(want, ["example_id", id_name])
    last = F.floor(F.greatest(F.col(rows) - 1, F.lit(0)) / ROW_BLOCK)
    want = pairs.select(*PAIR, *carry, F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("_block"))
    mine = mine.withColumn("_block", F.floor(F.col("row_idx") / ROW_BLOCK))
    return mine.join(want, ["example_id", id_name, "_block"]).drop("_block")


def _load_of(todo: DataFrame) -> int:
    """Rows of a checkpointed pair table, counted no further than the broadcast bound."""
    return todo.select(F.lit(1)).limit(BROADCAST_PAIRS + 1).count()


def _aligned(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """Cells at equal positions side by side."""
    def named(df: DataFrame, prefix: str) -> DataFrame:
        return df.select(
            *PAIR, "row_idx", "col_idx", *[F.col(c).alias(prefix + c) for c in ("rn", "rx", "nn", "nx")]
        )

    return named(pred, "p").join(named(gold, "g"), [*PAIR, "row_idx", "col_idx"])


def _norm_same() -> Column:
    return same(F.col("pnn"), F.col("pnx"), F.col("gnn"), F.col("gnx"))


def _percentage_cell(a: Column, b: Column) -> Column:
    ratio = F.try_divide(a, b)
    # One percent around a ratio of 1, 100 and 1/100.
    near = (
        ((ratio > 0.99) & (ratio < 1.01)) | ((ratio > 99.0) & (ratio < 101.0))
        | ((ratio > 0.0099) & (ratio < 0.0101))
    )
    return F.when(a.isNull() | b.isNull(), _norm_same()).when(b != 0.0, near).otherwise(a == 0.0)


def _boolean_cell() -> Column:
    return bool_value(F.col("prn"), F.col("prx")).eqNullSafe(bool_value(F.col("grn"), F.col("grx")))


def _tolerance_cell(tolerance: float) -> Column:
    gap = F.abs(F.col("pnn") - F.col("gnn"))
    return F.when(gap.isNotNull(), F.isnan(gap) | (gap <= tolerance)).otherwise(_norm_same())


def _positional(pred: DataFrame, gold: DataFrame, tolerance: float) -> DataFrame:
    """One row per pair: do all aligned cells agree under each positional rule."""
    both = _aligned(pred, gold).withColumns({
        "pnum": number_of(F.col("prn"), F.col("prx")), "gnum": number_of(F.col("grn"), F.col("grx")),
    })
    return both.select(
        *PAIR, _percentage_cell(F.col("pnum"), F.col("gnum")).alias("pct"), _boolean_cell().alias("bool"),
        _tolerance_cell(tolerance).alias("tol"), _norm_same().alias("same"),
    ).groupBy(*PAIR).agg(*[F.bool_and(c).alias(c) for c in ("pct", "bool", "tol", "same")])


def match_positional(pairs: DataFrame, cells: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Adds ``pct``, ``bool`` and ``tol``: percentage, boolean and tolerance rules."""
    valued = with_values(cells)
    shaped = with_profiles(pairs, valued, [])
    todo = shaped.filter(_same_shape() & (F.col("p_n_rows") > 0))
    flags = _positional(_attach(valued, todo, "pred"), _attach(valued, todo, "gold"), tolerance).drop("same")
    base = shaped.select(*pairs.columns, _both_empty().alias("_empty"))
    return base.join(flags, list(PAIR), "left").select(
        *pairs.columns, *[F.coalesce(c, "_empty").alias(c) for c in ("pct", "bool", "tol")]
    )


def match_semantic(pairs: DataFrame, cells: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Adds ``semantic``: any of the three positional rules, from one join."""
    return match_positional(pairs, cells, tolerance).select(
        *pairs.columns, (F.col("pct") | F.col("bool") | F.col("tol")).alias("semantic")
    )


# --- column mapping -------------------------------------------------------


def _column_scores(wide: DataFrame, narrow: DataFrame) -> DataFrame:
    """Per pair and column pair, how many rows hold equal normalised cells."""
    w = wide.select(*PAIR, "row_idx", F.col("col_idx").alias("w"), "nn", "nx").alias("a")
    n = narrow.select(*PAIR, "row_idx", F.col("col_idx").alias("n"), "nn", "nx").alias("b")
    at = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (*PAIR, "row_idx")]
    equal = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("nn", "nx")]
    return (
        w.join(n, [*at, *equal]).select(*[F.col(f"a.{c}") for c in PAIR], "w", "n")
        .groupBy(*PAIR, "w", "n").agg(F.count("*").alias("hits"))
    )


def best_assignment(grid: np.ndarray) -> tuple[int, list[int]]:
    """Highest sum of one cell per column of ``grid`` from different rows, and the row of each column.

    Of equal sums the set of rows that comes first in lexicographic order wins, then the first
    order of that set. Both are ranks of exact integers below the sum, so one solution of the
    assignment problem decides them at any width.
    """
    w, n = grid.shape
    places = w ** n  # orders of chosen rows, as digits of base w
    sets = places << w  # sets of chosen rows, as bits, the first row highest
    cost = [[-(int(grid[r, c]) * sets + ((1 << (w - 1 - r)) * places) + (w - 1 - r) * w ** (n - 1 - c)) for r in range(w)] for c in range(n)]
    # Shortest augmenting paths over potentials, one column of the grid at a time.
    high, low, owner = [0] * (n + 1), [0] * (w + 1), [0] * (w + 1)
    for c in range(1, n + 1):
        owner[0], at = c, 0
        slack, via, seen = [None] * (w + 1), [0] * (w + 1), [False] * (w + 1)
        while owner[at]:
            seen[at] = True
            row, step, nearest = owner[at], None, 0
            for r in range(1, w + 1):
                if seen[r]:
                    continue
                gap = cost[row - 1][r - 1] - high[row] - low[r]
                if slack[r] is None or gap < slack[r]:
                    slack[r], via[r] = gap, at
                if step is None or slack[r] < step:
                    step, nearest = slack[r], r
            for r in range(w + 1):
                if seen[r]:
                    high[owner[r]] += step
                    low[r] -= step
                elif slack[r] is not None:
                    slack[r] -= step
            at = nearest
        while at:
            owner[at], at = owner[via[at]], via[at]
    chosen = [0] * n
    for r in range(1, w + 1):
        if owner[r]:
            chosen[owner[r] - 1] = r - 1
    return int(sum(grid[r, c] for c, r in enumerate(chosen))), chosen


def _best_map_udf():
    """Best injective column map per pair from its grid of column scores; the grid is one row of bounded width."""

    def best_map(n_wide: pd.Series, n_narrow: pd.Series, hits: pd.Series) -> pd.DataFrame:
        scores, maps = [], []
        for w, n, cells in zip(n_wide, n_narrow, hits):
            grid = np.zeros((w, n), dtype=np.int64)
            for cell in cells:
                grid[cell["w"], cell["n"]] = cell["hits"]
            score, mapping = best_assignment(grid)
            scores.append(score)
            maps.append(np.array(mapping, dtype=np.int32))
        return pd.DataFrame({"score": scores, "mapping": maps})

    out = T.StructType([
        T.StructField("score", T.LongType()), T.StructField("mapping", T.ArrayType(T.IntegerType())),
    ])
    return F.pandas_udf(best_map, out)


def _best_maps(todo: DataFrame, hits: DataFrame) -> DataFrame:
    """Best map of each pair from ``hits(PAIR, w, n, hits)``; a list of them holds at most one entry per pair of columns."""
    grids = hits.groupBy(*PAIR).agg(F.collect_list(F.struct("w", "n", "hits")).alias("hits"))
    best = todo.select(*PAIR, "n_wide", "n_narrow", "n").join(grids, list(PAIR)).withColumn(
        "best", _best_map_udf()("n_wide", "n_narrow", "hits"))
    return best.select(*PAIR, "n", "n_narrow", "best.score", "best.mapping")


def _equal_columns(todo: DataFrame, valued: DataFrame) -> DataFrame:
    """``(PAIR, w, n, hits)`` of columns whose fingerprints are equal, for pairs of equally many rows."""
    prints = column_prints(valued)
    sides = [prints.filter(F.col("side") == side).select("example_id", F.col("query_id").alias(f"{side}_id"), F.col("col_idx").alias(f"{side}_col"), "print")
             for side in ("pred", "gold")]
    want = todo.filter(_same_rows()).select(*PAIR, "pred_wide", "n")
    both = want.join(sides[0], ["example_id", "pred_id"]).join(sides[1], ["example_id", "gold_id", "print"])
    return both.select(
        *PAIR, F.when(F.col("pred_wide"), F.col("pred_col")).otherwise(F.col("gold_col")).cast("int").alias("w"),
        F.when(F.col("pred_wide"), F.col("gold_col")).otherwise(F.col("pred_col")).cast("int").alias("n"), F.col("n").alias("hits"))


def _map_columns(todo: DataFrame, valued: DataFrame, min_share: float, small: bool = False) -> DataFrame:
    """``mapping[j]`` is the wide column for narrow column j; no row without a good map.

    ``todo`` carries shapes, ``pred_wide``, ``n_wide``, ``n_narrow`` and ``n``, the row count. A map where every
    narrow column has an equal wide one scores as high as any can, so it is found from the fingerprints of
    columns alone, the same choice among equal columns included. Only other pairs join their cells.
    """
    full = F.col("score") == F.col("n") * F.col("n_narrow")
    equal = _equal_columns(todo, valued)
    whole = equal.groupBy(*PAIR).agg(F.count_distinct("n").alias("met")).join(todo.select(*PAIR, "n_narrow"), list(PAIR)).filter("met = n_narrow")
    maps = cut_lineage(_best_maps(todo, equal.join(whole.select(*PAIR), list(PAIR), "left_semi")).filter(full))
    rest = todo.join(maps, list(PAIR), "left_anti")
    if not rest.isEmpty():
        rest = cut_lineage(rest)
        cells = {side: _attach(valued, rest, side, ["pred_wide"], small) for side in ("pred", "gold")}
        wide = cells["pred"].filter("pred_wide").unionByName(cells["gold"].filter("NOT pred_wide"), True)
        narrow = cells["gold"].filter("pred_wide").unionByName(cells["pred"].filter("NOT pred_wide"), True)
        maps = maps.unionByName(_best_maps(rest, _column_scores(wide, narrow)))
    return maps.filter((F.col("score") > 0) & (F.col("score") >= F.col("n") * F.col("n_narrow") * min_share)).select(
        *PAIR, "score", "mapping", full.alias("full"))


def column_mapping(
    pairs: DataFrame, cells: DataFrame, max_pred: int | None = None, max_gold: int | None = None, min_share: float = 0.5
) -> DataFrame:
    """Best map of predicted onto gold columns, of any width: one row per gold column.

    Pairs below ``min_share`` of equal cells, or outside the width bounds if any are
    set, have no rows. Rows are aligned by position up to the shorter result.
    """
    valued = with_values(cells)
    todo = _mappable(with_profiles(pairs, valued, []), max_pred, max_gold).withColumn("pred_wide", F.lit(True))
    maps = _map_columns(todo, valued, min_share)
    return maps.select(*PAIR, "score", F.posexplode("mapping").alias("gold_col", "pred_col"))


def _within(column: str, bound: int | None) -> Column:
    return F.lit(True) if bound is None else F.col(column) <= bound


def _mappable(shaped: DataFrame, max_pred: int | None, max_gold: int | None) -> DataFrame:
    return shaped.filter(
        (F.col("p_n_rows") > 0) & (F.col("g_n_rows") > 0) & (F.col("p_n_cols") >= F.col("g_n_cols"))
        & _within("p_n_cols", max_pred) & _within("g_n_cols", max_gold)
    ).withColumns({
        "n_wide": F.col("p_n_cols"), "n_narrow": F.col("g_n_cols"), "n": F.col("p_n_rows"),
    })


def project_columns(cells: DataFrame, mapping: DataFrame) -> DataFrame:
    """Keep and reorder columns of predicted results.

    ``mapping(example_id, pred_id, gold_id, gold_col, pred_col)``; the result has
    one projected copy per pair, with ``gold_id`` added.
    """
    want = mapping.select(*PAIR, "gold_col", F.col("pred_col").alias("col_idx"))
    mine = cells.filter("side = 'pred'").withColumnRenamed("query_id", "pred_id")
    return mine.join(want, ["example_id", "pred_id", "col_idx"]).drop("col_idx").withColumnsRenamed(
        {"gold_col": "col_idx", "pred_id": "query_id"}
    )


# --- containment ----------------------------------------------------------


def match_subset(pairs: DataFrame, cells: DataFrame) -> DataFrame:
    """Adds ``subset``: the multiset of normalised gold cells is contained in pred's."""
    return pairs.join(_subset(pairs, with_values(cells)), list(PAIR), "left").withColumn(
        "subset", F.coalesce("subset", F.lit(True))
    )


def _subset(pairs: DataFrame, valued: DataFrame) -> DataFrame:
    gaps = _count_gaps(pairs, valued, "nn", "nx")
    return gaps.groupBy(*PAIR).agg(F.bool_and(F.col("d") >= 0).alias("subset"))


# --- flexible cascade -----------------------------------------------------


def match_flex(
    pairs: DataFrame, cells: DataFrame, min_similarity: float = 0.7, tolerance: float = 0.01,
    max_wide: int | None = None, max_narrow: int | None = None, min_share: float = 0.5, profiles: DataFrame | None = None,
) -> DataFrame:
    """Adds ``strict``, ``flex`` and ``rule`` (the first rule that held).

    Pairs settled by one stage do not enter the next, and a stage without pairs is
    left out. The per-pair state (one narrow row per pair) is checkpointed between
    stages, so that no stage repeats the cell work of an earlier one. ``profiles``
    are fingerprints already made by ``stored_profiles``.
    """
    valued = with_values(cells)
    has_similarity = "similarity" in pairs.columns
    key = list(PAIR)

    # Stage 0: shapes and fingerprints.
    shaped = with_profiles(pairs, valued, ["bag", "row_bags", "norm_cells", "norm_rows"], profiles)
    plain = (F.col("p_odd") == 0) & (F.col("g_odd") == 0)
    identical = _same_shape() & _equal_print("norm_cells")
    state = cut_lineage(shaped.select(
        *pairs.columns, "p_n_rows", "g_n_rows", "p_n_cols", "g_n_cols",
        F.when(F.col("ordered"), _rows_equal()).otherwise(_bag_equal()).alias("strict"),
        _norm_equal(F.col("ordered")).alias("normalized"), plain.alias("plain"),
        F.when(_both_empty(), "empty").when(_one_empty(), "none")
        .when(identical & plain, "percentage").alias("rule"),
    ))

    # The cells of open pairs are parsed and written once; later stages read no others.
    contained = F.lit(False)
    if has_similarity:
        contained = ~F.col("ordered") & F.coalesce(F.col("similarity") > min_similarity, F.lit(False))
    unsettled = state.filter(F.col("rule").isNull() & (_same_rows() | contained))
    if not _load_of(unsettled):
        rule = F.coalesce("rule", F.when(F.col("strict"), "strict").otherwise("none"))
        return state.select(*pairs.columns, "strict", (rule != "none").alias("flex"), rule.alias("rule"))
    results = unsettled.select("example_id", F.explode(F.array(*[
        F.struct(F.lit(side).alias("side"), F.col(f"{side}_id").alias("query_id")) for side in ("pred", "gold")])).alias("r"))
    valued = cut_lineage(valued.join(results.select("example_id", "r.*").distinct(), ["example_id", "side", "query_id"], "left_semi"))

    # Stage 1: positional rules and normalised rows on equal shapes.
    todo = state.filter(F.col("rule").isNull() & _same_shape())
    if load := _load_of(todo):
        small = load <= BROADCAST_PAIRS
        flags = _positional(
            _attach(valued, todo, "pred", small=small), _attach(valued, todo, "gold", small=small), tolerance)
        state = cut_lineage(_settle(state.join(flags, key, "left"), F.when(
            _same_shape(),
            F.when(F.col("pct"), "percentage").when(F.col("bool"), "boolean").when(F.col("tol"), "tolerance")
            .when(F.col("normalized"), "normalized"),
        )).drop("pct", "bool", "tol", "same"))
    state = state.drop("normalized")

    # Stage 2: column maps, wide side onto narrow side, equal row counts only.
    wide_pred = F.col("p_n_cols") >= F.col("g_n_cols")
    prefix = F.when(_same_shape(), "mapped+").when(wide_pred, "wide+").otherwise("narrow+")
    todo = state.filter(F.col("rule").isNull() & _same_rows()).withColumns({
        "n_wide": F.greatest("p_n_cols", "g_n_cols"), "n_narrow": F.least("p_n_cols", "g_n_cols"),
        "n": F.col("p_n_rows"), "pred_wide": wide_pred,
    }).filter(_within("n_wide", max_wide) & _within("n_narrow", max_narrow))
    if load := _load_of(todo):
        maps = _map_columns(todo, valued, min_share, load <= BROADCAST_PAIRS).drop("score")
        identity = _same_shape() & (F.col("mapping") == F.sequence(F.lit(0), F.size("mapping") - 1))
        state = cut_lineage(_settle(
            state.join(maps, key, "left")
            .withColumn("mapping", F.when(~F.coalesce(identity, F.lit(False)), F.col("mapping"))),
            F.when(F.col("mapping").isNotNull() & F.col("full") & F.col("plain"),
                   F.concat(prefix, F.lit("percentage"))),
        ))

        # Stage 3: the positional and row rules again, on mapped columns.
        todo = state.filter("rule IS NULL AND mapping IS NOT NULL").withColumn("pred_wide", wide_pred)
        if load := _load_of(todo):
            state = _mapped_rules(state, todo, valued, prefix, tolerance, load <= BROADCAST_PAIRS)

    # Stage 4: containment, only where a similarity above the bound is given.
    if has_similarity:
        state = cut_lineage(state)
        open_pair = F.col("rule").isNull() & contained
        inside = _subset(state.filter(open_pair), valued)
        state = state.join(inside, key, "left").withColumn(
            "rule", F.when(open_pair, F.when(F.coalesce("subset", F.lit(True)), "subset").otherwise("none"))
            .otherwise(F.col("rule")))

    # Stage 5: whatever is still open falls back to the strict answer.
    rule = F.coalesce("rule", F.when(F.col("strict"), "strict").otherwise("none"))
    return state.select(*pairs.columns, "strict", (rule != "none").alias("flex"), rule.alias("rule"))


def _mapped_rules(
    state: DataFrame, todo: DataFrame, valued: DataFrame, prefix: Column, tolerance: float, small: bool
) -> DataFrame:
    key = list(PAIR)
    sides = {
        side: _projected(_attach(valued, todo, side, ["pred_wide", "mapping"], small), side == "pred")
        for side in ("pred", "gold")
    }
    flags = _positional(sides["pred"], sides["gold"], tolerance)
    rows = _mapped_rows_equal(sides)
    same_rows = F.when(F.col("ordered"), F.col("same")).otherwise(F.col("rows_same"))
    rules = (("pct", "percentage"), ("bool", "boolean"), ("tol", "tolerance"))
    rule = F.lit(None).cast("string")
    for flag, name in ((same_rows, "normalized"), *[(F.col(c), n) for c, n in reversed(rules)]):
        rule = F.when(flag, F.concat(prefix, F.lit(name))).otherwise(rule)
    return _settle(state.join(flags, key, "left").join(rows, key, "left"), rule)


def _settle(state: DataFrame, rule: Column) -> DataFrame:
    return state.withColumn("rule", F.coalesce("rule", rule))


def _projected(cells: DataFrame, is_pred: bool) -> DataFrame:
    """Mapped column positions on the wide side; the narrow side stays as it is."""
    wide = F.col("pred_wide") if is_pred else ~F.col("pred_wide")
    moved = F.array_position("mapping", F.col("col_idx").cast("int")).cast("int") - 1
    return cells.withColumn("col_idx", F.when(wide, moved).otherwise(F.col("col_idx").cast("int"))).filter(
        "col_idx >= 0"
    )


def _mapped_rows_equal(sides: dict[str, DataFrame]) -> DataFrame:
    """Multisets of projected normalised rows, compared by fingerprint."""
    both = sides["pred"].withColumn("side", F.lit("pred")).unionByName(
        sides["gold"].withColumn("side", F.lit("gold")), True
    )
    prof = profile_results(both, ["norm_rows"], keys=(*PAIR, "side"))
    p = prof.filter("side = 'pred'").select(*PAIR, F.col("norm_rows").alias("pr"))
    g = prof.filter("side = 'gold'").select(*PAIR, F.col("norm_rows").alias("gr"))
    return p.join(g, list(PAIR)).select(*PAIR, (F.col("pr") == F.col("gr")).alias("rows_same"))
