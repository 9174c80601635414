import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rules import cells_of, flex, greedy, strict
from sqlverdict.operators import compare, score
from sqlverdict.operators.extend import match_rules
from sqlverdict.schema import RESULT_CELLS

CASES = [  # rule, ordered, pred, gold, expected
    ("unordered", False, [(1, 3), (2, 4)], [(1, 2), (3, 4)], True),
    ("unordered", False, [(1,), (2,)], [(1, 2)], True),
    ("unordered", False, [("1",)], [(1,)], False),
    ("unordered", False, [(1.0,)], [(1,)], True),
    ("unordered", False, [], [], True),
    ("unordered", False, [], [(None,)], False),
    ("ordered", True, [(2, "a"), (1, "b")], [("a", 2), ("b", 1)], True),
    ("ordered", True, [(1,), (2,)], [(2,), (1,)], False),
    ("percentage", False, [(50,)], [(0.5,)], True),
    ("percentage", False, [("50%",)], [(50,)], True),
    ("percentage", False, [(1000,)], [(1005,)], True),
    ("percentage", False, [(0,)], [(0,)], True),
    ("boolean", False, [("YES",)], [(1,)], True),
    ("boolean", False, [("F",)], [("no",)], True),
    ("tolerance", False, [(1.005,)], [(1,)], True),
    ("normalized", False, [(" A ", 1)], [("a", "1")], True),
    ("normalized", False, [(1, 3), (2, 4)], [(1, 2), (3, 4)], False),
    ("flex", False, [(1, "a", "x")], [(1, "a")], True),
    ("flex", False, [("a",)], [("a", 9)], True),
    ("subset", False, [(1, 2, 3)], [(3, 1)], True),
]


def tables(spark, items):
    """items: (id, ordered, pred rows, gold rows) -> pairs, cells"""
    rows = [c for i, _, p, g in items for side, r in (("pred", p), ("gold", g)) for c in cells_of(i, side, side, r)]
    pairs = spark.createDataFrame(
        [(i, "pred", "gold", o) for i, o, _, _ in items], "example_id string, pred_id string, gold_id string, ordered boolean")
    return pairs, spark.createDataFrame(rows, RESULT_CELLS)


def test_golden_cases(spark):
    items = [(str(n), o, p, g) for n, (_, o, p, g, _) in enumerate(CASES)]
    pairs, cells = tables(spark, items)
    mine = {
        "percentage": lambda p, c: compare.match_positional(p, c).withColumnRenamed("pct", "hit"),
        "boolean": lambda p, c: compare.match_positional(p, c).withColumnRenamed("bool", "hit"),
        "tolerance": lambda p, c: compare.match_positional(p, c).withColumnRenamed("tol", "hit"),
    }
    names = sorted({c[0] for c in CASES})
    got = {r["example_id"]: r.asDict() for r in match_rules(pairs, cells, names, mine).collect()}
    for n, (rule, _, p, g, want) in enumerate(CASES):
        assert got[str(n)][f"rule_{rule}"] is want, (rule, p, g)


def test_map_of_any_width(spark):
    gold = [tuple(range(k * 100, k * 100 + 12)) for k in range(3)]
    pred = [tuple(["x"] * 4 + list(r[::-1]) + ["y"] * 4) for r in gold]
    pairs, cells = tables(spark, [("w", False, pred, gold), ("v", False, [tuple(range(11))], [(1, 2)])])
    got = {(r["example_id"], r["gold_col"]): (r["pred_col"], r["score"]) for r in compare.column_mapping(pairs, cells).collect()}
    assert got == {("w", c): (15 - c, 36) for c in range(12)} | {("v", 0): (1, 2), ("v", 1): (2, 2)}
    assert {r["example_id"]: r["flex"] for r in compare.match_flex(pairs, cells).collect()} == {"w": True, "v": True}
    assert compare.column_mapping(pairs, cells, max_pred=10, max_gold=5).count() == 0


def test_best_assignment_ties():
    """The first set of columns, then the first order, as if all candidates were tried in turn."""
    rng = random.Random(3)
    for _ in range(300):
        w = rng.randint(1, 5)
        n = rng.randint(1, w)
        grid = np.array([[rng.choice((0, 0, 1, 2)) for _ in range(n)] for _ in range(w)])
        tried = [p for c in itertools.combinations(range(w), n) for p in itertools.permutations(c)]
        totals = [sum(grid[r, c] for c, r in enumerate(p)) for p in tried]
        best = totals.index(max(totals))
        assert compare.best_assignment(grid) == (totals[best], list(tried[best]))


def _random_result(rng, pool, rows=None, cols=None):
    cols = cols or rng.randint(1, 4)
    return [tuple(rng.choice(pool) for _ in range(cols)) for _ in range(rng.randint(0, 4) if rows is None else rows)]


def _variant(rng, rows, pool):
    """A result close to another one: shuffled, widened, narrowed, reformatted."""
    rows = [list(r) for r in rows]
    kind = rng.randint(0, 6)
    if kind == 0:
        rng.shuffle(rows)
    elif kind == 1:
        rows = [r + [rng.choice(pool)] for r in rows]
    elif kind == 2 and rows and len(rows[0]) > 1:
        rows = [r[1:] for r in rows]
    elif kind == 3 and rows:
        cols = list(range(len(rows[0])))
        rng.shuffle(cols)
        rows = [[r[c] for c in cols] for r in rows]
    elif kind == 4:
        rows = [[f" {v} ".upper() if isinstance(v, str) else v for v in r] for r in rows]
    elif kind == 5:
        rows = [[v * 100 if isinstance(v, (int, float)) else v for v in r] for r in rows]
    elif rows:
        rows[rng.randrange(len(rows))][0] = rng.choice(pool)
    return [tuple(r) for r in rows]


@pytest.mark.parametrize("seed", [1, 2])
def test_flex_against_plain_rules(spark, seed):
    rng = random.Random(seed)
    pool = [0, 1, 2, 2.5, 100, None, "a", "A ", "yes", "no", "1", "50%", "null", "1,000", "x y", 1e-3, -1]
    items = []
    for n in range(250):
        gold = _random_result(rng, pool)
        pred = _variant(rng, gold, pool) if rng.random() < 0.8 else _random_result(rng, pool)
        items.append((str(n), rng.random() < 0.4, pred, gold))
    pairs, cells = tables(spark, items)
    pairs = pairs.withColumn("similarity", F.when(F.col("example_id").cast("int") % 3 == 0, 0.9))
    got = {r["example_id"]: r for r in compare.match_flex(pairs, cells).collect()}
    exact = {r["example_id"]: r["exact"] for r in compare.confirm_bags(pairs, cells).collect()}
    loose = {r["example_id"]: r["strict"] for r in compare.match_unordered(pairs, cells).collect()}
    for i, ordered, p, g in items:
        similarity = 0.9 if int(i) % 3 == 0 else None
        assert got[i]["rule"] == flex(p, g, ordered, similarity), (ordered, p, g)
        assert got[i]["strict"] == strict(p, g, ordered), (ordered, p, g)
        assert got[i]["flex"] or similarity or not got[i]["strict"]
        assert loose[i] == exact[i] == strict(p, g, False) or not (p and g)


def test_nan_equals_nothing_and_big_integers_stay_exact(spark):
    def cell(i, side, num, text=None):
        return (i, side, side, 0, 0, "num", num, text)

    rows = [cell("nan", "pred", float("nan")), cell("nan", "gold", float("nan")),
            cell("big", "pred", 2.0**53, "9007199254740993"), cell("big", "gold", 2.0**53, None),
            cell("same", "pred", 2.0**60, str(2**60)), cell("same", "gold", 2.0**60, None),
            cell("zero", "pred", -0.0), cell("zero", "gold", 0.0)]
    pairs = spark.createDataFrame([(i, "pred", "gold", False) for i in ("nan", "big", "same", "zero")],
                                  "example_id string, pred_id string, gold_id string, ordered boolean")
    got = compare.match_unordered(pairs, spark.createDataFrame(rows, RESULT_CELLS)).collect()
    assert {r["example_id"]: r["strict"] for r in got} == {"nan": False, "big": False, "same": True, "zero": True}


def test_large_pair_tables_take_the_salted_join(spark, monkeypatch):
    monkeypatch.setattr(compare, "BROADCAST_PAIRS", 0)
    rows = [(1, "a", 2.0), (2, "b", 3.0), (3, "c", 4.0)]
    pairs, cells = tables(spark, [
        ("swap", False, [(r[1], r[0], r[2]) for r in rows], rows), ("cents", True, [(r[2] * 100,) for r in rows], [(r[2],) for r in rows]),
        ("half", False, [(1, "a", 9), (2, "b", 9), (3, "c", 9)], rows)])
    got = {r["example_id"]: r["rule"] for r in compare.match_flex(pairs, cells).collect()}
    assert got == {"swap": "mapped+percentage", "cents": "percentage", "half": "none"}


def test_result_dedup_against_greedy(spark):
    rng = random.Random(7)
    pool = [[], [(1, "a")], [("a", 1)], [(1,), ("a",)], [(2,), (1,)], [(1,), (2,)], None]
    runs, rows, want = [], [], {}
    for n in range(120):
        results = [rng.choice(pool) for _ in range(rng.randint(1, 7))]
        ordered = [rng.random() < 0.4 for _ in results]
        for j, r in enumerate(results):
            sql = f"SELECT {j}" + (" ORDER BY 1" if ordered[j] else "")
            runs.append((str(n), "pred", f"p{j}", j, sql, ordered[j], r is not None, None if r is not None else "bad"))
            rows += cells_of(str(n), "pred", f"p{j}", r)
        want[str(n)] = greedy(results, ordered)
    runs = spark.createDataFrame(
        runs, "example_id string, side string, query_id string, pos int, sql string, ordered boolean, ok boolean, error string")
    got = {}
    for r in score.result_dedup(runs, spark.createDataFrame(rows, RESULT_CELLS)).collect():
        got.setdefault(r["example_id"], []).append(r["pos"])
    assert {k: sorted(v) for k, v in got.items()} == want


def test_precision_recall_f1(spark):
    runs = spark.createDataFrame(
        [("half", "gold", "g0", 0, "a", False, True), ("half", "gold", "g1", 1, "b", False, True),
         ("half", "pred", "p0", 0, "a", False, True), ("half", "pred", "p1", 1, "c", False, True),
         ("none", "gold", "g0", 0, "a", False, True)],
        "example_id string, side string, query_id string, pos int, sql string, ordered boolean, ok boolean")
    rows = [c for q, side, v in (("g0", "gold", 1), ("g1", "gold", 2), ("p0", "pred", 1), ("p1", "pred", 3))
            for c in cells_of("half", side, q, [(v,)])] + list(cells_of("none", "gold", "g0", [(1,)]))
    matches = compare.match_strict(compare.pair_up(runs), spark.createDataFrame(rows, RESULT_CELLS))
    got = {r["example_id"]: (r["precision"], r["recall"], r["f1"], r["num_correct"])
           for r in score.score_examples(runs, matches).collect()}
    assert got == {"half": (0.5, 0.5, 0.5, 1), "none": (0.0, 0.0, 0.0, 0)}
