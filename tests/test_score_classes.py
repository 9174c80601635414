"""Scores by classes of results next to scores by all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from sqlverdict.operators import compare, score
from sqlverdict.schema import RESULT_CELLS
from tests.test_compare import _random_result, _variant, cells_of

RUNS = "example_id string, side string, query_id string, pos int, sql string, ordered boolean, ok boolean, error string, similarity double"


@pytest.mark.parametrize("seed, with_similarity", [(3, True), (4, False)])
def test_counts_equal_those_of_pairs(spark, seed, with_similarity):
    rng = random.Random(seed)
    pool = [0, 1, 2.5, 100, None, "a", "A ", "yes", "1", "50%", "nan", "inf", -1]
    runs, rows = [], []
    for n in range(60):
        made = []
        for side in ("gold", "pred"):
            for j in range(rng.randrange(1, 6)):
                result = _variant(rng, rng.choice(made), pool) if made and rng.random() < 0.7 else _random_result(rng, pool)
                result = rng.choice(made) if made and rng.random() < 0.2 else result
                made.append(result)
                similarity = rng.choice((None, 0.5, 0.9)) if side == "pred" else None
                runs.append((str(n), side, f"{side}{j}", j, f"{side} {j}", rng.random() < 0.3, True, None, similarity))
                rows += cells_of(str(n), side, f"{side}{j}", result)
    runs = spark.createDataFrame(runs, RUNS)
    runs = runs if with_similarity else runs.drop("similarity")
    cells = spark.createDataFrame(rows, RESULT_CELLS)
    pairs = compare.match_flex(compare.pair_up(runs), cells)
    want = {r["example_id"]: r.asDict() for r in score._pair_counts(pairs).collect()}
    got = {r["example_id"]: r.asDict() for r in score.match_counts(runs, cells, flex=True).collect()}
    assert got == want and any(r["gold_flex"] > r["gold_strict"] for r in got.values())
    strict = {r["example_id"]: (r["gold_strict"], r["pred_strict"]) for r in score.match_counts(runs, cells).collect()}
    assert strict == {k: (r["gold_strict"], r["pred_strict"]) for k, r in want.items()}


def test_thousands_of_statements_need_no_pairs(spark, capsys):
    """5000 statements a side: 4000 predictions with one result, which is in the gold; a plan without a pair join."""
    runs = spark.range(5000).select(
        F.lit("x").alias("example_id"), F.explode(F.array(F.lit("gold"), F.lit("pred"))).alias("side"), F.col("id").cast("string").alias("query_id"),
        F.col("id").cast("int").alias("pos"), F.col("id").cast("string").alias("sql"), F.lit(False).alias("ordered"), F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error"))
    value = F.when((F.col("side") == "pred") & (F.col("pos") < 4000), 7.0).otherwise(F.col("pos") + F.when(F.col("side") == "pred", 0.0).otherwise(2.0))
    cells = runs.select("example_id", "side", "query_id", F.lit(0).cast("bigint").alias("row_idx"), F.lit(0).alias("col_idx"),
                        F.lit("num").alias("kind"), value.alias("num"), F.lit(None).cast("string").alias("str"))
    counts = score.match_counts(runs, cells)
    assert counts.first().asDict() == {"example_id": "x", "gold_strict": 1 + 1000, "pred_strict": 4000 + 1000}
    counts.explain()
    plan = capsys.readouterr().out
    assert "pred_id" not in plan and "gold_id" not in plan
    scores = score.score_examples(runs, counts).first()
    assert (scores["precision"], scores["recall"]) == (1.0, 1001 / 5000)


def test_wide_results_with_equal_columns_join_no_cells(spark, monkeypatch):
    """300 columns in another order: the map comes from the fingerprints of columns, ties like the plain assignment."""
    def fail(*_):
        raise AssertionError("cells were joined")

    wide = [[f"{r}-{c}" for c in range(300)] for r in range(3)]
    order = list(range(300))
    random.Random(5).shuffle(order)
    twice = [("a", "a", 1), ("b", "b", 2)]
    rows = [*cells_of("w", "pred", "p", wide), *cells_of("w", "gold", "g", [[r[c] for c in order[:250]] for r in wide]),
            *cells_of("t", "pred", "p", twice), *cells_of("t", "gold", "g", [(1, "a"), (2, "b")])]
    pairs = spark.createDataFrame([(i, "p", "g", False) for i in "wt"], "example_id string, pred_id string, gold_id string, ordered boolean")
    monkeypatch.setattr(compare, "_column_scores", fail)
    got = {(r["example_id"], r["gold_col"]): r["pred_col"] for r in compare.column_mapping(pairs, spark.createDataFrame(rows, RESULT_CELLS)).collect()}
    assert got == {**{("w", k): order[k] for k in range(250)}, ("t", 0): 2, ("t", 1): 0}
