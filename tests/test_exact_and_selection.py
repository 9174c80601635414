"""Fingerprint matches confirmed by values, selection by slices of digests, vectors by content."""

import random

import pytest
from pyspark.sql import functions as F

from sqlverdict.functions import cells as cells_module
from sqlverdict.operators import compare, curate, numbering, score
from sqlverdict.sources import vector_ledger
from tests.rules import strict
from tests.test_compare import _random_result, _variant, tables


def _collide(monkeypatch):
    """Every fingerprint is the same, so results of one shape cannot be told apart."""
    monkeypatch.setattr(cells_module, "_member_sums", lambda name: [
        F.sum(F.lit(0)).alias(f"{name}_{i}") for i in range(cells_module._SLICES)])


@pytest.mark.parametrize("collide", [False, True])
def test_matches_are_confirmed(spark, monkeypatch, collide):
    rng = random.Random(3)
    pool = [0, 1, 2, None, "a", "A ", "x y", -1]
    items = []
    for n in range(120):
        gold = _random_result(rng, pool)
        items.append((str(n), rng.random() < 0.5, _variant(rng, gold, pool), gold))
    pairs, cells = tables(spark, items)
    want = {i: strict(p, g, o) for i, o, p, g in items}
    loose = {i: strict(p, g, False) for i, o, p, g in items}
    by_row = {i: strict(p, g, True) for i, o, p, g in items}
    normal = {r["example_id"]: r["normalized"] for r in compare.match_normalized(pairs, cells).collect()}
    if collide:
        _collide(monkeypatch)
        wrong = {r["example_id"]: r["strict"] for r in compare.match_strict(pairs, cells).collect()}
        assert sum(wrong.values()) > sum(want.values())
    for rule, name, right in ((compare.match_strict, "strict", want), (compare.match_unordered, "strict", loose),
                              (compare.match_ordered, "strict", by_row), (compare.match_normalized, "normalized", normal)):
        got = {r["example_id"]: r[name] for r in rule(pairs, cells, exact=True).collect()}
        assert got == right, rule
        assert 0 < sum(right.values()) < len(right)


@pytest.mark.parametrize("collide", [False, True])
def test_gold_duplicates_are_confirmed(spark, monkeypatch, collide):
    results = {"e1": [1, 2, 3, 2], "e2": [1, 2, 3], "e3": [5, 6, 7, 8, 7], "e4": [1, 1]}
    runs = [(e, "gold", f"g{k}", k, f"SELECT {e} {k}", False, True, 1, 1) for e, vs in results.items() for k in range(len(vs))]
    cells = [(e, "gold", f"g{k}", 0, 0, "num", float(v), None) for e, vs in results.items() for k, v in enumerate(vs)]
    runs = spark.createDataFrame(runs, "example_id string, side string, query_id string, pos int, sql string, ordered boolean, ok boolean, n_rows long, n_cols int")
    cells = spark.createDataFrame(cells, "example_id string, side string, query_id string, row_idx long, col_idx int, kind string, num double, str string")
    if collide:
        _collide(monkeypatch)
        assert score.gold_duplicates(runs, cells).count() == 4
    got = {r["example_id"]: r["dup_pos"] for r in score.gold_duplicates(runs, cells, exact=True).collect()}
    assert got == {"e1": 3, "e3": 4, "e4": 1}


@pytest.mark.parametrize("digits", [1, 3])
def test_selection_by_slices(spark, monkeypatch, digits):
    """The same rows as sorting, with groups below, at and above the cap, repeated keys and nulls."""
    rng = random.Random(4)
    rows = [(None if k % 50 == 0 else k // 2, rng.choice(["hot"] * 6 + ["b", None]), k) for k in range(4000)]
    df = spark.createDataFrame(rows, "id long, g string, n long")
    keyed = df.withColumn("_k", curate.shuffle_key(7, F.col("id")))
    monkeypatch.setattr(numbering, "SLICE_DIGITS", digits)
    for by, n in ((["g"], 300), (["g"], 1), ([], 777), (["g"], 5000), (["g"], 0)):
        monkeypatch.setattr(numbering, "GROUP_LIMIT", 10**6)
        want = numbering.first_per_group(keyed, n, by, "_k", "id", "n").collect()
        monkeypatch.setattr(numbering, "GROUP_LIMIT", 0)
        got = numbering.first_by_digest(keyed, n, by, "_k", "id", "n")
        assert got.columns == keyed.columns
        assert sorted(r["n"] for r in got.collect()) == sorted(r["n"] for r in want)


def test_only_the_slice_at_the_cut_is_sorted(spark, monkeypatch):
    df = spark.range(20000).withColumn("_k", curate.shuffle_key(1, F.col("id")))
    monkeypatch.setattr(numbering, "GROUP_LIMIT", 0)
    sorted_rows = []
    rank = numbering.grouped_rank
    monkeypatch.setattr(numbering, "grouped_rank", lambda edge, *rest: sorted_rows.append(edge.count()) or rank(edge, *rest))
    assert numbering.first_by_digest(df, 7000, [], "_k", "id").count() == 7000
    assert sorted_rows[0] < 100


def test_only_new_texts_are_encoded(spark, tmp_path):
    seen = []

    def encode(texts):
        seen.append(sorted(r["text"] for r in texts.select("text").collect()))
        return texts.select("key", F.array(F.length("text").cast("float")).alias("vector"))

    path = str(tmp_path / "ledger")
    corpus = spark.createDataFrame([(k, f"text {k % 100}") for k in range(300)] + [(900, None), (901, "")], "vec_id long, text string")
    vector_ledger.encode_unseen(corpus, encode, path, "v1")
    changed = corpus.withColumn("text", F.when(F.col("vec_id") == 5, "changed").otherwise(F.col("text")))
    vector_ledger.encode_unseen(changed, encode, path, "v1")
    vector_ledger.encode_unseen(changed, encode, path, "v1")
    assert len(seen[0]) == 101 and seen[1:] == [["changed"], []]
    got = {r["vec_id"]: r["embedding"] for r in vector_ledger.with_vectors(changed, path, "v1").collect()}
    assert len(got) == 302 and got[5] == [7.0] and got[105] == [6.0] and got[900] is None and got[901] == [0.0]
    vector_ledger.encode_unseen(corpus.limit(0), encode, path, "v1")
    vector_ledger.encode_unseen(corpus, encode, path, "v2")
    assert seen[3] == [] and len(seen[4]) == 101
