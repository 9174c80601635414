"""Steps whose tasks must not grow with the tables, on small rows of their own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sqlverdict.functions import cells as cl
from sqlverdict.operators import numbering, retrieve, textsim
from sqlverdict.plans import fixtures as fx
from sqlverdict.session import spread

CELLS = "example_id int, side string, query_id string, row_idx bigint, col_idx int, kind string, num double, str string"


def _cells(spark):
    a = [[1.0, 2.0], [3.0, 4.0]]
    tables = {"p0": a, "p1": [r[::-1] for r in a], "p2": a[::-1], "p3": [[1.0, 3.0], [2.0, 4.0]], "p4": a}
    rows = [(1, "pred", q, i, j, "num", v, None) for q, t in tables.items() for i, r in enumerate(t) for j, v in enumerate(r)]
    return cl.with_values(spark.createDataFrame(rows, CELLS))


def test_prints_without_row_groups(spark):
    """Without normalised rows, results are the only groups, and equal where they were equal before."""
    out = cl.profile_results(_cells(spark), ("bag", "raw_cells", "row_bags", "norm_cells"))
    groups = [line.split("Aggregate [")[1].split("]")[0] for line in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Aggregate [" in line]
    assert len(groups) == 1 and "row_idx" not in groups[0]
    kept = {p: cl.profile_results(_cells(spark), (p, "norm_rows")).select("query_id", p).collect() for p in ("bag", "raw_cells", "row_bags", "norm_cells")}

    def classes(rows, p):
        return {frozenset(r["query_id"] for r in rows if r[p] == x[p]) for x in rows}

    new = out.collect()
    assert all(classes(new, p) == classes(rows, p) for p, rows in kept.items())
    assert {(r["n_rows"], r["n_cols"], r["odd"]) for r in new} == {(2, 2, 0)}


def test_orders_are_spread(spark, tmp_path, monkeypatch):
    rows = [(k, k % 40, "F", float(k), "1-URGENT") for k in range(1, 401)]
    spark.createDataFrame(rows, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(fx, "ORDERS", 10)
    for made in (fx.wide(spark, str(tmp_path)), fx.multi_cells(spark, str(tmp_path))):
        key = "ck" if "ck" in made.columns else "example_id"
        assert made.rdd.getNumPartitions() == 40
        assert made.groupBy(F.spark_partition_id().alias("p"), key).count().groupBy(key).count().filter("count > 1").isEmpty()
    wide = fx.wide(spark, str(tmp_path))
    mine = {(r["ck"], r["rn"]): r for r in wide.filter("v = 10").collect()}
    assert mine and all(r["p_rev"] == mine[ck, r["n"] - 1 - rn]["p"] for (ck, rn), r in mine.items())


def test_spread_leaves_small_tables(spark):
    df = spark.range(10)
    assert spread(df, 10, 10, "id") is df
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert spread(df, parts + 1, 1, "id").rdd.getNumPartitions() == parts + 1


def test_wide_rows_are_sorted_in_small_tasks(spark):
    df = spark.range(2000).withColumn("g", F.col("id") % 3)
    sizes = []
    real = numbering.cut_lineage

    def seen(x):
        out = real(x)
        if "_m" in x.columns:
            sizes.append(max(r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()))
        return out

    numbering.cut_lineage, keep = seen, real
    try:
        got = numbering.grouped_rank(df, "g", "r", F.col("id").desc(), each=50).collect()
    finally:
        numbering.cut_lineage = keep
    assert sizes[0] < 200
    ids = {g: sorted((i for i in range(2000) if i % 3 == g), reverse=True) for g in range(3)}
    assert all(ids[r["g"]][r["r"] - 1] == r["id"] for r in got) and len(got) == 2000


def test_search_sends_no_vectors_through_the_driver(spark, monkeypatch):
    """Blocks of both sides meet in tasks: no broadcast is made and the plan does not grow with the queries."""
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(300, 6)).astype(np.float32)
    rows = [(i, f"q{i}", "AA", None if i % 3 else "scope", v.tolist()) for i, v in enumerate(vectors)]
    corpus = spark.createDataFrame(rows, "vec_id bigint, question string, category string, ambig_type string, embedding array<float>")
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda value: pytest.fail("queries went through the driver"), raising=False)
    monkeypatch.setattr(retrieve, "TASK_QUERIES", 64)
    found = retrieve.top_k(corpus, corpus, 3, chunk_rows=4, chunk_bytes=100)
    assert str(found._jdf.queryExecution().optimizedPlan()).count("MapInPandas") == 1
    sims = np.round(vectors.astype(np.float64) @ vectors.astype(np.float64).T, 9)
    for q, ids in {r["query_id"]: r["ids"] for r in found.groupBy("query_id").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))), lambda x: x["vec_id"]).alias("ids")).collect()}.items():
        first = [int(c) for c in np.lexsort((np.arange(300), -sims[q]))[:4]]
        assert ids == [c for c in first if c != q][:3]


def test_texts_are_spread_by_characters(spark, monkeypatch):
    monkeypatch.setattr(textsim, "TASK_CHARS", 50)
    docs = spark.createDataFrame([(i, f"some words of text {i}") for i in range(100)], "vec_id bigint, text string")
    assert textsim.term_counts(docs, "vec_id", "text").rdd.getNumPartitions() >= 40
    pairs = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (3, 99)], "query_id bigint, vec_id bigint")
    vocabulary = textsim.tfidf_fit(docs, "vec_id", "text")
    out = textsim.tfidf_similarity(pairs, docs.withColumnRenamed("vec_id", "query_id"), docs, vocabulary, "text")
    got = sorted((r[0], r[1], round(r[2], 9)) for r in out.collect())
    w = {(r["vec_id"], r["term"]): r["w"] for r in textsim.tfidf_weights(docs, vocabulary, "vec_id", "text").collect()}
    dot = {(a, b): sum(x * w.get((b, t), 0) for (i, t), x in w.items() if i == a) for a, b in ((1, 1), (1, 2), (3, 99))}
    assert got == [(1, 1, 1.0), (1, 2, round(2 * dot[1, 2], 9)), (1, 2, round(2 * dot[1, 2], 9)), (3, 99, round(dot[3, 99], 9))]
