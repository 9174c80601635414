"""Edges of the retrieval policy, of text similarity, and of statement runs."""

import pytest
from pyspark.sql import functions as F

from sqlverdict.operators import curate, examples, lda, quality, replies, reports, retrieve, run_sql, textsim

VEC = "vec_id long, question string, category string, ambig_type string, embedding array<float>"


def _structural(pairs):
    return pairs.withColumn("structural", F.lit(0.5))


def _corpus(spark, n_same):
    near = [(k, "same", "AA", "scope", [1.0, 0.001 * k]) for k in range(n_same)]
    far = [(1000, "far", "AA", "scope", [0.2, 1.0]), (1001, "other", "AU", None, [0.1, 1.0])]
    return spark.createDataFrame(near + far, VEC)


def test_empty_hybrid_goes_by_category(spark):
    query = spark.createDataFrame([(1, "same", "AA", "scope", [1.0, 0.0], 0.9)], VEC + ", confidence double")
    found = retrieve.retrieve(query, _corpus(spark, 40), _structural, k=1, k_other=1).collect()
    assert sorted((r["vec_id"], r["path"]) for r in found) == [(1000, "category"), (1001, "category")]
    found = retrieve.retrieve(query, _corpus(spark, 1), _structural, k=1, k_other=1).collect()
    assert sorted((r["vec_id"], r["path"]) for r in found) == [(1000, "hybrid"), (1001, "other")]


def test_predicted_type(spark):
    rows = [(k, f"q{k}", "AA", "scope" if k % 2 else "vague", [float(k % 2) + 0.01 * (k % 7), 0.3 * (k % 3)]) for k in range(60)]
    corpus = spark.createDataFrame(rows, VEC)
    model = lda.lda_fit(corpus, "ambig_type")
    named = retrieve.with_predicted_type(corpus.withColumn("confidence", F.lit(0.0)), model).collect()
    assert all(r["ambig_type"] == ("scope" if r["vec_id"] % 2 else "vague") and r["confidence"] > 0.9 for r in named)
    unsure = retrieve.with_predicted_type(corpus, model, min_confidence=1.1).collect()
    assert {r["ambig_type"] for r in unsure} == {None}


def test_search_in_chunks(spark):
    corpus = _corpus(spark, 30)
    whole = retrieve.top_k_by_type(corpus, corpus, 3, 2).collect()
    parts = retrieve.top_k_by_type(corpus, corpus, 3, 2, chunk_rows=4).collect()
    assert sorted(whole) == sorted(parts) and len(whole) > 30


def test_no_features_are_all_alike(spark):
    docs = spark.createDataFrame([(1, ""), (2, " ")], "vec_id long, text string")
    pairs = spark.createDataFrame([(5, 1), (5, 2)], "query_id long, vec_id long")
    queries = spark.createDataFrame([(5, "words")], "query_id long, text string")
    vocabulary = textsim.tfidf_fit(docs, "vec_id", "text")
    assert [r["structural"] for r in textsim.tfidf_similarity(pairs, queries, docs, vocabulary, "text").collect()] == [1.0, 1.0]


def test_term_counts(spark):
    docs = spark.createDataFrame([(1, "ab a ab"), (2, None), (3, "")], "id long, text string")
    got = {(r["id"], r["term"]): r["tf"] for r in textsim.term_counts(docs, "id", "text").collect()}
    assert got[1, "a"] == 3 and got[1, "ab"] == 2 and got[1, " ab"] == 2 and got[1, " a "] == 1 and got[1, " "] == 6
    assert {k for k, _ in got} == {1}


def test_writes_are_errors_whatever_they_begin_with(spark, tmp_path):
    spark.sql("CREATE OR REPLACE TEMP VIEW src AS SELECT 1 AS a")
    spark.sql(f"CREATE TABLE IF NOT EXISTS guarded (a INT) USING parquet LOCATION '{tmp_path}/guarded'")
    try:
        texts = ["WITH t AS (SELECT 1 AS a) INSERT INTO guarded SELECT * FROM t", "SELECT a FROM src -- note", "SELECT nothing FROM src",
                 "WITH t AS (SELECT a FROM src) SELECT a FROM t ORDER BY a", "SELECT 1) t, (SELECT 2"]
        statements = spark.createDataFrame([("e", "pred", f"p{k}", k, t, "d") for k, t in enumerate(texts)],
                                           "example_id string, side string, query_id string, pos int, sql string, db_id string")
        runs, _ = run_sql.run_statements(spark, statements, None, str(tmp_path / "runs"))
        got = {r["query_id"]: (r["ok"], r["error"]) for r in runs.collect()}
        assert {k: v[0] for k, v in got.items()} == {"p0": False, "p1": True, "p2": False, "p3": True, "p4": False}
        assert len(got["p2"][1]) > 100  # the whole message
        assert spark.table("guarded").count() == 0
    finally:
        spark.sql("DROP TABLE guarded")


def test_caps_of_zero_and_repeated_dumps(spark):
    rows = spark.createDataFrame([(k, "train", "U") for k in range(5)], "id long, split string, label string")
    assert curate.mixture({"a": rows}, {"train": {"a": ("train", 0)}}).count() == 0
    assert curate.mixture({"a": rows}, {"train": {"a": ("train", None)}}).count() == 5
    statements = spark.createDataFrame([(1, "d", "SELECT a FROM t")], "id long, db_id string, sql string")
    dumps = spark.createDataFrame([("d", "CREATE TABLE t (a INT);"), ("d", "CREATE TABLE t (a INT);")], "db_id string, db_dump string")
    assert quality.schema_correctness(statements, dumps).count() == 1


def test_study_rows(spark):
    scores = spark.createDataFrame([("d", "AA", "AA", 0.5, c) for c in ("x", "y")], "dataset string, gt_category string, pred_category string, f1 double, condition string")
    got = {(r["condition"], r["metric"]): r["value"] for r in reports.study_rows(scores, ["f1"]).collect()}
    assert got == {("x", "f1"): 0.5, ("y", "f1"): 0.5}
    with pytest.raises(ValueError):
        reports.study_grid(scores)
    assert reports.study_grid(scores, conditions=["x", "y"]).columns == ["dataset", "x", "y"]


def test_reply_recovery(spark):
    body = '{"sql_queries": ["SELECT 1"]}'
    cases = [
        (body, "direct"), (f"```json\n{body}\n```", "cleaned_escapes"), (r'{"sql_queries": ["\d \\ \" \u12"]}', "escapes"), (body + " more", "extra"),
        ('{"a": NaN, "sql_queries": ["q"]}', "lenient"), ('x {"sql_queries": ["a"]} z {"b": 1}', "cleaned_extra"), ("none", "none"), ("{bad", "none"), (None, "none"),
        ('{"sql_queries": ["a"], "sql_queries": ["b"]}', "lenient"), (r'pre {"sql_queries": ["\d+ \\d"]} post', "cleaned_escapes"),
    ]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "id int, raw_text string")
    assert {r["id"]: r["parse_mode"] for r in replies.recover_json(df).select("id", "parse_mode").collect()} == {k: m for k, (_, m) in enumerate(cases)}
    got = {r["id"]: r["sql"] for r in replies.json_queries(df).collect()}
    assert got[2] == r'\d \ " \u12' and got[9] == "b" and got[10] == r"\d+ \d"


def test_gold_lists(spark):
    cases = [("['a b', 'c']", None, ["a b", "c"]), ("['it\\'s', \"b\"]", None, ["it's", "b"]), ("['a' 'b']", None, ["ab"]), ("[1, 'a']", None, ["1", "a"]),
             ("['open", "q1\n\nq2", ["q1", "q2"]), (None, "['s']", ["s"]), (None, "[bad", ["[bad"]), ("[]", "[]", [])]
    df = spark.createDataFrame([c[:2] for c in cases], "ambig_queries string, gold_queries string")
    assert [r["gold_list"] for r in examples.parse_gold_list(df).collect()] == [c[2] for c in cases]
