import numpy as np
import pytest
from pyspark.sql import functions as F

from sqlverdict.functions import cells as C
from sqlverdict.functions import text as tx
from sqlverdict.operators import examples, lda, replies, reports, retrieve, textsim

COUNTS = {  # split -> counts for (true, predicted) in the order U, AA, AU
    "test": [[253, 2, 0], [5, 123, 3], [9, 13, 287]],
    "validation": [[250, 2, 3], [2, 210, 8], [4, 9, 363]],
}
EXPECTED = {
    "test": {"AA": (0.89, 0.94, 0.91), "AU": (0.99, 0.93, 0.96), "U": (0.95, 0.99, 0.97), "accuracy": (None, None, 0.95),
             "macro avg": (0.94, 0.95, 0.95), "weighted avg": (0.96, 0.95, 0.95)},
    "validation": {"AA": (0.95, 0.95, 0.95), "AU": (0.97, 0.97, 0.97), "U": (0.98, 0.98, 0.98), "accuracy": (None, None, 0.97),
                   "macro avg": (0.97, 0.97, 0.97), "weighted avg": (0.97, 0.97, 0.97)},
}


@pytest.mark.parametrize("split", ["test", "validation"])
def test_published_classification_reports(spark, split):
    labels = ("U", "AA", "AU")
    cells = [(t, p, n) for t, row in zip(labels, COUNTS[split]) for p, n in zip(labels, row)]
    df = spark.createDataFrame([(t, p) for t, p, n in cells for _ in range(n)], "t string, p string")
    got = {r["label"]: tuple(None if v is None else round(v, 2) for v in (r["precision"], r["recall"], r["f1"]))
           for r in reports.class_report(df, "t", "p").collect()}
    assert got == EXPECTED[split]
    accuracy = reports.class_metrics(df, "t", "p").first()["accuracy"]
    assert accuracy == pytest.approx({"test": 0.9539568345323741, "validation": 0.9670975323149236}[split])
    per_class = {r["true_label"]: round(r["accuracy"], 4) for r in reports.class_breakdown(df, "t", "p").collect()}
    assert per_class == {"test": {"U": 0.9922, "AA": 0.9389, "AU": 0.9288},
                         "validation": {"U": 0.9804, "AA": 0.9545, "AU": 0.9654}}[split]


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t")).alias("v")).first()["v"]


@pytest.mark.parametrize("text, n, x", [
    (" NULL ", None, None), ("none", None, None), ("", None, None), ("1e3", 1000.0, None), ("007", 7.0, None),
    ("2.50", 2.5, None), ("1_000", 1000.0, None), ("1d", None, "1d"), (" Ab ", None, "ab"), ("-Infinity", float("-inf"), None),
])
def test_normalised_values(spark, text, n, x):
    raw = C.raw_value(F.lit("str"), F.lit(None).cast("double"), F.lit(text))
    row = spark.range(1).select(C.norm_value(raw).alias("v")).first()["v"]
    assert (row["n"], row["x"]) == (n, x)


@pytest.mark.parametrize("expr, text, want", [
    (tx.yes_no, "I do not know", "no"), (tx.yes_no, "assistant\n\nYes.", "yes"), (tx.yes_no, "maybe", "n/a"),
    (tx.score_of_text, "0.85", 0.85), (tx.score_of_text, "85", 1.0), (tx.score_of_text, "Score: 0.4", 0.4),
    (tx.score_of_text, "none", 0.0), (tx.score_of_text, "nan", 1.0), (tx.score_of_text, "-3 x", 0.0),
    (tx.format_reward, '["a","b"]', 0.05), (tx.format_reward, "[1,2]", 0.01), (tx.format_reward, '["a"]', 0.0),
    (tx.format_reward, "oops", 0.0), (tx.format_reward, '["a", null]', 0.01), (tx.format_reward, '["a","b"] tail', 0.0),
    (tx.format_reward, "```json\n[\"" + "y" * 50 + "\", \"" + "z" * 50 + "\"]\n```", 0.1),
    (lambda c: tx.quality_gate(c, F.lit(0.9)), "oops", 0.25), (lambda c: tx.quality_gate(c, F.lit(0.9)), "[]", 0.9),
    (examples.split_gold, "SELECT  1\n\n\nSELECT 2", ["SELECT 1", "SELECT 2"]),
    (tx.quantifier_marker, "Does every cat, or all?", "QUANT_every all"),
    (tx.schema_skeleton, "create table t (\n a INT,\n primary key (a)\n);", "create table t (\nprimary key (a)\n);"),
])
def test_text_rules(spark, expr, text, want):
    assert one(spark, text, expr) == want


def test_statement_extraction_quirks(spark):
    texts = {
        "prose": "Here is nothing", "block": "```sql\nSELECT 1\n```", "lost": "```sql\nSELECT 1\n```\n```sql\nSELECT 2; SELECT 3\n```",
        "label": "assistant\n\nSQL query(s): SELECT a\\_b"}
    df = spark.createDataFrame(list(texts.items()), "id string, raw_text string")
    got = {}
    for r in replies.extract_statements(df).orderBy("id", "pos").collect():
        got.setdefault(r["id"], []).append(r["sql"])
    assert got == {"prose": ["Here is nothing"], "block": ["SELECT 1\n"], "lost": ["SELECT 2", "SELECT 3"],
                   "label": ["SELECT a_b"]}


def test_json_recovery_modes(spark):
    texts = {
        "direct": '{"sql_queries": ["SELECT 1"]}', "lenient": '{"sql_queries": ["SELECT 1"], "x": NaN}',
        "repeated": '{"sql_queries": ["no"], "sql_queries": ["SELECT 1"]}', "escapes": '{"sql_queries": ["SELECT \\d"]}',
        "extra": '{"sql_queries": ["SELECT 1"]} and text', "fenced": 'so ```json\n{"sql_queries": ["SELECT 1"]}\n``` done',
        "scalar": "{{not json", "wrong": '{"sql_queries": "SELECT 1"}'}
    df = spark.createDataFrame(list(texts.items()), "id string, raw_text string")
    modes = {r["id"]: r["parse_mode"] for r in replies.recover_json(df).select("id", "parse_mode").collect()}
    assert modes == {"direct": "direct", "lenient": "lenient", "repeated": "lenient", "escapes": "escapes", "extra": "extra",
                     "fenced": "cleaned_escapes", "scalar": "none", "wrong": "direct"}
    queries = {r["id"]: r["sql"] for r in replies.json_queries(df).collect()}
    assert queries == {"direct": "SELECT 1", "lenient": "SELECT 1", "repeated": "SELECT 1", "escapes": "SELECT \\d",
                       "extra": "SELECT 1", "fenced": "SELECT 1"}


def test_strict_interpretations(spark):
    df = spark.createDataFrame([(1, '{"interpretations": [" a ", "", 5, "b"]}'), (2, 'x {"interpretations": ["a"]}')],
                               "id int, raw_text string")
    got = [(r["id"], r["interpretation"]) for r in replies.json_interpretations(df, strict=True).orderBy("id", "pos").collect()]
    assert got == [(1, "a"), (1, "b")]


def test_analysis_and_corrections(spark):
    df = spark.createDataFrame([(1, "Query 1:\nSELECT 1\n\n# note with SELECT\n\nplain")], "id int, raw_text string")
    assert [r["sql"] for r in replies.reply_queries(df, "correction").collect()] == ["SELECT 1"]
    with pytest.raises(ValueError):
        replies.reply_queries(df, "other")


def test_ngrams(spark):
    assert sorted(one(spark, "Ab", textsim.char_ngrams)) == sorted(
        [" ", "a", "b", " ", " a", "ab", "b ", " ab", "ab "])
    assert one(spark, "a", lambda c: textsim.char_ngrams(c, (4, 5))) == [" a "]


def test_lda_matches_direct_solution(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 6)) + np.repeat(np.eye(3, 6) * 2, 100, axis=0)
    y = np.repeat(["a", "b", "c"], 100)
    df = spark.createDataFrame([(i, y[i], x[i].tolist()) for i in range(300)], "vec_id long, kind string, embedding array<double>")
    model = lda.lda_fit(df, "kind")
    assert np.allclose(lda.lda_fit(df.repartition(40), "kind").coef, model.coef)
    means = np.stack([x[y == c].mean(axis=0) for c in "abc"])
    within = sum((x[y == c] - m).T @ (x[y == c] - m) for c, m in zip("abc", means)) / 297
    scores = x @ np.linalg.solve(within, means.T) - 0.5 * np.einsum("ij,ij->i", means, np.linalg.solve(within, means.T).T) + np.log(1 / 3)
    prob = np.exp(scores - scores.max(axis=1, keepdims=True))
    prob /= prob.sum(axis=1, keepdims=True)
    got = {r["vec_id"]: {p["label"]: p["prob"] for p in r["predictions"]} for r in lda.lda_predict(df, model, 3).collect()}
    assert np.allclose([[got[i][c] for c in "abc"] for i in range(300)], prob, atol=1e-6)
    levels = {p["level"] for r in lda.lda_predict(df, model).collect() for p in r["predictions"]}
    assert levels <= {"high", "medium", "low"}


def test_retrieval_edges(spark):
    schema = "vec_id long, question string, category string, ambig_type string, embedding array<float>"
    q = spark.createDataFrame([(1, "a", "U", None, [1.0, 0.0])], schema)
    c = spark.createDataFrame(
        [(10, "a", "AA", "scope", [1.0, 0.0]), (11, "a", "U", None, [0.9, 0.1]), (12, "b", "AU", None, [0.5, 0.5]),
         (13, "c", "U", None, [0.0, 1.0])], schema)
    assert [r["vec_id"] for r in retrieve.top_k(q, c, 2).collect()] == [12]
    assert [r["vec_id"] for r in retrieve.top_k(q, c, 2, exclude_exact=False).orderBy("rank").collect()] == [10, 11]
    assert [r["vec_id"] for r in retrieve.top_k_by_category(q, c, 1, 2).orderBy("rank").collect()] == [13, 12]
    assert [r["vec_id"] for r in retrieve.top_k_by_type(q, c, 2, 0).orderBy("rank").collect()] == [12, 13]
    assert retrieve.top_k(q, c, 0).count() == 0
    with pytest.raises(Exception, match="invalid category"):
        retrieve.top_k_by_category(q.withColumn("category", F.lit("X")), c).collect()
