"""What model-written statements may do, and how many jobs they take."""

import pytest

from sqlverdict.operators import guard, run_sql

SCHEMA = "example_id string, side string, query_id string, pos int, sql string, db_id string"


def statements(spark, texts):
    return spark.createDataFrame([("e", "pred", f"p{k}", k, t, "d") for k, t in enumerate(texts)], SCHEMA)


@pytest.mark.parametrize("views", [True, False])
def test_only_queries_over_given_tables_run(spark, tmp_path, views):
    (tmp_path / "note.txt").write_text("secret")
    spark.createDataFrame([(9,)], "a int").write.parquet(f"{tmp_path}/other")
    spark.createDataFrame([(9,)], "a int").createOrReplaceTempView("hidden")
    table = spark.createDataFrame([(1, "x", [1, 2]), (2, "y", [])], "a int, b string, c array<int>")
    table.createOrReplaceTempView("t")
    bad = [
        "SELECT java_method('java.lang.System', 'getProperty', 'user.home')", "SELECT reflect('java.lang.System', 'getProperty', 'user.home') FROM t",
        "SELECT (SELECT try_reflect('java.lang.System', 'getProperty', 'user.home')) FROM t", f"SELECT * FROM text.`{tmp_path}/note.txt`",
        f"SELECT a FROM t WHERE a IN (SELECT a FROM parquet.`{tmp_path}/other`)", f"WITH x AS (SELECT * FROM parquet.`{tmp_path}/other`) SELECT * FROM x",
        "SELECT * FROM range(3)", "SELECT input_file_name() FROM t", "SELECT current_user()", "SELECT transform(a) USING 'cat' AS (x) FROM t",
        "SELECT * FROM t; DROP VIEW t", "DROP TABLE t", "SHOW TABLES", "SELECT * FROM explode(array(1))", "SELECT nosuch(a) FROM t", "SELECT * FROM IDENTIFIER('t')",
        "SELECT a FROM t WHERE java_method('java.lang.Math', 'abs', a) = '1'", "SELECT max(a) OVER (ORDER BY reflect('java.lang.Math', 'abs', a)) FROM t"]
    bad += ["SELECT * FROM hidden", "SELECT * FROM global_temp.hidden"] if views else []
    good = {
        "SELECT upper(b), count(*) FROM t GROUP BY 1 HAVING count(*) > 0 ORDER BY 1 DESC": 2, "SELECT a, x FROM t LATERAL VIEW explode(c) s AS x": 2,
        "WITH r AS (SELECT a FROM t) SELECT r.a, sum(r.a) OVER (ORDER BY r.a) FROM r JOIN t USING (a)": 2,
        "SELECT CASE WHEN a > 1 THEN 'p' ELSE b END, CAST(a AS STRING), a + 1, b LIKE 'x%' FROM t WHERE EXISTS (SELECT 1 FROM t u WHERE u.a = t.a)": 2,
        "SELECT a FROM t UNION ALL SELECT 5": 3, "SELECT * FROM (VALUES (1), (2)) v(z) LIMIT 1": 1, "SELECT transform(c, x -> x + 1) FROM t": 2}
    runs, cells = run_sql.run_statements(spark, statements(spark, bad + list(good)), (lambda _: {"t": table}) if views else None, str(tmp_path / "runs"))
    got = {r["sql"]: (r["ok"], r["error"]) for r in runs.collect()}
    assert {q: got[q][0] for q in bad} == dict.fromkeys(bad, False)
    assert {q: got[q] for q in good} == dict.fromkeys(good, (True, None))
    rows = {r["query_id"]: r["n"] for r in cells.groupBy("query_id").agg({"row_idx": "max"}).withColumnRenamed("max(row_idx)", "n").collect()}
    assert {q: rows[f"p{len(bad) + k}"] + 1 for k, q in enumerate(good)} == good


def test_jobs_grow_with_chunks(spark, tmp_path):
    """Forty statements in one chunk take no more jobs than eight; one that fails while running costs a few more."""
    table = spark.createDataFrame([(k, f"v{k}") for k in range(20)], "a int, b string")

    def jobs(texts, name):
        before = spark.sparkContext._jsc.sc().dagScheduler().nextJobId()
        runs, cells = run_sql.run_statements(spark, statements(spark, texts), lambda _: {"t": table}, str(tmp_path / name))
        return spark.sparkContext._jsc.sc().dagScheduler().nextJobId() - before, runs, cells

    few, _, _ = jobs([f"SELECT a, b FROM t WHERE a <> {k}" for k in range(8)], "few")
    many, runs, _ = jobs([f"SELECT a, b FROM t WHERE a <> {k}" for k in range(40)], "many")
    assert many <= few + 4 and runs.filter("ok").count() == 40
    texts = [f"SELECT b, a FROM t WHERE a > {k} ORDER BY a DESC" if k % 2 else f"SELECT a FROM t WHERE a > {k}" for k in range(20)]
    _, runs, cells = jobs(texts, "sorted")
    got = {(r["query_id"], r["row_idx"]): r["num"] for r in cells.filter("kind = 'num'").collect()}
    for k in range(20):
        left = sorted(range(k + 1, 20), reverse=k % 2 == 1)
        assert [got[f"p{k}", i] for i in range(len(left))] == left
    _, runs, _ = jobs(["SELECT a FROM t", "SELECT 1 / (a - 3) FROM t", "SELECT b FROM t", "SELECT CAST(b AS INT) FROM t"], "faults")
    assert {r["query_id"]: r["ok"] for r in runs.collect()} == {"p0": True, "p1": False, "p2": True, "p3": False}


def test_guard_names_the_fault(spark):
    with pytest.raises(guard.NotAllowed, match="java_method"):
        guard.checked(spark, "SELECT java_method('a', 'b')")
