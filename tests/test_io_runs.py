import json
import os

import pytest
from pyspark.sql import functions as F

from sqlverdict.operators import curate, examples, reports, run_sql, score
from sqlverdict.operators.numbering import dense_index
from sqlverdict.plans import curate_checks, fixtures
from sqlverdict.sources import readers
from sqlverdict.sources.checkpoint import pending, read_checkpoint
from sqlverdict.streaming import score_stream as ss

SF = "/root/testdata/sf0.001"


def test_csv_landing_and_registry(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('split,question,gold_queries,db_file_full,is_ambiguous\n'
                    'test,"How\nmany ""cats""?","SELECT 1\n\nSELECT  2",db1,TRUE\ntrain,x,,db2,FALSE\ntest,y,SELECT 3,,TRUE\n')
    raw = readers.read_examples(spark, str(path))
    got = [(r["row_idx"], r["question"], r["db_dump"]) for r in raw.orderBy("row_idx").collect()]
    assert got == [(0, 'How\nmany "cats"?', None), (1, "x", None), (2, "y", None)]
    readers.land_examples(raw, str(tmp_path / "landed"))
    back = spark.read.parquet(str(tmp_path / "landed"))
    loaded = examples.load_examples(back, "test").collect()
    assert [(r["example_id"], r["category"], r["gold_queries"]) for r in loaded] == [("test_0", "AA", ["SELECT 1", "SELECT 2"])]
    both = readers.read_sources(spark, {"ambrosia": str(tmp_path / "landed"), "bird_dev": str(tmp_path / "landed")})
    assert {r["dataset"]: r["count"] for r in both.groupBy("dataset").count().collect()} == {"ambrosia": 3, "bird": 3}
    assert readers.source_for("bird", {"bird_train": "t", "bird_dev": "d"}, retrieval=True) == "t"
    with pytest.raises(ValueError):
        readers.source_for("other", {})
    with pytest.raises(ValueError, match="empty"):
        examples.load_corpus(back)


def test_results_checkpoint_and_resume(spark, tmp_path):
    path = str(tmp_path / "out")
    schema = "id string, f1 double, written_at bigint"
    assert read_checkpoint(spark, path + "/detailed", schema).count() == 0
    first = spark.createDataFrame([("a", 0.1), ("b", 0.2)], "id string, f1 double")
    total = first.agg(F.count("*").alias("n"))
    readers.write_results(first, total, path, {"batch": 1, "api_key": "s3cret"})
    readers.write_results(spark.createDataFrame([("b", 0.9)], "id string, f1 double"), total, path, {"batch": 2, "api_key": "s3cret"})
    done = read_checkpoint(spark, path + "/detailed", schema)
    assert {r["id"]: r["f1"] for r in done.collect()} == {"a": 0.1, "b": 0.9}
    todo = pending(spark.createDataFrame([("a",), ("c",)], "example_id string"), done)
    assert [r["example_id"] for r in todo.collect()] == ["c"]
    summary = spark.read.json(path + "/summary").first()
    assert summary["n"] == 2 and json.loads(summary["config"]) == {"batch": 2}


def test_reports_splits_and_vectors_on_disk(spark, tmp_path):
    df = spark.createDataFrame([("U", "U"), ("AA", "AU")], "t string, p string")
    readers.write_classification_report(df, "t", "p", str(tmp_path))
    assert spark.read.json(str(tmp_path / "report_test")).count() == 6
    rows = spark.createDataFrame([("test", 'say "hi"\nyou')], "split string, question string")
    readers.write_split(rows, str(tmp_path / "csv"))
    assert readers.read_examples(spark, str(tmp_path / "csv")).first()["question"] == 'say "hi"\nyou'
    readers.write_split(rows, str(tmp_path / "pq"), "parquet")
    with pytest.raises(ValueError):
        readers.write_split(rows, str(tmp_path / "x"), "xml")
    vectors = spark.createDataFrame([(1, [0.5, 0.5])], "vec_id long, embedding array<float>")
    version = readers.content_hash(vectors)
    assert version == readers.content_hash(vectors.repartition(3)) != readers.content_hash(vectors.withColumn("vec_id", F.lit(2)))
    place = (str(tmp_path / "vec"), "ambrosia", "train", version)
    assert readers.load_vectors(spark, *place) is None
    readers.save_vectors(vectors, *place)
    assert readers.load_vectors(spark, *place).count() == 1
    assert readers.load_vectors(spark, *place, rebuild=True) is None
    stages = reports.reward_stages(spark.createDataFrame([("scope", 0, 0.5)], "stage string, epoch int, reward double"))
    readers.write_stage_results(stages, str(tmp_path / "stages"), {"seed": 1, "api_key": "x"})
    assert json.loads(spark.read.json(str(tmp_path / "stages")).first()["config"]) == {"seed": 1}


def test_rows_are_numbered_by_file_and_place(spark, tmp_path):
    for name, first in (("b", 3), ("a", 0)):
        (tmp_path / f"{name}.csv").write_text("split,question\n" + "".join(f"test,q{first + k}\n" for k in range(3)))
    got = readers.read_examples(spark, str(tmp_path)).orderBy("row_idx").collect()
    assert [(r["row_idx"], r["question"]) for r in got] == [(k, f"q{k}") for k in range(6)]


def test_last_row_wins_without_times(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.json").write_text("".join(json.dumps({"id": i, "f1": k + j / 10}) + "\n" for j in range(3) for i in "ab"))
        os.utime(tmp_path / f"{k}.json", (1000 + k, 1000 + k))
    assert {r["id"]: r["f1"] for r in read_checkpoint(spark, str(tmp_path), "id string, f1 double").collect()} == {"a": 2.2, "b": 2.2}


def test_dense_index_is_dense_and_ordered(spark):
    df = spark.range(1000).withColumn("k", (F.col("id") * 7919) % 1009).repartition(7)
    got = dense_index(df, "i", "k").orderBy("k").select("i").collect()
    assert [r["i"] for r in got] == list(range(1000))


def test_group_split_bounds(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 37).alias("g"))
    out = curate.group_split(df, "g")
    audit = {r["split"]: (r["groups"], r["shared_groups"]) for r in reports.split_audit(out, "split", "g").collect()}
    assert audit == {"few_shot_examples": (29, 0), "test": (4, 0), "validation": (4, 0)}
    assert out.count() == 1000


def test_statement_packs(spark):
    got = {r["example_id"]: r for r in curate_checks.run_pack_scores(spark, SF).collect()}
    p = {k: (r["status"], round(r["precision"], 3), round(r["recall"], 3), round(r["f1_flex"], 3)) for k, r in got.items()}
    assert p == {
        "1": ("ok", 0.5, 0.5, 0.667), "2": ("ok", 0.5, 1.0, 0.667), "3": ("ok", 0.0, 0.0, 0.0),
        "4": ("gold_duplicate", 0.0, 0.0, 0.0), "5": ("unanswerable", 0.0, 0.0, 0.0), "6": ("ok", 0.0, 0.0, 1.0),
        "7": ("ok", 0.0, 0.0, round(2 / 3, 3)), "8": ("ok", 1.0, 1.0, 1.0)}


def test_databases_are_kept_apart_and_runs_resume(spark, tmp_path):
    data = {"one": spark.createDataFrame([(1, b"\x01", None)], "a int, b binary, c string"),
            "two": spark.createDataFrame([(2, b"\x02", "x")], "a int, b binary, c string")}
    statements = spark.createDataFrame(
        [(d, "pred", "p0", 0, "SELECT a, b, c, a > 1 AS d, date'2024-01-02' AS e, array(a) AS f FROM t", d) for d in data]
        + [("one", "pred", "p1", 1, "DROP TABLE t", "one"), ("one", "pred", "p2", 2, "SELECT 1/0 AS z FROM t", "one")],
        "example_id string, side string, query_id string, pos int, sql string, db_id string")
    out = str(tmp_path / "runs")
    runs, cells = run_sql.run_statements(spark, statements, lambda d: {"t": data[d]}, out)
    ok = {(r["example_id"], r["query_id"]): r["ok"] for r in runs.collect()}
    assert ok == {("one", "p0"): True, ("two", "p0"): True, ("one", "p1"): False, ("one", "p2"): False}
    got = {(r["example_id"], r["col_idx"]): (r["kind"], r["num"], r["str"]) for r in cells.collect()}
    assert got[("one", 0)] == ("num", 1.0, None) and got[("two", 0)] == ("num", 2.0, None)
    assert got[("one", 1)] == ("bin", None, "01") and got[("one", 2)] == ("null", None, None)
    assert got[("two", 3)] == ("num", 1.0, None) and got[("one", 4)] == ("str", None, "2024-01-02")
    assert got[("one", 5)] == ("str", None, "[1]")
    again, same = run_sql.run_statements(spark, statements, lambda d: 1 / 0, out)
    assert again.count() == 4 and same.count() == cells.count()


def test_stream_scores_what_arrives_once(spark, tmp_path):
    source, out, ck = (str(tmp_path / d) for d in ("in", "out", "ck"))

    def write(kind, part, rows):
        folder = tmp_path / "in" / kind / (f"part={part}" if kind != "markers" else "")
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{part}.json").write_text("\n".join(map(json.dumps, rows)))

    def arrive(name, value, rows=1, missing=0):
        side = [("gold", "g0", "a"), ("pred", "p0", "b")]
        write("runs", name, [{"example_id": name, "side": s, "query_id": q, "pos": 0, "sql": t, "ordered": False, "ok": True} for s, q, t in side])
        cells = [{"example_id": name, "side": s, "query_id": q, "row_idx": r, "col_idx": 0, "kind": "num", "num": v + r}
                 for (s, q, _), v in zip(side, (1.0, value)) for r in range(rows)]
        write("cells", name, cells[missing:])
        write("markers", name, [{"example_id": name, "part": name, "n_runs": 2, "n_cells": len(cells)}])

    arrive("hit", 1.0)
    ss.score_stream(ss.read_markers(spark, source), source, out, ck).awaitTermination()
    arrive("miss", 5.0)
    arrive("long", 1.0, rows=3000)
    arrive("short", 1.0, missing=1)
    ss.score_stream(ss.read_markers(spark, source), source, out, ck).awaitTermination()
    got = {r["example_id"]: r["f1"] for r in spark.read.parquet(out + "/scores").collect()}
    assert got == {"hit": 1.0, "miss": 0.0, "long": 1.0}
    assert ss.running_totals(spark, out).first()["n"] == 3
    errors = spark.read.parquet(out + "/errors").collect()
    assert [(r["example_id"], r["status"], r["error"]) for r in errors] == [("short", "incomplete", "2 of 2 runs, 1 of 2 cells")]
    assert {r["status"]: r["n"] for r in ss.error_totals(spark, out).collect()} == {"incomplete": 1}


def test_evaluate_reads_initial_statements_too(spark):
    runs, cells = fixtures.multi_runs(spark, SF).drop("res"), fixtures.multi_cells(spark, SF)
    def initial(df):
        return df.filter("side = 'gold' OR query_id <= 'p2'").withColumn(
            "side", F.when(F.col("side") == "pred", "pred_initial").otherwise("gold"))
    before = score.evaluate(initial(runs), initial(cells), pred_side="pred_initial")
    after = score.evaluate(runs, cells)
    gain = score.correction_gain(after, before).agg(F.min("f1"), F.max("f1"), F.count("f1_improvement")).first()
    assert 0 <= gain[0] <= gain[1] <= 1 and gain[2] == after.count()


def test_large_caps_rank_by_sort(spark, monkeypatch):
    from sqlverdict.operators import numbering
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 2 == 0, "b").alias("g"))
    small = curate.capped_sample(df, 200, ["g"]).orderBy("id").collect()
    monkeypatch.setattr(numbering, "GROUP_LIMIT", 0)
    large = curate.capped_sample(df, 200, ["g"]).orderBy("id").collect()
    assert small == large and len(large) == 600
