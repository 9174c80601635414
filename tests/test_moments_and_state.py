"""Moments that survive an offset, a stored model, and the state of streamed examples."""

import json
import time

import numpy as np

from sqlverdict.operators import lda
from sqlverdict.streaming import score_stream as ss


def test_moments_keep_digits_at_a_large_offset(spark, tmp_path):
    rng = np.random.default_rng(1)
    x, y = rng.normal(0, 0.1, (600, 3)), rng.integers(0, 3, 600)
    x += y[:, None] * 0.3
    names = [f"c{k}" for k in y]

    def fit(offset, parts):
        rows = [(n, [float(v) for v in row + offset]) for n, row in zip(names, x)]
        return lda.lda_fit(spark.createDataFrame(rows, "label string, embedding array<double>").repartition(parts), "label")

    near, far = fit(0.0, 3), fit(1e8, 40)
    assert np.allclose(near.covariance, far.covariance, atol=1e-6) and np.allclose(near.means, far.means - 1e8, atol=1e-6)
    assert np.allclose(near.coef, far.coef, rtol=1e-3) and (near.counts == far.counts).all()
    lda.save_model(spark, near, str(tmp_path / "model"))
    again = lda.load_model(spark, str(tmp_path / "model"))
    docs = spark.createDataFrame([([float(v) for v in row],) for row in x[:50]], "embedding array<double>")
    assert [r["predictions"] for r in lda.lda_predict(docs, again).collect()] == [r["predictions"] for r in lda.lda_predict(docs, near).collect()]


def test_repeated_late_and_missing_pieces(spark, tmp_path):
    source, out, ck = (str(tmp_path / d) for d in ("in", "out", "ck"))
    n = 0

    def piece(example, part, side, value, pieces, data=True):
        nonlocal n
        n += 1
        query = {"example_id": example, "side": side, "query_id": side, "pos": 0, "sql": side, "ordered": False, "ok": True}
        cell = {"example_id": example, "side": side, "query_id": side, "row_idx": 0, "col_idx": 0, "kind": "num", "num": value}
        for kind, row in (("runs", query), ("cells", cell)) if data else ():
            folder = tmp_path / "in" / kind / f"part={part}"
            folder.mkdir(parents=True, exist_ok=True)
            (folder / f"{example}.json").write_text(json.dumps(row))
        (tmp_path / "in" / "markers").mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / "markers" / f"{n}.json").write_text(json.dumps({"example_id": example, "part": part, "n_runs": 1, "n_cells": 1, "pieces": pieces}))

    def go(patience=3_600_000):
        ss.score_stream(ss.read_markers(spark, source), source, out, ck, patience=patience).awaitTermination()

    def totals():
        return {r["status"]: r["n"] for r in ss.running_totals(spark, out).collect()}

    piece("a", "p1", "gold", 1.0, 2)
    piece("never", "p1", "gold", 1.0, 2)
    go()
    assert totals() == {}
    piece("a", "p2", "pred", 1.0, 2)  # the late piece
    go()
    assert totals() == {"ok": 1}
    piece("a", "p2", "pred", 1.0, 2, data=False)  # announced again
    piece("a", "p1", "gold", 1.0, 2, data=False)
    go(patience=1)
    assert totals() == {"ok": 1} and spark.read.parquet(out + "/scores").count() == 1
    piece("never", "p1", "gold", 1.0, 2, data=False)  # the same piece again, the other one never comes
    go(patience=1)
    time.sleep(0.1)
    piece("b", "p3", "gold", 1.0, 1)
    go(patience=1)
    errors = [(r["example_id"], r["error"]) for r in spark.read.parquet(out + "/errors").collect() if r["example_id"] == "never"]
    assert errors == [("never", "1 of 2 pieces")]
