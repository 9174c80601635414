"""Registered queries for scoring and reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sqlverdict.operators import reports, score
from sqlverdict.plans import compare_checks as cc
from sqlverdict.plans import fixtures as fx
from sqlverdict.sources.checkpoint import pending


def _multi(spark, sf):
    return fx.multi_runs(spark, sf).drop("res"), fx.multi_cells(spark, sf)


def statement_dedup(spark, sf):
    runs, _ = _multi(spark, sf)
    return score.dedup_statements(runs).select("example_id", "side", "pos", "sql")


def gold_duplicates(spark, sf):
    return score.gold_duplicates(*_multi(spark, sf))


def unique_results(spark, sf):
    return score.unique_results(*_multi(spark, sf))


def result_dedup(spark, sf):
    return score.result_dedup(*_multi(spark, sf)).select("example_id", "pos")


def _strict_prf(dedup):
    def query(spark, sf):
        runs, cells = _multi(spark, sf)
        distinct = score.dedup_statements(runs)
        kept = score.result_dedup(runs, cells) if dedup else distinct.filter("side = 'pred'")
        out = score.score_examples(runs, score.match_counts(distinct.filter("side = 'gold'").unionByName(kept), cells), kept)
        return out.select("example_id", "num_queries", "num_unique_queries", "n_gold", "precision", "recall", "f1",
                          "all_found", "one_found", "num_correct")
    return query


def example_prf_flex(spark, sf):
    runs, cells = fx.cell_runs(spark, sf), fx.cells(spark, sf)
    out = score.score_examples(runs, score.match_counts(runs, cells, flex=True))
    return out.select("example_id", "precision", "recall", "f1", "precision_flex", "recall_flex", "f1_flex", "all_found_flex")


def evaluate_guarded(spark, sf):
    runs, cells = _multi(spark, sf)
    return score.evaluate(runs, cells).select(
        "example_id", "status", "precision", "recall", "f1", "all_found", "num_queries", "num_unique_queries",
        "num_executable", "n_gold")


def exec_summary(spark, sf):
    return score.execution_summary(_multi(spark, sf)[0])


def exec_errors_first(spark, sf):
    return score.execution_errors(_multi(spark, sf)[0], first=1)


def reclassify(spark, sf):
    runs, _ = _multi(spark, sf)
    only = runs.filter("side = 'pred' AND (pos IN (0, 3) OR example_id % 5 = 0)")
    cats = runs.select("example_id", F.when(F.col("example_id") % 4 == 0, "U").otherwise("AA").alias("pred_category")).distinct()
    return score.reclassify(cats, only).select("example_id", "pred_category", "reclassified_to_u", "num_valid")


def correction_gain(spark, sf):
    """Final list against the same list with only its first three statements."""
    runs, cells = _multi(spark, sf)

    def f1(part):
        return score.score_examples(part, score.match_counts(score.dedup_statements(part), cells)).select("example_id", "f1")

    first = f1(runs.filter("(side = 'gold' OR pos <= 2) AND example_id % 3 <> 1"))
    return score.correction_gain(f1(runs), first).select(
        "example_id", "f1", "initial_f1", "correction_applied", "f1_improvement")


def error_kinds(spark, sf):
    runs, cells = _multi(spark, sf)
    return score.error_counts(score.example_status(runs, cells), runs)


def resume_antijoin(spark, sf):
    ex = fx.examples(spark, sf)
    done = ex.filter("doc_id % 4 = 1").select(F.col("example_id").alias("id"))
    return pending(ex, done).select("example_id")


def resume_totals(spark, sf):
    """Totals over finished and new rows together equal totals over all rows."""
    s = fx.scores(spark, sf)
    done, new = s.filter("doc_id % 4 = 1"), s.filter("doc_id % 4 <> 1")
    return reports.coverage(done.unionByName(new), "gt_category").select("gt_category", "count", "avg_f1", "full_coverage")


def _report(fn, *args):
    def query(spark, sf):
        return fn(fx.scores(spark, sf), *args)
    return query


def _labels(fn, *args):
    def query(spark, sf):
        return fn(fx.examples(spark, sf), *args)
    return query


def tracker_grid(spark, sf):
    s = fx.scores(spark, sf)
    return reports.tracker_grid(s.select(
        F.when(F.col("gt_category") == "AA", "ambig").otherwise("unambig").alias("main_key"), "ambig_type", "precision",
        "recall", "f1", (F.col("recall") > 0).alias("one_found"), (F.col("recall") >= 1).alias("all_found"))
    ).select("main_key", "ambig_type", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "one_found", "all_found")])


def study_grid(spark, sf):
    s = fx.scores(spark, sf)
    return reports.study_grid({"base": s, "rag": s.filter("doc_id % 2 = 0"), "rag_lora": s.filter("doc_id % 3 = 0")})


def reward_summary(spark, sf):
    return reports.reward_summary(fx.rewards(spark, sf), "stage")


def throughput(spark, sf):
    return reports.throughput(fx.table(spark, sf, "events"), "ts", "event_type")


def topk_accuracy(spark, sf):
    ex = fx.examples(spark, sf)
    return reports.topk_accuracy(
        ex.withColumn("preds", F.array("pred_category", F.lit("AA"), F.lit("AU"))), "preds", "gt_category", by="ambig_type")


def quality_rows(spark, sf):
    """Parts as interpretations with scores derived from their columns."""
    p = fx.table(spark, sf, "part")
    return p.select(
        F.col("p_partkey").alias("id"), "p_brand", (F.col("p_size") % 11).cast("double").alias("overall_score"),
        ((F.col("p_size") % 7) / 7).alias("semantic_similarity"), ((F.col("p_size") % 5) / 5).alias("schema_correctness"),
        (F.col("p_size") % 3 > 0).alias("execution_success"),
        F.when(F.col("p_size") % 4 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("issues"))


def quality_summary(spark, sf):
    return reports.quality_summary(quality_rows(spark, sf), "p_brand")


def quality_ranking(spark, sf):
    from sqlverdict.operators.quality import rank_by_score
    return rank_by_score(quality_rows(spark, sf), "p_brand").select("p_brand", "id", "rank")


QUERIES = {
    "statement_dedup": statement_dedup, "gold_duplicates": gold_duplicates, "unique_results": unique_results,
    "result_dedup": result_dedup, "example_prf": _strict_prf(False), "example_prf_dedup": _strict_prf(True),
    "example_prf_flex": example_prf_flex, "evaluate_guarded": evaluate_guarded, "exec_summary": exec_summary,
    "exec_errors_first": exec_errors_first, "reclassify": reclassify, "correction_gain": correction_gain,
    "error_kinds": error_kinds, "resume_antijoin": resume_antijoin, "resume_totals": resume_totals,
    "routing_accuracy": _report(reports.routing_accuracy), "confusion": _report(reports.confusion),
    "category_stats": _report(reports.category_stats), "coverage": _report(reports.coverage),
    "by_type_total": _report(reports.by_type_total), "correction_stats": _report(reports.correction_stats),
    "reclassified_count": _report(reports.reclassified_count), "tracker_grid": tracker_grid,
    "class_metrics": _labels(reports.class_metrics, "gt_category", "pred_category"),
    "class_report": _labels(reports.class_report, "gt_category", "pred_category"),
    "class_breakdown": _labels(reports.class_breakdown, "gt_category", "pred_category"),
    "label_distribution": _labels(reports.label_distribution, "dataset", "gt_category"),
    "topk_accuracy": topk_accuracy, "quality_summary": quality_summary, "quality_ranking": quality_ranking,
    "study_grid": study_grid, "throughput": throughput,
    "reward_epochs": lambda spark, sf: reports.reward_epochs(fx.rewards(spark, sf)),
    "reward_stages": lambda spark, sf: reports.reward_stages(fx.rewards(spark, sf)),
    "reward_summary": reward_summary,
}

_DUPS = """kd AS (SELECT ck, pos AS j, ok, bag, rowbags, ordered, len(bag) = 0 AS hollow FROM dd WHERE side = 'pred'),
dup AS (SELECT b.ck, b.j, list(a.j) FILTER (CASE WHEN NOT b.ok THEN NOT a.ok WHEN NOT a.ok THEN b.hollow
    WHEN a.hollow AND b.hollow THEN true WHEN a.hollow OR b.hollow THEN false
    WHEN a.ordered OR b.ordered THEN a.rowbags = b.rowbags ELSE a.bag = b.bag END) AS di
  FROM kd b LEFT JOIN kd a ON a.ck = b.ck AND a.j < b.j GROUP BY 1, 2),
gr(ck, j, kept) AS (SELECT DISTINCT ck, -1, CAST([] AS INTEGER[]) FROM kd
  UNION ALL SELECT gr.ck, gr.j + 1, CASE WHEN d.j IS NULL OR list_has_any(kept, coalesce(d.di, [])) THEN kept ELSE list_append(kept, gr.j + 1) END
  FROM gr LEFT JOIN dup d ON d.ck = gr.ck AND d.j = gr.j + 1 WHERE gr.j < 6),
keep AS (SELECT ck, unnest(kept) AS pos FROM gr WHERE j = 6)"""

_BASE = "WITH RECURSIVE " + fx.SQL_RUNS


def _prf(kept: str, extra: str = "") -> str:
    return _BASE + extra + f""", kp AS ({kept}),
pm AS (SELECT g.ck, g.sql AS gsql, p.pos AS ppos FROM dd g JOIN kp p ON p.ck = g.ck WHERE g.side = 'gold' AND g.ok AND p.ok
  AND CASE WHEN len(g.bag) = 0 OR len(p.bag) = 0 THEN len(g.bag) = len(p.bag) WHEN g.ordered THEN g.rowbags = p.rowbags ELSE g.bag = p.bag END),
sz AS (SELECT ck, count(*) FILTER (side = 'pred') AS num_queries, count(*) FILTER (side = 'gold') AS n_gold FROM runs GROUP BY 1),
pf AS (SELECT sz.ck, num_queries, n_gold, u.n AS num_unique_queries, coalesce(mp, 0) / u.n AS p, coalesce(mg, 0) / n_gold AS r, coalesce(mg, 0) AS mg
  FROM sz JOIN (SELECT ck, count(*) AS n FROM kp GROUP BY 1) u USING (ck)
  LEFT JOIN (SELECT ck, count(DISTINCT gsql) AS mg, count(DISTINCT ppos) AS mp FROM pm GROUP BY 1) m USING (ck))"""


_PRF_TAIL = """ SELECT ck AS example_id, num_queries, num_unique_queries, n_gold, p AS precision, r AS recall,
CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1, mg = n_gold AS all_found, r > 0 AS one_found, mg AS num_correct FROM pf"""
_PLAIN = _prf("SELECT * FROM dd WHERE side = 'pred'")
_KEPT = _prf("SELECT dd.* FROM dd JOIN keep USING (ck, pos) WHERE side = 'pred'", ",\n" + _DUPS)

_COVER = ", ".join(
    f"avg(precision{t}) AS avg_precision{t}, avg(recall{t}) AS avg_recall{t}, avg(f1{t}) AS avg_f1{t}, "
    f"count(*) FILTER (recall{t} >= 1) AS full_coverage{t}, count(*) FILTER (recall{t} > 0) AS single_coverage{t}, "
    f"avg(CASE WHEN recall{t} >= 1 THEN 1.0 ELSE 0 END) AS full_coverage_rate{t}, avg(CASE WHEN recall{t} > 0 THEN 1.0 ELSE 0 END) AS single_coverage_rate{t}"
    for t in ("", "_flex"))


def _scores(tail: str) -> str:
    return f"WITH {fx.SQL_SCORES}\n{tail}"


_CLASSES = f"""WITH {fx.SQL_EXAMPLES}, cl AS (SELECT label, sum(tp) AS tp, sum(s) AS support, sum(p) AS said FROM (
  SELECT gt_category AS label, CASE WHEN gt_category = pred_category THEN 1 ELSE 0 END AS tp, 1 AS s, 0 AS p FROM fx_examples
  UNION ALL SELECT pred_category, 0, 0, 1 FROM fx_examples) GROUP BY 1),
pc AS (SELECT label, tp, support, p AS precision, r AS recall, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1
  FROM (SELECT *, coalesce(tp / nullif(said, 0), 0) AS p, coalesce(tp / nullif(support, 0), 0) AS r FROM cl))"""

_STATUS = """gd AS (SELECT b.ck, min(b.pos) AS dup_pos FROM dd a JOIN dd b ON a.ck = b.ck AND a.pos < b.pos AND a.exact = b.exact
  WHERE a.side = 'gold' AND b.side = 'gold' AND a.ok AND b.ok GROUP BY 1),
es AS (SELECT ck, CASE WHEN bool_or(side = 'gold' AND upper(trim(sql)) = 'UNANSWERABLE') THEN 'unanswerable' WHEN bool_or(side = 'gold' AND NOT ok) THEN 'gold_error'
  WHEN any_value(gd.dup_pos) IS NOT NULL THEN 'gold_duplicate' ELSE 'ok' END AS status FROM runs LEFT JOIN gd USING (ck) GROUP BY 1)"""

ORACLE = {
    "statement_dedup": _BASE + " SELECT ck AS example_id, side, pos, sql FROM dd",
    "gold_duplicates": _BASE + f", {_STATUS} SELECT ck AS example_id, dup_pos FROM gd",
    "unique_results": _BASE + """ SELECT ck AS example_id, count(DISTINCT CASE WHEN ok THEN CAST(exact AS VARCHAR) ELSE 'failed' END) AS n_unique
FROM dd WHERE side = 'pred' GROUP BY 1""",
    "result_dedup": _BASE + ",\n" + _DUPS + " SELECT ck AS example_id, pos FROM keep",
    "example_prf": _PLAIN + _PRF_TAIL,
    "example_prf_dedup": _KEPT + _PRF_TAIL,
    "example_prf_flex": cc._sql(cc.SQL_BAG, cc.SQL_ROWBAG, cc.SQL_NORM, cc.SQL_POS, cc.SQL_MAP, cc.SQL_FLEX, tail="""
SELECT ck AS example_id, s AS precision, s AS recall, s AS f1, x AS precision_flex, x AS recall_flex, x AS f1_flex, x = 1 AS all_found_flex
FROM (SELECT w.ck, CAST(CASE WHEN f.strict THEN 1 ELSE 0 END AS DOUBLE) AS s, CAST(CASE WHEN f.rule <> 'none' THEN 1 ELSE 0 END AS DOUBLE) AS x
  FROM (SELECT DISTINCT ck FROM fx_wide) w LEFT JOIN flex f ON f.example_id = w.ck)"""),
    "evaluate_guarded": _KEPT + f""", {_STATUS}
SELECT ck AS example_id, status, CASE WHEN status = 'ok' THEN p ELSE 0 END AS precision, CASE WHEN status = 'ok' THEN r ELSE 0 END AS recall,
CASE WHEN status = 'ok' AND p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1, status = 'ok' AND mg = n_gold AS all_found, num_queries,
CASE WHEN status = 'ok' THEN num_unique_queries ELSE 0 END AS num_unique_queries,
CASE status WHEN 'ok' THEN num_queries - nf WHEN 'unanswerable' THEN num_queries ELSE 0 END AS num_executable,
CASE WHEN status = 'unanswerable' THEN 0 ELSE n_gold END AS n_gold
FROM pf JOIN es USING (ck) JOIN (SELECT ck, count(*) FILTER (NOT ok) AS nf FROM dd WHERE side = 'pred' GROUP BY 1) USING (ck)""",
    "exec_summary": _BASE + """ SELECT ck AS example_id, count(*) AS num_queries, count(*) FILTER (ok) AS num_valid, bool_and(ok) AS success
FROM runs WHERE side = 'pred' GROUP BY 1""",
    "exec_errors_first": _BASE + """ SELECT ck AS example_id, min(pos) AS pos, concat('Query ', min(pos) + 1, ' failed: no such column') AS message
FROM runs WHERE side = 'pred' AND NOT ok GROUP BY 1""",
    "reclassify": _BASE + """ SELECT ck AS example_id, CASE WHEN ck % 4 = 0 OR nv = 0 THEN 'U' ELSE 'AA' END AS pred_category,
ck % 4 <> 0 AND nv = 0 AS reclassified_to_u, nv AS num_valid
FROM (SELECT ck, count(*) FILTER (side = 'pred' AND ok AND (pos IN (0, 3) OR ck % 5 = 0)) AS nv FROM runs GROUP BY 1)""",
    "correction_gain": _PLAIN + """, pm1 AS (SELECT pm.* FROM pm WHERE ppos <= 2), b AS (
SELECT sz.ck, coalesce(mp, 0) / u.n AS p, coalesce(mg, 0) / n_gold AS r FROM sz JOIN (SELECT ck, count(*) AS n FROM kp WHERE pos <= 2 GROUP BY 1) u USING (ck)
  LEFT JOIN (SELECT ck, count(DISTINCT gsql) AS mg, count(DISTINCT ppos) AS mp FROM pm1 GROUP BY 1) m USING (ck) WHERE ck % 3 <> 1)
SELECT pf.ck AS example_id, CASE WHEN pf.p + pf.r > 0 THEN 2 * pf.p * pf.r / (pf.p + pf.r) ELSE 0 END AS f1,
CASE WHEN b.p IS NULL THEN NULL WHEN b.p + b.r > 0 THEN 2 * b.p * b.r / (b.p + b.r) ELSE 0 END AS initial_f1, b.p IS NOT NULL AS correction_applied,
CASE WHEN pf.p + pf.r > 0 THEN 2 * pf.p * pf.r / (pf.p + pf.r) ELSE 0 END - CASE WHEN b.p IS NULL THEN NULL WHEN b.p + b.r > 0 THEN 2 * b.p * b.r / (b.p + b.r) ELSE 0 END AS f1_improvement
FROM pf LEFT JOIN b ON b.ck = pf.ck""",
    "error_kinds": _BASE + f""", {_STATUS} SELECT status AS kind, count(*) AS n FROM es WHERE status IN ('gold_error', 'gold_duplicate') GROUP BY 1
UNION ALL SELECT 'pred_error', count(*) FROM runs WHERE side = 'pred' AND NOT ok""",
    "resume_antijoin": f"WITH {fx.SQL_EXAMPLES} SELECT example_id FROM fx_examples WHERE doc_id % 4 <> 1",
    "resume_totals": _scores("SELECT gt_category, count(*) AS count, avg(f1) AS avg_f1, count(*) FILTER (recall >= 1) AS full_coverage FROM pop GROUP BY 1"),
    "routing_accuracy": _scores("""SELECT count(*) AS total, count(*) FILTER (gt_category = pred_category) AS correct,
avg(CASE WHEN gt_category = pred_category THEN 1.0 ELSE 0 END) AS accuracy FROM sc"""),
    "confusion": _scores("SELECT gt_category, " + ", ".join(
        f"count(*) FILTER (pred_category = '{c}') AS {c}" for c in ("U", "AU", "AA")) + " FROM sc GROUP BY 1"),
    "category_stats": _scores("""SELECT gt_category, count(*) AS total, count(*) FILTER (gt_category = pred_category) AS correct,
any_value(a) AS avg_f1 FROM sc LEFT JOIN (SELECT gt_category, avg(f1) AS a FROM pop GROUP BY 1) USING (gt_category) GROUP BY 1"""),
    "coverage": _scores(f"SELECT count(*) AS count, {_COVER} FROM pop"),
    "by_type_total": _scores(f"SELECT ambig_type, GROUPING(ambig_type) AS is_total, count(*) AS count, {_COVER} FROM pop GROUP BY GROUPING SETS ((ambig_type), ())"),
    "correction_stats": _scores("""SELECT count(*) AS applied, coalesce(sum(f1_improvement), 0) AS total_gain, coalesce(avg(f1_improvement), 0) AS avg_gain
FROM pop WHERE pred_category <> 'U' AND correction_applied"""),
    "reclassified_count": _scores("SELECT count(*) FILTER (reclassified_to_u) AS reclassified FROM sc"),
    "tracker_grid": _scores("""SELECT g.main_key, g.ambig_type, """ + ", ".join(
        f"round(coalesce(avg(v.{c}), 0), 6) AS {c}" for c in ("precision", "recall", "f1", "one_found", "all_found")) + """
FROM (SELECT * FROM (VALUES ('ambig'), ('unambig')) a(main_key), (VALUES ('scope'), ('attachment'), ('vague'), ('total')) b(ambig_type)) g
LEFT JOIN (SELECT CASE WHEN gt_category = 'AA' THEN 'ambig' ELSE 'unambig' END AS main_key, ambig_type, coalesce(precision, 0) AS precision, coalesce(recall, 0) AS recall,
  coalesce(f1, 0) AS f1, CASE WHEN recall > 0 THEN 1 ELSE 0 END AS one_found, CASE WHEN recall >= 1 THEN 1 ELSE 0 END AS all_found
  FROM sc WHERE ambig_type IN ('scope', 'attachment', 'vague')) v ON v.main_key = g.main_key AND (v.ambig_type = g.ambig_type OR g.ambig_type = 'total') GROUP BY 1, 2"""),
    "class_metrics": _CLASSES + " SELECT sum(tp) / sum(support) AS accuracy, " + ", ".join(
        f"avg({m}) AS {m}_macro, sum({m} * support) / sum(support) AS {m}_weighted" for m in ("precision", "recall", "f1")) + " FROM pc",
    "class_report": _CLASSES + """ SELECT 0 AS ord, label, precision, recall, f1, support FROM pc
UNION ALL SELECT 1, 'accuracy', NULL, NULL, sum(tp) / sum(support), sum(support) FROM pc
UNION ALL SELECT 2, 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM pc
UNION ALL SELECT 3, 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM pc""",
    "class_breakdown": f"""WITH {fx.SQL_EXAMPLES} SELECT gt_category AS true_label, pred_category AS pred_label, count(*) AS n, t AS total, k AS correct, k / t AS accuracy, 100 * count(*) / t AS pct
FROM fx_examples JOIN (SELECT gt_category, count(*) AS t, count(*) FILTER (gt_category = pred_category) AS k FROM fx_examples GROUP BY 1) USING (gt_category) GROUP BY 1, 2, t, k""",
    "label_distribution": f"""WITH {fx.SQL_EXAMPLES} SELECT dataset AS split, gt_category AS label, count(*) AS n, 100 * count(*) / t AS pct
FROM fx_examples JOIN (SELECT dataset, count(*) AS t FROM fx_examples GROUP BY 1) USING (dataset) GROUP BY 1, 2, t""",
    "topk_accuracy": f"""WITH {fx.SQL_EXAMPLES} SELECT ambig_type, count(*) AS count, avg(CASE WHEN gt_category = pred_category THEN 1.0 ELSE 0 END) AS top1_accuracy,
avg(CASE WHEN gt_category IN (pred_category, 'AA') THEN 1.0 ELSE 0 END) AS top2_accuracy FROM fx_examples GROUP BY 1""",
    "quality_summary": """SELECT p_brand, count(*) AS n, avg(p_size % 11) AS avg_overall, avg((p_size % 7) / 7) AS avg_semantic, avg((p_size % 5) / 5) AS avg_schema,
count(*) FILTER (p_size % 3 > 0) AS n_success, count(*) FILTER (p_size % 11 >= 9) AS excellent, count(*) FILTER (p_size % 11 BETWEEN 7 AND 8) AS good,
count(*) FILTER (p_size % 11 BETWEEN 5 AND 6) AS fair, count(*) FILTER (p_size % 11 < 5) AS poor, count(*) FILTER (p_size % 4 = 0) AS with_issues,
arg_max(p_partkey, CAST(p_size % 11 AS BIGINT) * 1000000000 - p_partkey) AS best_id FROM part GROUP BY 1""",
    "quality_ranking": "SELECT p_brand, p_partkey AS id, row_number() OVER (PARTITION BY p_brand ORDER BY p_size % 11 DESC, p_partkey) AS rank FROM part",
    "study_grid": _scores("""SELECT dataset, avg(f1) AS base, avg(f1) FILTER (doc_id % 2 = 0) AS rag, avg(f1) FILTER (doc_id % 3 = 0) AS rag_lora FROM pop GROUP BY 1"""),
    "throughput": """SELECT event_type, count(*) AS n, epoch(max(ts)) - epoch(min(ts)) AS seconds, count(*) / (epoch(max(ts)) - epoch(min(ts))) AS per_second FROM events GROUP BY 1""",
    "reward_epochs": f"""WITH {fx.SQL_REWARDS} SELECT stage, epoch, count(*) AS n, avg(reward) AS mean_reward, min(reward) AS min_quality, max(reward) AS max_quality FROM fx_rewards GROUP BY 1, 2""",
    "reward_stages": f"""WITH {fx.SQL_REWARDS} SELECT stage, CAST(sum(n) AS BIGINT) AS num_samples, count(*) AS epochs, max(m) AS best_reward
FROM (SELECT stage, epoch, count(*) AS n, avg(reward) AS m FROM fx_rewards GROUP BY 1, 2) GROUP BY 1""",
    "reward_summary": f"""WITH {fx.SQL_REWARDS} SELECT stage, min(reward) AS min_all, max(reward) AS max_all, avg(reward) AS mean_all,
min(reward) FILTER (reward <> 0.25) AS min_valid, max(reward) FILTER (reward <> 0.25) AS max_valid, avg(reward) FILTER (reward <> 0.25) AS mean_valid,
count(*) FILTER (reward = 0.25) AS at_default, count(*) AS n FROM fx_rewards GROUP BY 1""",
}

# Means and rates are sums of doubles in any order: both sides round them to six places.
_RATES = [f"{m}{t}" for t in ("", "_flex") for m in (
    "avg_precision", "avg_recall", "avg_f1", "full_coverage_rate", "single_coverage_rate")]
_ROUNDED = {
    "resume_totals": ["avg_f1"], "coverage": _RATES, "by_type_total": _RATES, "category_stats": ["avg_f1"],
    "correction_stats": ["total_gain", "avg_gain"], "throughput": ["seconds", "per_second"],
    "quality_summary": ["avg_overall", "avg_semantic", "avg_schema"], "study_grid": ["base", "rag", "rag_lora"],
    "class_metrics": ["accuracy", *[f"{m}_{k}" for m in ("precision", "recall", "f1") for k in ("macro", "weighted")]],
    "class_report": ["precision", "recall", "f1"], "class_breakdown": ["accuracy", "pct"], "label_distribution": ["pct"],
    "topk_accuracy": ["top1_accuracy", "top2_accuracy"], "reward_epochs": ["mean_reward"], "reward_stages": ["best_reward"],
    "reward_summary": ["mean_all", "mean_valid"],
}


def _rounding(query, names):
    def rounded(spark, sf):
        return query(spark, sf).withColumns({n: F.round(n, 6) for n in names})
    return rounded


for _name, _columns in _ROUNDED.items():
    QUERIES[_name] = _rounding(QUERIES[_name], _columns)
    _six = ", ".join(f"round({c}, 6) AS {c}" for c in _columns)
    ORACLE[_name] = f"SELECT * REPLACE ({_six}) FROM ({ORACLE[_name]})"
