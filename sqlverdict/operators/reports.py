"""Evaluation reports: plain aggregations over score tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sqlverdict.schema import AMBIGUITY_TYPES

METRICS = ("precision", "recall", "f1", "precision_flex", "recall_flex", "f1_flex")


def _hit():
    return F.col("gt_category") == F.col("pred_category")


def scored(scores: DataFrame) -> DataFrame:
    """The scoring population: answerable gold, zero where predicted ``U`` or not evaluated."""
    zero = F.col("pred_category") == "U"
    return scores.filter(F.col("gt_category").isin("AU", "AA")).withColumns({
        m: F.when(zero, 0.0).otherwise(F.coalesce(m, F.lit(0.0))) for m in METRICS if m in scores.columns
    })


def routing_accuracy(scores: DataFrame) -> DataFrame:
    return scores.agg(
        F.count("*").alias("total"), F.count_if(_hit()).alias("correct"),
        F.coalesce(F.avg(_hit().cast("double")), F.lit(0.0)).alias("accuracy"),
    )


def confusion(scores: DataFrame, labels=("U", "AU", "AA")) -> DataFrame:
    return scores.groupBy("gt_category").pivot("pred_category", list(labels)).count().na.fill(0)


def category_stats(scores: DataFrame) -> DataFrame:
    f1 = scored(scores).groupBy("gt_category").agg(F.avg("f1").alias("avg_f1"))
    totals = scores.filter(F.col("gt_category").isin("U", "AU", "AA")).groupBy("gt_category").agg(
        F.count("*").alias("total"), F.count_if(_hit()).alias("correct"))
    return totals.join(f1, "gt_category", "left")


def _coverage_aggs():
    out = [F.count("*").alias("count")]
    for tail in ("", "_flex"):
        p, r, f = ("precision" + tail, "recall" + tail, "f1" + tail)
        full, one = F.col(r) >= 1.0, F.col(r) > 0
        out += [F.avg(c).alias("avg_" + c) for c in (p, r, f)] + [
            F.count_if(full).alias("full_coverage" + tail), F.count_if(one).alias("single_coverage" + tail),
            F.avg(full.cast("double")).alias("full_coverage_rate" + tail),
            F.avg(one.cast("double")).alias("single_coverage_rate" + tail),
        ]
    return out


def coverage(scores: DataFrame, *by: str) -> DataFrame:
    """Means and coverage, strict and flexible, over the scoring population."""
    return scored(scores).groupBy(*by).agg(*_coverage_aggs())


def by_type_total(scores: DataFrame) -> DataFrame:
    """Coverage per ambiguity type plus one total row (``is_total``)."""
    base = scored(scores)
    kind = F.col("ambig_type")
    return base.groupingSets([[kind], []], kind).agg(
        F.grouping("ambig_type").cast("int").alias("is_total"), *_coverage_aggs())


def correction_stats(scores: DataFrame) -> DataFrame:
    seen = scores.filter(F.col("gt_category").isin("AU", "AA") & (F.col("pred_category") != "U") & F.col("correction_applied"))
    return seen.agg(
        F.count("*").alias("applied"), F.coalesce(F.sum("f1_improvement"), F.lit(0.0)).alias("total_gain"),
        F.coalesce(F.avg("f1_improvement"), F.lit(0.0)).alias("avg_gain"))


def reclassified_count(scores: DataFrame) -> DataFrame:
    return scores.agg(F.count_if("reclassified_to_u").alias("reclassified"))


def tracker_grid(scores: DataFrame) -> DataFrame:
    """Mean metrics for the fixed grid of main key x type, with totals; no rows means 0."""
    names = ("recall", "precision", "f1", "one_found", "all_found")
    spark = scores.sparkSession
    grid = spark.createDataFrame(
        [(m, t) for m in ("ambig", "unambig") for t in (*AMBIGUITY_TYPES, "total")], "main_key string, ambig_type string")
    values = scores.select(
        "main_key", "ambig_type", *[F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in names])
    known = values.filter(F.col("ambig_type").isin(*AMBIGUITY_TYPES))
    means = known.groupingSets(
        [[F.col("main_key"), F.col("ambig_type")], [F.col("main_key")]], F.col("main_key"), F.col("ambig_type")
    ).agg(*[F.avg(n).alias(n) for n in names], F.count("*").alias("n")).withColumn(
        "ambig_type", F.coalesce("ambig_type", F.lit("total")))
    return grid.join(means, ["main_key", "ambig_type"], "left").fillna(0)


# --- classifier reports ---------------------------------------------------


def _per_class(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """tp, support and predicted count per label, from one confusion aggregation."""
    counts = df.groupBy(F.col(truth).alias("t"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))
    sides = F.explode(F.array(
        F.struct(F.col("t").alias("label"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("said")),
        F.struct(F.col("p").alias("label"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("said")),
    ))
    hit = F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)
    flat = counts.select(hit.alias("hit"), sides.alias("s")).select("hit", "s.*")
    per = flat.groupBy("label").agg(
        (F.sum("hit") / 2).alias("tp"), F.sum("support").alias("support"), F.sum("said").alias("said"))
    zero = F.lit(0.0)
    per = per.withColumns({
        "precision": F.coalesce(F.try_divide("tp", "said"), zero),
        "recall": F.coalesce(F.try_divide("tp", "support"), zero),
    })
    f1 = F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return per.withColumn("f1", F.coalesce(f1, zero))


def class_metrics(df: DataFrame, truth: str, pred: str) -> DataFrame:
    per = _per_class(df, truth, pred)
    aggs = [F.try_divide(F.sum("tp"), F.sum("support")).alias("accuracy")]
    for m in ("precision", "recall", "f1"):
        aggs += [F.avg(m).alias(m + "_macro"),
                 F.try_divide(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(m + "_weighted")]
    return per.agg(*aggs)


def class_report(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Per class, then accuracy, macro and weighted rows; ``ord`` gives the print order."""
    per = _per_class(df, truth, pred)
    classes = per.select(
        F.lit(0).alias("ord"), "label", "precision", "recall", "f1", F.col("support").cast("bigint").alias("support"))
    total = F.sum("support")
    summary = per.agg(
        total.alias("support"), F.try_divide(F.sum("tp"), total).alias("accuracy"),
        *[F.avg(m).alias("macro_" + m) for m in ("precision", "recall", "f1")],
        *[F.try_divide(F.sum(F.col(m) * F.col("support")), total).alias("weighted_" + m) for m in ("precision", "recall", "f1")],
    )
    none = F.lit(None).cast("double")
    rows = F.explode(F.array(
        F.struct(F.lit(1).alias("ord"), F.lit("accuracy").alias("label"), none.alias("precision"),
                 none.alias("recall"), F.col("accuracy").alias("f1"), "support"),
        *[F.struct(F.lit(o).alias("ord"), F.lit(name).alias("label"), F.col(k + "_precision").alias("precision"),
                   F.col(k + "_recall").alias("recall"), F.col(k + "_f1").alias("f1"), "support")
          for o, name, k in ((2, "macro avg", "macro"), (3, "weighted avg", "weighted"))],
    ))
    return classes.unionByName(summary.select(rows.alias("r")).select("r.*"))


def class_breakdown(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Per true class: total, accuracy, and count and share of each predicted label."""
    counts = df.groupBy(F.col(truth).alias("true_label"), F.col(pred).alias("pred_label")).agg(F.count("*").alias("n"))
    per = W.partitionBy("true_label")
    total = F.sum("n").over(per)
    right = F.sum(F.when(F.col("true_label") == F.col("pred_label"), F.col("n")).otherwise(0)).over(per)
    return counts.select(
        "true_label", "pred_label", "n", total.alias("total"), right.alias("correct"),
        (right / total).alias("accuracy"), (100 * F.col("n") / total).alias("pct"))


def label_distribution(df: DataFrame, split: str, label: str) -> DataFrame:
    counts = df.groupBy(F.col(split).alias("split"), F.col(label).alias("label")).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", 100 * F.col("n") / F.sum("n").over(W.partitionBy("split")))


def split_audit(df: DataFrame, split: str, group: str) -> DataFrame:
    """Rows and groups per split, and groups it shares with other splits."""
    pairs = df.groupBy(F.col(group).alias("g"), F.col(split).alias("split")).agg(F.count("*").alias("n"))
    spread = pairs.groupBy("g").agg(F.count("*").alias("k"))
    return pairs.join(spread, "g").groupBy("split").agg(
        F.sum("n").alias("rows"), F.count("*").alias("groups"), F.count_if(F.col("k") > 1).alias("shared_groups"))


def topk_accuracy(df: DataFrame, preds: str, truth: str, ks=(1, 2), by: str | None = None) -> DataFrame:
    """Share of rows whose truth is among the first k predictions, overall or by a column."""
    hits = [
        F.avg(F.array_contains(F.slice(preds, 1, k), F.col(truth)).cast("double")).alias(f"top{k}_accuracy") for k in ks
    ]
    return df.groupBy(*([by] if by else [])).agg(F.count("*").alias("count"), *hits)


# --- training logs and other reports ---------------------------------------


def reward_epochs(rewards: DataFrame) -> DataFrame:
    return rewards.groupBy("stage", "epoch").agg(
        F.count("*").alias("n"), F.avg("reward").alias("mean_reward"),
        F.min("reward").alias("min_quality"), F.max("reward").alias("max_quality"))


def reward_stages(rewards: DataFrame) -> DataFrame:
    return reward_epochs(rewards).groupBy("stage").agg(
        F.sum("n").alias("num_samples"), F.count("*").alias("epochs"),
        F.coalesce(F.max("mean_reward"), F.lit(0.0)).alias("best_reward"))


def reward_summary(rewards: DataFrame, *by: str, default: float = 0.25) -> DataFrame:
    """Min, max and mean with and without the default score.

    A genuine score equal to the default is left out too.
    """
    real = F.when(F.col("reward") != default, F.col("reward"))
    return rewards.groupBy(*by).agg(
        *[f(c).alias(f"{name}_{kind}") for kind, c in (("all", F.col("reward")), ("valid", real))
          for name, f in (("min", F.min), ("max", F.max), ("mean", F.avg))],
        F.count_if(F.col("reward") == default).alias("at_default"), F.count("*").alias("n"))


def quality_summary(quality: DataFrame, *by: str) -> DataFrame:
    s = F.col("overall_score")
    return quality.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(s).alias("avg_overall"), F.avg("semantic_similarity").alias("avg_semantic"),
        F.avg("schema_correctness").alias("avg_schema"), F.count_if("execution_success").alias("n_success"),
        F.count_if(s >= 9).alias("excellent"), F.count_if((s >= 7) & (s < 9)).alias("good"),
        F.count_if((s >= 5) & (s < 7)).alias("fair"), F.count_if(s < 5).alias("poor"),
        F.count_if(F.size("issues") > 0).alias("with_issues"),
        F.max_by("id", F.struct(s, -F.col("id"))).alias("best_id"))


def throughput(log: DataFrame, ts: str = "ts", *by: str) -> DataFrame:
    at = F.col(ts).cast("timestamp")
    seconds = (F.unix_micros(F.max(at)) - F.unix_micros(F.min(at))) / 1e6
    return log.groupBy(*by).agg(
        F.count("*").alias("n"), seconds.alias("seconds"), F.try_divide(F.count("*"), seconds).alias("per_second"))


def study_rows(
    runs: dict[str, DataFrame] | DataFrame, metrics: Sequence[str] = ("precision", "recall", "f1", "all_found", "one_found"), row: str = "dataset",
) -> DataFrame:
    """(row, condition, metric, value): every metric's mean over scored rows, for any number of conditions.

    Takes score tables by condition name, or one table with a ``condition`` column.
    """
    table = runs
    if isinstance(runs, dict):
        table = reduce(DataFrame.unionByName, [df.withColumn("condition", F.lit(n)) for n, df in runs.items()])
    means = scored(table).groupBy(row, "condition").agg(*[F.avg(F.col(m).cast("double")).alias(m) for m in metrics])
    return means.unpivot([row, "condition"], list(metrics), "metric", "value")


def study_grid(
    runs: dict[str, DataFrame] | DataFrame, metric: str = "f1", row: str = "dataset", conditions: Sequence[str] | None = None,
) -> DataFrame:
    """One metric across conditions, the listed conditions as columns; by default the names of a dictionary of runs."""
    if conditions is None:
        if not isinstance(runs, dict):
            raise ValueError("name the conditions that become columns, or use study_rows")
        conditions = list(runs)
    return study_rows(runs, [metric], row).groupBy(row).pivot("condition", list(conditions)).agg(F.first("value"))
