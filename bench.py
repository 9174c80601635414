"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sqlverdict.plans import registry  # noqa: E402
from sqlverdict.session import build_session  # noqa: E402

HEADLINE = (
    "strict_rate", "match_strict", "match_normalized", "match_semantic", "match_subset", "column_mapping", "match_flex",
    "result_dedup", "example_prf_dedup", "evaluate_guarded", "coverage", "by_type_total", "class_report",
    "reward_stages", "topk", "topk_grid", "topk_by_category", "hybrid_rerank", "retrieval_policy", "quality_ranking", "run_packs", "tfidf_sim", "softmax_route", "lda_predict",
    "extract_statements", "reply_queries", "format_reward", "schema_correctness", "load_examples", "load_corpus",
    "group_split", "capped_sample", "curriculum", "fewshot_prompt",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.log.level": "ERROR",
        # One task per core: merging small shuffle outputs would leave cores idle at this size.
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    })
    spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    queries, names = registry.queries(), sys.argv[1:] or HEADLINE
    times = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
