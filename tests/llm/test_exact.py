"""Counts and spans that stay exact, and linear, in very long texts."""

import random
import time

import pytest
from pyspark.sql import functions as F

from sqlverdict.llm import rules, secrets
from tests.llm import brute


@pytest.mark.parametrize("bits", [3, 7, 58, 62])
def test_repeats_where_hashes_cannot_tell(spark, bits):
    """Too few bits for positions, or too few for hashes: the words decide."""
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcdef") for _ in range(rng.randrange(70))) for _ in range(60)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("words", F.filter(F.split("text", " "), lambda w: w != ""))
    got = {r["text"]: r["n"] for r in docs.select("text", rules._repeat_words(F.col("words"), bits).alias("n")).collect()}
    assert got == {t: brute.rule_counts(t)[4] for t in texts}


def test_long_clean_text_is_kept(spark):
    rng = random.Random(9)
    pool = ["the", "of"] * 100 + [f"word{k}" for k in range(3000)]
    text = " ".join(rng.choice(pool) for _ in range(120_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string").repartition(1)
    row = rules.apply_rules(docs).first()
    assert row["n_words"] == 120_000 and "length" not in row["failed_rules"]


def test_many_secrets_in_one_text(spark, tmp_path):
    """Spans of many groups are right; four times the matches take about four times as long."""
    took = {}
    for n in (10_000, 40_000):
        text = "é " + "".join(f"token = abc{k:06d} " if k % 3 else f"token=ab é{k} " for k in range(n))
        docs = spark.createDataFrame([(1, text)], "path long, text string")
        start = time.time()
        row = secrets.scan(docs, str(tmp_path / f"ledger-{n}")).select(secrets.joined(secrets.BASE_RULES).alias("x"), F.size("assign").alias("n")).first()
        took[n] = time.time() - start
        assert (row["n"], row["x"]) == (brute.secrets(text)[0], brute.secrets(text)[4])
    assert took[40_000] < 10 * took[10_000] + 5
