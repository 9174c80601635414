"""Extension points: named column rewards, table scorers, and comparison rules."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlverdict.functions.text import format_reward, quality_gate
from sqlverdict.operators import compare

Reward = Callable[..., Column]

REWARDS: dict[str, Reward] = {
    "format": lambda reply, score=None: format_reward(reply),
    "quality": lambda reply, score: quality_gate(reply, score),
}


def register_reward(name: str, fn: Reward) -> None:
    """``fn(reply, score)`` maps columns to a column of numbers (a pandas UDF is one way)."""
    if name in REWARDS:
        raise ValueError(f"reward {name} exists")
    REWARDS[name] = fn


def reward_table(df: DataFrame, names=None, reply: str = "raw_text", score: str = "score") -> DataFrame:
    """Adds one ``reward_<name>`` column per reward."""
    given = F.col(score) if score in df.columns else F.lit(None).cast("double")
    return df.withColumns({f"reward_{n}": REWARDS[n](F.col(reply), given) for n in (names or list(REWARDS))})


def score_with(df: DataFrame, fn: Callable[[pd.DataFrame], pd.Series], name: str = "score") -> DataFrame:
    """Adds a double column computed batch by batch by a user function."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{name}` double"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(**{name: fn(frame).astype("float64")})

    return df.mapInPandas(run, schema)


RULES: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    "unordered": lambda p, c: compare.match_unordered(p, c).withColumnRenamed("strict", "hit"),
    "ordered": lambda p, c: compare.match_ordered(p, c).withColumnRenamed("strict", "hit"),
    "strict": lambda p, c: compare.match_strict(p, c).withColumnRenamed("strict", "hit"),
    "normalized": lambda p, c: compare.match_normalized(p, c).withColumnRenamed("normalized", "hit"),
    "subset": lambda p, c: compare.match_subset(p, c).withColumnRenamed("subset", "hit"),
    "semantic": lambda p, c: compare.match_semantic(p, c).withColumnRenamed("semantic", "hit"),
    "flex": lambda p, c: compare.match_flex(p, c).withColumnRenamed("flex", "hit"),
}


def match_rules(pairs: DataFrame, cells: DataFrame, names, rules=None) -> DataFrame:
    """One boolean column ``rule_<name>`` per rule; ``rules`` adds the caller's own.

    A rule takes pairs and cells and returns the pairs with a boolean ``hit``.
    """
    known = {**RULES, **(rules or {})}
    out = pairs
    for name in names:
        column = f"rule_{name}"
        hits = known[name](pairs, cells).select(*compare.PAIR, F.col("hit").alias(column))
        out = out.join(hits, list(compare.PAIR), "left").withColumn(column, F.coalesce(column, F.lit(False)))
    return out
