"""Splits, capped and balanced samples, mixtures and curriculum stages.

Sampling is seeded by ``md5(seed || id)``: sizes, disjointness and repeatability
are guaranteed, the same rows on any cluster and engine.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlverdict.functions.pytext import strip
from sqlverdict.operators.examples import complete, derive_category, first_nonblank, present
from sqlverdict.operators.numbering import dense_index, first_by_digest
from sqlverdict.schema import AMBIGUITY_TYPES, CATEGORY_IDS

BROADCAST_GROUPS = 200_000

# Labels of sources that hold one kind of question.
SOURCE_LABELS = {"ambiqt": "AA", "spider": "AU"}
# Stage order with its epochs, and the caps of the training mixture.
STAGE_EPOCHS = {"scope": 2, "attachment": 2, "vague": 3, "mixed": 3}
MIXTURE_CAPS = {
    "train": {"ambrosia": ("train", 10000), "ambiqt": ("train", 200), "spider": ("train", 200)},
    "validation": {"ambrosia": ("validation", 1000), "ambiqt": ("test", 100), "spider": ("validation", 100)},
    "test": {"ambrosia": ("test", None)},
}


def shuffle_key(seed: Column | int, key: Column) -> Column:
    seed = F.lit(seed) if isinstance(seed, int) else seed
    return F.md5(F.concat(seed.cast("string"), key.cast("string")))


def group_split(
    df: DataFrame, group: str, weights: Sequence[float] = (0.8, 0.1, 0.1),
    names: Sequence[str] = ("few_shot_examples", "test", "validation"), seed: int = 42,
) -> DataFrame:
    """Adds ``split`` so that no group is in two splits.

    Distinct groups are shuffled; boundaries are ``int`` of the cumulative weight
    times the number of groups.
    """
    groups = df.select(group).distinct().withColumn("_k", shuffle_key(seed, F.col(group)))
    placed = dense_index(groups, "_i", "_k", group)
    n = placed.count()
    edges, total = [], 0.0
    for w in weights[:-1]:
        total += w
        edges.append(int(round(total, 9) * n))
    split = F.lit(names[-1])
    for edge, name in reversed(list(zip(edges, names))):
        split = F.when(F.col("_i") < edge, name).otherwise(split)
    named = placed.select(group, split.alias("split"))
    # A hot group sits on the table's side of the join: few groups are broadcast, with
    # more of them the adaptive skew join splits it.
    return df.join(F.broadcast(named) if n <= BROADCAST_GROUPS else named, group)


def capped_sample(
    df: DataFrame, cap: int, by: Sequence[str] = (), seed: int = 42, key: str = "id"
) -> DataFrame:
    """At most ``cap`` random rows per group, or of the whole table without groups.

    A huge group costs no more than its share of the scan: see ``first_by_digest``.
    """
    keyed = df.withColumn("_k", shuffle_key(seed, F.col(key)))
    return first_by_digest(keyed, cap, list(by), "_k", key).drop("_k")


def classifier_rows(raw: DataFrame, source: str) -> DataFrame:
    """(id, split, db_dump, question, label) of a source for the question classifier.

    Sources of one kind of question have its label; for all others the question's flags decide and
    rows they cannot tell go. A given category column is not read. Questions must not be
    blank, dumps may be.
    """
    fixed = SOURCE_LABELS.get(source)
    label = F.lit(fixed) if fixed else derive_category("flags")
    return complete(raw).filter(present("question") & label.isNotNull()).select(
        F.col("row_idx").alias("id"), strip(F.col("split")).alias("split"), first_nonblank("db_dump_processed").alias("db_dump"),
        strip(F.col("question")).alias("question"), label.alias("label"))


def mixture(
    sources: Mapping[str, DataFrame], caps: Mapping[str, Mapping[str, tuple[str, int | None]]] = MIXTURE_CAPS,
    seed: int = 42, key: str = "id",
) -> DataFrame:
    """Union of capped sources per target split, with label ids.

    ``caps[split][source]`` is (source split, cap or None). Sources have the same
    columns, among them ``split`` and ``label``.
    """
    parts = []
    for split, wanted in caps.items():
        for name, (source_split, cap) in wanted.items():
            if name not in sources:
                continue
            rows = sources[name].filter(F.col("split") == source_split)
            rows = rows if cap is None else capped_sample(rows, cap, (), seed, key)
            parts.append(rows.withColumns({"split": F.lit(split), "dataset": F.lit(name)}))
    ids = F.create_map(*[F.lit(x) for pair in CATEGORY_IDS.items() for x in pair])
    return reduce(DataFrame.unionByName, parts).withColumn("label_id", F.try_element_at(ids, F.col("label")))


def balanced_sample(
    df: DataFrame, n: int, types: Sequence[str] = AMBIGUITY_TYPES, seed: int = 42, by: str = "ambig_type", key: str = "id"
) -> DataFrame:
    """At most n rows of each listed type; all rows of other types."""
    listed = F.coalesce(F.col(by).isin(*types), F.lit(False))
    return capped_sample(df.filter(listed), n, [by], seed, key).unionByName(df.filter(~listed))


def curriculum(
    df: DataFrame, order: Sequence[str] = tuple(STAGE_EPOCHS), skip: Sequence[str] = (), cap: int | None = None,
    seed: int = 42, by: str = "ambig_type", key: str = "id", epochs: Mapping[str, int] = STAGE_EPOCHS,
) -> DataFrame:
    """Rows per training stage: own type, and everything again under ``mixed``.

    Adds ``stage``, ``stage_num`` (place in the full order), ``epochs`` and
    ``shuffle_key``, the order inside the stage; seeds differ by stage. ``cap``
    keeps that many rows per stage. Stages without rows do not appear.
    """
    numbers = {name: i + 1 for i, name in enumerate(STAGE_EPOCHS)}
    for name in order:
        numbers.setdefault(name, len(numbers) + 1)
    stages = [s for s in order if s not in set(skip)]
    wanted = F.array_compact(F.array(
        F.when(F.col(by).isin(*[s for s in stages if s != "mixed"] or [""]), F.col(by)),
        F.lit("mixed") if "mixed" in stages else F.lit(None).cast("string")))

    def lookup(values: Mapping[str, int]) -> Column:
        return F.try_element_at(F.create_map(*[F.lit(x) for p in values.items() for x in p]), F.col("stage"))

    out = df.withColumn("stage", F.explode(wanted)).withColumns({
        "stage_num": lookup(numbers), "epochs": lookup(epochs)})
    out = out.withColumn("shuffle_key", shuffle_key(F.col("stage_num") + seed, F.col(key)))
    if cap is None:
        return out
    return first_by_digest(out, cap, ["stage"], "shuffle_key", key)
