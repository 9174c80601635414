"""Dense global positions without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sqlverdict.session import cut_lineage


def dense_index(df: DataFrame, name: str, *order, each: int | None = None) -> DataFrame:
    """Adds the 0-based position of each row in the given global order.

    With no order, rows are numbered as they are read. The order is made by a
    range-partitioned sort; a position is the row's place in its partition plus
    the sizes of the partitions before it. Only those sizes, one row per
    partition, meet in one task. With ``each``, rows are stored and counted first and
    sorted in tasks of about that many; for wide rows, of which a task sorts few.
    """
    laid = df.orderBy(*order) if order else df
    if order and each:
        kept = cut_lineage(df)
        tasks = -(-kept.count() // each)
        many = tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        laid = kept.repartitionByRange(tasks, *order).sortWithinPartitions(*order) if many else kept.orderBy(*order)
    placed = cut_lineage(laid.withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33).alias("_p")
    sizes = placed.groupBy(part).agg(F.count("*").alias("_n"))
    before = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("_p", F.shiftright("_m", 33)).join(F.broadcast(starts), "_p").withColumn(
        name, F.col("_start") + own).drop("_m", "_p", "_start")


# Spark keeps the best n rows per group before the shuffle up to this n by default.
GROUP_LIMIT = 1000


def grouped_rank(df: DataFrame, by: str, name: str, *order, each: int | None = None) -> DataFrame:
    """1-based place of each row in its group, with no task per group.

    The whole table is sorted by group and order; a row's place is its global
    position less the first position of its group. A group of any size is spread
    over as many sort partitions as it fills.
    """
    placed = dense_index(df, "_i", by, *order, each=each)
    firsts = placed.groupBy(by).agg(F.min("_i").alias("_first"))
    return placed.join(firsts.withColumnRenamed(by, "_by"), F.col(by).eqNullSafe(F.col("_by"))).withColumn(
        name, F.col("_i") - F.col("_first") + 1).drop("_i", "_first", "_by")


def first_per_group(df: DataFrame, n: int, by, *order) -> DataFrame:
    """The first n rows per group; of the whole table without a group.

    Small n: each task keeps n rows per group before the shuffle. Large n: ranks
    from a global sort, so that no task holds a whole group.
    """
    if n <= 0:
        return df.limit(0)
    if not by:
        if n <= GROUP_LIMIT:
            return df.orderBy(*order).limit(n)
        return dense_index(df, "_r", *order).filter(F.col("_r") < n).drop("_r")
    if n <= GROUP_LIMIT:
        rank = F.row_number().over(W.partitionBy(*by).orderBy(*order))
        return df.withColumn("_r", rank).filter(F.col("_r") <= n).drop("_r")
    keyed = df.withColumn("_g", F.to_json(F.struct(*by), {"ignoreNullFields": "false"}))
    return grouped_rank(keyed, "_g", "_r", *order).filter(F.col("_r") <= n).drop("_r", "_g").select(*df.columns)


# Hexadecimal digits of a digest that name its slice: 4096 slices a group.
SLICE_DIGITS = 3
BROADCAST_CUTS = 200_000


def first_by_digest(df: DataFrame, n: int, by, digest: str, *ties: str) -> DataFrame:
    """The first n rows per group in the order of ``digest``, a column of hexadecimal hashes, then ``ties``.

    A large n is found without sorting the table: counts per group and slice of the digests say in which
    slice the n-th row lies. Rows of slices before it stay, rows after it go, and only those of this one
    slice, about one in 4096, are ranked. Null digests come first.
    """
    if n <= GROUP_LIMIT:
        return first_per_group(df, n, by, digest, *ties)
    group = F.to_json(F.struct(*by), {"ignoreNullFields": "false"}) if by else F.lit("")
    at = F.coalesce(F.conv(F.substring(digest, 1, SLICE_DIGITS), 16, 10).cast("int"), F.lit(-1))
    laid = df.withColumns({"_g": group, "_at": at})
    counts = laid.groupBy("_g", "_at").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy("_g").orderBy("_at")) - F.col("_n")
    cuts = cut_lineage(counts.withColumn("_before", before).filter((F.col("_before") < n) & (F.col("_before") + F.col("_n") >= n)).select(
        F.col("_g"), F.col("_at").alias("_cut"), (F.lit(n) - F.col("_before")).alias("_need")))
    small = cuts.limit(BROADCAST_CUTS + 1).count() <= BROADCAST_CUTS
    placed = laid.join(F.broadcast(cuts) if small else cuts, "_g", "left")
    sure = placed.filter(_before_cut(F.col("_at"), F.col("_cut"))).select(*df.columns)
    edge = grouped_rank(placed.filter("_at = _cut"), "_g", "_r", digest, *ties).filter("_r <= _need").select(*df.columns)
    return sure.unionByName(edge)


def _before_cut(at: Column, cut: Column) -> Column:
    """Groups of fewer rows have no cut and stay whole."""
    return cut.isNull() | (at < cut)
