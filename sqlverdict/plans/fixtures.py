"""Check inputs derived from the given tables: DataFrames here, SQL text for the oracle.

The SQL of each view is plain enough for Spark and DuckDB; where the DataFrame
form differs it is only to read the source fewer times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sqlverdict.session import spread

# Orders a task: each becomes up to twenty cells in the stage that reads them.
ORDERS = 30_000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- result cells: one example per customer, one predicted variant each ----

SQL_WIDE = """fx_wide AS (
SELECT a.ck, a.ck % 15 AS v, a.rn, a.n, a.k, a.p, a.s, b.p AS p_rev,
       CAST(floor(a.ck / 15.0) AS BIGINT) % 2 AS is_ordered
FROM (SELECT o_custkey AS ck, o_orderkey AS k, o_totalprice AS p, o_orderstatus AS s,
             CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS BIGINT) AS rn,
             count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) a
JOIN (SELECT o_custkey AS ck, o_totalprice AS p,
             CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) - 1 AS BIGINT) AS rn FROM orders) b
  ON a.ck = b.ck AND a.rn = b.rn)"""

SQL_CELLS = SQL_WIDE + """, fx_cells AS (
SELECT ck AS example_id, 'gold' AS side, rn AS row_idx, 0 AS col_idx, 'num' AS kind, CAST(k AS DOUBLE) AS num, CAST(NULL AS VARCHAR(100)) AS str FROM fx_wide
UNION ALL SELECT ck, 'gold', rn, 1, 'num', p, CAST(NULL AS VARCHAR(100)) FROM fx_wide
UNION ALL SELECT ck, 'gold', rn, 2, 'str', CAST(NULL AS DOUBLE), s FROM fx_wide
UNION ALL SELECT ck, 'pred', CASE WHEN v = 1 THEN n - 1 - rn ELSE rn END, CASE WHEN v = 3 THEN 1 ELSE 0 END, 'num', CAST(k AS DOUBLE), CAST(NULL AS VARCHAR(100))
  FROM fx_wide WHERE v NOT IN (11, 12) AND NOT (v = 8 AND rn = n - 1)
UNION ALL SELECT ck, 'pred', CASE WHEN v = 1 THEN n - 1 - rn ELSE rn END, CASE WHEN v = 3 THEN 2 ELSE 1 END,
       CASE WHEN v = 4 THEN 'str' ELSE 'num' END,
       CASE WHEN v = 4 THEN CAST(NULL AS DOUBLE) WHEN v = 5 THEN p * 100 WHEN v = 6 THEN p + 0.005 WHEN v = 10 THEN p_rev WHEN v = 13 THEN p * 1.5 ELSE p END,
       CASE WHEN v = 4 THEN CAST(CAST(p AS DECIMAL(18,2)) AS VARCHAR(100)) ELSE NULL END
  FROM fx_wide WHERE v NOT IN (11, 12) AND NOT (v = 8 AND rn = n - 1)
UNION ALL SELECT ck, 'pred', CASE WHEN v = 1 THEN n - 1 - rn ELSE rn END, CASE WHEN v = 3 THEN 0 ELSE 2 END, 'str', CAST(NULL AS DOUBLE),
       CASE WHEN v = 7 THEN concat(' ', lower(s), ' ') WHEN v = 14 AND s = 'F' THEN 'no' ELSE s END
  FROM fx_wide WHERE v NOT IN (9, 11, 12) AND NOT (v = 8 AND rn = n - 1)
UNION ALL SELECT ck, 'pred', rn, 3, 'str', CAST(NULL AS DOUBLE), 'x' FROM fx_wide WHERE v = 2)"""


def wide(spark: SparkSession, sf: str) -> DataFrame:
    """Orders numbered per customer, for variant 10 with the price of the mirrored row."""
    every = table(spark, sf, "orders")
    o = spread(every.filter("o_custkey IS NOT NULL").select(
        F.col("o_custkey").alias("ck"), F.col("o_orderkey").alias("k"),
        F.col("o_totalprice").alias("p"), F.col("o_orderstatus").alias("s"),
    ), every.count(), ORDERS, "ck")
    per = W.partitionBy("ck")
    up = o.withColumns({
        "rn": (F.row_number().over(per.orderBy("k")) - 1).cast("bigint"),
        "n": F.count("*").over(per),
    })
    # By customer alone, so that orders are shuffled once and stay with their customer.
    back = F.array_sort(F.collect_list(F.struct((-F.col("rn")).alias("at"), "p")))
    mirrored = up.filter("ck % 15 = 10").groupBy("ck").agg(F.transform(back, lambda x: x["p"]).alias("back"))
    return up.join(mirrored, "ck", "left").withColumns({
        "p_rev": F.get("back", F.col("rn").cast("int")),
        "v": F.col("ck") % 15, "is_ordered": F.floor(F.col("ck") / 15).cast("bigint") % 2,
    }).drop("back")


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """All gold and predicted cells, from one pass over ``wide``."""
    w = wide(spark, sf)
    null_d, null_s = F.lit(None).cast("double"), F.lit(None).cast("string")
    v, rn, n, p, s = (F.col(c) for c in ("v", "rn", "n", "p", "s"))

    def cell(side, row, col, kind, num, text, keep):
        body = F.struct(
            F.lit(side).alias("side"), row.cast("bigint").alias("row_idx"), col.cast("int").alias("col_idx"),
            kind.alias("kind"), num.alias("num"), text.alias("str"),
        )
        return F.when(keep, body)

    num_kind, str_kind, yes = F.lit("num"), F.lit("str"), F.lit(True)
    prow = F.when(v == 1, n - 1 - rn).otherwise(rn)
    has = ~v.isin(11, 12) & ~((v == 8) & (rn == n - 1))
    price = (
        F.when(v == 4, null_d).when(v == 5, p * 100).when(v == 6, p + 0.005).when(v == 10, F.col("p_rev"))
        .when(v == 13, p * 1.5).otherwise(p)
    )
    status = (
        F.when(v == 7, F.concat(F.lit(" "), F.lower(s), F.lit(" ")))
        .when((v == 14) & (s == "F"), "no").otherwise(s)
    )
    made = F.array_compact(F.array(
        cell("gold", rn, F.lit(0), num_kind, F.col("k").cast("double"), null_s, yes),
        cell("gold", rn, F.lit(1), num_kind, p, null_s, yes),
        cell("gold", rn, F.lit(2), str_kind, null_d, s, yes),
        cell("pred", prow, F.when(v == 3, 1).otherwise(0), num_kind, F.col("k").cast("double"), null_s, has),
        cell("pred", prow, F.when(v == 3, 2).otherwise(1), F.when(v == 4, "str").otherwise("num"), price,
             F.when(v == 4, p.cast("decimal(18,2)").cast("string")), has),
        cell("pred", prow, F.when(v == 3, 0).otherwise(2), str_kind, null_d, status, has & (v != 9)),
        cell("pred", rn, F.lit(3), str_kind, null_d, F.lit("x"), v == 2),
    ))
    return w.select(F.col("ck").alias("example_id"), F.explode(made).alias("c")).select("example_id", "c.*").select(
        "example_id", "side", F.col("side").alias("query_id"), "row_idx", "col_idx", "kind", "num", "str"
    )


def cell_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """One gold and one predicted result per customer; variant 12 failed to run."""
    ck = table(spark, sf, "orders").select(F.col("o_custkey").alias("example_id")).distinct()
    return ck.filter(F.col("example_id") % 15 != 12).select(
        "example_id", F.lit("pred").alias("pred_id"), F.lit("gold").alias("gold_id"),
        (F.floor(F.col("example_id") / 15).cast("bigint") % 2 == 1).alias("ordered"),
    )


def cell_runs(spark: SparkSession, sf: str) -> DataFrame:
    """The two statements of each customer: gold always runs, variant 12 fails."""
    ck = table(spark, sf, "orders").select(F.col("o_custkey").alias("example_id")).distinct()
    side = F.explode(F.array(F.lit("gold"), F.lit("pred")))
    return ck.select("example_id", side.alias("side")).select(
        "example_id", "side", F.col("side").alias("query_id"), F.lit(0).alias("pos"), F.col("side").alias("sql"),
        (F.floor(F.col("example_id") / 15).cast("bigint") % 2 == 1).alias("ordered"),
        ((F.col("side") == "gold") | (F.col("example_id") % 15 != 12)).alias("ok"),
        F.lit(None).cast("string").alias("error"),
    )


# --- several statements per customer ---------------------------------------
#
# Result kinds: A status and priority, B priority, C as A reversed, D as A with
# columns swapped, S status, Z empty, X failed.

SQL_RUNS = """st0 AS (SELECT DISTINCT o_custkey AS ck FROM orders),
st AS (
SELECT ck, 'gold' AS side, 0 AS pos, 'A' AS res, CASE WHEN ck % 2 = 0 THEN 'SELECT a ORDER BY k' ELSE 'SELECT a' END AS sql FROM st0 WHERE ck % 17 <> 0
UNION ALL SELECT ck, 'gold', 1, CASE WHEN ck % 13 = 0 THEN 'X' WHEN ck % 5 = 0 THEN 'S' ELSE 'B' END, 'SELECT b' FROM st0 WHERE ck % 17 <> 0
UNION ALL SELECT ck, 'gold', 2, 'A', CASE WHEN ck % 2 = 0 THEN 'SELECT a ORDER BY k' ELSE 'SELECT a' END FROM st0 WHERE ck % 17 <> 0 AND ck % 7 = 0
UNION ALL SELECT ck, 'gold', 3, 'A', 'SELECT a2' FROM st0 WHERE ck % 17 <> 0 AND ck % 11 = 0
UNION ALL SELECT ck, 'gold', 0, 'X', 'unanswerable ' FROM st0 WHERE ck % 17 = 0
UNION ALL SELECT ck, 'pred', 0, CASE WHEN ck % 3 = 0 THEN 'X' ELSE 'C' END, 'SELECT p0' FROM st0
UNION ALL SELECT ck, 'pred', 1, 'Z', 'SELECT p1' FROM st0
UNION ALL SELECT ck, 'pred', 2, 'D', CASE WHEN ck % 4 = 0 THEN 'SELECT p2 ORDER BY k' ELSE 'SELECT p2' END FROM st0
UNION ALL SELECT ck, 'pred', 3, 'X', 'SELECT p3' FROM st0
UNION ALL SELECT ck, 'pred', 4, CASE WHEN ck % 6 = 0 THEN 'D' ELSE 'A' END,
  CASE WHEN ck % 6 <> 0 THEN 'SELECT p4' WHEN ck % 4 = 0 THEN 'SELECT p2 ORDER BY k' ELSE 'SELECT p2' END FROM st0
UNION ALL SELECT ck, 'pred', 5, 'Z', 'SELECT p5' FROM st0
UNION ALL SELECT ck, 'pred', 6, 'B', 'SELECT p6' FROM st0 WHERE ck % 2 = 1),
runs AS (SELECT *, res <> 'X' AS ok, contains(lower(sql), 'order by') AS ordered FROM st),
res AS (
SELECT s.ck, s.side, s.pos, list_sort(list(o.o_orderpriority)) AS pri, list_sort(list(o.o_orderstatus)) AS sta,
  list(list_sort([o.o_orderpriority, o.o_orderstatus]) ORDER BY o_orderkey) AS up,
  list(list_sort([o.o_orderpriority, o.o_orderstatus]) ORDER BY o_orderkey DESC) AS down,
  list([o.o_orderstatus, o.o_orderpriority] ORDER BY o_orderkey) AS a_rows, list([o.o_orderpriority, o.o_orderstatus] ORDER BY o_orderkey) AS d_rows,
  list([o.o_orderpriority] ORDER BY o_orderkey) AS b_rows, list([o.o_orderstatus] ORDER BY o_orderkey) AS s_rows,
  list([o.o_orderstatus, o.o_orderpriority] ORDER BY o_orderkey DESC) AS c_rows, any_value(s.res) AS res
  FROM st s JOIN orders o ON o.o_custkey = s.ck GROUP BY 1, 2, 3),
r2 AS (SELECT runs.*, CASE runs.res WHEN 'B' THEN list_concat(pri, []) WHEN 'S' THEN sta WHEN 'Z' THEN [] WHEN 'X' THEN NULL ELSE list_sort(list_concat(pri, sta)) END AS bag,
  CASE runs.res WHEN 'A' THEN up WHEN 'D' THEN up WHEN 'C' THEN down WHEN 'B' THEN b_rows WHEN 'S' THEN s_rows WHEN 'Z' THEN [] END AS rowbags,
  CASE runs.res WHEN 'A' THEN a_rows WHEN 'D' THEN d_rows WHEN 'C' THEN c_rows WHEN 'B' THEN b_rows WHEN 'S' THEN s_rows WHEN 'Z' THEN [] END AS exact
  FROM runs LEFT JOIN res USING (ck, side, pos)),
dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ck, side, sql ORDER BY pos) AS rr FROM r2) WHERE rr = 1)"""


def multi_runs(spark: SparkSession, sf: str) -> DataFrame:
    ck = table(spark, sf, "orders").select(F.col("o_custkey").alias("ck")).distinct()
    c = F.col("ck")

    def one(keep, side, pos, res, sql):
        return F.when(keep, F.struct(
            F.lit(side).alias("side"), F.lit(pos).alias("pos"), res.alias("res"), sql.alias("sql")))

    answer = c % 17 != 0
    yes = F.lit(True)
    gold_a = F.when(c % 2 == 0, "SELECT a ORDER BY k").otherwise("SELECT a")
    p2 = F.when(c % 4 == 0, "SELECT p2 ORDER BY k").otherwise("SELECT p2")
    items = F.array_compact(F.array(
        one(answer, "gold", 0, F.lit("A"), gold_a),
        one(answer, "gold", 1, F.when(c % 13 == 0, "X").when(c % 5 == 0, "S").otherwise("B"), F.lit("SELECT b")),
        one(answer & (c % 7 == 0), "gold", 2, F.lit("A"), gold_a),
        one(answer & (c % 11 == 0), "gold", 3, F.lit("A"), F.lit("SELECT a2")),
        one(~answer, "gold", 0, F.lit("X"), F.lit("unanswerable ")),
        one(yes, "pred", 0, F.when(c % 3 == 0, "X").otherwise("C"), F.lit("SELECT p0")),
        one(yes, "pred", 1, F.lit("Z"), F.lit("SELECT p1")),
        one(yes, "pred", 2, F.lit("D"), p2),
        one(yes, "pred", 3, F.lit("X"), F.lit("SELECT p3")),
        one(yes, "pred", 4, F.when(c % 6 == 0, "D").otherwise("A"), F.when(c % 6 == 0, p2).otherwise("SELECT p4")),
        one(yes, "pred", 5, F.lit("Z"), F.lit("SELECT p5")),
        one(c % 2 == 1, "pred", 6, F.lit("B"), F.lit("SELECT p6")),
    ))
    return ck.select("ck", F.explode(items).alias("s")).select(
        F.col("ck").alias("example_id"), "s.side", F.concat(F.substring("s.side", 1, 1), F.col("s.pos")).alias("query_id"),
        "s.pos", "s.sql", F.contains(F.lower("s.sql"), F.lit("order by")).alias("ordered"),
        (F.col("s.res") != "X").alias("ok"), F.when(F.col("s.res") == "X", "no such column").alias("error"), "s.res",
    )


def multi_cells(spark: SparkSession, sf: str) -> DataFrame:
    every = table(spark, sf, "orders")
    o = spread(every.select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority"), every.count(), ORDERS, "o_custkey")
    per = W.partitionBy("o_custkey")
    rows = o.select(
        F.col("o_custkey").alias("example_id"), F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"),
        (F.row_number().over(per.orderBy("o_orderkey")) - 1).cast("bigint").alias("rn"), F.count("*").over(per).alias("n"),
    )
    runs = multi_runs(spark, sf).filter("res NOT IN ('X', 'Z')").select("example_id", "side", "query_id", "res")
    res = F.col("res")
    values = (
        F.when(res == "B", F.array("p")).when(res == "S", F.array("s")).when(res == "D", F.array("p", "s"))
        .otherwise(F.array("s", "p"))
    )
    return rows.join(runs, "example_id").select(
        "example_id", "side", "query_id",
        F.when(res == "C", F.col("n") - 1 - F.col("rn")).otherwise(F.col("rn")).alias("row_idx"),
        F.posexplode(values).alias("col_idx", "str"),
    ).withColumns({"kind": F.lit("str"), "num": F.lit(None).cast("double")})


# --- benchmark questions with categories and scores -------------------------

SQL_EXAMPLES = """fx_examples AS (SELECT doc_id, concat('test_', CAST(doc_id AS VARCHAR(20))) AS example_id,
       concat('db', CAST(doc_id % 37 AS VARCHAR(20))) AS db_id, source AS dataset, gt_category,
       CASE WHEN doc_id % 7 = 0 THEN 'U' WHEN doc_id % 11 = 0 THEN 'AA' ELSE gt_category END AS pred_category,
       CASE WHEN gt_category = 'AU' THEN 'null'
            WHEN doc_id % 3 = 0 THEN 'scope' WHEN doc_id % 3 = 1 THEN 'attachment' ELSE 'vague' END AS ambig_type,
       CAST(doc_id % 5 AS DOUBLE) / 4 AS prec, CAST(doc_id % 4 AS DOUBLE) / 3 AS rec
FROM (SELECT d.doc_id, d.source, CASE WHEN l.toxic = 1 THEN 'U' WHEN l.quality = 0 THEN 'AA' ELSE 'AU' END AS gt_category
      FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) t)"""


def examples(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "source")
    gt = F.when(F.col("toxic") == 1, "U").when(F.col("quality") == 0, "AA").otherwise("AU")
    k = F.col("doc_id")
    return d.join(table(spark, sf, "labels"), "doc_id", "left").select(
        "doc_id", F.concat(F.lit("test_"), k).alias("example_id"), F.concat(F.lit("db"), k % 37).alias("db_id"),
        F.col("source").alias("dataset"), gt.alias("gt_category"),
    ).withColumns({
        "pred_category": F.when(k % 7 == 0, "U").when(k % 11 == 0, "AA").otherwise(F.col("gt_category")),
        "ambig_type": F.when(F.col("gt_category") == "AU", "null").when(k % 3 == 0, "scope")
        .when(k % 3 == 1, "attachment").otherwise("vague"),
        "prec": (k % 5).cast("double") / 4, "rec": (k % 4).cast("double") / 3,
    })


SQL_SCORES = SQL_EXAMPLES + """, sc AS (SELECT *, CASE WHEN doc_id % 13 <> 0 THEN prec END AS precision, CASE WHEN doc_id % 13 <> 0 THEN rec END AS recall,
  CASE WHEN doc_id % 13 = 0 THEN NULL WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0 END AS f1,
  CASE WHEN doc_id % 13 <> 0 THEN least(1.0, prec + 0.25) END AS precision_flex, CASE WHEN doc_id % 13 <> 0 THEN least(1.0, rec + CAST(1 AS DOUBLE) / 3) END AS recall_flex,
  CASE WHEN doc_id % 13 <> 0 THEN least(1.0, (prec + rec) / 2) END AS f1_flex, doc_id % 4 = 0 AS correction_applied,
  CAST(doc_id % 3 - 1 AS DOUBLE) / 10 AS f1_improvement, doc_id % 10 = 0 AS reclassified_to_u FROM fx_examples),
pop AS (SELECT doc_id, gt_category, pred_category, ambig_type, dataset, correction_applied, f1_improvement,
  CASE WHEN pred_category = 'U' THEN 0 ELSE coalesce(precision, 0) END AS precision, CASE WHEN pred_category = 'U' THEN 0 ELSE coalesce(recall, 0) END AS recall,
  CASE WHEN pred_category = 'U' THEN 0 ELSE coalesce(f1, 0) END AS f1, CASE WHEN pred_category = 'U' THEN 0 ELSE coalesce(precision_flex, 0) END AS precision_flex,
  CASE WHEN pred_category = 'U' THEN 0 ELSE coalesce(recall_flex, 0) END AS recall_flex, CASE WHEN pred_category = 'U' THEN 0 ELSE coalesce(f1_flex, 0) END AS f1_flex
  FROM sc WHERE gt_category IN ('AU', 'AA'))"""


def scores(spark: SparkSession, sf: str) -> DataFrame:
    k, p, r = F.col("doc_id"), F.col("prec"), F.col("rec")
    done = k % 13 != 0
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return examples(spark, sf).withColumns({
        "precision": F.when(done, p), "recall": F.when(done, r), "f1": F.when(done, f1),
        "precision_flex": F.when(done, F.least(F.lit(1.0), p + 0.25)),
        "recall_flex": F.when(done, F.least(F.lit(1.0), r + F.lit(1.0) / 3)),
        "f1_flex": F.when(done, F.least(F.lit(1.0), (p + r) / 2)),
        "correction_applied": k % 4 == 0, "f1_improvement": (k % 3 - 1).cast("double") / 10,
        "reclassified_to_u": k % 10 == 0,
    })


# --- training log -----------------------------------------------------------

SQL_REWARDS = """fx_rewards AS (SELECT event_id AS step,
       CASE event_type WHEN 'view' THEN 'scope' WHEN 'click' THEN 'attachment' WHEN 'purchase' THEN 'vague' ELSE 'mixed' END AS stage,
       CAST(user_id % 3 AS BIGINT) AS epoch, CASE WHEN event_type = 'error' THEN 0.25 ELSE CAST(event_id % 101 AS DOUBLE) / 100 END AS reward
FROM events)"""


def rewards(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_type")
    return table(spark, sf, "events").select(
        F.col("event_id").alias("step"),
        F.when(e == "view", "scope").when(e == "click", "attachment").when(e == "purchase", "vague").otherwise("mixed").alias("stage"),
        (F.col("user_id") % 3).alias("epoch"),
        F.when(e == "error", 0.25).otherwise((F.col("event_id") % 101).cast("double") / 100).alias("reward"),
    )


# --- vectors ------------------------------------------------------------------

SQL_VEC = """fx_vec AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label,
       concat('q', CAST(label AS VARCHAR(20)), '_', CAST(vec_id % 8 AS VARCHAR(20))) AS question,
       CASE WHEN label % 2 = 0 THEN 'AA' ELSE 'AU' END AS category,
       CASE WHEN label % 2 = 1 THEN NULL WHEN label % 3 = 0 THEN 'scope' WHEN label % 3 = 1 THEN 'attachment' ELSE 'vague' END AS ambig_type
FROM embeddings),
sims AS (SELECT q.vec_id AS query_id, c.vec_id, q.question AS qq, c.question AS cq, q.category AS qc, c.category AS cc, q.ambig_type AS qt, c.ambig_type AS ct,
  round(list_dot_product(q.e, c.e), 9) AS similarity FROM fx_vec q JOIN fx_vec c ON q.vec_id % 20 = 0)"""


def vectors(spark: SparkSession, sf: str, part: str) -> DataFrame:
    """``part`` is query (every vector whose id is divisible by 20) or corpus (all)."""
    label, k = F.col("label"), F.col("vec_id")
    mine = (k % 20 == 0) if part == "query" else F.lit(True)
    return table(spark, sf, "embeddings").filter(mine).select(
        "vec_id", "embedding", "label", F.concat(F.lit("q"), label, F.lit("_"), k % 8).alias("question"),
        F.when(label % 2 == 0, "AA").otherwise("AU").alias("category"),
        F.when(label % 2 == 1, F.lit(None)).when(label % 3 == 0, "scope").when(label % 3 == 1, "attachment")
        .otherwise("vague").alias("ambig_type"),
    )


# --- logits -------------------------------------------------------------------

SQL_LOGITS = """fx_logits AS (SELECT doc_id, CAST(n_chars % 7 AS DOUBLE) / 2 AS l_u, CAST(n_chars % 5 AS DOUBLE) / 2 AS l_aa, CAST(n_chars % 3 AS DOUBLE) / 2 AS l_au,
  CASE doc_id % 3 WHEN 0 THEN 'Validation:  should_reclassify' WHEN 1 THEN 'VALIDATION: CONFIRMED_U then VALIDATION: SHOULD_RECLASSIFY' END AS verdict FROM documents)"""


def logits(spark: SparkSession, sf: str) -> DataFrame:
    n, k = F.col("n_chars"), F.col("doc_id")
    return table(spark, sf, "documents").select(
        "doc_id", ((n % 7).cast("double") / 2).alias("l_u"), ((n % 5).cast("double") / 2).alias("l_aa"),
        ((n % 3).cast("double") / 2).alias("l_au"),
        F.when(k % 3 == 0, "Validation:  should_reclassify")
        .when(k % 3 == 1, "VALIDATION: CONFIRMED_U then VALIDATION: SHOULD_RECLASSIFY").alias("verdict"))


# --- model replies ---------------------------------------------------------------

SQL_REPLIES = """fx_responses AS (SELECT p_partkey AS id, p_partkey % 8 AS fmt,
  CASE p_partkey % 8
    WHEN 0 THEN concat('{"sql_queries": ["SELECT p_name FROM part WHERE p_size = ', CAST(p_size AS VARCHAR(20)), '", "SELECT p_brand FROM part"]}')
    WHEN 1 THEN '{"corrected_queries": ["SELECT 1", " "]}'
    WHEN 2 THEN '{"interpretations": [{"interpretation": "by size", "sql_query": "SELECT p_size FROM part"}]}'
    WHEN 3 THEN concat('```sql', chr(10), 'SELECT p_name FROM part; SELECT p_size FROM part', chr(10), '```')
    WHEN 4 THEN concat('SELECT p_name FROM part', chr(10), chr(10), 'WITH t AS (SELECT 1) SELECT * FROM t')
    WHEN 5 THEN concat('-- Interpretation 1:', chr(10), 'SELECT 1', chr(10), '-- Interpretation 2:', chr(10), 'SELECT 2')
    WHEN 6 THEN concat('["', p_name, '", "', p_type, '"]')
    ELSE concat('Score: 0.', CAST(p_size AS VARCHAR(20))) END AS raw_text
FROM part)"""


def replies(spark: SparkSession, sf: str) -> DataFrame:
    p, k = table(spark, sf, "part"), F.col("p_partkey") % 8
    text = (
        F.when(k == 0, F.concat(F.lit('{"sql_queries": ["SELECT p_name FROM part WHERE p_size = '), "p_size",
                                F.lit('", "SELECT p_brand FROM part"]}')))
        .when(k == 1, '{"corrected_queries": ["SELECT 1", " "]}')
        .when(k == 2, '{"interpretations": [{"interpretation": "by size", "sql_query": "SELECT p_size FROM part"}]}')
        .when(k == 3, "```sql\nSELECT p_name FROM part; SELECT p_size FROM part\n```")
        .when(k == 4, "SELECT p_name FROM part\n\nWITH t AS (SELECT 1) SELECT * FROM t")
        .when(k == 5, "-- Interpretation 1:\nSELECT 1\n-- Interpretation 2:\nSELECT 2")
        .when(k == 6, F.concat(F.lit('["'), "p_name", F.lit('", "'), "p_type", F.lit('"]')))
        .otherwise(F.concat(F.lit("Score: 0."), "p_size"))
    )
    return p.select(F.col("p_partkey").alias("id"), k.alias("fmt"), text.alias("raw_text"))


# --- dumps: one small database per customer nation and segment ---------------------

SQL_DUMPS = """fx_dumps AS (SELECT c_custkey AS db_id, n AS t,
       concat('CREATE TABLE ', n, ' (', chr(10), 'id INTEGER,', chr(10), 'name TEXT,', chr(10), '  ', lower(c_mktsegment), ' REAL,', chr(10),
              'PRIMARY KEY (id)', chr(10), ');', chr(10), 'INSERT INTO t VALUES (', CAST(c_nationkey AS VARCHAR(20)), ');', chr(10), ' insert into t values (1);') AS db_dump,
       CASE WHEN c_custkey % 3 = 0 THEN concat('SELECT name, missing FROM ', n, ' WHERE id = 1')
            WHEN c_custkey % 3 = 1 THEN concat('SELECT t.name FROM ', n, ' t JOIN other o ON t.id = o.id ORDER BY t.name')
            ELSE concat('SELECT count(*) FROM ', n, ' GROUP BY ', lower(c_mktsegment)) END AS sql_text
FROM (SELECT *, lower(replace(n_name, ' ', '_')) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey) x)"""


def dumps(spark: SparkSession, sf: str) -> DataFrame:
    """One database per customer, named after its nation, with one statement."""
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.lower(
        F.replace("n_name", F.lit(" "), F.lit("_"))).alias("n"))
    c = table(spark, sf, "customer").join(nation, "c_nationkey")
    seg, k = F.lower("c_mktsegment"), F.col("c_custkey") % 3
    dump = F.concat(
        F.lit("CREATE TABLE "), "n", F.lit(" (\nid INTEGER,\nname TEXT,\n  "), seg,
        F.lit(" REAL,\nPRIMARY KEY (id)\n);\nINSERT INTO t VALUES ("), "c_nationkey", F.lit(");\n insert into t values (1);"))
    sql = (
        F.when(k == 0, F.concat(F.lit("SELECT name, missing FROM "), "n", F.lit(" WHERE id = 1")))
        .when(k == 1, F.concat(F.lit("SELECT t.name FROM "), "n", F.lit(" t JOIN other o ON t.id = o.id ORDER BY t.name")))
        .otherwise(F.concat(F.lit("SELECT count(*) FROM "), "n", F.lit(" GROUP BY "), seg))
    )
    return c.select(F.col("c_custkey").alias("db_id"), F.col("n").alias("t"), dump.alias("db_dump"), sql.alias("sql_text"))


# --- raw benchmark rows ---------------------------------------------------------------

SQL_RAW = """raw AS (SELECT doc_id AS row_idx, CASE doc_id % 4 WHEN 0 THEN 'train' WHEN 1 THEN 'test' WHEN 2 THEN ' train ' ELSE 'validation' END AS split,
  CASE WHEN doc_id % 9 = 0 THEN '  ' ELSE text END AS question, CASE WHEN doc_id % 5 = 0 THEN 'unanswerable' ELSE 'ambig' END AS question_type,
  CASE doc_id % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'FALSE' ELSE '' END AS is_ambiguous, CASE doc_id % 7 WHEN 0 THEN 'AA' WHEN 1 THEN ' ' ELSE '' END AS question_category,
  CASE WHEN doc_id % 2 = 0 THEN ' ' ELSE concat('CREATE ', source) END AS db_dump_processed, CASE WHEN doc_id % 8 = 0 THEN '' ELSE concat(lang, ' dump ') END AS db_dump,
  CASE WHEN doc_id % 13 = 0 THEN '' ELSE concat('db', doc_id % 37) END AS db_file_full,
  concat('SELECT  ', doc_id, chr(10), chr(10), ' SELECT', chr(10), ' 2 ', chr(10), chr(10), chr(10), chr(10)) AS gold_queries,
  CASE doc_id % 4 WHEN 0 THEN 'Scope' WHEN 1 THEN 'attachment' WHEN 2 THEN 'unanswerable' ELSE '' END AS ambig_type,
  CASE WHEN doc_id % 10 = 0 THEN '' ELSE concat('a ', chr(10), chr(10), ' b', doc_id) END AS nl_interpretations,
  CASE doc_id % 6 WHEN 0 THEN concat('["SELECT ', doc_id, '", "SELECT 1"]') WHEN 1 THEN concat('[''SELECT ', doc_id, ''']') WHEN 2 THEN 'not a list' WHEN 3 THEN '[]' ELSE '' END AS ambig_queries
FROM documents)"""


def raw_rows(spark: SparkSession, sf: str) -> DataFrame:
    d, k = table(spark, sf, "documents"), F.col("doc_id")

    def pick(mod, *values):
        out = F.when(k % mod == 0, values[0])
        for i, v in enumerate(values[1:], 1):
            out = out.when(k % mod == i, v)
        return out

    return d.select(
        k.alias("row_idx"), pick(4, "train", "test", " train ", "validation").alias("split"),
        F.when(k % 9 == 0, "  ").otherwise(F.col("text")).alias("question"),
        F.when(k % 5 == 0, "unanswerable").otherwise("ambig").alias("question_type"),
        pick(3, "true", "FALSE", "").alias("is_ambiguous"), pick(7, "AA", " ").otherwise("").alias("question_category"),
        F.when(k % 2 == 0, " ").otherwise(F.concat(F.lit("CREATE "), "source")).alias("db_dump_processed"),
        F.when(k % 8 == 0, "").otherwise(F.concat("lang", F.lit(" dump "))).alias("db_dump"),
        F.when(k % 13 == 0, "").otherwise(F.concat(F.lit("db"), k % 37)).alias("db_file_full"),
        F.concat(F.lit("SELECT  "), k, F.lit("\n\n SELECT\n 2 \n\n\n\n")).alias("gold_queries"),
        pick(4, "Scope", "attachment", "unanswerable", "").alias("ambig_type"),
        F.when(k % 10 == 0, "").otherwise(F.concat(F.lit("a \n\n b"), k)).alias("nl_interpretations"),
        F.when(k % 6 == 0, F.concat(F.lit('["SELECT '), k, F.lit('", "SELECT 1"]')))
        .when(k % 6 == 1, F.concat(F.lit("['SELECT "), k, F.lit("']"))).when(k % 6 == 2, "not a list")
        .when(k % 6 == 3, "[]").otherwise("").alias("ambig_queries"),
    )
