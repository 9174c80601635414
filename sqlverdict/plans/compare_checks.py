"""Registered queries for cell values and result comparison, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sqlverdict.functions import cells as C
from sqlverdict.operators import compare
from sqlverdict.plans import fixtures as fx

# --- cell values ----------------------------------------------------------

SQL_TEXT_CELLS = """t AS (
SELECT o_orderkey, CASE o_orderkey % 9
  WHEN 0 THEN ' NULL ' WHEN 1 THEN concat(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), '%')
  WHEN 2 THEN '1e3' WHEN 3 THEN concat(' ', o_orderstatus, chr(9)) WHEN 4 THEN '1,234.5'
  WHEN 5 THEN concat('007', chr(10)) WHEN 6 THEN '' WHEN 7 THEN o_orderpriority
  ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END AS s FROM orders)"""


def _text_cells(spark, sf):
    price = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    k = F.col("o_orderkey") % 9
    s = (
        F.when(k == 0, " NULL ").when(k == 1, F.concat(price, F.lit("%"))).when(k == 2, "1e3")
        .when(k == 3, F.concat(F.lit(" "), "o_orderstatus", F.lit("\t"))).when(k == 4, "1,234.5")
        .when(k == 5, "007\n").when(k == 6, "").when(k == 7, F.col("o_orderpriority")).otherwise(price)
    )
    return fx.table(spark, sf, "orders").select(
        "o_orderkey", C.raw_value(F.lit("str"), F.lit(None).cast("double"), s).alias("raw")
    )


def cell_normalize(spark, sf):
    n = _text_cells(spark, sf).withColumn("v", C.norm_value(F.col("raw")))
    return n.select("o_orderkey", F.col("v.n").alias("num"), F.col("v.x").alias("str"),
                    (F.col("v.n").isNull() & F.col("v.x").isNull()).alias("is_null"))


def cell_extract_number(spark, sf):
    return _text_cells(spark, sf).select("o_orderkey", C.number_of(F.col("raw.n"), F.col("raw.x")).alias("num"))


def row_normalize_sort(spark, sf):
    """Each order as a row of mixed cells, normalised and put in mixed-type order."""
    o = fx.table(spark, sf, "orders")
    none = F.lit(None).cast("string")
    row = F.array(
        C.raw_value(F.lit("str"), F.lit(None).cast("double"), F.col("o_orderpriority")),
        C.raw_value(F.lit("num"), F.col("o_totalprice"), none),
        C.raw_value(F.lit("null"), F.lit(None).cast("double"), none),
        C.raw_value(F.lit("num"), F.col("o_custkey").cast("double"), none),
        C.raw_value(F.lit("str"), F.lit(None).cast("double"), F.col("o_orderstatus")),
    )
    done = C.sort_row(C.normalize_row(row))
    return o.select(
        "o_orderkey", F.get(done, 0)["x"].alias("x0"), F.get(done, 1)["n"].alias("n1"),
        F.get(done, 2)["n"].alias("n2"), F.get(done, 3)["x"].alias("x3"), F.get(done, 4)["x"].alias("x4"),
    )


_TRIM = "trim(s, ' ' || chr(9) || chr(10) || chr(13))"

# --- shared SQL for results ------------------------------------------------

SQL_KEYED = fx.SQL_CELLS + """, c AS (
SELECT *, CASE WHEN num IS NOT NULL THEN concat('n:', num) WHEN str IS NOT NULL THEN concat('s:', str) ELSE 'z' END AS rk,
  CASE WHEN num IS NOT NULL THEN concat('n:', num) WHEN lower(trim(str)) IN ('null','none','') OR str IS NULL THEN 'z'
       WHEN TRY_CAST(trim(str) AS DOUBLE) IS NOT NULL THEN concat('n:', TRY_CAST(trim(str) AS DOUBLE))
       ELSE concat('s:', lower(trim(str))) END AS nk,
  coalesce(num, TRY_CAST(trim(str) AS DOUBLE)) AS nn,
  coalesce(num, TRY_CAST(trim(replace(replace(str, '%', ''), ',', '')) AS DOUBLE)) AS xn,
  CASE WHEN lower(trim(str)) IN ('1','true','yes','t','y') THEN 'n:1.0' WHEN lower(trim(str)) IN ('0','false','no','f','n') THEN 'n:0.0'
       WHEN num IS NOT NULL THEN concat('n:', num) ELSE concat('s:', str) END AS bk
FROM fx_cells),
shp AS (SELECT example_id, side, max(row_idx) + 1 AS nr, max(col_idx) + 1 AS nc FROM c GROUP BY 1, 2),
pr AS (SELECT DISTINCT w.ck AS example_id, w.is_ordered = 1 AS ordered, coalesce(p.nr, 0) AS pnr, coalesce(p.nc, 0) AS pnc, g.nr AS gnr, g.nc AS gnc
  FROM fx_wide w LEFT JOIN shp p ON p.example_id = w.ck AND p.side = 'pred' LEFT JOIN shp g ON g.example_id = w.ck AND g.side = 'gold' WHERE w.v <> 12)"""

SQL_BAG = """bagdiff AS (SELECT DISTINCT coalesce(a.example_id, b.example_id) AS example_id
  FROM (SELECT example_id, rk, count(*) AS n FROM c WHERE side = 'pred' GROUP BY 1, 2) a
  FULL JOIN (SELECT example_id, rk, count(*) AS n FROM c WHERE side = 'gold' GROUP BY 1, 2) b
  ON a.example_id = b.example_id AND a.rk = b.rk WHERE a.n IS DISTINCT FROM b.n),
e5 AS (SELECT example_id, example_id NOT IN (SELECT example_id FROM bagdiff) AS ok FROM pr)"""

SQL_ROWBAG = """rb AS (SELECT example_id, side, row_idx, list_sort(list(rk)) AS r FROM c GROUP BY 1, 2, 3),
e6 AS (SELECT pr.example_id, pnr = gnr AND pnc = gnc AND coalesce(m.n, 0) = gnr AS ok FROM pr LEFT JOIN (
  SELECT a.example_id, count(*) AS n FROM rb a JOIN rb b ON a.example_id = b.example_id AND a.row_idx = b.row_idx AND a.r = b.r
  WHERE a.side = 'pred' AND b.side = 'gold' GROUP BY 1) m ON m.example_id = pr.example_id)"""

SQL_NORM = """nr AS (SELECT example_id, side, row_idx, list(nk ORDER BY col_idx) AS r FROM c GROUP BY 1, 2, 3),
nro AS (SELECT a.example_id, count(*) AS n FROM nr a JOIN nr b ON a.example_id = b.example_id AND a.row_idx = b.row_idx AND a.r = b.r
  WHERE a.side = 'pred' AND b.side = 'gold' GROUP BY 1),
nru AS (SELECT DISTINCT coalesce(a.example_id, b.example_id) AS example_id
  FROM (SELECT example_id, r, count(*) AS n FROM nr WHERE side = 'pred' GROUP BY 1, 2) a
  FULL JOIN (SELECT example_id, r, count(*) AS n FROM nr WHERE side = 'gold' GROUP BY 1, 2) b
  ON a.example_id = b.example_id AND a.r = b.r WHERE a.n IS DISTINCT FROM b.n),
e12 AS (SELECT pr.example_id, pnr = gnr AND pnc = gnc AND CASE WHEN ordered THEN coalesce(nro.n, 0) = gnr
  ELSE pr.example_id NOT IN (SELECT example_id FROM nru) END AS ok FROM pr LEFT JOIN nro ON nro.example_id = pr.example_id)"""

_CELL_RULES = """CASE WHEN p.xn IS NULL OR g.xn IS NULL THEN p.nk = g.nk WHEN g.xn <> 0 THEN
    (p.xn / g.xn > 0.99 AND p.xn / g.xn < 1.01) OR (p.xn / g.xn > 99 AND p.xn / g.xn < 101) OR (p.xn / g.xn > 0.0099 AND p.xn / g.xn < 0.0101)
    ELSE p.xn = 0 END AS pct, p.bk = g.bk AS bool,
  CASE WHEN p.nn IS NOT NULL AND g.nn IS NOT NULL THEN abs(p.nn - g.nn) <= 0.01 ELSE p.nk = g.nk END AS tol, p.nk = g.nk AS same"""

SQL_POS = f"""posc AS (SELECT p.example_id, {_CELL_RULES}
  FROM c p JOIN c g ON p.example_id = g.example_id AND p.row_idx = g.row_idx AND p.col_idx = g.col_idx
  WHERE p.side = 'pred' AND g.side = 'gold'),
pos AS (SELECT pr.example_id, pnr = gnr AND pnc = gnc AND coalesce(pct, false) AS pct, pnr = gnr AND pnc = gnc AND coalesce(bool, false) AS bool,
  pnr = gnr AND pnc = gnc AND coalesce(tol, false) AS tol FROM pr LEFT JOIN
  (SELECT example_id, bool_and(pct) AS pct, bool_and(bool) AS bool, bool_and(tol) AS tol FROM posc GROUP BY 1) f ON f.example_id = pr.example_id)"""

# Column maps for the widths in the data: 3 or 4 onto 3, and gold 3 onto pred 2.
SQL_MAP = """mm AS (SELECT w.example_id, w.side AS wide_side, w.col_idx AS wc, n.col_idx AS nc, count(*) AS hits
  FROM c w JOIN c n ON w.example_id = n.example_id AND w.row_idx = n.row_idx AND w.side <> n.side AND w.nk = n.nk GROUP BY 1, 2, 3, 4),
ix AS (SELECT range AS i FROM range(4)),
cand AS (SELECT [a.i, b.i, d.i] AS m, 3 AS nn FROM ix a, ix b, ix d WHERE a.i <> b.i AND a.i <> d.i AND b.i <> d.i
  UNION ALL SELECT [a.i, b.i], 2 FROM ix a, ix b WHERE a.i <> b.i),
todo AS (SELECT example_id, CASE WHEN pnc >= gnc THEN 'pred' ELSE 'gold' END AS wide_side, greatest(pnc, gnc) AS nw, least(pnc, gnc) AS nn,
  least(pnr, gnr) AS n_zip, pnr, gnr, pnc, gnc FROM pr WHERE pnr > 0),
scored AS (SELECT t.example_id, t.wide_side, t.nn, cand.m, coalesce(sum(mm.hits), 0) AS score,
    CASE WHEN t.wide_side = 'pred' THEN t.pnr ELSE t.gnr END AS n
  FROM todo t JOIN cand ON cand.nn = t.nn AND list_max(cand.m) < t.nw
  CROSS JOIN LATERAL (SELECT unnest(range(t.nn)) AS j) s
  LEFT JOIN mm ON mm.example_id = t.example_id AND mm.wide_side = t.wide_side AND mm.nc = s.j AND mm.wc = cand.m[s.j + 1]
  GROUP BY 1, 2, 3, 4, 6),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY score DESC, list_sort(m), m) AS r FROM scored)
  WHERE r = 1 AND score > 0 AND score >= n * nn * 0.5)"""

SQL_FLEX = f"""usable AS (SELECT best.* FROM best JOIN pr ON pr.example_id = best.example_id
  WHERE pnr = gnr AND NOT (pnc = gnc AND m = range(gnc))),
prj AS (SELECT c.* REPLACE (CASE WHEN c.side = u.wide_side THEN list_position(u.m, c.col_idx) - 1 ELSE c.col_idx END AS col_idx)
  FROM c JOIN usable u ON u.example_id = c.example_id WHERE c.side <> u.wide_side OR list_contains(u.m, c.col_idx)),
f2 AS (SELECT example_id, bool_and(pct) AS pct, bool_and(bool) AS bool, bool_and(tol) AS tol, bool_and(same) AS same FROM (
  SELECT p.example_id, {_CELL_RULES} FROM prj p JOIN prj g ON p.example_id = g.example_id AND p.row_idx = g.row_idx AND p.col_idx = g.col_idx
  WHERE p.side = 'pred' AND g.side = 'gold') GROUP BY 1),
prow AS (SELECT example_id, side, row_idx, list(nk ORDER BY col_idx) AS r FROM prj GROUP BY 1, 2, 3),
pdiff AS (SELECT DISTINCT coalesce(a.example_id, b.example_id) AS example_id
  FROM (SELECT example_id, r, count(*) AS n FROM prow WHERE side = 'pred' GROUP BY 1, 2) a
  FULL JOIN (SELECT example_id, r, count(*) AS n FROM prow WHERE side = 'gold' GROUP BY 1, 2) b
  ON a.example_id = b.example_id AND a.r = b.r WHERE a.n IS DISTINCT FROM b.n),
strict AS (SELECT pr.example_id, CASE WHEN ordered THEN e6.ok ELSE e5.ok END AS ok FROM pr JOIN e5 USING (example_id) JOIN e6 USING (example_id)),
flex AS (SELECT pr.example_id, strict.ok AS strict, CASE WHEN pnr = 0 THEN 'none'
  WHEN pos.pct THEN 'percentage' WHEN pos.bool THEN 'boolean' WHEN pos.tol THEN 'tolerance' WHEN e12.ok THEN 'normalized'
  WHEN f2.pct THEN concat(pre, 'percentage') WHEN f2.bool THEN concat(pre, 'boolean') WHEN f2.tol THEN concat(pre, 'tolerance')
  WHEN f2.example_id IS NOT NULL AND CASE WHEN ordered THEN f2.same ELSE pr.example_id NOT IN (SELECT example_id FROM pdiff) END THEN concat(pre, 'normalized')
  WHEN strict.ok THEN 'strict' ELSE 'none' END AS rule
  FROM (SELECT *, CASE WHEN pnc = gnc THEN 'mapped+' WHEN pnc > gnc THEN 'wide+' ELSE 'narrow+' END AS pre FROM pr) pr
  JOIN pos USING (example_id) JOIN e12 USING (example_id) JOIN strict USING (example_id) LEFT JOIN f2 USING (example_id))"""

SQL_SUBSET = """short AS (SELECT DISTINCT g.example_id FROM (SELECT example_id, nk, count(*) AS n FROM c WHERE side = 'gold' GROUP BY 1, 2) g
  LEFT JOIN (SELECT example_id, nk, count(*) AS n FROM c WHERE side = 'pred' GROUP BY 1, 2) p
  ON p.example_id = g.example_id AND p.nk = g.nk WHERE coalesce(p.n, 0) < g.n),
e13 AS (SELECT example_id, example_id NOT IN (SELECT example_id FROM short) AS ok FROM pr)"""


def _run(fn, *columns):
    def query(spark, sf):
        return fn(fx.cell_pairs(spark, sf), fx.cells(spark, sf)).select("example_id", *columns)
    return query


def project_mapped(spark, sf):
    """Checksums of predicted results after projection onto gold columns."""
    all_cells = fx.cells(spark, sf)
    mapping = compare.column_mapping(fx.cell_pairs(spark, sf), all_cells)
    return compare.project_columns(all_cells, mapping).groupBy("example_id", "col_idx").agg(
        F.count("*").alias("n"), F.sum(F.col("num").cast("decimal(20,4)")).cast("double").alias("total"), F.max("str").alias("top")
    )


def _with_similarity(pairs):
    return pairs.withColumn("similarity", (F.col("example_id") % 10) / 10)


def flex_similarity(spark, sf):
    return compare.match_flex(_with_similarity(fx.cell_pairs(spark, sf)), fx.cells(spark, sf)).select(
        "example_id", "flex", "rule")


def strict_rate(spark, sf):
    """Match rate per variant under the unordered strict rule."""
    hits = compare.match_unordered(fx.cell_pairs(spark, sf), fx.cells(spark, sf))
    return hits.groupBy((F.col("example_id") % 15).alias("v")).agg(
        F.count("*").alias("n"), F.count_if("strict").alias("n_match"))


def _sql(*ctes, tail):
    return "WITH " + ",\n".join((SQL_KEYED, *ctes)) + "\n" + tail


QUERIES = {
    "cell_normalize": cell_normalize,
    "cell_extract_number": cell_extract_number,
    "row_normalize_sort": row_normalize_sort,
    "strict_rate": strict_rate,
    "match_strict_unordered": _run(compare.match_unordered, "strict"),
    "match_strict_ordered": _run(compare.match_ordered, "strict"),
    "match_strict": _run(compare.match_strict, "strict"),
    "match_normalized": _run(compare.match_normalized, "normalized"),
    "match_subset": _run(compare.match_subset, "subset"),
    "match_percentage": _run(compare.match_positional, "pct"),
    "match_boolean": _run(compare.match_positional, "bool"),
    "match_tolerance": _run(compare.match_positional, "tol"),
    "match_semantic": _run(compare.match_semantic, "semantic"),
    "column_mapping": _run(compare.column_mapping, "score", "gold_col", "pred_col"),
    "project_mapped": project_mapped,
    "match_flex": _run(compare.match_flex, "strict", "flex", "rule"),
    "match_flex_similarity": flex_similarity,
}

ORACLE = {
    "cell_normalize": f"""WITH {SQL_TEXT_CELLS}, u AS (SELECT o_orderkey, lower({_TRIM}) AS l FROM t)
SELECT o_orderkey, CASE WHEN l NOT IN ('null','none','') THEN TRY_CAST(l AS DOUBLE) END AS num,
  CASE WHEN l NOT IN ('null','none','') AND TRY_CAST(l AS DOUBLE) IS NULL THEN l END AS str,
  l IN ('null','none','') AS is_null FROM u""",
    "cell_extract_number": f"""WITH {SQL_TEXT_CELLS}
SELECT o_orderkey, TRY_CAST(replace(replace({_TRIM}, '%', ''), ',', '') AS DOUBLE) AS num FROM t""",
    "row_normalize_sort": """SELECT o_orderkey, CAST(NULL AS VARCHAR) AS x0, least(o_totalprice, o_custkey) AS n1, greatest(o_totalprice, o_custkey) AS n2,
  least(lower(o_orderpriority), lower(o_orderstatus)) AS x3, greatest(lower(o_orderpriority), lower(o_orderstatus)) AS x4 FROM orders""",
    "strict_rate": _sql(SQL_BAG, tail="SELECT example_id % 15 AS v, count(*) AS n, count(*) FILTER (ok) AS n_match FROM e5 GROUP BY 1"),
    "match_strict_unordered": _sql(SQL_BAG, tail="SELECT example_id, ok AS strict FROM e5"),
    "match_strict_ordered": _sql(SQL_ROWBAG, tail="SELECT example_id, ok AS strict FROM e6"),
    "match_strict": _sql(SQL_BAG, SQL_ROWBAG, tail="""SELECT pr.example_id, CASE WHEN ordered THEN e6.ok ELSE e5.ok END AS strict
FROM pr JOIN e5 USING (example_id) JOIN e6 USING (example_id)"""),
    "match_normalized": _sql(SQL_NORM, tail="SELECT example_id, ok AS normalized FROM e12"),
    "match_subset": _sql(SQL_SUBSET, tail="SELECT example_id, ok AS subset FROM e13"),
    "match_percentage": _sql(SQL_POS, tail="SELECT example_id, pct FROM pos"),
    "match_boolean": _sql(SQL_POS, tail="SELECT example_id, bool FROM pos"),
    "match_tolerance": _sql(SQL_POS, tail="SELECT example_id, tol FROM pos"),
    "match_semantic": _sql(SQL_POS, tail="SELECT example_id, pct OR bool OR tol AS semantic FROM pos"),
    "column_mapping": _sql(SQL_MAP, tail="""SELECT example_id, score, unnest(range(nn)) AS gold_col, unnest(m) AS pred_col
FROM best WHERE wide_side = 'pred'"""),
    "project_mapped": _sql(SQL_MAP, tail="""SELECT c.example_id, list_position(b.m, c.col_idx) - 1 AS col_idx, count(*) AS n, CAST(sum(CAST(num AS DECIMAL(20,4))) AS DOUBLE) AS total, max(str) AS top
FROM c JOIN best b ON b.example_id = c.example_id AND b.wide_side = 'pred' WHERE c.side = 'pred' AND list_contains(b.m, c.col_idx) GROUP BY 1, 2"""),
    "match_flex": _sql(SQL_BAG, SQL_ROWBAG, SQL_NORM, SQL_POS, SQL_MAP, SQL_FLEX,
                       tail="SELECT example_id, strict, rule <> 'none' AS flex, rule FROM flex"),
    "match_flex_similarity": _sql(SQL_BAG, SQL_ROWBAG, SQL_NORM, SQL_POS, SQL_MAP, SQL_FLEX, SQL_SUBSET, tail="""
SELECT example_id, r <> 'none' AS flex, r AS rule FROM (SELECT f.example_id, CASE WHEN f.rule NOT IN ('strict', 'none') THEN f.rule
  WHEN NOT ordered AND f.example_id % 10 > 7 AND pnr > 0 THEN CASE WHEN e13.ok THEN 'subset' ELSE 'none' END
  ELSE f.rule END AS r FROM flex f JOIN e13 USING (example_id) JOIN pr USING (example_id))"""),
}
