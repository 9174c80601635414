"""Registered queries for retrieval, similarity and routing, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sqlverdict.operators import lda, reports, retrieve
from sqlverdict.operators.textsim import PostingIndex, structural_scorer, structural_top_k, tfidf_fit, tfidf_similarity
from sqlverdict.plans import fixtures as fx


def _sides(spark, sf):
    return fx.vectors(spark, sf, "query"), fx.vectors(spark, sf, "corpus")


def _shown(df, *more):
    return df.select("query_id", "rank", "vec_id", F.round("similarity", 6).alias("similarity"), *more)


def topk(spark, sf):
    return _shown(retrieve.top_k(*_sides(spark, sf), k=5))


def topk_grid(spark, sf):
    """The same search in many chunks, as for a large query side."""
    return _shown(retrieve.top_k(*_sides(spark, sf), k=5, chunk_rows=8, chunk_bytes=4000))


def topk_by_category(spark, sf):
    return _shown(retrieve.top_k_by_category(*_sides(spark, sf)), "bucket")


def topk_by_type(spark, sf):
    return _shown(retrieve.top_k_by_type(*_sides(spark, sf), k_same=4, k_mixed=2), "bucket")


def hybrid_rerank(spark, sf):
    q, c = _sides(spark, sf)
    out = retrieve.hybrid_rerank(q, c, structural_scorer(q, c), k=5)
    return _shown(out, F.round("hybrid", 6).alias("hybrid"), "bucket")


def retrieval_policy(spark, sf):
    q, c = _sides(spark, sf)
    q = q.withColumn("confidence", (F.col("vec_id") % 4) / 4 + F.when(F.col("label") % 4 == 0, 0.5).otherwise(0.1))
    return _shown(retrieve.retrieve(q, c, structural_scorer(q, c), k=3, k_other=2), "path")


def policy_predicted(spark, sf):
    """The policy with types that the classifier predicts."""
    q, c = _sides(spark, sf)
    model = lda.lda_fit(c.filter("ambig_type IS NOT NULL"), "ambig_type")
    return _shown(retrieve.retrieve_predicted(q, c, structural_scorer(q, c), model, k=3, k_other=2), "path")


def vote_share(spark, sf):
    q, c = _sides(spark, sf)
    near = retrieve.top_k(q, c, k=50)
    out = retrieve.vote_share(near, c, structural_scorer(q, c))
    return out.select("query_id", "ambig_type", F.round("share", 6).alias("share"))


def tfidf_sim(spark, sf):
    """Each reply against the turn before it in the same conversation."""
    t = fx.table(spark, sf, "conversations").withColumn("id", F.concat_ws("_", "conv_id", "turn"))
    q = t.select(F.col("id").alias("query_id"), "text", "conv_id", "turn")
    c = t.select(F.col("id").alias("vec_id"), "text", "conv_id", (F.col("turn") + 1).alias("turn"))
    pairs = q.join(c.drop("text"), ["conv_id", "turn"]).select("query_id", "vec_id")
    vocabulary = tfidf_fit(c, "vec_id", "text")
    out = tfidf_similarity(pairs, q, c, vocabulary, "text")
    return out.select("query_id", "vec_id", F.round("structural", 6).alias("structural"))


def structural_topk(spark, sf):
    """Messages most similar in structure to every message whose id is divisible by 20, among all messages."""
    t = fx.table(spark, sf, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).cast("bigint").alias("vec_id"), "text")
    out = structural_top_k(t.filter("vec_id % 20 = 0"), PostingIndex(t, "text"), k=5)
    return out.select("query_id", "rank", "vec_id", F.round("structural", 6).alias("structural"))


def softmax_route(spark, sf):
    lg = fx.logits(spark, sf)
    return retrieve.route(lg.drop("verdict"), lg.select("doc_id", "verdict")).select(
        "doc_id", "category", "validated", *[F.round(p, 6).alias(p) for p in ("p_u", "p_aa", "p_au")])


def _model(spark, sf):
    return lda.lda_fit(fx.vectors(spark, sf, "corpus").filter("ambig_type IS NOT NULL"), "ambig_type")


def lda_means(spark, sf):
    """Class counts and means that the classifier is fitted from."""
    m = _model(spark, sf)
    rows = [(c, int(n), i, float(v)) for c, n, mean in zip(m.classes, m.counts, m.means) for i, v in enumerate(mean)]
    return spark.createDataFrame(rows, "ambig_type string, n bigint, dim int, mean double").withColumn("mean", F.round("mean", 6) + 0.0)


def lda_covariance(spark, sf):
    """The pooled covariance within classes."""
    m = _model(spark, sf)
    rows = [(i, j, float(v)) for i, row in enumerate(m.covariance) for j, v in enumerate(row)]
    return spark.createDataFrame(rows, "i int, j int, value double").withColumn("value", F.round("value", 6) + 0.0)


def lda_predict(spark, sf):
    q, c = _sides(spark, sf)
    model = lda.lda_fit(c.filter("ambig_type IS NOT NULL"), "ambig_type")
    return lda.lda_predict(q, model, top_k=3).select("vec_id", F.posexplode("predictions").alias("pos", "p")).select(
        "vec_id", "pos", "p.*")


def lda_topk_accuracy(spark, sf):
    q, c = _sides(spark, sf)
    model = lda.lda_fit(c.filter("ambig_type IS NOT NULL"), "ambig_type")
    preds = lda.lda_predict(q.filter("ambig_type IS NOT NULL"), model, top_k=2).withColumn(
        "labels", F.col("predictions.label"))
    return reports.topk_accuracy(preds, "labels", "ambig_type", by="ambig_type")


QUERIES = {
    "topk": topk, "topk_grid": topk_grid, "topk_by_category": topk_by_category, "topk_by_type": topk_by_type,
    "hybrid_rerank": hybrid_rerank, "retrieval_policy": retrieval_policy, "policy_predicted": policy_predicted, "vote_share": vote_share,
    "tfidf_sim": tfidf_sim, "structural_topk": structural_topk, "softmax_route": softmax_route, "lda_predict": lda_predict, "lda_means": lda_means, "lda_covariance": lda_covariance,
    "lda_topk_accuracy": lda_topk_accuracy,
}

_TOP = "row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id)"


def _near(name: str, k: str) -> str:
    """Plain neighbours: the first k + 1, then without the question's own repeats."""
    return f"""{name} AS (SELECT * FROM (SELECT *, {_TOP} AS rank FROM (SELECT *, {_TOP} AS place FROM sims) WHERE place <= {k} + 1 AND qq <> cq) WHERE rank <= {k})"""


def _tfidf(docs: str) -> str:
    """Weights wt(side, id, term, w) over dq (queries) and dc (corpus), vocabulary from the corpus."""
    return f"""{docs},
grams AS (SELECT side, id, substr(w, CAST(i AS BIGINT), CAST(n AS BIGINT)) AS term FROM (
  SELECT side, id, w, n, unnest(range(1, length(w) - n + 2)) AS i FROM (
    SELECT side, id, concat(' ', u, ' ') AS w FROM (SELECT side, id, unnest(string_split_regex(lower(t), '\\s+')) AS u FROM docs) WHERE u <> ''), (VALUES (1), (2), (3)) s(n))),
tf AS (SELECT side, id, term, count(*) AS tf FROM grams GROUP BY 1, 2, 3),
vocab AS (SELECT term, ln((1 + (SELECT count(*) FROM docs WHERE side = 'c')) / (1 + df)) + 1 AS idf FROM (
  SELECT term, count(*) AS df, sum(tf) AS total FROM tf WHERE side = 'c' GROUP BY 1 ORDER BY total DESC, term LIMIT 5000)),
wt AS (SELECT side, id, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY side, id)) AS w FROM tf JOIN vocab USING (term))"""


_VEC_DOCS = """docs AS (SELECT 'c' AS side, vec_id AS id, question AS t FROM fx_vec
  UNION ALL SELECT 'q', vec_id, question FROM fx_vec WHERE vec_id % 20 = 0)"""
_STRUCT = _tfidf(_VEC_DOCS) + """,
fq AS (SELECT question, min(vec_id) AS first_id FROM fx_vec GROUP BY 1),
st AS (SELECT a.id AS query_id, b.id AS first_id, sum(a.w * b.w) AS s FROM wt a JOIN wt b ON a.side = 'q' AND b.side = 'c' AND a.term = b.term
  JOIN fq ON fq.first_id = b.id GROUP BY 1, 2)"""


def _hybrid(w_sem: float, w_str: float, k: int, where: str) -> str:
    return f"""{_near('cand', str(10 * k))},
typed AS (SELECT c.*, {w_sem} * similarity + {w_str} * coalesce(st.s, 0) AS hybrid FROM cand c JOIN fq ON fq.question = c.cq
  LEFT JOIN st ON st.query_id = c.query_id AND st.first_id = fq.first_id WHERE c.qt = c.ct AND {where}),
chosen AS (SELECT * FROM (SELECT query_id, vec_id, cq, similarity, hybrid, row_number() OVER (PARTITION BY query_id ORDER BY round(hybrid, 9) DESC, similarity DESC, vec_id) AS rank FROM typed) WHERE rank <= {k}),
shortq AS (SELECT q.query_id, {k} - count(c.vec_id) AS miss FROM (SELECT DISTINCT query_id FROM sims c WHERE {where}) q LEFT JOIN chosen c USING (query_id) GROUP BY 1),
fill AS (SELECT query_id, vec_id, cq, similarity, {k} - miss + n AS rank FROM (SELECT s.*, miss, row_number() OVER (PARTITION BY query_id ORDER BY place) AS n
  FROM (SELECT *, {_TOP} AS place FROM sims) s JOIN shortq USING (query_id) WHERE place <= miss + 1 AND miss > 0 AND qq <> cq) WHERE n <= miss)"""


_LDA = """flat AS (SELECT vec_id, ambig_type, count(*) OVER (PARTITION BY ambig_type, dim) AS n, dim, x FROM (
  SELECT vec_id, ambig_type, unnest(e) AS x, generate_subscripts(e, 1) AS dim FROM fx_vec WHERE ambig_type IS NOT NULL))"""


def _sql(*ctes: str, tail: str) -> str:
    return "WITH " + ",\n".join((fx.SQL_VEC, *ctes)) + "\n" + tail


_PLAIN = "SELECT query_id, rank, vec_id, round(similarity, 6) AS similarity FROM near"
_CONF = "(q.vec_id % 4) / 4 + CASE WHEN q.label % 4 = 0 THEN 0.5 ELSE 0.1 END"
_IS_HYBRID = "query_id IN (SELECT vec_id FROM hy)"

ORACLE = {
    "topk": _sql(_near("near", "5"), tail=_PLAIN),
    "topk_grid": _sql(_near("near", "5"), tail=_PLAIN),
    "topk_by_category": _sql(tail="""SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY bucket DESC, r) AS rank, vec_id, round(similarity, 6) AS similarity, bucket
FROM (SELECT *, row_number() OVER (PARTITION BY query_id, bucket ORDER BY similarity DESC, vec_id) AS r
  FROM (SELECT *, CASE WHEN qc = cc THEN 'same' ELSE 'other' END AS bucket FROM sims WHERE qq <> cq)) WHERE r <= CASE bucket WHEN 'same' THEN 3 ELSE 1 END"""),
    "topk_by_type": _sql(tail="""SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY bucket DESC, r) AS rank, vec_id, round(similarity, 6) AS similarity, bucket
FROM (SELECT *, row_number() OVER (PARTITION BY query_id, bucket ORDER BY similarity DESC, vec_id) AS r
  FROM (SELECT *, CASE WHEN qt IS NOT DISTINCT FROM ct THEN 'same' ELSE 'other' END AS bucket FROM sims WHERE qq <> cq)) WHERE r <= CASE bucket WHEN 'same' THEN 4 ELSE 2 END"""),
    "hybrid_rerank": _sql(_STRUCT, _hybrid(0.7, 0.3, 5, "true"), tail="""
SELECT query_id, rank, vec_id, round(similarity, 6) AS similarity, round(hybrid, 6) AS hybrid, 'type' AS bucket FROM chosen
UNION ALL SELECT query_id, rank, vec_id, round(similarity, 6), NULL, 'fill' FROM fill"""),
    "retrieval_policy": _sql(f"""hy AS (SELECT vec_id FROM fx_vec q WHERE vec_id % 20 = 0 AND category = 'AA' AND ambig_type IN ('attachment', 'scope') AND {_CONF} >= 0.7)""",
        _STRUCT, _hybrid(0.3, 0.7, 3, "c." + _IS_HYBRID), _near("near", "5"), f"""hyb AS (SELECT query_id, rank, vec_id, cq, similarity FROM chosen UNION ALL SELECT query_id, rank, vec_id, cq, similarity FROM fill),
others AS (SELECT query_id, vec_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM near
  WHERE {_IS_HYBRID} AND (query_id, cq) NOT IN (SELECT (query_id, cq) FROM hyb)),
cat AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY bucket DESC, r) AS rank, vec_id, similarity
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id, bucket ORDER BY similarity DESC, vec_id) AS r
    FROM (SELECT *, CASE WHEN qc = cc THEN 'same' ELSE 'other' END AS bucket FROM sims WHERE qq <> cq)) WHERE r <= CASE bucket WHEN 'same' THEN 3 ELSE 2 END)""", tail=f"""
SELECT query_id, rank, vec_id, round(similarity, 6) AS similarity, 'hybrid' AS path FROM hyb
UNION ALL SELECT o.query_id, o.n + coalesce(h.k, 0), o.vec_id, round(o.similarity, 6), 'other' FROM others o LEFT JOIN (SELECT query_id, count(*) AS k FROM hyb GROUP BY 1) h USING (query_id) WHERE o.n <= 2
UNION ALL SELECT query_id, rank, vec_id, round(similarity, 6), 'category' FROM cat WHERE NOT {_IS_HYBRID}"""),
    "vote_share": _sql(_STRUCT, _near("near", "50"), tail="""
SELECT query_id, ambig_type, round(w / sum(w) OVER (PARTITION BY query_id), 6) AS share FROM (
  SELECT n.query_id, n.ct AS ambig_type, sum(0.7 * similarity + 0.3 * coalesce(st.s, 0)) AS w FROM near n JOIN fq ON fq.question = n.cq
  LEFT JOIN st ON st.query_id = n.query_id AND st.first_id = fq.first_id GROUP BY 1, 2) QUALIFY sum(w) OVER (PARTITION BY query_id) > 0"""),
    "tfidf_sim": "WITH " + _tfidf("""tt AS (SELECT concat(conv_id, '_', turn) AS id, conv_id, turn, text FROM conversations),
docs AS (SELECT 'c' AS side, id, text AS t FROM tt UNION ALL SELECT 'q', id, text FROM tt)""") + """,
pr AS (SELECT a.id AS query_id, b.id AS vec_id FROM tt a JOIN tt b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1)
SELECT pr.query_id, pr.vec_id, round(coalesce(any_value(d.s), 0), 6) AS structural FROM pr LEFT JOIN (
  SELECT pr.query_id, pr.vec_id, sum(a.w * b.w) AS s FROM pr JOIN wt a ON a.side = 'q' AND a.id = pr.query_id JOIN wt b ON b.side = 'c' AND b.id = pr.vec_id AND b.term = a.term GROUP BY 1, 2) d
  ON d.query_id = pr.query_id AND d.vec_id = pr.vec_id GROUP BY 1, 2""",
    "structural_topk": "WITH " + _tfidf("""tt AS (SELECT conv_id * 100 + turn AS id, text FROM conversations),
docs AS (SELECT 'c' AS side, id, text AS t FROM tt UNION ALL SELECT 'q', id, text FROM tt WHERE id % 20 = 0)""") + """,
s AS (SELECT a.id AS query_id, b.id AS vec_id, sum(a.w * b.w) AS s FROM wt a JOIN wt b ON a.side = 'q' AND b.side = 'c' AND b.term = a.term AND b.id <> a.id GROUP BY 1, 2)
SELECT query_id, rank, vec_id, round(s, 6) AS structural FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
    "lda_means": _sql(_LDA, tail="""
SELECT ambig_type, any_value(n) AS n, (dim - 1)::INT AS dim, round(avg(x), 6) + 0.0 AS mean FROM flat GROUP BY ambig_type, dim"""),
    "lda_covariance": _sql(_LDA, tail="""
, centred AS (SELECT vec_id, dim, x - avg(x) OVER (PARTITION BY ambig_type, dim) AS x FROM flat),
k AS (SELECT count(*) - count(DISTINCT ambig_type) AS free FROM fx_vec WHERE ambig_type IS NOT NULL)
SELECT (a.dim - 1)::INT AS i, (b.dim - 1)::INT AS j, round(sum(a.x * b.x) / any_value(free), 6) + 0.0 AS value
FROM centred a JOIN centred b ON a.vec_id = b.vec_id, k GROUP BY 1, 2"""),
    "softmax_route": f"""WITH {fx.SQL_LOGITS}, e AS (SELECT *, exp(l_u) AS a, exp(l_aa) AS b, exp(l_au) AS c FROM fx_logits),
g AS (SELECT *, CASE WHEN l_u >= l_aa AND l_u >= l_au THEN 'U' WHEN l_aa >= l_au THEN 'AA' ELSE 'AU' END AS cat FROM e)
SELECT doc_id, CASE WHEN cat = 'U' AND doc_id % 3 = 0 THEN 'AA' ELSE cat END AS category, cat = 'U' AND verdict IS NOT NULL AS validated,
round(a / (a + b + c), 6) AS p_u, round(b / (a + b + c), 6) AS p_aa, round(c / (a + b + c), 6) AS p_au FROM g""",
}
