"""Registered queries for dumps, questions and replies, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sqlverdict.functions import text as tx
from sqlverdict.operators import quality, replies
from sqlverdict.plans import fixtures as fx


def _dump(expr):
    def query(spark, sf):
        return fx.dumps(spark, sf).select("db_id", expr().alias("out"))
    return query


def _reply(fn, *args):
    def query(spark, sf):
        return fn(fx.replies(spark, sf), *args)
    return query


def _reply_column(expr):
    def query(spark, sf):
        return fx.replies(spark, sf).select("id", expr().alias("out"))
    return query


def quantifier_marker(spark, sf):
    d = fx.table(spark, sf, "documents")
    return d.select("doc_id", tx.quantifier_marker(F.col("text")).alias("marker"))


def yes_no(spark, sf):
    """Yes or no in every conversation turn."""
    return fx.table(spark, sf, "conversations").select("conv_id", "turn", tx.yes_no(F.col("text")).alias("answer"))


def interpretation_lines(spark, sf):
    """Lines of all conversation turns as interpretations."""
    t = fx.table(spark, sf, "conversations").select(F.concat_ws("_", "conv_id", "turn").alias("id"), F.col("text").alias("raw_text"))
    return replies.interpretation_list(t)


def numbered_list(spark, sf):
    p = fx.table(spark, sf, "part")
    text = F.concat(F.lit("Readings:\n 1. "), "p_name", F.lit(" \n- skip\n22.  "), "p_type", F.lit("\n3."))
    return replies.numbered_list(p.select(F.col("p_partkey").alias("id"), text.alias("raw_text")))


def json_interpretations(spark, sf):
    p = fx.table(spark, sf, "part")
    k = F.col("p_partkey") % 4
    text = (
        F.when(k == 0, F.concat(F.lit('Sure: {"interpretations": ["'), "p_name", F.lit('", {"text": "'), "p_type", F.lit('"}, 5]} done')))
        .when(k == 1, F.concat(F.lit('{"interpretation": "'), "p_name", F.lit('"}')))
        .when(k == 2, F.concat(F.lit('{"interpretation": ["'), "p_name", F.lit('", "'), "p_brand", F.lit('"]}')))
        .otherwise("no json here"))
    return replies.json_interpretations(p.select(F.col("p_partkey").alias("id"), text.alias("raw_text")))


def json_recovery(spark, sf):
    """Damaged replies: fences, prose around the object, bad escapes, extra data."""
    p = fx.table(spark, sf, "part")
    k = F.col("p_partkey") % 5
    body = F.concat(F.lit('{"sql_queries": ["SELECT '), "p_size", F.lit('"]}'))
    text = (
        F.when(k == 0, body).when(k == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(k == 2, F.concat(F.lit("Here you are: "), body, F.lit(" - done")))
        .when(k == 3, F.concat(F.lit('{"sql_queries": ["SELECT \\d'), "p_size", F.lit('"]}')))
        .otherwise(F.concat(body, F.lit(" and more"))))
    return replies.json_queries(p.select(F.col("p_partkey").alias("id"), text.alias("raw_text"))).select(
        "id", "pos", "sql", "parse_mode")


def analysis_replies(spark, sf):
    p = fx.table(spark, sf, "part")
    text = F.concat(F.lit("Hello\n**Ambiguity Analysis**: size of "), "p_name", F.lit("\n\nSELECT p_size\n-- note\nFROM part"))
    return replies.reply_queries(p.select(F.col("p_partkey").alias("id"), text.alias("raw_text")))


def schema_entities(spark, sf):
    return quality.schema_entities(fx.dumps(spark, sf))


def _statements(spark, sf):
    return fx.dumps(spark, sf).select(F.col("db_id").alias("id"), "db_id", F.col("sql_text").alias("sql"))


def statement_entities(spark, sf):
    return quality.statement_entities(_statements(spark, sf))


def unknown_entities(spark, sf):
    return quality.unknown_entities(_statements(spark, sf), schema_entities(spark, sf))


def schema_correctness(spark, sf):
    return quality.schema_correctness(_statements(spark, sf), fx.dumps(spark, sf)).select(
        "id", F.round("schema_correctness", 6).alias("schema_correctness"), F.array_join("issues", "; ").alias("issues"))


def interpretation_quality(spark, sf):
    """Statements with the embedding of their id as question and of the next id as interpretation."""
    e = fx.table(spark, sf, "embeddings")
    s = _statements(spark, sf).withColumns({
        "ok": F.col("id") % 4 > 0, "error": F.when(F.col("id") % 4 == 0, "no such column: missing")})
    q = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("question_vec"))
    i = e.select((F.col("vec_id") - 1).alias("id"), F.col("embedding").alias("interpretation_vec"))
    full = s.join(q, "id", "left").join(i, "id", "left")
    return quality.interpretation_quality(full, fx.dumps(spark, sf)).select(
        "id", *[F.round(c, 6).alias(c) for c in ("semantic_similarity", "schema_correctness", "overall_score")],
        "execution_success", F.array_join("issues", "; ").alias("issues"))


QUERIES = {
    "strip_inserts": _dump(lambda: tx.strip_inserts(F.col("db_dump"))),
    "strip_inserts_case": _dump(lambda: tx.strip_inserts(F.col("db_dump"), any_case=False)),
    "schema_skeleton": _dump(lambda: tx.schema_skeleton(F.col("db_dump"))),
    "embedding_text": _dump(lambda: tx.embedding_text(F.col("t"), F.col("db_dump"))),
    "quantifier_marker": quantifier_marker, "yes_no": yes_no,
    "extract_statements": _reply(replies.extract_statements),
    "read_only_statements": lambda spark, sf: replies.read_only(
        replies.extract_statements(fx.replies(spark, sf)), allow_with=False),
    "interpretation_list": _reply(replies.interpretation_list), "interpretation_lines": interpretation_lines,
    "json_queries": _reply(replies.json_queries), "json_recovery": json_recovery,
    "reply_queries": _reply(replies.reply_queries),
    "reply_corrections": _reply(replies.reply_queries, "correction"),
    "parse_modes": _reply(replies.parse_modes), "analysis_replies": analysis_replies,
    "single_statement": _reply(replies.single_statement), "json_interpretations": json_interpretations,
    "numbered_list": numbered_list, "score_text": _reply_column(lambda: tx.score_of_text(F.col("raw_text"))),
    "format_reward": _reply_column(lambda: tx.format_reward(F.col("raw_text"))),
    "quality_gate": _reply_column(lambda: tx.quality_gate(F.col("raw_text"), F.lit(0.8))),
    "schema_entities": schema_entities, "statement_entities": statement_entities, "unknown_entities": unknown_entities,
    "schema_correctness": schema_correctness, "interpretation_quality": interpretation_quality,
}


def _dumps(tail):
    return f"WITH {fx.SQL_DUMPS}\n{tail}"


def _replies(tail):
    return f"WITH {fx.SQL_REPLIES}\n{tail}"


_LINES = "list_transform(string_split(db_dump, chr(10)), lambda x: trim(x))"
_SKELETON = (f"array_to_string(list_filter({_LINES}, lambda x: upper(x) LIKE 'CREATE%' OR upper(x) LIKE 'FOREIGN KEY%' "
             "OR upper(x) LIKE 'PRIMARY KEY%' OR upper(x) LIKE ');%'), chr(10))")
_ONE = "SELECT id, 0 AS pos, "
_PARTS = "SELECT id, pos, sql FROM (SELECT id, unnest(l) AS sql, unnest(range(len(l))) AS pos FROM ({}))"
_SEG = "lower(c_mktsegment)"
_ENT = f"""ent AS (SELECT c_custkey AS id, lower(replace(n_name, ' ', '_')) AS n, {_SEG} AS seg FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
_BAD = """bad AS (SELECT id, CASE id % 3 WHEN 1 THEN 'Invalid tables: other; Potentially invalid columns: tname'
  WHEN 0 THEN 'Potentially invalid columns: missing' ELSE '' END AS issues FROM ent)"""

ORACLE = {
    "strip_inserts": _dumps("SELECT db_id, array_to_string(list_filter(string_split(db_dump, chr(10)), lambda x: NOT upper(trim(x)) LIKE 'INSERT INTO%'), chr(10)) AS out FROM fx_dumps"),
    "strip_inserts_case": _dumps("SELECT db_id, array_to_string(list_filter(string_split(db_dump, chr(10)), lambda x: NOT trim(x) LIKE 'INSERT INTO%'), chr(10)) AS out FROM fx_dumps"),
    "schema_skeleton": _dumps(f"SELECT db_id, {_SKELETON} AS out FROM fx_dumps"),
    "embedding_text": _dumps(f"SELECT db_id, concat('Question: ', t, chr(10), 'Schema: ', {_SKELETON}) AS out FROM fx_dumps"),
    "quantifier_marker": """SELECT doc_id, CASE WHEN len(q) > 0 THEN concat('QUANT_', array_to_string(q, ' ')) ELSE '' END AS marker FROM (
SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda w: w IN ('each', 'every', 'all', 'some', 'any')) AS q FROM documents)""",
    "yes_no": "SELECT conv_id, turn, CASE WHEN contains(lower(text), 'yes') THEN 'yes' WHEN contains(lower(text), 'no') THEN 'no' ELSE 'n/a' END AS answer FROM conversations",
    "extract_statements": _replies(_PARTS.format("""SELECT id, CASE fmt WHEN 3 THEN ['SELECT p_name FROM part', 'SELECT p_size FROM part']
  WHEN 4 THEN ['SELECT p_name FROM part', 'WITH t AS (SELECT 1) SELECT * FROM t'] ELSE [raw_text] END AS l FROM fx_responses""")),
    "read_only_statements": _replies("""SELECT id, unnest(['SELECT p_name FROM part', 'SELECT p_size FROM part']) AS sql, unnest([0, 1]) AS pos FROM fx_responses WHERE fmt = 3
UNION ALL SELECT id, 'SELECT p_name FROM part', 0 FROM fx_responses WHERE fmt = 4"""),
    "interpretation_list": _replies("""SELECT id, unnest(l) AS interpretation, unnest(range(len(l))) AS pos FROM (SELECT id, list_transform(list_filter(list_transform(
  string_split(CASE WHEN fmt = 3 THEN 'SELECT p_name FROM part; SELECT p_size FROM part' ELSE raw_text END, chr(10)), lambda x: trim(x)), lambda x: x <> ''),
  lambda x: regexp_replace(x, '^\\s*(?:\\d+\\.|[-•])\\s*', '')) AS l FROM fx_responses)"""),
    "interpretation_lines": """SELECT id, unnest(l) AS interpretation, unnest(range(len(l))) AS pos FROM (SELECT concat(conv_id, '_', turn) AS id, list_transform(list_filter(list_transform(
  string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), lambda x: regexp_replace(x, '^\\s*(?:\\d+\\.|[-•])\\s*', '')) AS l FROM conversations)""",
    "json_queries": _replies("""SELECT id, pos, sql, CAST(NULL AS VARCHAR) AS analysis, 'direct' AS parse_mode FROM (
  SELECT id, 0 AS pos, json_extract_string(raw_text, '$.sql_queries[0]') AS sql FROM fx_responses WHERE fmt = 0
  UNION ALL SELECT id, 1, json_extract_string(raw_text, '$.sql_queries[1]') FROM fx_responses WHERE fmt = 0
  UNION ALL SELECT id, 0, json_extract_string(raw_text, '$.corrected_queries[0]') FROM fx_responses WHERE fmt = 1
  UNION ALL SELECT id, 0, json_extract_string(raw_text, '$.interpretations[0].sql_query') FROM fx_responses WHERE fmt = 2)"""),
    "json_recovery": """SELECT p_partkey AS id, 0 AS pos, concat('SELECT ', CASE WHEN p_partkey % 5 = 3 THEN '\\d' ELSE '' END, p_size) AS sql,
CASE p_partkey % 5 WHEN 0 THEN 'direct' WHEN 1 THEN 'cleaned_escapes' WHEN 2 THEN 'cleaned_escapes' WHEN 3 THEN 'escapes' ELSE 'extra' END AS parse_mode FROM part""",
    "reply_queries": _replies("""SELECT id, pos, sql, CAST(NULL AS VARCHAR) AS analysis, CASE WHEN fmt <= 2 THEN 'json:direct' ELSE 'text' END AS parse_mode FROM (
  SELECT id, fmt, unnest(l) AS sql, unnest(range(len(l))) AS pos FROM (SELECT id, fmt, CASE fmt
    WHEN 0 THEN [json_extract_string(raw_text, '$.sql_queries[0]'), json_extract_string(raw_text, '$.sql_queries[1]')]
    WHEN 1 THEN ['SELECT 1'] WHEN 2 THEN ['SELECT p_size FROM part'] WHEN 3 THEN ['SELECT p_name FROM part; SELECT p_size FROM part']
    WHEN 4 THEN ['SELECT p_name FROM part', 'WITH t AS (SELECT 1) SELECT * FROM t'] WHEN 5 THEN ['SELECT 1', 'SELECT 2'] ELSE [] END AS l FROM fx_responses))"""),
    "reply_corrections": _replies("""SELECT id, pos, sql, CAST(NULL AS VARCHAR) AS analysis, CASE WHEN fmt <= 2 THEN 'json:direct' ELSE 'text' END AS parse_mode FROM (
  SELECT id, fmt, unnest(l) AS sql, unnest(range(len(l))) AS pos FROM (SELECT id, fmt, CASE fmt
    WHEN 0 THEN [json_extract_string(raw_text, '$.sql_queries[0]'), json_extract_string(raw_text, '$.sql_queries[1]')]
    WHEN 1 THEN ['SELECT 1'] WHEN 2 THEN ['SELECT p_size FROM part'] WHEN 3 THEN ['SELECT p_name FROM part; SELECT p_size FROM part']
    WHEN 4 THEN ['SELECT p_name FROM part', 'WITH t AS (SELECT 1) SELECT * FROM t'] ELSE [] END AS l FROM fx_responses))"""),
    "parse_modes": _replies("""SELECT CASE WHEN fmt <= 2 THEN 'json:direct' WHEN fmt <= 5 THEN 'text' ELSE 'unparsed' END AS parse_mode, count(*) AS replies,
CAST(sum(CASE WHEN fmt IN (0, 4, 5) THEN 2 WHEN fmt > 5 THEN 0 ELSE 1 END) AS BIGINT) AS queries FROM fx_responses GROUP BY 1"""),
    "analysis_replies": """SELECT p_partkey AS id, 0 AS pos, concat('SELECT p_size', chr(10), 'FROM part') AS sql, concat('size of ', p_name) AS analysis, 'text' AS parse_mode FROM part""",
    "single_statement": _replies(_ONE + "CASE WHEN fmt = 3 THEN 'SELECT p_name FROM part; SELECT p_size FROM part' ELSE raw_text END AS sql FROM fx_responses"),
    "json_interpretations": """SELECT p_partkey AS id, 0 AS pos, p_name AS interpretation FROM part WHERE p_partkey % 4 < 3
UNION ALL SELECT p_partkey, 1, CASE WHEN p_partkey % 4 = 0 THEN p_type ELSE p_brand END FROM part WHERE p_partkey % 4 IN (0, 2)""",
    "numbered_list": "SELECT p_partkey AS id, unnest([0, 1]) AS pos, unnest([p_name, p_type]) AS item FROM part",
    "score_text": _replies("""SELECT id, CASE fmt WHEN 7 THEN CAST(substr(raw_text, 8) AS DOUBLE) WHEN 1 THEN 1.0 WHEN 4 THEN 1.0 WHEN 5 THEN 1.0
WHEN 0 THEN coalesce(TRY_CAST(nullif(list_last(regexp_extract_all(raw_text, '\\b(0|1)\\b')), '') AS DOUBLE), 0) ELSE 0.0 END AS out FROM fx_responses"""),
    "format_reward": _replies("SELECT id, CAST(CASE WHEN fmt = 6 THEN 0.05 ELSE 0 END AS DOUBLE) AS out FROM fx_responses"),
    "quality_gate": _replies("SELECT id, CAST(CASE WHEN fmt = 6 THEN 0.8 ELSE 0.25 END AS DOUBLE) AS out FROM fx_responses"),
    "schema_entities": f"WITH {_ENT} SELECT id AS db_id, n AS table, unnest(['id', 'name', seg]) AS column FROM ent",
    "statement_entities": f"""WITH {_ENT} SELECT id, 'table' AS kind, n AS name FROM ent UNION ALL SELECT id, 'table', 'other' FROM ent WHERE id % 3 = 1
UNION ALL SELECT id, 'column', unnest(CASE id % 3 WHEN 0 THEN ['id', 'name', 'missing'] WHEN 1 THEN ['id', 'name'] ELSE [seg] END) FROM ent""",
    "unknown_entities": f"""WITH {_ENT} SELECT id, 'table' AS kind, 'other' AS name FROM ent WHERE id % 3 = 1 UNION ALL SELECT id, 'column', 'missing' FROM ent WHERE id % 3 = 0""",
    "schema_correctness": f"""WITH {_ENT} SELECT id, CASE id % 3 WHEN 0 THEN round(0.6 + 0.4 * 2 / 3, 6) WHEN 1 THEN 0.7 ELSE 1.0 END AS schema_correctness,
CASE id % 3 WHEN 0 THEN 'Potentially invalid columns: missing' WHEN 1 THEN 'Invalid tables: other' ELSE '' END AS issues FROM ent""",
    "interpretation_quality": f"""WITH {_ENT}, x AS (SELECT id, CASE id % 3 WHEN 0 THEN 0.6 + CAST(0.8 AS DOUBLE) / 3 WHEN 1 THEN 0.7 ELSE 1.0 END AS sc,
  CASE id % 3 WHEN 0 THEN 'Potentially invalid columns: missing' WHEN 1 THEN 'Invalid tables: other' ELSE '' END AS iss, id % 4 > 0 AS ok,
  coalesce(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(i.embedding AS DOUBLE[])), 0.5) AS sim
  FROM ent LEFT JOIN embeddings q ON q.vec_id = id LEFT JOIN embeddings i ON i.vec_id = id + 1)
SELECT id, round(sim, 6) AS semantic_similarity, round(sc, 6) AS schema_correctness, round(4 * sim + 3 * sc + CASE WHEN ok THEN 3 ELSE 0 END, 6) AS overall_score, ok AS execution_success,
concat(iss, CASE WHEN NOT ok AND iss <> '' THEN '; ' ELSE '' END, CASE WHEN NOT ok THEN 'Execution error: no such column: missing' ELSE '' END) AS issues FROM x""",
}
