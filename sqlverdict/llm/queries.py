"""Queries of the operators over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlverdict.llm import bpe, decontam, lines, neardup, quality_model, queries_phrases, quotes, rules, secrets, substrings, warc
from sqlverdict.llm.common import named, table
from sqlverdict.session import scratch_path

#: Rank file of the encoder, among the public tokenizers.
RANKS = "byte_bpe_50k.tiktoken"


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines left of every whole text once later repeated runs are deleted."""
    kept = lines.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op1_line_dedup_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, under the name it had while the other took runs of three lines only."""
    return op1_line_dedup(spark, sf_dir)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items held by every whole text, within a fifth of their words."""
    return decontam.report(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), least=1)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict of every whole text, by a model of the labels that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality_model.classify(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of near copies of every whole text."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every whole text, through a new ledger of blobs."""
    docs = named(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = secrets.scan(docs, scratch_path(spark, "ledger"), path="doc_id")
    counts = [F.coalesce(F.size(r.name), F.lit(0)).cast("long").alias(f"n_{r.name}") for r in secrets.BASE_RULES]
    return found.select(F.col("path").alias("doc_id"), *counts,
                        F.sha2(secrets.joined(secrets.BASE_RULES).cast("binary"), 256).alias("base_sha256"),
                        secrets.joined(secrets.RULES).alias("spans"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left of every whole text once windows that start earlier elsewhere are removed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text and their decoded bytes, as digests."""
    docs = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL")
    return bpe.digests(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page archived, indexed and read back."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of the quality rules for every whole text."""
    return rules.apply_rules(table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select("doc_id", "text"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message without its quotes, linked to what it replies to, in reply order."""
    return quotes.conversations(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_near_dedup": op4_near_dedup,
    "op5_secret_scan": op5_secret_scan,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_warc": op8_warc,
    "op9_quality_rules": op9_quality_rules,
    "op10_chat_format": op10_chat_format,
    "op1_line_dedup_words": op1_line_dedup_words,
} | queries_phrases.QUERIES
_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_STOP = ", ".join(f"'{w}'" for w in sorted(set(rules.STOP_WORDS)))


def _spans_sql() -> str:
    """Spans of all secret rules: matches and the pieces between them are walked side by side."""
    parts = []
    for order, r in enumerate(secrets.RULES):
        pattern = (r.quick or r.pattern).replace("'", "''")
        parts.append(f"""
SELECT doc_id, '{r.name}' AS kind, {order} AS kind_order, text, unnest(pieces[:len(whole)]) AS piece, unnest(whole) AS whole, unnest(tested) AS tested,
       generate_subscripts(whole, 1) AS k
FROM (SELECT doc_id, text, string_split_regex(text, '{pattern}') AS pieces, regexp_extract_all(text, '{pattern}') AS whole,
             regexp_extract_all(text, '{pattern}', {r.group}) AS tested FROM d)""")
    least = " ".join(f"WHEN '{r.name}' THEN {r.least}" for r in secrets.RULES)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents WHERE doc_id IS NOT NULL),
m AS ({" UNION ALL ".join(parts)}),
ends AS (SELECT *, sum(length(piece) + length(whole)) OVER (PARTITION BY doc_id, kind ORDER BY k) AS finish FROM m),
s AS (SELECT doc_id, kind, kind_order, finish - length(whole) AS start, finish FROM ends WHERE length(tested) >= CASE kind {least} END),
labels AS (SELECT doc_id, kind, kind_order, start, kind || ':' || start || ':' || finish AS label FROM s)
SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
       sha256(coalesce(string_agg(label, ',' ORDER BY start, kind_order) FILTER (kind_order < 3), '')) AS base_sha256,
       coalesce(string_agg(label, ',' ORDER BY start, kind_order), '') AS spans
FROM d LEFT JOIN labels ON labels.doc_id = d.doc_id GROUP BY d.doc_id
"""


_LINES = rf"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS p FROM documents),
b AS (SELECT *, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS body FROM l),
n AS (SELECT doc_id, p, body, len({_WORDS.replace("text", "body")}) AS words, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS k FROM b WHERE body <> ''),
w AS (SELECT doc_id, k, 1 AS size, body AS run FROM n WHERE words >= {lines.WORDS}
      UNION ALL SELECT a.doc_id, a.k, 2, a.body || chr(10) || m.body
      FROM n a JOIN n m ON m.doc_id = a.doc_id AND m.k = a.k + 1 WHERE a.words + m.words >= {lines.WORDS}
      UNION ALL SELECT a.doc_id, a.k, 3, a.body || chr(10) || m.body || chr(10) || z.body
      FROM n a JOIN n m ON m.doc_id = a.doc_id AND m.k = a.k + 1 JOIN n z ON z.doc_id = a.doc_id AND z.k = a.k + 2),
later AS (SELECT doc_id, k, size FROM w QUALIFY row_number() OVER (PARTITION BY run ORDER BY doc_id, k) > 1),
gone AS (SELECT DISTINCT n.doc_id, n.p FROM later JOIN n ON n.doc_id = later.doc_id AND n.k BETWEEN later.k AND later.k + later.size - 1)
SELECT b.doc_id, count(*) FILTER (body <> '') AS n_lines, count(gone.p) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY b.p) FILTER (gone.p IS NULL), '')) AS kept_sha256
FROM b LEFT JOIN gone ON gone.doc_id = b.doc_id AND gone.p = b.p GROUP BY b.doc_id
"""

ORACLE: dict[str, str] = {
    "op1_line_dedup": _LINES,
    "op1_line_dedup_words": _LINES,
    "op4_near_dedup": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS words FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 3], ' ') AS g FROM (
        SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, least(len(words), 1)) + 1)) AS i FROM w)),
n AS (SELECT w.doc_id, count(g) AS n_shingles FROM w LEFT JOIN g ON g.doc_id = w.doc_id GROUP BY w.doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_n FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_n >= 80 * (x.n_shingles + y.n_shingles - both_n)),
r AS (SELECT doc_id, doc_id AS other FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other)
SELECT n.doc_id, any_value(n_shingles) AS n_shingles, min(other) AS component_id, min(other) = n.doc_id AS kept
FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY n.doc_id
""",
    "op5_secret_scan": _spans_sql(),
    "op6_substring_dedup": f"""
WITH w AS (SELECT doc_id, {_WORDS} AS words FROM documents),
win AS (SELECT doc_id, i, array_to_string(words[i:i + 19], ' ') AS k FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM w)),
later AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM later, range(20) t(j)),
each AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
kept AS (SELECT each.doc_id, count(gone.i) AS n_removed, string_agg(word, ' ' ORDER BY each.i) FILTER (gone.i IS NULL) AS kept
         FROM each LEFT JOIN gone ON gone.doc_id = each.doc_id AND gone.i = each.i GROUP BY each.doc_id)
SELECT w.doc_id, len(words) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
""",
    "op8_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to
FROM f
""",
    "op9_quality_rules": rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS words FROM documents WHERE doc_id IS NOT NULL),
tri AS (SELECT doc_id, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
again AS (SELECT doc_id, i FROM tri QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, range(3) t(k) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS lines,
             coalesce(covered.n, 0) AS n_repeat_words, len(list_filter(words, lambda x: lower(x) IN ({_STOP}))) AS n_stop
      FROM w LEFT JOIN covered ON covered.doc_id = w.doc_id),
v AS (SELECT *, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
f AS (SELECT *, concat_ws(',',
        CASE WHEN n_words < 50 THEN 'length' END,
        CASE WHEN n_words = 0 OR word_chars < 1.5 * n_words OR word_chars > 20 * n_words THEN 'word_length' END,
        CASE WHEN word_chars > 0 AND n_symbols / word_chars > 0.1 THEN 'symbols' END,
        CASE WHEN n_words = 0 OR n_stop / n_words < 0.02 THEN 'stop_words' END,
        CASE WHEN n_lines > 0 AND n_dup_lines / n_lines > 0.5 THEN 'dup_lines' END,
        CASE WHEN n_words > 0 AND n_repeat_words / n_words > 0.5 THEN 'repeats' END) AS failed_rules FROM v)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed_rules = '' AS kept, failed_rules FROM f
""",
} | queries_phrases.ORACLE
