"""Queries of license scans, collocations and periodic runs over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlverdict.llm import collocations, licenses, runs
from sqlverdict.llm.common import table


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and expressions of every whole text."""
    found = licenses.scan(table(spark, sf_dir, "documents"))
    base = F.expr("filter(places, p -> p.base).start")
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(base).alias("first_word"), F.array_max(base).alias("last_word"),
        licenses.labels(base_only=True).alias("base_labels"), licenses.labels().alias("labels"), licenses.score().alias("score"),
        F.array_join("expressions.postfix", "; ").alias("expressions"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first collocations of each language, counted over all texts."""
    return collocations.mine(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every whole text, a tenth of them made periodic from some word on."""
    found = runs.detect(runs.planted(table(spark, sf_dir, "documents")))
    best = found.withColumn("best", runs.strongest("runs"))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length DIV best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


QUERIES = {"op11_license_scan": op11_license_scan, "op12_collocations": op12_collocations, "op13_periodic_runs": op13_periodic_runs}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _license_sql() -> str:
    """Phrases only: the given tables have no identifier tag; expressions are held against a plain parser in the tests."""
    phrases = [(p, label, base) for found, base in ((licenses.BASE, True), (licenses.NOTICES, False)) for p, label in found.items()]
    values = ", ".join(f"('{p}', '{label}', {base}, {p.count(' ') + 1}, {licenses.WEIGHT[label]})" for p, label, base in phrases)
    return rf"""
WITH p(phrase, label, base, size, weight) AS (VALUES {values}),
w AS (SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM documents WHERE doc_id IS NOT NULL),
placed AS (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM w),
t AS (SELECT doc_id, i - 1 AS start, list_transform(range(2, 9), lambda n: array_to_string(words[i:i + n - 1], ' ')) AS runs FROM placed
      WHERE list_contains([{", ".join(sorted({f"'{p[0].split()[0]}'" for p in phrases}))}], words[i])),
m AS (SELECT DISTINCT t.doc_id, start, label, base, weight, phrase FROM t, p WHERE list_contains(runs, phrase))
SELECT w.doc_id, any_value(len(words)) AS n_words, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels,
       coalesce(max(weight), 0)::DOUBLE AS score, '' AS expressions
FROM w LEFT JOIN m ON m.doc_id = w.doc_id GROUP BY w.doc_id
"""


ORACLE = {
    "op11_license_scan": _license_sql(),
    "op12_collocations": rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
i AS (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) t(k)),
g AS (SELECT lang, k AS words, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM i GROUP BY ALL HAVING count(*) >= 30),
totals AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
c AS (SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS ws FROM g WHERE words > 1),
s AS (SELECT lang, a, words, ws, unnest(range(2, words)) AS size FROM c),
z AS (SELECT lang, a, ws, size, unnest(range(1, words - size + 2)) AS pos FROM s),
longer AS (SELECT lang, array_to_string(ws[pos:pos + size - 1], ' ') AS phrase, max(a) AS within FROM z GROUP BY 1, 2),
kept AS (SELECT c.* FROM c LEFT JOIN longer ON longer.lang = c.lang AND longer.phrase = c.phrase WHERE within IS NULL OR 100 * within < 80 * a),
cut AS (SELECT lang, phrase, a, ws, words, unnest(range(1, words)) AS k FROM kept),
scored AS (SELECT cut.lang, cut.phrase, a, k, x.f AS l, y.f AS r, ((2000000 * a::HUGEINT) // (x.f + y.f))::BIGINT AS score
           FROM cut JOIN g x ON x.lang = cut.lang AND x.phrase = array_to_string(ws[:k], ' ')
                    JOIN g y ON y.lang = cut.lang AND y.phrase = array_to_string(ws[k + 1:], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT ranked.lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals ON totals.lang = ranked.lang WHERE rank <= 2000
""",
    "op13_periodic_runs": r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
                  list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i::INT, 1))::BIGINT) AS digits
           FROM documents WHERE doc_id IS NOT NULL),
h AS (SELECT doc_id, ws, len(ws) AS n, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], digits), lambda c, b:
        list_reduce(list_concat([xor(c, b)], range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))) AS h FROM d),
a AS (SELECT *, CASE WHEN n > 0 THEN (h // 10) % n END AS a FROM h),
p AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM a),
placed AS (SELECT doc_id, ws, h, a, p, unnest(range(n)) AS i FROM p),
t AS (SELECT doc_id, i, ws[1 + CASE WHEN h % 10 = 0 AND i >= a THEN a + (i - a) % p ELSE i END] AS w FROM placed),
lags AS (SELECT doc_id, n, unnest(range(1, n // 4 + 1)) AS q FROM p),
places AS (SELECT doc_id, q, unnest(range(0, n - 3 * q, q)) AS j FROM lags),
near AS (SELECT DISTINCT places.doc_id, q FROM places JOIN t x ON x.doc_id = places.doc_id AND x.i = j JOIN t y ON y.doc_id = places.doc_id AND y.i = j + q AND y.w = x.w
         JOIN t z ON z.doc_id = places.doc_id AND z.i = j + 2 * q AND z.w = x.w),
same AS (SELECT near.doc_id, q, x.i, x.i - row_number() OVER (PARTITION BY near.doc_id, q ORDER BY x.i) AS island
         FROM near JOIN t x ON x.doc_id = near.doc_id JOIN t y ON y.doc_id = near.doc_id AND y.i = x.i + q AND y.w = x.w),
long AS (SELECT doc_id, q AS period, min(i) AS start, count(*) + q AS length FROM same GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT * FROM long WHERE NOT EXISTS (FROM long s WHERE s.doc_id = long.doc_id AND s.period < long.period AND s.start <= long.start AND s.start + s.length >= long.start + long.length)),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length / period DESC, start, period) = 1),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS text FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT t.doc_id, string_agg(w, ' ' ORDER BY t.i) AS text FROM t LEFT JOIN gone ON gone.doc_id = t.doc_id AND gone.i = t.i WHERE gone.i IS NULL GROUP BY t.doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
       sha256(coalesce(listed.text, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM d LEFT JOIN best ON best.doc_id = d.doc_id LEFT JOIN listed ON listed.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
""",
}
