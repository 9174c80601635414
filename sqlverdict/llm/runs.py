"""Periodic run detection (operator 13): recursive frequency splitting, then a scan by lags.

A run is a stretch of consecutive words with smallest period ``q``, of at least ``max(LEAST, REPEATS * q)``
words, that no neighbouring word extends. Each of its words therefore occurs ``REPEATS`` times in it. So:

1. Words that occur fewer than ``REPEATS`` times in their segment (at first: the text) cannot be part of a run
   and split it; pieces of fewer than ``LEAST`` words go; the rest are counted again, until nothing
   splits. numpy does this for all texts of a block at once.
2. A segment that is left is scanned by lags ``q`` from 1 up. A run of period ``q`` has at least ``(REPEATS - 1) * q``
   neighbouring matches at lag ``q``, so it has ``REPEATS - 1`` of them at consecutive multiples of ``q``: only
   these places are compared (``n / q`` of them), and a match is extended both ways from there.
   Places inside a run of a smaller period found before are passed over: two periods that overlap that
   far have a common divisor that is a period too, so the lag is not the smallest one. So are stretches
   that lie wholly in such a run.

Work is ``n log n`` for a text of ``n`` words left after splitting, plus the lengths of the runs. Each text is
handled whole; a very long one is a block of its own. Nothing is shuffled.

Null and empty texts have no words and no runs. Rows without an id go; rows that repeat an id
are each answered. Runs are ordered by start, then period. An empty table gives no rows. Columns
other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlverdict.llm.common import SPACE, blocks, word_codes, word_spans

#: Least words of a run, and least repeats of its period.
LEAST, REPEATS = 6, 4
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_NONE = np.zeros(0, np.int64)


def segments(codes: np.ndarray, rows: np.ndarray, least: int = LEAST, repeats: int = REPEATS) -> list[np.ndarray]:
    """Positions of the stretches in which every word occurs often enough; ``rows`` numbers the texts."""
    done, at, part = [], np.arange(len(codes)), rows
    while len(at):
        size = np.bincount(part)
        long = size[part] >= least
        at, part = at[long], part[long]
        if not len(at):
            break
        _, inverse, counts = np.unique(part * (codes.max() + 1) + codes[at], return_inverse=True, return_counts=True)
        rare = counts[inverse] < repeats
        split = np.zeros(len(size), bool)
        split[part[rare]] = True
        stable = ~split[part]
        if stable.any():
            own, ids = at[stable], part[stable]
            done += np.split(own, np.flatnonzero(np.diff(ids)) + 1)
        left = ~stable & ~rare
        at, part = at[left], part[left]
        part = np.cumsum(np.r_[True, (np.diff(at) != 1) | (np.diff(part) != 0)][:len(at)]) - 1
    return done


def _reach(same, step: int, most: int) -> int:
    """Number of matches in a row; ``same(k, n)`` compares the next ``n`` after ``k``."""
    k, n = 0, 64
    while k < most:
        n = min(n, most - k)
        found = same(k, n)[::step]
        if not found.all():
            return k + int(np.argmin(found))
        k, n = k + n, 2 * n
    return most


def scan(codes: np.ndarray, least: int = LEAST, repeats: int = REPEATS) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of the runs of one segment."""
    n, found = len(codes), []
    inside = np.zeros(n, np.int64)  # end of the farthest run over a place
    for q in range(1, n // repeats + 1):
        same = codes[:n - q:q] == codes[q::q]
        if len(same) < repeats - 1:
            break
        hits = same[:len(same) - repeats + 2].copy()
        for k in range(1, repeats - 1):
            hits &= same[k:len(same) - repeats + 2 + k]
        places = np.flatnonzero(hits) * q
        if not len(places):
            continue
        until = -1
        for j in places[inside[places] < places + 2 * q].tolist():
            if j < until:
                continue
            after = _reach(lambda k, m: codes[j + k:j + k + m] == codes[j + q + k:j + q + k + m], 1, n - q - j)
            before = _reach(lambda k, m: codes[j - k - m:j - k] == codes[j + q - k - m:j + q - k], -1, j)
            until, start, length = j + after, j - before, before + after + q
            if length >= max(least, repeats * q) and inside[start] < start + length:
                found.append((start, length, q))
                inside[start:start + length] = np.maximum(inside[start:start + length], start + length)
    return sorted(found, key=lambda r: (r[0], r[2]))


def _detect(least: int, repeats: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in blocks(batches):
            starts, ends, first = word_spans(data, offsets)
            codes, words = word_codes(data, starts, ends)
            text = np.full(int((ends - starts).sum()) + len(starts), 32, np.uint8)  # all words, a space behind each
            after = np.cumsum(ends - starts + 1)
            mask = np.ones(len(text), bool)
            mask[after - 1] = False
            text[mask] = np.frombuffer(data, np.uint8)[_covered(len(data), starts, ends)]
            text, after = text.tobytes(), np.r_[0, after]
            found: dict[int, list[tuple[int, int, int]]] = {}
            row = np.repeat(np.arange(rows.num_rows), np.diff(first))
            for part in segments(codes, row, least, repeats):
                if runs := scan(codes[part], least, repeats):
                    k = int(row[part[0]])
                    found.setdefault(k, []).extend((int(part[0] - first[k]) + s, n, q) for s, n, q in runs)
            runs, collapsed = [], []
            for k in range(rows.num_rows):
                own = sorted(found.get(k, ()), key=lambda r: (r[0], r[2]))
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in own])
                a, b = after[first[k]], max(after[first[k]], after[first[k + 1]] - 1)
                if own:
                    gone = np.zeros(first[k + 1] - first[k] + 1, np.int64)
                    for s, n, q in own:
                        gone[s + q] += 1
                        gone[s + n] -= 1
                    kept = first[k] + np.flatnonzero(np.cumsum(gone)[:-1] == 0)
                    collapsed.append(b" ".join(text[after[i]:after[i + 1] - 1] for i in kept.tolist()))
                else:
                    collapsed.append(text[a:b])
            yield pa.RecordBatch.from_arrays([
                rows.column(0), pa.array(np.diff(first).astype(np.int64)), pa.array(runs, _RUN), pa.array(collapsed, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "runs", "collapsed"])
    return run


def _covered(size: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    marks = np.zeros(size + 1, np.int8)
    marks[starts] = 1
    marks[ends] -= 1
    return np.cumsum(marks[:-1], dtype=np.int8) > 0


def detect(docs: DataFrame, least: int = LEAST, repeats: int = REPEATS) -> DataFrame:
    """``(doc_id, n_words, runs, collapsed)``: all runs of each text, and its words without those that a run
    repeats (all behind its first period), joined by spaces."""
    docs = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_detect(least, repeats), "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` where a tenth of the texts, chosen by a checksum of the id, goes on periodically from some word."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), SPACE + "+"), lambda w: w != "")
    check = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", check.alias("h"), F.when(check % 10 == 0, words).alias("w"))
    rows = rows.withColumn("g", F.expr("h DIV 10")).withColumn("n", F.size("w").cast("long"))
    rows = rows.withColumn("a", F.expr("IF(n > 0, g % n, 0)")).withColumn("p", F.expr("1 + (n - a) DIV (3 + g % 8)"))
    again = F.expr("array_join(transform(sequence(0L, n - 1), i -> w[CAST(IF(i < a, i, a + (i - a) % p) AS INT)]), ' ')")
    return rows.select("doc_id", F.when(F.col("n") > 0, again).otherwise(F.col("text")).alias("text"))


def strongest(runs: str) -> Column:
    """The run with the greatest length by period, compared exactly; of equal ones the first."""
    return F.expr(f"""aggregate({runs}, CAST(NULL AS struct<start:bigint,length:bigint,period:bigint>),
        (best, r) -> IF(best IS NULL OR r.length * best.period > best.length * r.period, r, best))""")
