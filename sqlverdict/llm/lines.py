"""Line dedup (operator 1): winnowing over line hashes.

A run is ``run`` or more consecutive lines that have a word, or fewer with ``words`` words in all (``None``:
no fewer lines), compared without the blanks at their ends; lines without a word are passed over and stay.
Every least run is a window and selects its least line hash (the leftmost of equal ones). Only the selected
lines are posted, each once with its position, so a run that occurs twice shares a fingerprint for certain. Fingerprints
found at one position only go. From the positions of the others the match is extended to both sides,
as far as the windows that selected the line reach: windows are compared by 128-bit hashes of their lines, and those that also
start earlier (in a document of smaller id, or further up in the same one) are later repeats. Neighbouring
repeats make up runs of any length. All lines of later repeats are deleted; the first occurrence stays.

Windows that shorter ones make up anyway are not looked at: where these are later repeats, so are their parts.

Null and empty texts have no lines and stay as they are. Rows that repeat a ``doc_id`` count
once (``common.named``). An empty table gives no rows. Other columns pass through; columns
named like those added here are replaced.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlverdict.llm.common import extended, named, stored, without

#: Least number of lines in a run.
RUN = 3
#: Least number of words in a run of fewer lines, where such runs count.
WORDS = 5
#: Blanks at the ends of lines that do not count.
BLANKS = " \t\n\x0b\x0c\r"
_SPANS = "_starts"
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _lines(text: str | None) -> tuple[list[str], list[int]]:
    """Lines of a text and the places of those with a word."""
    lines = (text or "").split("\n")
    return lines, [k for k, line in enumerate(lines) if line.strip(BLANKS)]


def _posted(counts: list[int], run_length: int, words: int | None) -> Iterator[tuple[int, int]]:
    """``(start, length)`` of the windows over lines of so many words that shorter windows do not make up."""
    if words is None:
        yield from ((s, run_length) for s in range(len(counts) - run_length + 1))
        return
    sums = [0, *itertools.accumulate(counts)]
    for s in range(len(counts)):
        for length in range(1, min(run_length, len(counts) - s) + 1):
            if length < run_length and sums[s + length] - sums[s] < words:
                continue
            parts = [(a, b) for a in range(s, s + length) for b in range(a + 1, s + length + 1) if b - a < length and sums[b] - sums[a] >= words]
            if len({k for a, b in parts for k in range(a, b)}) < length:
                yield s, length


_WINDOW = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("one", pa.int64()), ("two", pa.int64())]))


def _fingerprints(run_length: int, words: int | None):
    """``(doc_id, finger, windows)``: the lines that windows select, each with those windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, fingers, windows = [], [], []
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                lines, places = _lines(text.as_py())
                bodies = [lines[k].strip(BLANKS).encode() for k in places]
                digests = [hashlib.blake2b(body, digest_size=16).digest() for body in bodies]
                values = [struct.unpack_from("<q", d)[0] for d in digests]
                counts = [0 if words is None else len(_WORD.findall(body)) for body in bodies]
                selected: dict[int, list[dict]] = {}
                for s, length in _posted(counts, run_length, words):
                    one, two = struct.unpack("<qq", digests[s] if length == 1 else hashlib.blake2b(b"".join(digests[s:s + length]), digest_size=16).digest())
                    least = min(range(s, s + length), key=values.__getitem__)
                    selected.setdefault(least, []).append({"start": s, "length": length, "one": one, "two": two})
                ids += [doc_id.as_py()] * len(selected)
                fingers += [values[k] for k in selected]
                windows += selected.values()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fingers, pa.int64()), pa.array(windows, _WINDOW)], names=["doc_id", "finger", "windows"])
    return run


def _delete(text_at: int, spans_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, total, gone = [], [], []
            for text, spans in zip(batch.column(text_at), batch.column(spans_at)):
                text = text.as_py()
                lines, places = _lines(text)
                removed = {places[s["start"] + j] for s in (spans.as_py() or ()) for j in range(s["length"])}
                total.append(len(places))
                gone.append(len(removed))
                kept.append("\n".join(line for k, line in enumerate(lines) if k not in removed) if removed else text)
            columns = [pa.array(kept, pa.string()) if k == text_at else batch.column(k) for k in range(batch.num_columns) if k != spans_at]
            names = [n for k, n in enumerate(batch.schema.names) if k != spans_at]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(total, pa.int64()), pa.array(gone, pa.int64())], names=names + ["n_lines", "n_removed"])
    return run


def later_repeats(docs: DataFrame, run: int = RUN, words: int | None = WORDS) -> DataFrame:
    """``(doc_id, start, length)`` of the windows that also start earlier; places count lines with a word."""
    posted = stored(docs.select("doc_id", "text").mapInArrow(
        _fingerprints(run, words), "doc_id long, finger long, windows array<struct<start:int,length:int,one:long,two:long>>"), "posted")
    common = posted.groupBy("finger").agg(F.count("*").alias("n")).where("n > 1").select("finger")
    met = posted.join(stored(common, "fingerprints"), "finger").select("doc_id", F.explode("windows").alias("w"))
    met = stored(met.select("doc_id", "w.*"), "met")
    first = met.groupBy("one", "two").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = stored(first.select("one", "two", "first"), "firsts")
    return met.join(first, ["one", "two"]).where(F.struct("doc_id", "start") > F.col("first")).select("doc_id", "start", "length")


def remove_repeats(docs: DataFrame, run: int = RUN, words: int | None = WORDS) -> DataFrame:
    """The input with later repeated runs of lines deleted from ``text``, ``n_lines`` with a word, and ``n_removed``."""
    docs = without(named(docs), "n_lines", "n_removed", _SPANS)
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    repeats = later_repeats(docs, run, words).groupBy("doc_id").agg(F.collect_list(F.struct("start", "length")).alias(_SPANS))
    joined = docs.join(repeats, "doc_id", "left").select(*docs.columns, _SPANS)
    return joined.mapInArrow(_delete(docs.columns.index("text"), len(docs.columns)), extended(docs, "n_lines long, n_removed long"))
