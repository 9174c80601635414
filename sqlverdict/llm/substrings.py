"""Substring dedup (operator 6): a de Bruijn graph of token k-mers, compacted through Spark joins.

An edge of the graph is a window of ``window`` consecutive words. Windows that share the same
least gram of a few words (their minimizer) and follow each other form one path: a row with
the minimizer, a hash of all its windows in order, and its source coordinates. Equal text
makes equal paths, so a path stands for several windows at once, and most of the graph never
leaves it. Paths meet on their minimizer:

* a minimizer in one document only belongs to unique text and goes;
* if all its paths are equal the path does not branch: it is decided as a whole, and all
  documents but the first lose it;
* if its paths differ they branch (copies that begin, end or differ there). Only these are
  expanded into single edges and decided one by one.

Coordinates ``(doc_id, start, windows)`` of the decided paths go back to the texts, where
every covered word is removed. Edges that repeat inside one document are found there.
Windows are compared by two independent 64-bit hashes.

Null and empty texts have no words and lose none; texts shorter than a window lose none.
Rows that repeat a ``doc_id`` count once (``common.named``). An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlverdict.llm.common import blocks, gram_hashes, mix, named, signed, stored, texts, word_hashes

#: Words in a window, and in the grams of which the least names a path.
WINDOW, GRAM = 20, 5
PATHS = "h long, path long, doc_id long, start int, n int, inside boolean"


def _slide(x: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` of each ``width`` neighbours, by the index of the first."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = best(x[:-step], x[step:])
        have += step
    return x


def _windows(hashes: np.ndarray, first: np.ndarray, window: int, gram: int):
    """Starts of windows inside rows, their rows, two hashes, minimizers, and the rows with a repeated minimizer."""
    n = len(hashes) - window + 1
    if n <= 0:
        return None
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    valid = row[:n] == row[window - 1:]
    at = np.flatnonzero(valid)
    if not len(at):
        return None
    grams, width = gram_hashes(hashes, gram, 3), window - gram + 1
    least = _slide(grams, width, np.minimum)
    # A gram is a minimizer if it equals the greatest minimum of the windows over it.
    over = np.zeros(n + 2 * (width - 1), np.uint64)
    over[width - 1:width - 1 + n] = np.where(valid, least, 0)
    places = np.flatnonzero(_slide(over, width, np.maximum) == grams)
    order = np.lexsort((grams[places], row[places]))
    values, rows = grams[places][order], row[places][order]
    again = np.unique(rows[1:][(values[1:] == values[:-1]) & (rows[1:] == rows[:-1])])
    return at, row[at], gram_hashes(hashes, window, 1)[at], gram_hashes(hashes, window, 2)[at], least[at], again


def _repeats(row: np.ndarray, one: np.ndarray, again: np.ndarray) -> np.ndarray:
    """Marks of windows equal to an earlier one of their row; only rows ``again`` can have any."""
    marks = np.zeros(len(one), bool)
    for r in again:
        low, high = np.searchsorted(row, r), np.searchsorted(row, r, "right")
        marks[low:high] = True
        marks[low + np.unique(one[low:high], return_index=True)[1]] = False
    return marks


def _runs(marks: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of runs of marked neighbours."""
    i = np.flatnonzero(marks)
    if not len(i):
        return i, i
    new = np.ones(len(i), bool)
    new[1:] = (np.diff(i) > 1) | (np.diff(row[i]) > 0)
    heads = np.flatnonzero(new)
    return i[heads], np.diff(np.append(heads, len(i)))


def _paths(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in blocks(batches):
            found = _windows(*word_hashes(data, offsets), window, gram)
            if found is None:
                continue
            at, row, one, two, least, again = found
            first = np.searchsorted(row, row)  # index of the row's first window
            new = np.ones(len(at), bool)
            new[1:] = (np.diff(row) > 0) | (least[1:] != least[:-1])
            heads = np.flatnonzero(new)
            n = np.diff(np.append(heads, len(at)))
            place = np.arange(len(at)) - np.repeat(heads, n)
            path = np.add.reduceat(mix(one + mix(two + place.astype(np.uint64))), heads)
            marks = _repeats(row, one, again)
            inner, inner_n = _runs(marks, row)
            ids = rows.column(0).to_numpy()
            zero = np.zeros(len(inner), np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([signed(least[heads]), zero])),
                pa.array(np.concatenate([signed(path), zero])),
                pa.array(np.concatenate([ids[row[heads]], ids[row[inner]]]).astype(np.int64)),
                pa.array(np.concatenate([heads - first[heads], inner - first[inner]]).astype(np.int32)),
                pa.array(np.concatenate([n, inner_n]).astype(np.int32)),
                pa.array(np.concatenate([np.zeros(len(heads), bool), np.ones(len(inner), bool)])),
            ], names=["h", "path", "doc_id", "start", "n", "inside"])
    return run


def _edges(window: int, gram: int):
    """Single edges of the listed stretches of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in blocks(batches):
            _, row, one, two, _, _ = _windows(*word_hashes(data, offsets), window, gram)
            base = np.searchsorted(row, np.arange(rows.num_rows))
            spans = rows.column(2)
            count = np.diff(spans.offsets.to_numpy())
            flat = spans.flatten()
            start, n = flat.field("start").to_numpy(), flat.field("n").to_numpy()
            owner = np.repeat(np.arange(rows.num_rows), count)
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)
            owner = np.repeat(owner, n)
            pick = base[owner] + place
            yield pa.RecordBatch.from_arrays([
                pa.array(signed(one[pick])), pa.array(signed(two[pick])), pa.array(rows.column(0).to_numpy()[owner]),
                pa.array(place.astype(np.int32))], names=["one", "two", "doc_id", "start"])
    return run


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, kept, out = [], [], [], []
            for text, spans in zip(batch.column(1), batch.column(2)):
                words = text.as_py().encode("utf-8", "surrogatepass").split()
                total.append(len(words))
                if spans.is_valid:
                    edge = np.zeros(len(words) + 1, np.int64)
                    found = spans.values
                    start, n = found.field("start").to_numpy(), found.field("n").to_numpy()
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + n + window - 1, -1)
                    words = list(compress(words, np.cumsum(edge)[:-1] == 0))
                left = b" ".join(words)
                gone.append(total[-1] - len(words))
                kept.append(hashlib.sha256(left).hexdigest())
                out.append(left.decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), pa.array(out, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])
    return run


def repeated_stretches(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``(doc_id, start, n)``: windows ``start`` to ``start + n - 1`` of a document also start earlier."""
    paths = stored(docs.mapInArrow(_paths(window, gram), PATHS), "paths")
    edges = paths.where("NOT inside")
    # One row per minimizer: sums that are added up before the shuffle, however hot it is.
    nodes = edges.groupBy("h").agg(F.count("*").alias("rows"), F.min("path").alias("low"), F.max("path").alias("high"),
                                   F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("rows > 1")
    nodes = stored(nodes.where("first < last").select("h", (F.col("low") < F.col("high")).alias("branches"), "first"), "nodes")
    met = stored(edges.select("h", "doc_id", "start", "n").join(nodes, "h").where("branches OR doc_id > first")
                 .select("doc_id", "start", "n", "branches"), "met")
    listed = met.where("branches").groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    single = docs.join(listed, "doc_id").select("doc_id", "text", "spans").mapInArrow(
        _edges(window, gram), "one long, two long, doc_id long, start int")
    single = stored(single, "edges")
    firsts = single.groupBy("one", "two").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    later = single.join(stored(firsts.select("one", "two", "first"), "firsts"), ["one", "two"]).where("doc_id > first")
    columns = ["doc_id", "start", "n"]
    return (met.where("NOT branches").select(*columns)
            .union(later.select("doc_id", "start", F.lit(1).alias("n")))
            .union(paths.where("inside").select(*columns)))


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per document its words, how many were removed, and the kept words joined by one space."""
    docs = texts(named(docs))
    spans = repeated_stretches(docs, window, gram).groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    return docs.join(spans, "doc_id", "left").select("doc_id", "text", "spans").mapInArrow(
        _cut(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
