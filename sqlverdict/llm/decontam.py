"""Benchmark decontamination (operator 2): pigeonhole edit matching over words.

Texts and items become sequences of words: maximal runs of letters, digits and underscores,
lower-cased, so symbols, case and spacing hide nothing. In scripts without spaces between words
(``_UNSPACED``) each character is a word. An item of m words is found in a
text if some stretch of it is within ``errors = floor(rate * m)`` insertions, deletions and
substitutions of words. The item is split into ``errors + 1`` pieces; one of them must occur
unchanged. Exact piece hits come from hashed lookups, and each hit is verified on the
stretch around it with Myers' bit-parallel distance, whatever the item's length. The distance
gives the end of the best stretch; the same run backwards from there gives its start.

Items are a stated query set. They are read in blocks of at most ``BLOCK_BYTES`` of text, and each
block is broadcast in one pass over the texts, which never shuffle.

Null and empty texts hold no item; items without a word are found nowhere. Items of fewer than
``least`` words are not searched; with ``least=1``, as the query and the pipeline have it, items of
one to four words are found too, unchanged. Equal items are
reported each. Rows that repeat a ``doc_id`` are searched each. Empty tables on either side
give no hits. Columns of the texts pass through ``clean``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATE, LEAST_WORDS = 0.2, 5
BLOCK_BYTES = 4 << 20
HITS = "doc_id long, item_id long, errors int, start int, end int"
#: Thai to Tibetan, Burmese, Khmer, kana and Chinese characters.
_UNSPACED = "\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_WORD = re.compile(rf"(?!\W)[{_UNSPACED}]|[^\W{_UNSPACED}]+")
_FACTOR = 0x9E3779B97F4A7C15 | 1


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def distance(pattern: dict[int, int], m: int, text: list[int]) -> tuple[int, int]:
    """Least edit distance of the pattern to any stretch of ``text``, and the end of the first such stretch.

    ``pattern`` gives for each word a bit mask of its places. Myers' recurrence on integers of ``m`` bits.
    """
    full, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, now, best, end = full, 0, m, m, 0
    for k, word in enumerate(text):
        equal = pattern.get(word, 0)
        vertical = equal | minus
        equal |= (((equal & plus) + plus) ^ plus) & full
        up = minus | (~(equal | plus) & full)
        down = plus & equal
        if up & high:
            now += 1
        elif down & high:
            now -= 1
        up, down = (up << 1) & full, (down << 1) & full
        plus = down | (~(vertical | up) & full)
        minus = up & vertical
        if now < best:
            best, end = now, k + 1
    return best, end


class Items:
    """Pieces of a block of items, as hashes by length, and the masks to verify them with."""

    def __init__(self, items: list[tuple[int, str]], rate: float, least: int):
        self.codes: dict[str, int] = {}
        self.items: list[tuple[int, int, int, list[int], dict[int, int]]] = []
        self.backward: dict[int, dict[int, int]] = {}
        pieces: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for item_id, text in items:
            words = [self.codes.setdefault(w, len(self.codes) + 1) for w in words_of(text)]
            m = len(words)
            if m < least:
                continue
            errors = int(rate * m)
            masks: dict[int, int] = {}
            for k, w in enumerate(words):
                masks[w] = masks.get(w, 0) | 1 << k
            cuts = [m * j // (errors + 1) for j in range(errors + 2)]
            for low, high in zip(cuts, cuts[1:]):
                key = self._key(words[low:high])
                pieces.setdefault(high - low, {}).setdefault(key, []).append((len(self.items), low))
            self.items.append((item_id, m, errors, words, masks))
        self.pieces = {n: (np.array(sorted(by), np.uint64), by) for n, by in pieces.items()}

    @staticmethod
    def _key(words: list[int]) -> int:
        key = 0
        for w in words:
            key = (key * _FACTOR + w) % 2**64
        return key

    def _start(self, k: int, stretch: list[int]) -> int:
        """Start of the shortest stretch that ends with ``stretch`` and is as near to item ``k`` as any."""
        _, m, _, item, _ = self.items[k]
        if k not in self.backward:
            masks: dict[int, int] = {}
            for j, w in enumerate(reversed(item)):
                masks[w] = masks.get(w, 0) | 1 << j
            self.backward[k] = masks
        return len(stretch) - distance(self.backward[k], m, stretch[::-1])[1]

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """``(item_id, errors, start, end)`` of every item found, in words; the best stretch of each."""
        words = words_of(text)
        coded = list(map(self.codes.get, words, [0] * len(words)))
        codes = np.array(coded, np.uint64)
        inside = np.concatenate([[0], np.cumsum(codes == 0)])
        tried: set[tuple[int, int]] = set()
        found: dict[int, tuple[int, int, int]] = {}
        for n, (keys, by) in self.pieces.items():
            if len(codes) < n:
                continue
            at = np.flatnonzero(inside[n:] == inside[:-n])  # stretches of words that items have
            value = np.zeros(len(at), np.uint64)
            for j in range(n):
                value = value * np.uint64(_FACTOR) + codes[at + j]
            slot = np.minimum(np.searchsorted(keys, value), len(keys) - 1)
            hit = keys[slot] == value
            for t, key in zip(at[hit].tolist(), value[hit].tolist()):
                for k, low in by[key]:
                    if (k, t - low) in tried:
                        continue
                    tried.add((k, t - low))
                    item_id, m, errors, item, masks = self.items[k]
                    if item[low:low + n] != coded[t:t + n]:
                        continue
                    start = max(0, t - low - errors)
                    best, end = distance(masks, m, coded[start:t - low + m + errors])
                    if best <= errors and (k not in found or best < found[k][0]):
                        found[k] = (best, start, start + end)
        return [(self.items[k][0], errors, low + self._start(k, coded[low:end]), end) for k, (errors, low, end) in found.items()]


def item_blocks(items: DataFrame, limit: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str]]]:
    """Items in order of their ids, in blocks of bounded size; one block is on the driver at a time."""
    block, size = [], 0
    for row in items.where("item_id IS NOT NULL AND text IS NOT NULL").orderBy("item_id", "text").select("item_id", "text").toLocalIterator():
        if block and size + len(row["text"]) > limit:
            yield block
            block, size = [], 0
        block.append((row["item_id"], row["text"]))
        size += len(row["text"])
    if block:
        yield block


def hits(docs: DataFrame, items: DataFrame, rate: float = RATE, least: int = LEAST_WORDS) -> DataFrame:
    """``(doc_id, item_id, errors, start, end)``: the best stretch of each item in each text that holds it, in words."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = docs.sparkSession.createDataFrame([], HITS)
    for block in item_blocks(items):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            wanted = Items(shared.value, rate, least)
            for batch in batches:
                rows = [(d.as_py(), *hit) for d, t in zip(batch.column(0), batch.column(1)) for hit in wanted.find(t.as_py())]
                columns = list(zip(*rows)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([
                    pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))],
                    names=["doc_id", "item_id", "errors", "start", "end"])

        out = out.union(docs.mapInArrow(run, HITS))
    return out


def clean(docs: DataFrame, items: DataFrame, rate: float = RATE, least: int = LEAST_WORDS) -> DataFrame:
    """The rows of ``docs`` whose texts hold no item, with all their columns."""
    text_at = docs.columns.index("text")
    for block in item_blocks(items):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            wanted = Items(shared.value, rate, least)
            for batch in batches:
                yield batch.filter(pa.array([not wanted.find(t.as_py()) for t in batch.column(text_at)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def report(docs: DataFrame, items: DataFrame, rate: float = RATE, least: int = LEAST_WORDS) -> DataFrame:
    """Per document the items it holds in order, the fewest errors among them, ``contaminated`` and its opposite ``kept``."""
    found = hits(docs, items, rate, least).groupBy("doc_id").agg(
        F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.min("errors").alias("errors"))
    ids = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    none = F.array().cast("array<bigint>")
    return ids.join(found, "doc_id", "left").select(
        "doc_id", F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce("item_ids", none).alias("item_ids"), "errors",
        F.col("item_ids").isNull().alias("kept"))
