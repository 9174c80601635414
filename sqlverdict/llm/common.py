"""Helpers of the operators: inputs with one row per id, written tables, words and hashes in numpy.

Words are maximal runs of characters other than space and ``\\x09-\\x0D``. Separators are
single bytes in UTF-8, so words are found and hashed on the bytes of an Arrow string column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sqlverdict.session import scratch_path

#: Separators of words, as a character class for Spark's and DuckDB's patterns.
SPACE = r"[\x20\x09-\x0D]"
#: Bytes of text handled at a time; a longer document is a block of its own.
BLOCK = 1 << 20

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


# ---------------------------------------------------------------- inputs and tables

def named(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows with an id, one per id: of rows that repeat an id, the one with the smallest text stays.

    Null ids name nothing and go. Only ids are shuffled, unless one is repeated.
    """
    docs = docs.where(F.col(key).isNotNull())
    repeated = docs.groupBy(key).count().where("count > 1")
    if repeated.isEmpty():
        return docs
    rest = [c for c in docs.columns if c not in (key, text)]
    first = docs.groupBy(key).agg(F.min(F.struct(F.col(text), F.to_json(F.struct(*[F.col(c) for c in rest])).alias("r")
                                                 if rest else F.lit("").alias("r"))).alias("one"))
    if not rest:
        return first.select(key, F.col(f"one.{text}").alias(text))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in rest)
    parsed = first.select(key, F.col(f"one.{text}").alias(text), F.from_json("one.r", types).alias("rest"))
    return parsed.select(*[F.col(c) if c in (key, text) else F.col(f"rest.`{c}`").alias(c) for c in docs.columns])


def texts(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` with null texts as empty ones."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: a lineage cut that survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the columns that an operator is about to add, whatever their case."""
    return df.drop(*[c for c in df.columns if c.lower() in {n.lower() for n in names}])


def extended(df: DataFrame, added: str) -> T.StructType:
    """Schema of ``df`` with the columns of the DDL string ``added``."""
    return T.StructType(df.schema.fields + T.StructType.fromDDL(added).fields)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- words and hashes in numpy

def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of at most ``BLOCK`` bytes of text: the rows, the bytes, and each row's offset (one more at the end).

    The text is the column named ``text``; nulls count as empty.
    """
    for batch in batches:
        column = batch.column(batch.schema.get_field_index("text")).cast(pa.large_binary())
        if column.null_count:
            column = pc.fill_null(column, b"")
        if not len(column):
            continue
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
        data = column.buffers()[2]
        data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
        at = 0
        while at < len(column):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK, "right")) - 1)
            yield batch.slice(at, to - at), data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at]
            at = to


def _power(kind: str, base: int, n: int) -> np.ndarray:
    if len(_powers.get(kind, ())) < n:
        size = max(n, BLOCK)
        out = np.full(size, base % 2**64, np.uint64)
        out[0] = 1
        _powers[kind] = np.cumprod(out)
    return _powers[kind][:n]


def word_spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = _SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the words of a block in order, and the index of each row's first word (one more at the end)."""
    n = len(data)
    inside = ~separator[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.ones(n, bool)
    before[1:] = ~inside[:-1]
    starts = np.flatnonzero(inside & (before | edge[:n]))
    after = np.ones(n, bool)
    after[:-1] = ~inside[1:]
    ends = np.flatnonzero(inside & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lower_bytes(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case."""
    return _LOWER[data]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each span; spans are in order and apart."""
    hashes = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + BLOCK + 1)))
        low, high = starts[at], ends[to - 1]
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * _power("up", _BASE, high - low), out=sums[1:])
        s = starts[at:to] - low
        hashes[at:to] = (sums[ends[at:to] - low] - sums[s]) * _power("down", pow(_BASE, -1, 2**64), high - low)[s]
        at = to
    return mix(hashes)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a block in order, and the index of each row's first word (one more at the end)."""
    if lower:
        data = _LOWER[data]
    starts, ends, first = word_spans(data, offsets)
    return span_hashes(data, starts, ends), first


def word_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.LargeBinaryArray]:
    """Code of each word, equal for equal words of the block only, and the words by code."""
    lengths = ends - starts
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] = 1
    inside[ends] -= 1  # where a span starts at another's end, the marks cancel and the sum goes on
    spans = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[np.cumsum(inside[:-1], dtype=np.int8) > 0])])
    found = spans.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def gram_hashes(hashes: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive values, by the index of its first; runs cross rows."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    factor = np.uint64((seed * 2 + 1) * 0xD1342543DE82EF95 % 2**64 | 1)
    out = np.full(len(hashes) - n + 1, seed, np.uint64)
    for j in range(n):
        out = out * factor + hashes[j:len(hashes) - n + 1 + j]
    return mix(out)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
