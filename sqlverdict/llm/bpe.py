"""Byte-level BPE (operator 7): padded numpy matrices of pieces, one merge per row and round.

A text is split by the public pattern into pieces. A piece that is a token is that token;
every other piece is a row of symbols in a matrix of rows of like length. Each round finds
every row's leftmost pair of the smallest rank by a hashed lookup of symbol pairs, merges it,
and moves the rest of the row up; finished rows leave the matrix. Pieces longer than
``LONG`` bytes would make rounds as long as themselves, so they are merged one by one with a
heap of pairs in the same order. A worker keeps the ids of pieces it has seen.

Null texts are empty: no ids. Rows that repeat an id stay as they are, each with its own
result. An empty table gives no rows. Lone surrogates cannot occur in Spark strings.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Longest piece, in bytes, that joins a matrix; and pieces a worker remembers before it starts anew.
LONG, REMEMBERED = 128, 200_000
#: Bytes of text that are encoded together.
PART = 2 << 20
_NONE = np.int32(2**31 - 1)
_encoders: dict[tuple[str, str], "Encoder"] = {}


class Encoder:
    """Ranks of a ``.tiktoken`` file, as lookups for matrices of symbols."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        # The published pattern means Unicode white space; name the property, as \s also takes \x1c-\x1f here.
        self.pattern = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self._hash(np.array(list(pairs), np.uint64), np.array(list(pairs.values()), np.int32))
        self.clear()

    def _hash(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        """Open addressing with linear probing; every key lies within ``probes`` slots."""
        self.shift = np.uint64(64 - max(4, int(len(keys) * 2).bit_length() + 1))
        size = 1 << (64 - int(self.shift))
        self.slots, self.found = np.full(size + 64, 2**64 - 1, np.uint64), np.full(size + 64, _NONE, np.int32)
        left, self.probes = np.arange(len(keys)), 0
        while len(left):
            at = self._slot(keys[left]) + self.probes
            if at.max(initial=0) >= len(self.slots):
                self.slots = np.append(self.slots, np.full(64, 2**64 - 1, np.uint64))
                self.found = np.append(self.found, np.full(64, _NONE, np.int32))
            free = self.slots[at] == 2**64 - 1
            self.slots[at[free]] = keys[left[free]]
            self.found[at[free]] = ranks[left[free]]
            left = left[self.slots[at] != keys[left]]
            self.probes += 1
        self.slots = np.append(self.slots, np.full(self.probes, 2**64 - 1, np.uint64))
        self.found = np.append(self.found, np.full(self.probes, _NONE, np.int32))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.ids, self.size, self.used = np.zeros(1 << 16, np.int32), np.zeros(1 << 12, np.int64), 0
        self.start = np.zeros(1 << 12, np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint32)
        slot = self._slot(keys)
        out = np.full(keys.shape, _NONE, np.int32)
        open_ = np.flatnonzero(np.ones(keys.size, bool))
        flat, keys, slot = out.ravel(), keys.ravel(), slot.ravel()
        for probe in range(self.probes):
            at = slot[open_] + probe
            held = self.slots[at]
            hit = held == keys[open_]
            flat[open_[hit]] = self.found[at[hit]]
            open_ = open_[~hit & (held != 2**64 - 1)]
            if not len(open_):
                break
        return flat.reshape(left.shape)

    def merge_matrix(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of pieces of like length: a merge per row and round."""
        size = np.array([len(p) for p in pieces])
        width = int(size.max())
        inside = np.arange(width) < size[:, None]
        symbols = np.full((len(pieces), width), -1, np.int32)
        symbols[inside] = self.bytes[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = np.full((len(pieces), width), _NONE, np.int32)
        if width > 1:
            ranks[:, :-1] = np.where(inside[:, 1:], self.pair_ranks(symbols[:, :-1], symbols[:, 1:]), _NONE)
        rows, out = np.arange(len(pieces)), [None] * len(pieces)
        while len(rows):
            place = ranks.argmin(axis=1)
            line = np.arange(len(rows))
            best = ranks[line, place]
            done = best == _NONE
            for i in np.flatnonzero(done):
                out[rows[i]] = symbols[i, :size[i]].copy()
            if done.any():
                keep = ~done
                rows, symbols, ranks, size, place, best = (x[keep] for x in (rows, symbols, ranks, size, place, best))
                if not len(rows):
                    break
                width = int(size.max())
                symbols, ranks, line = symbols[:, :width].copy(), ranks[:, :width].copy(), np.arange(len(rows))
            # Put the token in place of the left symbol and move what follows the right one up.
            after = np.arange(width - 1) > place[:, None]
            symbols[:, :-1] = np.where(after, symbols[:, 1:], symbols[:, :-1])
            ranks[:, :-1] = np.where(after, ranks[:, 1:], ranks[:, :-1])
            symbols[line, place] = best
            size = size - 1
            symbols[line, size], ranks[line, size] = -1, _NONE
            for shift in (-1, 0):
                at = place + shift
                fits = np.flatnonzero((at >= 0) & (at + 1 < size))
                ranks[fits, at[fits]] = self.pair_ranks(symbols[fits, at[fits]], symbols[fits, at[fits] + 1])
            edge = np.flatnonzero(place + 1 >= size)
            ranks[edge, place[edge]] = _NONE
        return out

    def merge_long(self, piece: bytes) -> np.ndarray:
        """Ids of one long piece: a heap of (rank, place) over a linked list of symbols."""
        ids = self.bytes[np.frombuffer(piece, np.uint8)].tolist()
        n, ranks, tokens = len(ids), self.ranks, self.tokens
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(b"\1" * n)

        def rank(i: int) -> int | None:
            return ranks.get(tokens[ids[i]] + tokens[ids[after[i]]]) if after[i] < n else None

        heap = [(r, i) for i in range(n) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if not alive[i] or rank(i) != r:
                continue
            gone = after[i]
            ids[i], after[i], alive[gone] = r, after[gone], 0
            if after[i] < n:
                before[after[i]] = i
            for j in (i, before[i]):
                if j >= 0 and (new := rank(j)) is not None:
                    heapq.heappush(heap, (new, j))
        return np.array([x for x, a in zip(ids, alive) if a], np.int32)

    def learn(self, pieces: list[str]) -> None:
        """Remember the ids of pieces not seen so far."""
        groups: dict[int, list[tuple[int, bytes]]] = {}
        found: list[np.ndarray] = [None] * len(pieces)
        for k, piece in enumerate(pieces):
            raw = piece.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                found[k] = np.array([whole], np.int32)
            elif len(raw) > LONG:
                found[k] = self.merge_long(raw)
            else:
                groups.setdefault((len(raw) - 1).bit_length(), []).append((k, raw))
        for rows in groups.values():
            for at in range(0, len(rows), 4096):
                part = rows[at:at + 4096]
                for (k, _), ids in zip(part, self.merge_matrix([raw for _, raw in part])):
                    found[k] = ids
        count = len(self.index)
        if count + len(pieces) > len(self.size):
            grow = max(len(self.size), len(pieces))
            self.size, self.start = np.append(self.size, np.zeros(grow, np.int64)), np.append(self.start, np.zeros(grow, np.int64))
        flat = np.concatenate(found)
        if self.used + len(flat) > len(self.ids):
            self.ids = np.append(self.ids, np.zeros(max(len(self.ids), len(flat)), np.int32))
        sizes = np.array([len(x) for x in found])
        self.size[count:count + len(pieces)] = sizes
        self.start[count:count + len(pieces)] = self.used + np.cumsum(sizes) - sizes
        self.ids[self.used:self.used + len(flat)] = flat
        self.used += len(flat)
        self.index.update(zip(pieces, range(count, count + len(pieces))))

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; pieces that are new to the worker are merged together."""
        split = [self.pattern.findall(text) for text in texts]
        if len(self.index) > REMEMBERED or self.used > 16 * REMEMBERED:
            self.clear()
        new = list({p for pieces in split for p in pieces if p not in self.index})
        if new:
            self.learn(new)
        out = []
        for pieces in split:
            at = np.fromiter(map(self.index.__getitem__, pieces), np.int64, len(pieces))
            size, start = self.size[at], self.start[at]
            out.append(self.ids[np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size)])
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


def _encoder(ranks: bytes, pattern: str) -> Encoder:
    key = (hashlib.sha256(ranks).hexdigest(), pattern)
    if key not in _encoders:
        _encoders[key] = Encoder({base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}, pattern)
    return _encoders[key]


def _parts(batches: Iterator[pa.RecordBatch], encoder: Encoder) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Rows and their ids, some megabytes of text or one long text at a time."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy())
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + PART, "right")))
            part = batch.slice(at, to - at)
            yield part, encoder.encode_all([t or "" for t in part.column(1).to_pylist()])
            at = to


def _broadcast(docs: DataFrame, ranks_path: str):
    """The rank file: under a megabyte, its size is that of a vocabulary and not of the corpus."""
    with open(ranks_path, "rb") as file:
        return docs.sparkSession.sparkContext.broadcast(file.read())


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``doc_id``, the ``ids`` of every text and the ``decoded`` bytes of the ids."""
    ranks = _broadcast(docs, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks.value, pattern)
        for part, ids in _parts(batches, encoder):
            listed = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(np.concatenate(ids)))
            yield pa.RecordBatch.from_arrays([part.column(0), listed, pa.array([encoder.decode(x) for x in ids], pa.binary())],
                                             names=["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """As ``encode_decode``, with counts and digests in place of ids and bytes; ids are hashed where they are made."""
    ranks = _broadcast(docs, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks.value, pattern)
        for part, ids in _parts(batches, encoder):
            yield pa.RecordBatch.from_arrays([
                part.column(0), pa.array([len(x) for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(encoder.decode(x)).hexdigest() for x in ids], pa.string()),
            ], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
