"""Phrase collocation mining (operator 12): Apriori-safe candidates counted by broadcast double-array tries.

Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends, and pieces into words
at spaces and tabs. Phrases lie within a piece and are counted per language. The steps, each one
scan of the texts:

1. Words are counted exactly. Only frequent ones can be part of a candidate.
2. For two, three and four words, tasks count hashes of the phrases whose two shorter parts may
   be frequent; Spark sums them. Sums can only be too large (hashes that meet), so the ones that
   reach ``least`` are a safe superset, the candidates. Joins with the shorter phrases and the words
   give their text. Their hashes become a bitmap of ``bits`` positions, broadcast for the next
   length: its size is fixed, and one that fills up prunes less but loses nothing.
3. Candidates are dealt into ranges of about ``block`` phrases; a task builds the double-array trie of
   a range. Tries are broadcast in groups of at most ``BROADCAST`` bytes (their size is checked), and each
   group is one scan: numpy advances the states of all positions at once, word by word, bincounts
   accepting states, and Spark sums the arrays of counts of the tasks. These counts are exact.

Cuts, scores and dropping are joins and aggregations of counted phrases. Integers of the score
are decimals, so products may pass 64 bits. The first ``top`` of a language are ranked in two
steps, the first on salted parts, so a language of any size is never in one task.

Null texts are empty; a null language is ``und``. Every row counts, also repeated rows and rows
without an id: these are statistics of the table. Ties of score and count are ordered by the
phrase, so ranks are unique. An empty table, or one without candidates, gives no rows. Other
columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlverdict.llm import double_array
from sqlverdict.llm.common import blocks, lower_bytes, mix, signed, span_hashes, stored, word_codes, word_spans

#: Least count of a candidate, most words in one, and the percentage of a longer one that drops it.
LEAST, LONGEST, SHARE, TOP = 30, 4, 80, 2000
#: Positions of a bitmap, as a power of two (8 MB).
BITS = 26
#: Phrases in a range of candidates, and bytes of tries in one broadcast.
BLOCK_PHRASES, BROADCAST = 1 << 17, 48 << 20
#: Values that a task holds before it sums or sends them.
_HELD = 1 << 21
#: Counts sent as one array, and tasks whose arrays are summed first.
_CHUNK, _TASKS = 4096, 256
_SALTS = 64
_FACTOR = np.uint64(0x9FB21C651E98DF25)
_SPACE, _BREAK = np.zeros(256, bool), np.zeros(256, bool)
_SPACE[[9, 32]] = True
_BREAK[[10, 11, 12, 13, *b".,;:!?"]] = True


class _Tokens:
    """The words of a block of rows: codes, pieces, languages, and hashes by language."""

    def __init__(self, rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray):
        data = lower_bytes(data)
        starts, ends, first = word_spans(data, offsets, _SPACE | _BREAK)
        self.codes, self.words = word_codes(data, starts, ends)
        langs = rows.column(rows.schema.get_field_index("lang")).fill_null("und").dictionary_encode()
        self.langs = langs.dictionary.to_pylist()
        counts = np.diff(first)
        self.lang = np.repeat(langs.indices.to_numpy(zero_copy_only=False), counts).astype(np.int64)
        breaks = np.zeros(len(data) + 1, np.int64)
        np.cumsum(_BREAK[data], out=breaks[1:])
        piece = breaks[starts] + np.repeat(np.arange(len(counts)), counts)
        #: First position behind the piece of each word.
        self.until = np.searchsorted(piece, piece, "right")

    def hashes(self) -> np.ndarray:
        """Hash of each word with its language."""
        seeds = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in self.langs], np.uint64)
        ends = np.frombuffer(self.words.buffers()[1], np.int64)[:len(self.words) + 1]
        data = np.frombuffer(self.words.buffers()[2] or b"", np.uint8)
        return mix(span_hashes(data, ends[:-1], ends[1:])[self.codes] ^ seeds[self.lang]) if len(self.codes) else np.zeros(0, np.uint64)

    def parts(self, maps: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all phrases of one word more than there are maps, where all parts may be frequent:
        that of all words but the last, and that of the last."""
        word = self.hashes()
        gram, at = word, np.arange(len(word))
        for k, found in enumerate(maps):
            if k:
                longer = np.zeros(len(gram), np.uint64)
                longer[at] = _join(gram[at], word[at + k])
                gram = longer
            place = (gram[at] & np.uint64((1 << bits) - 1)).astype(np.int64)
            at = at[found[place >> 3] >> (place & 7).astype(np.uint8) & 1 > 0]
            at = at[:-1][at[1:] == at[:-1] + 1] if len(at) else at  # the part without the first word is left too
            at = at[at + k + 1 < self.until[at]]
        return gram[at], word[at + len(maps)]


def _join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a phrase from those of its parts."""
    return mix(left * _FACTOR + right)


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[_Tokens]:
    for rows, data, offsets in blocks(batches):
        yield _Tokens(rows, data, offsets)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for t in _tokens(batches):
        if not len(t.codes):
            continue
        keys, first, counts = np.unique(t.lang * len(t.words) + t.codes, return_index=True, return_counts=True)
        held.append(pa.table([
            pa.array(t.langs, pa.string()).take(pa.array(keys // len(t.words))),
            t.words.cast(pa.large_string()).cast(pa.string()).take(pa.array(keys % len(t.words))),
            pa.array(signed(t.hashes()[first])), pa.array(counts.astype(np.int64))], names=["lang", "word", "hash", "n"]))
        size += len(keys)
        if size > _HELD // 8:
            yield from _summed(held, "lang", "word", "hash")
            held, size = [], 0
    if held:
        yield from _summed(held, "lang", "word", "hash")


def _summed(held: list[pa.Table], *keys: str) -> list[pa.RecordBatch]:
    out = pa.concat_tables(held).group_by(list(keys)).aggregate([("n", "sum")])
    return out.select([*keys, "n_sum"]).rename_columns([*keys, "n"]).to_batches()


def _count_parts(maps: Broadcast, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for t in _tokens(batches):
            held.append(t.parts(maps.value, bits))
            size += len(held[-1][0])
            if size > _HELD:
                yield summed(held)
                held, size = [], 0
        if held:
            yield summed(held)

    def summed(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        left, right = (np.concatenate(x) for x in zip(*held))
        hashes = _join(left, right)
        order = np.argsort(hashes)
        hashes = hashes[order]
        at = np.flatnonzero(np.r_[len(hashes) > 0, hashes[1:] != hashes[:-1]][:len(hashes)])
        first, counts = order[at], np.diff(np.r_[at, len(hashes)])
        return pa.RecordBatch.from_arrays([pa.array(signed(left[first])), pa.array(signed(right[first])), pa.array(counts.astype(np.int64))], names=["left", "right", "n"])
    return run


def _hash_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = (batch.column(k).to_numpy(zero_copy_only=False).view(np.uint64) for k in range(2))
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(signed(_join(left, right)))], names=["left", "right", "hash"])


def _build_tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [pair for batch in batches for pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
    if not rows:
        return
    rows.sort()
    trie = double_array.build([lang for lang, _ in rows], [p.encode().split(b" ") for _, p in rows])
    size = len(rows)
    yield pa.RecordBatch.from_arrays([
        pa.array([TaskContext.get().partitionId()] * (size + 1), pa.int32()), pa.array([*range(size), -1], pa.int32()),
        pa.array([*(lang for lang, _ in rows), None], pa.string()), pa.array([*(p for _, p in rows), None], pa.string()),
        pa.array([0] * size + [trie.nbytes], pa.int64()), pa.array([None] * size + [pickle.dumps(trie)], pa.binary())],
        names=["block", "entry", "lang", "phrase", "size", "trie"])


def _count_entries(tries: Broadcast, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_tries = [(block, trie, {w: k + 1 for k, w in enumerate(trie.words)}) for block, trie in tries.value]
        counts = [np.zeros(int(trie.accept.max(initial=-1)) + 1, np.int64) for _, trie, _ in all_tries]
        for t in _tokens(batches):
            words = t.words.to_pylist()
            for k, (_, trie, known) in enumerate(all_tries):
                roots = np.array([trie.roots.get(x, -1) for x in t.langs], np.int64)
                codes = np.array([known.get(w, 0) for w in words], np.int64)
                if len(t.codes):
                    counts[k] += np.bincount(double_array.walk(trie, roots[t.lang], codes[t.codes], t.until, longest), minlength=len(counts[k]))
        task = TaskContext.get().partitionId() // _TASKS
        for (block, _, _), n in zip(all_tries, counts):
            yield from _chunks({(block, k): n[k * _CHUNK:(k + 1) * _CHUNK] for k in range(-(-len(n) // _CHUNK))}, task)
    return run


def _chunks(sums: dict[tuple[int, int], np.ndarray], task: int) -> Iterator[pa.RecordBatch]:
    keys = [key for key, n in sums.items() if n.any()]
    yield pa.RecordBatch.from_arrays([
        pa.array([b for b, _ in keys], pa.int32()), pa.array([k for _, k in keys], pa.int32()), pa.array([task] * len(keys), pa.int32()),
        pa.array([sums[key].tobytes() for key in keys], pa.binary())], names=["block", "chunk", "task", "counts"])


def _sum_chunks(least: int | None):
    """Sums of the arrays of each chunk, as arrays again, or as the entries that reach ``least``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for block, chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)):
                counts = np.frombuffer(counts.as_buffer(), np.int64)
                sums[block, chunk] = sums[block, chunk] + counts if (block, chunk) in sums else counts.copy()
        if least is None:
            yield from _chunks(sums, 0)
            return
        for (block, chunk), n in sums.items():
            met = np.flatnonzero(n >= least)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(met), block, np.int32)), pa.array((met + chunk * _CHUNK).astype(np.int32)), pa.array(n[met])], names=["block", "entry", "n"])
    return run


def _bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """Bits of the hashes: at most ``2^bits / 32768`` rows of 4 KB come to the driver."""
    place = F.col("hash").bitwiseAND(F.lit((1 << bits) - 1))
    parts = hashes.select(F.expr("0L").alias("_"), place.alias("p")).groupBy(F.shiftright("p", 15).alias("part")).agg(
        F.bitmap_construct_agg(F.col("p") % 32768).alias("bits"))
    out = np.zeros((1 << bits) // 8 if bits > 15 else 4096, np.uint8)
    for row in parts.collect():
        out[row["part"] * 4096:(row["part"] + 1) * 4096] = np.frombuffer(row["bits"], np.uint8)
    return out


def counted(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, bits: int = BITS, block: int = BLOCK_PHRASES) -> tuple[DataFrame, DataFrame]:
    """``(lang, phrase, words, n)`` of all phrases of at most ``longest`` words found ``least`` times, and ``(lang, n)`` of all words."""
    sc = docs.sparkSession.sparkContext
    docs = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    words = stored(docs.mapInArrow(_count_words, "lang string, word string, hash long, n long").groupBy("lang", "word", "hash").agg(F.sum("n").alias("n")), "words")
    frequent = words.where(F.col("n") >= least)
    single = frequent.select("lang", F.col("word").alias("phrase"), "hash")
    names, shorter, candidates = [_bitmap(frequent, bits)], single, None
    for k in range(2, longest + 1):
        sent = sc.broadcast(names)
        sums = docs.mapInArrow(_count_parts(sent, bits), "left long, right long, n long").groupBy("left", "right").agg(F.sum("n").alias("n"))
        sums = sums.where(F.col("n") >= least).select("left", "right").mapInArrow(_hash_parts, "left long, right long, hash long")
        last = single.select(F.col("lang").alias("other"), F.col("phrase").alias("word"), F.col("hash").alias("right"))
        long = sums.join(shorter.withColumnRenamed("hash", "left"), "left").join(last, "right").where("lang = other")
        shorter = stored(long.select("lang", F.concat_ws(" ", "phrase", "word").alias("phrase"), "hash"), f"phrases-{k}")
        sent.unpersist()
        names.append(_bitmap(shorter, bits))
        candidates = shorter if candidates is None else candidates.unionByName(shorter)
    n_blocks = max(1, math.ceil(candidates.count() / block))
    ranges = candidates.select("lang", "phrase").repartitionByRange(n_blocks, "lang", "phrase")
    built = stored(ranges.mapInArrow(_build_tries, "block int, entry int, lang string, phrase string, size long, trie binary"), "tries")
    tries = built.where("entry < 0")
    found = None
    for group in _groups({r["block"]: r["size"] for r in tries.select("block", "size").collect()}):
        sent = sc.broadcast([(r["block"], pickle.loads(r["trie"])) for r in tries.where(F.col("block").isin(group)).select("block", "trie").collect()])
        arrays = "block int, chunk int, task int, counts binary"
        scan = docs.mapInArrow(_count_entries(sent, longest), arrays).repartition("block", "chunk", "task").mapInArrow(_sum_chunks(None), arrays)
        scan = stored(scan.repartition("block", "chunk").mapInArrow(_sum_chunks(least), "block int, entry int, n long"), "counts")
        found = scan if found is None else found.unionByName(scan)
        sent.unpersist()
    single = frequent.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("words"), "n")
    if found is not None:
        long = built.where("entry >= 0").join(found, ["block", "entry"])
        single = single.unionByName(long.select("lang", "phrase", F.size(F.split("phrase", " ")).alias("words"), "n"))
    return stored(single, "phrases"), words.groupBy("lang").agg(F.sum("n").alias("n"))


def _groups(sizes: dict[int, int]) -> Iterator[list[int]]:
    """Blocks whose tries together keep to ``BROADCAST`` bytes (or one block)."""
    group, held = [], 0
    for block, size in sorted(sizes.items()):
        if group and held + size > BROADCAST:
            yield group
            group, held = [], 0
        group.append(block)
        held += size
    if group:
        yield group


def _part(first: str, size: str):
    return F.array_join(F.slice("ws", F.expr(first), F.expr(size)), " ")


def mine(docs: DataFrame, least: int = LEAST, share: int = SHARE, top: int = TOP, longest: int = LONGEST,
         bits: int = BITS, block: int = BLOCK_PHRASES) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)`` of the first ``top`` collocations of each language."""
    phrases, totals = counted(docs, least, longest, bits, block)
    long = phrases.where("words > 1").withColumn("ws", F.split("phrase", " "))
    inner = long.where("words > 2").select("lang", "n", "ws", "words", F.explode(F.expr("sequence(2, words - 1)")).alias("size"))
    inner = inner.select("lang", "n", "ws", "size", F.explode(F.expr("sequence(1, words - size + 1)")).alias("at"))
    inner = inner.select("lang", _part("at", "size").alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("within"))
    kept = long.join(inner, ["lang", "phrase"], "left").where(
        F.col("within").isNull() | (F.lit(100).cast("decimal(20,0)") * F.col("within") < F.lit(share).cast("decimal(20,0)") * F.col("n")))
    cuts = kept.select("lang", "phrase", F.col("n").alias("a"), "ws", "words", F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _part("1", "k").alias("left"), _part("k + 1", "words - k").alias("right"))
    counts = phrases.select("lang", F.col("phrase").alias("part"), F.col("n").alias("of"))
    cuts = cuts.join(counts.select("lang", F.col("part").alias("left"), F.col("of").alias("l")), ["lang", "left"])
    cuts = cuts.join(counts.select("lang", F.col("part").alias("right"), F.col("of").alias("r")), ["lang", "right"])
    score = F.expr("CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(19,0)) DIV (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    best = best.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = "ORDER BY score DESC, a DESC, phrase"
    best = best.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(_SALTS)))
    best = best.withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY lang, salt {order})")).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY lang {order})")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
