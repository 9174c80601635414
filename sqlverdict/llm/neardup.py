"""MinHash near-dedup (operator 4): an inverted join on signature coordinates.

A document's set holds its distinct shingles of ``words`` consecutive lower-cased words; with
fewer words the whole sequence is the only shingle; without words the set is empty and linked
with nothing. Two documents are linked if ``100 * |A & B| >= share * |A | B|``, decided on the
full sets of 64-bit shingle hashes. A component is what links connect.

1. Equal sets become one representative, the smallest id, so exact copies cost one row.
2. Each representative is posted under its coordinate-value pairs. A pair of texts of the wanted
   similarity agrees in at least ``MATCH`` of the ``COORDINATES`` values, save for a chance of about
   3e-5 at the threshold itself. Values found once can match nothing and are skipped. Under one order
   of all values, rarest first, two such texts share a value among their first
   ``COORDINATES - MATCH + 1``, so only that prefix is posted.
3. In a bucket every member is compared with one hub, the member whose values are the most
   frequent, never with all others. Candidates that collide often enough are confirmed.
4. Buckets whose members are not yet in one component are finished exactly: their members are joined
   on prefixes of the shingles themselves, rarest first, with the place and size bounds of a set
   join, for pairs of different components only. A pair joined there is confirmed like any other.
   Pairs inside a component change nothing and are never made.

Null and empty texts have an empty set. Rows that repeat a ``doc_id`` count once
(``common.named``); ties go to the smallest id. An empty table gives no rows. Extra columns of
the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlverdict.llm.common import blocks, gram_hashes, mix, named, signed, stored, texts, word_hashes

WORDS, SHARE = 4, 80
COORDINATES, MATCH = 32, 16
_SALTS = np.random.default_rng(11).integers(1, 2**63, (2, COORDINATES), np.uint64) * np.uint64(2) + np.uint64(1)


def _sets(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row of a block."""
    hashes, first = word_hashes(data, offsets, lower=True)
    grams = gram_hashes(hashes, words, 5)
    out = []
    for low, high in zip(first[:-1], first[1:]):
        if high - low >= words:
            found = np.sort(grams[low:high - words + 1])
            new = np.ones(len(found), bool)
            np.not_equal(found[1:], found[:-1], out=new[1:])
            out.append(found[new])
        else:
            out.append(gram_hashes(hashes[low:high], int(high - low), 5 + int(high - low)) if high > low else hashes[:0])
    return out


def _signatures(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in blocks(batches):
            sets = _sets(data, offsets, words)
            size = np.array([len(s) for s in sets])
            full = np.flatnonzero(size)
            one, two = np.zeros((2, len(size)), np.uint64)
            keys = np.zeros((len(size), COORDINATES), np.uint64)
            if len(full):
                values = np.concatenate(sets)
                starts = (np.cumsum(size) - size)[full]
                one[full] = np.add.reduceat(mix(values + np.uint64(1)), starts)
                two[full] = np.add.reduceat(mix(values ^ np.uint64(0x5851F42D4C957F2D)), starts)
                for j in range(COORDINATES):
                    v = (values ^ _SALTS[0, j]) * _SALTS[1, j]
                    v ^= v >> np.uint64(32)
                    keys[full, j] = mix(np.minimum.reduceat(v, starts) + np.uint64(j))
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * COORDINATES), pa.array(signed(keys.ravel())))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(size.astype(np.int64)), pa.array(signed(one)), pa.array(signed(two)), listed],
                names=["doc_id", "n_shingles", "one", "two", "keys"])
    return run


def _full_sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in blocks(batches):
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array([s.tobytes() for s in _sets(data, offsets, words)], pa.binary())], names=["rep", "members"])
    return run


def _confirm(share: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column(2), batch.column(3)):
                a, b = np.frombuffer(left.as_buffer(), np.uint64), np.frombuffer(right.as_buffer(), np.uint64)
                small, large = (a, b) if len(a) < len(b) else (b, a)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both = int(np.count_nonzero(large[at] == small))
                keep.append(100 * both >= share * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def signatures(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Per document its set size, two hashes of the set, and its coordinate-value pairs."""
    return docs.mapInArrow(_signatures(words), "doc_id long, n_shingles long, one long, two long, keys array<long>")


def postings(reps: DataFrame) -> DataFrame:
    """``(key, rep, hub)``: the prefix of each representative's values that others have too."""
    coordinates = reps.select("rep", F.explode("keys").alias("key"))
    shared = stored(coordinates.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    held = coordinates.join(shared, "key").groupBy("rep").agg(
        F.sort_array(F.collect_list(F.struct("n", "key"))).alias("held"), F.sum("n").alias("hub"))
    held = held.where(F.size("held") >= MATCH)
    return held.select("rep", "hub", F.explode(F.slice("held", F.lit(1), F.size("held") - (MATCH - 1))).alias("post")).select(
        F.col("post.key").alias("key"), "rep", "hub")


def confirmed(pairs: DataFrame, sets: DataFrame, share: int = SHARE) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets are similar enough."""
    left = sets.select(F.col("rep").alias("a"), F.col("members").alias("left"))
    right = sets.select(F.col("rep").alias("b"), F.col("members").alias("right"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(_confirm(share), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """``(id, component)`` of all ids in ``links (a, b)``, the component being its smallest id.

    Alternating large and small stars: every id points its larger neighbours, then its smaller
    ones, at the smallest one near it, until nothing changes. The edges never grow in number.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    seen = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stored(large, "large")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = stored(small.where("u <> v").distinct(), "links")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())


def _bucket_pairs(posts: DataFrame) -> DataFrame:
    """Every member of a bucket with the bucket's hub."""
    hubs = posts.groupBy("key").agg(F.max(F.struct("hub", (-F.col("rep")).alias("rep"))).alias("best"), F.count("*").alias("n"))
    hubs = stored(hubs.where("n > 1").select("key", (-F.col("best.rep")).alias("a")), "hubs")
    return posts.join(hubs, "key").where("rep <> a").select("a", F.col("rep").alias("b")).distinct()


def _colliding(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs that agree in at least ``MATCH`` coordinates."""
    left = reps.select(F.col("rep").alias("a"), F.col("keys").alias("x"))
    right = reps.select(F.col("rep").alias("b"), F.col("keys").alias("y"))
    hits = F.size(F.filter(F.zip_with("x", "y", lambda x, y: x == y), lambda e: e))
    return pairs.join(left, "a").join(right, "b").where(hits >= MATCH).select("a", "b")


def _open_pairs(posts: DataFrame, label: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """Pairs of different components that share an open bucket's members' rare shingles, by the bounds of a set join."""
    posts = posts.join(label, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    spread = posts.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    spread = stored(spread.where("low < high").select("key"), "open")
    members = stored(posts.join(spread, "key").select("rep", "component").distinct(), "members")
    listed = members.join(sets, "rep").mapInArrow(_explode_sets, "rep long, component long, size int, shingle long")
    listed = stored(listed, "shingles")
    shared = stored(listed.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1"), "frequent")
    held = listed.join(shared, "shingle").groupBy("rep", "component", "size").agg(F.sort_array(F.collect_list(F.struct("n", "shingle"))).alias("held"))
    # Shingles found once come first in the order and match nothing; the prefix ends at size - ceil(size * share) + 1.
    held = held.withColumn("alone", F.col("size") - F.size("held"))
    longest = F.col("size") - F.ceil(F.col("size") * share / 100.0) + 1 - F.col("alone")
    held = held.where(longest > 0).select("rep", "component", "size", "alone",
                                          F.posexplode(F.slice("held", F.lit(1), longest.cast("int"))).alias("place", "entry"))
    held = stored(held.select("rep", "component", "size", (F.col("alone") + F.col("place")).alias("place"), F.col("entry.shingle").alias("shingle")), "prefixes")
    spread = held.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    held = held.join(stored(spread.where("low < high").select("shingle"), "open"), "shingle")
    x = held.select("shingle", F.col("rep").alias("a"), F.col("component").alias("ca"), F.col("size").alias("sa"), F.col("place").alias("pa"))
    y = held.select("shingle", F.col("rep").alias("b"), F.col("component").alias("cb"), F.col("size").alias("sb"), F.col("place").alias("pb"))
    needed = F.ceil((F.col("sa") + F.col("sb")) * share / (100.0 + share) - 1e-9)
    met = ((F.col("ca") < F.col("cb")) & (F.col("pa") <= F.col("sa") - needed) & (F.col("pb") <= F.col("sb") - needed)
           & (needed <= F.least("sa", "sb")))
    return x.join(y, (x["shingle"] == y["shingle"]) & met).select("a", "b").distinct()


def _explode_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rep, component, members in zip(*(batch.column(k) for k in range(3))):
            values = np.frombuffer(members.as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(values), rep.as_py())), pa.array(np.full(len(values), component.as_py())),
                pa.array(np.full(len(values), len(values), np.int32)), pa.array(values)], names=["rep", "component", "size", "shingle"])


def near_duplicates(docs: DataFrame, words: int = WORDS, share: int = SHARE) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every document."""
    docs = texts(named(docs))
    signed_docs = stored(signatures(docs, words), "signatures")
    classes = stored(signed_docs.where("n_shingles > 0").groupBy("one", "two").agg(F.min("doc_id").alias("rep")), "classes")
    reps = stored(signed_docs.join(classes.select("rep"), F.col("doc_id") == F.col("rep")).select("rep", "keys"), "reps")
    posts = stored(postings(reps), "posts")
    pairs = stored(_colliding(_bucket_pairs(posts), reps), "pairs")
    candidates = posts.select("rep").distinct()
    sets = stored(docs.join(candidates, F.col("doc_id") == F.col("rep")).select("doc_id", "text").mapInArrow(
        _full_sets(words), "rep long, members binary"), "sets")
    links = stored(confirmed(pairs, sets, share), "confirmed")
    label = stored(components(links).select(F.col("id").alias("rep"), "component"), "components")
    more = stored(confirmed(_open_pairs(posts, label, sets, share), sets, share), "confirmed")
    if not more.isEmpty():
        label = stored(components(links.union(more)).select(F.col("id").alias("rep"), "component"), "components")
    by_class = stored(classes.join(label, "rep", "left").select("one", "two", F.coalesce("component", "rep").alias("component")), "by-class")
    out = signed_docs.select("doc_id", "n_shingles", "one", "two").join(by_class, ["one", "two"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (component == F.col("doc_id")).alias("kept"))
