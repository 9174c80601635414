"""Chat formatting (operator 10): quotation linking.

Lines that begin with ``>`` are quotes, their level is the number of marks. Neighbouring lines
of one level are a passage. Passages are normalised (lower case, one space between words)
and hashed. What a message says itself is indexed in its conversation by the hashes of its
whole text, its paragraphs and its lines, and a passage is joined to the earliest message
of the conversation that says it, if that came before. A passage found nowhere like that is
looked up inside the messages: as one of their sentences, or, from ``GRAM`` words on, as any words
in a row, however they were wrapped. Messages are indexed by sentences and grams of ``GRAM`` words
for that, in conversations with such passages only; a passage meets those that hold its rarest
gram and is then compared word by word. So the smallest quote that is linked is a whole message,
paragraph, line or sentence, or ``GRAM`` words of one. What is still open is looked up line by line. A message replies to the original of its outermost linked passage; of
several, to the latest. Chains of replies give each message a thread (its first message) and a
depth. In reply order a conversation is its messages by thread and turn, so a reply follows
what it quotes and nothing else moves. Quotes are left out of the text, and so is a line like
"... wrote:" right before one.

A conversation is kept as one row per message with its order, never gathered, so it may be of
any length. Messages without quotes keep their text and are their own thread. Null texts are
empty, null roles are ``unknown``. Rows without a conversation or turn go; of rows that repeat
both, the one with the smallest role and text stays. A passage that only itself or later messages
say is not linked. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlverdict.llm.common import stored

PARSED = ("conv_id long, turn long, role string, text string, passages array<struct<passage:int,level:int,whole:boolean,key:long,words:string>>, "
          "says array<long>, n_passages long")
#: One message of a formatted conversation.
TEMPLATE = "<|{role}|>\n{text}\n<|end|>\n"
#: Words of a gram: the least number of words that are linked wherever they stand in a message.
GRAM = 5
_SENTENCE = re.compile(r"(?<=[.!?\u2026])\s+")
_MARKS = re.compile(r"^(?:[ \t]*>)+")
#: Endings of a line that names whom the next lines quote.
_NAMES = re.compile(r"(?:wrote|writes|schrieb|escribió|a écrit)\s*:\s*$", re.I)


def _key(text: str) -> int | None:
    """Hash of a normalised text; None if it has no words."""
    words = text.lower().split()
    return struct.unpack("<q", hashlib.blake2b(" ".join(words).encode(), digest_size=8).digest())[0] if words else None


def parse_message(text: str | None) -> tuple[str, list[tuple[int, int, bool, int, str | None]], list[int]]:
    """Own text, quoted keys ``(passage, level, whole, key, words)``, and keys of what the message says itself."""
    lines = (text or "").split("\n")
    marks = [m.group() if (m := _MARKS.match(line)) else "" for line in lines]
    levels = [m.count(">") for m in marks]
    passages: list[tuple[int, list[str]]] = []
    own: list[str] = []
    for k, (line, level) in enumerate(zip(lines, levels)):
        if level:
            body = line[len(marks[k]):]
            if k and levels[k - 1] == level:
                passages[-1][1].append(body)
            else:
                passages.append((level, [body]))
        elif not (k + 1 < len(lines) and levels[k + 1] and _NAMES.search(line)):
            own.append(line)
    said = "\n".join(own).strip("\n") if passages else (text or "")
    quoted = []
    for n, (level, bodies) in enumerate(passages):
        keys = [("\n".join(bodies), True)] + ([(b, False) for b in bodies] if len(bodies) > 1 else [])
        quoted += [(n, level, whole, key, " ".join(body.lower().split()) if whole else None) for body, whole in keys if (key := _key(body)) is not None]
    parts = [said, *re.split(r"\n[ \t]*\n", said), *said.split("\n")]
    return said, quoted, list(dict.fromkeys(key for p in parts if (key := _key(p)) is not None))


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("passage", pa.int32()), ("level", pa.int32()), ("whole", pa.bool_()), ("key", pa.int64()), ("words", pa.string())]))
    for batch in batches:
        said, quoted, says, count = [], [], [], []
        for text in batch.column(3):
            own, keys, index = parse_message(text.as_py())
            said.append(own)
            quoted.append([dict(zip(("passage", "level", "whole", "key", "words"), k)) for k in keys])
            says.append(index)
            count.append(len({k[0] for k in keys}))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(said, pa.string()), pa.array(quoted, kind),
             pa.array(says, pa.list_(pa.int64())), pa.array(count, pa.int64())],
            names=["conv_id", "turn", "role", "text", "passages", "says", "n_passages"])


def parse(messages: DataFrame) -> DataFrame:
    """One row per message with its own text, its quoted passages and what it says, as hashes."""
    messages = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    if not messages.groupBy("conv_id", "turn").count().where("count > 1").isEmpty():
        messages = messages.groupBy("conv_id", "turn").agg(F.min(F.struct("role", "text")).alias("one")).select("conv_id", "turn", "one.*")
    return messages.mapInArrow(_parse, PARSED)


def grams_of(text: str) -> list[int]:
    """Keys of the runs of ``GRAM`` words of a text, and of the whole text if it has fewer."""
    words = text.lower().split()
    return [key for k in range(max(1, len(words) - GRAM + 1)) if (key := _key(" ".join(words[k:k + GRAM]))) is not None]


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        convs, turns, keys = [], [], []
        for conv, turn, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
            short = [key for x in _SENTENCE.split(text) if len(x.split()) < GRAM and (key := _key(x)) is not None]
            found = dict.fromkeys([*grams_of(text), *short])
            convs += [conv] * len(found)
            turns += [turn] * len(found)
            keys += found
        yield pa.RecordBatch.from_arrays([pa.array(convs, pa.int64()), pa.array(turns, pa.int64()), pa.array(keys, pa.int64())], names=["conv_id", "original", "gram"])


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        grams = pa.array([list(dict.fromkeys(grams_of(x))) for x in batch.column(4).to_pylist()], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([*batch.columns, grams], names=[*batch.schema.names, "grams"])


def _holds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose message, the last column, says the words in a row, or as a sentence if they are few."""
    for batch in batches:
        def holds(words: str, text: str) -> bool:
            if words.count(" ") + 1 < GRAM:
                return any(" ".join(x.lower().split()) == words for x in _SENTENCE.split(text))
            return f" {words} " in f" {' '.join(text.lower().split())} "

        kept = batch.filter(pa.array([holds(*x) for x in zip(batch.column(4).to_pylist(), batch.column(6).to_pylist())], pa.bool_()))
        yield kept.select([0, 1, 2, 3, 5])


def inside(parsed: DataFrame, passages: DataFrame) -> DataFrame:
    """``(conv_id, turn, passage, level, original)``: the earliest message before that has each passage inside."""
    messages = parsed.join(passages.select("conv_id").distinct(), "conv_id", "left_semi").select("conv_id", "turn", "text")
    index = stored(messages.mapInArrow(_index, "conv_id long, original long, gram long"), "grams")
    grams = passages.mapInArrow(_grams, "conv_id long, turn long, passage int, level int, words string, grams array<long>")
    grams = grams.select("conv_id", "turn", "passage", "level", "words", F.explode("grams").alias("gram"))
    holders = index.groupBy("conv_id", "gram").agg(F.count("*").alias("n"))
    rarest = grams.join(holders, ["conv_id", "gram"], "left").groupBy("conv_id", "turn", "passage", "level", "words").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("best")).select(
        "conv_id", "turn", "passage", "level", "words", F.col("best.gram").alias("gram"))
    near = rarest.join(index, ["conv_id", "gram"]).where("original < turn").drop("gram")
    texts = messages.select("conv_id", F.col("turn").alias("original"), "text")
    near = near.join(texts, ["conv_id", "original"]).select("conv_id", "turn", "passage", "level", "words", "original", "text")
    held = near.mapInArrow(_holds, "conv_id long, turn long, passage int, level int, original long")
    return held.groupBy("conv_id", "turn", "passage", "level").agg(F.min("original").alias("original"))


def link(parsed: DataFrame) -> DataFrame:
    """``(conv_id, turn, passage, level, original)``: the earliest message that says each passage, if it came before."""
    says = parsed.select("conv_id", "turn", F.explode("says").alias("key")).groupBy("conv_id", "key").agg(F.min("turn").alias("original"))
    says = stored(says, "says")
    quotes = stored(parsed.where("n_passages > 0").select("conv_id", "turn", F.explode("passages").alias("q")).select("conv_id", "turn", "q.*"), "quotes")
    found = stored(quotes.join(says, ["conv_id", "key"]).where("original < turn").select(
        "conv_id", "turn", "passage", "level", F.when(F.col("whole"), 2).otherwise(0).alias("rank"), "original"), "found")
    left = stored(quotes.where("whole").join(found.where("rank = 2"), ["conv_id", "turn", "passage"], "left_anti").select(
        "conv_id", "turn", "passage", "level", "words"), "left")
    if not left.isEmpty():
        found = found.unionByName(inside(parsed, left).withColumn("rank", F.lit(1)))
    # Whole passages count before passages inside a message, and these before single lines; of lines, the latest original.
    best = F.max(F.struct("rank", "original"))
    return found.groupBy("conv_id", "turn", "passage", "level").agg(best.alias("best")).select(
        "conv_id", "turn", "passage", "level", F.col("best.original").alias("original"))


def threads(links: DataFrame) -> DataFrame:
    """``(conv_id, turn, reply_to, thread, depth)`` of all messages with a linked passage.

    Every round doubles the distance that a message looks back along its chain of replies.
    """
    replies = links.groupBy("conv_id", "turn").agg(F.max(F.struct((-F.col("level")).alias("outer"), "original")).alias("best"))
    now = stored(replies.select("conv_id", "turn", F.col("best.original").alias("reply_to"), F.col("best.original").alias("thread"),
                                F.lit(1).cast("long").alias("depth")), "replies")
    while True:
        up = now.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("above"), F.col("depth").alias("more"))
        after = stored(now.join(up, ["conv_id", "thread"], "left").select(
            "conv_id", "turn", "reply_to", F.coalesce("above", "thread").alias("thread"),
            (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("above").isNotNull().alias("moved")), "threads")
        now = after.drop("moved")
        if after.where("moved").isEmpty():
            return now


def conversations(messages: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """Messages without quotes in reply order: conversations by id, each by thread and turn."""
    parsed = stored(parse(messages), "parsed")
    links = stored(link(parsed), "links")
    placed = threads(links)
    counts = links.groupBy("conv_id", "turn").agg(F.count("*").alias("n_linked"))
    before, after = template.split("{role}")
    middle, end = after.split("{text}")
    out = parsed.join(placed, ["conv_id", "turn"], "left").join(counts, ["conv_id", "turn"], "left").select(
        "conv_id", F.coalesce("thread", "turn").alias("thread"), "turn", "role", "reply_to", F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        "n_passages", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "text",
        F.concat(F.lit(before), "role", F.lit(middle), "text", F.lit(end)).alias("formatted"))
    return out.repartitionByRange("conv_id", "thread", "turn").sortWithinPartitions("conv_id", "thread", "turn")
