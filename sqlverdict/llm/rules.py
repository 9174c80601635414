"""Quality rules (operator 9): a threshold table compiled into one projection of built-in functions.

``measures`` gives the numbers of a text, ``RULES`` the table of thresholds over them, and
``apply_rules`` compiles the table: one row per document, no shuffle, no user function.
Null texts count as empty. A text without words has zero ratios and fails by its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlverdict.llm.common import SPACE

#: Symbols counted as such.
SYMBOLS = "#*$%&|<>"
#: Common words of the languages that the rules know; a text needs a few of them.
STOP_WORDS = (
    "the of and to in is that it for was with as are on be this by at or from a an "
    "le la les de des du un une et en que qui est dans pour par sur au avec "
    "el los las del una y se por con para su al lo como "
    "der die das und ist ein eine nicht mit von zu den auf für im dem des sich"
).split()
#: (name, measure, lower bound or None, upper bound or None): a text is kept if all hold.
RULES = (
    ("length", "n_words", 50, None),
    ("word_length", "mean_word_chars", 1.5, 20.0),
    ("symbols", "symbol_ratio", None, 0.10),
    ("stop_words", "stop_ratio", 0.02, None),
    ("dup_lines", "dup_line_ratio", None, 0.50),
    ("repeats", "repeat_ratio", None, 0.50),
)
#: Bits of a sort key that hold a position; the rest hold the hash of a window. Texts that need more are counted by their words.
_POSITION = 24


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row and bound to a lambda variable."""
    return F.transform(F.array(value), body)[0]


def _neighbours(keys: Column, met) -> Column:
    """What ``met`` says of each key and the next, where it is not null."""
    return F.filter(F.zip_with(F.slice(keys, F.lit(1), F.size(keys) - 1), F.slice(keys, F.lit(2), F.size(keys) - 1), met), lambda m: m.isNotNull())


def _covered(met: Column) -> Column:
    """Number of words in windows at the places ``p`` and ``q`` of equal neighbours."""
    places = F.sort_array(F.array_distinct(F.concat(F.transform(met, lambda x: x["p"]), F.transform(met, lambda x: x["q"]))))

    def count(p: Column) -> Column:
        gaps = F.zip_with(F.slice(p, F.lit(1), F.size(p) - 1), F.slice(p, F.lit(2), F.size(p) - 1), lambda a, b: F.least(F.lit(3), b - a))
        return F.when(F.size(p) > 0, F.aggregate(gaps, F.lit(3).cast("long"), lambda s, g: s + g)).otherwise(F.lit(0).cast("long"))

    return _bound(places, count)


def _starts(words: Column) -> Column:
    return F.sequence(F.lit(0), F.size(words) - 3)


def _by_hash(words: Column, bits: int) -> Column:
    """The count from longs of hash and position, equal windows neighbours after one sort of primitives.

    Null where that cannot tell: positions need more than ``bits``, or different windows agree in the
    bits of the hash that are left, so that one might lie between two equal ones.
    """
    def key(i: Column) -> Column:
        window = F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
        return F.shiftleft(F.shiftright(window, bits), bits).bitwiseOR(i.cast("long"))

    def place(k: Column) -> Column:
        return k.bitwiseAND(F.lit((1 << bits) - 1)).cast("int")

    def met(a: Column, b: Column) -> Column:
        p, q = place(a), place(b)
        same = (F.get(words, p) == F.get(words, q)) & (F.get(words, p + 1) == F.get(words, q + 1)) & (F.get(words, p + 2) == F.get(words, q + 2))
        return F.when(F.shiftright(a, bits) == F.shiftright(b, bits), F.struct(p.alias("p"), q.alias("q"), same.alias("same")))

    keys = F.sort_array(F.transform(_starts(words), key))
    count = _bound(_bound(keys, lambda k: _neighbours(k, met)), lambda m: F.when(F.forall(m, lambda x: x["same"]), _covered(m)))
    return F.when(F.size(words) < 1 << bits, count)


def _by_words(words: Column) -> Column:
    """The same count from the windows themselves, for texts where hashes cannot tell."""
    keys = F.array_sort(F.transform(_starts(words), lambda i: F.struct(
        F.get(words, i).alias("a"), F.get(words, i + 1).alias("b"), F.get(words, i + 2).alias("c"), i.alias("p"))))

    def met(x: Column, y: Column) -> Column:
        return F.when((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.struct(x["p"].alias("p"), y["p"].alias("q")))

    return _bound(_bound(keys, lambda k: _neighbours(k, met)), _covered)


def _repeat_words(words: Column, bits: int = _POSITION) -> Column:
    """Words inside three-word windows that occur at least twice in ``words``; exact at any length."""
    return F.when(F.size(words) >= 4, _bound(words, lambda w: F.coalesce(_by_hash(w, bits), _by_words(w)))).otherwise(F.lit(0).cast("long"))


def measures(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the counts of each text; null texts are empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select("doc_id", text.alias("text"), F.split(text, f"{SPACE}+").alias("pieces"))
    listed = split.select("doc_id", "text", F.filter("pieces", lambda w: w != "").alias("words"))
    stop = F.array(*[F.lit(w) for w in sorted(set(STOP_WORDS))])
    lines = F.filter(F.split(F.col("text"), "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return listed.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("long"), lambda s, w: s + F.length(w)).alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        _bound(lines, lambda x: F.struct(
            F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
        _repeat_words(F.col("words")).alias("n_repeat_words"),
        F.size(F.filter("words", lambda w: (F.length(w) < 6) & F.array_contains(stop, F.lower(w)))).cast("long").alias("n_stop"),
    ).select("doc_id", "n_words", "word_chars", "n_symbols", F.col("lines.dup").alias("n_dup_lines"), "n_repeat_words",
             F.col("lines.n").alias("n_lines"), "n_stop")


def apply_rules(docs: DataFrame, rules=RULES) -> DataFrame:
    """Per document the counts, ``base_failed``, ``kept`` and the names of the rules that failed."""
    def ratio(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    values = {
        "n_words": F.col("n_words"), "mean_word_chars": ratio("word_chars", "n_words"),
        "symbol_ratio": F.when(F.col("word_chars") > 0, F.col("n_symbols") / F.col("word_chars")).otherwise(F.lit(0.0)),
        "stop_ratio": ratio("n_stop", "n_words"), "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
        "repeat_ratio": ratio("n_repeat_words", "n_words"),
    }
    failed = []
    for name, measure, low, high in rules:
        bad = F.lit(False)
        if low is not None:
            bad = bad | (values[measure] < low)
        if high is not None:
            bad = bad | (values[measure] > high)
        failed.append(F.when(bad, F.lit(name)))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    reasons = F.concat_ws(",", *failed)
    return measures(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"),
        (~base & (reasons == "")).alias("kept"), reasons.alias("failed_rules"))
