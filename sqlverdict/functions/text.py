"""Column functions over dumps, questions and raw model replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sqlverdict.functions.pytext import lines, strip, to_float

# Line starts kept in a schema skeleton, and quantifier words.
SKELETON_STARTS = ("CREATE", "FOREIGN KEY", "PRIMARY KEY", ");")
QUANTIFIERS = ("each", "every", "all", "some", "any")
# Fixed value: a score between 0 and 1 somewhere in a text.
SCORE_PATTERN = r"\b(0?\.\d+|1\.0+|0|1)\b"
PARSE_ERROR_SCORE = 0.25


def strip_inserts(dump: Column, any_case: bool = True) -> Column:
    """The dump without its data lines."""
    def is_data(line: Column) -> Column:
        start = strip(line)
        return (F.upper(start) if any_case else start).startswith("INSERT INTO")

    return F.array_join(F.filter(lines(dump), lambda x: ~is_data(x)), "\n")


def schema_skeleton(dump: Column) -> Column:
    def keep(line: Column) -> Column:
        up = F.upper(line)
        test = up.startswith(SKELETON_STARTS[0])
        for start in SKELETON_STARTS[1:]:
            test = test | up.startswith(start)
        return test

    return F.array_join(F.filter(F.transform(lines(dump), strip), keep), "\n")


def embedding_text(question: Column, dump: Column) -> Column:
    return F.concat(F.lit("Question: "), question, F.lit("\nSchema: "), schema_skeleton(dump))


def quantifier_marker(question: Column) -> Column:
    """``QUANT_`` and the quantifier words found, in order; empty without any."""
    found = F.filter(F.regexp_extract_all(F.lower(question), F.lit(r"(?U)(\w+)"), 1), lambda w: w.isin(*QUANTIFIERS))
    return F.when(F.size(found) > 0, F.concat(F.lit("QUANT_"), F.array_join(found, " "))).otherwise("")


def drop_role(text: Column) -> Column:
    """A leading ``assistant`` line is not part of the reply."""
    t = strip(text)
    mark = "assistant\n\n"
    return F.when(F.lower(t).startswith(mark), strip(F.substring(t, F.lit(len(mark) + 1), F.length(t)))).otherwise(t)


def yes_no(text: Column) -> Column:
    low = F.lower(drop_role(text))
    return F.when(low.contains("yes"), "yes").when(low.contains("no"), "no").otherwise("n/a")


def score_of_text(text: Column) -> Column:
    """The first word if it is a number, clamped to [0, 1]; else the last score in the text; else 0."""
    first = to_float(F.get(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""), 0))
    clamped = F.when(F.isnan(first) | (first > 1.0), 1.0).when(first < 0.0, 0.0).otherwise(first)
    last = F.try_element_at(F.regexp_extract_all(text, F.lit(SCORE_PATTERN), 1), F.lit(-1)).try_cast("double")
    return F.coalesce(F.when(first.isNotNull(), clamped), last, F.lit(0.0))


def unfence(text: Column) -> Column:
    """Drops the first and last line of a reply that opens with a code fence."""
    t = strip(text)
    rows = lines(t)
    inner = F.array_join(F.slice(rows, 2, F.greatest(F.size(rows) - 2, F.lit(0))), "\n")
    return F.when(t.startswith("```"), strip(F.when(F.size(rows) > 2, inner).otherwise(t))).otherwise(t)


_END = "\\u0001end\\u0001"


def parse_json(text: Column) -> Column:
    """A variant, or NULL where the text is not exactly one JSON value.

    The built-in parser stops after the first value, so the text is parsed inside
    a list that must end in a marker right after it. Non-finite numbers and
    repeated keys count as invalid here.
    """
    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{_END}"]')))
    whole = (F.try_variant_get(wrapped, "$[1]", "string") == "\x01end\x01") & F.try_variant_get(
        wrapped, "$[2]", "variant").isNull()
    return F.when(whole, F.try_variant_get(wrapped, "$[0]", "variant"))


def kind_of(v: Column) -> Column:
    return F.schema_of_variant(v)


def is_json_list(text: Column) -> Column:
    return F.coalesce(kind_of(parse_json(text)).startswith("ARRAY"), F.lit(False))


def format_reward(text: Column) -> Column:
    """0.1 for a list of strings with two or more long ones, less for weaker forms."""
    items = F.try_variant_get(parse_json(unfence(text)), "$", "array<variant>")
    strings = F.forall(items, lambda v: kind_of(v) == "STRING")
    long_ones = F.size(F.filter(items, lambda v: F.length(F.try_variant_get(v, "$", "string")) >= 50))
    return (
        F.when(F.coalesce(F.size(items), F.lit(0)) < 2, 0.0).when(~strings, 0.01).when(long_ones >= 2, 0.1)
        .otherwise(0.05)
    )


def quality_gate(text: Column, score: Column) -> Column:
    """The supplied score where the reply is a JSON list, else a fixed low score."""
    return F.when(is_json_list(unfence(text)), score).otherwise(PARSE_ERROR_SCORE)
