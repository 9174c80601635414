"""License scans (operator 11): Aho-Corasick over words, a shunting-yard parser for license expressions.

Words are runs of digits, letters a-z (A-Z lower-cased) and characters above U+007F. The words of a text,
one space before and behind each, go through one Aho-Corasick automaton of notice phrases and identifier tags;
every place where the words of a phrase stand one after another is reported, overlaps included.

Behind a tag (``SPDX-License-Identifier:``, ``License-Expression:``) an expression is read from the text
itself up to the end of the line: identifiers, parentheses and ``AND``, ``OR``, ``WITH`` (upper or lower case;
``WITH`` binds closest, then ``AND``). A shunting-yard parser puts it in postfix order, which is evaluated on
a stack: each identifier has a family label and a weight from 0 (no duties) to 1 (network copyleft);
``AND`` takes the larger weight, ``OR`` the smaller, and a known exception behind ``WITH`` halves it. Unknown
identifiers have no label and weight 0.5. An expression ends before a word that cannot go on; parentheses
that stay open are closed and mark it as not valid; a tag without an operand behind it gives none.

The score of a text is the largest weight of its phrases and expressions, 0 without any.

Null and empty texts have no words and no places. Rows without an id go; rows that repeat an id are each
answered. Texts are handled whole. An empty table gives no rows. Columns other than the id and the
text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases and labels that are always reported. Fixed values.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Further notice phrases.
NOTICES = {
    "affero general public license": "agpl",
    "lesser general public license": "lgpl",
    "gnu lgpl": "lgpl",
    "gnu gpl": "gpl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "isc license": "isc",
    "boost software license": "bsl",
    "creative commons": "cc",
    "cc by": "cc",
    "cc by sa": "cc-sa",
    "cc by nc": "cc-nc",
    "all rights reserved": "proprietary",
    "public domain": "public-domain",
    "this is free and unencumbered software": "public-domain",
}
TAGS = ("spdx license identifier", "license expression")
#: Start of an identifier, its family and the weight of the family's duties.
FAMILIES = (
    ("mit", "mit", 0.1), ("apache", "apache", 0.2), ("bsd", "bsd", 0.1), ("isc", "isc", 0.1), ("bsl", "bsl", 0.1), ("zlib", "zlib", 0.1),
    ("0bsd", "public-domain", 0.0), ("cc0", "public-domain", 0.0), ("unlicense", "public-domain", 0.0),
    ("agpl", "agpl", 1.0), ("lgpl", "lgpl", 0.6), ("gpl", "gpl", 0.9), ("mpl", "mpl", 0.5), ("epl", "epl", 0.5),
    ("cc-by-nc", "cc-nc", 0.8), ("cc-by-sa", "cc-sa", 0.6), ("cc-by", "cc", 0.2), ("licenseref", "proprietary", 0.7),
)
WEIGHT = {label: weight for _, label, weight in FAMILIES} | {"proprietary": 0.7, "public-domain": 0.0}
UNKNOWN = 0.5
_BINDS = {"or": 1, "and": 2, "with": 3}
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")
_TOKEN = re.compile(rb"[ \t]*(\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*)")
_COLON = re.compile(rb"[\"']?[ \t]*[:=]?[ \t]*[\"']?")

_PLACE = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64()), ("label", pa.string()), ("base", pa.bool_())]))
_EXPRESSION = pa.list_(pa.struct([("postfix", pa.string()), ("labels", pa.list_(pa.string())), ("weight", pa.float64()), ("valid", pa.bool_())]))
SCHEMA = """doc_id long, n_words long, places array<struct<start:long,words:long,label:string,base:boolean>>,
    expressions array<struct<postfix:string,labels:array<string>,weight:double,valid:boolean>>"""


def family(identifier: str) -> tuple[str | None, float]:
    """Label and weight of an identifier."""
    low = identifier.lower()
    for start, label, weight in FAMILIES:
        if low.startswith(start) and not low[len(start):len(start) + 1].isalpha():
            return label, weight
    return None, UNKNOWN


def _exception(token: str) -> bool:
    return "exception" in token.lower()


def _operand(token: str) -> bool:
    return family(token)[0] is not None or not token.islower() or _exception(token)


def postfix(raw: bytes, at: int) -> tuple[list[str], bool]:
    """The expression that starts at a byte, in postfix order, and whether its parentheses are closed."""
    out, stack, valid = [], [], True
    held: tuple[list[str], list[str]] | None = None  # as they were behind the last operand or closed parenthesis
    want = True  # an operand
    while m := _TOKEN.match(raw, at):
        token = m[1].decode().rstrip(".:")
        low = token.lower()
        if want:
            if token == "(":
                stack.append(token)
            elif token != ")" and low not in _BINDS and _operand(token):
                out.append(token)
                want = False
            else:
                break
        elif token == ")":
            if "(" not in stack:
                break
            while (top := stack.pop()) != "(":
                out.append(top)
        elif low in _BINDS and token in (low, low.upper()):
            while stack and stack[-1] != "(" and _BINDS[stack[-1]] >= _BINDS[low]:
                out.append(stack.pop())
            stack.append(low)
            want = True
        else:
            break
        if not want:
            held = list(out), list(stack)
        at = m.end()
    if held is None:
        return [], True
    out, stack = held
    valid = "(" not in stack
    out += [op for op in reversed(stack) if op != "("]
    return out, valid


def evaluate(rpn: list[str]) -> tuple[list[str], float]:
    """Labels and weight of an expression in postfix order."""
    stack: list[tuple[set[str], float, bool]] = []
    for token in rpn:
        if token not in _BINDS:
            label, weight = family(token)
            stack.append(({label} - {None}, weight, _exception(token)))
            continue
        right, left = stack.pop(), stack.pop()
        if token == "with":
            stack.append((left[0], left[1] / 2 if right[2] else left[1], False))
        else:
            stack.append((left[0] | right[0], (max if token == "and" else min)(left[1], right[1]), False))
    labels, weight, _ = stack.pop()
    return sorted(labels), weight


def _automaton() -> ahocorasick.Automaton:
    """Keys are phrases with a space on both sides, as characters of one byte each."""
    found = ahocorasick.Automaton()
    for phrases, kind in ((NOTICES, "notice"), (BASE, "base"), (dict.fromkeys(TAGS), "tag")):
        for phrase, label in phrases.items():
            found.add_word(f" {phrase} ", (kind, label, phrase.count(" ") + 1))
    found.make_automaton()
    return found


def find(text: str, automaton: ahocorasick.Automaton) -> tuple[int, list[dict], list[dict]]:
    """Number of words, places of phrases and expressions of one text."""
    raw = text.encode()
    plain = raw.translate(_TABLE)
    words = plain.split()
    flat = (b" " + b" ".join(words) + b" ").decode("latin-1")
    places, expressions, seen, before, ends = [], [], 0, 0, None
    for end, (kind, label, size) in automaton.iter(flat):
        seen += flat.count(" ", before, end + 1)
        before = end + 1
        start = seen - 1 - size
        if kind != "tag":
            places.append({"start": start, "words": size, "label": label, "base": kind == "base"})
            continue
        ends = ends or [m.end() for m in _WORD.finditer(plain)]
        rpn, valid = postfix(raw, _COLON.match(raw, ends[start + size - 1]).end())
        if rpn:
            labels, weight = evaluate(rpn)
            expressions.append({"postfix": " ".join(rpn), "labels": labels, "weight": weight, "valid": valid})
    return len(words), sorted(places, key=lambda p: (p["start"], p["words"])), expressions


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = _automaton()
    for batch in batches:
        found = [find(text.as_py() or "", automaton) for text in batch.column(1)]
        yield pa.RecordBatch.from_arrays([
            batch.column(0), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], _PLACE),
            pa.array([f[2] for f in found], _EXPRESSION)], names=["doc_id", "n_words", "places", "expressions"])


def scan(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_words, places, expressions)``: where phrases stand (counted in words) and what the tags say."""
    docs = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_scan, SCHEMA)


def labels(base_only: bool = False) -> Column:
    """Distinct labels of a scanned text, in order, joined by commas."""
    places = F.expr("filter(places, p -> p.base).label") if base_only else F.col("places.label")
    if not base_only:
        places = F.concat(places, F.flatten(F.col("expressions.labels")))
    return F.array_join(F.array_sort(F.array_distinct(places)), ",")


def score() -> Column:
    """Largest weight of a scanned text."""
    weights = F.create_map(*[F.lit(x) for pair in sorted(WEIGHT.items()) for x in pair])
    return F.greatest(F.lit(0.0), F.coalesce(F.array_max(F.transform("places", lambda p: weights[p["label"]])), F.lit(0.0)),
                      F.coalesce(F.array_max("expressions.weight"), F.lit(0.0)))
