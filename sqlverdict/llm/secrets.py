"""Secret scans (operator 5): an incremental ledger of scanned blobs.

Every version of a text is addressed by the SHA-256 of its content. The ledger is a table
of ``(digest, rule, rule_version, spans)``, one row for each blob and rule version that was
scanned, found or not. ``update`` scans only pairs that the ledger lacks, appends them, and
``findings`` joins the ledger back to all paths. Built-in functions only: ``split`` and
``regexp_extract_all`` walk the same matches from left to right, so the lengths of the
pieces between matches give their positions.

Null texts are empty blobs. Equal texts under many paths are scanned once. An empty table
gives an empty ledger and no rows. Columns other than the path and the text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sqlverdict.llm.common import stored


@dataclass(frozen=True)
class Rule:
    """``pattern`` with the least length of one of its groups; ``hints`` are texts one of which any match holds in lower case."""

    name: str
    pattern: str
    group: int
    least: int
    version: int = 1
    hints: tuple[str, ...] = ()
    #: A pattern with the same matches that pass, or "": fewer short matches to throw away.
    quick: str = ""


#: Base rules, in the order in which spans of one start are listed.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6,
         hints=("passw", "secret", "token", "api")),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, hints=("akia",), quick=r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]+", 0, 24, quick=r"[0-9a-f]{24,}"),
)
#: Rules beyond the base: public formats of keys.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, hints=("private key",)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 1, hints=("eyj",)),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1, hints=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
)
RULES = BASE_RULES + MORE_RULES

SPAN = "struct<start:int,end:int>"
#: Matches that are walked before their spans are put together.
_GROUP = 256
LEDGER = T.StructType([
    T.StructField("digest", T.StringType()), T.StructField("rule", T.StringType()), T.StructField("rule_version", T.IntegerType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
])


def spans_of(text: Column, folded: Column, rule: Rule) -> Column:
    """Spans of the rule's matches, leftmost and non-overlapping, in code points; short ones are dropped."""
    pattern = rule.quick or rule.pattern
    pieces = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    tested = whole if rule.group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group))
    steps = F.arrays_zip(F.transform(F.slice(pieces, F.lit(1), F.size(whole)), F.length).alias("gap"),
                         F.transform(whole, F.length).alias("size"), F.transform(tested, F.length).alias("tested"))
    # The running position is the end of the last match, kept beside the spans so far. Matches are walked in
    # groups, and groups are moved to their places afterwards, so no step copies all spans before it.
    none = F.array().cast(f"array<{SPAN}>")

    def moved(span: Column, by: Column) -> Column:
        return F.struct((span["start"] + by).alias("start"), (span["end"] + by).alias("end"))

    def step(s: Column, m: Column) -> Column:
        first = s["at"] + m["gap"]
        last = first + m["size"]
        found = F.array(F.struct(first.alias("start"), last.alias("end")))
        return F.struct(last.alias("at"), F.when(m["tested"] >= rule.least, F.concat(s["spans"], found)).otherwise(s["spans"]).alias("spans"))

    def walk(group: Column) -> Column:
        return F.aggregate(group, F.struct(F.lit(0).alias("at"), none.alias("spans")), step)

    def place(s: Column, g: Column) -> Column:
        return F.struct((s["at"] + g["at"]).alias("at"), F.concat(s["spans"], F.array(F.transform(g["spans"], lambda x: moved(x, s["at"])))).alias("spans"))

    def spans(m: Column) -> Column:
        groups = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(m), F.lit(1)) - 1) / _GROUP).cast("int")), lambda k: F.slice(m, (k * _GROUP + 1).cast("int"), _GROUP))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{SPAN}>>").alias("spans"))
        return F.aggregate(F.transform(groups, walk), start, place, lambda s: F.flatten(s["spans"]))

    likely = F.lit(False)
    for hint in rule.hints:
        likely = likely | folded.contains(hint)
    if not rule.hints:
        likely = text.rlike(pattern)
    return F.when(likely, F.transform(F.array(steps), spans)[0]).otherwise(none)


def blobs_of(versions: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """``(path, digest, text)`` of every version."""
    content = F.coalesce(F.col(text), F.lit(""))
    return versions.select(F.col(path).alias("path"), F.sha2(content.cast("binary"), 256).alias("digest"), content.alias("text"))


def update(versions: DataFrame, ledger: DataFrame, rules=RULES, path: str = "path", text: str = "text") -> DataFrame:
    """Ledger rows of the blob and rule-version pairs that ``ledger`` lacks.

    A blob is scanned once however many paths hold it; a rule whose version changed is
    run again over all blobs, the others are not.
    """
    blobs = blobs_of(versions, path, text).groupBy("digest").agg(F.first("text").alias("text"))
    known = ledger.groupBy("digest").agg(F.collect_set(F.concat_ws(":", "rule", "rule_version")).alias("known"))
    open_ = blobs.join(known, "digest", "left").withColumn("known", F.coalesce("known", F.array().cast("array<string>")))
    open_ = open_.where(~F.forall(F.array(*[F.lit(f"{r.name}:{r.version}") for r in rules]), lambda x: F.array_contains("known", x)))
    folded = F.lower("text")
    scanned = open_.select("digest", "known", F.array(*[
        F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("rule_version"),
                 F.when(~F.array_contains("known", f"{r.name}:{r.version}"), spans_of(F.col("text"), folded, r)).alias("spans"))
        for r in rules]).alias("rows"))
    return scanned.select("digest", F.explode("rows").alias("row")).select("digest", "row.*").where("spans IS NOT NULL")


def findings(versions: DataFrame, ledger: DataFrame, rules=RULES, path: str = "path", text: str = "text") -> DataFrame:
    """``(path, digest, spans by rule)``: the ledger's rows of the current rule versions on every path."""
    current = ledger.where(F.concat_ws(":", "rule", "rule_version").isin([f"{r.name}:{r.version}" for r in rules]))
    by_blob = current.groupBy("digest").agg(*[F.max(F.when(F.col("rule") == r.name, F.col("spans"))).alias(r.name) for r in rules])
    by_blob = stored(by_blob, "by-blob")  # both sides of the join then shuffle alone, so a digest of many paths can be split
    paths = blobs_of(versions, path, text).select("path", "digest")
    return paths.join(by_blob, "digest", "left")


def joined(rules, columns=None) -> Column:
    """``kind:start:end`` of the rules' spans by start, then by the order of the rules, comma-joined."""
    def labelled(k: int, name: str) -> Column:
        return F.transform(F.coalesce(F.col(name), F.array().cast(f"array<{SPAN}>")), lambda s: F.struct(
            s["start"].alias("start"), F.lit(k).alias("kind"), F.concat_ws(":", F.lit(name), s["start"], s["end"]).alias("label")))

    parts = [labelled(k, r.name) for k, r in enumerate(rules)]
    return F.concat_ws(",", F.transform(F.array_sort(F.concat(*parts)), lambda s: s["label"]))


def scan(versions: DataFrame, ledger_path: str, rules=RULES, path: str = "path", text: str = "text") -> DataFrame:
    """Bring the ledger at ``ledger_path`` up to date, then give ``findings`` of all paths."""
    spark = versions.sparkSession
    try:
        ledger = spark.read.schema(LEDGER).parquet(ledger_path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        ledger = spark.createDataFrame([], LEDGER)
    update(versions, ledger, rules, path, text).write.mode("append").parquet(ledger_path)
    return findings(versions, spark.read.schema(LEDGER).parquet(ledger_path), rules, path, text)
