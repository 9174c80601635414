"""From statement runs and result cells to scores per example."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlverdict.functions.cells import profile_results, with_values
from sqlverdict.functions.pytext import has_order_by, strip
from sqlverdict.operators.compare import PAIR, PRINTS, STRICT_PRINTS, match_flex, stored_profiles, unequal
from sqlverdict.operators.numbering import first_per_group
from sqlverdict.session import cut_lineage

RESULT = ["example_id", "side", "query_id"]


def _joined_profiles(runs: DataFrame, cells: DataFrame, prints, profiles: DataFrame | None = None) -> DataFrame:
    prof = profile_results(with_values(cells), prints) if profiles is None else profiles
    keep = [c for c in runs.columns if c not in ("n_rows", "n_cols")]
    return runs.select(*keep).join(prof, RESULT, "left").fillna(0, ["n_rows", "n_cols"])


def dedup_statements(runs: DataFrame) -> DataFrame:
    """Equal statement texts of one example and side: the first position stays."""
    rest = [c for c in runs.columns if c not in ("example_id", "side", "sql")]
    first = F.min_by(F.struct(*rest), F.col("pos")).alias("r")
    return runs.groupBy("example_id", "side", "sql").agg(first).select(
        "example_id", "side", "sql", "r.*"
    ).select(*runs.columns)


def gold_duplicates(runs: DataFrame, cells: DataFrame, profiles: DataFrame | None = None, exact: bool = False) -> DataFrame:
    """Examples where two gold statements give identical ordered results.

    ``dup_pos`` is the first position whose result was already there. ``exact`` confirms
    equal fingerprints from the cells.
    """
    gold = _joined_profiles(dedup_statements(runs.filter("side = 'gold' AND ok")), cells, ["raw_cells"], profiles)
    return _confirmed_duplicates(gold, cells) if exact else _gold_duplicates(gold)


def _confirmed_duplicates(gold: DataFrame, cells: DataFrame) -> DataFrame:
    """Later results are compared with the first of their fingerprint; those unlike it among themselves again.

    One round is enough unless fingerprints of different results are equal.
    """
    result = ["example_id", "n_rows", "n_cols", "raw_cells"]
    rest = cut_lineage(gold.select(*result, "pos", "query_id").withColumn(
        "raw_cells", F.coalesce("raw_cells", F.array().cast("array<bigint>"))))
    valued = with_values(cells.filter("side = 'gold'")).withColumn("side", F.explode(F.array(F.lit("pred"), F.lit("gold"))))
    found = None
    while True:
        firsts = rest.groupBy(*result).agg(F.min_by("query_id", "pos").alias("gold_id"), F.min("pos").alias("_first"))
        later = rest.join(firsts, result).filter("pos > _first").withColumnRenamed("query_id", "pred_id")
        later = cut_lineage(later.withColumns({"p_n_rows": F.col("n_rows"), "g_n_rows": F.col("n_rows")}))
        wrong = cut_lineage(unequal(later, valued, "raw_cells"))
        same = later.join(wrong, list(PAIR), "left_anti").select("example_id", "pos")
        found = same if found is None else found.unionByName(same)
        if wrong.isEmpty():
            return found.groupBy("example_id").agg(F.min("pos").alias("dup_pos"))
        rest = cut_lineage(later.join(wrong, list(PAIR), "left_semi").select(*result, "pos", F.col("pred_id").alias("query_id")))


def _gold_duplicates(gold: DataFrame) -> DataFrame:
    result = ["example_id", "n_rows", "n_cols", "raw_cells"]
    prof = gold.select(*result, "pos").withColumn("raw_cells", F.coalesce("raw_cells", F.array().cast("array<bigint>")))
    firsts = prof.groupBy(*result).agg(F.min("pos").alias("first"), F.count("*").alias("n"))
    again = prof.join(firsts.filter("n > 1"), result).filter("pos > first")
    return again.groupBy("example_id").agg(F.min("pos").alias("dup_pos"))


def unique_results(runs: DataFrame, cells: DataFrame, side: str = "pred") -> DataFrame:
    """Distinct ordered results per example; all failures count as one."""
    mine = dedup_statements(runs.filter(F.col("side") == side))
    prof = _joined_profiles(mine, cells, ["raw_cells"])
    kinds = prof.select(
        "example_id", "ok", F.when(F.col("ok"), F.col("n_rows")).alias("r"),
        F.when(F.col("ok"), F.col("n_cols")).alias("c"), F.when(F.col("ok"), F.col("raw_cells")).alias("p"),
    ).distinct()
    return kinds.groupBy("example_id").agg(F.count("*").alias("n_unique"))


def result_dedup(runs: DataFrame, cells: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """Predicted statements that survive greedy removal of equal results.

    Going through the statements in order, a later one falls to a kept earlier
    one when their results match: by rows if either text is ordered, else as bags
    of cells. Both relations are equalities, of the bag and of the finer row
    print, so the greedy outcome follows from first positions per class, found
    by aggregation alone, without comparing statements two by two:

    * an unordered statement is *free* if it is first in its row class; the first
      free one of a bag class is kept, all other unordered ones fall;
    * the first ordered one of a row class is kept unless that kept unordered one
      is in the same class and comes earlier.

    Failures: the first is kept. An empty result falls to an earlier failure or
    an earlier empty result, but a failure does not fall to an empty result.
    """
    pred = dedup_statements(runs.filter("side = 'pred'"))
    prof = _joined_profiles(pred, cells, ["bag", "row_bags"], profiles).withColumn("ord", has_order_by(F.col("sql")))
    return pred.join(_surviving(prof), ["example_id", "pos"], "left_semi").select(*runs.columns)


def _surviving(prof: DataFrame) -> DataFrame:
    """``(example_id, pos)`` of the predicted statements that ``result_dedup`` keeps."""
    classes = prof.groupBy("example_id", "ok", "bag", F.when(F.col("ok"), F.col("n_rows")).alias("rows"), 
                           F.when(F.col("ok"), F.col("n_cols")).alias("cols"), "row_bags").agg(
        F.min(F.when(F.col("ord"), F.col("pos"))).alias("first_ord"),
        F.min(F.when(~F.col("ord"), F.col("pos"))).alias("first_plain"),
        F.min("pos").alias("first"),
    )
    classes = cut_lineage(classes)
    filled = classes.filter("ok AND rows > 0")
    free = F.when(F.col("first_ord").isNull() | (F.col("first_plain") < F.col("first_ord")), F.col("first_plain"))
    bags = filled.groupBy("example_id", "bag").agg(F.min(free).alias("plain_pos"))
    kept_plain = bags.filter("plain_pos IS NOT NULL").select("example_id", F.col("plain_pos").alias("pos"))
    blocked = (F.col("first_plain") == F.col("plain_pos")) & (F.col("plain_pos") < F.col("first_ord"))
    kept_ord = (
        filled.filter("first_ord IS NOT NULL").join(bags, ["example_id", "bag"])
        .filter(~F.coalesce(blocked, F.lit(False))).select("example_id", F.col("first_ord").alias("pos"))
    )
    rest = classes.filter("NOT ok OR rows = 0").groupBy("example_id").agg(
        F.min(F.when(~F.col("ok"), F.col("first"))).alias("failed"),
        F.min(F.when(F.col("ok"), F.col("first"))).alias("hollow"),
    )
    hollow = F.when(F.col("failed").isNull() | (F.col("hollow") < F.col("failed")), F.col("hollow"))
    kept_rest = rest.select("example_id", F.explode(F.array_compact(F.array("failed", hollow))).alias("pos"))
    return kept_plain.unionByName(kept_ord).unionByName(kept_rest)


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


SHAPE = ["n_rows", "n_cols"]


def result_classes(runs: DataFrame, profiles: DataFrame, min_similarity: float = 0.7) -> DataFrame:
    """Results of an example and side that every rule treats alike, as one row with their number ``n``.

    Equal are those with the same cells at the same places; gold ones are also told apart by their order,
    predicted ones by whether their similarity allows containment. ``query_id`` is one of them.
    ``profiles`` may leave out the normalised prints where only strict rules are asked for.
    """
    gold = F.col("side") == "gold"
    close = F.coalesce(F.col("similarity") > min_similarity, F.lit(False)) if "similarity" in runs.columns else F.lit(False)
    ok = runs.filter("ok").select(*RESULT, (gold & F.col("ordered")).alias("ordered"), (~gold & close).alias("close"))
    prof = ok.join(profiles, RESULT, "left").fillna(0, SHAPE)
    held = [c for c in ("odd", *PRINTS) if c != "raw_cells" and c in profiles.columns]
    return prof.groupBy("example_id", "side", "ordered", "close", *SHAPE, "raw_cells").agg(
        F.count("*").alias("n"), F.min_by(F.struct("query_id", *held), "query_id").alias("r")).select(
        "example_id", "side", "ordered", "close", *SHAPE, "n", "r.*")


_KEYS = "array<struct<rule:int,rows:bigint,cols:int,print:array<bigint>>>"


def class_matches(classes: DataFrame) -> DataFrame:
    """Adds ``strict`` and ``equal`` to classes: does one of the other side match strictly, or in normalised rows.

    Strict rules and normalised rows are equalities of fingerprints, so each class holds the keys by which it
    can be met. Keys: 0 no rows, 1 bag of cells, 2 rows in order, 3 normalised rows, 4 the same in order;
    3 and 4 only where classes have the normalised prints, and without them ``equal`` tells nothing more.
    Gold classes hold the keys of their own order, predicted ones both. Keys are met by an aggregation over
    classes, never by pairs: a key that thousands of classes hold is one row. An equal bag settles the flexible
    rule too, unless cells may read as no number (``odd``), which equal nothing in a containment.
    """
    gold, rows, cols, zero = F.col("side") == "gold", F.col("n_rows"), F.col("n_cols"), F.lit(0)
    none = F.array().cast("array<bigint>")

    def key(rule: int, r: Column, c: Column, held: Column) -> Column:
        return F.struct(F.lit(rule).alias("rule"), r.cast("long").alias("rows"), c.cast("int").alias("cols"), held.alias("print"))

    def where(allowed: Column, *keys: Column) -> Column:
        return F.when(allowed, F.array(*keys).cast(_KEYS)).otherwise(F.array().cast(_KEYS))

    filled = rows > 0
    flat, in_order = [key(1, zero, zero, F.col("bag"))], [key(2, rows, cols, F.col("row_bags"))]
    if "norm_rows" in classes.columns:
        flat.append(key(3, rows, cols, F.col("norm_rows")))
        in_order.append(key(4, rows, cols, F.col("norm_cells")))
    else:
        classes = classes.withColumn("odd", zero)
    held = classes.select(*RESULT, "odd", F.explode(F.concat(
        where(~filled, key(0, zero, zero, none)),
        where(filled & (~gold | ~F.col("ordered")), *flat),
        where(filled & (~gold | F.col("ordered")), *in_order),
    )).alias("k")).select(*RESULT, "odd", "k.*")
    keys = ["example_id", "rule", "rows", "cols", "print"]
    both = held.groupBy(*keys).agg(F.bool_or(gold).alias("g"), F.bool_or(~gold).alias("p")).filter("g AND p").select(*keys)
    met = held.join(both, keys, "left_semi").groupBy(*RESULT).agg(F.bool_or(F.col("rule") < 3).alias("strict"), F.bool_or((F.col("rule") != 1) | (F.col("odd") == 0)).alias("equal"))
    return classes.join(met, RESULT, "left").fillna(False, ["strict", "equal"])


def open_pairs(classes: DataFrame) -> DataFrame:
    """Pairs of classes that only the cells can settle: one of both is not met yet, and a rule is possible.

    Rules by position and by column maps need equally many rows; containment needs a similar prediction, an
    unordered gold result and at least as many cells. Bags that are equal but ``odd`` are looked at as well.
    ``similarity`` says whether containment is allowed.
    """
    filled = classes.filter("n_rows > 0")
    sides = {side: filled.filter(F.col("side") == side).select(
        "example_id", F.col("query_id").alias(f"{side}_id"), "ordered" if side == "gold" else "close", "bag", F.col("odd").alias(f"{side}_odd"), F.col("equal").alias(f"{side}_met"),
        F.col("n_rows").alias(f"{side}_rows"), (F.col("n_rows") * F.col("n_cols")).alias(f"{side}_cells")) for side in ("gold", "pred")}
    gold, pred = sides["gold"], sides["pred"]
    same_rows = F.col("gold_rows") == F.col("pred_rows")
    inside = ~same_rows & ~F.col("ordered") & F.col("close") & (F.col("gold_cells") <= F.col("pred_cells"))
    columns = ["example_id", "gold_id", "pred_id", "ordered", F.when(F.col("close"), 1.0).otherwise(0.0).alias("similarity")]
    out = None
    for g, p in ((gold.filter("NOT gold_met"), pred), (gold.filter("gold_met"), pred.filter("NOT pred_met"))):
        level = g.join(p.drop("bag").withColumn("gold_rows", F.col("pred_rows")), ["example_id", "gold_rows"]).select(*columns)
        uneven = g.drop("bag").filter("NOT ordered").join(p.filter("close"), "example_id").filter(inside).select(*columns)
        odd = g.filter("NOT ordered AND gold_odd > 0").join(p.filter("pred_odd > 0"), ["example_id", "bag"]).filter(~same_rows & ~inside).select(*columns)
        part = level.unionByName(uneven).unionByName(odd)
        out = part if out is None else out.unionByName(part)
    return out


def match_counts(runs: DataFrame, cells: DataFrame, flex: bool = False, profiles: DataFrame | None = None,
                 min_similarity: float = 0.7, tolerance: float = 0.01) -> DataFrame:
    """``gold_strict``, ``pred_strict`` (and ``.._flex``) per example: statements that some other side's statement matches.

    No gold x predicted table is made for the strict rule, nor for statements that equal rows settle; the flexible rule
    compares the cells of ``open_pairs`` only.
    """
    profiles = stored_profiles(cells, PRINTS if flex else STRICT_PRINTS) if profiles is None else profiles
    classes = class_matches(result_classes(runs, profiles, min_similarity))
    kinds = ["strict"]
    if flex:
        kinds = ["strict", "flex"]
        classes = cut_lineage(classes.select(*RESULT, "ordered", "close", *SHAPE, "n", "odd", "bag", "strict", "equal"))
        pairs = open_pairs(classes)
        if "similarity" not in runs.columns:
            pairs = pairs.drop("similarity")
        found = match_flex(pairs, cells, 0.5, tolerance, profiles=profiles).filter("flex")
        hit = found.select("example_id", F.explode(F.array(*[
            F.struct(F.lit(side).alias("side"), F.col(f"{side}_id").alias("query_id")) for side in ("gold", "pred")])).alias("s"))
        hit = hit.select("example_id", "s.*").distinct().withColumn("hit", F.lit(True))
        classes = classes.join(hit, RESULT, "left").withColumn("flex", F.col("equal") | F.coalesce("hit", F.lit(False)))
    return classes.groupBy("example_id").agg(*[
        F.coalesce(F.sum(F.when((F.col("side") == side) & F.col(k), F.col("n"))), F.lit(0)).alias(f"{side}_{k}") for side in ("gold", "pred") for k in kinds])


def score_examples(runs: DataFrame, matches: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """Precision, recall and F1 per example, strict and (if matched) flexible.

    ``matches`` is a table of pairs, or the counts of ``match_counts``. ``kept`` are the predicted statements that
    count (default: distinct texts). Recall divides by all gold list entries, repeated texts included.
    """
    kept = dedup_statements(runs.filter("side = 'pred'")) if kept is None else kept
    sizes = runs.groupBy("example_id").agg(
        F.count_if(F.col("side") == "gold").alias("n_gold"), F.count_if(F.col("side") == "pred").alias("num_queries"),
    ).join(kept.groupBy("example_id").agg(
        F.count("*").alias("num_unique_queries"), F.count_if(~F.col("ok")).alias("n_failed"),
    ), "example_id", "left").fillna(0)
    found = matches if "gold_strict" in matches.columns else _pair_counts(matches)
    return _scores(sizes, found)


def _pair_counts(matches: DataFrame) -> DataFrame:
    kinds = [k for k in ("strict", "flex") if k in matches.columns]
    sides = F.explode(F.array(
        F.struct(F.lit("gold").alias("what"), F.col("gold_id").alias("id")),
        F.struct(F.lit("pred").alias("what"), F.col("pred_id").alias("id")),
    )).alias("s")
    return (
        matches.select("example_id", *kinds, sides).groupBy("example_id", "s.what", "s.id")
        .agg(*[F.bool_or(k).alias(k) for k in kinds])
        .groupBy("example_id").agg(*[
            F.count_if((F.col("what") == side) & F.col(k)).alias(f"{side}_{k}") for side in ("gold", "pred") for k in kinds
        ])
    )


def _scores(sizes: DataFrame, found: DataFrame) -> DataFrame:
    kinds = [k for k in ("strict", "flex") if f"gold_{k}" in found.columns]
    out = sizes.join(found, "example_id", "left").fillna(0)
    for kind in kinds:
        tail = "" if kind == "strict" else "_flex"
        p = F.least(F.lit(1.0), _ratio(F.col(f"pred_{kind}"), F.col("num_unique_queries")))
        r = F.least(F.lit(1.0), _ratio(F.col(f"gold_{kind}"), F.col("n_gold")))
        out = out.withColumns({"precision" + tail: p, "recall" + tail: r}).withColumns({
            "f1" + tail: _f1(F.col("precision" + tail), F.col("recall" + tail)),
            "all_found" + tail: F.col(f"gold_{kind}") == F.col("n_gold"),
            "one_found" + tail: F.col("recall" + tail) > 0,
            "num_correct" + tail: F.floor(F.col("recall" + tail) * F.col("n_gold") + 1e-9).cast("int"),
        })
    return out.drop(*[f"{s}_{k}" for s in ("gold", "pred") for k in kinds])


def is_unanswerable(gold: Column) -> Column:
    """No gold statement, or one that says so."""
    return (F.size(gold) <= 0) | F.exists(gold, lambda q: F.upper(strip(q)) == "UNANSWERABLE")


def example_status(runs: DataFrame, cells: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """``ok``, ``unanswerable``, ``gold_error`` or ``gold_duplicate`` per example, with the error text."""
    return _status(runs.withColumn("never", F.upper(strip(F.col("sql"))) == "UNANSWERABLE"), gold_duplicates(runs, cells, profiles))


def _status(runs: DataFrame, duplicates: DataFrame) -> DataFrame:
    gold = F.col("side") == "gold"
    base = runs.groupBy("example_id").agg(
        (~F.bool_or(gold) | F.bool_or(gold & F.col("never"))).alias("none"),
        F.min_by(F.when(gold & ~F.col("ok"), F.coalesce("error", F.lit("failed"))),
                 F.when(gold & ~F.col("ok"), F.col("pos"))).alias("gold_error"),
    )
    return base.join(duplicates, "example_id", "left").select(
        "example_id",
        F.when(F.col("none"), "unanswerable").when(F.col("gold_error").isNotNull(), "gold_error")
        .when(F.col("dup_pos").isNotNull(), "gold_duplicate").otherwise("ok").alias("status"),
        F.when(F.col("none"), F.lit(None)).when(F.col("gold_error").isNotNull(), F.col("gold_error"))
        .when(F.col("dup_pos").isNotNull(), F.concat(F.lit("duplicate of gold result at position "), "dup_pos"))
        .alias("error"),
    )


def statement_results(runs: DataFrame, cells: DataFrame) -> DataFrame:
    """One narrow row per distinct statement text: its first position, how many there are (``same``), flags, shape and
    all fingerprints of its result. Texts are read once and left behind."""
    text = F.col("sql")
    first = F.min_by(F.struct("query_id", "pos", "ok", "error", "ordered", *(["similarity"] if "similarity" in runs.columns else [])), "pos")
    distinct = runs.groupBy("example_id", "side", "sql").agg(first.alias("r"), F.count("*").alias("same")).select(
        "example_id", "side", "r.*", "same", has_order_by(text).alias("ord"), (F.upper(strip(text)) == "UNANSWERABLE").alias("never"))
    return distinct.join(profile_results(with_values(cells), PRINTS), RESULT, "left").fillna(0, [*SHAPE, "odd"])


def evaluate(runs: DataFrame, cells: DataFrame, dedup: bool = True, pred_side: str = "pred") -> DataFrame:
    """Guarded scores: examples whose gold cannot be used score zero, with a status.

    Strict and flexible scores come from one pass over the cells, which leaves a narrow row per statement
    (checkpointed), and from the cells of the results that the flexible rule leaves open.
    ``num_executable`` subtracts failures among distinct statements from all predicted statements, repeats included.
    """
    if pred_side != "pred":
        def as_pred(df):
            return df.filter(F.col("side").isin("gold", pred_side)).withColumn(
                "side", F.when(F.col("side") == pred_side, "pred").otherwise("gold"))
        runs, cells = as_pred(runs), as_pred(cells)
    results = cut_lineage(statement_results(runs, cells))
    gold, pred = results.filter("side = 'gold'"), results.filter("side = 'pred'")
    status = _status(results, _gold_duplicates(gold.filter("ok")))
    usable = status.filter("status = 'ok'").select("example_id")
    kept = pred.join(_surviving(pred), ["example_id", "pos"], "left_semi") if dedup else pred
    kept = kept.unionByName(gold).join(usable, "example_id", "left_semi")
    sizes = kept.groupBy("example_id").agg(
        F.sum(F.when(F.col("side") == "gold", F.col("same"))).alias("n_gold"),
        F.count_if(F.col("side") == "pred").alias("num_unique_queries"))
    profiles = results.select(*RESULT, *SHAPE, "odd", *PRINTS)
    plain = kept.select(*[c for c in kept.columns if c in ("similarity", "ordered", "ok", *RESULT)])
    scores = _scores(sizes, match_counts(plain, cells, True, profiles)).drop("n_gold")
    counts = results.groupBy("example_id").agg(
        F.coalesce(F.sum(F.when(F.col("side") == "gold", F.col("same"))), F.lit(0)).alias("n_gold"),
        F.coalesce(F.sum(F.when(F.col("side") == "pred", F.col("same"))), F.lit(0)).alias("num_queries"),
        F.count_if((F.col("side") == "pred") & ~F.col("ok")).alias("n_failed"))
    flags = ["all_found", "one_found", "all_found_flex", "one_found_flex"]
    out = status.join(counts, "example_id").join(scores, "example_id", "left").fillna(0).fillna(False, flags)
    executable = F.when(F.col("status") == "ok", F.col("num_queries") - F.col("n_failed")).when(
        F.col("status") == "unanswerable", F.col("num_queries")).otherwise(0)
    return out.withColumn("num_executable", executable).withColumn(
        "n_gold", F.when(F.col("status") == "unanswerable", 0).otherwise(F.col("n_gold"))).drop("n_failed")


def execution_summary(runs: DataFrame) -> DataFrame:
    """How many predicted statements ran, and whether all did."""
    return runs.filter("side = 'pred'").groupBy("example_id").agg(
        F.count("*").alias("num_queries"), F.count_if("ok").alias("num_valid"), F.bool_and("ok").alias("success"))


def execution_errors(runs: DataFrame, first: int | None = None) -> DataFrame:
    """Messages of failed statements as rows; ``first`` keeps that many per example."""
    text = F.concat(F.lit("Query "), (F.col("pos") + 1).cast("string"), F.lit(" failed: "), F.coalesce("error", F.lit("")))
    failed = runs.filter("side = 'pred' AND NOT ok").select("example_id", "pos", text.alias("message"))
    return failed if first is None else first_per_group(failed, first, ["example_id"], "pos")


def reclassify(predicted: DataFrame, runs: DataFrame) -> DataFrame:
    """``U`` where no statement ran; ``predicted(example_id, pred_category)``."""
    ran = execution_summary(runs).select("example_id", "num_valid")
    out = predicted.join(ran, "example_id", "left").fillna(0, ["num_valid"])
    again = (F.col("pred_category") != "U") & (F.col("num_valid") == 0)
    return out.withColumn("reclassified_to_u", again).withColumn(
        "pred_category", F.when(again, "U").otherwise(F.col("pred_category")))


def correction_gain(final: DataFrame, initial: DataFrame) -> DataFrame:
    """F1 after minus F1 before, for examples that have a corrected list."""
    before = initial.select("example_id", F.col("f1").alias("initial_f1"))
    out = final.join(before, "example_id", "left")
    return out.withColumns({
        "correction_applied": F.col("initial_f1").isNotNull(), "f1_improvement": F.col("f1") - F.col("initial_f1"),
    })


def error_counts(statuses: DataFrame, runs: DataFrame) -> DataFrame:
    """Counts by error kind: gold failures, gold duplicates, failed predictions."""
    failed = runs.filter("side = 'pred' AND NOT ok").select(F.lit("pred_error").alias("kind"))
    whole = statuses.filter("status IN ('gold_error', 'gold_duplicate')").select(F.col("status").alias("kind"))
    return whole.unionByName(failed).groupBy("kind").agg(F.count("*").alias("n"))
