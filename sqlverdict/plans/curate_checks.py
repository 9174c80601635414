"""Registered queries for loading, curation, prompts and statement runs, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sqlverdict.operators import compare, curate, examples, extend, prompts, reports, retrieve, run_sql, score
from sqlverdict.plans import fixtures as fx

_TABLES = ("region", "nation", "customer", "orders", "lineitem", "part", "supplier")

# --- loading -----------------------------------------------------------------


def load_examples(spark, sf):
    out = examples.load_examples(fx.raw_rows(spark, sf), "test", exclude_u=True)
    return out.select("example_id", "question", "category", "ambig_type", "db_id", "db_dump",
                      F.array_join("gold_queries", "|").alias("gold"), F.array_join("interpretations", "|").alias("readings"))


def load_examples_limit(spark, sf):
    return examples.load_examples(fx.raw_rows(spark, sf), "train", limit=25, trim_split=True).select("example_id", "category")


def load_corpus(spark, sf):
    return examples.load_corpus(fx.raw_rows(spark, sf)).select(
        "vec_id", "question", "category", "ambig_type", "db_dump", F.array_join("gold_queries", "|").alias("gold"),
        F.array_join("interpretations", "|").alias("readings"))


def load_corpus_ambiguous(spark, sf):
    return examples.load_corpus(fx.raw_rows(spark, sf), ambiguous_only=True).select("vec_id", "ambig_type")


def load_training(spark, sf):
    return examples.load_training(fx.raw_rows(spark, sf), types=("scope", "unknown")).select(
        "id", "question", "db_dump", "category", "ambig_type", F.array_join("interpretations", "|").alias("readings"))


def derive_category(spark, sf):
    raw = fx.raw_rows(spark, sf)
    return raw.select("row_idx", *[examples.derive_category(m).alias(m + "_rule") for m in ("column", "flags", "default")])


def split_gold(spark, sf):
    return fx.raw_rows(spark, sf).select("row_idx", F.posexplode(examples.split_gold(F.col("gold_queries"))).alias("pos", "sql"))


def parse_gold_list(spark, sf):
    out = examples.parse_gold_list(fx.raw_rows(spark, sf))
    return out.select("row_idx", F.posexplode("gold_list").alias("pos", "sql"))


def lda_rows(spark, sf):
    raw = fx.raw_rows(spark, sf)
    return raw.select("row_idx", examples.lda_rows(True).alias("fit"), examples.lda_rows(False).alias("test"))


def question_rules(spark, sf):
    raw = fx.raw_rows(spark, sf)
    cat = examples.derive_category()
    return raw.select(
        "row_idx", examples.question_with_suffix().alias("question"), examples.type_label(cat, F.col("ambig_type")).alias("corpus_type"),
        examples.result_type(cat, F.col("ambig_type")).alias("result_type"))


def unanswerable_gold(spark, sf):
    d = fx.table(spark, sf, "documents")
    gold = F.when(F.col("doc_id") % 3 == 0, F.array().cast("array<string>")).when(
        F.col("doc_id") % 3 == 1, F.array("lang", F.lit(" Unanswerable"))).otherwise(F.array("lang", "source"))
    return d.select("doc_id", score.is_unanswerable(gold).alias("none"))


# --- curation ------------------------------------------------------------------


def group_split(spark, sf):
    return curate.group_split(fx.examples(spark, sf), "db_id").select("example_id", "split")


def split_audit(spark, sf):
    return reports.split_audit(curate.group_split(fx.examples(spark, sf), "db_id"), "split", "db_id")


def split_types(spark, sf):
    return reports.label_distribution(curate.group_split(fx.examples(spark, sf), "db_id"), "split", "ambig_type")


def capped_sample(spark, sf):
    return curate.capped_sample(fx.examples(spark, sf), 15, ["dataset", "gt_category"], key="doc_id").select("doc_id")


def _classifier_sources(spark, sf):
    """Raw rows of the documents' four languages as three sources."""
    raw = fx.raw_rows(spark, sf).join(fx.table(spark, sf, "documents").select(F.col("doc_id").alias("row_idx"), "lang"), "row_idx")
    langs = {"ambrosia": ("en", "es"), "ambiqt": ("de",), "spider": ("fr",)}
    return {n: curate.classifier_rows(raw.filter(F.col("lang").isin(*codes)), n) for n, codes in langs.items()}


def classifier_rows(spark, sf):
    parts = [df.withColumn("dataset", F.lit(n)) for n, df in _classifier_sources(spark, sf).items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("id", "dataset", "split", "db_dump", F.md5("question").alias("question"), "label")


def mixture(spark, sf):
    """Labelled rows of documents in four languages, capped per source and split."""
    caps = {"train": {"ambrosia": ("train", 100), "ambiqt": ("train", 20), "spider": ("train", 20)},
            "validation": {"ambrosia": ("validation", 30), "ambiqt": ("test", 10), "spider": ("validation", 10)},
            "test": {"ambrosia": ("test", None)}}
    return curate.mixture(_classifier_sources(spark, sf), caps).select("id", "split", "dataset", "label", "label_id")


def balanced_sample(spark, sf):
    return curate.balanced_sample(fx.examples(spark, sf), 10, key="doc_id").select("doc_id", "ambig_type")


def curriculum(spark, sf):
    return curate.curriculum(fx.examples(spark, sf), skip=("attachment",), key="doc_id").select(
        "doc_id", "stage", "stage_num", "epochs", "shuffle_key")


def curriculum_capped(spark, sf):
    return curate.curriculum(fx.examples(spark, sf), cap=12, key="doc_id").select("doc_id", "stage")


TRAIN_TEMPLATE = "Schema:\n{db_dump}\nQuestion: {question}\nAnswer as {{list}}."


def training_rows(spark, sf):
    rows = examples.load_training(fx.raw_rows(spark, sf))
    out = prompts.training_rows(rows, TRAIN_TEMPLATE, "You answer.", n=40)
    return out.select("id", F.col("prompt")[1]["content"].alias("user"), F.col("prompt")[0]["role"].alias("role"),
                      "num_ground_truth", "ambig_type")


# --- prompts --------------------------------------------------------------------


def _corpus_texts(spark, sf):
    c = fx.vectors(spark, sf, "corpus")
    dump = F.concat(F.lit("CREATE TABLE t"), "label", F.lit(" (x);\nINSERT INTO t VALUES (1);"))
    gold = F.when(F.col("vec_id") % 2 == 0, F.array(F.lit("SELECT 1"))).otherwise(F.array(F.lit("SELECT 1"), F.lit("SELECT 2")))
    return c.withColumns({"db_dump": dump, "gold_queries": gold})


def fewshot_prompt(spark, sf):
    q, c = fx.vectors(spark, sf, "query"), _corpus_texts(spark, sf)
    near = retrieve.top_k_by_category(q, c, 2, 1)
    probs = q.select(F.col("vec_id").alias("query_id"), "category", F.lit(0.125).alias("p_u"), F.lit(0.5).alias("p_aa"),
                     F.lit(0.375).alias("p_au"))
    return prompts.fewshot_text(near, c, True, probs, 2, 1)


GEN_TEMPLATE = "{examples_text}\nS: {db_schema}\nQ: {question}"
FIX_TEMPLATE = "E: {examples_text} S: {db_schema} Q: {question}\n{queries_text}\nReview the question, interpretations and queries thoroughly."


def _requests(spark, sf):
    p, k = fx.table(spark, sf, "part"), F.col("p_partkey")
    none = F.array().cast("array<string>")
    errors = F.when(k % 3 == 0, F.array(*[F.concat(F.lit(f"e{i} "), "p_brand") for i in range(7)])).otherwise(none)
    return p.select(
        k.alias("id"), F.col("p_name").alias("question"), F.col("p_type").alias("db_schema"),
        F.when(k % 2 == 0, F.col("p_brand")).otherwise("").alias("examples_text"), errors.alias("previous_errors"),
        errors.alias("execution_errors"), F.when(k % 5 == 0, "look again").alias("retry_guidance"),
        F.array(F.lit("SELECT 1"), F.concat(F.lit("SELECT "), "p_size")).alias("sql_queries"))


def generation_request(spark, sf):
    return prompts.generation_request(_requests(spark, sf), GEN_TEMPLATE).select("id", "user")


def correction_request(spark, sf):
    return prompts.correction_request(_requests(spark, sf), FIX_TEMPLATE).select("id", "user")


# --- statement runs ---------------------------------------------------------------

PACKS = [
    ("1", "gold", ["SELECT r_name FROM region", "SELECT n_name FROM nation"]),
    ("1", "pred", ["SELECT r_name FROM region", "SELECT r_name, r_regionkey FROM region"]),
    ("2", "gold", ["SELECT n_name FROM nation ORDER BY n_name"]),
    ("2", "pred", ["SELECT n_name FROM nation ORDER BY n_name DESC", "SELECT n_name FROM nation"]),
    ("3", "gold", ["SELECT n_name FROM nation WHERE n_regionkey = 99"]),
    ("3", "pred", ["SELECT x FROM nation", "SELECT r_name FROM region WHERE r_regionkey = 99"]),
    ("4", "gold", ["SELECT r_regionkey FROM region", "SELECT r_regionkey FROM region WHERE r_regionkey >= 0"]),
    ("4", "pred", ["SELECT r_regionkey FROM region"]),
    ("5", "gold", ["UNANSWERABLE"]),
    ("5", "pred", ["SELECT 1"]),
    ("6", "gold", ["SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment"]),
    ("6", "pred", ["SELECT count(*) AS n, c_mktsegment, max(c_acctbal) AS m FROM customer GROUP BY c_mktsegment"]),
    ("7", "gold", ["SELECT o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey"]),
    ("7", "pred", ["SELECT o_custkey, o_totalprice * 100 AS cents FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey",
                   "DELETE FROM orders"]),
    ("8", "gold", ["SELECT l_suppkey, sum(l_quantity) AS q FROM lineitem GROUP BY l_suppkey"]),
    ("8", "pred", ["SELECT sum(l_quantity) AS q, l_suppkey FROM lineitem GROUP BY l_suppkey"]),
]


def _run_packs(spark, sf):
    rows = [(e, side, f"{side[0]}{i}", i, sql, "tpch") for e, side, sqls in PACKS for i, sql in enumerate(sqls)]
    statements = spark.createDataFrame(rows, "example_id string, side string, query_id string, pos int, sql string, db_id string")
    return run_sql.run_statements(spark, statements, lambda _: {t: fx.table(spark, sf, t) for t in _TABLES})


def run_packs(spark, sf):
    """What every statement returned: success, shape and checksums over all of its cells."""
    runs, cells = _run_packs(spark, sf)
    digest = cells.groupBy("example_id", "side", "query_id").agg(
        (F.max("row_idx") + 1).alias("n_rows"), (F.max("col_idx") + 1).alias("n_cols"),
        F.sum(F.col("num").cast("decimal(24,4)")).cast("double").alias("total"), F.min("str").alias("lo"), F.max("str").alias("hi"),
        F.max(F.when(F.col("row_idx") == 0, F.col("str"))).alias("first_str"))
    return runs.select("example_id", "side", "query_id", "ok").join(digest, ["example_id", "side", "query_id"], "left")


def run_pack_scores(spark, sf):
    runs, cells = _run_packs(spark, sf)
    return score.evaluate(runs, cells).select(
        "example_id", "status", "precision", "recall", "f1", "precision_flex", "recall_flex", "f1_flex", "num_queries",
        "num_unique_queries", "num_executable")


# --- extension points ----------------------------------------------------------------


def rule_columns(spark, sf):
    pairs, cells = fx.cell_pairs(spark, sf), fx.cells(spark, sf)
    mine = {"same_shape": lambda p, c: compare.with_profiles(p, compare.with_values(c), []).select(
        *p.columns, ((F.col("p_n_rows") == F.col("g_n_rows")) & (F.col("p_n_cols") == F.col("g_n_cols"))).alias("hit"))}
    return extend.match_rules(pairs, cells, ["unordered", "ordered", "same_shape"], mine).select(
        "example_id", "rule_unordered", "rule_ordered", "rule_same_shape")


def reward_columns(spark, sf):
    r = fx.replies(spark, sf).withColumn("score", (F.col("id") % 10) / 10)
    return extend.reward_table(r).select("id", "reward_format", "reward_quality")


def score_batches(spark, sf):
    """A user scorer over document batches: share of distinct words."""
    def distinct_share(frame):
        words = frame["text"].str.split()
        return words.map(lambda w: len(set(w)) / max(1, len(w)))

    return extend.score_with(fx.table(spark, sf, "documents").select("doc_id", "text"), distinct_share).select(
        "doc_id", F.round("score", 6).alias("score"))


QUERIES = {
    "load_examples": load_examples, "load_examples_limit": load_examples_limit, "load_corpus": load_corpus,
    "load_corpus_ambiguous": load_corpus_ambiguous, "load_training": load_training, "derive_category": derive_category,
    "split_gold": split_gold, "parse_gold_list": parse_gold_list, "lda_rows": lda_rows, "question_rules": question_rules,
    "unanswerable_gold": unanswerable_gold, "group_split": group_split, "split_audit": split_audit, "split_types": split_types,
    "capped_sample": capped_sample, "mixture": mixture, "classifier_rows": classifier_rows, "balanced_sample": balanced_sample, "curriculum": curriculum,
    "curriculum_capped": curriculum_capped, "training_rows": training_rows, "fewshot_prompt": fewshot_prompt,
    "generation_request": generation_request, "correction_request": correction_request, "run_packs": run_packs,
    "run_pack_scores": run_pack_scores, "rule_columns": rule_columns, "reward_columns": reward_columns,
    "score_batches": score_batches,
}

_CAT = """CASE WHEN trim(question_category) <> '' THEN question_category WHEN question_type = 'unanswerable' THEN 'U'
WHEN upper(is_ambiguous) = 'TRUE' THEN 'AA' WHEN upper(is_ambiguous) = 'FALSE' THEN 'AU' END"""
_DUMP = "CASE WHEN trim(db_dump_processed) <> '' THEN trim(db_dump_processed) ELSE trim(db_dump) END"
_GOLD = "concat('SELECT ', row_idx, '|SELECT 2')"
_READ = "CASE WHEN nl_interpretations = '' THEN '' ELSE concat('a|b', row_idx) END"
_GOLD_LIST = """CASE row_idx % 6 WHEN 0 THEN ['SELECT ' || row_idx, 'SELECT 1'] WHEN 1 THEN ['SELECT ' || row_idx]
ELSE ['SELECT  ' || row_idx, 'SELECT' || chr(10) || ' 2'] END"""


def _raw(tail):
    return f"WITH {fx.SQL_RAW}\n{tail}"


_CLASSIFIER = """, labelled AS (SELECT row_idx AS id, dataset, trim(split) AS split, trim(db_dump_processed) AS db_dump, trim(question, ' ' || chr(9) || chr(10) || chr(13)) AS question,
  CASE dataset WHEN 'ambiqt' THEN 'AA' WHEN 'spider' THEN 'AU' ELSE CASE WHEN question_type = 'unanswerable' THEN 'U' WHEN upper(is_ambiguous) = 'TRUE' THEN 'AA' WHEN upper(is_ambiguous) = 'FALSE' THEN 'AU' END END AS label
  FROM (SELECT raw.*, CASE d.lang WHEN 'de' THEN 'ambiqt' WHEN 'fr' THEN 'spider' ELSE 'ambrosia' END AS dataset
    FROM raw JOIN documents d ON d.doc_id = raw.row_idx WHERE d.lang IN ('en', 'es', 'de', 'fr'))
  WHERE trim(question, ' ' || chr(9) || chr(10) || chr(13)) <> '' AND label IS NOT NULL)
"""


def _ex(tail):
    return f"WITH {fx.SQL_EXAMPLES}{',' if tail.startswith('gs AS') else ''}\n{tail}"


_SPLIT = """gs AS (SELECT db_id, row_number() OVER (ORDER BY md5(concat('42', db_id)), db_id) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT db_id FROM fx_examples)),
sp AS (SELECT e.*, CASE WHEN i < floor(0.8 * n) THEN 'few_shot_examples' WHEN i < floor(0.9 * n) THEN 'test' ELSE 'validation' END AS split FROM fx_examples e JOIN gs USING (db_id))"""
_NAMES = "CASE {} WHEN 'AA' THEN 'Answerable-Ambiguous' WHEN 'AU' THEN 'Answerable-Unambiguous' ELSE 'Unanswerable' END"


def _statement_digests() -> str:
    parts = []
    for e, side, sqls in PACKS:
        for i, sql in enumerate(sqls):
            head = f"SELECT '{e}' AS example_id, '{side}' AS side, '{side[0]}{i}' AS query_id"
            if not sql.startswith("SELECT") or "SELECT x" in sql:
                parts.append(f"{head}, false AS ok, NULL AS n_rows, NULL AS n_cols, NULL AS total, NULL AS lo, NULL AS hi, NULL AS first_str")
                continue
            parts.append((head, sql))
    kinds = {  # numeric and text columns of each statement, and its order
        "SELECT r_name FROM region": ([], ["r_name"]), "SELECT n_name FROM nation": ([], ["n_name"]),
        "SELECT r_name, r_regionkey FROM region": (["r_regionkey"], ["r_name"]),
    }
    out = []
    for part in parts:
        if isinstance(part, str):
            out.append(part)
            continue
        head, sql = part
        nums, strs = kinds.get(sql, (
            [c for c in ("r_regionkey", "n", "m", "o_custkey", "o_totalprice", "cents", "l_suppkey", "q") if _selects(sql, c)],
            [c for c in ("n_name", "r_name", "c_mktsegment") if _selects(sql, c)]))
        width = max(1, len(nums) + len(strs))
        total = " + ".join(f"sum(CAST({c} AS DECIMAL(24,4)))" for c in nums) or "CAST(NULL AS DOUBLE)"
        if sql == "SELECT 1":
            total, sql = "sum(CAST(one AS DECIMAL(24,4)))", "SELECT 1 AS one"
        lo, hi = (f"min({strs[0]})", f"max({strs[0]})") if strs else ("NULL", "NULL")
        if not strs:
            first = "NULL"
        elif "DESC" in sql:
            first = hi
        elif len(nums) == 0:
            first = lo
        else:
            first = f"arg_min({strs[0]}, struct_pack({', '.join(f'a{i} := {c}' for i, c in enumerate(_in_order(nums, strs)))}))"
        out.append(f"""{head}, true AS ok, nullif(count(*), 0) AS n_rows, CASE WHEN count(*) > 0 THEN {width} END AS n_cols, CAST({total} AS DOUBLE) AS total, {lo} AS lo, {hi} AS hi, {first} AS first_str FROM ({sql})""")
    return "\nUNION ALL ".join(out)


def _selects(sql: str, column: str) -> bool:
    listed = sql[len("SELECT "):(sql + " FROM").index(" FROM")]
    return any(part.split()[-1] == column for part in listed.split(", "))


def _in_order(nums, strs) -> list[str]:
    """Row order of an unordered result: texts before numbers."""
    return [f"lower({c})" for c in strs] + nums


ORACLE = {
    "load_examples": _raw(f"""SELECT concat('test_', row_idx) AS example_id, question, {_CAT} AS category, ambig_type, db_file_full AS db_id, {_DUMP} AS db_dump,
{_GOLD} AS gold, CASE WHEN nl_interpretations = '' THEN '' ELSE concat('a || b', row_idx) END AS readings FROM raw WHERE split = 'test' AND db_file_full <> '' AND {_CAT} IN ('AA', 'AU')"""),
    "load_examples_limit": _raw(f"""SELECT concat('train_', row_idx) AS example_id, {_CAT} AS category FROM raw WHERE trim(split) = 'train' AND db_file_full <> '' AND {_CAT} IS NOT NULL ORDER BY row_idx LIMIT 25"""),
    "load_corpus": _raw(f"""SELECT row_idx AS vec_id, trim(question, ' ' || chr(10)) AS question, {_CAT} AS category, CASE WHEN {_CAT} = 'AA' THEN ambig_type END AS ambig_type, {_DUMP} AS db_dump,
array_to_string({_GOLD_LIST}, '|') AS gold, {_READ} AS readings FROM raw WHERE trim(split) = 'train' AND trim(question) <> '' AND {_DUMP} <> '' AND {_CAT} IS NOT NULL"""),
    "load_corpus_ambiguous": _raw(f"SELECT row_idx AS vec_id, ambig_type FROM raw WHERE trim(split) = 'train' AND trim(question) <> '' AND {_DUMP} <> '' AND {_CAT} = 'AA'"),
    "load_training": _raw(f"""SELECT row_idx AS id, trim(question, ' ' || chr(10)) AS question, trim(db_dump_processed) AS db_dump,
CASE WHEN trim(question_category) <> '' THEN question_category WHEN question_type = 'unanswerable' THEN 'U' ELSE 'AA' END AS category,
CASE WHEN ambig_type = '' THEN 'unknown' ELSE lower(ambig_type) END AS ambig_type, {_READ} AS readings FROM raw
WHERE trim(split) = 'train' AND trim(question) <> '' AND nl_interpretations <> '' AND upper(is_ambiguous) = 'TRUE' AND lower(ambig_type) IN ('scope', '')"""),
    "derive_category": _raw(f"""SELECT row_idx, {_CAT} AS column_rule, CASE WHEN question_type = 'unanswerable' THEN 'U' WHEN upper(is_ambiguous) = 'TRUE' THEN 'AA' WHEN upper(is_ambiguous) = 'FALSE' THEN 'AU' END AS flags_rule,
CASE WHEN trim(question_category) <> '' THEN question_category WHEN question_type = 'unanswerable' THEN 'U' WHEN upper(is_ambiguous) = 'TRUE' THEN 'AA' ELSE 'AU' END AS default_rule FROM raw"""),
    "split_gold": _raw("SELECT row_idx, unnest([0, 1]) AS pos, unnest(['SELECT ' || row_idx, 'SELECT 2']) AS sql FROM raw"),
    "parse_gold_list": _raw(f"SELECT row_idx, unnest(range(len(l))) AS pos, unnest(l) AS sql FROM (SELECT row_idx, {_GOLD_LIST} AS l FROM raw)"),
    "lda_rows": _raw("""SELECT row_idx, question_type = 'ambig' AND ambig_type <> 'unanswerable' AND split = 'train' AS fit,
question_type = 'ambig' AND ambig_type <> 'unanswerable' AND split <> 'train' AS test FROM raw"""),
    "question_rules": _raw(f"""SELECT row_idx, CASE WHEN ambig_type = 'attachment' THEN concat(question, ' Show them in one table.') ELSE question END AS question,
CASE WHEN {_CAT} = 'AA' THEN ambig_type END AS corpus_type, CASE WHEN {_CAT} = 'AU' THEN 'null' ELSE ambig_type END AS result_type FROM raw"""),
    "unanswerable_gold": "SELECT doc_id, doc_id % 3 < 2 AS none FROM documents",
    "group_split": _ex(f"{_SPLIT} SELECT example_id, split FROM sp"),
    "split_audit": _ex(f"{_SPLIT} SELECT split, count(*) AS rows, count(DISTINCT db_id) AS groups, 0 AS shared_groups FROM sp GROUP BY 1"),
    "split_types": _ex(f"{_SPLIT} SELECT split, ambig_type AS label, count(*) AS n, 100 * count(*) / t AS pct FROM sp JOIN (SELECT split, count(*) AS t FROM sp GROUP BY 1) USING (split) GROUP BY 1, 2, t"),
    "capped_sample": _ex("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY dataset, gt_category ORDER BY md5(concat('42', doc_id)), doc_id) AS r FROM fx_examples) WHERE r <= 15"),
    "classifier_rows": _raw(_CLASSIFIER + "SELECT id, dataset, split, db_dump, md5(question) AS question, label FROM labelled"),
    "mixture": _raw(_CLASSIFIER + """, r AS (SELECT *, row_number() OVER (PARTITION BY dataset, split ORDER BY md5(concat('42', id)), id) AS r FROM labelled),
u AS (SELECT id, 'train' AS split, dataset, label FROM r WHERE split = 'train' AND r <= CASE dataset WHEN 'ambrosia' THEN 100 ELSE 20 END
  UNION ALL SELECT id, 'validation', dataset, label FROM r WHERE split = CASE dataset WHEN 'ambiqt' THEN 'test' ELSE 'validation' END AND r <= CASE dataset WHEN 'ambrosia' THEN 30 ELSE 10 END
  UNION ALL SELECT id, 'test', dataset, label FROM r WHERE split = 'test' AND dataset = 'ambrosia')
SELECT id, split, dataset, label, CASE label WHEN 'U' THEN 0 WHEN 'AA' THEN 1 ELSE 2 END AS label_id FROM u"""),
    "balanced_sample": _ex("""SELECT doc_id, ambig_type FROM (SELECT *, row_number() OVER (PARTITION BY ambig_type ORDER BY md5(concat('42', doc_id)), doc_id) AS r FROM fx_examples)
WHERE r <= 10 OR ambig_type NOT IN ('scope', 'attachment', 'vague')"""),
    "curriculum": _ex("""SELECT doc_id, stage, stage_num, CASE WHEN stage IN ('scope', 'attachment') THEN 2 ELSE 3 END AS epochs, md5(concat(42 + stage_num, doc_id)) AS shuffle_key FROM (
SELECT doc_id, ambig_type AS stage, CASE ambig_type WHEN 'scope' THEN 1 ELSE 3 END AS stage_num FROM fx_examples WHERE ambig_type IN ('scope', 'vague') UNION ALL SELECT doc_id, 'mixed', 4 FROM fx_examples)"""),
    "curriculum_capped": _ex("""SELECT doc_id, stage FROM (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY md5(concat(42 + stage_num, doc_id)), doc_id) AS r FROM (
SELECT doc_id, ambig_type AS stage, CASE ambig_type WHEN 'scope' THEN 1 WHEN 'attachment' THEN 2 ELSE 3 END AS stage_num FROM fx_examples WHERE ambig_type IN ('scope', 'attachment', 'vague')
UNION ALL SELECT doc_id, 'mixed', 4 FROM fx_examples)) WHERE r <= 12"""),
    "training_rows": _raw("""SELECT id, concat('Schema:', chr(10), d, chr(10), 'Question: ', q, chr(10), 'Answer as {list}.') AS user, 'system' AS role, 2 AS num_ground_truth, ambig_type FROM (
SELECT row_idx AS id, trim(db_dump_processed) AS d, trim(question, ' ' || chr(10)) AS q, CASE WHEN ambig_type = '' THEN 'unknown' ELSE lower(ambig_type) END AS ambig_type FROM raw
WHERE trim(split) = 'train' AND trim(question) <> '' AND nl_interpretations <> '' AND upper(is_ambiguous) = 'TRUE' ORDER BY md5(concat('42', row_idx)), row_idx LIMIT 40)"""),
    "fewshot_prompt": f"""WITH {fx.SQL_VEC}, pick AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY bucket DESC, r) AS rank, vec_id, qc, cc, ct, cq
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id, bucket ORDER BY similarity DESC, vec_id) AS r
    FROM (SELECT *, CASE WHEN qc = cc THEN 'same' ELSE 'other' END AS bucket FROM sims WHERE qq <> cq)) WHERE r <= CASE bucket WHEN 'same' THEN 2 ELSE 1 END),
parts AS (SELECT query_id, rank, qc, concat('**Example ', rank, '** (Category: ', {_NAMES.format('cc')}, CASE WHEN cc = 'AA' THEN concat(', Ambiguity Type: ', ct) ELSE '' END, '):', chr(10), chr(10),
  'Database Schema:', chr(10), 'CREATE TABLE t', v.label, ' (x);', chr(10), chr(10), 'Question: ', cq, chr(10), chr(10),
  CASE WHEN pick.vec_id % 2 = 0 THEN concat('**This question has 1 valid SQL query:**', chr(10), chr(10), 'SQL 1: SELECT 1')
  ELSE concat('**This question has 2 valid SQL queries:**', chr(10), chr(10), 'SQL 1: SELECT 1', chr(10), chr(10), 'SQL 2: SELECT 2') END) AS t FROM pick JOIN fx_vec v ON v.vec_id = pick.vec_id)
SELECT query_id, concat('**Question Classification:**', chr(10), chr(10), 'Classification probabilities:', chr(10), '  - Unanswerable: 0.1250', chr(10), '  - Answerable-Ambiguous: 0.5000', chr(10),
  '  - Answerable-Unambiguous: 0.3750', chr(10), chr(10), 'The question is most likely: **', {_NAMES.format('qc')}, '**', chr(10), chr(10), 'Showing 2 example(s) from **', {_NAMES.format('qc')},
  '** category and 1 example(s) from **', {_NAMES.format("CASE qc WHEN 'AA' THEN 'AU' ELSE 'AA' END")}, '** category.', chr(10), chr(10), '---', chr(10), chr(10), chr(10), chr(10),
  string_agg(t, chr(10) || chr(10) ORDER BY rank)) AS examples_text FROM parts GROUP BY query_id, qc""",
    "generation_request": """SELECT p_partkey AS id, concat(CASE WHEN p_partkey % 3 = 0 OR p_partkey % 5 = 0 THEN concat(chr(10), chr(10), '**RETRY CONTEXT - Previous Attempt Failed:**', chr(10),
  CASE WHEN p_partkey % 3 = 0 THEN concat(chr(10), '**Previous SQL Execution Errors:**', chr(10), '1. e0 ', p_brand, chr(10), '2. e1 ', p_brand, chr(10), '3. e2 ', p_brand, chr(10), '4. e3 ', p_brand, chr(10), '5. e4 ', p_brand, chr(10)) ELSE '' END,
  CASE WHEN p_partkey % 5 = 0 THEN concat(chr(10), '**Failure Analysis and Guidance:**', chr(10), 'look again', chr(10)) ELSE '' END,
  chr(10), '**IMPORTANT:** Use the schema and error information above to avoid making the same mistakes. Generate corrected SQL queries.', chr(10)) ELSE '' END,
  CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '' END, chr(10), 'S: ', p_type, chr(10), 'Q: ', p_name) AS user FROM part""",
    "correction_request": """SELECT p_partkey AS id, concat('E: ', CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'No examples provided.' END, ' S: ', p_type, ' Q: ', p_name, chr(10),
  'Query 1:', chr(10), 'SELECT 1', chr(10), chr(10), 'Query 2:', chr(10), 'SELECT ', p_size, chr(10),
  CASE WHEN p_partkey % 3 = 0 THEN concat('The following execution errors occurred:', chr(10), chr(10), 'Execution Errors:', chr(10), '- e0 ', p_brand, chr(10), '- e1 ', p_brand, chr(10), '- e2 ', p_brand, chr(10), '- e3 ', p_brand, chr(10),
    '- e4 ', p_brand, chr(10), '- e5 ', p_brand, chr(10), '- e6 ', p_brand, chr(10), chr(10)) ELSE '' END, 'Review the question, interpretations and queries thoroughly.') AS user FROM part""",
    "run_packs": _statement_digests(),
    "score_batches": """SELECT doc_id, round(len(list_distinct(w)) / greatest(1, len(w)), 6) AS score
FROM (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM documents)""",
    "reward_columns": f"WITH {fx.SQL_REPLIES} SELECT id, CAST(CASE WHEN fmt = 6 THEN 0.05 ELSE 0 END AS DOUBLE) AS reward_format, CASE WHEN fmt = 6 THEN (id % 10) / 10 ELSE 0.25 END AS reward_quality FROM fx_responses",
}


def _rule_sql() -> str:
    from sqlverdict.plans import compare_checks as cc
    return cc._sql(cc.SQL_BAG, cc.SQL_ROWBAG, tail="""SELECT pr.example_id, e5.ok AS rule_unordered, e6.ok AS rule_ordered, pnr = gnr AND pnc = gnc AS rule_same_shape
FROM pr JOIN e5 USING (example_id) JOIN e6 USING (example_id)""")


ORACLE["rule_columns"] = _rule_sql()
