"""Table layouts and fixed label values."""

from __future__ import annotations

# Category labels with their ids, and the three ambiguity types.
CATEGORY_IDS = {"U": 0, "AA": 1, "AU": 2}
CATEGORY_NAMES = {
    "U": "Unanswerable",
    "AA": "Answerable-Ambiguous",
    "AU": "Answerable-Unambiguous",
}
AMBIGUITY_TYPES = ("scope", "attachment", "vague")

RAW_COLUMNS = (
    "split", "question", "question_type", "is_ambiguous", "question_category",
    "db_dump_processed", "db_dump", "db_file", "db_file_full", "gold_queries",
    "ambig_queries", "ambig_type", "nl_interpretations", "ambig_question",
)

EXAMPLES = (
    "example_id STRING, dataset STRING, row_idx BIGINT, split STRING, question STRING, "
    "question_type STRING, category STRING, ambig_type STRING, db_id STRING, db_dump STRING, "
    "gold_queries ARRAY<STRING>, interpretations ARRAY<STRING>"
)
QUERY_RUNS = (
    "example_id STRING, side STRING, query_id STRING, pos INT, sql STRING, ordered BOOLEAN, "
    "ok BOOLEAN, error STRING, n_rows BIGINT, n_cols INT, similarity DOUBLE"
)
RESULT_CELLS = (
    "example_id STRING, side STRING, query_id STRING, row_idx BIGINT, col_idx INT, "
    "kind STRING, num DOUBLE, str STRING"
)
EXAMPLE_SCORES = (
    "example_id STRING, gt_category STRING, pred_category STRING, ambig_type STRING, "
    "precision DOUBLE, recall DOUBLE, f1 DOUBLE, all_found BOOLEAN, one_found BOOLEAN, "
    "precision_flex DOUBLE, recall_flex DOUBLE, f1_flex DOUBLE, all_found_flex BOOLEAN, "
    "num_queries INT, num_unique_queries INT, correction_applied BOOLEAN, "
    "f1_improvement DOUBLE, reclassified_to_u BOOLEAN, status STRING"
)
