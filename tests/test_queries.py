"""A spread of registered queries against their SQL, on the smallest tables."""

import os

import pytest

from ledgerloom.workload import load
from ledgerloom.workload.check import compare, connect

FOLDER = "/root/testdata/sf0.001"
NAMES = (
    "C25_text_matches", "D1_first_match_by_rule_set", "D4_category_ladder", "D6_conversion_chain",
    "D12_rule_set_diff", "E1_date_formats", "E6_applied_counts", "E14_amount_profile", "E18_flagged_rows",
    "G1_duplicate_counter", "A4_csv_records", "A11_issue_log", "A18_footprint_upsert", "B20_generated_operations",
    "E10_review_summary", "K2_why_tree", "D1_rule_errors", "D1_faulty_rules_are_left_out", "E6_applied_counts_by_rule_set",
    "B16_refused_files", "B30_review_echo", "C36_review_filter", "D9_recall_save_new", "I6_row_hash", "S1_incremental_import",
    "K1_decision_trace_by_rule_set", "K2_why_tree_by_rule_set", "D4_category_ladder_by_rule_set", "D13_rule_preview_diff_by_rule_set",
    "K3_previous_and_new_category_by_rule_set", "E13_categorical_profile_by_rule_set", "E17_atypicality_by_rule_set", "E4_auto_detection",
    "A24_snapshot_cells", "S1_file_import",
)

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are absent")


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_every_oracle_has_a_query():
    queries, oracles = load()
    assert set(oracles) <= set(queries)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    told, _, _ = compare(spark, duck, FOLDER, name)
    assert told.startswith("ok"), told
