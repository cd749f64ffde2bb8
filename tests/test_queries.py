"""Every query that SQL can state gives the rows SQL gives."""

import os

import pytest

import __spark_entry__ as entry
from compare import compare, database

QUERIES, SQL = entry.queries(), entry.oracle_sql()
# one or two of every subject; TEST_ALL=1 compares all of them
USUAL = """customer_snapshot matured_cutoffs clean_coerce prepare_cases key_checks exact_sample stratified_folds
dedup_latest profile_numeric drift_verdict auc_exact top_decile_precision macro_f1 text_normalize mask_term
drop_last_sentence playbook_join retention_digest complaint_routing usage_counters running_usage
visitor_trailing_hour quota_remaining quota_replay_daily call_cost event_latest_state action_flatten route_latency
counter_increase validate_records copy_reconcile paired_labels knn_exact knn_same_product_excluding_self
chance_precision hashed_embedding tfidf_topk citation_filter stream_daily_usage stream_routing
cost_per_question isotonic_rule_score risk_drivers_fixed knn_hashed_recall table_refresh stream_daily_usage_late""".split()


@pytest.fixture(scope="module")
def con(folder):
    return database(folder)


@pytest.mark.parametrize("name", sorted(SQL) if os.environ.get("TEST_ALL") else USUAL)
def test_same_rows_as_sql(spark, con, folder, name):
    assert compare(spark, con, name, QUERIES[name], SQL[name], folder) is None


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1
