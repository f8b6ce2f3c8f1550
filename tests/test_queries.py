"""Every registered query with SQL against DuckDB at the smallest scale, and the contract."""

import pytest

import __spark_entry__ as entry_module
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry_module.queries(), entry_module.oracle_sql()
# One per family here; the whole set runs with ``python -m tests.oracle``.
SAMPLE = (
    "entry_names", "body_facts", "search_exact_key", "best_call_per_fdi", "coverage_calendar", "mirror_plan", "copies_of_one_day",
    "newest_call_per_key", "call_outcomes", "retry_targets", "layered_headers", "three_way_verdicts", "case_summaries", "review_state",
    "filter_switches", "exact_block_matches", "candidate_block_pairs", "change_types", "payload_leaves", "value_proofs", "zone_differences",
    "delivery_plan", "sliding_rate",
)


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_contract(spark):
    assert set(SQL) <= set(QUERIES)
    assert entry_module.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_query(spark, con, name):
    ok, text = compare(spark, con, SF, name, QUERIES[name], SQL[name])
    assert ok, text
