"""Registered queries against their SQL on the small tables."""

import os
from pathlib import Path

import pytest

import __spark_entry__ as entry
from verification import compare

SMALL = Path("/root/testdata/sf0.001")
# All pairs are compared by ``python -m verification.compare``; the quick ones run with the tests.
QUICK = [
    "sample_manifest", "representative_states", "primary_effects", "upsert_by_scope", "prioritised_group_tables", "shared_specific_features", "run_derangements",
    "segmented_words", "packed_batches", "sentence_basis", "continuous_regressor", "deletion_status", "fold_summary", "tagged_shards",
    "group_bridge", "output_state_manifest",
]


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not SMALL.exists(), reason="given tables are not here")
@pytest.mark.parametrize("name", list(entry.oracle_sql()) if os.environ.get("ALL_QUERIES") else QUICK)
def test_query_equals_sql(spark, name):
    outcome = compare.compare(spark, compare.connect(str(SMALL)), str(SMALL), name)
    assert outcome.startswith("ok") and "TYPES" not in outcome, outcome


@pytest.mark.skipif(not SMALL.exists(), reason="given tables are not here")
def test_entry(spark):
    assert entry.entry(spark).count() == 12
