"""Queries against their SQL on the small tables (check_oracle.py runs all of them)."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from formulake.plans.compare import connect, differences

CHECKED = [
    "clean_outcome", "ratio_features", "ratio_reduce", "validate_report", "screen_new_rows",
    "canonical_names", "duplicate_report", "icc1", "fe_slope", "spearman_within",
    "wilcoxon_signed_rank", "within_study_pairs", "anchor_quantile", "shrunk_offset",
    "optimize_grid", "whatif_batch", "candidate_rank", "pair_grade", "gate_claims", "harvest_job",
    "merge_spans", "group_folds", "within_study_permutation", "fold_safe_prep",
]


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, sf_dir, name):
    assert differences(queries()[name](spark, sf_dir), connect(sf_dir), oracle_sql()[name]) == []


def test_entry_runs(spark):
    assert entry(spark).count() == 3


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())
