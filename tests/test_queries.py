"""Registered queries against their SQL twins. ``DUEPATH_ALL=1`` runs every one."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from check import compare, connect  # noqa: E402

SAMPLE = """feature_matrix bureau_matrix payload_matrix s08_payload_transactions s10_transaction_dedup s13_score_history p09_payee_text p15_missing_flags p21_name_spellings
c01_bureau_payments c07_seeded_mandates c15_missed_cycles c18_delinquency_profile c21_cycles_as_transactions j01_assembled_features
j06_claim_verification j07_identity_verification a06_coverage_gini a10_archetypes w02_average_rank w03_three_way_split m03_gini_stability
m08_drift m10_rank_correlation k02_binned_isotonic k06_predicted_rate k06_reloaded_rate k20_pooled_evidence t05_permuted_column x05_rate_limit j06_claims_by_name c06_recurring_streams j09_block_for_pd k11_calibration_error k19_block_intervals k19_row_intervals m06_univariate_gini_all u01_delong u02_block_bootstrap
t03_monotone_audit g03_canonical_json g06_merkle_proofs g13_issuers_over_time x03_accepted_submissions x04_daily_usage""".split()
NAMES = sorted(entry.oracle_sql()) if os.environ.get("DUEPATH_ALL") else SAMPLE


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, sf, name):
    got = entry.queries()[name](spark, sf).toPandas()
    assert compare(got, con.sql(entry.oracle_sql()[name]).df()).startswith("ok")


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and len(df.columns) == 84


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
