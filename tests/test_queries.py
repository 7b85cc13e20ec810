"""Queries against their reference SQL.  EBBTIDE_ALL=1 runs every query, default a fast subset."""

import os

import pytest

import __spark_entry__ as entry
from tests.conftest import SF
from tests.oracle import compare, connect

FAST = ["external_transfer_alerts", "aum_outflow", "client_reply_rate", "open_complaint",
        "products_closed", "filter_ledger_range", "asof_business_day", "rank_average",
        "equal_freq_bucket", "balanced_books", "churn_labels", "ledger_identity", "auc", "ks_stat",
        "top_k_list", "woe_document_quality", "bh_adjust", "l_moments", "dq_complaints"]
NAMES = sorted(entry.oracle_sql()) if os.environ.get("EBBTIDE_ALL") else FAST


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_reference_sql(spark, con, name):
    assert compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], SF) is None


def test_entry_and_registry(spark):
    frame = entry.entry(spark)
    assert frame.columns[0] == "household_id" and frame.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
