"""A spread of registered queries against DuckDB at the smallest scale.

`python -m pytest tests -m twins` checks all the others; `python tests/compare.py <folder>` checks all of them at any scale.
"""

from __future__ import annotations

import pytest

from tests.compare import check, duck
from binding import catalog
from binding.registry import REGISTRY

FOLDER = "/root/testdata/sf0.001"
CHECKED = ["usable_facts", "ttm_statements", "latest_two_facts", "target_weights", "feature_rows", "security_seeds", "source_documents",
           "resolved_observations", "filings_by_group", "audit_references", "replay_compare", "tail_events", "scaled_numbers"]


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, con, name):
    status, n, m, diff, _ = check(spark, con, name, FOLDER)
    assert status == "ok", diff
    assert n > 0


@pytest.mark.twins
@pytest.mark.parametrize("name", [n for n in catalog.NAMES if n not in CHECKED])
def test_every_other_query_equals_sql(spark, con, name):
    status, _, _, diff, _ = check(spark, con, name, FOLDER)
    assert status == "ok", diff


def test_every_query_has_a_twin():
    assert all(REGISTRY[n].sql for n in catalog.NAMES)
