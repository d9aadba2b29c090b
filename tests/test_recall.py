"""Recall of the registered approximate searches, with their own settings and queries."""

import pytest

from vellumine.workload import load


@pytest.mark.parametrize("name", ["ivf_recall", "pq_recall", "lsh_recall"])
def test_registered_recall(spark, name):
    row = load()[0][name](spark, "/root/testdata/sf0.1").first()
    assert row["queries"] == 40 and row["wanted"] == 400 and row["recall"] >= 0.9
