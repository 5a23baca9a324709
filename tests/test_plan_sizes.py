"""The driver holds every plan of a query, so none may grow with the steps before it."""

import re

import pytest

from docloom import session
from docloom.plans import matching

SF = "/root/testdata/sf0.001"


def _exchanges(df):
    return len(re.findall("Exchange", df._jdf.queryExecution().executedPlan().toString()))


@pytest.mark.parametrize("name", ["match_source_paths", "outline_issues", "build_nav", "normalize_outline", "fill_outline"])
def test_no_plan_of_a_matching_query_is_large(spark, monkeypatch, name):
    sizes, stored = [], session.materialized

    def counted(df, table):
        sizes.append(_exchanges(df))
        return stored(df, table)

    monkeypatch.setattr(session, "materialized", counted)
    sizes.append(_exchanges(getattr(matching, name)(spark, SF)))
    assert max(sizes) <= 16
