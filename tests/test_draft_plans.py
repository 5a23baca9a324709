"""Drafts are judged in one pass over their texts."""

from docloom.operators import quality
from docloom.plans import matching

SF = "/root/testdata/sf0.001"


def test_accepting_and_repairing_scan_the_drafts_once(spark):
    facts = matching._facts(spark, SF)
    one = facts._jdf.queryExecution().optimizedPlan().toString().count("AS markdown")
    assert one > 0
    for df in (quality.accept_drafts(facts), matching.repair_feedback(spark, SF)):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("AS markdown") <= one


def test_serious_issues_of_any_row_of_an_attempt_count(spark):
    facts = matching._facts(spark, SF)
    once = {tuple(r) for r in quality.accept_drafts(facts).collect()}
    twice = {tuple(r) for r in quality.accept_drafts(facts.unionByName(facts)).collect()}
    assert {(r[0], r[1], 2 * r[2], *r[3:]) for r in once} == twice
