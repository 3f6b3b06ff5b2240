"""Every registered query of the evidence engine builds an analysed plan with distinct columns over the smallest tables."""

import pytest

from factloom.plans import catalogue

SMALLEST = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_builds(spark, name):
    made = catalogue.QUERIES[name](spark, SMALLEST)
    assert len(set(made.columns)) == len(made.columns) and made.isStreaming is False


def test_sql_names_a_query():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES)


def test_facts_are_read_from_files(spark):
    """The extraction plan makes candidates and facts once: what follows scans what was written."""
    plan = catalogue.QUERIES["extraction_pipeline"](spark, SMALLEST)._jdf.queryExecution().optimizedPlan().toString()
    assert "lineitem" not in plan and "Generate" not in plan.split("Relation")[-1]
