"""How often a query's plan reads the texts."""

import re

import pytest

from strata.plans.queries import QUERIES


@pytest.mark.parametrize("name", ["attach_issue_counts", "fix_prompts", "run_engines", "health_score", "dedupe_findings"])
def test_texts_are_read_once(spark, name):
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    df.collect()
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = df._jdf.queryExecution().explainString(mode)
    schemas = re.findall(r"Location: .*?documents\.parquet\]\n(?:.*\n)*?ReadSchema: (.*)", plan)
    assert sum("text" in s for s in schemas) == 1


def test_numbered_issues_read_no_text_again(spark):
    """Positions are landed, so what is returned reads the landed rows only."""
    plan = QUERIES["search_issues"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in plan
