"""The shapes of the text operators' plans."""

import re

import pytest

from tidemark.llm import queries

SF = "/root/testdata/sf0.001"
PYTHON = re.compile(r"Python|Pandas|Arrow|BatchEval")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["op7_fingerprints", "op10_url_filters"])
def test_native_operators_run_no_python(spark, name):
    assert not PYTHON.search(plan(queries.QUERIES[name](spark, SF)))


@pytest.mark.parametrize("name", ["op1_quality", "op2_bpe", "op4_decontamination", "op5_html_text", "op6_pii", "op9_lm_score"])
def test_scans_of_texts_shuffle_nothing(spark, name):
    assert "Exchange" not in plan(queries.QUERIES[name](spark, SF))


@pytest.mark.parametrize("name, columns", [("op2_bpe", {"doc_id", "text"}), ("op4_decontamination", {"doc_id", "text"}), ("op10_url_filters", {"page_id", "url"})])
def test_scans_read_only_their_columns(spark, name, columns):
    read = {c.split(":")[0] for schema in re.findall(r"ReadSchema: struct<([^>]*)>", plan(queries.QUERIES[name](spark, SF))) for c in schema.split(",")}
    assert read <= columns


def test_url_rules_come_without_python_rows(spark):
    text = queries.QUERIES["op10_url_filters"](spark, SF)._jdf.queryExecution().toString()
    assert "ExistingRDD" not in text and "LogicalRDD" not in text


def test_url_scan_skips_the_pages_text(spark):
    assert "html" not in plan(queries.QUERIES["op10_url_filters"](spark, SF))
