import check
import pytest

import __spark_entry__ as contract
from parley.plans.catalog import QUERIES
from parley.plans.oracle import ORACLE
from parley.sources import readers
from parley.sources.files import Store


@pytest.fixture(scope="module")
def database(tables):
    return check.connect(tables)


def test_every_query_has_check_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_check_sql(spark, database, tables, name):
    assert check.compare(spark, database, tables, name) == ""


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() == 1


def physical(spark, tables, name):
    text = contract.queries()[name](spark, tables)._jdf.queryExecution().toString()
    return text[text.index("== Physical Plan ==") :]


PYTHON_QUERIES = {
    "repetition_scores", "rule_repetitive", "document_repetition", "document_issues", "quality_by_source",
    "issues", "filter_valid", "issue_summary", "issue_display", "problematic_examples",
    "recommendations", "training_gate", "extracted_json", "resolve_request", "token_rows", "batch_generate",
    "feed_records", "predictions_csv", "predictions_csv_targets", "report_prompt", "jsonl_from_offset", "jsonl_count_and_load",
    "feed_line_kinds", "custom_rule", "predictions_json", "feedback_append", "jsonl_round_trip",
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_python_only_where_needed_and_once(spark, tables, name):
    plan = physical(spark, tables, name)
    assert plan.count("ArrowEvalPython") == (1 if name in PYTHON_QUERIES else 0)
    assert "BatchEvalPython" not in plan and "CartesianProduct" not in plan
    assert "NestedLoopJoin" not in plan


@pytest.mark.parametrize(
    "name,columns",
    [("document_source", {"doc_id", "lang", "source"}), ("dataset_size", {"conv_id", "turn", "role"}),
     ("page_source", {"page_id", "url"}), ("prompt_text", {"doc_id", "text"})],
)
def test_scans_read_only_needed_columns(spark, tables, name, columns):
    frame = contract.queries()[name](spark, tables)
    scans = [line for line in frame._jdf.queryExecution().toString().splitlines() if "ReadSchema" in line]
    read = {part.split(":")[0] for line in scans for part in line.split("struct<")[1].split(">")[0].split(",")}
    assert read <= columns


def test_json_arrays_of_a_long_conversation(spark, tmp_path, monkeypatch):
    turns = spark.range(3000).selectExpr(
        "7L conv_id", "id turn", "if(id % 2 = 0, 'user', 'assistant') role", "concat('text ', id) text"
    )
    turns.write.parquet(f"{tmp_path}/conversations.parquet")
    read, folders = readers.read_json, []
    monkeypatch.setattr(readers, "read_json", lambda spark, path, *rest: (folders.append(path), read(spark, path, *rest))[1])
    frame = contract.queries()["json_array_round_trip"](spark, str(tmp_path))
    assert frame.count() == 1500
    names = Store(spark, folders[0]).names()
    assert len([name for name in names if name.startswith("part-")]) == 12
