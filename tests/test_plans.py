"""Plans: pruned scans, no accidental cartesian joins, no Python where built-ins do."""

import re

import pytest
from helpers import SMALL
from quillmill.plans import registry
from quillmill.sources import tables

#: They run a tokenizer, a provider or a model outside the JVM.
PYTHON = {"document_chunks", "generated_texts", "style_classifier", "top_directions"}


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - PYTHON))
def test_plans_stay_in_the_jvm(spark, name):
    text = plan(registry.QUERIES[name](spark, SMALL))
    assert not re.search("Python|Pandas|Arrow", text)
    assert "CartesianProduct" not in text


@pytest.mark.parametrize(("name", "columns"), [("text_scalars", {"doc_id", "text"}), ("word_stats_by_author", {"text", "source"}), ("event_windows", {"ts", "event_type"}), ("projection", {"vec_id", "embedding"})])
def test_scans_read_what_they_need(spark, name, columns):
    text = plan(registry.QUERIES[name](spark, SMALL))
    read = set(re.findall(r"(\w+):", re.findall(r"ReadSchema: struct<(.*?)>\n", text + "\n")[-1].replace("array<", "")))
    assert read == columns


def test_filters_reach_the_scan(spark):
    df = tables.table(spark, SMALL, "documents").where("lang = 'en'").select("doc_id")
    assert "EqualTo(lang,en)" in plan(df)


def test_only_few_files_of_a_small_table_are_dealt_out(spark, tmp_path):
    spark.range(100).repartition(8).write.parquet(str(tmp_path / "many.parquet"))
    assert "Exchange" not in plan(tables.table(spark, str(tmp_path), "many"))
    assert "RoundRobinPartitioning(8)" in plan(tables.table(spark, SMALL, "documents"))
