"""Plan properties of the registered queries (static plan: AQE and size-based broadcast off)."""

import re

import pytest

import __spark_entry__ as E
from conftest import SF0001

SKIP = {"stream_latest_kv", "stream_register", "stream_extract", "ingest_run"}  # run a stream or an ingestion when called


@pytest.fixture(scope="module")
def plans(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        out = {n: f(spark, SF0001)._jdf.queryExecution().executedPlan().toString()
               for n, f in E.queries().items() if n not in SKIP}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    return out


def _shuffles(plan: str) -> int:
    return len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|RoundRobin|SinglePartition)", plan))


def test_no_nested_loop_or_cartesian_join(plans):
    bad = [n for n, p in plans.items() if "BroadcastNestedLoopJoin" in p or "CartesianProduct" in p]
    assert not bad


def test_row_local_operators_do_not_shuffle(plans):
    for n in ["route_by_extension", "parse_documents", "raw_text_documents", "explode_elements", "concat_text",
              "parse_html", "item_text", "speaker_label", "history_view", "contract_details", "path_parts"]:
        assert _shuffles(plans[n]) == 0, n


def test_python_only_where_a_model_runs(plans):
    """... or a parser of bytes."""
    py = {n for n, p in plans.items() if re.search(r"MapInPandas|ArrowEvalPython|BatchEvalPython", p)}
    assert py == {"infer_text", "summarize_documents", "parse_binary"}


def test_no_explicit_broadcast(plans):
    """Broadcasts are left to the measured size of a side."""
    assert {n for n, p in plans.items() if "BroadcastExchange" in p} == set()


def test_signal_rows_are_reduced_in_place(plans):
    """S1 and S3 read each sample once inside its row: one exchange (the spread of the input), no grouping."""
    for n in ["downsample_mean", "downsample_peak", "normalize_signals", "band_peak_music", "band_peak_voice"]:
        assert _shuffles(plans[n]) == 1 and "Aggregate" not in plans[n], n


def test_one_parse_feeds_every_outcome(plans):
    for n in ["union_outcomes", "coverage_report"]:
        assert plans[n].count("parseJson(") == 1, n


def test_expiring_contracts_pushes_a_range(plans):
    pushed = re.search(r"PushedFilters: \[(.*?)\]", plans["expiring_contracts"]).group(1)
    assert "GreaterThanOrEqual(data_fim_vigencia" in pushed and "LessThanOrEqual(data_fim_vigencia" in pushed


def test_a_far_page_reads_one_range(plans):
    assert re.search(r"PartitionFilters: \[[^\]]*_range#\d+ = ", plans["page_by_range"])
