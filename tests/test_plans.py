"""The physical plans that the design relies on."""

import re

import pytest

from evalsweep.operators import grid, rollup, telemetry
from evalsweep.operators.sizing import spread
from evalsweep.plans import queries, views
from evalsweep.sources import store


@pytest.fixture()
def plan(spark, capsys):
    def shown(df):
        capsys.readouterr()
        df.explain()
        return capsys.readouterr().out

    return shown


NARROW = (
    "normalize_text extract_choice strip build_prompt format_options resolve_question resolve_answer "
    "is_multiple_choice token_budget score_documents judge_prompt parse_judge_reply permutations grid_cells "
    "check_allowed check_ranges check_required_if check_unknown_columns telemetry_units attempt_outcome "
    "fill_defaults cell_samples"
).split()


@pytest.mark.parametrize("name", NARROW)
def test_narrow_queries_neither_shuffle_nor_leave_the_jvm(spark, sf_dir, plan, name):
    text = plan(queries.QUERIES[name](spark, sf_dir))
    # Small single-split inputs are dealt out to the cores first; nothing else moves.
    assert "Exchange" not in text.replace("Exchange RoundRobinPartitioning", "")
    assert "Python" not in text and "ArrowEval" not in text


@pytest.mark.parametrize("name", ["score_samples", "cell_accuracy", "cell_results", "sweep_summary"])
def test_scoring_runs_without_python(spark, sf_dir, plan, name):
    text = plan(queries.QUERIES[name](spark, sf_dir))
    assert "Python" not in text and "ArrowEval" not in text


@pytest.mark.parametrize("name", ["cell_accuracy", "cell_results", "cell_telemetry", "sweep_summary"])
def test_rollups_hash_aggregate(spark, sf_dir, plan, name):
    text = plan(queries.QUERIES[name](spark, sf_dir))
    assert "HashAggregate" in text and "SortAggregate" not in text


def test_no_query_uses_a_cross_product(spark, sf_dir, plan):
    for name in ("cell_samples", "align_outputs", "alignment_report", "attribute_telemetry", "score_samples"):
        text = plan(queries.QUERIES[name](spark, sf_dir))
        assert "Cartesian" not in text and "NestedLoop" not in text


def test_scoring_moves_predictions_and_samples_once_and_no_prompts(spark, sf_dir, plan):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scores = views.scores_mc(spark, sf_dir).select("cell_idx", "sample_idx", "exact_match")
        text = plan(scores)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(re.findall(r"Exchange hashpartitioning\(sample_idx", text)) == 2
    assert not re.search(r"AS prompt#", text)


def test_large_sides_are_not_broadcast(spark, plan):
    samples = spark.range(1000).withColumnRenamed("id", "sample_idx")
    cells = spark.range(100).selectExpr("cast(id as int) as cell_idx")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sliced = grid.cell_samples(samples, cells, broadcast_rows=10)
        text = plan(sliced)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Each slice of the grid is carried to samples that stay where they are.
    assert "Join" not in text and "hashpartitioning" not in text
    assert sliced.distinct().count() == 100_000


def test_large_linked_sides_meet_in_a_salted_join(spark, plan):
    samples = spark.range(1000).selectExpr("id as sample_idx", "1 as k")
    cells = spark.range(100).selectExpr("cast(id as int) as cell_idx", "1 as k")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = grid.cell_samples(samples, cells, ["k"], broadcast_rows=10)
        text = plan(joined)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastExchange" not in text and "_salt" in text
    assert joined.count() == 100_000


def test_hot_bucket_is_spread_over_salts(spark, sf_dir, plan):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        events = views.table(spark, sf_dir, "events").select("event_id", "ts")
        windows = views.cell_windows(spark, sf_dir)
        text = plan(telemetry.attribute_telemetry(events, windows, broadcast_rows=0))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert re.search(r"SortMergeJoin \[_width#\d+, _bucket#\d+L, _salt#\d+\]", text)


def test_status_filter_and_columns_reach_the_scan(spark, sf_dir, plan, tmp_path):
    path = str(tmp_path / "results")
    rollup.cell_results(views.grid(spark), views.scores_mc(spark, sf_dir)).write.parquet(path)
    text = plan(rollup.ok_cells(spark.read.parquet(path)).select("cell_idx", "mean_tps"))
    assert "PushedFilters: [IsNotNull(status), EqualTo(status,ok)]" in text
    assert "ReadSchema: struct<cell_idx:int,status:string,mean_tps:double>" in text


def test_cells_are_pruned_by_partition(spark, sf_dir, plan, tmp_path):
    path = str(tmp_path / "cells")
    rows = views.predictions_mc(spark, sf_dir).selectExpr("'E' experiment", "'t' run_ts", "*")
    store.write_cells(rows, path)
    text = plan(store.read_cells(spark, path).filter("cell_idx = 3"))
    assert re.search(r"PartitionFilters: \[isnotnull\(cell_idx#\d+\), \(cell_idx#\d+ = 3\)\]", text)


def test_split_filter_is_pushed(spark, sf_dir, plan):
    text = plan(queries.QUERIES["scan_dataset"](spark, sf_dir))
    assert "EqualTo(lang,en)" in text


def test_head_sample_is_a_filter_where_the_rows_lie(spark, sf_dir, plan):
    shown = plan(queries.QUERIES["head_sample"](spark, sf_dir))
    assert "Exchange" not in shown and "Join" not in shown


def test_only_tables_in_too_few_splits_are_spread(spark, plan):
    cores = spark.sparkContext.defaultParallelism
    assert "RoundRobin" in plan(spread(spark.range(0, 100, 1, cores - 1)))
    assert "RoundRobin" not in plan(spread(spark.range(0, 100, 1, cores)))


def test_inference_moves_no_prompt(spark, sf_dir, plan):
    assert "Exchange" not in plan(queries.QUERIES["batch_infer"](spark, sf_dir))
