import os
import time

import pytest
from pyspark.sql import functions as F

from evalsweep.functions.measures import TIMEOUT_TEXT
from evalsweep.plans import cell_jobs

SCHEMA = "experiment string, run_ts string, cell_idx int, sample_idx bigint, prediction string"
RUN = "20240131T000000Z"


@pytest.fixture()
def sweep(spark, tmp_path):
    spark.range(40).selectExpr("id as sample_idx", "concat('p', id) as prompt").repartition(4).write.parquet(f"{tmp_path}/s")
    cells = spark.range(1, 5).selectExpr("'e' as experiment", "cast(id as int) as cell_idx", "concat('m', id) as model_id")
    return spark.read.parquet(f"{tmp_path}/s"), cells, str(tmp_path / "out")


def echo(model_id, options):
    return lambda asked, budgets: [f"{model_id}:{p}" for p in asked]


def stored(spark, path):
    rows = cell_jobs.read_committed(spark, path, SCHEMA).groupBy("cell_idx").agg(
        F.count("*").alias("n"), F.countDistinct("sample_idx").alias("distinct")
    )
    return {r["cell_idx"]: (r["n"], r["distinct"]) for r in rows.collect()}


def test_a_stuck_cell_ends_by_its_limit_and_the_others_go_on(spark, sweep):
    samples, cells, path = sweep

    def factory(model_id, options):
        def engine(asked, budgets):
            if model_id == "m2":
                time.sleep(600)
            return list(asked)

        return engine

    started = time.monotonic()
    log = cell_jobs.run_attempts(samples, cells, factory, path, RUN, limit_s=15, at_once=4)
    assert time.monotonic() - started < 120
    found = {r["cell_idx"]: r for r in cell_jobs.cell_outcomes(log).collect()}
    assert {i: r["status"] for i, r in found.items()} == {1: "ok", 2: "error", 3: "ok", 4: "ok"}
    assert found[2]["error"] == TIMEOUT_TEXT and found[2]["exit_code"] is None and found[2]["payload"] is None
    assert stored(spark, path) == {i: (40, 40) for i in (1, 3, 4)}
    # Called again, only the cell that is missing is asked for.
    again = cell_jobs.run_attempts(samples, cells, echo, path, RUN)
    assert again.count() == 5
    assert {r["cell_idx"]: (r["status"], r["attempt"]) for r in cell_jobs.cell_outcomes(again).collect()} == {
        1: ("ok", 1), 2: ("ok", 2), 3: ("ok", 1), 4: ("ok", 1)
    }
    assert stored(spark, path) == {i: (40, 40) for i in (1, 2, 3, 4)}


def test_cells_do_not_share_their_tags(spark, sweep, monkeypatch):
    samples, cells, path = sweep
    seen, infer = [], cell_jobs.infer_cells

    def watched(*args):
        time.sleep(1)  # so that cells overlap
        seen.append(frozenset(spark.sparkContext.getJobTags()))
        return infer(*args)

    monkeypatch.setattr(cell_jobs, "infer_cells", watched)
    cell_jobs.run_attempts(samples, cells, echo, path, RUN, at_once=4)
    assert len(set(seen)) == 4 and all(len(tags) == 1 for tags in seen)


def test_nothing_of_a_crashed_cell_is_seen(spark, sweep, monkeypatch):
    samples, cells, path = sweep

    def dies_half_way(model_id, options):
        def engine(asked, budgets):
            if model_id == "m3" and "p39" in asked:
                time.sleep(2)  # other tasks of the cell have written by then
                os._exit(9)
            return list(asked)

        return engine

    log = cell_jobs.run_attempts(samples, cells, dies_half_way, path, RUN, at_once=1)
    assert {r["cell_idx"]: r["error"] for r in cell_jobs.cell_outcomes(log).collect()} == {
        1: None, 2: None, 3: "Worker exited with code 1", 4: None
    }
    assert stored(spark, path) == {i: (40, 40) for i in (1, 2, 4)}

    # The driver dies between the answers of a cell and its record.
    real, calls = cell_jobs._record, []

    def fails_second(*args):
        calls.append(args)
        if len(calls) == 2:
            raise KeyboardInterrupt
        real(*args)

    other = "20240201T000000Z"
    monkeypatch.setattr(cell_jobs, "_record", fails_second)
    with pytest.raises(KeyboardInterrupt):
        cell_jobs.run_attempts(samples, cells, echo, path + "2", other, at_once=1)
    monkeypatch.undo()
    before = stored(spark, path + "2")
    assert 2 not in before and before[1] == (40, 40)
    cell_jobs.run_attempts(samples, cells, echo, path + "2", other)
    assert stored(spark, path + "2") == {i: (40, 40) for i in (1, 2, 3, 4)}


def test_an_empty_store_has_no_cells(spark, tmp_path):
    assert cell_jobs.read_log(spark, str(tmp_path / "none")).count() == 0
    assert cell_jobs.read_committed(spark, str(tmp_path / "none"), SCHEMA).count() == 0
