import os
import sys
import uuid

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evalsweep.functions.measures import failure_status
from evalsweep.operators import infer


def rows_of(spark, cells=(1, 2), samples=40):
    return spark.createDataFrame(
        [(c, s, f"prompt {s}" + (" Options:" if s % 2 else ""), f"m{c}", None if c == 1 else "int4", 99)
         for c in cells for s in range(samples)],
        "cell_idx int, sample_idx long, prompt string, model_id string, quantization string, max_new_tokens int",
    )


def echo_factory(model_id, options):
    def engine(prompts, budgets):
        return [
            {"text": f" {model_id}|{options['quantization']}|{p}|{b} ", "total_s": 1.0, "n_tokens": 0}
            for p, b in zip(prompts, budgets)
        ]

    return engine


@pytest.mark.parametrize("gather", [True, False])
def test_answers_carry_model_options_and_budget(spark, gather):
    answers = infer.batch_infer(rows_of(spark), echo_factory, tasks=3, batch_size=7, gather=gather).collect()
    assert len(answers) == 80
    for row in answers:
        s, choice = row.sample_idx, row.sample_idx % 2
        quantization = None if row.cell_idx == 1 else "int4"
        prompt = f"prompt {s}" + (" Options:" if choice else "")
        assert row.prediction == f"m{row.cell_idx}|{quantization}|{prompt}|{10 if choice else 99}"
        assert row.n_tokens == len(row.prediction.split())
        assert (row.total_s, row.ttft_s, row.error) == (1.0, None, None)


def failing_factory(model_id, options):
    def engine(prompts, budgets):
        if any(p.startswith("prompt 3") for p in prompts):
            raise RuntimeError("CUDA out of memory")
        if "prompt 5 Options:" in prompts:
            raise KeyError("five")
        return prompts

    return engine


def test_only_the_failing_prompts_fail(spark):
    answers = infer.batch_infer(rows_of(spark), failing_factory, tasks=2, batch_size=16).collect()
    failed = {(r.cell_idx, r.sample_idx): r for r in answers if r.error_type}
    threes = {3, *range(30, 40)}
    assert set(failed) == {(c, s) for c in (1, 2) for s in threes | {5}}
    assert failed[1, 3].error == "CUDA out of memory" and failed[1, 3].prediction is None
    assert failed[1, 5].error_type == "KeyError" and "Traceback" in failed[1, 5].error
    assert all(r.prediction and r.total_s >= 0 for r in answers if not r.error_type)


def broken_factory(model_id, options):
    if model_id == "m2":
        raise RuntimeError("no such model")
    return lambda prompts, budgets: prompts


def test_a_model_that_does_not_load_fails_its_cell(spark):
    answers = infer.batch_infer(rows_of(spark), broken_factory, tasks=4).collect()
    assert {(r.cell_idx, r.error) for r in answers} == {(1, None), (2, "no such model")}


def counting_factory(folder):
    class Engine:
        def __init__(self, model_id):
            self.note("load", model_id)
            self.model_id = model_id

        def note(self, what, model_id):
            with open(f"{folder}/{what}", "a") as log:
                log.write(f"{model_id} {os.getpid()}\n")

        def __call__(self, prompts, budgets):
            return prompts

        def close(self):
            self.note("close", self.model_id)

    return lambda model_id, options: Engine(model_id)


def test_a_task_loads_a_model_once_per_cell(spark, tmp_path):
    rows = rows_of(spark, cells=range(1, 7), samples=200)
    answers = infer.batch_infer(rows, counting_factory(str(tmp_path)), tasks=3, batch_size=5, gather=True)
    assert answers.count() == 1200
    loads = open(tmp_path / "load").read().split("\n")[:-1]
    # Three tasks over six cells of equal size: each model loads once, or twice at a cut.
    assert 6 <= len(loads) <= 8
    assert sorted(loads) == sorted(open(tmp_path / "close").read().split("\n")[:-1])


def test_a_large_cell_is_cut_over_all_tasks(spark):
    rows = rows_of(spark, cells=[1], samples=4000)
    answers = infer.batch_infer(rows, echo_factory, tasks=8, gather=True)
    sizes = [r["count"] for r in answers.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1000


@pytest.mark.parametrize("answer", [["only one"], []])
def test_wrong_number_of_answers_is_a_failure(spark, answer):
    got = infer.batch_infer(rows_of(spark), lambda m, o: lambda p, b: answer, tasks=1, batch_size=4).collect()
    # A single prompt with a single answer is fine, so retrying alone can succeed.
    assert {r.prediction for r in got} == {answer[0] if answer else None}


def settings_factory(model_id, options):
    if options["temperature"] > 1:
        raise ValueError("too hot")
    return lambda prompts, budgets: [f"{model_id} {options['backend']} {options['temperature']}" for _ in prompts]


def test_one_scan_per_cell_moves_nothing_and_passes_all_settings(spark, capsys):
    samples = spark.createDataFrame([(i, f"p{i}") for i in range(20)], "sample_idx long, prompt string")
    cells = spark.createDataFrame(
        [(1, "m", "vllm", 0.0), (2, "m", "api", 0.5), (3, "m", "api", 2.0)],
        "cell_idx int, model_id string, backend string, temperature double",
    )
    answers = infer.infer_cells(samples, cells, settings_factory)
    answers.explain()
    assert "Exchange" not in capsys.readouterr().out
    found = {(r.cell_idx, r.prediction, r.error_type) for r in answers.collect()}
    assert found == {(1, "m vllm 0.0", None), (2, "m api 0.5", None), (3, None, "ValueError")}
    assert answers.count() == 60
    assert infer.infer_cells(samples, cells.limit(0), settings_factory).count() == 0


def stuck_factory(model_id, options):
    class Engine:
        def __call__(self, prompts, budgets):
            return prompts

        def close(self):
            if model_id == "m1":
                raise OSError("stuck")

    return Engine()


def test_an_engine_that_does_not_close_fails_its_own_cell_only(spark):
    answers = infer.batch_infer(rows_of(spark), stuck_factory, batch_size=16).collect()
    assert len(answers) == 80
    assert {r.cell_idx for r in answers if r.error_type == "OSError"} == {1}
    assert all(r.error is None for r in answers if r.cell_idx == 2)


def subclass_factory(model_id, options):
    class AcceleratorError(RuntimeError):
        pass

    def engine(prompts, budgets):
        raise AcceleratorError("device out of memory") if model_id == "m1" else OSError("disk out of memory")

    return engine


def test_kinds_of_runtime_errors_count_as_such(spark):
    answers = infer.batch_infer(rows_of(spark, samples=4), subclass_factory)
    status = failure_status(F.col("error_type"), F.col("error"), F.col("error_is_runtime"))
    found = {tuple(r) for r in answers.select("cell_idx", "error_type", status).collect()}
    assert found == {(1, "AcceleratorError", "oom"), (2, "OSError", "error")}


def loads_of(folder):
    """Loads by worker process: the stand-in leaves a file for each."""
    counted = {}
    for name in os.listdir(folder):
        counted.setdefault(name.split("-")[0], []).append(name.split("-")[1])
    return counted


@pytest.mark.parametrize("keep", [0, 1, 2])
def test_kept_engines_are_loaded_once_per_worker(spark, tmp_path, keep):
    folder = str(tmp_path)

    def factory(model_id, options):
        open(f"{folder}/{os.getpid()}-{model_id}-{uuid.uuid4().hex}", "w").close()
        return lambda asked, budgets: [f"{model_id}{options['level']}" for _ in asked]

    spark.range(200).selectExpr("id as sample_idx", "'p' as prompt").repartition(50).write.parquet(f"{folder}-s")
    samples = spark.read.option("maxPartitionBytes", 1).parquet(f"{folder}-s")
    cells = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "cell_idx int, model_id string, level int")
    with_splits = samples.repartition(50)
    found = infer.infer_cells(with_splits, cells, factory, keep_engines=keep)
    assert found.rdd.getNumPartitions() == 100
    rows = found.groupBy("cell_idx", "prediction").count().collect()
    assert sorted(map(tuple, rows)) == [(1, "a5", 200), (2, "b6", 200)]
    loads = loads_of(folder)
    if keep == 0:
        assert sum(map(len, loads.values())) >= 100
    else:
        assert max(map(len, loads.values())) <= 2


def test_engines_give_way_and_are_closed(monkeypatch):
    monkeypatch.delitem(sys.modules, infer._KEPT, raising=False)
    closed = []

    class Engine:
        def __init__(self, name):
            self.name = name

        def close(self):
            closed.append(self.name)
            raise RuntimeError("closing is not what counts here")

    def get(name, token="t", most=2):
        return infer._kept_engine(lambda model_id, options: Engine((model_id, options["x"])), token, {"model_id": name, "x": 1}, most)

    a = get("a")
    assert get("a") is a and get("b") is not a and get("a") is a
    get("c")  # b was used least recently
    assert closed == [("b", 1)] and get("a") is a
    assert get("a", token="other") is not a and closed == [("b", 1), ("c", 1)]
    monkeypatch.delitem(sys.modules, infer._KEPT)


def test_one_model_for_all_rows_needs_no_order(spark, capsys):
    rows = spark.range(40).selectExpr("cast(id % 3 as int) as cell_idx", "id as sample_idx", "concat('p', id) as prompt")

    def plan(df):
        df.explain()
        return capsys.readouterr().out

    def factory(model_id, options):
        return lambda prompts, budgets: [p.upper() for p in prompts]

    judged = infer.batch_infer(rows, factory, load_on=())
    assert "Sort" not in plan(judged) and "Sort" in plan(infer.batch_infer(rows, factory))
    assert {(r.sample_idx, r.prediction) for r in judged.collect()} == {(i, f"P{i}") for i in range(40)}


def test_answers_go_back_many_together():
    steps = [pa.RecordBatch.from_pydict({"i": range(64 * k, 64 * (k + 1))}) for k in range(200)]
    found = list(infer._together(iter(steps)))
    assert len(found) <= 4 and [i for batch in found for i in batch.column("i").to_pylist()] == list(range(12800))
    assert list(infer._together(iter(()))) == []
