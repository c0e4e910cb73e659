import glob
import os
import time

import pytest
from pyspark.sql import functions as F

from evalsweep.functions.measures import failure_status
from evalsweep.operators.grid import grid_cells
from evalsweep.plans import cell_jobs
from evalsweep.plans import sweep as plan
from evalsweep.plans import views
from evalsweep.plans.sweep import run_sweep


def factory_at(folder):
    def factory(model_id, options):
        def engine(prompts, budgets):
            with open(os.path.join(folder, "asked"), "a") as log:
                log.write("".join(f"{model_id}\n" for _ in prompts))
            if model_id == "bad" and not os.path.exists(os.path.join(folder, "fixed")):
                raise RuntimeError("CUDA out of memory")
            return [{"text": p[-1], "total_s": 0.5, "n_tokens": 2} for p in prompts]

        return engine

    return factory


@pytest.fixture()
def sweep(spark):
    samples = spark.createDataFrame(
        [(i, f"Question {i % 3}", str(i % 2)) for i in range(12)], "sample_idx long, prompt string, reference string"
    )
    spec = spark.createDataFrame(
        [("E 1", [("good", "hf"), ("bad", "hf")], [None, "int4"], [64])],
        "experiment string, models array<struct<id:string,backend:string>>, quantization array<string>, "
        "max_new_tokens array<int>",
    )
    return samples, grid_cells(spec)


def test_sweep_stores_resumes_and_asks_each_prompt_once(spark, sweep, tmp_path):
    samples, grid = sweep
    path, factory = str(tmp_path / "sweep"), factory_at(str(tmp_path))

    def run(ts):
        results = run_sweep(samples, grid, factory, path, ts, judge="heuristic", cells_per_wave=3)
        return {r.cell_idx: r for r in results.collect()}

    first = run("t1")
    assert {c: r.status for c, r in first.items()} == {1: "ok", 2: "ok", 3: "oom", 4: "oom"}
    # Answers are 0, 1, 2, 0, ...; references 0, 1, 0, 1, ...: four in twelve agree.
    assert first[1].exact_match_pct == pytest.approx(100 / 3)
    assert (first[1].n_samples, first[1].mean_tps, first[3].n_samples) == (12, 4.0, None)
    asked = open(tmp_path / "asked").read().count("good\n")
    assert asked == 24

    # Nothing is left to do for this run.
    assert {c: r.status for c, r in run("t1").items()} == {c: r.status for c, r in first.items()}
    assert open(tmp_path / "asked").read().count("good\n") == asked

    # A cell that is taken away is run again, alone, and another run starts from nothing.
    for name in ("results", "predictions"):
        lost = glob.glob(f"{path}/{name}/experiment=*/run_ts=t1/cell_idx=3")[0]
        os.rename(lost, str(tmp_path / f"lost-{name}"))
    open(tmp_path / "fixed", "w").close()
    assert {c: r.status for c, r in run("t1").items()} == {1: "ok", 2: "ok", 3: "ok", 4: "oom"}
    assert open(tmp_path / "asked").read().count("good\n") == asked
    assert {c: r.status for c, r in run("t2").items()} == {c: "ok" for c in (1, 2, 3, 4)}
    runs = spark.read.parquet(f"{path}/results").groupBy("run_ts").count().collect()
    assert sorted(tuple(r) for r in runs) == [("t1", 4), ("t2", 4)]


def test_other_runs_are_not_opened(spark, sweep, tmp_path):
    samples, grid = sweep
    path, factory = str(tmp_path / "sweep"), factory_at(str(tmp_path))
    good = grid.filter("model_id = 'good'").withColumn("experiment", F.lit("a [b]/c*'d %25"))
    run_sweep(samples, good, factory, path, "t1")
    for file in glob.glob(f"{glob.escape(path)}/*/experiment=*/run_ts=t1/cell_idx=*/*.parquet"):
        with open(file, "wb") as damaged:
            damaged.write(b"no parquet")
        os.remove(os.path.join(os.path.dirname(file), f".{os.path.basename(file)}.crc"))
    for _ in range(2):
        results = run_sweep(samples, good, factory, path, "t2").collect()
        assert {(r.experiment, r.run_ts, r.status) for r in results} == {("a [b]/c*'d %25", "t2", "ok")}
    assert len(open(tmp_path / "asked").read().split()) == 48


def test_a_stuck_cell_ends_as_an_error_and_the_sweep_goes_on(spark, sweep, tmp_path):
    samples, grid = sweep
    path = str(tmp_path / "sweep")

    def factory(model_id, options):
        def engine(prompts, budgets):
            if model_id == "bad" and options["quantization"] is None:
                time.sleep(600)
            if model_id == "bad":
                os._exit(3)
            return [p[-1] for p in prompts]

        return engine

    def run(model):
        rows = run_sweep(samples, grid, model, path, "t1", judge="heuristic", limit_s=30, cells_per_wave=4)
        return {r.cell_idx: r for r in rows.collect()}

    found = run(factory)
    assert {c: r.status for c, r in found.items()} == {1: "ok", 2: "ok", 3: "error", 4: "error"}
    assert "timeout" in found[3].error and found[4].error and "timeout" not in found[4].error
    assert (found[1].n_samples, found[3].n_samples) == (12, None)
    log = cell_jobs.cell_outcomes(cell_jobs.read_log(spark, f"{path}/cell-jobs"))
    assert {r.cell_idx: r.status for r in log.collect()} == {c: r.status for c, r in found.items()}
    # Committed answers are used again, whatever else was lost; cells without any are tried once more.
    for name in ("results", "predictions"):
        os.rename(glob.glob(f"{path}/{name}/experiment=*/run_ts=t1")[0], str(tmp_path / f"lost-{name}"))
    again = run(lambda model_id, options: lambda prompts, budgets: ["later" for _ in prompts])
    assert {c: r.status for c, r in again.items()} == dict.fromkeys((1, 2, 3, 4), "ok")
    assert again[1].exact_match_pct == found[1].exact_match_pct > again[3].exact_match_pct


def test_stored_predictions_keep_what_did_not_fail(spark, sweep, tmp_path):
    samples, grid = sweep
    path = str(tmp_path / "sweep")
    run_sweep(samples, grid, factory_at(str(tmp_path)), path, "t1")
    stored = spark.read.parquet(f"{path}/predictions")
    assert stored.count() == 48
    status = failure_status(F.col("error_type"), F.col("error"))
    assert stored.filter(status == "oom").count() == 24


def test_stored_answers_outlive_a_failure_in_scoring(spark, sweep, tmp_path, monkeypatch):
    samples, grid = sweep
    path, factory = str(tmp_path / "sweep"), factory_at(str(tmp_path))
    open(tmp_path / "fixed", "w").close()

    def broken(*args, **options):
        raise KeyError("scoring broke")

    with monkeypatch.context() as patch:
        patch.setattr(plan, "score_rows", broken)
        with pytest.raises(KeyError):
            run_sweep(samples, grid, factory, path, "t1")
    asked = len(open(tmp_path / "asked").read().split())
    assert asked == 48
    results = run_sweep(samples, grid, factory, path, "t1").collect()
    assert {r.status for r in results} == {"ok"} and len(results) == 4
    assert len(open(tmp_path / "asked").read().split()) == asked


def test_names_that_look_like_numbers_stay_texts(spark, sweep, tmp_path):
    samples, grid = sweep
    path = str(tmp_path / "sweep")
    named = grid.filter("model_id = 'good'").withColumn("experiment", F.lit("007"))
    for _ in range(2):
        results = run_sweep(samples, named, factory_at(str(tmp_path)), path, "20240131")
        assert {(r.experiment, r.run_ts) for r in results.collect()} == {("007", "20240131")}
    assert len(open(tmp_path / "asked").read().split()) == 24


def test_answers_that_do_not_pair_fail_the_sweep(spark, sweep, tmp_path):
    samples, grid = sweep
    path, factory = str(tmp_path / "sweep"), factory_at(str(tmp_path))
    run_sweep(samples, grid, factory, path, "t1")
    lost = glob.glob(f"{path}/results/experiment=*/run_ts=t1/cell_idx=1")[0]
    os.rename(lost, str(tmp_path / "lost"))
    more = samples.unionByName(samples.limit(1).withColumn("sample_idx", F.lit(99)))
    with pytest.raises(Exception, match="sample without a prediction"):
        run_sweep(more, grid, factory, path, "t1")


def test_waves_are_bounded_by_cells(spark):
    cells = [(f"e{e}", c) for e in range(7) for c in range(1, 4)] + [("e0", 4), ("e0", 5)]
    rows = spark.createDataFrame([(e, c, int(e[1:]) + 1) for e, c in cells], "experiment string, cell_idx int, _place int")
    found = [[tuple(r)[:2] for r in rows.filter(wave).collect()] for wave in plan._waves(rows, 3)]
    assert max(map(len, found)) <= 3
    assert sorted(cell for wave in found for cell in wave) == sorted(cells)


def judge_factory(model_id, options):
    return lambda prompts, budgets: ['{"score": 0.5, "label": "partial"}' for _ in prompts]


def test_a_model_judges_and_its_replies_are_stored(spark, sweep, tmp_path):
    samples, grid = sweep
    open(tmp_path / "fixed", "w").close()
    path = str(tmp_path / "sweep")
    results = run_sweep(samples, grid, factory_at(str(tmp_path)), path, "t1", judge=judge_factory).collect()
    assert {r.judge_avg_score for r in results} == {0.5}
    assert spark.read.parquet(f"{path}/judgements").count() == 48
    assert {r.judge_label for r in spark.read.parquet(f"{path}/scores").collect()} == {"partial"}


def test_forms_of_one_file_of_parts_are_made_by_all_cores(spark, sf_dir, tmp_path):
    """The table of parts is one split: a sweep over it must not start from a single task."""
    samples = views.samples_mc(spark, sf_dir)
    grid = views.grid(spark).limit(1)
    run_sweep(samples, grid, factory_at(str(tmp_path)), str(tmp_path / "sweep"), "t1", judge=judge_factory)
    assert len(glob.glob(f"{tmp_path}/sweep/references/t1/*.parquet")) >= spark.sparkContext.defaultParallelism
    assert spark.read.parquet(f"{tmp_path}/sweep/judgements").count() == samples.count()
