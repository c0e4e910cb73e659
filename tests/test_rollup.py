import statistics

import pytest
from pyspark.sql import functions as F

from evalsweep.operators import inspect, rollup, telemetry

SCORES = (
    "cell_idx int, sample_idx long, exact_match boolean, normalized_match boolean, judge_score double, "
    "ttft_s double, total_s double, n_tokens int, error_type string, error string"
)
ROWS = [
    (1, 0, True, True, 1.0, None, 0.0, 5, None, None),
    (1, 1, False, True, 0.5, 0.2, 2.0, 5, None, None),
    (2, 9, False, False, 0.0, None, 1.0, 1, "ValueError", "late"),
    (2, 4, False, False, 0.0, None, 1.0, 1, "RuntimeError", "CUDA out of memory"),
    (2, 1, True, True, 0.0, None, 1.0, 1, None, None),
    (3, 2, True, True, 0.0, None, 1.0, 1, "ValueError", "out of memory"),
    (4, 0, True, True, None, None, 4.0, 8, None, None),
]


@pytest.fixture(scope="module")
def tables(spark):
    grid = spark.createDataFrame(
        [(c, "m", "hf", None, False, True, 128) for c in range(1, 6)],
        "cell_idx int, model_id string, backend string, quantization string, kv_cache boolean, "
        "prefix_cache boolean, max_new_tokens int",
    )
    return grid, spark.createDataFrame(ROWS, SCORES)


def by_cell(df):
    return {r.cell_idx: r for r in df.collect()}


def test_accuracy_counts_empty_cells(tables):
    found = by_cell(rollup.cell_accuracy(*tables))
    assert tuple(found[1])[1:] == (2, 1, 2, 50.0, 100.0)
    assert tuple(found[5])[1:] == (0, 0, 0, 0.0, 0.0)


def test_perf_means(tables):
    found = by_cell(rollup.cell_perf(*tables))
    assert tuple(found[1])[1:] == (2, 0.2, 1.25, 1.0)
    assert tuple(found[5])[1:] == (0, None, 0.0, 0.0)
    assert found[4].mean_ttft_s is None


def test_one_failure_fails_the_cell_with_the_first_error(tables):
    found = by_cell(rollup.cell_results(*tables))
    assert [found[c].status for c in range(1, 6)] == ["ok", "oom", "error", "ok", "ok"]
    assert found[2].error == "CUDA out of memory" and found[2].exact_match_pct is None
    assert found[3].error == "out of memory" and found[3].n_samples is None
    assert found[1].judge_avg_score == 0.75 and found[4].judge_avg_score == 0.0
    assert found[5].n_samples == 0 and found[5].mean_tps == 0.0


def test_a_cell_has_one_row_however_often_a_failure_is_stored(spark, tables):
    grid, scores = tables
    broken = [(5, i, None, None, None, None, None, None, "OSError", "no such model") for i in range(50)]
    kinds = {"oom": ("AcceleratorError", "out of memory", True), "error": ("OSError", "disk out of memory", False)}
    more = scores.unionByName(spark.createDataFrame(ROWS[3:4] * 3 + broken, SCORES))
    found = rollup.cell_results(grid, more).collect()
    assert sorted(r.cell_idx for r in found) == [1, 2, 3, 4, 5]
    assert by_cell(rollup.cell_results(grid, more))[5].error == "no such model"
    for status, (kind, text, runtime) in kinds.items():
        rows = scores.filter("cell_idx = 3").withColumns(
            {"error_type": F.lit(kind), "error": F.lit(text), "error_is_runtime": F.lit(runtime)}
        )
        assert by_cell(rollup.cell_results(grid, rows))[3].status == status


def test_errors_may_come_from_the_predictions(spark, tables, capsys):
    grid, scores = tables
    kept = [name for name in scores.columns if name not in ("exact_match", "normalized_match", "judge_score")]
    predictions = scores.select(*kept)
    assert by_cell(rollup.cell_results(grid, scores, failures=predictions)) == by_cell(rollup.cell_results(grid, scores))
    # What is dear to compute, here a mark in the scores, then stands in the plan once.
    dear = scores.withColumn("judge_score", F.sqrt(F.col("judge_score") * F.col("judge_score") + F.lit(0.0)))
    dear = dear.filter(F.sqrt(F.col("sample_idx") + F.lit(7654.25)) > 0)
    rollup.cell_results(grid, dear, failures=predictions).explain()
    once = capsys.readouterr().out.count("7654.25")
    rollup.cell_results(grid, dear).explain()
    assert capsys.readouterr().out.count("7654.25") > once > 0


def test_a_mean_of_nan_stays(spark, tables):
    rows = spark.createDataFrame([(1, 0, True, True, float("nan"), None, float("nan"), 5, None, None)], SCORES)
    found, result = by_cell(rollup.cell_perf(tables[0], rows))[1], by_cell(rollup.cell_results(tables[0], rows))[1]
    judged = by_cell(rollup.cell_judge(tables[0], rows))[1]
    assert all(x != x for x in (found.mean_total_s, result.mean_total_s, judged.judge_avg_score))


def test_summary_and_progress(tables):
    results = rollup.cell_results(*tables)
    pcts = [50.0, 100.0, 0.0]
    summary = rollup.sweep_summary(results).first()
    assert summary.exact_mean == pytest.approx(statistics.mean(pcts))
    assert summary.exact_std == pytest.approx(statistics.stdev(pcts))
    one = rollup.sweep_summary(results.filter("cell_idx = 1")).first()
    assert one.exact_mean == 50.0 and one.exact_std is None
    assert tuple(rollup.sweep_progress(results).first()) == (3, 5, len(results.columns))
    assert tuple(rollup.summary_ttft(results).first()) == (0.2, "0.20s")
    assert tuple(rollup.summary_ttft(results.filter("cell_idx = 4")).first()) == (None, "N/A")


def test_summary_of_failed_cells_only_is_empty_of_values(tables):
    results = rollup.cell_results(*tables).filter("status <> 'ok'")
    assert rollup.sweep_summary(results).first().exact_mean is None


def test_detail_and_predictions(spark, tables):
    results = rollup.cell_results(*tables)
    detail = {r.cell_pos: r for r in inspect.cell_detail(results).collect()}
    assert detail[0].config == "quant=None, kv=False, prefix=True, tokens=128"
    assert detail[0].error is None and detail[1].error == "CUDA out of memory"
    samples = spark.createDataFrame(
        [(1, 5, " x ", "x"), (1, 3, "y" * 71, "x"), (1, 4, "x", "x "), (2, 1, "q", "q")],
        "cell_idx int, sample_idx long, prediction string, reference string",
    )
    shown = inspect.show_predictions(results, samples, 0, 2).orderBy("pos").collect()
    assert [(r.pos, r.mark, r.prediction) for r in shown] == [(0, "✗", "y" * 70 + "..."), (1, "✗", "x")]
    assert inspect.show_predictions(results, samples, 0).orderBy("pos").collect()[2].mark == "✓"
    assert inspect.show_predictions(results, samples, 1).first().message == "Cell 1 failed: CUDA out of memory"
    assert inspect.show_predictions(results, samples, 9).first().message == "Cell 9 not found (only 5 cells available)"


READINGS = (
    "cell_idx int, vram_used_bytes long, power_mw long, gpu_util_pct double, cpu_util_pct double, gpu_ok boolean"
)


def test_telemetry_rollup(spark, tables):
    readings = spark.createDataFrame(
        [(1, 1048576, 2000, 10.0, None, False), (1, 3 * 1048576, None, 30.0, 50.0, True)], READINGS
    )
    found = by_cell(telemetry.cell_telemetry(tables[0], readings))
    one = found[1]
    assert (one.peak_vram_mb, one.avg_vram_mb, one.peak_power_w, one.avg_power_w) == (3.0, 2.0, 2.0, 1.0)
    assert (one.avg_gpu_util_pct, one.avg_cpu_util_pct, one.hw_sample_count) == (20.0, 25.0, 2)
    assert one.gpu_available is True and one.avg_ram_used_mb == 0.0
    assert tuple(found[2])[1:] == (0.0,) * 7 + (0, False)


def test_hosts_without_a_gpu(spark, tables):
    readings = spark.createDataFrame([(1, 50.0), (1, 70.0)], "cell_idx int, cpu_util_pct double")
    one = by_cell(telemetry.cell_telemetry(tables[0], readings))[1]
    assert (one.avg_cpu_util_pct, one.peak_vram_mb, one.hw_sample_count, one.gpu_available) == (60.0, 0.0, 2, False)


@pytest.mark.parametrize("broadcast_rows", [10**6, 0])
def test_readings_go_to_cells_of_their_own_host(spark, broadcast_rows):
    # All at one time, as fleets that are polled on one tick.
    ts = F.timestamp_seconds(F.lit(1_700_000_000))
    readings = spark.range(400).select("id", F.pmod("id", F.lit(4)).alias("host"), ts.alias("ts"))
    windows = spark.range(4).select(
        F.col("id").alias("host"), F.col("id").alias("cell"), ts.alias("start_ts"), F.timestamp_seconds(F.lit(1_700_000_060)).alias("end_ts")
    )
    joined = telemetry.attribute_telemetry(readings, windows, on=("host",), broadcast_rows=broadcast_rows)
    assert sorted((r.id, r.cell) for r in joined.collect()) == [(i, i % 4) for i in range(400)]


@pytest.mark.parametrize("broadcast_rows", [10**6, 0])
def test_attribution_equals_brute_force(spark, broadcast_rows):
    base = 1_700_000_000
    readings = spark.range(3000).select(
        F.col("id").alias("rid"), F.timestamp_micros((base * 10**6 + F.col("id") * 137_001)).alias("ts")
    )
    lengths = [1, 2, 3, 60, 61, 3600]
    windows = [
        (w, base + (w * 37) % 400, base + (w * 37) % 400 + lengths[w % len(lengths)]) for w in range(60)
    ]
    spans = spark.createDataFrame(windows + [(99, base, base)], "w int, s long, e long").select(
        "w", F.timestamp_seconds("s").alias("start_ts"), F.timestamp_seconds("e").alias("end_ts")
    )
    joined = telemetry.attribute_telemetry(readings, spans, broadcast_rows=broadcast_rows)
    found = sorted((r.rid, r.w) for r in joined.collect())
    want = sorted(
        (i, w)
        for i in range(3000)
        for w, s, e in windows
        if s * 10**6 <= base * 10**6 + i * 137_001 < e * 10**6
    )
    assert found == want


