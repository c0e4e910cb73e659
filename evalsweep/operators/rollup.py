"""Roll-ups: samples to cells, cells to sweeps.

Aggregation states are fixed-width numbers, so Spark hash-aggregates on the map
side and one row per cell and task crosses the network, whatever share of the
samples a single cell holds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalsweep.functions.measures import failure_status, percent, throughput
from evalsweep.operators.sizing import fits_broadcast
from evalsweep.operators.telemetry import fill_missing, or_zero, rollup_readings

GRID_COLUMNS = (
    "experiment",
    "run_ts",
    "model_id",
    "backend",
    "quantization",
    "kv_cache",
    "prefix_cache",
    "max_new_tokens",
)


def _accuracy() -> list[Column]:
    return [
        F.count("sample_idx").alias("n_samples"),
        F.count_if(F.col("exact_match")).alias("n_exact"),
        F.count_if(F.col("normalized_match")).alias("n_normalized"),
    ]


def _performance() -> list[Column]:
    per_sample = throughput(F.col("n_tokens"), F.col("total_s"))
    return [
        F.avg("ttft_s").alias("mean_ttft_s"),
        F.avg(F.when(F.col("sample_idx").isNotNull(), per_sample)).alias("mean_tps"),
        F.avg("total_s").alias("mean_total_s"),
    ]


def cell_accuracy(grid: DataFrame, scores: DataFrame, keys: Sequence[str] = ("cell_idx",)) -> DataFrame:
    """Counts and percentages per cell; a cell without samples shows zeros."""
    keys = list(keys)
    counted = scores.groupBy(*keys).agg(*_accuracy())
    joined = or_zero(grid.select(*keys).join(counted, keys, "left"), "n_samples", "n_exact", "n_normalized")
    return joined.select(
        *keys,
        "n_samples",
        "n_exact",
        "n_normalized",
        percent(F.col("n_exact"), F.col("n_samples")).alias("exact_match_pct"),
        percent(F.col("n_normalized"), F.col("n_samples")).alias("normalized_match_pct"),
    )


def cell_judge(grid: DataFrame, scores: DataFrame, keys: Sequence[str] = ("cell_idx",)) -> DataFrame:
    """Mean judge score per cell; 0.0 without one, also when the judge is off."""
    keys = list(keys)
    judged = scores.groupBy(*keys).agg(F.avg("judge_score").alias("judge_avg_score"))
    return or_zero(grid.select(*keys).join(judged, keys, "left"), "judge_avg_score")


def cell_perf(grid: DataFrame, predictions: DataFrame, keys: Sequence[str] = ("cell_idx",)) -> DataFrame:
    """Mean time to first token (where measured), throughput and latency per cell."""
    keys = list(keys)
    timed = predictions.groupBy(*keys).agg(F.count("sample_idx").alias("n_samples"), *_performance())
    joined = grid.select(*keys).join(timed, keys, "left")
    return or_zero(joined, "n_samples", "mean_tps", "mean_total_s")


def cell_results(
    grid: DataFrame,
    scores: DataFrame,
    readings: DataFrame | None = None,
    keys: Sequence[str] = ("cell_idx",),
    failures: DataFrame | None = None,
) -> DataFrame:
    """The result row of each cell.

    One failed sample fails its cell: the status and error are those of the
    first failing sample by number, and there are no metrics.  A failing row that
    is stored twice counts once for that.  Aggregation states carry no texts: the
    errors are read in a second, pruned pass, which keeps one row per cell before
    any text moves.  It reads ``failures``, any table with the same failing rows:
    the predictions, where ``scores`` is a plan that would score them twice, or by
    default ``scores``, which is then best given as a stored table.
    """
    keys = list(keys)
    numbers = scores.groupBy(*keys).agg(
        *_accuracy(),
        *_performance(),
        F.avg("judge_score").alias("judge_avg_score"),
    )
    errors = _first_errors(grid, scores if failures is None else failures, keys)
    cells = grid.join(numbers, keys, "left").join(errors, keys, "left")
    if readings is not None:
        cells = fill_missing(cells.join(rollup_readings(readings, keys), keys, "left"))

    is_runtime = F.col("error_is_runtime")
    status = F.coalesce(failure_status(F.col("error_type"), F.col("error"), is_runtime), F.lit("ok"))
    n_samples = F.coalesce(F.col("n_samples"), F.lit(0))
    metrics = {
        "n_samples": n_samples,
        "mean_ttft_s": F.col("mean_ttft_s"),
        "mean_tps": F.coalesce("mean_tps", F.lit(0.0)),
        "mean_total_s": F.coalesce("mean_total_s", F.lit(0.0)),
        "exact_match_pct": percent(F.col("n_exact"), n_samples),
        "normalized_match_pct": percent(F.col("n_normalized"), n_samples),
        "judge_avg_score": F.coalesce("judge_avg_score", F.lit(0.0)),
    }
    if readings is not None:
        metrics.update(
            {
                name: F.col(name)
                for name in (
                    "peak_vram_mb",
                    "avg_vram_mb",
                    "peak_power_w",
                    "avg_power_w",
                    "avg_gpu_util_pct",
                    "avg_cpu_util_pct",
                    "avg_ram_used_mb",
                    "hw_sample_count",
                    "gpu_available",
                )
            }
        )
    described = [name for name in GRID_COLUMNS if name in grid.columns and name not in keys]
    return cells.withColumn("status", status).select(
        *keys,
        *described,
        "status",
        "error",
        *[F.when(F.col("status") == "ok", value).alias(name) for name, value in metrics.items()],
    )


def _first_errors(grid: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Type and text of each failed cell's first error, one row per cell.

    A model that does not load leaves its traceback on every row of its cell.
    The first failing numbers are found without texts and, having at most a row
    per cell, are carried to the failing rows if the grid is small.
    """
    is_runtime = F.col("error_is_runtime") if "error_is_runtime" in rows.columns else F.lit(None)
    failing = rows.filter(F.col("error_type").isNotNull()).select(
        *keys, "sample_idx", "error_type", "error", is_runtime.cast("boolean").alias("error_is_runtime")
    )
    first = failing.groupBy(*keys).agg(F.min("sample_idx").alias("sample_idx"))
    first = first.join(grid.select(*keys), keys, "left_semi")
    if fits_broadcast(grid.select(*keys)):
        first = F.broadcast(first)
    found = failing.join(first, [*keys, "sample_idx"], "left_semi")
    # Only copies of one row are left in a cell; one of them stands for it.
    copies = Window.partitionBy(*keys).orderBy("error_type", "error")
    one = found.withColumn("_copy", F.row_number().over(copies)).filter("_copy = 1")
    return one.drop("_copy", "sample_idx")


def ok_cells(results: DataFrame) -> DataFrame:
    return results.filter(F.col("status") == "ok")


def sweep_summary(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Means over the successful cells, and the sample deviation of accuracy.

    The deviation of a single cell is NULL.
    """
    means = {
        "judge_avg_score": "judge_mean",
        "mean_tps": "tps_mean",
        "mean_total_s": "total_s_mean",
        "peak_vram_mb": "peak_vram_mean",
        "avg_vram_mb": "avg_vram_mean",
        "peak_power_w": "peak_power_mean",
        "avg_power_w": "avg_power_mean",
        "avg_gpu_util_pct": "gpu_util_mean",
        "avg_cpu_util_pct": "cpu_util_mean",
    }
    return (
        ok_cells(results)
        .groupBy(*by)
        .agg(
            F.avg("exact_match_pct").alias("exact_mean"),
            F.stddev_samp("exact_match_pct").alias("exact_std"),
            F.avg("normalized_match_pct").alias("normalized_mean"),
            F.stddev_samp("normalized_match_pct").alias("normalized_std"),
            *[F.avg(name).alias(label) for name, label in means.items() if name in results.columns],
        )
    )


def summary_ttft(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean time to first token over the cells that measured it, and its text."""
    mean = F.avg("mean_ttft_s")
    shown = F.when(mean.isNotNull(), F.format_string("%.2fs", mean)).otherwise(F.lit("N/A"))
    return ok_cells(results).groupBy(*by).agg(mean.alias("ttft_mean"), shown.alias("ttft_text"))


def sweep_progress(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Successful and total cells, and the width of the result table."""
    return results.groupBy(*by).agg(
        F.count_if(F.col("status") == "ok").alias("n_ok"),
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(results.columns)).alias("n_columns"),
    )
