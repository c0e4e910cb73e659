"""Reading results: cell details and sample predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalsweep.functions.text import strip

# Fixed values -----------------------------------------------------------
SHOWN_CHARACTERS = 70
NOT_FOUND_TEXT = "Cell {pos} not found (only {cells} cells available)"
FAILED_TEXT = "Cell {pos} failed: {error}"
# ------------------------------------------------------------------------
DETAIL_METRICS = (
    "n_samples",
    "exact_match_pct",
    "normalized_match_pct",
    "judge_avg_score",
    "mean_tps",
    "mean_total_s",
    "peak_vram_mb",
    "avg_vram_mb",
    "avg_power_w",
)


def cell_position(cell_idx: str = "cell_idx") -> Column:
    """Cells are numbered from 1 in the data and shown from 0."""
    return (F.col(cell_idx) - 1).cast("int")


def _shown(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("None"))


def config_label() -> Column:
    return F.concat(
        F.lit("quant="),
        _shown(F.col("quantization")),
        F.lit(", kv="),
        F.initcap(_shown(F.col("kv_cache"))),
        F.lit(", prefix="),
        F.initcap(_shown(F.col("prefix_cache"))),
        F.lit(", tokens="),
        _shown(F.col("max_new_tokens")),
    )


def cell_detail(results: DataFrame) -> DataFrame:
    """Label, status, and the metrics of a good cell or the error of a failed one."""
    good = F.col("status") == "ok"
    return results.select(
        cell_position().alias("cell_pos"),
        "model_id",
        "backend",
        config_label().alias("config"),
        "status",
        *[F.when(good, F.col(m)).alias(m) for m in DETAIL_METRICS if m in results.columns],
        F.when(~good, F.col("error")).alias("error"),
    )


def show_predictions(results: DataFrame, samples: DataFrame, cell_pos: int = 0, n: int = 5) -> DataFrame:
    """First ``n`` predictions of one cell, shortened, with a match mark.

    The mark compares the stripped prediction with the reference as it is.
    ``samples`` holds ``cell_idx, sample_idx, reference, prediction``.  A bad
    position or a failed cell gives one row with a message.
    """
    spark = results.sparkSession
    schema = "pos int, mark string, prediction string, reference string, message string"
    cell = results.filter(F.col("cell_idx") == cell_pos + 1).select("status", "error").first()
    if cell is None:
        message = NOT_FOUND_TEXT.format(pos=cell_pos, cells=results.count())
        return spark.createDataFrame([(None, None, None, None, message)], schema)
    if cell["status"] != "ok":
        message = FAILED_TEXT.format(pos=cell_pos, error=cell["error"])
        return spark.createDataFrame([(None, None, None, None, message)], schema)

    text = F.col("prediction")
    short = F.when(
        F.length(text) > SHOWN_CHARACTERS, F.concat(F.substring(text, 1, SHOWN_CHARACTERS), F.lit("..."))
    ).otherwise(text)
    first = (
        samples.filter(F.col("cell_idx") == cell_pos + 1)
        .select("sample_idx", "prediction", "reference")
        .orderBy("sample_idx")
        .limit(n)
    )
    # At most n rows from here on.
    row = F.struct(
        "sample_idx",
        F.when(strip(text) == F.col("reference"), F.lit("✓")).otherwise(F.lit("✗")).alias("mark"),
        short.alias("prediction"),
        "reference",
    )
    listed = first.agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return listed.select(F.posexplode("rows").alias("pos", "r")).select(
        "pos", "r.mark", "r.prediction", "r.reference", F.lit(None).cast("string").alias("message")
    )
