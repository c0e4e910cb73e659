"""Hardware readings: units, attribution to cells, roll-up per cell."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalsweep.functions.measures import mebibytes, watts
from evalsweep.operators.sizing import MAX_BROADCAST_ROWS, fits_broadcast, for_every_salt, with_salt
from evalsweep.sources.workspace import work_folder

TELEMETRY_COLUMNS = (
    "peak_vram_mb",
    "avg_vram_mb",
    "peak_power_w",
    "avg_power_w",
    "avg_gpu_util_pct",
    "avg_cpu_util_pct",
    "avg_ram_used_mb",
)


def telemetry_units(readings: DataFrame) -> DataFrame:
    """Raw readings to MiB, watts and percent; a failed reading counts as 0.0.

    Devices that were not read at all may lack their columns; hosts that do not
    say whether a GPU was read have none.
    """
    conversions = {
        "vram_used_mb": ("vram_used_bytes", mebibytes),
        "vram_total_mb": ("vram_total_bytes", mebibytes),
        "power_draw_w": ("power_mw", watts),
        "gpu_util_pct": ("gpu_util_pct", _or_zero),
        "cpu_util_pct": ("cpu_util_pct", _or_zero),
        "ram_used_mb": ("ram_used_bytes", mebibytes),
    }
    raw = {source for source, _ in conversions.values()}
    kept = [name for name in readings.columns if name not in raw]
    converted = [
        (convert(F.col(source)) if source in readings.columns else F.lit(0.0)).alias(name)
        for name, (source, convert) in conversions.items()
    ]
    if "gpu_ok" not in kept:
        converted.append(F.lit(False).alias("gpu_ok"))
    return readings.select(*kept, *converted)


def _or_zero(value: Column) -> Column:
    return F.coalesce(value.cast("double"), F.lit(0.0))


def rollup_columns() -> list[Column]:
    """Aggregates of one cell's readings; all keep fixed-width partial states."""
    return [
        F.max("vram_used_mb").alias("peak_vram_mb"),
        F.avg("vram_used_mb").alias("avg_vram_mb"),
        F.max("power_draw_w").alias("peak_power_w"),
        F.avg("power_draw_w").alias("avg_power_w"),
        F.avg("gpu_util_pct").alias("avg_gpu_util_pct"),
        F.avg("cpu_util_pct").alias("avg_cpu_util_pct"),
        F.avg("ram_used_mb").alias("avg_ram_used_mb"),
        F.count(F.lit(1)).alias("hw_sample_count"),
        F.bool_or(F.col("gpu_ok")).alias("gpu_available"),
    ]


def rollup_readings(readings: DataFrame, keys: Sequence[str] = ("cell_idx",)) -> DataFrame:
    """One row per cell that has readings."""
    return telemetry_units(readings).groupBy(*keys).agg(*rollup_columns())


def fill_missing(rolled: DataFrame) -> DataFrame:
    """Cells without readings show zeros and no GPU."""
    filled = or_zero(rolled, *TELEMETRY_COLUMNS, "hw_sample_count")
    return filled.withColumn("gpu_available", F.coalesce("gpu_available", F.lit(False)))


def or_zero(df: DataFrame, *names: str) -> DataFrame:
    """Numbers that are missing become 0; NaN, which ``na.fill`` replaces too, stays."""
    zeros = {name: F.coalesce(F.col(name), F.lit(0).cast(df.schema[name].dataType)) for name in names}
    return df.withColumns(zeros)


def cell_telemetry(
    grid: DataFrame, readings: DataFrame, keys: Sequence[str] = ("cell_idx",)
) -> DataFrame:
    """One row per cell of the grid, zeros where nothing was read."""
    cells = grid.select(*keys)
    return fill_missing(cells.join(rollup_readings(readings, keys), list(keys), "left"))


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def _shift(value: Column, bits: Column) -> Column:
    return F.call_function("shiftright", value, bits)


def attribute_telemetry(
    readings: DataFrame,
    windows: DataFrame,
    ts: str = "ts",
    start: str = "start_ts",
    end: str = "end_ts",
    on: Sequence[str] = (),
    salts: int | None = None,
    broadcast_rows: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """Give each reading the windows open at its time: ``start <= ts < end``.

    ``on`` names what reading and window must share, such as host and device:
    cells that run side by side each get their own readings only.

    Time is cut into buckets as wide as a window is long, rounded up to a power
    of two: a window lies in at most two buckets of its own width, and a bucket
    holds few windows that do not overlap.  Readings look into one bucket per
    width in use (at most 63).  That makes it an equi-join whose candidates grow
    with the true matches, and no reading meets all windows.  Windows of checked small
    size are broadcast; otherwise a bucket with most of the readings, even if they
    carry one time, is spread over ``salts`` sub-keys, by default as many as a
    shuffle has partitions, at most 256.  The placed windows are stored once.
    """
    on = list(on)
    opened, closed = _micros(F.col(start)), _micros(F.col(end))
    # Bits of (length - 1): the power of two that covers the window.
    width = F.length(F.bin(closed - opened - 1)).cast("int")
    placed = (
        windows.filter(F.col(start) < F.col(end))
        .withColumn("_width", width)
        .withColumn(
            "_bucket",
            F.explode(
                F.array_distinct(
                    F.array(_shift(opened, F.col("_width")), _shift(closed - 1, F.col("_width")))
                )
            ),
        )
    )
    spark = readings.sparkSession
    path = work_folder(spark, "placed-windows")
    placed.write.parquet(path)
    placed = spark.read.schema(placed.schema).parquet(path)
    widths = placed.agg(F.collect_set("_width")).scalar()
    probes = readings.withColumn("_width", F.explode(widths)).withColumn(
        "_bucket", _shift(_micros(F.col(ts)), F.col("_width"))
    )
    helpers = ["_width", "_bucket"]
    if fits_broadcast(placed, broadcast_rows):
        placed = F.broadcast(placed)
    else:
        salts = salts or min(256, int(spark.conf.get("spark.sql.shuffle.partitions")))
        probes, placed = with_salt(probes, salts, *readings.columns), for_every_salt(placed, salts)
        helpers.append("_salt")
    inside = (F.col(ts) >= F.col(start)) & (F.col(ts) < F.col(end))
    return probes.join(placed, [*on, *helpers]).filter(inside).drop(*helpers)
