"""Continuous roll-up of hardware readings per cell."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from evalsweep.operators.telemetry import rollup_columns, telemetry_units
from evalsweep.sources.store import read_cells, write_cells


def telemetry_rollup_stream(
    readings: DataFrame,
    out: str,
    checkpoint: str,
    keys: Sequence[str] = ("cell_idx",),
    trigger: dict | None = None,
) -> StreamingQuery:
    """Keep each cell's roll-up current while its readings arrive.

    The state is one row of numbers per cell.  Each micro-batch replaces the
    stored rows of the cells it changed, and only those, so a batch repeated
    after a failure changes nothing.  Read them with ``read_rollup``.
    """
    rolled = telemetry_units(readings).groupBy(*keys).agg(*rollup_columns())

    def upsert(changed: DataFrame, batch_id: int) -> None:
        write_cells(changed, out, keys)

    return (
        rolled.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(upsert)
        .start()
    )


def read_rollup(spark: SparkSession, out: str, schema: str | None = None) -> DataFrame:
    """Newest roll-up of every cell; a schema keeps text keys that look like numbers."""
    return read_cells(spark, out, schema)


# Roll-ups whose state expires -----------------------------------------------------------

_SUMMED = {
    "avg_vram_mb": "vram_used_mb",
    "avg_power_w": "power_draw_w",
    "avg_gpu_util_pct": "gpu_util_pct",
    "avg_cpu_util_pct": "cpu_util_pct",
    "avg_ram_used_mb": "ram_used_mb",
}


def _partial() -> list[Column]:
    """What a slice of time adds to a cell's roll-up: numbers that merge by adding or comparing."""
    return [
        F.max("vram_used_mb").alias("peak_vram_mb"),
        F.max("power_draw_w").alias("peak_power_w"),
        *[F.sum(source).alias(name) for name, source in _SUMMED.items()],
        F.count(F.lit(1)).alias("hw_sample_count"),
        F.bool_or("gpu_ok").alias("gpu_available"),
    ]


def telemetry_slices_stream(
    readings: DataFrame,
    out: str,
    checkpoint: str,
    keys: Sequence[str] = ("cell_idx",),
    ts: str = "ts",
    width: str = "10 minutes",
    delay: str = "1 hour",
    files: int = 8,
    trigger: dict | None = None,
) -> StreamingQuery:
    """The same roll-up with bounded state: a cell that has finished leaves it.

    State is one row per cell and slice of time, and goes once the latest reading
    is ``delay`` beyond the slice; a reading later than that is not counted, and
    the query's progress says how many there were.  A micro-batch writes the
    slices that it changed to a folder of its own, in at most ``files`` files
    however many cells it touched; a batch that is repeated after a failure
    overwrites its folder.  ``read_slices`` merges the newest row of every slice.
    """
    timed = telemetry_units(readings).withWatermark(ts, delay)
    rolled = timed.groupBy(F.window(ts, width).alias("_slice"), *keys).agg(*_partial())

    def store(changed: DataFrame, batch_id: int) -> None:
        rows = changed.withColumn("_slice", F.col("_slice.start")).coalesce(files)
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        rolled.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(store)
        .start()
    )


def read_slices(spark: SparkSession, out: str, keys: Sequence[str] = ("cell_idx",)) -> DataFrame:
    """One roll-up per cell: its slices as last written, added up."""
    stored = spark.read.parquet(out)
    numbers = [name for name in stored.columns if name not in (*keys, "_slice", "batch")]
    newest = stored.groupBy(*keys, "_slice").agg(F.max_by(F.struct(*numbers), "batch").alias("s")).select(*keys, "s.*")
    count = F.sum("hw_sample_count")
    merged = {
        "peak_vram_mb": F.max("peak_vram_mb"),
        "peak_power_w": F.max("peak_power_w"),
        **{name: F.sum(name) / count for name in _SUMMED},
        "hw_sample_count": count,
        "gpu_available": F.bool_or("gpu_available"),
    }
    order = ["peak_vram_mb", "avg_vram_mb", "peak_power_w", "avg_power_w", "avg_gpu_util_pct", "avg_cpu_util_pct"]
    order += ["avg_ram_used_mb", "hw_sample_count", "gpu_available"]
    return newest.groupBy(*keys).agg(*[merged[name].alias(name) for name in order])


# Attribution while readings and windows arrive -------------------------------------------


def attribute_telemetry_stream(
    readings: DataFrame,
    windows: DataFrame,
    out: str,
    checkpoint: str,
    longest_s: int,
    delay: str = "10 minutes",
    ts: str = "ts",
    start: str = "start_ts",
    end: str = "end_ts",
    on: Sequence[str] = (),
    trigger: dict | None = None,
) -> StreamingQuery:
    """Give each reading the windows open at its time, ``start <= ts < end``, while both arrive.

    Time is cut into buckets of ``longest_s`` seconds, the greatest length that a
    window may have (a longer one fails the query): a window lies in at most two,
    and ``on`` and the bucket make it an equi-join.  Both sides are held until the
    watermark, ``delay`` behind the slower side, has passed what they can still
    meet; readings and windows later than that are not joined.  Matches are
    appended to Parquet under ``out``.
    """

    def bucket(at: Column) -> Column:
        return F.floor(F.unix_micros(at.cast("timestamp")) / F.lit(longest_s * 1_000_000))

    opened, closed = F.col(start).cast("timestamp"), F.col(end).cast("timestamp")
    too_long = F.unix_micros(closed) - F.unix_micros(opened) > longest_s * 1_000_000
    just_before = F.timestamp_micros(F.unix_micros(closed) - 1)
    both = F.array_distinct(F.array(bucket(opened), bucket(just_before)))
    buckets = F.when(too_long, F.raise_error(F.lit(f"a window is longer than {longest_s} s")).cast("array<bigint>")).otherwise(both)
    left = readings.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).withColumn("_bucket", bucket(F.col(ts)))
    right = windows.withColumns({start: opened, end: closed}).withWatermark(start, delay).filter(F.col(start) < F.col(end))
    right = right.withColumn("_bucket", F.explode(buckets))
    renamed = {name: f"_w_{name}" for name in (*on, "_bucket")}
    right = right.withColumnsRenamed(renamed)
    met = F.col("_bucket") == F.col("_w__bucket")
    for name in on:
        met = met & (F.col(name) == F.col(f"_w_{name}"))
    # The last condition bounds how long a reading has to be held.
    inside = (F.col(ts) >= F.col(start)) & (F.col(ts) < F.col(end))
    bounded = F.col(ts) < F.col(start) + F.expr(f"INTERVAL '{int(longest_s)}' SECOND")
    joined = left.join(right, met & inside & bounded).drop("_bucket", *renamed.values())
    return (
        joined.writeStream.format("parquet")
        .outputMode("append")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
