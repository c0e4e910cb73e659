import pytest
from pyspark.sql import functions as F

from evalsweep.operators import telemetry
from evalsweep.plans import views
from evalsweep.streaming import telemetry_stream


@pytest.fixture()
def arriving(spark, sf_dir, tmp_path):
    """The events cut into six files, taken one per micro-batch."""
    folder = str(tmp_path / "events")
    views.table(spark, sf_dir, "events").repartition(6).write.parquet(folder)
    schema = spark.read.parquet(folder).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return folder, views.readings_of(stream)


def rounded(df):
    names = sorted(c for c in df.columns)
    return sorted(
        tuple(round(v, 6) if isinstance(v, float) else v for v in row) for row in df.select(*names).collect()
    )


def test_stream_equals_batch_and_takes_up_late_files(spark, sf_dir, arriving, tmp_path):
    folder, readings = arriving
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def run():
        telemetry_stream.telemetry_rollup_stream(readings, out, checkpoint).awaitTermination()
        return rounded(telemetry_stream.read_rollup(spark, out))

    events = views.table(spark, sf_dir, "events")
    assert run() == rounded(telemetry.rollup_readings(views.readings_of(events)))
    # More readings of one cell: the others keep their rows.
    more = events.filter("user_id % 16 = 3")
    more.write.mode("append").parquet(folder)
    assert run() == rounded(telemetry.rollup_readings(views.readings_of(events.unionByName(more))))


def test_finished_cells_leave_the_state_and_late_readings_count(spark, tmp_path):
    folder, out = str(tmp_path / "events"), str(tmp_path / "out")
    # Each cell reads for half an hour, one after the other; a few readings come 20 minutes late.
    events = spark.range(0, 3600).selectExpr(
        "id as event_id", "timestamp_seconds(1700000000 + id * 10) as ts", "(id div 180) * 1L as user_id",
        "cast(id % 50 as double) as value", "if(id % 40 = 0, 'error', 'view') as event_type",
    )
    due = F.floor((F.unix_seconds("ts") - 1700000000 + F.when(F.col("event_id") % 90 == 0, 1200).otherwise(0)) / 3600)
    events = events.withColumn("due", due)
    schema = events.drop("due").schema
    for part in range(11):
        events.filter(F.col("due") == part).drop("due").coalesce(1).write.mode("append").parquet(folder)
    readings = views.readings_of(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder))
    running = telemetry_stream.telemetry_slices_stream(readings, out, str(tmp_path / "checkpoint"), delay="30 minutes")
    running.awaitTermination()
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in running.recentProgress if p["stateOperators"]]
    dropped = [p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in running.recentProgress if p["stateOperators"]]
    # Ten hours of slices went through; those of the last hour or so are left.
    assert sum(dropped) == 0 and max(rows) <= 40 and rows[-1] <= 12
    whole = telemetry.rollup_readings(views.readings_of(events))
    assert whole.count() > 10 and rounded(telemetry_stream.read_slices(spark, out)) == rounded(whole)
    # One folder per micro-batch with few files, not one per cell.
    files = spark.read.format("binaryFile").load(f"{out}/batch=*/*.parquet").count()
    assert files <= 8 * len(running.recentProgress)


def test_readings_beyond_the_delay_are_told(spark, tmp_path):
    folder, out = str(tmp_path / "events"), str(tmp_path / "out")
    for start in (0, 36_000, 72_000, 100):  # the last file is hours too late
        spark.range(50).selectExpr(
            "id as event_id", f"timestamp_seconds(1700000000 + {start} + id) as ts", "1L as user_id",
            "1.5D as value", "'view' as event_type",
        ).coalesce(1).write.mode("append").parquet(folder)
    schema = spark.read.parquet(folder).schema
    readings = views.readings_of(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder))
    running = telemetry_stream.telemetry_slices_stream(readings, out, str(tmp_path / "checkpoint"))
    running.awaitTermination()
    dropped = sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in running.recentProgress if p["stateOperators"])
    (row,) = telemetry_stream.read_slices(spark, out).collect()
    assert dropped >= 1 and row["hw_sample_count"] == 150


def test_streams_of_readings_and_windows_meet_and_are_let_go(spark, tmp_path):
    first = 1700000000
    readings = spark.range(2000).selectExpr(
        "id as event_id", f"timestamp_seconds({first} + id * 30) as ts", "cast(id % 3 as int) as host"
    )
    windows = spark.range(60).selectExpr(
        "id as window_idx", f"timestamp_seconds({first} + (id div 3) * 3000) as start_ts",
        f"timestamp_seconds({first} + (id div 3) * 3000 + 1700 + (id % 5) * 300) as end_ts", "cast(id % 3 as int) as host",
    )
    streams = []
    for name, df, ts in (("r", readings, "ts"), ("w", windows, "start_ts")):
        for part in range(10):
            stretch = (F.unix_seconds(ts) - first).between(part * 6000, part * 6000 + 5999)
            df.filter(stretch).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
        streams.append(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}"))
    out = str(tmp_path / "out")
    running = telemetry_stream.attribute_telemetry_stream(
        *streams, out, str(tmp_path / "checkpoint"), longest_s=3000, delay="20 minutes", on=("host",)
    )
    running.awaitTermination()
    found = spark.read.parquet(out).select("event_id", "window_idx", "host")
    expected = telemetry.attribute_telemetry(readings, windows, on=("host",)).select("event_id", "window_idx", "host")
    assert found.count() > 500 and rounded(found) == rounded(expected)
    held = [p["stateOperators"][0]["numRowsTotal"] for p in running.recentProgress if p["stateOperators"]]
    assert max(held) < 1200 and held[-1] < 400  # of 2000 readings and their windows


def test_a_window_longer_than_allowed_fails_the_stream(spark, tmp_path):
    spark.sql("select 1L as event_id, timestamp_seconds(10) as ts").write.parquet(f"{tmp_path}/r")
    spark.sql("select 1L as w, timestamp_seconds(0) as start_ts, timestamp_seconds(99) as end_ts").write.parquet(f"{tmp_path}/w")
    sides = [spark.readStream.schema(spark.read.parquet(p).schema).parquet(p) for p in (f"{tmp_path}/r", f"{tmp_path}/w")]
    running = telemetry_stream.attribute_telemetry_stream(*sides, f"{tmp_path}/o", f"{tmp_path}/c", longest_s=50)
    with pytest.raises(Exception, match="longer than 50 s"):
        running.awaitTermination()
