import glob
import os

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from evalsweep.sources import store
from evalsweep.sources.workspace import work_folder


def foreign_file(path, rows):
    """A result file as pandas and Arrow write it: types come from the values."""
    pq.write_table(pa.Table.from_pandas(pd.DataFrame(rows), preserve_index=False), path)


def good(cell, **more):
    row = {
        "model_id": "m", "backend": "hf", "quantization": None, "kv_cache": False, "prefix_cache": False,
        "max_new_tokens": 128, "status": "ok", "error": None, "n_samples": 2, "mean_ttft_s": None,
        "mean_tps": 1.5, "mean_total_s": 2.0, "exact_match_pct": 50.0, "normalized_match_pct": 50.0,
        "judge_avg_score": 0.0, "hw_sample_count": 3, "gpu_available": False,
        "prompts": ["p0", "p1"], "references": ["r0", "r1"], "predictions": ["a0", "a1"],
        "cell_idx": cell, "experiment": "E x",
    }
    return {**row, **more}


def failed(cell):
    keep = ("model_id", "backend", "quantization", "kv_cache", "prefix_cache", "max_new_tokens", "experiment")
    return {**{k: good(cell)[k] for k in keep}, "status": "error", "error": "boom", "cell_idx": cell}


def test_read_foreign_results(spark, tmp_path):
    path = str(tmp_path / "sweep_a_1.parquet")
    foreign_file(path, [good(1), failed(2)])
    results = store.read_results(spark, path)
    assert dict(results.dtypes) == store.RESULT_COLUMNS
    rows = {r.cell_idx: r for r in results.collect()}
    assert rows[1].n_samples == 2 and rows[1].quantization is None and rows[1].run_ts is None
    assert rows[2].n_samples is None and rows[2].error == "boom"
    samples = store.read_result_samples(spark, path)
    assert sorted(tuple(r) for r in samples.collect()) == [(1, 0, "p0", "r0", "a0"), (1, 1, "p1", "r1", "a1")]


def test_missing_file(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        store.read_results(spark, str(tmp_path / "nothing.parquet"))


def test_latest_and_listing_of_files(spark, tmp_path):
    for n in range(12):
        foreign_file(str(tmp_path / f"sweep_a_{n:02d}.parquet"), [good(n + 1)])
    foreign_file(str(tmp_path / "other.parquet"), [good(99)])
    assert store.latest_sweep(spark, str(tmp_path)).first().cell_idx == 12
    listed = store.list_sweep_files(spark, str(tmp_path)).orderBy("position").collect()
    assert [(r.position, r.name) for r in listed] == [
        (i + 1, f"sweep_a_{n:02d}.parquet") for i, n in enumerate(range(2, 12))
    ]


def test_only_sweep_files_of_the_folder_itself_count(spark, tmp_path):
    folder = tmp_path / "results [1]"
    for place, n in (("sweep_a.parquet", 1), ("tier1/sweep_z.parquet", 2), ("old_sweep_z.parquet", 3)):
        path = folder / place
        path.parent.mkdir(parents=True, exist_ok=True)
        foreign_file(str(path), [good(n)])
    # A sweep that Spark wrote is a folder.
    spark.read.parquet(str(folder / "sweep_a.parquet").replace("[", "\\[").replace("]", "\\]")).write.parquet(
        str(folder / "sweep_b.parquet")
    )
    assert [r.name for r in store.list_sweep_files(spark, str(folder)).collect()] == ["sweep_a.parquet", "sweep_b.parquet"]
    with pytest.raises(FileNotFoundError):
        store.latest_sweep(spark, str(folder / "tier2"))


def test_head_sample_finds_the_first_rows_without_moving_texts(spark, tmp_path, capsys):
    path = str(tmp_path / "rows")
    spark.range(100).selectExpr("id", "id % 3 as k", "repeat('x', 50) as text").repartition(7).write.parquet(path)
    df = spark.read.parquet(path)
    sample = store.head_sample(df, 40, ["k", "id"])
    expected = sorted(range(100), key=lambda i: (i % 3, i))[:40]
    assert sorted(r.id for r in sample.collect()) == sorted(expected)
    sample.explain()
    assert "Exchange" not in capsys.readouterr().out
    assert store.head_sample(df, 30).count() == 30
    made = spark.range(9).withColumn("k", F.lit(1))
    assert [r.id for r in store.head_sample(made, 2, "id").collect()] == [0, 1]


def test_nested_chunks_are_bounded_by_bytes(spark):
    rows = [(1, s, "p" * 10, "r" * 10, "a" * (500 if s == 3 else 10)) for s in range(10)]
    df = spark.createDataFrame(rows, "cell_idx int, sample_idx long, prompt string, reference string, prediction string")
    nested = store.nest_cells(df, chunk_bytes=100)
    for row in nested.collect():
        size = sum(len(t) for name in ("prompts", "references", "predictions") for t in row[name])
        last = sum(len(row[name][-1]) for name in ("prompts", "references", "predictions"))
        assert size - last < 100
    assert nested.count() == 3
    assert sorted(tuple(r) for r in store.unnest_cells(nested).collect()) == rows


def test_no_sweep_files(spark, tmp_path):
    foreign_file(str(tmp_path / "other.parquet"), [good(1)])
    with pytest.raises(FileNotFoundError):
        store.latest_sweep(spark, str(tmp_path))


def test_sweep_names(spark):
    df = spark.createDataFrame([("My Sweep", "20240101T000000Z")], "e string, t string")
    name = df.select(store.sweep_name(F.col("e"), F.col("t"))).first()[0]
    assert name == "sweep_my_sweep_20240101T000000Z.parquet"


@pytest.mark.parametrize("codec", ["snappy", "gzip", "zstd", "none"])
def test_codecs(spark, tmp_path, codec):
    path = str(tmp_path / codec)
    store.write_results(spark.range(10), path, codec)
    assert spark.read.parquet(path).count() == 10
    file = glob.glob(f"{path}/*.parquet")[0]
    used = pq.ParquetFile(file).metadata.row_group(0).column(0).compression
    assert used == {"none": "UNCOMPRESSED"}.get(codec, codec.upper())


def test_other_codecs_are_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        store.write_results(spark.range(1), str(tmp_path / "x"), "lz4")


def test_scan_formats_and_splits(spark, tmp_path):
    rows = spark.range(10).select("id", F.when(F.col("id") < 4, "train").otherwise("test").alias("split"))
    rows.write.partitionBy("split").parquet(str(tmp_path / "p"))
    rows.write.json(str(tmp_path / "j"))
    rows.write.option("header", True).csv(str(tmp_path / "c"))
    assert store.scan_dataset(spark, str(tmp_path / "p"), "train").count() == 4
    assert store.scan_dataset(spark, str(tmp_path / "j"), "test", fmt="json").count() == 6
    csv = store.scan_dataset(
        spark, str(tmp_path / "c"), "test", fmt="csv", schema="id long, split string", header="true"
    )
    assert csv.count() == 6
    assert store.scan_dataset(spark, str(tmp_path / "p")).count() == 10


def test_head_sample_is_in_source_order(spark):
    df = spark.range(100).repartition(7)
    assert [r.id for r in store.head_sample(df, 3, "id").collect()] == [0, 1, 2]
    assert store.head_sample(df, 1000, "id").count() == 100


def test_head_sample_in_file_order(spark, tmp_path):
    spark.range(100, 0, -1, 1).write.parquet(str(tmp_path / "d"))
    first = store.head_sample(store.scan_dataset(spark, str(tmp_path / "d")), 3)
    assert [tuple(r) for r in first.collect()] == [(100,), (99,), (98,)]


def cells(spark, cell_numbers, value):
    return spark.createDataFrame(
        [("E", "t1", c, s, value) for c in cell_numbers for s in range(4)],
        "experiment string, run_ts string, cell_idx int, sample_idx long, value string",
    )


@pytest.mark.parametrize("gather", [True, False])
def test_rerun_of_one_cell_leaves_the_others(spark, tmp_path, gather):
    path = str(tmp_path / "cells")
    store.write_cells(cells(spark, [1, 2, 3], "old"), path, gather=gather)
    kept = {f: os.path.getmtime(f) for f in glob.glob(f"{path}/*/*/cell_idx=[13]/*.parquet")}
    store.write_cells(cells(spark, [2, 4], "new"), path, gather=gather)
    rows = store.read_cells(spark, path).groupBy("cell_idx", "value").count().collect()
    assert sorted(tuple(r) for r in rows) == [(1, "old", 4), (2, "new", 4), (3, "old", 4), (4, "new", 4)]
    assert kept == {f: os.path.getmtime(f) for f in glob.glob(f"{path}/*/*/cell_idx=[13]/*.parquet")}


def test_a_large_cell_is_written_by_many_tasks(spark, tmp_path):
    path, size = str(tmp_path / "cells"), "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    rows = spark.range(0, 60_000, 1, 8).selectExpr(
        "'E' experiment", "'t' run_ts", "if(id % 3 < 2, 1, cast(id % 50 as int) + 2) cell_idx",
        "id sample_idx", "sha2(cast(id as string), 512) value",
    )
    spark.conf.set(size, "256k")
    try:
        store.write_cells(rows, path)
    finally:
        spark.conf.unset(size)
    assert len(glob.glob(f"{path}/*/*/cell_idx=1/*.parquet")) > 4
    assert store.read_cells(spark, path).count() == 60_000


def test_nest_and_unnest(spark):
    rows = [(c, s, f"p{s}", f"r{s}", f"a{c}{s}") for c in (1, 2) for s in range(25)]
    df = spark.createDataFrame(rows, "cell_idx int, sample_idx long, prompt string, reference string, prediction string")
    whole = store.nest_cells(df).orderBy("cell_idx").collect()
    assert [len(r.prompts) for r in whole] == [25, 25]
    assert list(whole[0].predictions) == [f"a1{s}" for s in range(25)]
    chunked = store.nest_cells(df, chunk_rows=10)
    assert sorted(len(r.sample_ids) for r in chunked.collect()) == [5, 5, 10, 10, 10, 10]
    assert sorted(tuple(r) for r in store.unnest_cells(chunked).collect()) == rows


def test_uneven_lists_fail(spark):
    df = spark.createDataFrame([(1, ["p"], ["r", "s"], ["a"])], "cell_idx int, prompts array<string>, references array<string>, predictions array<string>")
    with pytest.raises(Exception, match="differ in length"):
        store.unnest_cells(df).collect()


def test_metrics_export_keeps_present_columns_in_order(spark, tmp_path):
    df = spark.createDataFrame([("e", 1.5, "m")], "experiment string, mean_tps double, model_id string").coalesce(1)
    assert store.export_metrics(df, str(tmp_path / "m")) == ["model_id", "mean_tps", "experiment"]
    text = "".join(open(f).read() for f in glob.glob(str(tmp_path / "m" / "*.csv")))
    assert text.strip() == "model_id,mean_tps,experiment\nm,1.5,e"


def test_exported_values_read_as_python_text(spark, tmp_path):
    df = spark.createDataFrame([("m", True, 1e-05, None)], "model_id string, kv_cache boolean, mean_tps double, error string")
    store.export_metrics(df, str(tmp_path / "m"))
    text = "".join(open(f).read() for f in glob.glob(str(tmp_path / "m" / "*.csv")))
    assert "m,True,,1e-05" in text
    back = store.read_csv(spark, str(tmp_path / "m"), "model_id string, kv_cache boolean, error string, mean_tps double")
    assert [tuple(r) for r in back.collect()] == [("m", True, None, 1e-05)]


def test_brotli_says_what_is_missing(spark, tmp_path):
    try:
        store.write_results(spark.range(3), str(tmp_path / "b"), "brotli")
    except RuntimeError as exc:
        assert "brotli codec" in str(exc)
    else:
        assert spark.read.parquet(str(tmp_path / "b")).count() == 3


def test_prediction_export(spark, tmp_path):
    results = spark.createDataFrame(
        [(1, "ok", "m", "hf", 1.0, 2.0, 3.0, 4.0), (2, "oom", "m", "hf", None, None, None, None)],
        "cell_idx int, status string, model_id string, backend string, exact_match_pct double, "
        "normalized_match_pct double, mean_tps double, mean_total_s double",
    )
    texts = ['say "hi", you', "two\nlines", "  padded ", "back\\slash", "", "plain"]
    samples = spark.createDataFrame(
        [(c, i, t, t, t) for c in (1, 2) for i, t in enumerate(texts)],
        "cell_idx int, sample_idx long, prompt string, reference string, prediction string",
    )
    store.export_predictions(results, samples, str(tmp_path))
    assert os.listdir(tmp_path / "summary") != [] and not os.path.exists(tmp_path / "predictions" / "cell_pos=1")
    files = sorted(glob.glob(str(tmp_path / "predictions" / "cell_pos=0" / "*.csv")))
    lines = pd.concat([pd.read_csv(f, keep_default_na=False) for f in files])
    assert list(lines.columns) == ["prompt", "reference", "prediction"]
    assert list(lines["prediction"]) == texts


def test_work_folder_is_under_the_shared_folder(spark):
    assert work_folder(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


@pytest.mark.parametrize("fmt", ["parquet", "json", "csv"])
def test_first_rows_of_every_format(spark, tmp_path, fmt):
    """In order of files and rows, and by a key with ties and nulls."""
    folder = str(tmp_path / fmt)
    rows = spark.range(300).selectExpr(
        "id", "if(id % 17 = 0, null, cast((id * 37) % 50 as string)) as key", "concat('text ', id) as text"
    )
    rows.repartitionByRange(5, "id").sortWithinPartitions("id").write.format(fmt).option("header", True).save(folder)
    reader = spark.read.format(fmt).schema("id long, key string, text string").option("header", True)
    df = reader.load(folder)
    for n in (0, 1, 59, 60, 61, 150, 299, 300, 1000):
        found = store.head_sample(df, n).collect()
        assert sorted(r.id for r in found) == list(range(min(n, 300)))
        by_key = store.head_sample(df, n, "key").collect()
        whole = sorted(df.collect(), key=lambda r: (r.key is not None, r.key or "", r.id if fmt == "parquet" else 0))
        assert len(by_key) == min(n, 300)
        keys = sorted((r.key is not None, r.key or "") for r in by_key)
        assert keys == [(r.key is not None, r.key or "") for r in whole[:n]]
        if fmt == "parquet":
            assert sorted(r.id for r in by_key) == sorted(r.id for r in whole[:n])


def test_first_rows_move_no_texts(spark, tmp_path):
    spark.range(5000).selectExpr("id", "repeat('t', 50) as text").repartition(6).write.parquet(f"{tmp_path}/t")
    found = store.head_sample(spark.read.parquet(f"{tmp_path}/t"), 1234, "id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "Sort" not in plan
    assert sorted(r.id for r in found.collect()) == list(range(1234))
