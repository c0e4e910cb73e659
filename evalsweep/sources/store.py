"""Datasets in, result tables in and out."""

from __future__ import annotations

import re
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalsweep.functions.text import plain_text
from evalsweep.operators.inspect import cell_position
from evalsweep.operators.rollup import ok_cells
from evalsweep.operators.rules import CODECS
from evalsweep.sources.workspace import work_folder

# Fixed values -----------------------------------------------------------
EXPORT_COLUMNS = (
    "model_id",
    "backend",
    "quantization",
    "kv_cache",
    "prefix_cache",
    "max_new_tokens",
    "status",
    "error",
    "n_samples",
    "exact_match_pct",
    "normalized_match_pct",
    "judge_avg_score",
    "mean_tps",
    "mean_total_s",
    "peak_vram_mb",
    "avg_vram_mb",
    "avg_power_w",
    "avg_gpu_util_pct",
    "hw_sample_count",
    "experiment",
)
SWEEP_FILE = r"sweep_[^/]*\.parquet"
LISTED_SWEEPS = 10
# Sample numbers that an export keeps together.
EXPORT_BLOCK = 100_000
# ------------------------------------------------------------------------

# The canonical result row.
RESULT_COLUMNS = {
    "experiment": "string",
    "run_ts": "string",
    "cell_idx": "int",
    "model_id": "string",
    "backend": "string",
    "quantization": "string",
    "kv_cache": "boolean",
    "prefix_cache": "boolean",
    "max_new_tokens": "int",
    "status": "string",
    "error": "string",
    "n_samples": "bigint",
    "mean_ttft_s": "double",
    "mean_tps": "double",
    "mean_total_s": "double",
    "exact_match_pct": "double",
    "normalized_match_pct": "double",
    "judge_avg_score": "double",
    "peak_vram_mb": "double",
    "avg_vram_mb": "double",
    "peak_power_w": "double",
    "avg_power_w": "double",
    "avg_gpu_util_pct": "double",
    "avg_cpu_util_pct": "double",
    "avg_ram_used_mb": "double",
    "hw_sample_count": "bigint",
    "gpu_available": "boolean",
}
CELL_PARTITIONS = ("experiment", "run_ts", "cell_idx")


# Datasets ----------------------------------------------------------------


def scan_dataset(
    spark: SparkSession,
    path: str,
    split: str | None = None,
    split_col: str = "split",
    fmt: str = "parquet",
    schema: T.StructType | str | None = None,
    **options: str,
) -> DataFrame:
    """A dataset, or one named split of it.

    The split is a filter on its column: it prunes folders when the dataset is
    partitioned by that column and is pushed to the scan otherwise.
    """
    reader = spark.read.format(fmt).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    table = reader.load(path)
    return table if split is None else table.filter(F.col(split_col) == split)


def _first_files(df: DataFrame, n: int) -> tuple[list[str], str | None, int]:
    """Files that the first n rows fill, the file in which they end, and how many of its rows are meant."""
    per_file = df.groupBy(F.col("_metadata.file_path").alias("_file")).agg(F.count(F.lit(1)).alias("_rows"))
    whole: list[str] = []
    # In order of names; no more of them come to the driver than hold n rows.
    for row in per_file.orderBy("_file").toLocalIterator():
        if row["_rows"] > n:
            return whole, row["_file"], n
        whole.append(row["_file"])
        n -= row["_rows"]
        if not n:
            break
    return whole, None, 0


def _nth(keys: DataFrame, order: Sequence[str], n: int) -> T.Row | None:
    """The n-th row of a table of keys, or None if it has fewer; no task sorts more than a range of them."""
    spark = keys.sparkSession
    path = work_folder(spark, "sorted-keys")
    keys.orderBy(*order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    ranges = spark.read.schema(T.StructType([*keys.schema, T.StructField("_range", T.IntegerType())])).parquet(path)
    # One row per shuffle partition.
    for row in sorted(ranges.groupBy("_range").count().collect()):
        if n <= row["count"]:
            own = ranges.filter(F.col("_range") == row["_range"]).drop("_range")
            return own.orderBy(*order).offset(n - 1).first()
        n -= row["count"]
    return None


def head_sample(
    df: DataFrame, max_samples: int, order_by: str | Sequence[str] | None = None
) -> DataFrame:
    """The first ``max_samples`` rows in source order, bad rows included.

    Without ``order_by`` the order is that of the files and their rows: rows are
    counted per file, and only the file in which the sample ends is cut.  With it,
    the keys alone are range-sorted, the last key of the sample is looked up, and
    rows up to it are filtered where they lie.  Either way no task holds a large
    sample and no text moves.  Ties go by place in the files, where rows have one
    (Parquet); in other formats rows that tie with the last key are ordered by
    their columns.  A table that is not read from files is ordered as a whole.
    """
    order = [] if order_by is None else [order_by] if isinstance(order_by, str) else list(order_by)
    if max_samples <= 0:
        return df.limit(0)
    place = {"_file": F.col("_metadata.file_path"), "_at": F.col("_metadata.row_index")}
    try:
        placed = df.select("*", *[column.alias(name) for name, column in place.items()])
    except AnalysisException:
        placed = None
    if not order:
        file = F.col("_metadata.file_path")
        whole, last, n = _first_files(df, max_samples)
        kept = df.filter(file < last) if last else df.filter(file <= whole[-1]) if whole else df.limit(0)
        if last is None:
            return kept
        if placed is None:
            # One task reads the file from its beginning, as far as it has to.
            return kept.unionAll(df.filter(file == last).coalesce(1).limit(n))
        cut = placed.filter((F.col("_file") < last) | ((F.col("_file") == last) & (F.col("_at") < n)))
        return cut.select(*df.columns)
    if placed is None:
        try:
            df.select(place["_file"])
        except AnalysisException:
            return df.orderBy(*order).limit(max_samples)
    rows, names = (placed, [*order, *place]) if placed is not None else (df, order)
    last = _nth(rows.select(*names), names, max_samples)
    if last is None:
        return df
    # Nulls come first, as in a sort.
    limits = {name: F.lit(last[name]).cast(rows.schema[name].dataType) for name in names}
    before, tied = F.lit(False), F.lit(True)
    for name in names:
        own = F.col(name)
        less = F.coalesce(own < limits[name], own.isNull() & limits[name].isNotNull())
        before, tied = before | (tied & less), tied & own.eqNullSafe(limits[name])
    if placed is not None:
        return rows.filter(before | tied).select(*df.columns)
    under = df.filter(before)
    return under.unionAll(df.filter(tied).orderBy(*df.columns).limit(max_samples - under.count()))


# Result files written by other tools --------------------------------------


def conform_results(df: DataFrame) -> DataFrame:
    """Cast to the canonical result schema; missing columns become NULL.

    Other writers may infer a type from the values alone, so a column of NULLs
    can arrive as a number and a count as a double.
    """
    return df.select(
        *[
            (F.col(name) if name in df.columns else F.lit(None)).cast(kind).alias(name)
            for name, kind in RESULT_COLUMNS.items()
        ]
    )


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """One result file in the canonical schema; a missing file is an error."""
    try:
        found = spark.read.parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no result file at {path}") from exc
        raise
    return conform_results(found)


def _sweep_files(spark: SparkSession, folder: str) -> DataFrame:
    """(name, path) of the sweep files directly in a folder; only paths are listed, no data is read.

    A sweep is a file, or a folder of files as Spark writes it.
    """
    literal = re.sub(r"([\\\[\]{}*?])", r"\\\1", folder.rstrip("/"))
    try:
        listed = spark.read.format("binaryFile").load(f"{literal}/sweep_*.parquet").select("path")
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        listed = spark.createDataFrame([], "path string")
    whole = F.regexp_extract("path", rf"^(.*/{SWEEP_FILE})(?:/[^/]*)?$", 1)
    return (
        listed.select(whole.alias("path"))
        .filter(F.col("path") != "")
        .distinct()
        .select(F.regexp_extract("path", "[^/]*$", 0).alias("name"), "path")
    )


def latest_sweep(spark: SparkSession, folder: str) -> DataFrame:
    """Results of the lexicographically last sweep file; only that file is read."""
    last = _sweep_files(spark, folder).agg(F.max(F.struct("name", "path")).alias("last")).first()["last"]
    if last is None:
        raise FileNotFoundError(f"no sweep files in {folder}")
    return read_results(spark, last["path"])


def latest_runs(results: DataFrame) -> DataFrame:
    """Rows of the newest run of each experiment in a result table."""
    newest = results.groupBy("experiment").agg(F.max("run_ts").alias("run_ts"))
    return results.join(newest, ["experiment", "run_ts"], "left_semi")


def sweep_name(experiment: Column, run_ts: Column) -> Column:
    """File-style name of a run: blanks to underscores, lower case."""
    token = F.lower(F.replace(experiment, F.lit(" "), F.lit("_")))
    return F.concat(F.lit("sweep_"), token, F.lit("_"), run_ts, F.lit(".parquet"))


def number_last(names: DataFrame, n: int = LISTED_SWEEPS) -> DataFrame:
    """The last ``n`` distinct names, ascending and numbered from 1."""
    last = names.select("name").distinct().orderBy(F.desc("name")).limit(n)
    # At most n names are gathered.
    listed = last.agg(F.array_sort(F.collect_list("name")).alias("names"))
    return listed.select(F.posexplode("names").alias("_pos", "name")).select(
        (F.col("_pos") + 1).cast("int").alias("position"), "name"
    )


def list_sweeps(results: DataFrame, n: int = LISTED_SWEEPS) -> DataFrame:
    """The last runs of a result table."""
    return number_last(results.select(sweep_name(F.col("experiment"), F.col("run_ts")).alias("name")), n)


def list_sweep_files(spark: SparkSession, folder: str, n: int = LISTED_SWEEPS) -> DataFrame:
    """The last sweep files of a folder."""
    return number_last(_sweep_files(spark, folder), n)


# Writing -------------------------------------------------------------------


def write_results(df: DataFrame, path: str, codec: str = "snappy") -> None:
    """Parquet with one of the five codecs."""
    if codec not in CODECS:
        raise ValueError(f"compression must be one of {sorted(CODECS)}, got {codec!r}")
    try:
        df.write.option("compression", codec).parquet(path)
    except Exception as exc:
        if codec == "brotli" and "brotli" in str(exc).lower():
            raise RuntimeError("brotli needs the Parquet brotli codec on Spark's class path") from exc
        raise


def write_cells(
    df: DataFrame, path: str, partitions: Sequence[str] = CELL_PARTITIONS, gather: bool = True
) -> None:
    """Store cells; a cell that is already there is replaced, others stay.

    Only the partitions present in ``df`` are written, so re-running a failed or
    lost cell costs one cell.  ``gather`` brings a cell's rows together for
    larger files: a rebalance, which splits a cell that is too large for one
    task and needs no second pass over ``df``.  Rows that already lie cell by
    cell, such as the output of ``batch_infer``, are written where they are with
    ``gather=False``.
    """
    if gather:
        df = df.hint("rebalance", *[F.col(name) for name in partitions])
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partitions)
        .parquet(path)
    )


def read_cells(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None
) -> DataFrame:
    """Cells written by ``write_cells``; give the schema to fix partition types."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def partition_folders(spark: SparkSession, path: str, name: str, value: str | None = None) -> list[tuple[str, str]]:
    """(value, folder) of the partition folders ``name=...`` below a path; all, or those of one value.

    One listing of one folder: no file below is listed or opened.
    """
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(root):
        return []
    found = []
    for status in system.listStatus(root):
        own, _, text = status.getPath().getName().partition("=")
        if own == name and status.isDirectory() and value in (None, unquote(text)):
            found.append((unquote(text), status.getPath().toString()))
    return found


def run_folders(spark: SparkSession, path: str, run_ts: str) -> list[tuple[str, str]]:
    """(experiment, folder) of what ``write_cells`` stored for one run: a listing per experiment."""
    outer, inner, _ = CELL_PARTITIONS
    return [
        (experiment, folder)
        for experiment, below in partition_folders(spark, path, outer)
        for _, folder in partition_folders(spark, below, inner, run_ts)
    ]


def stored_cells(spark: SparkSession, path: str, run_ts: str) -> list[tuple[str, str, int]]:
    """Keys of one run's stored cells, by the names of their folders.

    The driver holds a name per cell of this run; other runs cost a listing per
    experiment, and no data file is opened.
    """
    number = CELL_PARTITIONS[-1]
    return [
        (experiment, run_ts, int(cell))
        for experiment, folder in run_folders(spark, path, run_ts)
        for cell, _ in partition_folders(spark, folder, number)
    ]


def read_run(spark: SparkSession, path: str, schema: T.StructType | str, run_ts: str) -> DataFrame:
    """Cells of one run; the folders of other runs are not listed."""
    folders = [folder for _, folder in run_folders(spark, path, run_ts)]
    reader = spark.read.schema(schema).option("basePath", path)
    return reader.parquet(*folders) if folders else spark.createDataFrame([], schema)


# Exports -------------------------------------------------------------------

_CSV = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def write_csv(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """CSV with quotes doubled inside quoted fields."""
    df.write.options(**_CSV).partitionBy(*partition_by).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.options(**_CSV, multiLine="true").schema(schema).csv(path)


def _as_text(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """Booleans and doubles the way Python writes them; NULL stays an empty field."""
    shown = (T.BooleanType, T.DoubleType)
    return [
        F.when(F.col(name).isNotNull(), plain_text(F.col(name), df.schema[name].dataType)).alias(name)
        if isinstance(df.schema[name].dataType, shown)
        else F.col(name)
        for name in columns
    ]


def export_metrics(results: DataFrame, path: str) -> list[str]:
    """The metric columns that are present, in their fixed order; returns them."""
    columns = [name for name in EXPORT_COLUMNS if name in results.columns]
    write_csv(results.select(*_as_text(results, columns)), path)
    return columns


def export_predictions(
    results: DataFrame, samples: DataFrame, path: str, keys: Sequence[str] = ("cell_idx",)
) -> None:
    """Prompts, references and predictions of each good cell, and a summary row.

    Rows are gathered by cell and block of sample numbers, without a sampling
    pass, and ordered within a file; a large cell becomes many files.
    """
    keys = list(keys)
    good = ok_cells(results)
    rows = samples.join(good.select(*keys), keys, "left_semi")
    block = F.floor(F.col("sample_idx") / EXPORT_BLOCK)
    rows = rows.withColumn("_block", block).hint("rebalance", *[F.col(name) for name in (*keys, "_block")])
    rows = rows.sortWithinPartitions(*keys, "sample_idx")
    others = [k for k in keys if k != "cell_idx"]
    write_csv(
        rows.select(*others, cell_position().alias("cell_pos"), "prompt", "reference", "prediction"),
        f"{path}/predictions",
        [*others, "cell_pos"],
    )
    metrics = ("exact_match_pct", "normalized_match_pct", "mean_tps", "mean_total_s")
    write_csv(
        good.select(
            *others,
            cell_position().alias("cell_pos"),
            F.col("model_id").alias("model"),
            "backend",
            *_as_text(good, metrics),
        ),
        f"{path}/summary",
        [*others, "cell_pos"],
    )


# Nested form -----------------------------------------------------------------

NESTED = {"prompt": "prompts", "reference": "references", "prediction": "predictions"}


def nest_cells(
    samples: DataFrame,
    keys: Sequence[str] = ("cell_idx",),
    chunk_rows: int = 1024,
    chunk_bytes: int = 64 * 1024 * 1024,
) -> DataFrame:
    """Parallel lists of a cell's samples in order.

    A cell is cut into chunks of ``chunk_rows`` sample numbers, and a chunk whose
    texts exceed ``chunk_bytes`` into parts, which end with the sample that
    reaches that size: no row or task ever has to hold a whole large cell.  Sample
    numbers must be unique within a cell.
    """
    keys = list(keys)
    item = F.struct("sample_idx", *NESTED)
    size = sum((F.coalesce(F.octet_length(F.col(name)), F.lit(0)) for name in NESTED), F.lit(0)).cast("long")
    before = Window.partitionBy(*keys, "chunk_idx").orderBy("sample_idx").rowsBetween(Window.unboundedPreceding, -1)
    grouped = (
        samples.withColumn("chunk_idx", F.expr(f"sample_idx div {int(chunk_rows)}"))
        .withColumn("part_idx", F.floor(F.coalesce(F.sum(size).over(before), F.lit(0)) / F.lit(chunk_bytes)))
        .groupBy(*keys, "chunk_idx", "part_idx")
        .agg(F.array_sort(F.collect_list(item)).alias("_items"))
    )
    return grouped.select(
        *keys,
        "chunk_idx",
        "part_idx",
        F.col("_items.sample_idx").alias("sample_ids"),
        *[F.col(f"_items.{name}").alias(plural) for name, plural in NESTED.items()],
    )


def unnest_cells(nested: DataFrame, keys: Sequence[str] = ("cell_idx",)) -> DataFrame:
    """One row per sample again; lists of different lengths fail the job.

    Rows of other writers have no ``sample_ids``: their samples are numbered by
    position from 0.
    """
    numbered = "sample_ids" in nested.columns
    lists = [*NESTED.values(), *(["sample_ids"] if numbered else [])]
    uneven = F.lit(False)
    for name in lists[1:]:
        uneven = uneven | (F.size(name) != F.size(lists[0]))
    zipped = F.when(
        uneven, F.raise_error(F.lit("parallel lists of a cell differ in length"))
    ).otherwise(F.arrays_zip(*lists))
    sample_idx = F.col("_s.sample_ids") if numbered else F.col("_pos").cast("bigint")
    return nested.select(*keys, F.posexplode(zipped).alias("_pos", "_s")).select(
        *keys,
        sample_idx.alias("sample_idx"),
        *[F.col(f"_s.{plural}").alias(name) for name, plural in NESTED.items()],
    )


def read_result_samples(spark: SparkSession, path: str) -> DataFrame:
    """Samples of the good cells of a result file that keeps them as lists."""
    return unnest_cells(ok_cells(spark.read.parquet(path)))
