"""Helpers shared by the operators: staging, Arrow columns, numpy hashing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

import evalsweep.llm
from evalsweep.sources.workspace import work_folder

# Executors need not have this package installed.
cloudpickle.register_pickle_by_value(evalsweep.llm)

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = 2048) -> None:
    """Let Spark hand Python at most so many rows at a time, if the session has not set a number.

    With long texts the default of 10,000 rows is many times what a step works on.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts the lineage: what follows never computes it again, and a lost executor
    costs no more than the tasks that ran on it.
    """
    path = work_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_batches(
    df: DataFrame,
    work: Callable[[pa.RecordBatch], dict],
    schema: str | StructType,
    start: Callable | None = None,
    size: int = 4 << 20,
) -> DataFrame:
    """Apply ``work`` to pieces of about ``size`` bytes; it returns the columns of ``schema``.

    With ``start``, ``work`` gets what ``start()`` returned as its second
    argument: models and caches that a task makes once.
    """
    kinds = _arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = start() if start else None
        for batch in batches:
            for lo, hi in slices(batch, size):
                part = batch.slice(lo, hi - lo)
                columns = work(part, own) if start else work(part)
                arrays = [pa.array(columns[field.name], field.type) for field in kinds]
                yield pa.RecordBatch.from_arrays(arrays, schema=kinds)

    return df.mapInArrow(run, schema)


def _arrow_schema(schema: str | StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_type

    # A type is taken as it is: names of fields within it need not be DDL.
    fields = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    return pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in fields])


def slices(batch: pa.RecordBatch, size: int, rows: int = 2048) -> list[tuple[int, int]]:
    """Cut a batch so that a piece has few rows and, single long rows aside, few bytes."""
    n = batch.num_rows
    if not n:
        return []
    step = max(1, min(rows, int(n * size / max(1, batch.nbytes))))
    return [(lo, min(n, lo + step)) for lo in range(0, n, step)]


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """Texts of a batch; null counts as empty."""
    return [text or "" for text in batch.column(name).to_pylist()]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row and the offsets of each; null counts as empty."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix, so that every bit depends on every other."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def random_words(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    return mixed(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed * 1_000_003))


class PolyHash:
    """Prefix hashes of a byte string modulo 2**64, over random values of the bytes.

    ``of(starts, ends)`` gives hashes of substrings that do not depend on where
    they stand: prefix differences times the inverse power of the start.
    """

    BASE = 0x5851F42D4C957F2D

    def __init__(self, seed: int = 1):
        self.values = random_words(seed, 256)
        self.base = (self.BASE + 8 * seed) | 1
        self.powers = self.inverses = np.ones(1, U64)

    def _grow(self, n: int) -> None:
        if len(self.powers) > n:
            return
        size = max(n + 1, 1 << 16)
        base = np.full(size, self.base, U64)
        base[0] = 1
        inverse = np.full(size, pow(self.base, -1, 1 << 64), U64)
        inverse[0] = 1
        self.powers, self.inverses = np.multiply.accumulate(base), np.multiply.accumulate(inverse)

    def load(self, data: np.ndarray) -> "PolyHash":
        self._grow(len(data))
        prefix = np.zeros(len(data) + 1, U64)
        np.cumsum(self.values[data] * self.powers[: len(data)], out=prefix[1:])
        self.prefix = prefix
        return self

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.prefix[ends] - self.prefix[starts]) * self.inverses[starts])


def whole_runs(batches: Iterator[pa.RecordBatch], key: str, rows: int = 32768) -> Iterator[pa.Table]:
    """Tables of at least so many rows that never cut a run of equal keys; input sorted by key."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < rows:
            continue
        whole = pa.Table.from_batches(held)
        keys = whole.column(key).to_numpy()
        if keys[0] == keys[-1]:
            continue
        cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1
        yield whole.slice(0, cut)
        held, size = whole.slice(cut).combine_chunks().to_batches(), size - cut
    if held:
        yield pa.Table.from_batches(held)


def run_starts(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, and the end of the last."""
    if not len(keys):
        return np.zeros(1, np.int64)
    return np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)]


def least_reachable(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For n places, the smallest place that each reaches over the links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new
