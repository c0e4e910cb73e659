"""Near-duplicate vectors by cross-polytope hashing.

A vector is turned by a few rounds of random signs and fast Hadamard transforms;
its hash is the axis, with its sign, that it then lies closest to.  Several such
hashes make a table's bucket, and the vector is filed under further buckets in
which its most doubtful hash is replaced by the runner-up.  Vectors that share a
bucket are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalsweep.llm.common import (
    U64,
    least_reachable,
    map_batches,
    mixed,
    random_words,
    run_starts,
    staged,
    whole_runs,
)
from evalsweep.llm.components import connected

# Members of a bucket that one task compares with as many others.
BLOCK = 256


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of rows whose length is a power of two."""
    n, half = x.shape[1], 1
    while half < n:
        y = x.reshape(len(x), n // (2 * half), 2, half)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], 2).reshape(len(x), n)
        half *= 2
    return x / np.sqrt(n)


def bucket_keys(unit: np.ndarray, tables: int, hashes: int, probes: int, rounds: int = 3) -> np.ndarray:
    """Bucket numbers of every row, ``probes`` for each table."""
    n, dim = unit.shape
    width = 1 << max(0, dim - 1).bit_length()
    base = np.zeros((n, width))
    base[:, :dim] = unit
    rows = np.arange(n)
    keys = np.empty((n, tables * probes), U64)
    for table in range(tables):
        best, second, gap = [], [], []
        for h in range(hashes):
            y = base
            for r in range(rounds):
                bits = random_words(1 + ((table * hashes) + h) * rounds + r, width)
                y = hadamard(y * np.where(bits >> U64(63), 1.0, -1.0))
            size = np.abs(y)
            first = size.argmax(1)
            top = size[rows, first]
            size[rows, first] = -1.0
            other = size.argmax(1)
            best.append(2 * first + (y[rows, first] > 0))
            second.append(2 * other + (y[rows, other] > 0))
            gap.append(top - size[rows, other])
        best, second, doubt = np.array(best), np.array(second), np.argsort(gap, 0, kind="stable")
        for probe in range(probes):
            used = best.copy()
            if probe:  # the runner-up in the probe-th most doubtful place
                used[doubt[probe - 1], rows] = second[doubt[probe - 1], rows]
            key = np.full(n, table * 1_000_003 + dim, U64)
            for axis in used:
                key = mixed(key * U64(0x9E3779B97F4A7C15) + axis.astype(U64))
            keys[:, table * probes + probe] = key
    return keys


def _classes(rows: DataFrame, tables: int, hashes: int, probes: int) -> DataFrame:
    """One row per distinct vector of a label: its unit vector and buckets."""

    def work(batch: pa.RecordBatch) -> dict:
        out: dict = {name: [] for name in ("class", "least", "copies", "unit", "keys")}
        vectors = batch.column("vector").to_pylist()
        dims: dict[int, list[int]] = {}
        for i, vector in enumerate(vectors):
            dims.setdefault(len(vector), []).append(i)
        label = batch.column("label").cast(pa.int64()).to_numpy().view(U64)
        for places in dims.values():
            x = np.array([vectors[i] for i in places], np.float64)
            x /= np.abs(x).max(1, keepdims=True)
            x /= np.sqrt((x * x).sum(1, keepdims=True))
            keys = mixed(bucket_keys(x, tables, hashes, probes) ^ mixed(label[places] + U64(1))[:, None])
            # In order within a table: both rows of a pair then agree on the first they share.
            keys = np.sort(keys.reshape(len(x), tables, probes), 2).reshape(len(x), -1)
            out["unit"] += [row.tobytes() for row in x]
            out["keys"] += list(keys.view(np.int64))
            for name in ("class", "least", "copies"):
                out[name] += batch.column(name).take(pa.array(places)).to_pylist()
        return out

    schema = "class long, least long, copies long, unit binary, keys array<long>"
    return map_batches(rows, work, schema)


def _shared_first(keys: np.ndarray, a: np.ndarray, b: np.ndarray, here: np.ndarray, probes: int) -> np.ndarray:
    """Whether ``here`` is the first bucket that both rows of a pair are filed under."""
    out = np.zeros(len(a), bool)
    open_ = np.arange(len(a))
    for table in range(keys.shape[1] // probes):
        part = slice(table * probes, (table + 1) * probes)
        ka, kb = keys[a[open_], part], keys[b[open_], part]
        same = (ka[:, :, None] == kb[:, None, :]).any(2)
        hit = same.any(1)
        first = ka[np.arange(len(ka)), same.argmax(1)]
        out[open_[hit]] = first[hit] == here[open_[hit]]
        open_ = open_[~hit]
    return out


def _compared(whole: pa.Table, threshold: float, probes: int) -> dict:
    """Links found in the buckets of a table sorted by bucket and block pair.

    A pair is counted in the first bucket that it shares, so that sums over all
    buckets count it once; no pair leaves the task.
    """
    bucket = whole.column("bucket").to_numpy()
    side = whole.column("side").to_numpy()
    copies = whole.column("copies").to_numpy()
    least = whole.column("least").to_numpy()
    class_ = whole.column("class").to_numpy()
    keys = np.array(whole.column("keys").combine_chunks().flatten().to_numpy()).reshape(len(bucket), -1)
    units = whole.column("unit").to_pylist()
    starts = run_starts(whole.column("part").to_numpy())
    sizes = np.diff(starts)
    found_a, found_b = [], []

    def keep(a: np.ndarray, b: np.ndarray) -> None:
        cross = (side[a] == 2) | (side[a] != side[b])
        a, b = a[cross], b[cross]
        first = _shared_first(keys, a, b, bucket[a], probes)
        found_a.append(a[first])
        found_b.append(b[first])

    # Buckets hold vectors of one dimension: it is part of the key.
    small = np.repeat(sizes <= 24, sizes)
    run = np.repeat(np.arange(len(sizes)), sizes)
    for gap in range(1, 24):
        a = np.flatnonzero(small[:-gap] & (run[:-gap] == run[gap:])) if len(run) > gap else np.zeros(0, np.int64)
        for lo in range(0, len(a), 8192):
            i = a[lo : lo + 8192]
            for dim in {len(units[p]) for p in i.tolist()}:
                j = np.array([p for p in i.tolist() if len(units[p]) == dim])
                x = np.frombuffer(b"".join([units[p] for p in j.tolist()])).reshape(len(j), -1)
                y = np.frombuffer(b"".join([units[p + gap] for p in j.tolist()])).reshape(len(j), -1)
                j = j[np.einsum("ij,ij->i", x, y) >= threshold]
                keep(j, j + gap)
    for place in np.flatnonzero(sizes > 24).tolist():
        lo, hi = starts[place], starts[place + 1]
        x = np.frombuffer(b"".join(units[lo:hi])).reshape(hi - lo, -1)
        for part in range(0, hi - lo, 512):
            a, b = np.nonzero(x[part : part + 512] @ x[part:].T >= threshold)
            a, b = a + part, b + part
            a, b = a[a < b], b[a < b]
            for cut in range(0, len(a), 1 << 16):
                keep(lo + a[cut : cut + (1 << 16)], lo + b[cut : cut + (1 << 16)])
    a = np.concatenate([np.zeros(0, np.int64), *found_a])
    b = np.concatenate([np.zeros(0, np.int64), *found_b])
    if not len(a):
        return {name: np.zeros(0, np.int64) for name in ("class", "least", "links", "root")}
    links = np.bincount(a, copies[b], len(class_)) + np.bincount(b, copies[a], len(class_))
    # The same vector stands in several rows; nodes are numbered in the order of their ids.
    ids, node = np.unique(least, return_inverse=True)
    root = ids[least_reachable(len(ids), node[a], node[b])]
    classes, first, place = np.unique(class_, return_index=True, return_inverse=True)
    links = np.bincount(place, links).astype(np.int64)
    some = links > 0
    return {
        "class": classes[some],
        "least": least[first][some],
        "links": links[some],
        "root": root[node[first]][some],
    }


def near_duplicates(
    vectors: DataFrame,
    id_column: str,
    vector_column: str,
    label_column: str,
    threshold: float = 0.98,
    tables: int = 6,
    hashes: int = 3,
    probes: int = 3,
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row.

    Rows link when their labels are equal and their cosine, in double precision,
    reaches the threshold; pairs that share no bucket are missed, others never.
    Rows with a null id or label, or a vector that is null, empty, all zeros or
    holds a null or non-finite component, link with nothing and are kept.  Every
    repeated row counts as a vector of its own; rows that share an id are one
    node of the components.  Equal vectors are compared once, as a class.  A cosine
    equal to the threshold links.  Other columns are left out; an empty table gives
    no rows.
    """
    if probes > hashes + 1:
        raise ValueError("each probe after the first replaces another hash")
    rows = vectors.select(
        F.col(id_column).cast("long").alias("vec_id"),
        F.col(vector_column).cast("array<double>").alias("vector"),
        F.col(label_column).cast("long").alias("label"),
    )
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("vector", lambda x: x != 0)
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(~bad & some, F.lit(False))
    rows = rows.withColumn("class", F.when(usable, F.xxhash64("label", "vector")))
    distinct = (
        rows.filter("class is not null")
        .groupBy("class", "label", "vector")
        .agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    )
    classes = staged(_classes(distinct, tables, hashes, probes), "vector-classes")
    filed = classes.select("class", F.explode("keys").alias("bucket")).distinct()
    crowded = filed.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    # Large buckets are cut into blocks, and each pair of blocks meets in a task.
    met = filed.join(crowded, "bucket").select(
        "bucket",
        "class",
        F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"),
    )
    met = met.withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select(
        "bucket",
        "class",
        F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("part"),
        F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") > F.col("other")).cast("int")).alias("side"),
    )
    work = met.join(classes, "class").repartition("part").sortWithinPartitions("part")
    schema = "class long, least long, links long, root long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in whole_runs(batches, "part", 8192):
            columns = _compared(whole, threshold, probes)
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in columns.items()})

    links = staged(work.mapInArrow(run, schema), "vector-links")
    tied = connected(links.select(F.col("least").alias("u"), F.col("root").alias("v")))
    counted = links.groupBy("class").agg(F.sum("links").alias("links"))
    judged = (
        classes.select("class", "least", "copies")
        .join(counted, "class", "left")
        .join(tied.withColumnRenamed("node", "least"), "least", "left")
        .select(
            "class",
            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("component", "least").alias("component_id"),
        )
    )
    out = rows.select("vec_id", "class").join(judged, "class", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
