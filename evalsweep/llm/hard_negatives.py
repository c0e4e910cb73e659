"""Hard negatives: candidate blocks along a Hilbert curve, chosen by their zone maps.

Vectors are rotated by the singular vectors of their second moments and ordered
along a Hilbert curve through their first axes.  Neighbours on the curve fill
blocks of bounded size, each one row of a Parquet table, with the least and
greatest value of every rotated component and of the label: its zone map.  An
interval product of an anchor and a zone map bounds all scores in the block, so
that an anchor reads only blocks which can hold one of its results:

1. Positives: the anchor's own block gives a floor, its k-th best score of the
   same label; then every block whose upper bound reaches the floor is read.
2. Windows: each positive's score gives a window of negative scores.  A few
   promising blocks give floors; then every block whose bounds meet a window, at
   or above its floor, is read.

Floors only leave out blocks that cannot change a result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalsweep.llm.common import U64, _arrow_schema, map_batches, staged
from evalsweep.llm.inner_products import EXACT, LONG, best_of

# Axes and bits of the curve: 60 of 63 bits are used.
AXES, BITS = 6, 10
# Sums of products below this are exact in single precision.
EXACT_SINGLE = float(2**24)


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of grid cells, one row each, ``bits`` bits per axis."""
    x = [column.astype(U64) for column in cells.T]
    zero = U64(0)
    step = 1 << (bits - 1)
    while step > 1:
        bit, below = U64(step), U64(step - 1)
        for i in range(len(x)):
            hit = (x[i] & bit) > zero
            swap = np.where(hit, zero, (x[0] ^ x[i]) & below)
            x[0] = np.where(hit, x[0] ^ below, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
        step >>= 1
    for i in range(1, len(x)):  # Gray code
        x[i] = x[i] ^ x[i - 1]
    turn, step = np.zeros(len(cells), U64), 1 << (bits - 1)
    while step > 1:
        turn = np.where((x[-1] & U64(step)) > zero, turn ^ U64(step - 1), turn)
        step >>= 1
    out = np.zeros(len(cells), U64)
    for bit in range(bits - 1, -1, -1):
        for column in x:
            out = out << U64(1) | ((column ^ turn) >> U64(bit) & U64(1))
    return out.astype(np.int64)


def whole_vectors(vectors: DataFrame, scale: int) -> DataFrame:
    """``(id, label, dim, v)`` with floor(scale * x); ``v`` is the bytes of doubles, which are whole numbers."""

    def work(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"id": [], "label": [], "dim": [], "v": []}
        for key, label, vector in zip(*(batch.column(c).to_pylist() for c in ("id", "label", "vector"))):
            if key is None or label is None or not vector or None in vector:
                continue
            x = np.floor(np.array(vector, np.float64) * scale) + 0.0  # no negative zero
            if np.isfinite(x).all():
                for name, value in zip(out, (key, label, len(x), x.tobytes())):
                    out[name].append(value)
        return out

    return map_batches(vectors, work, "id long, label long, dim int, v binary")


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def axes_of(rows: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each dimension the singular vectors of all rows, largest first, and the root mean squares along them.

    Tasks add up outer products: the driver gets one matrix per task and dimension.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        counts: dict[int, int] = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                x = _matrix(batch.filter(pa.array(dims == dim)).column("v"), dim)
                sums[dim], counts[dim] = sums.get(dim, 0) + x.T @ x, counts.get(dim, 0) + len(x)
        yield pa.RecordBatch.from_pydict(
            {
                "dim": pa.array(sums, pa.int32()),
                "n": pa.array([counts[d] for d in sums], pa.int64()),
                "gram": pa.array([s.ravel() for s in sums.values()], pa.list_(pa.float64())),
            }
        )

    total: dict[int, list] = {}
    for row in rows.select("dim", "v").mapInArrow(work, "dim int, n long, gram array<double>").toLocalIterator():
        own = total.setdefault(row["dim"], [0, 0.0])
        own[0] += row["n"]
        own[1] = own[1] + np.array(row["gram"]).reshape(row["dim"], -1)
    out = {}
    for dim, (n, gram) in total.items():
        if np.isfinite(gram).all():
            spread, turn = np.linalg.eigh(gram)
            out[dim] = turn[:, ::-1].copy(), np.sqrt(np.maximum(spread[::-1], 0.0) / n)
        else:  # lengths whose squares overflow are left as they are
            out[dim] = np.eye(dim), np.ones(dim)
    return out


def along_curve(x: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Places on the curve of rotated vectors: three root mean squares to each side are told apart."""
    n = min(AXES, x.shape[1])
    unit = x[:, :n] / np.maximum(3.0 * spread[:n], 1e-300)
    cells = np.clip((unit + 1.0) * (1 << (BITS - 1)), 0, (1 << BITS) - 1)
    return hilbert(np.nan_to_num(cells), BITS)


BLOCK = (
    "block long, dim int, low array<double>, high array<double>, label_low long, label_high long, "
    "ids binary, labels binary, vectors binary"
)


def blocks_of(rows: DataFrame, axes: dict, block_bytes: int, task_bytes: int = 32 << 20) -> DataFrame:
    """Blocks along the curve with their zone maps, in rotated components."""

    def place(batch: pa.RecordBatch) -> dict:
        dims = batch.column("dim").to_numpy()
        at = np.zeros(len(dims), np.int64)
        for dim in np.unique(dims).tolist():
            own = dims == dim
            x = _matrix(batch.filter(pa.array(own)).column("v"), dim)
            at[own] = along_curve(x @ axes[dim][0], axes[dim][1])
        return {"at": at} | {name: batch.column(name) for name in ("id", "label", "dim", "v")}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []

        def block(whole: pa.Table, dim: int, number: int) -> pa.RecordBatch:
            v = _matrix(whole.column("v"), dim)
            x = v @ axes[dim][0]
            labels = whole.column("label").to_numpy()
            values = {
                "block": number, "dim": dim, "low": x.min(0), "high": x.max(0),
                "label_low": labels.min(), "label_high": labels.max(),
                "ids": whole.column("id").to_numpy().tobytes(), "labels": labels.tobytes(), "vectors": v.tobytes(),
            }
            return pa.RecordBatch.from_pydict({k: [value] for k, value in values.items()}, schema=kinds)

        def cut(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, number
            if not held:
                return
            whole = pa.Table.from_batches(held)
            dims = whole.column("dim").to_numpy()
            lo = 0
            while lo < len(dims):
                dim = int(dims[lo])
                most = max(1, block_bytes // (8 * dim))
                other = np.flatnonzero(dims[lo : lo + most] != dim)
                hi = lo + (int(other[0]) if len(other) else min(most, len(dims) - lo))
                if hi == len(dims) and hi - lo < most and not last:
                    break
                yield block(whole.slice(lo, hi - lo), dim, number)
                number, lo = number + 1, hi
            held = whole.slice(lo).combine_chunks().to_batches() if lo < len(dims) else []

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                yield from cut(False)
        yield from cut(True)

    lists = pa.list_(pa.float64())
    kinds = pa.schema(
        [("block", pa.int64()), ("dim", pa.int32()), ("low", lists), ("high", lists), ("label_low", pa.int64()),
         ("label_high", pa.int64()), ("ids", pa.binary()), ("labels", pa.binary()), ("vectors", pa.binary())]
    )
    placed = map_batches(rows, place, "at long, id long, label long, dim int, v binary")
    n_bytes = rows.agg(F.sum(F.octet_length("v"))).first()[0] or 0
    cores = rows.sparkSession.sparkContext.defaultParallelism
    tasks = max(-(-n_bytes // task_bytes), min(cores, -(-n_bytes // block_bytes)), 1)
    order = ["dim", "at", "id", "label"]
    ranged = placed.repartitionByRange(int(tasks), *order).sortWithinPartitions(*order)
    return staged(ranged.mapInArrow(pack, BLOCK), "negative-blocks")


REQUEST = "block long, chunk int, dim int, nos binary"
FOUND = "no long, win int, id long, score long"
# Pairs of an anchor and a zone, or a row, that a step holds at once.
PAIRS = 1 << 19


def meet(left: DataFrame, right: DataFrame, keys: list[str], work: Callable, schema: str) -> DataFrame:
    """``work(key, left, right)`` of both sides' rows with equal keys; it yields batches of ``schema``.

    A cogroup takes one table back; here a group can give much more than it holds.
    """
    kinds = _arrow_schema(schema)

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, F.struct(*(c for c in df.columns if c not in keys)).alias(name))

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[pa.RecordBatch]] = {"left": [], "right": []}
        for batch in batches:
            for name, own in held.items():
                own.append(pa.RecordBatch.from_struct_array(batch.column(name).drop_null()))
        sides = [pa.Table.from_batches(own) for own in held.values()]
        if all(own.num_rows for own in sides):
            for columns in work(tuple(x.as_py() for x in key), *sides):
                yield pa.RecordBatch.from_pydict(columns, schema=kinds)

    both = side(left, "left").unionByName(side(right, "right"), allowMissingColumns=True)
    return both.groupBy(*keys).applyInArrow(run, schema)


def _lists(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of equal length, one row each."""
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _windows(a: pa.Table) -> np.ndarray:
    """What anchors look for: (low / high / floor, anchor, window); scores in [low, high], at or above the floor."""
    return np.stack([_lists(a.column(c)) for c in ("low", "high", "floor")])


def bounds(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest product that each row of x can have with any vector of each zone."""
    up, down = np.maximum(x, 0.0), np.minimum(x, 0.0)
    least, most = up @ low.T + down @ high.T, up @ high.T + down @ low.T
    # More than rotating and adding in doubles can be off by.
    size = np.sqrt((np.maximum(np.abs(low), np.abs(high)) ** 2).sum(1))
    slack = 1.0 + 1e-9 * np.sqrt((x * x).sum(1))[:, None] * size
    return least - slack, most + slack


def choose(anchors: DataFrame, blocks: DataFrame, axes: dict, same: bool, mode: str, chunks: int, groups: int) -> DataFrame:
    """Which blocks the anchors of a chunk must read: a row names a block and some of the anchors.

    ``nos`` holds their numbers, each less the one before it: where neighbours
    all ask for a block, what is stored and sent is next to nothing.
    ``mode`` is ``own`` (the block an anchor lies in), ``lead`` (the two blocks
    whose middle scores lie nearest to the top of the windows) or ``all`` (those
    whose bounds meet a window).  ``same`` looks for rows of the anchor's label,
    otherwise for rows of others.
    """
    zones = blocks.select("block", "dim", "low", "high", "label_low", "label_high")
    zones = zones.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int"))
    left = anchors.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = zones.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

    def work(key: tuple, a: pa.Table, z: pa.Table) -> Iterator[dict]:
        dim, chunk, _ = key
        turn = axes[dim][0]
        a = a.sort_by("no")
        low, high = _lists(z.column("low")), _lists(z.column("high"))
        names = z.column("block").to_numpy()
        label_low, label_high = z.column("label_low").to_numpy(), z.column("label_high").to_numpy()
        step = max(1, PAIRS // len(names))
        for lo in range(0, a.num_rows, step):
            part = a.slice(lo, step)
            labels, windows = part.column("label").to_numpy()[:, None], _windows(part)
            if same:
                able = (label_low <= labels) & (labels <= label_high)
            else:
                able = (label_low != labels) | (label_high != labels)
            x = _matrix(part.column("v"), dim) @ turn
            if mode == "own":
                needed = able & (names == part.column("block").to_numpy()[:, None])
            elif mode == "lead":
                middle = x @ ((low + high) / 2).T
                far = np.where(able, np.abs(middle - windows[1].max(1)[:, None]), np.inf)
                nearest = np.argsort(far, 1, kind="stable")[:, :2]
                needed = np.zeros(far.shape, bool)
                np.put_along_axis(needed, nearest, True, 1)
                needed &= able
            else:
                least, most = bounds(x, low, high)
                needed = np.zeros(least.shape, bool)
                for from_, to, floor in windows.transpose(2, 0, 1):
                    from_ = np.maximum(from_, floor)
                    needed |= (most >= from_[:, None]) & (least <= to[:, None]) & (from_ <= to)[:, None]
                needed &= able
            nos = part.column("no").to_numpy()
            asked = np.flatnonzero(needed.any(0))
            yield {
                "block": names[asked],
                "chunk": np.full(len(asked), chunk, np.int32),
                "dim": np.full(len(asked), dim, np.int32),
                "nos": [np.diff(nos[needed[:, b]], prepend=0).tobytes() for b in asked.tolist()],
            }

    return meet(left, right, ["dim", "chunk", "group"], work, REQUEST)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whole-number products of all rows, in the narrowest floats that hold them and all their sums exactly.

    Python integers where doubles would round, held within 64 bits.
    """
    largest = [float(np.abs(x).max(initial=0)) for x in (a, b)]
    most = largest[0] * largest[1] * a.shape[1]
    if max(most, *largest) < EXACT_SINGLE:
        return a.astype(np.float32) @ b.astype(np.float32).T
    if most < EXACT:
        return a @ b.T
    whole = [[int(x) for x in row] for row in b.tolist()]
    out = np.empty((len(a), len(b)), np.int64)
    for i, row in enumerate(a.tolist()):
        row = [int(x) for x in row]
        out[i] = [min(max(sum(p * q for p, q in zip(row, other)), -LONG - 1), LONG) for other in whole]
    return out


def read(anchors: DataFrame, requests: DataFrame, blocks: DataFrame, same: bool, k: int, per_set: int, per_unit: int) -> DataFrame:
    """``(no, win, id, score, rank)``: the k best rows within each window, from the blocks that were asked for.

    A task meets the anchors of ``per_set`` chunks with up to ``per_unit``
    neighbouring blocks, so that a block is sent once for all of a set.
    """
    keys = ["dim", "set", "unit"]
    set_, unit = F.expr(f"chunk div {per_set}").alias("set"), F.expr(f"block div {per_unit}").alias("unit")
    asked = requests.select("dim", set_, "block", "nos").groupBy("dim", "set", "block").agg(F.collect_list("nos").alias("nos"))
    asked = asked.select("dim", "set", unit, "block", "nos")
    # Names of their own: both sides come from the requests.
    wanted = requests.select(F.col("dim").alias("dim"), set_, unit).distinct()
    left = anchors.select("dim", set_, "no", "id", "label", "v", "low", "high", "floor").join(wanted, ["dim", "set"])
    right = blocks.select("block", "ids", "labels", "vectors").join(asked, "block").drop("block")

    def work(key: tuple, a: pa.Table, z: pa.Table) -> Iterator[dict]:
        v = _matrix(a.column("v"), key[0])
        nos, own, kinds_of = (a.column(name).to_numpy() for name in ("no", "id", "label"))
        low, most, floor = _windows(a)
        least = np.maximum(low, floor)
        n_windows = least.shape[1]
        order = np.argsort(nos)
        empty = np.zeros(0, np.int64)
        held = [(empty, empty, empty)]  # place of the anchor and window, id, score

        def best() -> None:
            """Leave the k best of every window: no later row counts that is under the k-th."""
            places, ids, scores = (np.concatenate(x) for x in zip(*held))
            kept = best_of(scores, ids, places, k)
            held[:] = [(places[kept], ids[kept], scores[kept])]
            counts = np.bincount(held[0][0], minlength=least.size)
            full = np.flatnonzero(counts == k)
            flat = least.reshape(-1)
            flat[full] = np.maximum(flat[full], held[0][2][np.cumsum(counts)[full] - 1])

        n_held = 0
        for ids, labels, vectors, of in zip(*(z.column(name) for name in ("ids", "labels", "vectors", "nos"))):
            ids, labels = (np.frombuffer(x.as_buffer(), np.int64) for x in (ids, labels))
            c = np.frombuffer(vectors.as_buffer(), np.float64).reshape(len(ids), -1)
            of = np.concatenate([np.cumsum(np.frombuffer(x, np.int64)) for x in of.as_py()])
            at = order[np.searchsorted(nos, of, sorter=order)]
            step = max(1, PAIRS // len(ids))
            for lo in range(0, len(at), step):
                part = at[lo : lo + step]
                scores = products(v[part], c)
                # As floats, bounds that are no whole numbers of theirs still lie beyond every score.
                low, high = (x.astype(scores.dtype)[:, None] for x in (least[part].min(1), most[part].max(1)))
                row, column = np.nonzero((scores >= low) & (scores <= high))
                score, row = scores[row, column].astype(np.int64), part[row]
                alike = kinds_of[row] == labels[column]
                able = alike & (own[row] != ids[column]) if same else ~alike
                score, row, column = score[able], row[able], column[able]
                for w in range(n_windows):
                    fits = np.flatnonzero((score >= least[row, w]) & (score <= most[row, w]))
                    held.append((row[fits] * n_windows + w, ids[column[fits]], score[fits]))
                    n_held += len(fits)
                    if n_held > PAIRS:
                        best()
                        n_held = 0
        best()
        places, ids, scores = held[0]
        yield {"no": nos[places // n_windows], "win": (places % n_windows).astype(np.int32), "id": ids, "score": scores}

    rows = meet(left, right, keys, work, FOUND)
    order = Window.partitionBy("no", "win").orderBy(F.col("score").desc(), "id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _share(score: Column, percent: int, up: bool) -> Column:
    """Whole hundredths of a score, rounded up or down."""
    hundredths = score.cast("decimal(38,0)") * F.lit(percent) / F.lit(100).cast("decimal(3,0)")
    rounded = F.ceil(hundredths) if up else F.floor(hundredths)
    return F.least(F.greatest(rounded, F.lit(-LONG - 1)), F.lit(LONG)).cast("long")


def hard_negatives(
    vectors: DataFrame,
    id_column: str,
    label: Column,
    vector_column: str,
    is_anchor: Callable[[Column], Column],
    positives: int = 5,
    negatives: int = 3,
    percents: tuple[int, int] = (50, 95),
    scale: int = 256,
    block_bytes: int = 256 << 10,
    chunk_rows: int = 1024,
    group_rows: int = 4096,
    task_bytes: int = 16 << 20,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    The score of two rows is the product of their vectors after floor(scale * x);
    higher ones come first, ties by smaller id.  An anchor's positives are its
    first ``positives`` other rows of the same label; for each, the first
    ``negatives`` rows of other labels are returned whose scores lie between the
    two ``percents`` of the positive's score.  An anchor or positive without such
    rows gives none; a negative positive score gives an empty window.

    Rows without id, label or vector, and vectors that are empty or hold null or
    non-finite components, take no part; only vectors of equal dimension meet.
    Rows that repeat id, label and vector count once; of other rows with one id
    each is a candidate, and each anchor among them has results of its own; rows
    with the anchor's id are not its positives.  Other columns are not read; an
    empty table gives an empty result.  Scores beyond 64 bits count as the
    largest or smallest long.

    A task holds about ``task_bytes`` of anchors with what is found for them, and
    as much of blocks or zone maps; sizes change no result.
    """
    rows = vectors.select(
        F.col(id_column).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector_column).alias("vector")
    )
    rows = staged(whole_vectors(rows, scale).dropDuplicates(["id", "label", "v"]), "negative-rows")
    axes = axes_of(rows)
    blocks = blocks_of(rows, axes, block_bytes)
    n_blocks = blocks.count()
    anchor = is_anchor(F.col("id"))
    n_anchors, n_bytes, widest = rows.agg(
        F.count_if(anchor), F.sum(F.when(anchor, F.octet_length("v"))), F.max("dim")
    ).first()
    # An anchor's windows and results take 24 bytes each.
    n_bytes = (n_bytes or 0) + 24 * positives * (1 + negatives) * n_anchors
    sets = max(1, -(-n_bytes // task_bytes))
    # Zone maps go to every chunk, so there are no more of these than memory or cores ask for.
    cores = rows.sparkSession.sparkContext.defaultParallelism
    chunks = max(sets, min(4 * cores, -(-n_anchors // chunk_rows)))
    fit = max(1, min(group_rows, task_bytes // (16 * (widest or 1))))
    groups = max(1, -(-n_blocks // fit))
    # Beside a block lie the numbers of its anchors.
    per_unit = max(1, task_bytes // (2 * block_bytes))

    def unpack(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"block": [], "dim": [], "id": [], "label": [], "v": []}
        for block, dim, ids, labels, v in zip(*(batch.column(c).to_pylist() for c in ("block", "dim", "ids", "labels", "vectors"))):
            ids, labels = np.frombuffer(ids, np.int64).tolist(), np.frombuffer(labels, np.int64).tolist()
            out["block"] += [block] * len(ids)
            out["dim"] += [dim] * len(ids)
            out["id"] += ids
            out["label"] += labels
            out["v"] += [v[i : i + 8 * dim] for i in range(0, len(v), 8 * dim)]
        return out

    unpacked = map_batches(blocks, unpack, "block long, dim int, id long, label long, v binary")
    found = staged(unpacked.filter(is_anchor(F.col("id"))), "negative-anchors")
    # Anchors that lie close together on the curve ask for much the same blocks.
    ranged = found.repartitionByRange(chunks, "dim", "block", "id", "label").sortWithinPartitions("dim", "block")
    numbers = {"chunk": F.spark_partition_id(), "no": F.monotonically_increasing_id()}
    anchors = staged(ranged.withColumns(numbers), "negative-chunks")
    chunks = (anchors.agg(F.max("chunk")).first()[0] or 0) + 1
    per_set = -(-chunks // sets)
    lowest, highest = F.lit(-LONG - 1), F.lit(LONG)

    def search(looking: DataFrame, same: bool, mode: str, k: int) -> DataFrame:
        looking = staged(looking, "negative-windows")
        requests = staged(choose(looking, blocks, axes, same, mode, chunks, groups), "negative-requests")
        return staged(read(looking, requests, blocks, same, k, per_set, per_unit), f"negative-{mode}")

    open_ = anchors.select("*", F.array(lowest).alias("low"), F.array(highest).alias("high"), F.array(lowest).alias("floor"))
    own = search(open_, True, "own", positives)
    floors = own.filter(F.col("rank") == positives).select("no", F.col("score").alias("least"))
    floored = open_.join(floors, "no", "left").withColumn("floor", F.array(F.coalesce("least", lowest))).drop("least")
    found = search(floored, True, "all", positives)
    found = found.select("no", (F.col("rank") - 1).alias("win"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))

    # One window per positive; those that an anchor lacks are empty.
    score = F.col("positive_score")
    windows = found.select(
        "no", "win", _share(score, percents[0], True).alias("low"), _share(score, percents[1], False).alias("high")
    )
    per_window = [F.max(F.when(F.col("win") == w, F.struct("low", "high"))) for w in range(positives)]
    windows = windows.groupBy("no").agg(F.array(*per_window).alias("w"))
    windows = windows.select(
        "no",
        F.transform("w", lambda w: F.coalesce(w["low"], highest)).alias("low"),
        F.transform("w", lambda w: F.coalesce(w["high"], lowest)).alias("high"),
    )
    looking = staged(
        anchors.join(windows, "no").withColumn("floor", F.array_repeat(lowest, positives)), "negative-windows"
    )
    lead = search(looking, False, "lead", negatives)
    reached = lead.filter(F.col("rank") == negatives).groupBy("no").agg(
        F.map_from_entries(F.collect_list(F.struct("win", "score"))).alias("least")
    )
    with_floor = looking.join(reached, "no", "left").withColumn(
        "floor", F.transform("floor", lambda f, w: F.coalesce(F.col("least")[w], f))
    )
    mined = search(with_floor.drop("least"), False, "all", negatives)
    named = anchors.select("no", F.col("id").alias("anchor_id"))
    return (
        mined.select("no", "win", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"), "rank")
        .join(found, ["no", "win"])
        .join(named, "no")
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
