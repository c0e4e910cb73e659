"""Exact top-k by inner product: norm-sorted blocks, rotated partial sums, pruning.

Integer vectors are rotated by the singular vectors of their second moments, so
that the first coordinates carry most of a product.  Candidates are dealt out by
descending length.  A block of them meets a block of queries in one task: for
each slice of rotated coordinates the partial products grow, and a pair is given
up once partial product plus the product of both residual lengths
(Cauchy-Schwarz) is under the query's k-th best score so far.  What is left is
scored in integers, so pruning changes no result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalsweep.llm.common import map_batches, staged

# Sums of products below this are exact in double precision.
EXACT = float(2**52)
LONG = 2**63 - 1


def integer_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """``(id, dim, norm2, v)`` with floor(scale * x) of finite, non-empty vectors.

    ``v`` holds doubles, which are whole numbers; rows that are null or hold null
    or non-finite components are left out, and so are rows without an id.
    """

    def work(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"id": [], "dim": [], "norm2": [], "v": []}
        for key, vector in zip(batch.column("id").to_pylist(), batch.column("vector").to_pylist()):
            if key is None or not vector or None in vector:
                continue
            x = np.floor(np.array(vector, np.float64) * scale)
            if np.isfinite(x).all():
                out["id"].append(key)
                out["dim"].append(len(x))
                out["norm2"].append(float(x @ x))
                out["v"].append(x)
        return out

    return map_batches(vectors, work, "id long, dim int, norm2 double, v array<double>")


def rotations(rows: DataFrame) -> dict[int, np.ndarray]:
    """For each dimension the singular vectors of all rows, largest first.

    Tasks add up outer products; the driver gets one matrix of size dim**2 per
    task and dimension.  Only the amount of pruning depends on it.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, x in _by_dim(batch.to_pandas()):
                sums[dim] = sums.get(dim, 0) + x.T @ x
        yield pa.RecordBatch.from_pydict(
            {"dim": pa.array(sums, pa.int32()), "gram": pa.array([s.ravel() for s in sums.values()], pa.list_(pa.float64()))}
        )

    partial = rows.mapInArrow(work, "dim int, gram array<double>")
    total: dict[int, np.ndarray] = {}
    for row in partial.toLocalIterator():
        gram = np.array(row["gram"]).reshape(row["dim"], row["dim"])
        total[row["dim"]] = total.get(row["dim"], 0) + gram
    # Vectors so long that their squares overflow are left as they are.
    return {
        dim: np.linalg.eigh(gram)[1][:, ::-1].copy() if np.isfinite(gram).all() else np.eye(dim)
        for dim, gram in total.items()
    }


def _by_dim(frame: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
    for dim, part in frame.groupby("dim"):
        yield int(dim), np.stack(part["v"].to_list())


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whole-number products of matching rows, as Python integers where doubles would round.

    Scores beyond 64 bits become the largest or smallest long.
    """
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1] < EXACT:
        return np.einsum("ij,ij->i", a, b).astype(np.int64)
    out = [sum(int(p) * int(q) for p, q in zip(x, y)) for x, y in zip(a.tolist(), b.tolist())]
    return np.array([min(max(s, -LONG - 1), LONG) for s in out], np.int64)


def best_of(scores: np.ndarray, ids: np.ndarray, queries: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best pairs of every query; ties go to the smaller id."""
    order = np.lexsort((ids, ~scores, queries))  # ~ reverses the order and cannot overflow
    sorted_queries = queries[order]
    first = np.r_[True, sorted_queries[1:] != sorted_queries[:-1]] if len(order) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    return order[np.arange(len(order)) - start < k]


def search_block(
    q_ids: np.ndarray,
    q: np.ndarray,
    floor: np.ndarray,
    c_ids: np.ndarray,
    c: np.ndarray,
    rotation: np.ndarray,
    k: int,
    step: int = 1024,
    slice_: int = 16,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best k candidates of a block for every query: places of queries, ids, scores.

    ``floor`` holds a score that each query's k-th best is known to reach.
    """
    order = np.argsort(-np.einsum("ij,ij->i", c, c), kind="stable")
    c_ids, c = c_ids[order], c[order]
    rq, rc = q @ rotation, c @ rotation
    # Lengths of what the slices from each cut on still hold.
    rest_q = np.sqrt(np.cumsum((rq * rq)[:, ::-1], 1)[:, ::-1])
    rest_c = np.sqrt(np.cumsum((rc * rc)[:, ::-1], 1)[:, ::-1])
    # More than rotating and adding in doubles can be off by.
    slack = 1.0 + 1e-9 * (rest_q[:, :1] * rest_c[:, 0].max(initial=0.0))
    dim = c.shape[1]
    floor = floor.astype(np.float64).copy()
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for lo in range(0, len(c), step):
        hi = min(lo + step, len(c))
        live = np.flatnonzero(~(rest_q[:, 0] * rest_c[lo, 0] + slack[:, 0] < floor))
        if not len(live):
            break  # this and all shorter vectors are under every floor
        part = np.zeros((len(live), hi - lo))
        columns = np.arange(lo, hi)
        for cut in range(0, dim, slice_):
            end = min(cut + slice_, dim)
            part += rq[live, cut:end] @ rc[columns, cut:end].T
            if end == dim:
                keep = ~(part + slack[live] < floor[live, None])
                break
            bound = part + rest_q[live, end, None] * rest_c[None, columns, end] + slack[live]
            keep = ~(bound < floor[live, None])
            rows, cols = keep.any(1), keep.any(0)
            live, columns, part = live[rows], columns[cols], part[np.ix_(rows, cols)]
            keep = keep[np.ix_(rows, cols)]
            if not len(live):
                break
        at_q, at_c = np.nonzero(keep)
        if not len(at_q):
            continue
        at_q, at_c = live[at_q], columns[at_c]
        # Rotated sums choose whom to score; of each query only what can reach its k best.
        other = c_ids[at_c] != q_ids[at_q]
        at_q, at_c = at_q[other], at_c[other]
        if not len(at_q):
            continue
        for a in range(0, len(at_q), 1 << 18):
            one_q, one_c = at_q[a : a + (1 << 18)], at_c[a : a + (1 << 18)]
            held.append((one_q, c_ids[one_c], exact_products(q[one_q], c[one_c])))
        places, ids, scores = (np.concatenate(x) for x in zip(*held))
        best = best_of(scores, ids, places, k)
        places, ids, scores = places[best], ids[best], scores[best]
        held = [(places, ids, scores)]
        # The k-th score found is the least that a later candidate must reach.
        counts = np.bincount(places, minlength=len(q))
        last = np.full(len(q), -np.inf)
        ends = np.cumsum(counts) - 1
        full = counts == k
        last[full] = scores[ends[full]]
        floor = np.maximum(floor, last)
    if not held:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    return held[0]


def block_pairs(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """``(dim, q_block, c_block, top)`` of the blocks that have to meet.

    ``queries`` holds dim, q_block and ``need``, the length from which on a candidate
    can reach the query's floor; ``top`` is the greatest length of a block.  One
    number per block of either kind takes part.
    """
    needs = queries.groupBy("dim", "q_block").agg(F.min("need").alias("least"))
    tops = candidates.groupBy("dim", "c_block").agg(F.max(F.sqrt("norm2")).alias("top"))
    return needs.join(tops, "dim").filter("top >= least").drop("least")


def top_k(
    vectors: DataFrame,
    id_column: str,
    vector_column: str,
    is_query: Callable[[Column], Column],
    k: int = 5,
    scale: int = 256,
    query_block: int = 16384,
    block: int = 65536,
    block_bytes: int = 64 << 20,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's k highest integer products.

    Every other row is a candidate; rows with the query's own id are not.  Ties
    go to the smaller id; a query with fewer candidates gets all of them.  Only
    vectors of equal dimension are compared; empty, null and non-finite ones take
    no part.  Rows that repeat an id and vector count once; of an id with several
    vectors each is a candidate and, among queries, has ranks of its own.  Other
    columns are left out; an empty table, or one without queries, gives no rows.
    Blocks hold at most ``block`` candidates or ``query_block`` queries, and about
    ``block_bytes`` bytes of vectors; sizes change no result.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("vector"))
    rows = staged(integer_vectors(rows, scale).dropDuplicates(["id", "v"]), "vectors")
    query = is_query(F.col("id"))
    n, n_queries, widest = rows.agg(F.count("*"), F.count_if(query), F.max("dim")).first()
    if not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    fit = max(1, block_bytes // (8 * widest))
    block, query_block = min(block, fit), min(query_block, fit)
    # Blocks by descending length; small tables still get some for every core.
    n_blocks = max(-(-n // block), min(2 * spark.sparkContext.defaultParallelism, -(-n // 2048)))
    ranged = rows.repartitionByRange(n_blocks, F.col("norm2").desc(), F.xxhash64("id", "v"))
    candidates = staged(ranged.withColumn("c_block", F.spark_partition_id()), "candidates")
    n_blocks = candidates.agg(F.max("c_block")).first()[0] + 1
    q_blocks = -(-n_queries // query_block)
    spins = rotations(rows)
    queries = rows.filter(query).select(
        "dim",
        "norm2",
        F.xxhash64("id", "v").alias("q_no"),
        F.col("id").alias("q_id"),
        "v",
        F.pmod(F.xxhash64("id", "v", F.lit(7)), F.lit(q_blocks)).cast("int").alias("q_block"),
    )
    keys = ["dim", "q_block", "c_block"]
    names = ["q_no", "q_id", "id", "score"]

    def work(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({name: np.zeros(0, np.int64) for name in names})
        q_ids, c_ids = q["q_id"].to_numpy(), c["id"].to_numpy()
        q_rows, c_rows = np.stack(q["v"].to_list()), np.stack(c["v"].to_list())
        floor = q["floor"].to_numpy(np.float64)
        at, ids, scores = search_block(q_ids, q_rows, floor, c_ids, c_rows, spins[c_rows.shape[1]], k)
        return pd.DataFrame({"q_no": q["q_no"].to_numpy()[at], "q_id": q_ids[at], "id": ids, "score": scores})

    def met(asked: DataFrame, pairs: DataFrame) -> DataFrame:
        """Best pairs of every query with the candidates of the blocks that its own block meets."""
        left = asked.join(pairs, ["dim", "q_block"]).filter("top >= need").select(*keys, "q_no", "q_id", "v", "floor")
        right = candidates.join(pairs, ["dim", "c_block"]).select(*keys, "id", "v")
        # Names of their own: both sides come from the same stored pairs.
        other = ["dim_", "q_block_", "c_block_"]
        right = right.toDF(*other, "id", "v")
        schema = "q_no long, q_id long, id long, score long"
        return left.groupBy(*keys).cogroup(right.groupBy(*other)).applyInPandas(work, schema)

    def best(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("q_no").orderBy(F.col("score").desc(), "id")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    # The longest candidates come first: their k-th scores are floors for all other blocks.
    low = F.lit(float("-inf"))
    first, others = candidates.filter("c_block = 0"), candidates.filter("c_block > 0")
    asked = queries.withColumn("floor", low).withColumn("need", low)
    lead = staged(best(met(asked, staged(block_pairs(asked, first), "block-pairs"))), "lead")
    found = lead
    if n_blocks > 1:
        floors = lead.filter(F.col("rank") == k).select("q_no", F.col("score").cast("double").alias("floor"))
        asked = queries.drop("q_block").join(floors, "q_no", "left").na.fill(float("-inf"), ["floor"])
        # A little less than floor / length, since both are rounded.
        bounded = (F.col("norm2") > 0) & (F.col("norm2") < float("inf"))
        need = F.when(bounded, (F.col("floor") - 1) / F.sqrt("norm2") * (1 - 1e-9)).otherwise(low)
        # Queries that need equal lengths stand in one block, so that the others need not meet short candidates.
        asked = asked.withColumn("need", need).repartitionByRange(q_blocks, "need", "q_no")
        asked = staged(asked.withColumn("q_block", F.spark_partition_id()), "queries")
        pairs = staged(block_pairs(asked, others), "block-pairs")
        found = best(lead.drop("rank").unionByName(met(asked, pairs)))
    return found.select(
        F.col("q_id").alias("query_id"), F.col("rank"), F.col("id").alias("vec_id"), F.col("score")
    )
