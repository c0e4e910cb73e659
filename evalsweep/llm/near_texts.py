"""Near-duplicate texts: hash minima, banding, verification, components.

A text's set of word shingles gets many universal hash minima; texts whose minima
agree in a band become candidates, the minima estimate their similarity, and
what may reach the threshold is compared on the full sets.  Equal sets are one
class from the start.  Components come from alternating large-star and
small-star.

Within a bucket no list of all pairs is made.  First every member is compared
with the bucket's smallest.  Then only members that are still in different
components are compared, block by block, and each keeps one link.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalsweep.llm.common import (
    U64,
    PolyHash,
    least_reachable,
    map_batches,
    mixed,
    random_words,
    run_starts,
    staged,
    text_bytes,
    whole_runs,
)
from evalsweep.llm.components import connected

# Members of a bucket that one task compares with as many others.
BLOCK = 512
# Bytes of text that are hashed at a time: a handful of 8-byte numbers for each.
HASHED = 1 << 20
_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[ord("A") : ord("Z") + 1] += 32
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True


@dataclass(frozen=True)
class Plan:
    """Shingle width, percent of similarity, and the shape of the bands.

    26 bands of 5 miss a pair at similarity 0.85 once in five million.
    """

    words: int = 5
    percent: int = 85
    bands: int = 26
    rows: int = 5

    @property
    def minima(self) -> int:
        return self.bands * self.rows

    @property
    def least_equal(self) -> int:
        """Fewest equal minima that a pair at the threshold may show: six standard deviations under."""
        share = self.percent / 100
        return int(self.minima * share - 6 * np.sqrt(self.minima * share * (1 - share)))


def shingle_sets(column: pa.Array, width: int, poly: PolyHash) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of all texts in a row, ascending in each, and their offsets.

    Words are runs without white space, A-Z as a-z; a text of fewer words than
    ``width`` has its whole sequence as its one shingle, one without words none.
    """
    data, offsets = text_bytes(column)
    data = _SMALL[data]
    gap = _GAP[data]
    begins = ~gap
    begins[1:] &= gap[:-1]
    first = offsets[:-1][np.diff(offsets) > 0]
    begins[first] = ~gap[first]
    ends = ~gap
    ends[:-1] &= gap[1:]
    ends[first[1:] - 1] = ~gap[first[1:] - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    word = poly.load(data).of(starts, stops)
    bounds = np.searchsorted(starts, offsets)  # words of each text
    n_words = np.diff(bounds)
    factors = random_words(99, width)
    sums = np.zeros(max(len(word) - width + 1, 0), U64)
    for i in range(width):
        sums += word[i : len(word) - width + 1 + i] * factors[i]
    sums = mixed(sums)
    sets = []
    for i, n in enumerate(n_words.tolist()):
        lo = bounds[i]
        if n >= width:
            sets.append(np.unique(sums[lo : lo + n - width + 1]))
        elif n:
            total = np.array([n], U64) * U64(0xD6E8FEB86659FD93)
            for j in range(n):
                total += word[lo + j : lo + j + 1] * factors[j]
            sets.append(mixed(total))
        else:
            sets.append(np.zeros(0, U64))
    sizes = [len(s) for s in sets]
    return np.concatenate([np.zeros(0, U64), *sets]), np.r_[0, np.cumsum(sizes, dtype=np.int64)]


def signatures(shingles: np.ndarray, offsets: np.ndarray, minima: int) -> np.ndarray:
    """Least value of each of many universal hashes over every non-empty set, its upper 32 bits."""
    factors, shifts = random_words(7, minima) | U64(1), random_words(8, minima)
    out = np.empty((len(offsets) - 1, minima), np.uint32)
    lo = 0
    while lo < len(offsets) - 1:  # so many sets at a time as stay in the cache
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + 32768, "right")) - 1)
        part = shingles[offsets[lo] : offsets[hi]]
        starts = offsets[lo:hi] - offsets[lo]
        held = np.empty_like(part)
        for k in range(minima):
            np.multiply(part, factors[k], out=held)
            held += shifts[k]
            out[lo:hi, k] = np.minimum.reduceat(held, starts) >> U64(32)
        lo = hi
    return out


def _signed(docs: DataFrame, plan: Plan) -> DataFrame:
    """Per row: size of its set, two hashes that identify the set, bands, minima."""

    def work(batch: pa.RecordBatch, poly: PolyHash) -> dict:
        shingles, offsets = shingle_sets(batch.column("text"), plan.words, poly)
        sizes = np.diff(offsets)
        some = sizes > 0
        kept = np.r_[offsets[:-1][some], offsets[-1]]
        names = np.zeros((2, len(sizes)), U64)
        if some.any():
            names[0, some] = mixed(np.add.reduceat(shingles, kept[:-1]))
            names[1, some] = mixed(np.add.reduceat(mixed(shingles ^ U64(0xA0761D6478BD642F)), kept[:-1]))
        minima = np.zeros((len(sizes), plan.minima), np.uint32)
        minima[some] = signatures(shingles, kept, plan.minima)
        bands = np.zeros((len(sizes), plan.bands), U64)
        for band in range(plan.bands):
            key = np.full(len(sizes), band + 1, U64)
            for row in range(plan.rows):
                key = mixed(key * U64(0x9E3779B97F4A7C15) + minima[:, band * plan.rows + row].astype(U64))
            bands[:, band] = key
        return {
            "doc_id": batch.column("doc_id"),
            "n_shingles": sizes,
            "name1": names[0].view(np.int64),
            "name2": names[1].view(np.int64),
            "bands": [list(b) if s else None for b, s in zip(bands.view(np.int64), some)],
            "minima": [m.tobytes() if s else None for m, s in zip(minima, some)],
        }

    schema = "doc_id long, n_shingles long, name1 long, name2 long, bands array<long>, minima binary"
    return map_batches(docs, work, schema, PolyHash, HASHED)


def _sets(docs: DataFrame, ids: DataFrame, plan: Plan) -> DataFrame:
    """(doc_id, shingles) of the texts whose ``doc_id`` is listed."""

    def work(batch: pa.RecordBatch, poly: PolyHash) -> dict:
        shingles, offsets = shingle_sets(batch.column("text"), plan.words, poly)
        shingles = shingles.view(np.int64)
        return {
            "doc_id": batch.column("doc_id"),
            "shingles": [shingles[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])],
        }

    # The same plan at every size: the list of ids grows with the documents.
    wanted = docs.join(ids.distinct().hint("merge"), "doc_id", "left_semi")
    return staged(map_batches(wanted, work, "doc_id long, shingles binary", PolyHash, HASHED), "sets")


def _similar(a: np.ndarray, b: np.ndarray, plan: Plan) -> bool:
    same = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * same >= plan.percent * (len(a) + len(b) - same)


def _confirmed(pairs: DataFrame, sets: DataFrame, plan: Plan) -> DataFrame:
    """Those of the ``(u, v)`` pairs whose full sets reach the threshold; a pair of repeated ids may come twice."""
    pairs = staged(pairs, "pairs")
    a = sets.select(F.col("doc_id").alias("u"), F.col("shingles").alias("a"))
    b = sets.select(F.col("doc_id").alias("v"), F.col("shingles").alias("b"))
    both = pairs.join(a, "u").join(b, "v")

    def compare(batch: pa.RecordBatch) -> dict:
        columns = zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())
        linked = [_similar(np.frombuffer(a, np.int64), np.frombuffer(b, np.int64), plan) for a, b in columns]
        return {"u": batch.column("u"), "v": batch.column("v"), "linked": linked}

    return map_batches(both, compare, "u long, v long, linked boolean").filter("linked").select("u", "v")


def _likely(pairs: DataFrame, signed: DataFrame, plan: Plan) -> DataFrame:
    """Those of the ``(u, v)`` pairs whose minima do not rule the threshold out."""
    u = signed.select(F.col("doc_id").alias("u"), F.col("minima").alias("a"))
    v = signed.select(F.col("doc_id").alias("v"), F.col("minima").alias("b"))

    def compare(batch: pa.RecordBatch) -> dict:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, plan.minima) for c in "ab")
        return {"u": batch.column("u"), "v": batch.column("v"), "ok": (a == b).sum(1) >= plan.least_equal}

    joined = pairs.join(u, "u").join(v, "v")
    return map_batches(joined, compare, "u long, v long, ok boolean").filter("ok").select("u", "v").distinct()


def _partners(whole: pa.Table, plan: Plan) -> Iterator[tuple[int, np.ndarray]]:
    """For members of parts, the later ones of other components that their minima let pass.

    A pair that shares several buckets is looked at in the first only.
    """
    bucket, side = whole.column("bucket").to_numpy(), whole.column("side").to_numpy()
    component = whole.column("component").to_numpy()
    minima = np.frombuffer(b"".join(whole.column("minima").to_pylist()), np.uint32).reshape(len(bucket), -1)
    bands = whole.column("bands").combine_chunks().flatten().to_numpy().reshape(len(bucket), -1)
    starts = run_starts(whole.column("part").to_numpy())
    for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist()):
        for i in range(lo, hi - 1):
            j = np.arange(i + 1, hi)
            j = j[(component[j] != component[i]) & ((side[j] == 2) | (side[j] != side[i]))]
            j = j[(minima[j] == minima[i]).sum(1) >= plan.least_equal]
            if len(j):
                shared = (bands[j] == bands[i]).argmax(1)
                j = j[bands[i][shared] == bucket[i]]
            if len(j):
                yield i, j


def _across(filed: DataFrame, standing: DataFrame, sets: DataFrame, plan: Plan) -> DataFrame:
    """Links between components that meet in a bucket, as ``(u, v)`` rows; some come twice.

    ``filed`` holds (bucket, doc_id, component).  A bucket whose members are all
    in one component has nothing left to find.  Of the others each member is put
    into blocks, and a task meets two blocks.  First it gives the members that
    have any likely partner; those come again with their full sets, and the task
    gives each member the smallest that it reaches over true links.  Neither
    gives pairs: rows grow with members and blocks.
    """
    open_ = (
        filed.groupBy("bucket")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n"))
        .filter("low <> high")
        .select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    )
    met = filed.join(open_, "bucket").withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select(
        "bucket",
        "doc_id",
        "component",
        F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("part"),
        F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") > F.col("other")).cast("int")).alias("side"),
    )
    signed = standing.select("doc_id", "bands", "minima")

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in whole_runs(batches, "part", 4096):
            hit = np.zeros(whole.num_rows, bool)
            for i, j in _partners(whole, plan):
                hit[i] = hit[j] = True
            kept = whole.select(["bucket", "doc_id", "component", "part", "side"]).filter(pa.array(hit))
            yield from kept.combine_chunks().to_batches()

    schema = "bucket long, doc_id long, component long, part long, side int"
    work = met.join(signed, "doc_id").repartition("part").sortWithinPartitions("part")
    hits = staged(work.mapInArrow(likely, schema), "likely")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in whole_runs(batches, "part", 1024):
            ids = whole.column("doc_id").to_numpy()
            sets = [np.frombuffer(x, np.int64) for x in whole.column("shingles").to_pylist()]
            found_a, found_b = [], []
            for i, j in _partners(whole, plan):
                true = [k for k in j.tolist() if _similar(sets[i], sets[k], plan)]
                found_a += [i] * len(true)
                found_b += true
            nodes, node = np.unique(ids, return_inverse=True)
            a, b = node[np.array(found_a, np.int64)], node[np.array(found_b, np.int64)]
            root = least_reachable(len(nodes), a, b)
            tied = root != np.arange(len(nodes))
            yield pa.RecordBatch.from_pydict({"u": pa.array(nodes[tied]), "v": pa.array(nodes[root[tied]])})

    again = hits.join(signed, "doc_id").join(sets, "doc_id").repartition("part").sortWithinPartitions("part")
    return again.mapInArrow(links, "u long, v long")


def near_duplicates(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row.

    Texts link when 100 * intersection >= percent * union of their shingle sets.
    Null and empty texts and those of white space alone have an empty set and
    link with nothing.  Rows that share an id are one node of the components.  A
    row without an id takes no part: no component, kept.  A similarity equal to the
    threshold links.  Shingles are told apart by 64-bit hashes.  Texts of any length
    are read whole; other columns are left out; an empty table gives no rows.
    """
    rows = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    signed = staged(_signed(rows, plan), "minima")
    full = signed.filter("doc_id is not null and n_shingles > 0")
    # Equal sets are one class, whose smallest id stands for all.
    classes = staged(full.groupBy("name1", "name2", "n_shingles").agg(F.min("doc_id").alias("first")), "classes")
    firsts = classes.select(F.col("first").alias("doc_id")).distinct()
    standing = full.join(firsts, "doc_id", "left_semi")
    filed = standing.select("doc_id", F.explode("bands").alias("bucket"))
    crowded = filed.groupBy("bucket").agg(F.min("doc_id").alias("pivot"), F.max("doc_id").alias("last"))
    filed = filed.join(crowded.filter("pivot <> last"), "bucket").select("bucket", "doc_id", "pivot")
    filed = staged(filed, "buckets")
    # Stored, as are their sets, which both comparisons below read, and the likely pairs: joins of
    # stored tables let Spark split the rows of a pivot.
    standing = staged(standing.join(filed.select("doc_id").distinct(), "doc_id", "left_semi"), "standing")
    sets = _sets(rows.filter("doc_id is not null"), standing.select("doc_id"), plan)

    stars = filed.filter("doc_id <> pivot").select(F.col("pivot").alias("u"), F.col("doc_id").alias("v")).distinct()
    tied = connected(_confirmed(_likely(stars, standing, plan), sets, plan))
    placed = filed.join(tied.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "bucket", "doc_id", F.coalesce("component", "doc_id").alias("component")
    )
    # The links found so far are stars by now: what no link across touches is settled.
    ties = tied.select(F.col("node").alias("u"), F.col("component").alias("v"))
    tied = connected(ties.unionByName(_across(placed, standing, sets, plan)))

    of_class = classes.join(tied.withColumnRenamed("node", "first"), "first", "left").select(
        "name1", "name2", "n_shingles", F.coalesce("component", "first").alias("component")
    )
    out = signed.select("doc_id", "n_shingles", "name1", "name2").join(
        of_class, ["name1", "name2", "n_shingles"], "left"
    )
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """The documents whose id is the smallest of their component; same columns.

    Rows of equal id and text, null or not, are one document and leave one row.
    Of other rows that share an id and are kept, one of each group of near copies
    stays.  Otherwise rows without an id or without words stay.  Columns may have
    any names.  An empty table stays empty.
    """
    names = docs.columns
    # Plain names inside, so that no column can clash with those of this module.
    docs = docs.toDF(*[name if name in ("doc_id", "text") else f"c{i}" for i, name in enumerate(names)])
    marks = near_duplicates(docs, plan).groupBy(F.col("doc_id").alias("_id"))
    marks = marks.agg(F.min("kept").alias("_kept"), (F.count("*") > 1).alias("_shared"))
    marks = staged(marks.filter("not _kept or _shared"), "marks")
    once = docs.join(marks, docs["doc_id"].eqNullSafe(marks["_id"]), "left_anti")
    shared = staged(marks.filter("_kept and _shared").select("_id"), "shared")
    if shared.isEmpty():
        return once.toDF(*names)
    rows = docs.join(shared, docs["doc_id"].eqNullSafe(shared["_id"]), "left_semi")
    rows = rows.dropDuplicates(["doc_id", "text"])
    rows = staged(rows.withColumn("_node", F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text"))), "rows")
    # Kept ids are of different components: only texts under one id can link here.
    nodes = rows.select(F.col("_node").alias("doc_id"), "text")
    gone = near_duplicates(nodes, plan).filter("not kept").select(F.col("doc_id").alias("_node"))
    return once.unionByName(rows.join(gone, "_node", "left_anti").drop("_node")).toDF(*names)
