"""Repeated passages: every byte of a fixed-length string that starts anywhere else.

Each window of ``length`` bytes is represented by one anchor in it: the gram of
least hash.  Equal windows have equal anchors at equal places, so only windows
whose anchors have equal grams need comparing, and an anchor stands for the run
of windows that chose it.

1. Grams that occur once are dropped.  Tasks exchange sorted hash lists.
2. Anchors whose whole stretch (all windows that chose them) occurs again are
   settled by counting stretches, within each piece of input first.  A stretch is
   told apart by the gram's hash and a 128-bit BLAKE2 digest of its bytes.
3. Anchors that share the gram but not the stretch lie at the edges of repeats.
   One of each kind brings its surroundings, and a suffix sort of each gram's
   group finds the common extensions to the right and, reversed, to the left.
   Suffixes are compared by binary search over prefix hashes, in a mergesort
   whose runs are merged for all groups at once; extensions of neighbours are
   verified byte by byte.  For every offset, members with the same right and
   left extension hold the same window.
4. A gram with more members than one task should sort is cut into slices: half of
   the windows' offsets each, and of those the members that share the bytes which
   all these windows cover.  Slices that are still large are halved again, at last
   to one offset, where a slice is a window and its members are counted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from evalsweep.llm.common import (
    U64,
    PolyHash,
    map_batches,
    mixed,
    random_words,
    run_starts,
    staged,
    text_bytes,
    whole_runs,
)

GRAM = 50
# Bytes that are hashed at a time; longer texts are read in overlapping parts, each anchor in one.
PART = 1 << 18
# Gram hashes that a task holds before it passes them on.
HELD = 500_000
# Larger groups of edges are cut into slices before they are sorted.
MOST = 16_384
_PLACE = U64((1 << 24) - 1)


def anchors(data: np.ndarray, offsets: np.ndarray, poly: PolyHash, length: int, gram: int) -> tuple:
    """Anchors of all windows of the texts: text, first and last window, place, gram hash."""
    width, n = length - gram + 1, len(data)
    if n < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.view(U64)
    poly.load(data)
    at = np.arange(n - gram + 1)
    hashes = poly.of(at, at + gram)
    # The upper bits of the hash, then the place: the first of equals is the least.
    key = (hashes & ~_PLACE) | at.astype(U64)
    padded = np.full(-(-len(key) // width) * width, U64(2**64 - 1))
    padded[: len(key)] = key
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    n_windows = n - length + 1
    place = (np.minimum(behind[:n_windows], ahead[width - 1 : width - 1 + n_windows]) & _PLACE).astype(np.int64)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, offsets[:-1], 1)
    np.add.at(edge, np.maximum(offsets[:-1], offsets[1:] - length + 1), -1)
    inside = np.cumsum(edge)[:n_windows] > 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | (place[1:] != place[:-1])
    ends = inside.copy()
    ends[:-1] &= begins[1:] | ~inside[1:]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends)
    at = place[first]
    text = np.searchsorted(offsets, first, "right") - 1
    return text, first, last, at, hashes[at]


def _named(data: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """128-bit digests of stretches of bytes, as two numbers each."""
    view = memoryview(np.ascontiguousarray(data))
    found = [hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(first.tolist(), stop.tolist())]
    return np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)


def _parts(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first text, texts) in runs of about ``PART`` bytes; a longer text alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PART, "right")) - 1)
        yield i, j - i
        i = j


def _each_anchor(column: pa.Array, poly: PolyHash, length: int, gram: int, named: bool = False) -> Iterator[tuple]:
    """Anchors of a piece of input, part by part; with ``named`` also the digests of their stretches."""
    data, offsets = text_bytes(column)
    part = max(PART, 4 * length)  # many more windows than one anchor has
    for first, n in _parts(offsets):
        lo, stop = int(offsets[first]), int(offsets[first + n])
        while lo < stop:
            hi = stop if n > 1 else min(lo + part, stop)
            own = np.clip(offsets[first : first + n + 1], lo, hi) - lo
            text, begin, end, at, h = anchors(data[lo:hi], own, poly, length, gram)
            base = lo - offsets[first + text]  # places count from the start of the text
            found = first + text, begin + base, end + base, at + base, h
            if named:
                found = *found, _named(data[lo:hi], begin, end + length)
            if hi == stop:
                yield found
                break
            # The next part begins with the windows of the last anchor and finds it whole.
            lo += int(begin[-1])
            yield tuple(x[:-1] for x in found)


def _with_row(docs: DataFrame) -> DataFrame:
    """Documents with a number that stands for id and text: equal rows share it and their result."""
    return docs.withColumn("_row", F.xxhash64("doc_id", "text"))


def _repeated_grams(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Hashes of grams that are anchors twice or more."""
    # So many sorted lists from each task, several for each task that merges them.
    lists = 16 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def sent(hashes: list[np.ndarray]) -> pa.RecordBatch:
        found, counts = np.unique(np.concatenate([np.zeros(0, U64), *hashes]), return_counts=True)
        found = np.repeat(found, np.minimum(counts, 2))
        cuts = np.searchsorted(found, np.arange(1, lists, dtype=U64) * U64((1 << 64) // lists))
        blobs = [part.tobytes() for part in np.split(found, cuts)]
        full = [i for i, blob in enumerate(blobs) if blob]
        return pa.RecordBatch.from_pydict(
            {"list": pa.array(full, pa.int32()), "hashes": pa.array([blobs[i] for i in full], pa.binary())}
        )

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        poly, held, size = PolyHash(), [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                for *_, h in _each_anchor(batch.column("text").slice(lo, 256), poly, length, gram):
                    held.append(h)
                    size += len(h)
                if size > HELD:
                    yield sent(held)
                    held, size = [], 0
        yield sent(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in whole_runs(batches, "list", 1):
            found = np.frombuffer(b"".join(whole.column("hashes").to_pylist()), U64)
            found, counts = np.unique(found, return_counts=True)
            yield pa.RecordBatch.from_pydict({"h": pa.array(found[counts > 1].view(np.int64))})

    lists_sent = docs.select("text").mapInArrow(collect, "list int, hashes binary")
    return lists_sent.repartition("list").sortWithinPartitions("list").mapInArrow(merge, "h long")


def _anchor_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Anchors and spans that are settled where they are found.

    An anchor is (h, s1, s2, n, _row, packed): ``s1`` and ``s2`` name its stretch,
    ``packed`` holds first window, steps to the anchor and to the last window;
    ``n`` how many equal ones the piece of input had, of which this is the first.
    Those are repeats already: what they cover follows as rows with ``settled``,
    from ``packed`` to ``s1``, merged, under numbers that spread them.  A line that fills half
    a text becomes one span and one anchor before anything is shuffled.
    """

    def work(batch: pa.RecordBatch, poly: PolyHash) -> dict:
        parts = list(_each_anchor(batch.column("text"), poly, length, gram, named=True))
        if not parts:
            return {name: [] for name in ("h", "s1", "s2", "n", "_row", "packed", "settled")}
        text, begin, end, at, h, stretch = (np.concatenate(x) for x in zip(*parts))
        s1, s2 = stretch.T
        row = batch.column("_row").to_numpy()[text]
        packed = begin << 16 | (at - begin) << 8 | (end - begin)
        order = np.lexsort((s2, s1, h))
        same = np.ones(max(0, len(order) - 1), bool)
        for key in (h, s1, s2):
            same &= key[order][1:] == key[order][:-1]
        starts = np.flatnonzero(np.r_[True, ~same]) if len(order) else np.zeros(0, np.int64)
        counts = np.diff(np.r_[starts, len(order)])
        first = order[starts]  # the sort is stable: the earliest of its kind
        again = np.zeros(len(order), bool)
        again[order] = np.repeat(counts > 1, counts)
        text, low, high, own = text[again], begin[again], end[again] + length, row[again]
        fresh = np.ones(len(low), bool)
        fresh[1:] = (text[1:] != text[:-1]) | (low[1:] > high[:-1])
        last = np.r_[fresh[1:], True] if len(low) else fresh
        low, high, own = low[fresh], high[last], own[fresh]
        spread = mixed(own.astype(np.int64).view(U64) + low.astype(U64)).view(np.int64)
        zeros = np.zeros(len(low), np.int64)
        return {
            "h": np.r_[h[first].view(np.int64), spread],
            "s1": np.r_[s1[first], high],
            "s2": np.r_[s2[first], zeros],
            "n": np.r_[counts, zeros],
            "_row": np.r_[row[first], own],
            "packed": np.r_[packed[first], low],
            "settled": np.r_[np.zeros(len(first), bool), np.ones(len(low), bool)],
        }

    schema = "h long, s1 long, s2 long, n long, _row long, packed long, settled boolean"
    return map_batches(docs.select("_row", "text"), work, schema, PolyHash)


def _begin(packed: Column) -> Column:
    return F.shiftright(packed, 16)


def _at(packed: Column) -> Column:
    return F.shiftright(packed, 16) + F.shiftright(packed, 8).bitwiseAND(F.lit(255))


def _span(packed: Column, length: int) -> list[Column]:
    end = F.shiftright(packed, 16) + packed.bitwiseAND(F.lit(255)) + length
    return [_begin(packed).alias("start"), end.alias("end")]


# Sorting of edges ---------------------------------------------------------------------


class Suffixes:
    """Byte strings of bounded length, compared by their prefix hashes."""

    def __init__(self, strings: list[bytes], width: int):
        n = len(strings)
        self.size = np.fromiter(map(len, strings), np.int64, n)
        self.bytes = np.zeros((n, width + 1), np.uint8)
        self.bytes[np.arange(width + 1) < self.size[:, None]] = np.frombuffer(b"".join(strings), np.uint8)
        values = random_words(3, 256)[self.bytes[:, :width]] * random_words(4, width)
        self.prefix = np.zeros((n, width + 1), U64)
        np.cumsum(values, 1, out=self.prefix[:, 1:])
        self.steps = max(1, width.bit_length())

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix: binary search for the longest with equal hashes."""
        low, high = np.zeros(len(a), np.int64), np.minimum(self.size[a], self.size[b])
        for _ in range(self.steps):
            middle = (low + high + 1) >> 1
            equal = self.prefix[a, middle] == self.prefix[b, middle]
            low, high = np.where(equal, middle, low), np.where(equal, high, middle - 1)
        return low

    def before(self, a: np.ndarray, b: np.ndarray, ties: bool | np.ndarray) -> np.ndarray:
        """Whether a sorts before b; ``ties`` is the answer for equal strings."""
        common = self.common(a, b)
        end_a, end_b = common == self.size[a], common == self.size[b]
        smaller = self.bytes[a, common] < self.bytes[b, common]
        return np.where(end_a & end_b, ties, np.where(end_a | end_b, end_a, smaller))

    def sort(self, starts: np.ndarray) -> np.ndarray:
        """Order within each group (rows from one start to the next): mergesort of all groups at once."""
        sizes = np.diff(starts)
        order = np.arange(starts[-1])
        base, size = np.repeat(starts[:-1], sizes), np.repeat(sizes, sizes)
        local = order - base
        width = 1
        while width < sizes.max(initial=0):
            run = local // width
            other = run ^ 1
            low = base + np.minimum(other * width, size)
            high = base + np.minimum((other + 1) * width, size)
            go = np.flatnonzero(low < high)
            x, right = order[go], (run[go] & 1) == 1
            lo, hi = low[go].copy(), high[go].copy()
            for _ in range(width.bit_length()):
                open_ = np.flatnonzero(lo < hi)
                middle = (lo[open_] + hi[open_]) >> 1
                # Equal strings keep their order: those of the left run go first.
                less = self.before(order[middle], x[open_], right[open_])
                lo[open_] = np.where(less, middle + 1, lo[open_])
                hi[open_] = np.where(less, hi[open_], middle)
            to = base[go] + (run[go] // 2) * 2 * width + (local[go] - run[go] * width) + (lo - low[go])
            merged = order.copy()
            merged[to] = x
            order, width = merged, 2 * width
        return order

    def neighbours(self, order: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order and length in common with the string before; -1 at the start of a group.

        Every length is verified against the bytes.  Where hashes collided, the
        group is sorted again by its bytes.
        """

        def measured(order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            common = np.full(len(order), -1, np.int64)
            right = np.ones(len(order), bool)
            a, b = order[:-1], order[1:]
            for lo in range(0, len(a), 4096):
                i, j = a[lo : lo + 4096], b[lo : lo + 4096]
                differ = self.bytes[i] != self.bytes[j]
                true = np.where(differ.any(1), differ.argmax(1), differ.shape[1])
                true = np.minimum(true, np.minimum(self.size[i], self.size[j]))
                common[lo + 1 : lo + 1 + len(i)] = true
                right[lo + 1 : lo + 1 + len(i)] = true == self.common(i, j)
            common[starts[:-1]] = -1
            right[starts[:-1]] = True
            return common, right

        common, right = measured(order)
        if not right.all():
            order = order.copy()
            for group in np.unique(np.searchsorted(starts, np.flatnonzero(~right), "right") - 1):
                own = slice(starts[group], starts[group + 1])
                order[own] = sorted(order[own], key=lambda i: self.bytes[i, : self.size[i]].tobytes())
            common, _ = measured(order)
        return order, common


def repeated_windows(starts: np.ndarray, left: list[bytes], right: list[bytes], length: int, gram: int) -> np.ndarray:
    """For members of groups, whether the window that begins ``offset`` bytes before each is in another.

    ``left`` holds what precedes a member, reversed; ``right`` what follows from
    it on.  One row per member, one column per offset.
    """
    n = starts[-1]
    ordered = []
    for strings, width in ((right, length), (left, length - gram)):
        suffixes = Suffixes(strings, width)
        order, common = suffixes.neighbours(suffixes.sort(starts), starts)
        ordered.append((suffixes.size, order, common))
    (right_size, right_order, right_common), (left_size, left_order, left_common) = ordered
    out = np.zeros((n, length - gram + 1), bool)
    right_class, left_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for offset in range(length - gram + 1):
        able = np.flatnonzero((right_size >= length - offset) & (left_size >= offset))
        if not len(able):
            continue
        # Members in a row that share so much, to the right and to the left.
        right_class[right_order] = np.cumsum(right_common < length - offset)
        left_class[left_order] = np.cumsum(left_common < max(offset, 0))
        key = right_class[able] * (n + 1) + left_class[able]
        _, place, counts = np.unique(key, return_inverse=True, return_counts=True)
        out[able, offset] = counts[place] > 1
    return out


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of true cells of each row: row, first column, last column."""
    padded = np.zeros((len(flags), flags.shape[1] + 2), np.int8)
    padded[:, 1:-1] = flags
    step = np.diff(padded, axis=1)
    row, first = np.nonzero(step == 1)
    _, last = np.nonzero(step == -1)
    return row, first, last - 1


def _sorted_edges(edges: DataFrame, length: int, gram: int) -> DataFrame:
    """Repeated spans around single members of the groups of equal ``slice``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in whole_runs(batches, "slice", 4096):
            starts = run_starts(whole.column("slice").to_numpy())
            left, right = whole.column("left").to_pylist(), whole.column("right").to_pylist()
            flags = repeated_windows(starts, left, right, length, gram)
            flags[whole.column("n").to_numpy() > 1] = False  # settled already
            member, low, high = _runs(flags)
            at, rows = whole.column("at").to_numpy()[member], whole.column("_row").to_numpy()[member]
            yield pa.RecordBatch.from_pydict(
                {"_row": pa.array(rows), "start": pa.array(at - high), "end": pa.array(at - low + length)}
            )

    work = edges.repartition("slice").sortWithinPartitions("slice")
    return work.mapInArrow(run, "_row long, start long, end long")


def _sliced(edges: DataFrame, length: int, gram: int, most: int) -> tuple[DataFrame, DataFrame | None]:
    """Edges whose groups, by ``slice``, are of a size to sort, and spans that slicing has settled.

    A slice is a range of offsets, and members that share the bytes which all
    windows of the range cover; members elsewhere hold none of these windows.
    Members that share the bytes which any window of the range covers are settled
    as one, and one of them goes on.
    """
    names = ["slice", "n", "_row", "at", "left", "right"]
    ready, spans = edges.filter("not big").select(names), None
    rest = edges.filter("big").selectExpr(*names, "0 as lo", f"{length - gram + 1} as hi")
    for _ in range((length - gram).bit_length()):
        if rest.isEmpty():
            return ready, spans
        middle = "cast((lo + hi) div 2 as int)"
        halves = rest.selectExpr(*names, f"explode(array(struct(lo, {middle} as hi), struct({middle} as lo, hi))) as half")
        # The offsets of the range at which a member has a window: its text may begin or end too near.
        low, high = f"greatest(lo, {length} - octet_length(right))", "least(hi - 1, octet_length(left))"
        cut = halves.select(*names, "half.*").filter(f"{low} <= {high}")
        core = f"substring(left, 1, lo), substring(right, 1, {length + 1} - hi)"
        cut = cut.selectExpr(
            f"xxhash64(slice, lo, hi, {core}) as slice",
            *("lo", "hi", "n", "_row", "at", "substring(left, 1, hi - 1) as left", f"substring(right, 1, {length} - lo) as right"),
        )
        cut = staged(cut, "slices")
        same = ["slice", "lo", "hi", "left", "right"]
        member = F.min(F.struct("_row", "at")).alias("one")
        kinds = cut.groupBy(same).agg(F.sum("n").alias("n"), F.count("*").alias("copies"), member)
        kinds = staged(kinds, "slice-kinds")
        whole = cut.join(kinds.filter("copies > 1").select(same), same, "left_semi")
        whole = whole.selectExpr("_row", f"at - {high} as start", f"at - {low} + {length} as end")
        spans = whole if spans is None else spans.unionByName(whole)
        sizes = kinds.groupBy("slice").agg(F.count("*").alias("members")).filter("members > 1")
        members = kinds.join(staged(sizes, "slice-sizes"), "slice").select("*", "one.*")
        ready = ready.unionByName(members.filter(F.col("members") <= most).select(names))
        rest = members.filter(F.col("members") > most).select(*names, "lo", "hi")
    # Slices of one offset hold one window each, unless hashes collided: the sort tells them apart.
    return ready.unionByName(rest.select(names)), spans


# The operator -------------------------------------------------------------------------


def _packed_text(docs: DataFrame) -> DataFrame:
    """Documents with ``text`` replaced by its compressed bytes, for a lighter shuffle."""
    others = [f for f in docs.schema if f.name != "text"]

    def work(batch: pa.RecordBatch) -> dict:
        pack = zstandard.ZstdCompressor(level=3).compress
        out = {f.name: batch.column(f.name) for f in others}
        out["_text"] = [None if t is None else pack(t.encode()) for t in batch.column("text").to_pylist()]
        return out

    return map_batches(docs, work, StructType([*others, StructField("_text", BinaryType())]))


def _contexts(docs: DataFrame, wanted: DataFrame, length: int, gram: int) -> DataFrame:
    """(h, n, _row, at) with up to ``length`` bytes from each place on and, reversed, those before it."""
    per_text = wanted.groupBy("_row").agg(F.collect_list(F.struct("h", "n", "at", "big")).alias("places"))
    # Equal rows share a number and give the same places; those are settled already.
    joined = _packed_text(docs.select("_row", "text")).join(per_text, "_row")

    def work(batch: pa.RecordBatch) -> dict:
        names = ("h", "n", "_row", "at", "big", "left", "right")
        out: dict[str, list] = {name: [] for name in names}
        unpack = zstandard.ZstdDecompressor().decompress
        columns = (batch.column(c).to_pylist() for c in ("_row", "places", "_text"))
        for row, places, text in zip(*columns):
            data = unpack(text) if text else b""
            for p in places:
                at = p["at"]
                values = p["h"], p["n"], row, at, p["big"], data[max(0, at - length + gram) : at][::-1]
                for name, value in zip(names, (*values, data[at : at + length])):
                    out[name].append(value)
        return out

    schema = "h long, n long, _row long, at long, big boolean, left binary, right binary"
    return map_batches(joined, work, schema)


def repeated_spans(docs: DataFrame, length: int, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """(_row, start, end) in bytes, overlapping: together all bytes of repeated windows."""
    if not 0 < gram < length or length - gram > 255:
        raise ValueError("a gram is shorter than the windows, by at most 255 bytes")
    # Stored first: texts are read for the grams and then for the anchors, not for both at once.
    grams = staged(_repeated_grams(docs, length, gram), "grams").withColumn("_again", F.lit(True))
    found = _anchor_rows(docs, length, gram).join(grams, "h", "left").filter("settled or _again")
    found = staged(found.drop("_again"), "anchors")
    settled = found.filter("settled").select("_row", F.col("packed").alias("start"), F.col("s1").alias("end"))
    rows = found.filter("not settled")
    name = ["h", "s1", "s2"]
    kinds = rows.groupBy(name).agg(F.sum("n").alias("n"), F.min(F.struct("_row", "packed")).alias("one"))
    kinds = staged(kinds, "stretches")
    again = rows.join(kinds.filter("n > 1").select(name), name, "left_semi")
    whole = again.select("_row", *_span(F.col("packed"), length))
    # Stored, so that the kinds of a frequent gram can be split among tasks.
    groups = staged(kinds.groupBy("h").agg(F.count("*").alias("kinds")).filter("kinds > 1"), "groups")
    wanted = kinds.join(groups, "h").select(
        "h", "n", F.col("one._row").alias("_row"), _at(F.col("one.packed")).alias("at"), (F.col("kinds") > most).alias("big")
    )
    edges = staged(_contexts(docs, wanted, length, gram), "edges").withColumnRenamed("h", "slice")
    ready, sliced = _sliced(edges, length, gram, most)
    spans = settled.unionByName(whole).unionByName(_sorted_edges(ready, length, gram))
    return spans if sliced is None else spans.unionByName(sliced)


def _cut(docs: DataFrame, length: int, finish: Callable, schema: str | StructType) -> DataFrame:
    """Join the spans to the documents and hand each its bytes and a mask of those to remove."""
    docs = _with_row(docs)
    spans = staged(repeated_spans(docs, length), "spans")
    per_text = spans.groupBy("_row").agg(F.collect_list(F.struct("start", "end")).alias("_spans"))
    joined = _packed_text(docs).join(per_text, "_row", "left").drop("_row")

    def work(batch: pa.RecordBatch) -> dict:
        unpack = zstandard.ZstdDecompressor().decompress
        found = []
        for packed, spans in zip(batch.column("_text").to_pylist(), batch.column("_spans")):
            data = np.frombuffer(b"" if packed is None else unpack(packed), np.uint8)
            step = np.zeros(len(data) + 1, np.int64)
            if spans.is_valid:
                np.add.at(step, spans.values.field("start").to_numpy(), 1)
                np.add.at(step, spans.values.field("end").to_numpy(), -1)
            found.append((packed is None, data, np.cumsum(step[:-1]) > 0))
        return finish(batch, found)

    return map_batches(joined, work, schema)


def find_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` for every row.

    A byte is removed when a ``length``-byte string that covers it also starts
    anywhere else, in this text or another.  A null text counts as empty; null
    ids are kept as they are; repeated rows are texts of their own, so that long
    ones are removed whole.  Texts of any length are read in overlapping parts.
    Other columns are left out; an empty table gives no rows.
    """

    def finish(batch: pa.RecordBatch, found: list) -> dict:
        out: dict = {"doc_id": batch.column("doc_id"), "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
        for _, data, gone in found:
            out["n_bytes"].append(len(data))
            out["n_removed"].append(int(gone.sum()))
            out["n_spans"].append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
            out["kept_sha256"].append(hashlib.sha256(data[~gone].tobytes()).hexdigest())
        return out

    rows = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    return _cut(rows, length, finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """Documents without their repeated passages; same rows and columns.

    Characters of which a part was removed go altogether; ``n_chars``, where it
    exists, follows the text.  Null texts stay null; other columns, of any name,
    stay as they are; an empty table stays empty.
    """
    names = docs.columns
    # Plain names inside, so that no column can clash with those of this module.
    plain = [name if name in ("doc_id", "text", "n_chars") else f"c{i}" for i, name in enumerate(names)]
    docs = docs.toDF(*plain)
    fields = list(docs.schema)

    def finish(batch: pa.RecordBatch, found: list) -> dict:
        out = {f.name: batch.column(f.name) for f in fields if f.name != "text"}
        out["text"] = [None if null else data[~gone].tobytes().decode("utf-8", "ignore") for null, data, gone in found]
        if "n_chars" in out:
            out["n_chars"] = [None if t is None else len(t) for t in out["text"]]
        return out

    return _cut(docs, length, finish, StructType(fields)).toDF(*names)
