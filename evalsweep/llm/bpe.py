"""Byte-level byte pair encoding and decoding with numpy matrices.

A text is cut into pieces by the tokenizer's pattern.  Pieces that a task has not
met before are laid out as rows of padded id matrices, one matrix for each
bucket of lengths.  In every round each row merges its leftmost pair of lowest
rank; pairs are looked up in an open-addressing hash table; rows that have
nothing left to merge leave the matrix.  The ids of a piece are remembered for
the rest of the task, up to a fixed number of pieces.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from evalsweep.llm.common import U64, map_batches, texts
from evalsweep.llm.splitting import Splitter

NONE = np.int32(2**31 - 1)
# Rows of a longer piece would merge for too many rounds: a heap does the same there.
LONGEST_ROW = 256
# Pieces that a task remembers; then it forgets all and goes on.
REMEMBERED = 300_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PairTable:
    """Open-addressing hash table from a pair of ids to the id that it merges into."""

    def __init__(self, ranks: dict[bytes, int]):
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        keys = np.array(left, U64) << U64(32) | np.array(right, U64)
        self.bits = max(4, int(4 * len(keys) + 1).bit_length())
        self.keys = np.full(1 << self.bits, U64(2**64 - 1))
        self.merged = np.full(1 << self.bits, NONE)
        at, values = self._home(keys), np.array(merged, np.int32)
        while len(keys):
            free = self.keys[at] == U64(2**64 - 1)
            # Of several new keys for one free place the last is kept.
            self.keys[at[free]], self.merged[at[free]] = keys[free], values[free]
            left_over = self.keys[at] != keys
            keys, values, at = keys[left_over], values[left_over], at[left_over]
            at = (at + 1) & ((1 << self.bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merged ids of pairs, NONE where a pair does not merge or an id is negative."""
        keys = a.astype(np.int64).view(U64) << U64(32) | (b.astype(np.int64).view(U64) & U64(0xFFFFFFFF))
        shape, keys = keys.shape, keys.ravel()
        at = self._home(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.merged[at], NONE)
        open_ = np.flatnonzero((found != keys) & (found != U64(2**64 - 1)))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.merged[at[open_[hit]]]
            open_ = open_[~hit & (found != U64(2**64 - 1))]
        out = out.reshape(shape)
        out[(a < 0) | (b < 0)] = NONE
        return out


class BytePairs:
    """Encoder and decoder for one table of ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        if any(bytes([i]) not in ranks for i in range(256)):
            raise ValueError("the ranks must hold every single byte")
        self.ranks = ranks
        self.pairs = PairTable(ranks)
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.bytes_of = {rank: token for token, rank in ranks.items()}

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece."""
        out: list[list[int]] = [[]] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[i] = [whole]
            elif len(piece) > LONGEST_ROW:
                out[i] = self._long(piece)
            elif piece:
                buckets.setdefault(max(4, 1 << (len(piece) - 1).bit_length()), []).append(i)
        for width, rows in buckets.items():
            step = max(1, (1 << 20) // width)
            for lo in range(0, len(rows), step):
                self._merge([pieces[i] for i in rows[lo : lo + step]], width, rows[lo : lo + step], out)
        return out

    def _merge(self, pieces: list[bytes], width: int, places: list[int], out: list) -> None:
        n = len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, n)
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        ids = np.full((n, width), -1, np.int32)
        ids[np.arange(width) < sizes[:, None]] = self.single[flat]
        ranks = self.pairs(ids[:, :-1], ids[:, 1:])
        place = np.array(places)
        while True:
            best = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(ids), np.int64)
            low = ranks[np.arange(len(ids)), best] if ranks.shape[1] else np.full(len(ids), NONE)
            done = low == NONE
            if done.any():
                for i, row, size in zip(place[done].tolist(), ids[done].tolist(), sizes[done].tolist()):
                    out[i] = row[:size]
                go = ~done
                if not go.any():
                    return
                ids, ranks, sizes, place = ids[go], ranks[go], sizes[go], place[go]
                best, low = best[go], low[go]
            row = np.arange(len(ids))
            # Every row grows one id shorter: so does the matrix.
            ids[row, best] = low
            columns = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, columns + (columns > best[:, None]), 1)
            columns = np.arange(ranks.shape[1] - 1)
            ranks = np.take_along_axis(ranks, columns + (columns > best[:, None]), 1)
            sizes = sizes - 1
            if not ranks.shape[1]:
                continue
            for at in (best - 1, best):
                on = np.flatnonzero((at >= 0) & (at < ranks.shape[1]))
                ranks[on, at[on]] = self.pairs(ids[on, at[on]], ids[on, at[on] + 1])

    def _long(self, piece: bytes) -> list[int]:
        """The same merges for one long piece: lowest rank first, leftmost among equals."""
        ranks, n = self.ranks, len(piece)
        end = {i: i + 1 for i in range(n)}  # of the part that begins at i
        before = {i: i - 1 for i in range(n)}  # where the part before it begins
        heap = []

        def offer(a: int) -> None:
            b = end.get(a, n)
            if a >= 0 and b < n and (rank := ranks.get(piece[a : end[b]])) is not None:
                heapq.heappush(heap, (rank, a, b, end[b]))

        for a in range(n - 1):
            offer(a)
        while heap:
            _, a, b, stop = heapq.heappop(heap)
            if end.get(a) != b or end.get(b) != stop:
                continue
            end[a] = stop
            del end[b], before[b]
            if stop < n:
                before[stop] = a
            offer(a)
            offer(before[a])
        return [ranks[piece[a:b]] for a, b in sorted(end.items())]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def _by_size(whole: list[str], size: int = 1 << 20) -> Iterable[list[str]]:
    """Runs of texts of about so many characters: enough new pieces for large matrices."""
    part, held = [], 0
    for text in whole:
        part.append(text)
        held += len(text)
        if held >= size:
            yield part
            part, held = [], 0
    if part:
        yield part


class Coder:
    """A task's encoder with what it remembers of pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.split, self.pairs = Splitter(pattern), BytePairs(ranks)
        self.ids: dict[str, bytes] = {}  # piece -> its ids as text, a comma after each
        self.back: dict[str, bytes] = {}  # piece -> the bytes that its ids decode to

    def learn(self, wanted: set[str]) -> None:
        if len(self.ids) + len(wanted) > REMEMBERED:
            self.ids.clear()
            self.back.clear()
        new = [piece for piece in wanted if piece not in self.ids]
        for piece, ids in zip(new, self.pairs.encode([piece.encode() for piece in new])):
            self.ids[piece] = b"%d," * len(ids) % tuple(ids)
            self.back[piece] = self.pairs.decode(ids)

    def run(self, whole: list[str]) -> Iterable[tuple[bytes, bytes]]:
        """For each text its ids, joined by commas, and the bytes they decode to."""
        for part in _by_size(whole):
            split = [self.split(text) for text in part]
            wanted = set().union(*split)
            if not wanted <= self.ids.keys():
                self.learn(wanted)
            ids, back = self.ids.__getitem__, self.back.__getitem__
            for pieces in split:
                yield b"".join(map(ids, pieces))[:-1], b"".join(map(back, pieces))


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Token ids of every text and what they decode to, as counts and digests.

    ``with_ids`` adds the ids and the decoded text.  No special tokens.  A null
    text counts as empty: no ids.  Null ids and repeated rows are kept as they
    are; other columns are left out; an empty table gives no rows.  Of equal pairs
    the leftmost merges first.  Texts of any length are encoded whole; pieces of
    more than ``LONGEST_ROW`` bytes, which would widen the matrices, merge by the
    same rule through a heap.  ``ranks_path`` is read where tasks run.
    """

    def work(batch: pa.RecordBatch, coder: Coder) -> dict:
        out: dict = {"doc_id": batch.column("doc_id"), "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        if with_ids:
            out |= {"ids": [], "decoded": []}
        for ids, back in coder.run(texts(batch)):
            out["n_tokens"].append(ids.count(b",") + 1 if ids else 0)
            out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(back).hexdigest())
            if with_ids:
                out["ids"].append([int(i) for i in ids.split(b",") if i])
                out["decoded"].append(back.decode())
        return out

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>, decoded string" * with_ids
    rows = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    return map_batches(rows, work, schema, lambda: Coder(read_ranks(ranks_path), pattern))
