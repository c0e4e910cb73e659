"""Packing documents into sequences: first-fit decreasing in randomised groups.

Documents are cut into full pieces and a rest.  Groups of documents, chosen by a
hash, are packed on their own: a full piece is a sequence, rests go, longest
first, into the first sequence with room, which a tournament tree over the
sequences' free space finds in logarithmic time.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalsweep.llm.common import map_batches, staged, texts
from evalsweep.llm.splitting import Splitter

# Pieces of text whose ids a task remembers; then it forgets all and goes on.
REMEMBERED = 400_000
# Documents to a group, about: enough for a tight fit, few enough for one small task.
GROUP = 2048


class Room:
    """Tournament tree of free space: the first of ``n`` bins with enough room."""

    def __init__(self, n: int, size: int):
        self.leaves = 1 << max(0, n - 1).bit_length()
        self.best = [size] * (2 * self.leaves)

    def place(self, need: int) -> tuple[int, int]:
        """Take ``need`` from the first bin that has it; the bin and the room it had."""
        best, at = self.best, 1
        while at < self.leaves:
            at *= 2
            if best[at] < need:
                at += 1
        room = best[at]
        best[at] = room - need
        bin_ = at - self.leaves
        while at > 1:
            at //= 2
            best[at] = max(best[2 * at], best[2 * at + 1])
        return bin_, room


def first_fit_decreasing(sizes: Iterable[int], size: int) -> list[tuple[int, int]]:
    """Bin and offset of every item; ties keep their order."""
    sizes = list(sizes)
    tree, out = Room(len(sizes), size), [(0, 0)] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        bin_, room = tree.place(sizes[i])
        out[i] = bin_, size - room
    return out


def _ranks(path: str) -> dict[bytes, int]:
    """Byte strings and ids of a byte-level vocabulary file, special tokens left out.

    The file writes bytes as printable letters: visible ones as they are, the
    others in order from U+0100.  Ids rise in the order of the merges, as the
    merging by ranks needs it; a file of another order is refused.
    """
    with open(path, encoding="utf-8") as lines:
        stored = json.load(lines)
    letter, extra = {}, 0
    for byte in range(256):
        if 33 <= byte <= 126 or 161 <= byte <= 172 or 174 <= byte:
            letter[chr(byte)] = byte
        else:
            letter[chr(256 + extra)] = byte
            extra += 1
    special = {token["content"] for token in stored["added_tokens"]}
    vocabulary, model = stored["model"]["vocab"], stored["model"]
    merged = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if model["type"] != "BPE" or merged != sorted(merged):
        raise ValueError(f"{path} is no byte-level vocabulary whose ids rise with its merges")
    return {
        bytes(letter[c] for c in token): i for token, i in vocabulary.items() if token not in special
    }


def _added(path: str) -> dict[str, int]:
    """Added tokens of a vocabulary file and their ids; those that take in what is around them are refused."""
    with open(path, encoding="utf-8") as lines:
        tokens = json.load(lines)["added_tokens"]
    if any(token[flag] for token in tokens for flag in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"{path} has added tokens that depend on the text around them")
    return {token["content"]: token["id"] for token in tokens}


class Tokenizer(dict):
    """Pieces of text and their ids, as little-endian 32-bit numbers."""

    def __init__(self, path: str, pattern: str):
        self.split = Splitter(pattern)
        self.encoding = tiktoken.Encoding(
            "pieces", pat_str=pattern, mergeable_ranks=_ranks(path), special_tokens={}
        )
        added = _added(path)
        self.added = {token: np.array([i], "<u4").tobytes() for token, i in added.items()}
        # Leftmost, and of several there the longest.
        longest = sorted(map(re.escape, added), key=len, reverse=True)
        self.between = re.compile("(%s)" % "|".join(longest)).split if added else lambda text: [text]

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = np.array(self.encoding.encode_ordinary(piece), "<u4").tobytes()
        self[piece] = ids
        return ids

    def ids(self, text: str) -> bytes:
        """Ids of a text in which added tokens are text like any other."""
        return b"".join(map(self.__getitem__, self.split(text)))

    def document(self, text: str) -> bytes:
        """Ids of a text; an added token that stands in it is one id, as the library has it by default."""
        parts = self.between(text)
        if len(parts) == 1:
            return self.ids(text)
        return b"".join(self.added[part] if i % 2 else self.ids(part) for i, part in enumerate(parts))


def cut(docs: DataFrame, tokenizer: str, pattern: str, size: int, end_id: int) -> DataFrame:
    """One row per piece of at most ``size`` ids: its place, length, digest, and a number of the document."""

    def work(batch: pa.RecordBatch, coder: Tokenizer) -> dict:
        names = ("doc_id", "row", "start", "length", "ids_crc32", "doc_tokens")
        out: dict[str, list] = {name: [] for name in names}
        ends = np.array([end_id], "<u4").tobytes()
        rows = zip(batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), texts(batch))
        for doc_id, row, text in rows:
            ids = coder.document(text) + ends
            for start in range(0, len(ids), 4 * size):
                piece = ids[start : start + 4 * size]
                values = (doc_id, row, start // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4)
                for name, value in zip(names, values):
                    out[name].append(value)
        return out

    # A number of its own for each row, so that repeated ids do not meet in one group.
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.monotonically_increasing_id().alias("row"),
    )
    schema = "doc_id long, row long, start long, length long, ids_crc32 long, doc_tokens long"
    return map_batches(rows, work, schema, lambda: Tokenizer(tokenizer, pattern))


def pack(
    docs: DataFrame,
    tokenizer: str,
    pattern: str,
    size: int = 1024,
    end_id: int = 0,
    group: int = GROUP,
) -> DataFrame:
    """Sequences of at most ``size`` ids that hold every id of every document once.

    A document's ids are followed by ``end_id``; a null or empty text gives that
    id alone.  Added tokens of the vocabulary that stand in a text have their ids.
    One row per piece: document, where it starts there, its sequence and its offset
    in it.  Texts of any length are cut into full pieces and a rest.  Repeated rows
    are documents of their own; null ids stay null; other columns are left out; an
    empty table gives no rows.  Ids of sequences are unique but not gapless.
    ``tokenizer`` is read where tasks run.
    """
    pieces = staged(cut(docs, tokenizer, pattern, size, end_id), "pieces")
    n_docs = pieces.filter("start = 0").count()
    groups = max(1, -(-n_docs // group))
    grouped = pieces.withColumn("grp", F.pmod(F.xxhash64("row"), F.lit(groups)))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

    def place(part: pa.Table) -> pa.Table:
        part = part.sort_by([("row", "ascending"), ("start", "ascending")])
        lengths = part.column("length").to_numpy()
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        full = lengths == size
        sequence[full] = np.arange(full.sum())
        places = first_fit_decreasing(lengths[~full].tolist(), size)
        if places:
            bins, offsets = zip(*places)
            sequence[~full] = np.array(bins) + full.sum()
            offset[~full] = offsets
        sequence += part.column("grp")[0].as_py() << 32
        out = part.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        return out.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return grouped.groupBy("grp").applyInArrow(place, schema)
