import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from evalsweep.llm import bpe, packing

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")


def odd_strings(rng):
    alphabet = "ab \n\t's1é日.😀\x85\xa0\x1d\u2003½Ⅷ\r"
    made = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 300))) for _ in range(400)]
    return made + ["", " ", "ab" * 900, "a" * 700 + "b", "  x", " " * 999 + "x", "it's we'll 'S", "<|endoftext|>", "é" * 400]


@pytest.fixture(scope="module")
def coder():
    return bpe.Coder(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(coder):
    ranks = coder.pairs.ranks
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_the_library_and_decode_back(coder, library, rng):
    texts = odd_strings(rng)
    for text, (ids, back) in zip(texts, coder.run(texts)):
        assert ids.decode() == ",".join(map(str, library.encode_ordinary(text))), text
        assert back.decode() == text


def test_forgetting_changes_nothing(coder, library, rng, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    texts = odd_strings(rng)[:60]
    for text, (ids, _) in zip(texts, coder.run(texts)):
        assert ids.decode() == ",".join(map(str, library.encode_ordinary(text)))


def test_a_long_piece_merges_like_a_row(coder, rng):
    piece = "".join(rng.choice("abcdeé") for _ in range(200)).encode()[:250]
    rows = [None]
    coder.pairs._merge([piece], 256, [0], rows)
    assert rows[0] == coder.pairs._long(piece)


def test_encoding_odd_tables(odd_docs, no_docs, library):
    out = bpe.encode_decode(odd_docs, RANKS, public_tokenizers.PATTERN, with_ids=True)
    texts = {(r["doc_id"], r["text"] or "") for r in odd_docs.collect()}
    rows = out.collect()
    assert len(rows) == odd_docs.count()
    for row in rows:
        assert (row["doc_id"], row["decoded"]) in texts
        ids = library.encode_ordinary(row["decoded"])
        assert row["ids"] == ids and row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(row["decoded"].encode()).hexdigest()
    assert bpe.encode_decode(no_docs, RANKS, public_tokenizers.PATTERN).count() == 0


# Packing ------------------------------------------------------------------------------


def test_pieces_have_the_ids_of_the_library(rng):
    own = packing.Tokenizer(JSON, public_tokenizers.PATTERN)
    library = Tokenizer.from_file(JSON)
    library.encode_special_tokens = True
    for text in odd_strings(rng):
        ids = np.frombuffer(own.ids(text), "<u4").tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids, text


def test_added_tokens_in_a_text_have_the_ids_of_the_library(spark, rng):
    own, library = packing.Tokenizer(JSON, public_tokenizers.PATTERN), Tokenizer.from_file(JSON)
    parts = ["<|endoftext|>", "<|endoftext", "|>", " ", "  \n", "a", "é日", "'s", "<"]
    texts = ["a<|endoftext|>b", *("".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(300))]
    expected = [library.encode(text, add_special_tokens=False).ids for text in texts]
    assert expected[0] == [64, 50256, 65]
    for text, ids in zip(texts, expected):
        assert np.frombuffer(own.document(text), "<u4").tolist() == ids, text
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    packed = {r["doc_id"]: r for r in packing.pack(docs, JSON, public_tokenizers.PATTERN).collect()}
    for i, ids in enumerate(expected):
        assert packed[i]["doc_tokens"] == len(ids) + 1
        assert packed[i]["ids_crc32"] == zlib.crc32(np.array([*ids, 0], "<u4").tobytes())


def test_first_fit_decreasing_equals_a_plain_scan(rng):
    for _ in range(50):
        sizes = [rng.randint(1, 100) for _ in range(rng.randint(0, 60))]
        bins, expected = [], [None] * len(sizes)
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            at = next((b for b, used in enumerate(bins) if used + sizes[i] <= 100), len(bins))
            if at == len(bins):
                bins.append(0)
            expected[i] = (at, bins[at])
            bins[at] += sizes[i]
        assert packing.first_fit_decreasing(sizes, 100) == expected


def check_packed(rows, texts, size):
    """Every id once, sequences gapless and within size, digests right."""
    library = Tokenizer.from_file(JSON)
    library.encode_special_tokens = True
    pieces, sequences = {}, {}
    for r in rows:
        assert 0 < r["length"] <= size
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    expected = {}
    for doc_id, text in texts:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for lo in range(0, len(ids), size):
            part = ids[lo : lo + size]
            expected.setdefault(doc_id, []).append((lo, len(part), zlib.crc32(part.tobytes()), len(ids)))
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in expected.items()}
    return len(sequences)


def test_packing_odd_tables(odd_docs, no_docs):
    rows = packing.pack(odd_docs, JSON, public_tokenizers.PATTERN, size=64, group=4).collect()
    check_packed(rows, [(r["doc_id"], r["text"]) for r in odd_docs.collect()], 64)
    assert packing.pack(no_docs, JSON, public_tokenizers.PATTERN).count() == 0


def test_packing_leaves_little_room(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = packing.pack(docs, JSON, public_tokenizers.PATTERN).collect()
    n = check_packed(rows, [(r["doc_id"], r["text"]) for r in docs.collect()], 1024)
    tokens = sum(r["length"] for r in rows)
    assert n <= 1.01 * tokens / 1024 + 1
