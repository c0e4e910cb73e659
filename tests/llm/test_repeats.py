import hashlib

import numpy as np
import pyarrow as pa
import pytest

from evalsweep.llm import repeats
from evalsweep.llm.common import PolyHash, mixed, run_starts


def by_brute_force(rows, length):
    seen = {}
    for k, (_, text) in enumerate(rows):
        data = (text or "").encode()
        for i in range(len(data) - length + 1):
            seen.setdefault(data[i : i + length], []).append((k, i))
    gone = [np.zeros(len((t or "").encode()), bool) for _, t in rows]
    for places in seen.values():
        if len(places) > 1:
            for k, i in places:
                gone[k][i : i + length] = True
    out = []
    for (doc_id, text), g in zip(rows, gone):
        data = np.frombuffer((text or "").encode(), np.uint8)
        spans = int(g[:1].sum() + (g[1:] & ~g[:-1]).sum())
        out.append((doc_id, len(data), int(g.sum()), spans, hashlib.sha256(data[~g].tobytes()).hexdigest()))
    return sorted(out, key=str)


def check(df, rows, length=200):
    assert sorted(map(tuple, repeats.find_repeats(df, length).collect()), key=str) == by_brute_force(rows, length)


def made(rng, n=60):
    """Texts of passages that many share, cut and joined anywhere, some periodic."""
    words = ["alpha", "beta", "gämma", "delta", "eps", "zeta", "日本"]
    passages = [" ".join(rng.choice(words) + str(rng.randint(0, 99)) for _ in range(60)) for _ in range(6)]
    passages += ["ab" * 300, "-" * 450]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            parts += [p[a : a + rng.randint(100, 400)], str(rng.random())]
        rows.append((i, "".join(parts)))
    return rows


@pytest.mark.parametrize("length", [200, 60])
def test_spans_equal_brute_force(spark, rng, length):
    rows = made(rng)
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows, length)


@pytest.mark.parametrize("most", [1, 7])
def test_slices_of_large_groups_have_the_same_result(spark, rng, most):
    rows = made(rng)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = repeats._with_row(df)
    by_sort = {tuple(r) for r in _covered(repeats.repeated_spans(whole, 200).collect())}
    by_slices = {tuple(r) for r in _covered(repeats.repeated_spans(whole, 200, most=most).collect())}
    assert by_sort == by_slices


@pytest.mark.parametrize("most", [1, 7])
def test_slices_equal_brute_force_at_text_ends(spark, rng, monkeypatch, most):
    monkeypatch.setattr(repeats.repeated_spans, "__defaults__", (repeats.GRAM, most))
    passage = "".join(rng.choice("abcdefgh ") for _ in range(400))
    rows = []
    for i in range(120):  # the passage from anywhere to anywhere, alone or between other bytes
        a, b = rng.randint(0, 199), rng.randint(200, 400)
        before, after = ("".join(rng.choice("xyz ") for _ in range(rng.choice([0, 3, 90, 300]))) for _ in range(2))
        rows.append((i, before + passage[a:b] + after))
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)


@pytest.mark.parametrize("most", [5, repeats.MOST])
def test_colliding_gram_hashes_change_no_result(spark, rng, monkeypatch, most):
    of = PolyHash.of
    monkeypatch.setattr(PolyHash, "of", lambda self, a, b: mixed(of(self, a, b) % np.uint64(97)))
    monkeypatch.setattr(repeats.repeated_spans, "__defaults__", (repeats.GRAM, most))
    rows = made(rng, 30)
    rows += [(100 + i, "".join(rng.choice("abcdefgh ") for _ in range(700))) for i in range(10)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def _covered(spans):
    return {(r["_row"], at) for r in spans for at in range(r["start"], r["end"])}


def test_odd_tables(odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    check(odd_docs, rows)
    assert repeats.find_repeats(no_docs).count() == 0
    clean = repeats.remove_repeats(odd_docs)
    assert clean.columns == odd_docs.columns and clean.count() == odd_docs.count()
    by_id = {r["doc_id"]: r for r in clean.collect()}
    assert by_id[0]["text"] is None and by_id[9]["text"] == "" and by_id[10]["text"] == rows[10][1]
    assert by_id[3]["_row"] == "x" and by_id[3]["keys"] == [1]


def test_the_given_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check(df, [(r["doc_id"], r["text"]) for r in df.collect()])


def test_long_texts_are_read_in_parts(rng, monkeypatch):
    text = "".join(rng.choice("abcdefgh ") for _ in range(20_000))
    column = pa.array(["short", text, None, text[5000:9000]])

    def windows(part):
        """The anchor's gram hash and place of every window."""
        monkeypatch.setattr(repeats, "PART", part)
        out = {}
        for text, begin, end, at, h in repeats._each_anchor(column, PolyHash(), 200, 50):
            for row in zip(text.tolist(), begin.tolist(), end.tolist(), at.tolist(), h.tolist()):
                for s in range(row[1], row[2] + 1):
                    assert (row[0], s) not in out
                    out[row[0], s] = row[3], row[4]
        return out

    assert windows(3000) == windows(1 << 20)
    assert len(windows(3000)) == 20_000 - 199 + 4000 - 199


def test_parts_have_the_anchors_of_the_whole_text(rng, monkeypatch):
    text = "".join(rng.choice("abcdefgh ") for _ in range(20_000))
    column = pa.array(["short", text, None, "-" * 9000 + text[5000:9000]])

    def found(part):
        monkeypatch.setattr(repeats, "PART", part)
        rows = repeats._each_anchor(column, PolyHash(), 200, 50, named=True)
        return sorted(tuple(map(str, row)) for columns in rows for row in zip(*(x.tolist() for x in columns)))

    whole = found(1 << 20)
    assert found(3000) == found(801) == found(10) == whole
    assert len({(row[0], row[3]) for row in whole}) == len(whole)


def test_long_texts_lose_nothing_at_the_ends_of_parts(spark, rng, monkeypatch):
    monkeypatch.setattr(repeats, "PART", 3000)
    long = ["".join(rng.choice("abcdefgh ü") for _ in range(n)) for n in (30_000, 20_000, 9000)]
    rows = list(enumerate([*long, long[0][14_000:14_500], long[2][:2990] + "x" + long[2][2990:6100], "-" * 7000]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(df, rows)
    kept = {r["doc_id"]: r for r in repeats.find_repeats(df).collect()}
    assert kept[1]["n_removed"] == 0


# Suffix sort --------------------------------------------------------------------------


def test_the_sort_equals_python_in_every_group(rng):
    strings, starts = [], [0]
    for _ in range(40):
        strings += ["".join(rng.choice("ab") for _ in range(rng.randint(0, 20))).encode() for _ in range(rng.randint(1, 40))]
        starts.append(len(strings))
    suffixes = repeats.Suffixes(strings, 20)
    order, common = suffixes.neighbours(suffixes.sort(np.array(starts)), np.array(starts))
    for a, b in zip(starts[:-1], starts[1:]):
        assert [strings[i] for i in order[a:b]] == sorted(strings[a:b])
        assert common[a] == -1
        for place in range(a + 1, b):
            x, y = strings[order[place - 1]], strings[order[place]]
            same = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
            assert common[place] == same


def test_hash_collisions_are_found_and_repaired(rng):
    strings = ["".join(rng.choice("abc") for _ in range(12)).encode() for _ in range(50)]
    suffixes = repeats.Suffixes(strings, 12)
    suffixes.prefix[:] = 0  # every comparison now claims equality
    starts = run_starts(np.zeros(50))
    order, _ = suffixes.neighbours(suffixes.sort(starts), starts)
    assert [strings[i] for i in order] == sorted(strings)
