import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from evalsweep.llm import periodic
from evalsweep.llm.queries import QUERIES, planted_order


def runs_by_hand(words, least=24, times=3):
    """Every period tried at every place."""
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                found.setdefault((i, j + q), q)  # smaller periods come first
            i = j + 1
    return sorted((a, q, b - a) for (a, b), q in found.items())


def odd_texts(rng):
    for _ in range(120):
        k = rng.choice([1, 2, 3, 5, 50])
        words = [rng.randrange(k) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 4)):
            part = [rng.randrange(k) for _ in range(rng.randint(1, rng.choice([3, 12, 40])))]
            part = part * rng.randint(2, 9)
            part = part[: len(part) - rng.randint(0, 3)]
            if rng.random() < 0.4:  # runs of runs
                part = (part + [rng.randrange(k)]) * rng.randint(1, 5)
            words += part + [rng.randrange(k) for _ in range(rng.randint(0, 20))]
        yield words


def test_runs_equal_brute_force(rng):
    texts = list(odd_texts(rng))
    texts += texts[:5]  # whole copies: their runs are found once and moved
    for lo in range(0, len(texts), 5):
        some = texts[lo : lo + 5]
        starts = np.r_[0, np.cumsum([len(t) for t in some])]
        s, e, q = periodic.runs_of(np.array([w for t in some for w in t], np.int64), starts)
        expected = [(int(o) + a, p, n) for t, o in zip(some, starts) for a, p, n in runs_by_hand(t)]
        assert list(zip(s.tolist(), q.tolist(), (e - s).tolist())) == expected


def test_grammar_gives_its_text_back(rng):
    for words in odd_texts(rng):
        if not words:
            continue
        half = len(words) // 2
        g = periodic.re_pair(np.array(words, np.int64), np.unique([0, half, len(words)]), max(words) + 1)

        def spell(symbol):
            return [symbol] if g.left[symbol] < 0 else spell(g.left[symbol]) + spell(g.right[symbol])

        assert [w for symbol in g.top.tolist() for w in spell(symbol)] == words
        for rule in np.flatnonzero(g.left >= 0).tolist():
            assert words[g.first[rule] : g.first[rule] + g.size[rule]] == spell(rule)


def test_collided_hashes_are_measured_again(rng, monkeypatch):
    true = periodic.PolyHash.of
    monkeypatch.setattr(periodic.PolyHash, "of", lambda self, a, b: true(self, a, b) & np.uint64(3))
    for words in odd_texts(rng):
        if len(words) < 24:
            continue
        flat, n = np.array(words, np.int64), len(words)
        mid = np.arange(1, n)
        row, s, e, q = periodic.crossing(flat, np.full(n, n), np.zeros(n - 1, int), mid, np.full(n - 1, n), 24, 3)
        for a, b, p in set(zip(s.tolist(), e.tolist(), q.tolist())):
            assert words[a : b - p] == words[a + p : b] and b - a >= max(24, 3 * p)


@pytest.mark.parametrize("period", [1, 7, 20_000])
def test_long_periods(period):
    words = np.r_[-np.arange(1, 10) % 99_999, np.arange(100_000) % period, 77_777].astype(np.int64)
    s, e, q = periodic.runs_of(words, np.array([0, len(words)]))
    assert (s.tolist(), e.tolist(), q.tolist()) == ([9], [100_009], [period])


def expected_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        a, g = (h // 10) % n, h // 10
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = runs_by_hand(words)
    dropped = {i for a, q, length in runs for i in range(a + q, a + length)}
    best = min(runs, key=lambda r: (-r[2] / r[1], r[0], r[1]), default=None)
    lines = "".join(f"{a},{length},{q}\n" for a, q, length in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    shown = (best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4
    return (doc_id, len(runs), *shown, *(hashlib.sha256(t.encode()).hexdigest() for t in (lines, kept)))


def test_query_equals_plain_version(spark, odd_docs, no_docs, tmp_path):
    many = [(1000 + i, "a b c d e f " * 9 + "x y " * (i % 30) + str(i)) for i in range(60)]
    docs = odd_docs.unionByName(spark.createDataFrame(many, "doc_id long, text string"), allowMissingColumns=True)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["op11_periodic_runs"](spark, str(tmp_path))
    expected = [expected_row(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    key = lambda row: tuple((v is not None, v) for v in row)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(expected, key=key)
    assert any(row[1] for row in expected)
    assert periodic.find_runs(no_docs, planted_order).count() == 0


def test_general_result(spark):
    docs = spark.createDataFrame([(1, "s " + "p q " * 20 + "t"), (2, None)], "doc_id long, text string")
    one, two = sorted(periodic.find_runs(docs).collect())
    assert one["n_words"] == 42 and one["longest"]["period"] == 2 and one["collapsed"] == "s p q t"
    assert [r.asDict() for r in one["runs"]] == [{"start": 1, "length": 40, "period": 2}]
    assert two["runs"] == [] and two["longest"] is None and two["collapsed"] == ""
