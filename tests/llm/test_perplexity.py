import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from evalsweep.llm import perplexity
from evalsweep.llm.queries import QUERIES

SPACE = " \t\n\x0b\x0c\r"


def plain_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(3)}
    lines = [line for line in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text or ""),
        sum(line in lines[:i] for i, line in enumerate(lines)),
        len(covered),
    )


def plain_symbols(text):
    """Gaps as one blank, digits as one digit, small letters."""
    out = [" "]
    for c in (text or "").lower():
        c = " " if ord(c) < 33 or (ord(c) < 4096 and c.isspace()) else "0" if ord(c) < 4096 and c.isdigit() else c
        if not (c == " " == out[-1]):
            out.append(c)
    return out[1:] + ([] if out[-1] == " " and len(out) > 1 else [" "])


def plain_model(texts):
    """Interpolated modified Kneser-Ney by the book, over tuples of characters."""
    grams = Counter()
    for text in texts:
        line = [" "] * 4 + plain_symbols(text)
        grams.update(tuple(line[i - 4 : i + 1]) for i in range(4, len(line)))
    levels = {5: grams}
    for k in range(4, 0, -1):
        before = defaultdict(set)
        for g in levels[k + 1]:
            before[g[1:]].add(g[0])
        levels[k] = {g: len(s) for g, s in before.items()}
    p = {(): 1 / 4096}
    for k in range(1, 6):
        n = Counter(min(c, 5) for c in levels[k].values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else 0.0
        d = {}
        for i in (1, 2, 3):
            found = i - (i + 1) * y * n[i + 1] / n[i] if n[i] else -1.0
            d[i] = found if n[1] and 0 < found < i else i / 2
        total, rest = Counter(), Counter()
        for g, c in levels[k].items():
            total[g[:-1]] += c
            rest[g[:-1]] += d[min(c, 3)]
        p |= {
            g: ((c - d[min(c, 3)]) + rest[g[:-1]] * p[g[1:]]) / total[g[:-1]] for g, c in levels[k].items()
        }
    return p


def plain_perplexity(text, model):
    line = [" "] * 4 + plain_symbols(text)
    found = [math.log(model[tuple(line[i - 4 : i + 1])]) for i in range(4, len(line))]
    return -sum(found) / len(found), len(found)


@pytest.fixture(scope="module")
def prose(spark):
    rng = random.Random(2)
    syllables = ["ba", "ke", "lin", "to", "ra", "mo", "su", "del", "ig"]
    rows = []
    for i in range(260):
        words = ["".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(rng.randint(55, 160))]
        rows.append((i, " ".join(words).capitalize() + ".\nAb 12 " + rng.choice("xyz"), rng.choice(["en", "de", None])))
    for i in range(6):  # noise
        rows.append((920 + i, "".join(rng.choices("qwxzjkvpfhgycnöäüßéè ", k=600)), "en"))
    rows.append((901, " ".join(["bake", "kera", "lin", "to"] * 5 + ["bake lin"] * 30), "en"))
    rows.append((902, "#*|<> & $ % word\nsame\nsame\n \nsame", "de"))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows


def test_equals_plain_version(prose):
    docs, rows = prose
    models = {lang: plain_model([t for _, t, x in rows if x == lang]) for lang in ("en", "de", None)}
    found = {r["doc_id"]: r for r in perplexity.judge_quality(docs).collect()}
    assert len(found) == len(rows)
    for key, text, lang in rows:
        row = found[key]
        assert tuple(row[name] for name in perplexity.MEASURES) == plain_base(text)
        expected, n = plain_perplexity(text, models[lang])
        assert row["lang"] == (lang or "") and row["n_grams"] == n
        assert row["log_perplexity"] == pytest.approx(expected, abs=1e-6)
        failed = row["n_words"] < 50 or 100 * row["n_repeat_words"] > 50 * row["n_words"]
        assert row["base_failed"] == failed
        assert row["kept"] == (not failed and row["low"] <= row["log_perplexity"] <= row["high"])
    for lang in ("en", "de", None):
        values = sorted(math.floor(1000 * found[k]["log_perplexity"]) / 1000 for k, _, x in rows if x == lang)
        q = [values[math.ceil(share * len(values)) - 1] for share in (0.25, 0.5, 0.75)]
        one = next(found[k] for k, _, x in rows if x == lang)
        scatter = 1.5 / math.sqrt(one["n_grams"])
        assert one["low"] == pytest.approx(q[1] - 5 * max(q[1] - q[0], 0.02) - scatter)
        assert one["high"] == pytest.approx(q[1] + 5 * max(q[2] - q[1], 0.02) + scatter)
    english = {k: found[k]["log_perplexity"] for k, _, x in rows if x == "en"}
    assert min(english[k] for k in english if k >= 920) > max(english[k] for k in english if k < 260)
    assert not any(found[k]["kept"] for k in range(920, 926))
    assert found[901]["base_failed"] and found[902]["n_dup_lines"] == 2 and found[902]["n_symbols"] == 8
    assert sum(found[k]["kept"] for k in range(260)) >= 258


def test_small_blocks_give_the_same(prose, monkeypatch):
    docs, _ = prose
    whole = sorted(map(tuple, perplexity.judge_quality(docs).collect()))
    monkeypatch.setattr(perplexity, "BLOCK_BYTES", 5000)
    parted = sorted(map(tuple, perplexity.judge_quality(docs).collect()))
    assert len(whole) == len(parted)
    for a, b in zip(whole, parted):
        assert a == pytest.approx(b)


def test_probabilities_add_up():
    model = plain_model(["ab ba abba", "b a b"])
    for context in {g[:-1] for g in model if len(g) == 5}:
        assert sum(p for g, p in model.items() if len(g) == 5 and g[:-1] == context) <= 1.0 + 1e-12


def test_odd_texts(spark, odd_docs, no_docs):
    rows = odd_docs.select("doc_id", "text").collect()
    found = perplexity.judge_quality(odd_docs).collect()
    assert len(found) == len(rows)
    given = sorted((str(r["doc_id"]), *plain_base(r["text"])) for r in rows)
    assert sorted((str(r["doc_id"]), *(r[m] for m in perplexity.MEASURES)) for r in found) == given
    assert all(np.isfinite(r["log_perplexity"]) for r in found)
    assert perplexity.judge_quality(no_docs).count() == 0


def test_query_keeps_clean_texts(spark):
    sf = "/root/testdata/sf0.01"
    found = QUERIES["op13_quality_rules"](spark, sf).filter("not base_failed")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    n, kept = found.join(labels, "doc_id").filter("quality = 1").selectExpr("count(*)", "count_if(kept)").first()
    assert n > 200 and kept >= 0.99 * n
