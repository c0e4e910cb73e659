import re

import pytest

from evalsweep.llm import components, near_texts, repeats

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    found = WORD.findall((text or "").translate(LOWER))
    if len(found) < 5:
        return {tuple(found)} if found else set()
    return {tuple(found[i : i + 5]) for i in range(len(found) - 4)}


def by_brute_force(rows):
    """(doc_id, set size, component) of every row; rows that share an id are one node."""
    sets = [shingles(text) for _, text in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and None not in (rows[i][0], rows[j][0]):
                if 100 * len(a & b) >= 85 * len(a | b):
                    x, y = root(rows[i][0]), root(rows[j][0])
                    parent[max(x, y)] = min(x, y)
    return sorted(
        ((i, len(s), None if i is None else root(i)) for (i, _), s in zip(rows, sets)), key=str
    )


def check(df, rows):
    out = near_texts.near_duplicates(df).collect()
    assert sorted(((r[0], r[1], r[2]) for r in out), key=str) == by_brute_force(rows)
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in out)
    return out


def test_odd_tables(odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    check(odd_docs, rows)
    assert near_texts.near_duplicates(no_docs).count() == 0
    kept = near_texts.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    assert kept.filter("doc_id = 5").count() == 1 and kept.filter("doc_id = 6").count() == 0


@pytest.mark.parametrize("block", [512, 7])
def test_near_copies_in_large_groups(spark, rng, monkeypatch, block):
    """Groups whose members are not all near the smallest: links must chain through others."""
    monkeypatch.setattr(near_texts, "BLOCK", block)
    rows = []
    for group in range(3):
        base = [f"w{group}_{rng.randint(0, 300)}" for _ in range(120)]
        for _ in range(45):
            text = list(base)
            for _ in range(rng.randint(0, 4)):
                text[rng.randrange(len(text))] = f"x{rng.randint(0, 999)}"
            rows.append((len(rows) * 7 % 1000, " ".join(text)))
    rows += [(2000 + i, rows[i * 5][1].upper()) for i in range(20)]
    rng.shuffle(rows)
    out = check(spark.createDataFrame(rows, "doc_id long, text string"), rows)
    assert len({r["component_id"] for r in out}) > 3


def test_the_given_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check(df, [(r["doc_id"], r["text"]) for r in df.collect()])


def test_repeated_rows_leave_one_whose_text_survives(spark, rng):
    def text(n=120):
        return " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))

    twice, often, near, other, lone, null = (text() for _ in range(6))
    rows = [(1, twice, "a"), (1, twice, "b"), *[(2, often, "a")] * 5, (8, often, "c"), (8, often, "c")]
    rows += [(3, near, "a"), (3, near + " end", "a"), (3, other, "a"), (4, lone, "a"), (5, None, "a"), (5, None, "a")]
    rows += [(None, null, "a"), (None, null, "a"), (None, other[:300], "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = near_texts.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    found = sorted(((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()))
    assert [i for i, _ in found] == [0, 0, 1, 2, 3, 3, 4, 5]
    texts = [t for _, t in found]
    assert {twice, often, other, lone, null} <= set(texts) and (near in texts) != (near + " end" in texts)
    clean = {(r["doc_id"], r["text"]) for r in repeats.remove_repeats(kept).collect()}
    assert {(1, twice), (2, often), (4, lone), (None, null)} <= clean


# Components ---------------------------------------------------------------------------


def test_components_equal_union_find(spark, rng):
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)]
    edges += [(1000 + i, 1001 + i) for i in range(60)] + [(5000, i) for i in range(4000, 4200)]
    edges += [(3, 3), (None, 4), (4, None), edges[0], edges[0][::-1]]
    parent = {x: x for edge in edges for x in edge if None not in edge and edge[0] != edge[1]}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if None not in (a, b) and a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    found = components.connected(spark.createDataFrame(edges, "u long, v long")).collect()
    assert sorted(map(tuple, found)) == sorted((x, root(x)) for x in parent)


def test_no_edges(spark):
    assert components.connected(spark.createDataFrame([], "u long, v long")).count() == 0


def test_stars_are_not_dealt_again(spark, monkeypatch):
    """Edges that tie every node to the least of its component need no round, others no round to confirm them."""
    rounds = []
    small_star = components._small_star
    monkeypatch.setattr(components, "_small_star", lambda edges: rounds.append(1) or small_star(edges))
    stars = [(i, 0) for i in range(1, 9)] + [(i, 100) for i in range(101, 105)]
    found = components.connected(spark.createDataFrame(stars, "u long, v long")).collect()
    assert sorted(map(tuple, found)) == sorted([*stars, (0, 0), (100, 100)]) and not rounds
    found = components.connected(spark.createDataFrame([*stars, (100, 1)], "u long, v long")).collect()
    assert {r["component"] for r in found} == {0} and len(found) == 14 and len(rounds) <= 2


def test_texts_are_hashed_once_for_both_comparisons(spark, rng, monkeypatch):
    made = []
    sets = near_texts._sets
    monkeypatch.setattr(near_texts, "_sets", lambda *given: made.append(1) or sets(*given))
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(40):
        text = list(base)
        for _ in range(rng.randint(0, 6)):
            text[rng.randrange(150)] = f"x{rng.randint(0, 999)}"
        rows.append((i, " ".join(text)))
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)
    assert len(made) == 1
