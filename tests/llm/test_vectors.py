import numpy as np
import pytest

from evalsweep.llm import inner_products, near_vectors

NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(6, 16))
    rows = []
    for i in range(260):
        x = centers[i % 6] + rng.normal(size=16) * (0.01 if i % 2 else 0.3)
        rows.append((i, [float(v) for v in x.astype(np.float32)], i % 3, "clash"))
    rows += [
        (300, None, 1, None), (301, [], 1, None), (302, [0.0] * 16, 1, None), (303, [NAN] + [1.0] * 15, 1, None),
        (304, [None] + [1.0] * 15, 1, None), (305, [INF] * 16, 1, None), (306, rows[1][1], None, None),
        (307, rows[1][1], 1, None), (350, rows[1][1], 1, None), (350, rows[1][1], 1, None), (400, [1.0, 2.0], 1, None),
        (401, [2.0, 4.0], 1, None), (None, rows[1][1], 1, None), (450, [-3.5] * 16, 0, None),
    ]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, bucket string"), rows


def usable(vector):
    return bool(vector) and all(v is not None and np.isfinite(v) for v in vector)


# Search -------------------------------------------------------------------------------


def searched(rows, k):
    """Every distinct (id, vector) against all others, in whole numbers."""
    kept = {}
    for i, vector, *_ in rows:
        if i is not None and usable(vector):
            whole = tuple(int(np.floor(256 * np.float64(v))) for v in vector)
            kept[i, whole] = whole
    out = []
    for (i, _), q in kept.items():
        if i % 50 == 0:
            scores = [
                (-sum(a * b for a, b in zip(q, c)), j) for (j, _), c in kept.items() if j != i and len(c) == len(q)
            ]
            out += [(i, rank + 1, j, -s) for rank, (s, j) in enumerate(sorted(scores)[:k])]
    return sorted(out)


@pytest.mark.parametrize("block", [65536, 40])
def test_top_k_equals_brute_force(vectors, block):
    df, rows = vectors
    found = inner_products.top_k(df, "vec_id", "embedding", lambda i: i % 50 == 0, 5, block=block, query_block=3)
    assert sorted(map(tuple, found.collect())) == searched(rows, 5)


@pytest.mark.parametrize("signs, share", [(False, 4), (True, 1)])  # a floor below zero has to meet every block
def test_only_blocks_that_can_hold_winners_meet(spark, monkeypatch, signs, share):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(400):  # lengths fall quickly
        x = rng.normal(size=8)
        x *= 50 * 0.985**i / np.linalg.norm(x)
        rows.append((i, [float(v) for v in (x if signs and i % 3 == 0 else np.abs(x))]))
    counted, block_pairs = [], inner_products.block_pairs

    def counting(queries, candidates):
        pairs = block_pairs(queries, candidates)
        blocks = candidates.select("c_block").distinct().count() * queries.select("q_block").distinct().count()
        counted.append((pairs.count(), blocks))
        return pairs

    monkeypatch.setattr(inner_products, "block_pairs", counting)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = inner_products.top_k(df, "vec_id", "embedding", lambda i: i % 50 == 0, block=20, query_block=2)
    assert sorted(map(tuple, found.collect())) == searched(rows, 5)
    (_, all_first), (met, every) = counted
    assert all_first and met < every / share, counted


def test_blocks_are_bounded_in_bytes(vectors):
    df, rows = vectors
    found = inner_products.top_k(df, "vec_id", "embedding", lambda i: i % 50 == 0, block_bytes=1024)
    assert sorted(map(tuple, found.collect())) == searched(rows, 5)


def test_top_k_of_few_none_and_huge(spark):
    def run(rows):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        found = inner_products.top_k(df, "vec_id", "embedding", lambda i: i % 50 == 0)
        return sorted(map(tuple, found.select("query_id", "rank", "vec_id", "score").collect()))

    assert run([]) == []
    assert run([(1, [1.0]), (2, [2.0])]) == []
    assert run([(50, [1.0])]) == []
    assert run([(0, [1.0]), (3, [1.0]), (2, [1.0])]) == [(0, 1, 2, 65536), (0, 2, 3, 65536)]
    # Beyond what doubles hold exactly, and beyond 64 bits.
    big = [(0, [2.0**20 + 1 / 256, 1.0]), (1, [2.0**20, 1.0]), (2, [2.0**20 + 1 / 256, 0.0]), (3, [1e300, 0.0])]
    got = run(big)
    exact = {j: sum(int(a * 256) * int(b * 256) for a, b in zip(big[0][1], v)) for j, v in big}
    assert [row[2] for row in got] == [3, 2, 1] and got[0][3] == 2**63 - 1
    assert got[1][3] == exact[2] and got[2][3] == exact[1]


def test_pruning_drops_no_winner():
    rng = np.random.default_rng(1)
    scale = rng.lognormal(0, 1.5, size=(3000, 1))
    c = np.floor(rng.normal(size=(3000, 32)) * np.linspace(4, 0.1, 32) * scale * 256)
    q, ids = c[:40], np.arange(3000)
    rotation = np.linalg.eigh(c.T @ c)[1][:, ::-1]
    floor = np.full(40, -np.inf)
    places, found, scores = inner_products.search_block(ids[:40], q, floor, ids, c, rotation, 5, step=200)
    for i in range(40):
        exact = [(-int(a @ q[i]), j) for j, a in enumerate(c.astype(np.int64)) if j != i]
        best = sorted((-int(s), int(j)) for s, j in zip(scores[places == i], found[places == i]))
        assert best == sorted(exact)[:5]


# Near duplicates ----------------------------------------------------------------------


def linked(rows, threshold=0.98):
    n = len(rows)
    units = [None] * n
    for i, (vec_id, vector, label, *_) in enumerate(rows):
        if vec_id is not None and label is not None and usable(vector) and any(vector):
            x = np.array(vector, np.float64)
            units[i] = x / np.linalg.norm(x)
    links, parent = [0] * n, {row[0]: row[0] for row in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if units[i] is None or units[j] is None or rows[i][2] != rows[j][2] or len(units[i]) != len(units[j]):
                continue
            if units[i] @ units[j] >= threshold:
                links[i], links[j] = links[i] + 1, links[j] + 1
                a, b = root(rows[i][0]), root(rows[j][0])
                parent[max(a, b)] = min(a, b)
    return sorted(
        ((row[0] is None, row[0] or 0, links[i], None if row[0] is None else root(row[0])) for i, row in enumerate(rows)),
        key=str,
    )


@pytest.mark.parametrize("block", [1024, 8])
def test_near_vectors_equal_brute_force(vectors, monkeypatch, block):
    monkeypatch.setattr(near_vectors, "BLOCK", block)
    df, rows = vectors
    out = near_vectors.near_duplicates(df, "vec_id", "embedding", "label").collect()
    got = sorted(((r[0] is None, r[0] or 0, r[1], r[2]) for r in out), key=str)
    assert got == linked(rows)
    assert all(r["kept"] == (r["vec_id"] is None or r["vec_id"] == r["component_id"]) for r in out)


def test_recall_on_the_given_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [tuple(r) for r in df.select("vec_id", "embedding", "label").collect()]
    out = near_vectors.near_duplicates(df, "vec_id", "embedding", "label").collect()
    expected = linked(rows)
    found, all_links = sum(r["n_links"] for r in out), sum(row[2] for row in expected)
    assert 0.9 * all_links <= found <= all_links


def test_no_vectors(vectors):
    df, _ = vectors
    assert near_vectors.near_duplicates(df.filter("false"), "vec_id", "embedding", "label").count() == 0
