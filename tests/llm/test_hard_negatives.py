import numpy as np
import pytest
from pyspark.sql import functions as F

from evalsweep.llm import hard_negatives as mining

NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(8)
    centers = rng.normal(size=(5, 16))
    rows = []
    for i in range(400):
        x = centers[i % 5] + rng.normal(size=16) * (0.05 if i % 4 else 0.5)
        rows.append((i, [float(v) for v in x.astype(np.float32)], i % 5 if i % 3 else i % 4, "clash"))
    rows += [
        (500, None, 1, None), (550, [], 1, None), (600, [0.0] * 16, 1, None), (650, [NAN] + [1.0] * 15, 1, None),
        (700, [None] + [1.0] * 15, 1, None), (750, [INF] * 16, 1, None), (800, rows[1][1], None, None),
        (850, rows[1][1], 1, None), (851, rows[1][1], 1, None), (852, rows[1][1], 2, None), (850, rows[1][1], 1, None),
        (900, [1.0, 2.0], 1, None), (901, [2.0, 4.0], 1, None), (902, [1.5, 3.0], 2, None), (None, rows[1][1], 1, None),
        (950, [-3.5] * 16, 77, None), (1000, rows[2][1], 3, None), (1000, rows[3][1], 3, None),
    ]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, no string"), rows


def mined(rows):
    """Every anchor against every row, in whole numbers."""
    kept = {}
    for i, vector, label, *_ in rows:
        if i is not None and label is not None and vector and all(v is not None and np.isfinite(v) for v in vector):
            whole = tuple(int(np.floor(256 * np.float64(v))) for v in vector)
            kept[i, label, whole] = None
    out = []
    for i, label, q in kept:
        if i % 50:
            continue
        scores = [
            (-sum(a * b for a, b in zip(q, c)), j, other) for j, other, c in kept if len(c) == len(q)
        ]
        positives = sorted((s, j) for s, j, other in scores if other == label and j != i)[:5]
        for s, j in positives:
            fits = sorted((t, k) for t, k, other in scores if other != label and -50 * s <= -100 * t <= -95 * s)
            out += [(i, j, rank + 1, k, -s, -t) for rank, (t, k) in enumerate(fits[:3])]
    return sorted(out)


def run(df, **options):
    return mining.hard_negatives(df, "vec_id", F.col("label"), "embedding", lambda i: i % 50 == 0, **options)


@pytest.mark.parametrize("options", [{}, {"block_bytes": 1024, "chunk_rows": 3, "group_rows": 5}])
def test_equals_brute_force(vectors, options):
    df, rows = vectors
    assert sorted(map(tuple, run(df, **options).collect())) == mined(rows)


def test_of_none_and_huge(spark):
    schema = "vec_id long, embedding array<double>, label long"
    assert run(spark.createDataFrame([], schema)).count() == 0
    assert run(spark.createDataFrame([(1, [1.0], 1)], schema)).count() == 0
    assert run(spark.createDataFrame([(50, [1.0], 1), (51, [1.0], 2)], schema)).count() == 0
    rows = [(50, [1e6, 3.0], 1), (51, [1e6, 1.0], 1), (52, [7e5, 1.0], 2), (53, [7e5, 2.0], 2), (54, [-7e5, 2.0], 2)]
    assert sorted(map(tuple, run(spark.createDataFrame(rows, schema)).collect())) == mined(rows)


def test_curve_visits_every_cell_once_and_moves_to_neighbours():
    for axes, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes), -1).reshape(-1, axes)
        at = mining.hilbert(cells, bits)
        assert sorted(at.tolist()) == list(range(len(cells)))
        steps = np.abs(np.diff(cells[np.argsort(at)], axis=0)).sum(1)
        assert (steps == 1).all()


def test_bounds_hold_for_every_vector_of_a_zone(rng):
    gen = np.random.default_rng(1)
    x, v = gen.normal(size=(20, 8)) * 300, gen.normal(size=(50, 8)) * 300
    least, most = mining.bounds(x, v.min(0)[None], v.max(0)[None])
    scores = x @ v.T
    assert (least <= scores.min(1, keepdims=True)).all() and (scores.max(1, keepdims=True) <= most).all()


def test_far_blocks_are_not_read(spark):
    """Anchors of clusters that lie apart read a small part of all blocks."""
    gen = np.random.default_rng(3)
    centers = gen.normal(size=(40, 12)) * 4
    rows = [
        (i, [float(v) for v in centers[i % 40] + gen.normal(size=12) * 0.05], (i % 40) // 2) for i in range(4000)
    ]
    df = spark.createDataFrame(rows, "id long, vector array<double>, label long")
    whole = mining.staged(mining.whole_vectors(df, 256), "test-rows")
    axes = mining.axes_of(whole)
    blocks = mining.blocks_of(whole, axes, 50 * 12 * 8)
    n_blocks = blocks.count()
    low = F.array(F.lit(-mining.LONG - 1))
    anchors = blocks.select("block", "dim").limit(0)
    anchors = whole.filter("id % 50 = 0").select(
        F.lit(-1).cast("long").alias("block"), "dim", "id", "label", "v", F.xxhash64("id").alias("no"),
        F.lit(0).alias("chunk"), low.alias("low"), F.array(F.lit(mining.LONG)).alias("high"),
    )
    best = {r["id"]: r["least"] for r in anchors.join(whole.select(F.col("label"), F.col("v").alias("other")), "label")
            .groupBy("id").agg(F.count("*").alias("least")).collect()}
    assert len(best) == 80
    # A floor near the anchor's own length, as its cluster gives it.
    own = {r["id"]: int(0.9 * (np.frombuffer(r["v"]) ** 2).sum()) for r in anchors.select("id", "v").collect()}
    floor = F.create_map(*[F.lit(x) for pair in own.items() for x in pair])[F.col("id")]
    asked = mining.choose(anchors.withColumn("floor", F.array(floor.cast("long"))), blocks, axes, True, "all", 1, 1)
    pairs = sum(len(r["nos"]) // 8 for r in asked.collect())
    assert n_blocks >= 80 and pairs < 0.25 * 80 * n_blocks


@pytest.mark.parametrize("task_bytes", [1 << 12, 1 << 16])
def test_small_tasks_change_nothing(vectors, monkeypatch, task_bytes):
    """Many sets and units, few pairs at a time."""
    df, rows = vectors
    monkeypatch.setattr(mining, "PAIRS", 64)
    found = run(df, block_bytes=1024, chunk_rows=3, group_rows=5, task_bytes=task_bytes)
    assert sorted(map(tuple, found.collect())) == mined(rows)


def test_requests_hold_no_vectors(spark, monkeypatch):
    """Where every anchor needs every block, a task gives 8 bytes a pair, a few pairs at a time."""
    gen = np.random.default_rng(4)
    rows = [(i, [float(v) for v in gen.normal(size=32)], i % 2) for i in range(1000)]
    whole = mining.whole_vectors(spark.createDataFrame(rows, "id long, vector array<double>, label long"), 256)
    whole = mining.staged(whole, "test-rows")
    axes = mining.axes_of(whole)
    blocks = mining.blocks_of(whole, axes, 25 * 32 * 8)
    n_blocks = blocks.count()
    any_score = [F.array(F.lit(x)) for x in (-mining.LONG - 1, mining.LONG, -mining.LONG - 1)]
    anchors = whole.filter("id % 5 = 0").select(
        F.lit(-1).cast("long").alias("block"), "dim", "id", "label", "v", F.xxhash64("id").alias("no"),
        F.lit(0).alias("chunk"), *(x.alias(c) for x, c in zip(any_score, ("low", "high", "floor"))),
    )
    monkeypatch.setattr(mining, "PAIRS", 10 * n_blocks, raising=False)
    asked = mining.choose(anchors, blocks, axes, False, "all", 1, 1)
    sizes = [sum(len(x) for x in r if isinstance(x, (bytes, bytearray))) for r in asked.collect()]
    assert n_blocks >= 40 and sum(sizes) == 8 * 200 * n_blocks and max(sizes) == 80


def test_products_are_exact(rng):
    for most in (100, 2**20, 2**40):
        a, b = (np.array([[float(rng.randint(-most, most)) for _ in range(8)] for _ in range(5)]) for _ in range(2))
        whole = [[sum(int(p) * int(q) for p, q in zip(x, y)) for y in b.tolist()] for x in a.tolist()]
        held = [[min(max(s, -mining.LONG - 1), mining.LONG) for s in row] for row in whole]
        assert [[int(s) for s in row] for row in mining.products(a, b).tolist()] == held
    assert mining.products(np.array([[1e300, 1.0]]), np.zeros((1, 2))).tolist() == [[0]]
