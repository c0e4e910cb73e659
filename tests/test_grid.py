from itertools import product

from pyspark.sql import functions as F

from evalsweep.operators import grid

CACHES = "array<struct<name:string,kv_cache:boolean,prefix_cache:boolean>>"


def test_full_product(spark):
    spec = spark.createDataFrame(
        [("e", [None, "int4"], [("a", False, False), ("b", True, False)], [128, 256])],
        f"experiment string, quantization array<string>, cache_config {CACHES}, max_new_tokens array<int>",
    )
    rows = [tuple(r)[1:] for r in grid.permutations(spec).orderBy("perm_idx").collect()]
    want = product([None, "int4"], [(False, False), (True, False)], [128, 256])
    assert rows == [(i, q, kv, px, n) for i, (q, (kv, px), n) in enumerate(want)]
    assert (0, None, False, False, 128) in rows


def test_axis_rules(spark):
    spec = spark.createDataFrame(
        [
            (1, None, None, None, None, None),
            (2, [], None, None, None, 7),
            (3, ["x"], [], [True, False], [False, True], 7),
            (4, ["x"], [], [True, False], [], 7),
            (5, ["x"], [("n", True, True)], [True, False], [False, True], 7),
        ],
        f"spec int, quantization array<string>, cache_config {CACHES}, kv_cache array<boolean>, "
        "prefix_cache array<boolean>, max_new_tokens int",
    )
    found = {}
    for row in grid.permutations(spec, ["spec"]).orderBy("spec", "perm_idx").collect():
        found.setdefault(row.spec, []).append(tuple(row)[2:])
    off = (False, False)
    assert found == {
        1: [(q, *off, 256) for q in (None, "int8", "int4")],
        3: [("x", kv, px, 7) for kv in (True, False) for px in (False, True)],
        4: [("x", *off, 7)],
        5: [("x", True, True, 7)],
    }
    no_axes = grid.permutations(spark.createDataFrame([(1,)], "spec int"), ["spec"])
    assert no_axes.count() == 3


def test_cells_are_model_major_and_counted_from_one(spark):
    spec = spark.createDataFrame(
        [("e", [("m1", None), ("m2", "api")], ["q1", "q2"], 5)],
        "experiment string, models array<struct<id:string,backend:string>>, quantization array<string>, max_new_tokens int",
    )
    rows = grid.grid_cells(spec).orderBy("cell_idx").collect()
    assert [(r.cell_idx, r.model_id, r.backend, r.quantization) for r in rows] == [
        (1, "m1", "hf", "q1"),
        (2, "m1", "hf", "q2"),
        (3, "m2", "api", "q1"),
        (4, "m2", "api", "q2"),
    ]
    assert grid.grid_size(spec).first().n_cells == 4


def test_every_cell_sees_every_sample(spark):
    samples = spark.range(50).select(F.col("id").alias("sample_idx"), F.lit("d").alias("dataset"))
    cells = spark.range(3).select((F.col("id") + 1).cast("int").alias("cell_idx"), F.lit("d").alias("dataset"))
    want = {(s, c) for s in range(50) for c in (1, 2, 3)}

    def pairs(df):
        rows = [(r.sample_idx, r.cell_idx) for r in df.collect()]
        assert len(rows) == len(set(rows))
        return set(rows)

    plain_cells = cells.drop("dataset")
    assert pairs(grid.cell_samples(samples, plain_cells)) == want
    assert pairs(grid.cell_samples(samples, plain_cells, broadcast_rows=1)) == want
    assert pairs(grid.cell_samples(samples, cells, on=["dataset"])) == want
    assert pairs(grid.cell_samples(samples, cells, on=["dataset"], broadcast_rows=1)) == want
    elsewhere = cells.withColumn("dataset", F.lit("other"))
    assert pairs(grid.cell_samples(samples, elsewhere, on=["dataset"])) == set()


def test_a_hundred_million_cells_are_computed_from_their_numbers(spark):
    spec = spark.sql(
        "select 'big' as experiment, transform(sequence(1, 500), m -> named_struct('id', concat('m', m), 'backend', 'hf')) as models, "
        "transform(sequence(1, 200), q -> concat('q', q)) as quantization, sequence(1, 1000) as max_new_tokens"
    )
    cells = grid.grid_cells(spec)
    assert cells.rdd.getNumPartitions() > 50
    last = cells.agg(
        F.count("*").alias("n"), F.max("cell_idx").alias("last"), F.sum("max_new_tokens").alias("tokens"),
        F.approx_count_distinct("model_id").alias("models"),
    ).first()
    assert (last["n"], last["last"], last["tokens"]) == (10**8, 10**8, 10**8 // 1000 * 500_500)


def test_cells_of_a_wave_from_their_numbers(spark):
    spec = spark.createDataFrame(
        [
            ("e", [("m1", None, 3), ("m2", "api", 4)], ["q1", None, "q3"], [5, 6], 0.5),
            ("f", [("m3", None, 1)], [], [5], 0.0),
            ("g", None, ["q"], [1], 0.0),
        ],
        "experiment string, models array<struct<id:string,backend:string,extra:int>>, quantization array<string>, "
        "max_new_tokens array<int>, temperature double",
    )
    whole = {(r.experiment, r.cell_idx): tuple(r) for r in grid.grid_cells(spec).collect()}
    assert len(whole) == 12 and {e for e, _ in whole} == {"e"}
    wanted = [("e", 1), ("e", 7), ("e", 12), ("e", 13), ("e", 0), ("f", 1), ("g", 1), ("x", 1)]
    found = grid.cells_at(spec, spark.createDataFrame(wanted, "experiment string, cell_idx int")).collect()
    assert {(r.experiment, r.cell_idx): tuple(r) for r in found} == {k: whole[k] for k in wanted[:3]}


def test_chunks_join_without_a_gap(spark, monkeypatch):
    monkeypatch.setattr(grid, "CHUNK", 7)
    monkeypatch.setattr(grid, "TASK_CELLS", 10)
    spec = spark.sql("select 'e' as experiment, sequence(1, 50) as max_new_tokens, array('a', 'b') as quantization")
    rows = grid.permutations(spec).orderBy("perm_idx").collect()
    assert [(r.perm_idx, r.quantization, r.max_new_tokens) for r in rows] == [
        (50 * i + n - 1, q, n) for i, q in enumerate("ab") for n in range(1, 51)
    ]
