import pytest
from pyspark.sql import functions as F

from evalsweep.operators import grid, prompts, rules


def found(df, *checks):
    return sorted(tuple(r) for r in rules.violations(df, "id", checks).collect())


def test_unknown_columns_at_every_level(spark):
    specs = spark.createDataFrame(
        [], "experiment struct<name:string>, models array<struct<id:string,made_up:int>>, execution string, "
        "generation struct<temperature:double,do_sample:boolean>"
    )
    allowed = {
        "experiment": {"name": None},
        "models": {"id": None, "backend": None},
        "generation": {"temperature": None},
    }
    rows = rules.check_unknown_columns(spark, specs, allowed).collect()
    assert sorted(r.column for r in rows) == ["execution", "generation.do_sample", "models.made_up"]
    assert rules.check_unknown_columns(spark, specs.select("experiment"), allowed).count() == 0


def test_unknown_map_keys(spark):
    df = spark.createDataFrame([(1, {"id": "m"}), (2, {"id": "m", "z": "1", "b": "2"}), (3, None)], "id int, s map<string,string>")
    assert found(df, rules.known_keys("s", ["id"])) == [(2, "unknown:s", "unknown keys: b, z")]


def test_allowed_and_required(spark):
    df = spark.createDataFrame(
        [(1, "api", None), (2, "api", "x"), (3, "nope", None), (4, None, None), (5, "hf", None)],
        "id int, backend string, api_config string",
    )
    got = found(df, rules.allowed_values("backend", rules.BACKENDS), rules.required_if("backend", "api", "api_config"))
    assert got == [
        (1, "required:api_config", "backend='api' requires api_config"),
        (3, "allowed:backend", "backend not allowed: nope"),
        (4, "allowed:backend", "backend not allowed: NULL"),
    ]


def test_ranges(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (2, 1, 1.01), (3, None, -0.01), (4, 5, 0.0)], "id int, n int, p double")
    got = found(df, rules.in_range("n", exclusive_minimum=0), rules.in_range("p", minimum=0.0, maximum=1.0))
    assert [(i, rule) for i, rule, _ in got] == [(1, "range:n"), (2, "range:p"), (3, "range:p")]


def test_defaults_leave_explicit_values(spark):
    rows = [(1, None, None, None), (2, "vllm", 5, float("nan"))]
    df = spark.createDataFrame(rows, "id int, backend string, max_samples int, top_p double")
    found = sorted(map(str, rules.fill_defaults(df).collect()))
    assert found == sorted(map(str, df.sparkSession.createDataFrame([(1, "hf", 100, 1.0), rows[1]], df.schema).collect()))


def test_unknown_fields_are_counted_at_any_depth(spark):
    rows = [(1, {"a": [(1, None)], "x": 5}), (2, {"a": [(2, 7), (3, None)], "x": None}), (3, None)]
    df = spark.createDataFrame(rows, "id int, s struct<a:array<struct<b:int,c:int>>,x:int>")
    found = rules.count_unknown_fields(df, {"id": None, "s": {"a": {"b": None}}}).collect()
    assert sorted(map(tuple, found)) == [("s.a.c", "unknown:s.a.c", 1), ("s.x", "unknown:s.x", 1)]
    assert rules.count_unknown_fields(df, {"id": None, "s": None}).count() == 0


def test_rules_need_no_shuffle(spark, capsys):
    df = spark.range(3).withColumn("n", F.lit(1))
    rules.violations(df, "id", [rules.in_range("n", minimum=2)]).explain()
    assert "Exchange" not in capsys.readouterr().out


def test_one_pass_admits_rejects_and_counts(spark, tmp_path):
    rows = [(1, "hf", 5, None), (2, "bad", 0, None), (3, None, 7, None), (4, "api", 3, None), (5, "api", 3, "url")]
    specs = spark.createDataFrame(rows, "spec_id int, backend string, max_samples int, api_config string")
    every = [
        rules.allowed_values("backend", rules.BACKENDS),
        rules.in_range("max_samples", exclusive_minimum=0),
        rules.required_if("backend", "api", "api_config"),
    ]
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    found = rules.admit(specs.mapInArrow(counted, specs.schema), every, str(tmp_path / "one"))
    assert reads.value == len(rows)  # every row was read once
    assert found.counts == {
        "rows": 5, "good": 2, "rejected": 3, "allowed:backend": 2, "range:max_samples": 1, "required:api_config": 1
    }
    assert sorted(r.spec_id for r in found.good.collect()) == [1, 5] and found.good.columns == specs.columns
    why = {r.spec_id: [b["rule"] for b in r.broken] for r in found.rejected.collect()}
    assert why == {2: ["allowed:backend", "range:max_samples"], 3: ["allowed:backend"], 4: ["required:api_config"]}
    assert reads.value == len(rows)
    empty = rules.admit(specs.filter("false"), every, str(tmp_path / "two"))
    assert empty.good.count() == empty.rejected.count() == empty.counts["rows"] == 0


def test_a_bad_spec_never_becomes_cells(spark, tmp_path):
    specs = spark.createDataFrame(
        [("good", [("m", "hf")], 5), ("bad", [("m", "hf")], 0)],
        "experiment string, models array<struct<id:string,backend:string>>, max_samples int",
    )
    every = [rules.in_range("max_samples", exclusive_minimum=0)]
    admitted = rules.admit(specs, every, str(tmp_path / "specs"))
    assert {r.experiment for r in grid.grid_cells(admitted.good).collect()} == {"good"}
    with pytest.raises(Exception, match="range:max_samples: max_samples out of range"):
        grid.grid_cells(rules.refuse(specs, every)).collect()
    assert grid.grid_cells(rules.refuse(specs.filter("max_samples > 0"), every)).count() == 3


def test_keyless_records_are_put_aside_in_one_pass(spark, tmp_path):
    rows = [(1, {"question": "q"}), (2, {"other": "x"}), (3, None), (4, {"prompt": "p"})]
    records = spark.createDataFrame(rows, "id int, record map<string,string>")
    found = rules.admit(records, [prompts.question_given("record")], str(tmp_path / "records"))
    assert sorted(r.id for r in found.good.collect()) == [1, 4]
    assert sorted(r.id for r in found.rejected.collect()) == [2, 3] and found.counts["rejected"] == 2
