import pytest
from pyspark.sql import functions as F

from evalsweep.operators import prompts
from evalsweep.plans.queries import QUERIES


def only(df, column):
    return [r[0] for r in df.select(column).collect()]


def test_question_alias_order_and_text(spark):
    df = spark.createDataFrame([("t", None, 1.5)], "text string, question string, input double")
    assert only(prompts.resolve_question(df), "question") == ["None"]
    assert only(prompts.resolve_question(df.drop("question")), "question") == ["t"]
    assert only(prompts.resolve_question(df.select("input")), "question") == ["1.5"]


def test_list_question_is_joined_and_list_answer_is_printed(spark):
    df = spark.createDataFrame([(["a", None], ["x", "y"])], "question array<string>, answer array<string>")
    assert only(prompts.resolve_question(df, name="q"), "q") == ["a; None"]
    assert only(prompts.resolve_answer(df), "reference") == ["['x', 'y']"]


def test_table_without_question_fails(spark):
    with pytest.raises(KeyError):
        prompts.resolve_question(spark.range(1))


def test_answer_is_stripped_and_may_be_absent(spark):
    df = spark.createDataFrame([(" x\n", True)], "answer string, label boolean")
    assert only(prompts.resolve_answer(df), "reference") == ["x"]
    assert only(prompts.resolve_answer(df.select("label")), "reference") == ["True"]
    assert only(prompts.resolve_answer(spark.range(1)), "reference") == [""]


RECORDS = [
    (1, {"text": "t", "question": None, "label": " l "}),
    (2, {"prompt": "p", "input": "i", "target": "x", "output": "o"}),
    (3, {"other": "z", "answer": "a"}),
    (4, {}),
]


def test_map_records(spark):
    df = spark.createDataFrame(RECORDS, "id int, record map<string,string>")
    asked = prompts.resolve_answer(prompts.resolve_question(df, record="record"), record="record")
    rows = {r.id: (r.question, r.reference) for r in asked.collect()}
    assert rows == {1: ("None", "l"), 2: ("i", "o"), 3: (None, "a"), 4: (None, "")}
    assert sorted(only(prompts.drop_keyless(df, "record"), "id")) == [1, 2]
    assert tuple(prompts.count_keyless(df, "record").first()) == (2, 2)


def options(spark, ddl, value):
    df = spark.createDataFrame([(value,)], f"c {ddl}")
    return df.select(prompts.format_options(F.col("c"), df.schema["c"].dataType)).first()[0]


@pytest.mark.parametrize(
    "ddl, value, lines",
    [
        ("array<string>", ["x", "y"], "  A. x\n  B. y"),
        ("array<int>", [4, None], "  A. 4\n  B. None"),
        ("map<string,string>", {"B": "y", "A": "x"}, "  A. x\n  B. y"),
        ("map<string,string>", {"B": "y", "A": None}, ""),
        ("struct<text:array<string>,label:array<string>>", (["x", "y", "z"], ["P", "Q"]), "  P. x\n  Q. y"),
        ("struct<text:array<string>>", (["x", "y"],), "  A. x\n  B. y"),
        ("struct<B:string,A:string>", ("y", "x"), "  A. x\n  B. y"),
        ("struct<B:string,A:string>", ("y", None), ""),
        ("array<string>", [], ""),
        ("map<string,int>", {"A": 1}, ""),
        ("map<string,array<string>>", {"text": ["x", "y"], "label": ["P"]}, "  P. x"),
        ("map<string,array<string>>", {"text": ["x", "y"]}, "  A. x\n  B. y"),
        ("map<string,array<string>>", {"other": ["x"]}, ""),
        ("struct<text:string,n:int>", ("x", 1), ""),
    ],
)
def test_options(spark, ddl, value, lines):
    assert options(spark, ddl, value) == lines


def test_prompts_of_mixed_choice_columns(spark):
    df = spark.createDataFrame(
        [
            (1, " q[[placeholder]] ", {"A": "x"}, ["n"], "A"),
            (2, "q", {}, ["n", "m"], "B"),
            (3, "q", None, [], "C"),
            (4, "q", None, None, "D"),
        ],
        "id long, question string, alternatives map<string,string>, choices array<string>, answer string",
    )
    built = prompts.build_samples(df, "id", choice_system="MC", essay_system="ES").collect()
    assert {r.sample_idx: r.prompt for r in built} == {
        1: "MC\n\nQuestion: q\n\nOptions:\n  A. x\n\nAnswer:",
        2: "MC\n\nQuestion: q\n\nOptions:\n  A. n\n  B. m\n\nAnswer:",
        3: "ES\n\nQuestion: q\n\nAnswer:",
        4: "ES\n\nQuestion: q\n\nAnswer:",
    }
    assert {r.sample_idx: r.reference for r in built} == {1: "A", 2: "B", 3: "C", 4: "D"}


def test_chat_messages(spark):
    got = spark.range(1).select(prompts.chat_messages(F.lit("hi"))).first()[0]
    assert [m.asDict() for m in got] == [{"role": "user", "content": "hi"}]


def test_letters_go_on_past_those_that_are_looked_up(spark):
    n = prompts.KNOWN_LABELS + 3
    lines = options(spark, "array<string>", [str(i) for i in range(n)]).split("\n")
    # Some of the code points end a line for splitlines, none for split.
    assert lines == [f"  {chr(65 + i)}. {i}" for i in range(n)]


def test_options_of_one_file_are_made_by_all_cores(spark, sf_dir):
    """A narrow table is one split, whose rows one task would make long texts of."""
    cores = spark.sparkContext.defaultParallelism
    for name in ("format_options", "first_choices"):
        made = QUERIES[name](spark, sf_dir).select("sample_idx", F.spark_partition_id().alias("at"))
        assert made.select("at").distinct().count() >= cores
        assert made.count() == spark.read.parquet(f"{sf_dir}/part.parquet").count()
