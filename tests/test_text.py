from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalsweep.functions import measures, text

ALPHABET = "aAbeEfFgthTHEn xyz019_.,;!?'\"()[]<>-\\\t\n\r\x0b\x1f\xa0 　éçãñßÉ"
TEXTS = st.lists(st.text(ALPHABET, max_size=30), min_size=1, max_size=300)


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, t {kind}")


def apply(spark, values, *functions):
    df = column(spark, values)
    rows = df.select("i", *[f(F.col("t")).alias(f"f{n}") for n, f in enumerate(functions)])
    return [tuple(r)[1:] for r in sorted(rows.collect())]


def test_normalize_cases(spark):
    cases = {
        "The Answer Is: A.": "answer is",
        "": "",
        "  \t\n": "",
        "a an the A.N. theory": "theory",
        "Éa,  b c": "éa b c",
        "don't": "dont",
        "a": "",
    }
    found = apply(spark, list(cases), text.normalize_text)
    assert [f[0] for f in found] == list(cases.values())


def test_extract_choice_cases(spark):
    cases = {
        "A. mudança de comportamento.": "A",
        "  c  ": "C",
        "42": "4",
        "": "",
        "   ": "   ",
        "The answer is (d)": "D",
        "_a b_": "_",
        "éa": "É",
        "Paris": "P",
        "g) f": "F",
    }
    found = apply(spark, list(cases), text.extract_choice)
    assert [f[0] for f in found] == list(cases.values())


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(TEXTS)
def test_text_rules_keep_their_properties(spark, values):
    def twice(column):
        return text.normalize_text(text.normalize_text(column))

    def of_stripped(rule):
        return lambda column: rule(text.strip(column))

    rules = (text.strip, text.words, text.normalize_text, twice, of_stripped(text.normalize_text))
    choices = (text.extract_choice, of_stripped(text.extract_choice))
    for value, row in zip(values, apply(spark, values, *rules, *choices)):
        stripped, words, norm, again, norm_stripped, choice, choice_stripped = row
        assert stripped == value.strip() and words == value.split()
        # A comparison form stays as it is, and stripping first changes nothing.
        assert norm == norm_stripped == " ".join(norm.split())
        assert again == norm
        assert not set(norm) & set(text.PUNCTUATION) and norm == norm.lower()
        assert not set(norm.split()) & {"a", "an", "the"}
        if stripped:
            # One character, bar ß, whose upper case has two.
            assert choice == choice_stripped and len(choice) <= 2 and choice in value.upper()
        else:
            assert choice == value


def test_strip_handles_every_whitespace_character(spark):
    padded = [f"{c}x y{c}{c}" for c in text.WHITESPACE]
    assert {f[0] for f in apply(spark, padded, text.strip)} == {"x y"}
    assert all(c.isspace() for c in text.WHITESPACE) and len(text.WHITESPACE) == 29


def test_answer_tag(spark):
    cases = {
        "<answer> x\ny </answer> z": "x\ny",
        "pre <response>b</answer>": "b",
        "<answer>a</answer><answer>b</answer>": "a",
        "<answer>open": "<answer>open",
        "none": "none",
        "<answer></answer>": "",
    }
    found = apply(spark, list(cases), text.answer_tag)
    assert [f[0] for f in found] == list(cases.values())


def test_clean_question_and_response(spark):
    found = apply(spark, [" [[placeholder]]a [[placeholder]] b\n", None], text.clean_question)
    assert found == [("a  b",), (None,)]
    assert apply(spark, [None, " x "], text.clean_response) == [("",), ("x",)]


def test_token_count(spark):
    df = spark.createDataFrame(
        [("a b c", None), ("a b", 0), ("a b", 7), ("", None)], "t string, n int"
    )
    found = df.select(text.token_count(F.col("t"), F.col("n"))).collect()
    assert [r[0] for r in found] == [3, 2, 7, 1]


def test_plain_text_matches_python(spark):
    numbers = [0.0, 1.0, -2.5, 1e7, 123456789.25, 1e15, 1e16, 1.5e20, 1e-3, 1e-4, 2.5e-5, 1e-300, float("inf")]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(numbers)], "i int, t double")
    shown = df.orderBy("i").select(text.plain_text(F.col("t"), T.DoubleType())).collect()
    assert [r[0] for r in shown] == [str(v) for v in numbers]
    flags = spark.createDataFrame([(True,), (False,), (None,)], "t boolean")
    assert [r[0] for r in flags.select(text.plain_text(F.col("t"), T.BooleanType())).collect()] == [
        "True",
        "False",
        "None",
    ]
    lists = [["a", None], ["it's"], ['say "hi"', "it's \"x\""], ["a\\b\n"], []]
    df = column(spark, lists, "array<string>")
    kind = T.ArrayType(T.StringType())
    shown = df.orderBy("i").select(text.plain_text(F.col("t"), kind)).collect()
    assert [r[0] for r in shown] == [str(v) for v in lists]


def test_failure_status(spark):
    rows = [
        ("RuntimeError", "CUDA Out Of Memory", "oom"),
        ("RuntimeError", "driver mismatch", "error"),
        ("RuntimeError", None, "error"),
        ("OutOfMemoryError", "whatever", "oom"),
        ("ValueError", "out of memory", "error"),
        (None, None, None),
    ]
    df = spark.createDataFrame(rows, "kind string, msg string, want string")
    for row in df.select("*", measures.failure_status(F.col("kind"), F.col("msg")).alias("got")).collect():
        assert row.got == row.want


def test_attempts(spark):
    rows = [
        (None, None, "error", "Worker process timeout: did not complete within 3600s"),
        (None, "p", "error", "Worker process timeout: did not complete within 3600s"),
        (1, "p", "ok", None),
        (-9, None, "error", "Worker exited with code -9"),
        (0, "p", "ok", None),
        (0, None, "error", "Worker produced no output: "),
    ]
    df = spark.createDataFrame(rows, "code int, payload string, status string, error string")
    got = df.select(
        "*",
        measures.attempt_status(F.col("code"), F.col("payload")).alias("s"),
        measures.attempt_error(F.col("code"), F.col("payload")).alias("e"),
    )
    for row in got.collect():
        assert (row.s, row.e) == (row.status, row.error)


def test_throughput_budget_and_units(spark):
    row = spark.range(1).select(
        measures.throughput(F.lit(10), F.lit(0.0)).alias("none"),
        measures.throughput(F.lit(10), F.lit(4.0)).alias("some"),
        measures.token_budget(F.lit(True), F.lit(500)).alias("choice"),
        measures.token_budget(F.lit(False), F.lit(500)).alias("essay"),
        measures.token_budget(F.lit(False), F.lit(None).cast("int")).alias("unset"),
        measures.mebibytes(F.lit(None).cast("bigint")).alias("unread"),
        measures.watts(F.lit(2500)).alias("watts"),
    ).first()
    assert tuple(row) == (0.0, 2.5, 10, 500, 256, 0.0, 2.5)
