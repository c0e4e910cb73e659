import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from evalsweep.functions import judging
from evalsweep.operators import judge, rollup, score
from evalsweep.plans import sql_views

CHOICE_PROMPT = "Question: ...\n\nOptions:\n  A. foo\n  B. bar\n\nAnswer:"


def scored(spark, triples, **options):
    rows = [(i, *triple) for i, triple in enumerate(triples)]
    df = spark.createDataFrame(rows, "sample_idx long, prompt string, reference string, prediction string")
    return sorted(score.score_rows(score.reference_forms(df), **options).collect())


@pytest.mark.parametrize(
    "prompt, reference, prediction, exact",
    [
        ("Q: capital of France?", "Paris", "Paris", True),
        (CHOICE_PROMPT, "A", "A. foo, the correct choice", True),
        (CHOICE_PROMPT, "A", "B. bar", False),
        (CHOICE_PROMPT, "A. foo", "A. foo", False),
        ("q", "", "  ", True),
    ],
)
def test_exact_match(spark, prompt, reference, prediction, exact):
    assert scored(spark, [(prompt, reference, prediction)])[0].exact_match is exact


def test_heuristic_judge_cases(spark):
    cases = [
        (("q", "Paris", "Paris"), (1.0, "correct")),
        (("q", "A", "A. some long option text"), (1.0, "correct")),
        (("q", "Paris", "Tokyo"), (0.0, "incorrect")),
        (("q", "Paris", "Pluto"), (1.0, "correct")),
        (("q", "xylophone", "my xylophone"), (0.5, "partial")),
    ]
    rows = scored(spark, [case for case, _ in cases], judge="heuristic")
    assert [(r.judge_score, r.judge_label) for r in rows] == [want for _, want in cases]


def test_strict_mode_keeps_to_lone_letters(spark):
    cases = [
        ("q", "Paris", "Pluto"),
        (CHOICE_PROMPT, "C", "The answer is C."),
        (CHOICE_PROMPT, "A", "Paris"),
    ]
    loose, strict = scored(spark, cases, judge="heuristic"), scored(spark, cases, judge="heuristic", strict=True)
    assert [r.normalized_match for r in loose] == [True, False, True]
    assert [r.processed for r in loose] == ["Pluto", "E", "A"]
    assert [r.normalized_match for r in strict] == [False, True, False]
    assert [r.processed for r in strict] == ["Pluto", "C", "Paris"]
    assert [r.judge_label for r in strict] == ["incorrect", "correct", "incorrect"]


def in_sql(triples):
    """The same scores by DuckDB, keyed by row."""
    rows = pd.DataFrame(triples, columns=["prompt", "reference", "prediction"]).reset_index()
    made = sql_views.processed("prediction", "contains(prompt, 'Options:')")
    right, label = sql_views.verdict("rn", "rc", "pn", "pc")
    sql = f"""SELECT index, processed, {sql_views.strip('reference')} = processed AS exact,
            rn = {sql_views.norm('processed')} OR rc = {sql_views.choice('processed')} AS loose,
            {right} AS score, {label} AS label
        FROM (SELECT *, {made} AS processed, {sql_views.norm('reference')} AS rn, {sql_views.choice('reference')} AS rc,
                {sql_views.norm('prediction')} AS pn, {sql_views.choice('prediction')} AS pc FROM rows)
        ORDER BY index"""
    return duckdb.query_df(rows, "rows", sql).fetchall()


def test_scores_equal_sql(spark):
    rng = random.Random(7)
    pieces = ["A", "b", "the", "The answer is", "Paris", " ", "\t", "...", "42", "f)", "É", "an apple", "zzz", "(c)"]
    triples = []
    for _ in range(1500):
        text = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 4))) for _ in range(2)]
        triples.append((rng.choice(["q", CHOICE_PROMPT]), *text))
    for row, (i, *want) in zip(scored(spark, triples, judge="heuristic"), in_sql(triples)):
        assert row.sample_idx == i
        got = [row.processed, row.exact_match, row.normalized_match, row.judge_score, row.judge_label]
        assert got == want
        assert row.normalized_match or not row.exact_match


def test_the_judge_takes_either_text_as_the_reference(spark):
    texts = ["Paris", "the Paris", "", " ", "B", "(b) two", "xylophone", "my xylophone", "zzz", "é"]
    pairs = [(a, b) for a in texts for b in texts]
    there = scored(spark, [("q", a, b) for a, b in pairs], judge="heuristic")
    back = scored(spark, [("q", b, a) for a, b in pairs], judge="heuristic")
    assert [(r.judge_score, r.judge_label) for r in there] == [(r.judge_score, r.judge_label) for r in back]


def test_missing_prediction_is_no_match(spark):
    row = scored(spark, [("q", "A", None)], judge="heuristic")[0]
    assert not row.exact_match and not row.normalized_match


def test_judge_off_gives_no_score_and_zero_mean(spark):
    rows = spark.createDataFrame([(1, 1, "q", "A", "B")], "cell_idx int, sample_idx long, prompt string, reference string, prediction string")
    off = score.score_rows(score.reference_forms(rows))
    assert off.first().judge_score is None
    grid = spark.createDataFrame([(1,), (2,)], "cell_idx int")
    means = {r.cell_idx: r.judge_avg_score for r in rollup.cell_judge(grid, off).collect()}
    assert means == {1: 0.0, 2: 0.0}


REPLIES = {
    '{"score": 0.5, "label": "partial"}': (0.5, "partial"),
    'Sure! {"score": 1, "label": "correct"} done': (1.0, "correct"),
    '{"score": 3}': (1.0, "incorrect"),
    '{"score": -1}': (0.0, "incorrect"),
    "no json here": (0.0, "incorrect"),
    "0.8": (0.0, "incorrect"),
    "[1]": (0.0, "incorrect"),
    '{"score": null}': (0.0, "incorrect"),
    '{"label": null}': (0.0, "None"),
    '{"score": "0.7", "label": "x"}': (0.7, "x"),
    '{"score": "high"}': (0.0, "incorrect"),
    '{"score": true}': (1.0, "incorrect"),
    '{"score":\n0.25}': (0.25, "incorrect"),
    '{"a": 1} and {"score": 1}': (0.0, "incorrect"),
    '{"score": 1},{"score": 0}': (0.0, "incorrect"),
    '{"score": 1}] {"x": 1}': (0.0, "incorrect"),
    '{"score": 1, "score": 0.25}': (0.25, "incorrect"),
    '{"label": "a } b", "score": 0.5}': (0.5, "a } b"),
    "": (0.0, "incorrect"),
    "{}": (0.0, "incorrect"),
    "{": (0.0, "incorrect"),
    "{'score': 1}": (0.0, "incorrect"),
    '{"score": 1, "label": 5}': (1.0, "5"),
    # Numbers in texts are read as Python reads them, not as Java does.
    '{"score": "0.7d", "label": "x"}': (0.0, "incorrect"),
    '{"score": "0x1p-1", "label": "x"}': (0.0, "incorrect"),
    '{"score": " 1_0e-1 ", "label": "x"}': (1.0, "x"),
    '{"score": "1__0", "label": "x"}': (0.0, "incorrect"),
    '{"score": ".5", "label": "x"}': (0.5, "x"),
    '{"score": "inf", "label": "x"}': (1.0, "x"),
    '{"score": "nan", "label": "x"}': (0.0, "incorrect"),
    '{"score": 1, "label": true}': (1.0, "True"),
    '{"score": 1, "label": "true"}': (1.0, "true"),
}


def test_judge_replies(spark):
    df = spark.createDataFrame(list(enumerate(REPLIES)), "i int, reply string")
    rows = judge.parse_judge_replies(df).orderBy("i").collect()
    for row, (text, want) in zip(rows, REPLIES.items()):
        assert tuple(row.verdict) == want, text


def test_parsed_replies_can_judge_the_scores(spark):
    df = spark.createDataFrame(
        [(0, "q", "A", "B", '{"score": 0.25, "label": "partial"}'), (1, "q", "A", "B", None)],
        "sample_idx long, prompt string, reference string, prediction string, reply string",
    )
    rows = judge.parse_judge_replies(score.reference_forms(df))
    found = sorted(score.score_rows(rows, judge=F.col("verdict")).collect())
    assert [(r.judge_score, r.judge_label) for r in found] == [(0.25, "partial"), (0.0, "incorrect")]


def test_judge_prompt_holds_the_three_texts(spark):
    columns = F.lit("q?"), F.lit("ref"), F.lit("pred")
    own = judging.judge_prompt(*columns, system="S", headings=("1", "2", "3"), closing="E")
    assert spark.range(1).select(own).first()[0] == "S\n\n1\nq?\n\n2\nref\n\n3\npred\n\nE"


@pytest.fixture()
def paired(spark):
    samples = spark.createDataFrame([(i, f"p{i}", f"r{i}") for i in range(5)], "sample_idx long, prompt string, reference string")
    grid = spark.createDataFrame([(1,), (2,)], "cell_idx int")
    rows = [(c, i, f"a{c}{i}") for c in (1, 2) for i in range(5)]
    return samples, grid, rows


def predictions(spark, rows):
    return spark.createDataFrame(rows, "cell_idx int, sample_idx long, prediction string")


def test_aligned(spark, paired):
    samples, grid, rows = paired
    aligned = score.align_outputs(samples, predictions(spark, rows), grid).collect()
    assert sorted((r.cell_idx, r.sample_idx, r.prompt, r.reference, r.prediction) for r in aligned) == [
        (c, i, f"p{i}", f"r{i}", a) for c, i, a in rows
    ]


@pytest.mark.parametrize(
    "change, message",
    [
        (lambda rows: rows[:-1], "sample without a prediction"),
        (lambda rows: [r for r in rows if r[1] != 3], "sample without a prediction"),
        (lambda rows: rows + [(1, 99, "x")], "prediction without a sample"),
        (lambda rows: rows + [(1, 0, "x")], "more than one prediction"),
        (lambda rows: rows + [(9, 0, "x")], "unknown cell"),
    ],
)
@pytest.mark.parametrize("columns", [["prediction"], ["cell_idx", "sample_idx"]])
def test_misaligned_raises(spark, paired, change, message, columns):
    samples, grid, rows = paired
    with pytest.raises(Exception, match=message):
        score.align_outputs(samples, predictions(spark, change(rows)), grid).select(*columns).collect()


@pytest.mark.parametrize("columns", [["prediction"], ["cell_idx", "sample_idx"]])
def test_a_sample_given_twice_raises(spark, paired, columns):
    samples, grid, rows = paired
    twice = samples.unionByName(samples.filter("sample_idx = 2"))
    with pytest.raises(Exception, match="sample given more than once"):
        score.align_outputs(twice, predictions(spark, rows), grid).select(*columns).collect()
    with pytest.raises(Exception, match="sample given more than once"):
        score.score_samples(twice, predictions(spark, rows)).select(*columns).collect()


@pytest.mark.parametrize("columns", [["exact_match"], ["cell_idx", "sample_idx"]])
def test_scoring_a_prediction_without_its_sample_raises(spark, paired, columns):
    samples, _, rows = paired
    assert score.score_samples(samples, predictions(spark, rows[:-1])).count() == 9
    with pytest.raises(Exception, match="prediction without a sample"):
        score.score_samples(samples, predictions(spark, rows + [(1, 99, "x")])).select(*columns).collect()


def test_alignment_report(spark, paired):
    samples, grid, rows = paired
    given = predictions(spark, rows[:-1] + [(1, 99, "x"), (1, 0, "x")])
    found = {r.cell_idx: tuple(r)[1:] for r in score.alignment_report(samples, given, grid).collect()}
    assert found == {1: (5, 7, 0, 1, 1), 2: (5, 4, 1, 0, 0)}
