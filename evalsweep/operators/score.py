"""Scoring of predictions against reference answers.

All comparison forms of a reference are computed once per sample, before the
join with the (cells x samples) predictions, and the scoring itself is a narrow
projection of built-in expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalsweep.functions.judging import heuristic_verdict, lone_letter
from evalsweep.functions.measures import is_multiple_choice
from evalsweep.functions.text import (
    extract_choice,
    first_option_letter,
    is_letter,
    normalize_text,
    strip,
)
from evalsweep.operators.sizing import fits_broadcast


def reduce_mc_prediction(prediction: Column, is_choice: Column, strict: bool = False) -> Column:
    """Stripped prediction, cut to its choice letter for multiple-choice prompts.

    By default any letter A-E counts, wherever it stands.  ``strict`` takes a
    standalone letter only.
    """
    choice = extract_choice(prediction)
    if strict:
        return F.coalesce(_choice_letter(choice, is_choice, strict), strip(prediction))
    return F.coalesce(
        _option_letter(prediction, is_choice), _choice_letter(choice, is_choice, strict), strip(prediction)
    )


def _option_letter(prediction: Column, is_choice: Column) -> Column:
    """First letter A-E of a multiple-choice prediction, NULL if there is none."""
    letter = first_option_letter(prediction)
    return F.when(is_choice & (letter != ""), letter)


def _choice_letter(choice: Column, is_choice: Column, strict: bool) -> Column:
    """The choice of a multiple-choice prediction where it is a letter, else NULL."""
    return F.when(is_choice & (lone_letter(choice) if strict else is_letter(choice)), choice)


def _same(ref_choice: Column, choice: Column, strict: bool) -> Column:
    """Equal choices; ``strict`` compares those of lone letters only."""
    return (ref_choice == choice) & lone_letter(ref_choice) if strict else ref_choice == choice


def reference_forms(samples: DataFrame) -> DataFrame:
    """Add the comparison forms of each reference, once per sample."""
    reference = F.col("reference")
    return samples.select(
        "*",
        is_multiple_choice(F.col("prompt")).alias("is_mc"),
        strip(reference).alias("_ref_strip"),
        normalize_text(reference).alias("_ref_norm"),
        extract_choice(reference).alias("_ref_choice"),
    )


def score_rows(
    rows: DataFrame, judge: Column | str | None = None, strict: bool = False
) -> DataFrame:
    """Score rows that hold ``prediction`` and the columns of ``reference_forms``.

    Predictions match exactly when the stripped reference equals the reduced
    prediction, and match normalized when their comparison forms or their
    choices are equal.  ``judge`` is None (off), ``"heuristic"``, or a struct
    column with ``judge_score`` and ``judge_label`` such as a parsed reply.

    Each step names what later ones use more than once, and the costly forms of
    a text are made only where a cheaper rule has not settled the row: a
    prediction cut to a letter needs none, and equal choices need no normalized
    text.  Stripping does not change the comparison forms of a text.
    """
    heuristic = isinstance(judge, str)
    if heuristic and judge != "heuristic":
        raise ValueError(f"unknown judge {judge!r}; give 'heuristic', a verdict column or None")
    helpers = {"_ref_strip", "_ref_norm", "_ref_choice"}
    kept = [name for name in rows.columns if name not in helpers]
    prediction, whole = F.col("prediction"), F.col("_pred_strip")
    ref_norm, ref_choice = F.col("_ref_norm"), F.col("_ref_choice")

    option = F.lit(None).cast("string") if strict else _option_letter(prediction, F.col("is_mc"))
    read = rows.select("*", strip(prediction).alias("_pred_strip"), option.alias("_option"))
    choice = extract_choice(prediction)
    chosen = read.withColumn(
        "_pred_choice", choice if heuristic else F.when(F.col("_option").isNull(), choice)
    )
    pred_choice = F.col("_pred_choice")
    letter = F.coalesce("_option", _choice_letter(pred_choice, F.col("is_mc"), strict))
    reduced = chosen.withColumn("_letter", letter)
    letter = F.col("_letter")
    own_choice = F.coalesce(letter, F.when(whole == "", F.lit("")).otherwise(pred_choice))
    compared = reduced.select(
        "*",
        F.coalesce(letter, whole).alias("processed"),
        _same(ref_choice, own_choice, strict).alias("_same_choice"),
        ((ref_choice != "") & _same(ref_choice, pred_choice, strict)).alias("_judged_same"),
    )
    open_rows = letter.isNull() & ~F.col("_same_choice")
    if heuristic:
        open_rows = open_rows | ~F.col("_judged_same")
    settled = compared.withColumn("_pred_norm", F.when(open_rows, normalize_text(prediction)))
    # The comparison form of a single upper-case letter needs no text rules.
    letter_norm = F.when(letter == "A", F.lit("")).otherwise(F.lower(letter))
    own_norm = F.coalesce(letter_norm, F.col("_pred_norm"))
    if heuristic:
        judge = heuristic_verdict(ref_norm, F.col("_pred_norm"), F.col("_judged_same"))
    none = F.lit(None)
    score = none.cast("double") if judge is None else judge["judge_score"]
    label = none.cast("string") if judge is None else judge["judge_label"]
    return settled.select(
        *kept,
        "processed",
        F.coalesce(F.col("_ref_strip") == F.col("processed"), F.lit(False)).alias("exact_match"),
        F.coalesce(F.col("_same_choice") | (ref_norm == own_norm), F.lit(False)).alias("normalized_match"),
        score.alias("judge_score"),
        label.alias("judge_label"),
    )


def score_samples(
    samples: DataFrame,
    predictions: DataFrame,
    judge: Column | str | None = None,
    strict: bool = False,
    on: Sequence[str] = ("sample_idx",),
) -> DataFrame:
    """Score predictions of all cells against the samples they answer.

    A prediction without its sample, and a sample number given twice, fail the
    job: accuracy is never taken over fewer or more rows than were predicted.
    Missing predictions show only against a grid: see ``align_outputs``.

    The only exchange is the join on the sample key.  Each sample occurs once per
    cell, so that key has no hot values, and prompt and reference texts travel
    with the predictions only if the caller selects them.
    """
    on = list(on)
    forms = reference_forms(samples).select(
        "*", F.count(F.lit(1)).over(Window.partitionBy(*on)).alias("_given")
    )
    where = F.concat_ws("/", *[F.col(name).cast("string") for name in on])
    mismatch = F.when(F.col("_given").isNull(), F.concat(F.lit("prediction without a sample: "), where)).when(
        F.col("_given") > 1, F.concat(F.lit("sample given more than once: "), where)
    )
    paired = predictions.join(forms, on, "left").filter(_sound(mismatch)).drop("_given")
    return score_rows(paired, judge, strict)


def _sound(mismatch: Column) -> Column:
    """True, or an error with the mismatch.  A filter, unlike a column, is never pruned."""
    return F.when(mismatch.isNotNull(), F.raise_error(mismatch).cast("boolean")).otherwise(F.lit(True))


def align_outputs(
    samples: DataFrame, predictions: DataFrame, grid: DataFrame, keys: Sequence[str] = ("cell_idx",)
) -> DataFrame:
    """Pair every cell's predictions with the samples; any mismatch fails the job.

    A prediction without its sample or its cell, a sample that lacks a cell's
    prediction, and a prediction or sample given twice are all errors.  They are raised
    from inside the joined rows, so the data is read once.  Predictions and
    samples each move once, by sample number: texts are not repeated per cell
    before they move, and a sample number has at most one row per cell.
    """
    keys = list(keys)
    cells = grid.select(*keys).withColumn("_known", F.lit(True))
    if fits_broadcast(cells):
        cells = F.broadcast(cells)
    n_cells = grid.agg(F.count(F.lit(1))).scalar()
    # One window serves both columns: a repeated cell follows its own copy.
    in_order = Window.partitionBy("sample_idx").orderBy(*keys)
    everything = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    given = predictions.join(cells, keys, "left").select(
        "*",
        F.count(F.lit(1)).over(everything).alias("_given"),
        (F.lag(F.struct(*keys)).over(in_order) == F.struct(*keys)).alias("_repeated"),
    )
    asked = samples.withColumn("_asked", F.count(F.lit(1)).over(Window.partitionBy("sample_idx")))
    joined = asked.join(given, "sample_idx", "full_outer")
    where = F.concat_ws("/", *[F.col(name).cast("string") for name in (*keys, "sample_idx")])
    mismatch = (
        F.when(F.col("_asked").isNull(), F.concat(F.lit("prediction without a sample: "), where))
        .when(F.col("_asked") > 1, F.concat(F.lit("sample given more than once: "), where))
        .when(F.col("_repeated"), F.concat(F.lit("more than one prediction: "), where))
        .when(
            F.col("_given").isNotNull() & F.col("_known").isNull(),
            F.concat(F.lit("prediction of an unknown cell: "), where),
        )
        .when(
            F.coalesce(F.col("_given"), F.lit(0)) < n_cells,
            F.concat(F.lit("sample without a prediction in some cell: "), F.col("sample_idx").cast("string")),
        )
    )
    text = [c for c in samples.columns if c != "sample_idx"]
    answer = [c for c in predictions.columns if c not in (*keys, "sample_idx")]
    return joined.filter(_sound(mismatch)).select(*keys, "sample_idx", *text, *answer)


def alignment_report(
    samples: DataFrame, predictions: DataFrame, grid: DataFrame, keys: Sequence[str] = ("cell_idx",)
) -> DataFrame:
    """Per cell: samples asked, predictions given, and how many of them do not pair.

    Only what was given is counted and joined to the sample numbers; the pairs
    that were asked for are a product, never a table.  Cells that the grid does
    not know are listed with nothing asked.
    """
    keys = list(keys)
    n_asked = samples.agg(F.count_distinct("sample_idx")).scalar()
    asked = samples.select("sample_idx").distinct().withColumn("_asked", F.lit(1))
    given = predictions.groupBy(*keys, "sample_idx").agg(F.count(F.lit(1)).alias("_given"))
    counted = (
        given.join(asked, "sample_idx", "left")
        .groupBy(*keys)
        .agg(
            F.sum("_given").alias("n_given"),
            F.count("_asked").alias("_paired"),
            F.count_if(F.col("_asked").isNull()).alias("n_unasked"),
            F.count_if(F.col("_given") > 1).alias("n_repeated"),
        )
    )
    cells = grid.select(*keys).withColumn("n_asked", n_asked)

    def number(name: str) -> Column:
        return F.coalesce(name, F.lit(0)).cast("bigint")

    return cells.join(counted, keys, "full_outer").select(
        *keys,
        number("n_asked").alias("n_asked"),
        number("n_given").alias("n_given"),
        F.greatest(number("n_asked") - number("_paired"), F.lit(0)).alias("n_missing"),
        number("n_unasked").alias("n_unasked"),
        number("n_repeated").alias("n_repeated"),
    )
