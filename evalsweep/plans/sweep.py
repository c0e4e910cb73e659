"""A whole sweep: prompts to stored predictions, scores and results."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalsweep.functions.judging import JUDGE_SYSTEM, judge_prompt
from evalsweep.functions.text import answer_tag
from evalsweep.operators.grid import cell_samples
from evalsweep.operators.infer import ANSWER_SCHEMA, Factory, batch_infer, infer_cells
from evalsweep.operators.judge import parse_judge_replies
from evalsweep.operators.rollup import cell_results
from evalsweep.operators.score import align_outputs, reference_forms, score_rows
from evalsweep.operators.telemetry import TELEMETRY_COLUMNS
from evalsweep.plans.cell_jobs import cell_outcomes, read_committed, run_attempts
from evalsweep.sources.store import CELL_PARTITIONS, RESULT_COLUMNS, read_run, stored_cells, write_cells

KEYS = list(CELL_PARTITIONS)
JUDGE_TOKENS = 256
_KEY_SCHEMA = "experiment string, run_ts string, cell_idx int"


def _without(cells: DataFrame, path: str, run_ts: str) -> DataFrame:
    """The cells that have no folder under the path."""
    spark = cells.sparkSession
    stored = stored_cells(spark, path, run_ts)
    return cells.join(spark.createDataFrame(stored, _KEY_SCHEMA), KEYS, "left_anti") if stored else cells


def _answers(
    prompts: DataFrame, cells: DataFrame, factory: Factory, path: str, run_ts: str, limit_s: float | None, at_once: int
) -> DataFrame:
    """Answers of a wave; with a limit each cell is a job, and a cell without an answer fails on every sample."""
    if limit_s is None:
        return infer_cells(prompts, cells, factory, KEYS)
    own = F.broadcast(cells.select(*KEYS))  # a wave
    options = [name for name in cells.columns if name not in KEYS]
    log = run_attempts(prompts, cells, factory, f"{path}/cell-jobs", run_ts, limit_s, at_once, options)
    log = log.join(own, KEYS, "left_semi")
    schema = f"{_KEY_SCHEMA}, sample_idx bigint, {ANSWER_SCHEMA}"
    answers = read_committed(prompts.sparkSession, f"{path}/cell-jobs", schema, log)
    failed = cell_outcomes(log).filter("status <> 'ok'").select(
        *KEYS, F.lit("CellFailed").alias("error_type"), "error", F.lit(False).alias("error_is_runtime")
    )
    rows = cell_samples(prompts.select("sample_idx"), failed)
    return answers.unionByName(rows, allowMissingColumns=True)


def _waves(cells: DataFrame, most: int) -> Iterator[Column]:
    """Filters that cut numbered cells into waves of at most ``most``.

    Cells of one number belong to different experiments; ``_place`` counts them.
    The numbers come to the driver a partition at a time.
    """
    low, last, held = None, None, 0
    for number, n in cells.groupBy("cell_idx").count().orderBy("cell_idx").toLocalIterator():
        if held and held + n > most:
            yield F.col("cell_idx").between(low, last)
            held = 0
        if n > most:
            for first in range(1, n + 1, most):
                yield (F.col("cell_idx") == number) & F.col("_place").between(first, first + most - 1)
            continue
        low, last, held = (low if held else number), number, held + n
    if held:
        yield F.col("cell_idx").between(low, last)


def _result_schema(grid: DataFrame, with_readings: bool) -> T.StructType:
    """Types of the stored results: those of partition folders are never guessed."""
    hardware = {*TELEMETRY_COLUMNS, "hw_sample_count", "gpu_available"}
    described = set(grid.columns) | set(KEYS)
    axes = {"model_id", "backend", "quantization", "kv_cache", "prefix_cache", "max_new_tokens"}
    names = [
        name
        for name in RESULT_COLUMNS
        if (with_readings or name not in hardware) and (name not in axes or name in described)
    ]
    return T.StructType.fromDDL(", ".join(f"{name} {RESULT_COLUMNS[name]}" for name in names))


def run_sweep(
    samples: DataFrame,
    grid: DataFrame,
    factory: Factory,
    path: str,
    run_ts: str,
    judge: Column | str | Factory | None = None,
    readings: DataFrame | None = None,
    cells_per_wave: int = 16,
    tagged: bool = False,
    judge_system: str = JUDGE_SYSTEM,
    limit_s: float | None = None,
    cells_at_once: int = 1,
) -> DataFrame:
    """Run all cells of a grid over all samples and return their result rows.

    Cells run in waves of at most ``cells_per_wave``.  After each wave its
    predictions, scores and results are on disk under ``path``, one partition per
    cell.  Calling again with the same ``run_ts`` runs only the cells without a
    result, and asks the model only for those without stored answers: a crash
    costs at most the wave in flight.  Predictions must pair with the samples one
    to one, or the job fails.

    ``judge`` is None, ``"heuristic"``, a verdict column, or the factory of a
    judge model, which is asked about every prediction of a wave in one batch job
    whose replies are stored too.  ``tagged`` keeps what stands in an answer's
    answer or response tag.

    With ``limit_s`` each cell of a wave is a job of its own (``cell_jobs``): what
    it answered is committed by itself, so that a crash costs the cells in flight;
    one that takes longer, or whose worker dies, ends with status ``error`` while
    the others go on, and all attempts are logged under ``cell-jobs``.  Of
    ``cells_at_once`` cells that run side by side, one that waits for the cores of
    another uses up its time; one by one, none waits.  What is
    stored is found by folder names of this run; no data file is opened for it.

    ``samples`` holds ``sample_idx, prompt, reference``; ``grid`` the columns of
    ``grid_cells`` with an ``experiment``; ``readings`` raw hardware readings
    with ``experiment`` and ``cell_idx``.
    """
    spark = samples.sparkSession
    asks_model = judge is not None and not isinstance(judge, (Column, str))
    if readings is not None:
        readings = readings.withColumn("run_ts", F.lit(run_ts))
    # Reference forms are made once, not in every wave.
    forms_path = f"{path}/references/{run_ts}"
    reference_forms(samples.select("sample_idx", "prompt", "reference")).write.mode("overwrite").parquet(forms_path)
    forms = spark.read.parquet(forms_path)
    cells = grid.withColumn("experiment", F.col("experiment").cast("string")).withColumn("run_ts", F.lit(run_ts))
    todo = _without(cells, f"{path}/results", run_ts)
    todo = todo.withColumn("_place", F.row_number().over(Window.partitionBy("cell_idx").orderBy("experiment")))
    for in_wave in _waves(todo, cells_per_wave):
        # At most cells_per_wave rows.
        rows = todo.filter(in_wave).drop("_place")
        wave = spark.createDataFrame(rows.collect(), rows.schema)

        def stored(name: str, schema: T.StructType) -> DataFrame:
            """The wave's rows back from disk; the filter prunes partitions."""
            numbers = [row["cell_idx"] for row in wave.select("cell_idx").distinct().collect()]
            kept = read_run(spark, f"{path}/{name}", schema, run_ts).filter(F.col("cell_idx").isin(numbers))
            return kept.join(F.broadcast(wave.select(*KEYS)), KEYS, "left_semi")

        unasked = _without(wave, f"{path}/predictions", run_ts)
        answers = _answers(forms.select("sample_idx", "prompt"), unasked, factory, path, run_ts, limit_s, cells_at_once)
        if tagged:
            answers = answers.withColumn("prediction", answer_tag(F.col("prediction")))
        if not unasked.isEmpty():
            write_cells(answers, f"{path}/predictions", gather=False)
        paired = align_outputs(forms, stored("predictions", answers.schema), wave, KEYS)
        verdict = judge
        if asks_model:
            unjudged = _without(wave, f"{path}/judgements", run_ts)
            text = judge_prompt(F.col("prompt"), F.col("reference"), F.coalesce("prediction", F.lit("")), judge_system)
            asked = paired.join(F.broadcast(unjudged.select(*KEYS)), KEYS, "left_semi")
            asked = asked.select(*KEYS, "sample_idx", text.alias("prompt"))
            replies = batch_infer(asked, judge, KEYS, load_on=(), budget=F.lit(JUDGE_TOKENS)).select(
                *KEYS, "sample_idx", F.col("prediction").alias("reply"), F.col("error").alias("judge_error")
            )
            if not unjudged.isEmpty():
                write_cells(replies, f"{path}/judgements", gather=False)
            parsed = parse_judge_replies(stored("judgements", replies.schema))
            paired = paired.join(parsed.select(*KEYS, "sample_idx", "verdict"), [*KEYS, "sample_idx"])
            verdict = F.col("verdict")
        # Prompts and references stay in the samples table instead of once per cell.
        scores = score_rows(paired, verdict).drop("prompt", "reference", "verdict")
        write_cells(scores, f"{path}/scores")
        results = cell_results(wave, stored("scores", scores.schema), readings, keys=KEYS)
        write_cells(results, f"{path}/results")
    schema = _result_schema(grid, readings is not None)
    return read_run(spark, f"{path}/results", schema, run_ts)
