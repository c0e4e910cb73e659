"""Batch inference with a user-supplied model function."""

from __future__ import annotations

import atexit
import hashlib
import sys
import traceback
import types
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from time import perf_counter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.resource import ResourceProfile
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

import evalsweep
from evalsweep.functions.measures import is_multiple_choice, token_budget

# engine(prompts, budgets) -> one answer per prompt: a text, or a dict with
# "text" and any of "ttft_s", "total_s", "n_tokens".
Engine = Callable[[list[str], list[int]], Sequence]
# factory(model_id, options) -> engine; an engine may have a close() method.
Factory = Callable[[str, dict], Engine]

ANSWER_SCHEMA = (
    "prediction string, ttft_s double, total_s double, n_tokens int, error_type string, error string, "
    "error_is_runtime boolean"
)
_ANSWER_TYPES = {
    "prediction": pa.string(),
    "ttft_s": pa.float64(),
    "total_s": pa.float64(),
    "n_tokens": pa.int32(),
    "error_type": pa.string(),
    "error": pa.string(),
    "error_is_runtime": pa.bool_(),
}


def _failure(exc: Exception) -> dict:
    """Runtime errors keep their message, everything else its traceback."""
    runtime = isinstance(exc, RuntimeError)
    text = str(exc) if runtime else traceback.format_exc()
    return {"error_type": type(exc).__name__, "error": text, "error_is_runtime": runtime}


def _closed(engine) -> dict | None:
    """Close an engine; what went wrong, or None."""
    try:
        if hasattr(engine, "close"):
            engine.close()
    except Exception as exc:
        return _failure(exc)
    return None


# Where a Python worker keeps engines between tasks: this package may be pickled anew with every task.
_KEPT = "evalsweep_kept_engines"


def _kept_engine(factory: Factory, token: str, config: dict, most: int) -> Engine:
    """The worker's engine for this factory and configuration, loaded if need be; the one unused longest gives way."""
    worker = sys.modules.setdefault(_KEPT, types.ModuleType(_KEPT)).__dict__
    if "engines" not in worker:
        worker["engines"] = {}
        atexit.register(lambda held=worker["engines"]: [_closed(engine) for engine in held.values()])
    held = worker["engines"]
    key = token, repr(sorted(config.items()))
    if key in held:
        held[key] = held.pop(key)
        return held[key]
    while len(held) >= most:
        _closed(held.pop(next(iter(held))))
    options = dict(config)
    held[key] = factory(options.pop("model_id", None), options)
    return held[key]


def _failed_late(batch: pa.RecordBatch, failure: dict | None) -> pa.RecordBatch:
    """The last answers of a cell, with the failure to close its engine on those without one."""
    if failure is None:
        return batch
    good = [kind is None for kind in batch.column("error_type").to_pylist()]
    columns = dict(zip(batch.schema.names, batch.columns))
    for name, value in failure.items():
        given = columns[name].to_pylist()
        columns[name] = pa.array([value if g else v for g, v in zip(good, given)], columns[name].type)
    return pa.RecordBatch.from_pydict(columns)


# Answers that go back to Spark together: a step of the model is far smaller.
_TOGETHER_ROWS, _TOGETHER_BYTES = 4096, 4 << 20


def _together(steps: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of many small batches in few, in the same order."""
    waiting, n_rows, n_bytes = [], 0, 0
    for step in steps:
        waiting.append(step)
        n_rows, n_bytes = n_rows + step.num_rows, n_bytes + step.nbytes
        if n_rows >= _TOGETHER_ROWS or n_bytes >= _TOGETHER_BYTES:
            yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()
            waiting, n_rows, n_bytes = [], 0, 0
    if waiting:
        yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()


def _one_call(engine: Engine, prompts: list[str], budgets: list[int]) -> dict[str, list]:
    """Columns of the answers; those that are left out are null."""
    started = perf_counter()
    answers = list(engine(prompts, budgets))
    elapsed = perf_counter() - started
    if len(answers) != len(prompts):
        raise ValueError(f"model gave {len(answers)} answers for {len(prompts)} prompts")
    answers = [answer if isinstance(answer, dict) else {"text": answer} for answer in answers]
    texts = [(answer.get("text") or "").strip() for answer in answers]
    each = elapsed / len(prompts) if prompts else 0.0
    return {
        "prediction": texts,
        "ttft_s": [answer.get("ttft_s") for answer in answers],
        "total_s": [answer.get("total_s", each) for answer in answers],
        "n_tokens": [answer.get("n_tokens") or max(len(text.split()), 1) for answer, text in zip(answers, texts)],
    }


def _answers(engine: Engine, prompts: list[str], budgets: list[int]) -> dict[str, list]:
    """Answers for a batch, by column; when it fails, all of its prompts are asked again, one by one."""
    try:
        return _one_call(engine, prompts, budgets)
    except Exception as exc:
        if len(prompts) == 1:
            return {name: [value] for name, value in _failure(exc).items()}
    single = [_answers(engine, [p], [b]) for p, b in zip(prompts, budgets)]
    return {name: [answer.get(name, (None,))[0] for answer in single] for name in _ANSWER_TYPES}


def _models(batch: pa.RecordBatch, load_on: Sequence[str]) -> list[tuple]:
    """The model of each row."""
    columns = [batch.column(name) for name in load_on]
    plain = not any(pa.types.is_nested(column.type) for column in columns)
    if plain and all(pc.count_distinct(column, mode="all").as_py() == 1 for column in columns):
        return [tuple(column[0].as_py() for column in columns)] * batch.num_rows
    return list(zip(*[column.to_pylist() for column in columns]))


def infer_cells(
    samples: DataFrame,
    cells: DataFrame,
    factory: Factory,
    keys: Sequence[str] = ("cell_idx",),
    options: Sequence[str] | None = None,
    batch_size: int = 64,
    keep_engines: int = 0,
    profile: ResourceProfile | None = None,
) -> DataFrame:
    """Run every cell over every ``(sample_idx, prompt)`` without moving a prompt.

    The samples are scanned once for each cell and the scans are united: a task
    has one split and one cell, and loads one model.  Give the samples as a stored
    table, or their prompts are built in every scan.  Meant for a wave of cells;
    all of them are named in one plan.

    With ``keep_engines`` a Python worker that Spark reuses keeps so many engines
    after their tasks, so that a cell of many splits is loaded once per worker.  A
    kept engine is closed when another takes its place, the last ones when their
    worker ends; what closing raises is lost then.  ``profile`` asks for the
    resources of a task, such as one accelerator, by stage-level scheduling.
    """
    rows = cells.collect()
    if not rows:
        cells_of_none = [F.lit(None).cast(f.dataType).alias(f.name) for f in cells.schema]
        none = samples.limit(0).select("sample_idx", "prompt", *cells_of_none)
        return batch_infer(none, factory, keys, options)
    scans = [
        samples.select(
            "sample_idx", "prompt", *[F.lit(row[f.name]).cast(f.dataType).alias(f.name) for f in cells.schema]
        )
        for row in rows
    ]
    united = reduce(DataFrame.unionAll, scans)
    return _infer(united, factory, keys, options, batch_size, keys, None, keep_engines, profile)


def batch_infer(
    rows: DataFrame,
    factory: Factory,
    keys: Sequence[str] = ("cell_idx",),
    options: Sequence[str] | None = None,
    tasks: int | None = None,
    batch_size: int = 64,
    gather: bool = False,
    load_on: Sequence[str] | None = None,
    budget: Column | None = None,
    keep_engines: int = 0,
    profile: ResourceProfile | None = None,
) -> DataFrame:
    """Run the model over ``(keys, sample_idx, prompt, model_id, options...)`` rows.

    Rows stay where they are and are put in cell order within their task, which
    loads each model that it meets; one model for all rows needs no order.  ``gather=True`` range-partitions them by
    (keys, sample_idx) first: few model loads per task and a large cell cut over
    many, at the price of moving the prompt of every row; ``infer_cells`` needs
    neither.  ``options`` names the columns that the factory gets, by default all
    others: axes, backend, generation settings.  A new model is loaded when the
    ``load_on`` columns change, by default the keys.

    A failing prompt fills ``error_type`` and ``error`` and the rest goes on.  An
    engine that fails to close fails the last batch of its cell.  For
    ``keep_engines`` and ``profile`` see ``infer_cells``.
    """
    keys = list(keys)
    load_on = keys if load_on is None else list(load_on)
    if gather:
        tasks = tasks or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.repartitionByRange(tasks, *keys, "sample_idx")
    settings = options if options is not None else {*rows.columns} - {*keys, "sample_idx", "prompt"}
    if load_on or settings:  # else one model answers all rows, in any order
        rows = rows.sortWithinPartitions(*keys, "sample_idx")
    return _infer(rows, factory, keys, options, batch_size, load_on, budget, keep_engines, profile)


def _infer(
    rows: DataFrame,
    factory: Factory,
    keys: Sequence[str],
    options: Sequence[str] | None,
    batch_size: int,
    load_on: Sequence[str],
    budget: Column | None,
    keep_engines: int,
    profile: ResourceProfile | None,
) -> DataFrame:
    # Executors need not have this package installed.
    cloudpickle.register_pickle_by_value(evalsweep)
    row_key = [*keys, "sample_idx"]
    if options is None:
        options = [name for name in rows.columns if name not in (*row_key, "prompt")]
    settings = [name for name in dict.fromkeys([*options, "model_id"]) if name in rows.columns]
    limit = F.col("max_new_tokens") if "max_new_tokens" in rows.columns else F.lit(None).cast("int")
    if budget is None:
        budget = token_budget(is_multiple_choice(F.col("prompt")), limit)
    wanted = list(dict.fromkeys([*row_key, "prompt", *settings]))
    work = rows.select(*wanted, budget.cast("int").alias("_budget"))
    # Tells the factories of different calls apart within a worker.
    token = hashlib.sha256(cloudpickle.dumps(factory)).hexdigest()

    def close(engine) -> dict | None:
        return None if keep_engines else _closed(engine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _together(steps(batches))

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine, loaded, load_error, held = None, None, None, None
        try:
            for batch in batches:
                # Rows that share a model are side by side; a step never crosses to another.
                models = _models(batch, load_on)
                start = 0
                while start < len(models):
                    stop = start + 1
                    while stop < len(models) and stop - start < batch_size and models[stop] == models[start]:
                        stop += 1
                    part = batch.slice(start, stop - start)
                    if models[start] != loaded:
                        # The last answers of a cell wait until its engine is closed.
                        closing, engine = engine, None
                        failure = close(closing)
                        if held is not None:
                            yield _failed_late(held, failure)
                        held, loaded, load_error = None, models[start], None
                        config = {name: part.column(name)[0].as_py() for name in settings}
                        try:
                            if keep_engines:
                                engine = _kept_engine(factory, token, config, keep_engines)
                            else:
                                engine = factory(config.pop("model_id", None), config)
                        except Exception as exc:
                            load_error = _failure(exc)
                    asked = part.column("prompt").to_pylist()
                    if load_error is not None:
                        answers = {name: [value] * len(asked) for name, value in load_error.items()}
                    else:
                        answers = _answers(engine, asked, part.column("_budget").to_pylist())
                    if held is not None:
                        yield held
                    held = pa.RecordBatch.from_arrays(
                        [
                            *[part.column(name) for name in row_key],
                            *[
                                pa.array(answers[name], kind) if name in answers else pa.nulls(len(asked), kind)
                                for name, kind in _ANSWER_TYPES.items()
                            ],
                        ],
                        names=[*row_key, *_ANSWER_TYPES],
                    )
                    start = stop
            closing, engine = engine, None
            failure = close(closing)
            if held is not None:
                yield _failed_late(held, failure)
        finally:
            close(engine)

    key_schema = ", ".join(f"{name} {rows.schema[name].dataType.simpleString()}" for name in row_key)
    return work.mapInArrow(run, f"{key_schema}, {ANSWER_SCHEMA}", profile=profile)
