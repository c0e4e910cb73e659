"""Numeric and status column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values -----------------------------------------------------------
OPTIONS_MARKER = "Options:"
CHOICE_TOKEN_BUDGET = 10
DEFAULT_TOKEN_BUDGET = 256
OOM_PHRASE = "out of memory"
OOM_TYPES = ("OutOfMemoryError", "torch.OutOfMemoryError", "torch.cuda.OutOfMemoryError")
RUNTIME_ERROR = "RuntimeError"
CELL_TIMEOUT_SECONDS = 3600
TIMEOUT_TEXT = f"Worker process timeout: did not complete within {CELL_TIMEOUT_SECONDS}s"
EXIT_TEXT = "Worker exited with code "
NO_OUTPUT_TEXT = "Worker produced no output: "
# ------------------------------------------------------------------------


def is_multiple_choice(prompt: Column) -> Column:
    """True when the prompt carries the options marker anywhere in its text."""
    return F.contains(prompt, F.lit(OPTIONS_MARKER))


def token_budget(is_choice: Column, max_new_tokens: Column) -> Column:
    """Generation limit: ten tokens for multiple choice, else the grid's own limit."""
    return (
        F.when(is_choice, F.lit(CHOICE_TOKEN_BUDGET))
        .otherwise(F.coalesce(max_new_tokens, F.lit(DEFAULT_TOKEN_BUDGET)))
        .cast("int")
    )


def throughput(n_tokens: Column, elapsed: Column) -> Column:
    """Tokens per second, 0.0 when no time was measured."""
    return F.when(elapsed > 0, n_tokens / elapsed).otherwise(F.lit(0.0))


def failure_status(error_type: Column, message: Column, is_runtime: Column | None = None) -> Column:
    """``oom`` or ``error`` for a failed attempt, NULL when nothing failed.

    ``is_runtime`` says whether the error is a runtime error or a kind of one;
    without it, or where it is NULL, the name of the type decides.
    """
    names_oom = F.contains(F.lower(message), F.lit(OOM_PHRASE))
    runtime = error_type == RUNTIME_ERROR
    if is_runtime is not None:
        runtime = runtime | F.coalesce(is_runtime, F.lit(False))
    out_of_memory = error_type.isin(*OOM_TYPES) | (runtime & F.coalesce(names_oom, F.lit(False)))
    return F.when(error_type.isNotNull(), F.when(out_of_memory, F.lit("oom")).otherwise(F.lit("error")))


def attempt_status(exit_code: Column, payload: Column) -> Column:
    """A finished attempt is good only when it ended in time and left a payload."""
    return F.when(exit_code.isNotNull() & payload.isNotNull(), F.lit("ok")).otherwise(F.lit("error"))


def attempt_error(exit_code: Column, payload: Column, reason: Column | None = None) -> Column:
    """Error text of an attempt without a result, NULL when it has one.

    The timeout is looked at first, so a payload left by an attempt that never
    exited is not used.
    """
    reason = F.lit("") if reason is None else F.coalesce(reason, F.lit(""))
    return (
        F.when(
            exit_code.isNull(),
            F.lit(TIMEOUT_TEXT),
        )
        .when(payload.isNotNull(), F.lit(None).cast("string"))
        .when(exit_code != 0, F.concat(F.lit(EXIT_TEXT), exit_code.cast("string")))
        .otherwise(F.concat(F.lit(NO_OUTPUT_TEXT), reason))
    )


def mebibytes(n_bytes: Column) -> Column:
    """Bytes to MiB; a missing reading counts as 0.0."""
    return F.coalesce(n_bytes / F.lit(1048576.0), F.lit(0.0))


def watts(milliwatts: Column) -> Column:
    """Milliwatts to watts; a missing reading counts as 0.0."""
    return F.coalesce(milliwatts / F.lit(1000.0), F.lit(0.0))


def percent(part: Column, whole: Column) -> Column:
    """Share in percent, 0.0 for an empty whole."""
    return F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))
