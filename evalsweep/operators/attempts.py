"""Outcome of cell attempts read from an attempt log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalsweep.functions.measures import attempt_error, attempt_status


def attempt_outcome(
    attempts: DataFrame, exit_code: str = "exit_code", payload: str = "payload", reason: str | None = None
) -> DataFrame:
    """Add ``status``, ``error`` and the payload that counts (none after a timeout)."""
    code, result = F.col(exit_code), F.col(payload)
    why = None if reason is None else F.col(reason)
    return attempts.select(
        *[c for c in attempts.columns if c != payload],
        attempt_status(code, result).alias("status"),
        attempt_error(code, result, why).alias("error"),
        F.when(code.isNotNull(), result).alias(payload),
    )
