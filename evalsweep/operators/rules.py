"""Data-quality rules over tables of sweep specs, results or datasets.

``violations`` checks all rules of a table in one narrow pass.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values -----------------------------------------------------------
BACKENDS = ("hf", "vllm", "mock", "api")
CODECS = ("snappy", "gzip", "brotli", "zstd", "none")
JUDGE_PROVIDERS = ("mock", "api")
DEFAULTS = {
    "backend": "hf",
    "description": "",
    "source": "hf",
    "split": "test",
    "max_samples": 100,
    "max_new_tokens": 256,
    "temperature": 0.0,
    "top_p": 1.0,
    "repetition_penalty": 1.0,
    "monitor_interval_ms": 50,
    "gpu_device_index": 0,
    "tdp_limit_watts": 300,
    "results_dir": "results",
    "compress": "snappy",
    "seed": 42,
    "judge_enabled": False,
    "judge_provider": "mock",
}
# ------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """``broken`` is true on rows that violate the rule, ``message`` says how."""

    name: str
    broken: Column
    message: Column


def allowed_values(column: str, values: Sequence[str]) -> Rule:
    """The column must hold one of the values; NULL is a violation."""
    cell = F.col(column)
    return Rule(
        f"allowed:{column}",
        cell.isNull() | ~cell.isin(*values),
        F.concat(F.lit(f"{column} not allowed: "), F.coalesce(cell, F.lit("NULL"))),
    )


def in_range(
    column: str,
    minimum: float | None = None,
    maximum: float | None = None,
    exclusive_minimum: float | None = None,
) -> Rule:
    """Bounds of a numeric column; NULL passes, defaults fill it."""
    cell = F.col(column)
    broken = F.lit(False)
    if minimum is not None:
        broken = broken | (cell < minimum)
    if maximum is not None:
        broken = broken | (cell > maximum)
    if exclusive_minimum is not None:
        broken = broken | (cell <= exclusive_minimum)
    return Rule(f"range:{column}", F.coalesce(broken, F.lit(False)), F.lit(f"{column} out of range"))


def required_if(trigger: str, value: str, needed: str) -> Rule:
    """``needed`` must be set wherever ``trigger`` has the value."""
    return Rule(
        f"required:{needed}",
        F.coalesce(F.col(trigger) == value, F.lit(False)) & F.col(needed).isNull(),
        F.lit(f"{trigger}='{value}' requires {needed}"),
    )


def known_keys(column: str, allowed: Sequence[str]) -> Rule:
    """Map column with keys outside the allowed set."""
    unknown = F.array_sort(
        F.array_except(F.map_keys(F.col(column)), F.array(*[F.lit(key) for key in allowed]))
    )
    return Rule(
        f"unknown:{column}",
        F.coalesce(F.size(unknown), F.lit(0)) > 0,
        F.concat(F.lit("unknown keys: "), F.array_join(unknown, ", ")),
    )


def violations(df: DataFrame, key: str | Sequence[str], rules: Sequence[Rule]) -> DataFrame:
    """``(key, rule, message)`` for every broken rule of every row."""
    keys = [key] if isinstance(key, str) else list(key)
    found = F.array(
        *[
            F.when(rule.broken, F.struct(F.lit(rule.name).alias("rule"), rule.message.alias("message")))
            for rule in rules
        ]
    )
    return df.select(*keys, F.explode(F.array_compact(found)).alias("_v")).select(
        *keys, "_v.rule", "_v.message"
    )


@dataclass(frozen=True)
class Admitted:
    """What one pass over a table let in, what it turned away and why, and how many rows of each."""

    good: DataFrame
    rejected: DataFrame
    counts: dict[str, int]


def _broken(rules: Sequence[Rule]) -> Column:
    found = [F.when(rule.broken, F.struct(F.lit(rule.name).alias("rule"), rule.message.alias("message"))) for rule in rules]
    return F.array_compact(F.array(*found))


def admit(df: DataFrame, rules: Sequence[Rule], path: str) -> Admitted:
    """Let in the rows that keep every rule; the others are put aside under ``path``.

    The table is read once: both kinds are written in the same pass, and counted in
    it.  ``rejected`` has the table's columns and ``broken``, a list of (rule,
    message); ``counts`` holds ``rows``, ``good``, ``rejected`` and, under the name
    of each rule, the rows that break it.  ``good`` is what was written, so that
    nothing behind it reads a rejected row or checks again.
    """
    seen = Observation()
    marked = df.withColumn("broken", _broken(rules)).withColumn("_rejected", F.size("broken") > 0)
    counted = [
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~F.col("_rejected")).alias("good"),
        F.count_if("_rejected").alias("rejected"),
        *[F.count_if(F.array_contains("broken.rule", rule.name)).alias(rule.name) for rule in rules],
    ]
    marked.observe(seen, *counted).write.partitionBy("_rejected").parquet(path)
    counts = {name: value or 0 for name, value in seen.get.items()}
    stored = df.sparkSession.read.schema(marked.schema).parquet(path)
    return Admitted(
        stored.filter(~F.col("_rejected")).select(*df.columns),
        stored.filter("_rejected").select(*df.columns, "broken"),
        counts,
    )


def refuse(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The same rows, but a job that meets one breaking a rule fails and says which."""
    checks = F.lit(True)
    for rule in rules:
        text = F.concat(F.lit(f"{rule.name}: "), rule.message)
        checks = checks & F.when(rule.broken, F.raise_error(text).cast("boolean")).otherwise(F.lit(True))
    return df.filter(checks)


def unknown_fields(schema: T.DataType, allowed: Mapping | None, path: str = "") -> list[str]:
    """Paths of struct fields, at any depth, outside the allowed tree.

    ``allowed`` maps a field name to the tree below it, or to None for a leaf.
    """
    while isinstance(schema, T.ArrayType):
        schema = schema.elementType
    if not isinstance(schema, T.StructType) or allowed is None:
        return []
    found = []
    for field in schema.fields:
        where = f"{path}.{field.name}" if path else field.name
        if field.name not in allowed:
            found.append(where)
        else:
            found.extend(unknown_fields(field.dataType, allowed[field.name], where))
    return found


def check_unknown_columns(spark: SparkSession, df: DataFrame, allowed: Mapping) -> DataFrame:
    """One row per unknown column or nested field of the table's schema."""
    paths = unknown_fields(df.schema, allowed)
    rows = [(path, f"unknown:{path}") for path in paths]
    return spark.createDataFrame(rows, "column string, rule string")


def count_unknown_fields(df: DataFrame, allowed: Mapping) -> DataFrame:
    """One row per unknown column or nested field, and in how many rows it is set; one pass."""
    paths = unknown_fields(df.schema, allowed)

    def is_set(path: str) -> Column:
        value, kind, in_list = F.col(".".join(f"`{part}`" for part in path.split("."))), df.schema, False
        for part in path.split("."):
            while isinstance(kind, T.ArrayType):
                kind, in_list = kind.elementType, True
            kind = kind[part].dataType
        return F.exists(value, lambda x: x.isNotNull()) if in_list else value.isNotNull()

    if not paths:
        return df.sparkSession.createDataFrame([], "column string, rule string, n_rows bigint")
    counts = df.agg(*[F.count_if(is_set(path)).alias(f"n{i}") for i, path in enumerate(paths)])
    rows = F.array(
        *[
            F.struct(F.lit(path).alias("column"), F.lit(f"unknown:{path}").alias("rule"), F.col(f"n{i}").alias("n_rows"))
            for i, path in enumerate(paths)
        ]
    )
    return counts.select(F.explode(rows).alias("_r")).select("_r.*")


def fill_defaults(df: DataFrame, defaults: Mapping[str, object] = DEFAULTS) -> DataFrame:
    """Absent values get their defaults; an explicit value is never changed."""
    present = {name: value for name, value in defaults.items() if name in df.columns}
    return df.withColumns(
        {name: F.coalesce(F.col(name), F.lit(value).cast(df.schema[name].dataType)) for name, value in present.items()}
    )
