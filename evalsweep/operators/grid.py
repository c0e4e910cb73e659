"""Grid expansion: sweep specs to cells, and cells to (cell, sample) rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalsweep.operators.sizing import MAX_BROADCAST_ROWS, fits_broadcast, for_every_salt, with_salt

# What an absent axis stands for -----------------------------
DEFAULT_QUANTIZATION = (None, "int8", "int4")
DEFAULT_MAX_NEW_TOKENS = 256
DEFAULT_BACKEND = "hf"
# ------------------------------------------------------------------------

# Numbers that are expanded from one row, and cells that one task computes.
CHUNK, TASK_CELLS = 4096, 1_000_000

AXES = ("quantization", "kv_cache", "prefix_cache", "max_new_tokens")
# Settings of a spec that hold for all of its cells.
GENERATION = ("temperature", "top_p", "repetition_penalty")


def _filled(items: Column) -> Column:
    return items.isNotNull() & (F.coalesce(F.size(items), F.lit(0)) > 0)


def quantization_axis(specs: DataFrame) -> Column:
    """Absent means the default members; an explicit empty list stays empty."""
    default = F.array(*[F.lit(member).cast("string") for member in DEFAULT_QUANTIZATION])
    if "quantization" not in specs.columns:
        return default
    return F.coalesce(F.col("quantization"), default)


def cache_axis(specs: DataFrame) -> Column:
    """Named presets win; else both legacy lists crossed; else one (off, off)."""

    def pair(kv: Column, prefix: Column) -> Column:
        return F.struct(
            kv.cast("boolean").alias("kv_cache"), prefix.cast("boolean").alias("prefix_cache")
        )

    both_off = F.array(pair(F.lit(False), F.lit(False)))
    chain = None
    if "cache_config" in specs.columns:
        presets = F.col("cache_config")
        chain = F.when(
            _filled(presets), F.transform(presets, lambda p: pair(p["kv_cache"], p["prefix_cache"]))
        )
    if {"kv_cache", "prefix_cache"} <= set(specs.columns):
        kv_list, prefix_list = F.col("kv_cache"), F.col("prefix_cache")
        crossed = F.flatten(
            F.transform(kv_list, lambda kv: F.transform(prefix_list, lambda prefix: pair(kv, prefix)))
        )
        usable = _filled(kv_list) & _filled(prefix_list)
        chain = F.when(usable, crossed) if chain is None else chain.when(usable, crossed)
    return both_off if chain is None else chain.otherwise(both_off)


def token_axis(specs: DataFrame) -> Column:
    """A scalar limit is a one-member list."""
    default = F.array(F.lit(DEFAULT_MAX_NEW_TOKENS))
    if "max_new_tokens" not in specs.columns:
        return default
    limit = F.col("max_new_tokens")
    if isinstance(specs.schema["max_new_tokens"].dataType, T.ArrayType):
        return F.coalesce(limit, default)
    return F.array(F.coalesce(limit, F.lit(DEFAULT_MAX_NEW_TOKENS)).cast("int"))


def _axes(specs: DataFrame) -> DataFrame:
    """Specs with their axes as short lists, and ``_n_perms``, the size of the product."""
    axes = {"_quants": quantization_axis(specs), "_caches": cache_axis(specs), "_limits": token_axis(specs)}
    held = specs.withColumns(axes)
    sizes = [F.size(name).cast("bigint") for name in axes]
    return held.withColumn("_n_perms", sizes[0] * sizes[1] * sizes[2])


def _numbered(specs: DataFrame, n: Column, names: Sequence[str]) -> DataFrame:
    """A row for each number ``_at`` from 0 below ``n`` of each spec, beside the columns ``names``.

    Numbers are dealt out in chunks; no list is longer than a chunk or the number
    of chunks, and the chunks of a large product go to many tasks.
    """
    counted = specs.withColumn("_n", n).filter("_n > 0")
    starts = F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1, F.lit(CHUNK).cast("bigint"))
    chunks = counted.select(*names, "_n", F.explode(starts).alias("_from"))
    total = counted.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    tasks = min(-(-total // TASK_CELLS), int(specs.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 16)
    if tasks > 1:
        chunks = chunks.repartition(int(tasks))
    stop = F.least(F.col("_from") + CHUNK, F.col("_n")) - 1
    return chunks.select(*names, F.explode(F.sequence(F.col("_from"), stop)).alias("_at"))


def _axis_values(at: Column) -> list[Column]:
    """Mixed-radix digits of a place in the product, as members of the axes; the last axis turns fastest."""
    n_limits, n_caches = F.size("_limits").cast("bigint"), F.size("_caches").cast("bigint")

    def member(axis: str, place: Column) -> Column:
        return F.get(F.col(axis), place.cast("int"))

    def over(a: Column, b: Column) -> Column:
        return F.call_function("div", a, b)

    cache = member("_caches", over(at, n_limits) % n_caches)
    return [
        member("_quants", over(at, n_limits * n_caches)).alias("quantization"),
        cache["kv_cache"].alias("kv_cache"),
        cache["prefix_cache"].alias("prefix_cache"),
        member("_limits", at % n_limits).cast("int").alias("max_new_tokens"),
    ]


def permutations(specs: DataFrame, keys: Sequence[str] = ("experiment",)) -> DataFrame:
    """One row per hyperparameter combination of each spec, numbered from 0.

    Each combination is computed from its number alone: the product is held
    nowhere, and numbers are dealt out over many tasks.
    """
    held = _axes(specs)
    rows = _numbered(held, F.col("_n_perms"), [*keys, "_quants", "_caches", "_limits"])
    return rows.select(*keys, F.col("_at").cast("int").alias("perm_idx"), *_axis_values(F.col("_at")))


def _cells(rows: DataFrame, keys: Sequence[str], more: Sequence[str], settings: Sequence[str]) -> DataFrame:
    """Cells of the numbers ``_at``, from 0, beside the axes of their specs."""
    model = F.get(F.col("models"), F.call_function("div", F.col("_at"), F.col("_n_perms")).cast("int"))
    return rows.select(*rows.columns, model.alias("_model")).select(
        *keys,
        (F.col("_at") + 1).cast("int").alias("cell_idx"),
        F.col("_model.id").alias("model_id"),
        F.coalesce(F.col("_model.backend"), F.lit(DEFAULT_BACKEND)).alias("backend"),
        *_axis_values(F.col("_at") % F.col("_n_perms")),
        *[F.col(f"_model.{name}").alias(name) for name in more],
        *settings,
    )


def _described(specs: DataFrame) -> tuple[list[str], list[str]]:
    """Options of the models, and generation settings of the spec."""
    described = {"id", "backend", *AXES}
    more = [f.name for f in specs.schema["models"].dataType.elementType.fields if f.name not in described]
    return more, [name for name in GENERATION if name in specs.columns and name not in more]


def grid_cells(specs: DataFrame, keys: Sequence[str] = ("experiment",)) -> DataFrame:
    """Models times permutations, model-major; ``cell_idx`` counts from 1 per spec.

    ``models`` is a list of structs with ``id`` and ``backend``; what else a
    struct holds are options of that model.  Those and the generation settings of
    the spec become columns of its cells, for the model factory.  Each cell is
    computed from its number alone.
    """
    more, settings = _described(specs)
    held = _axes(specs)
    n = F.size("models").cast("bigint") * F.col("_n_perms")
    names = [*keys, *settings, "models", "_quants", "_caches", "_limits", "_n_perms"]
    return _cells(_numbered(held, n, names), keys, more, settings)


def cells_at(specs: DataFrame, numbers: DataFrame, keys: Sequence[str] = ("experiment",)) -> DataFrame:
    """The cells of ``numbers`` (keys and ``cell_idx``), without expanding the rest of the grid.

    Numbers beyond a spec's grid, and those of unknown specs, give no row.
    """
    more, settings = _described(specs)
    rows = _axes(specs).join(numbers.select(*keys, (F.col("cell_idx") - 1).cast("bigint").alias("_at")), list(keys))
    rows = rows.filter((F.col("_at") >= 0) & (F.col("_at") < F.size("models") * F.col("_n_perms")))
    return _cells(rows, keys, more, settings)


def grid_size(specs: DataFrame, keys: Sequence[str] = ("experiment",)) -> DataFrame:
    """Number of cells of each spec, without expanding them."""
    n_cells = (
        F.size(F.col("models"))
        * F.size(quantization_axis(specs))
        * F.size(cache_axis(specs))
        * F.size(token_axis(specs))
    )
    return specs.select(*keys, n_cells.cast("bigint").alias("n_cells"))


def cell_samples(
    samples: DataFrame,
    grid: DataFrame,
    on: Sequence[str] = (),
    id_col: str = "sample_idx",
    salts: int | None = None,
    broadcast_rows: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """Every cell sees every sample (of its dataset, when ``on`` names the link).

    A grid of checked small size is carried to the samples, which then stay
    where they are.  A larger grid is cut into slices that each fit, and every
    slice is carried to the samples; where ``on`` links them, the two meet in a
    salted equi-join instead, so that a dataset holding most of the samples is
    spread over ``salts`` sub-keys, by default as many as a shuffle has
    partitions.
    """
    on = list(on)
    if fits_broadcast(grid, broadcast_rows):
        return samples.join(F.broadcast(grid), on) if on else _carried(samples, grid)
    if on:
        salts = salts or int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        salted = with_salt(samples, salts, id_col)
        return salted.join(for_every_salt(grid, salts), [*on, "_salt"]).drop("_salt")
    # Halved until every slice fits in rows and bytes.
    slices = 2
    while True:
        parts = [
            grid.filter(F.pmod(F.xxhash64(*grid.columns), F.lit(slices)) == part) for part in range(slices)
        ]
        if all(fits_broadcast(part, broadcast_rows) for part in parts):
            break
        if slices > 2**16:
            raise ValueError("too many equal cells for one slice of the grid")
        slices *= 2
    return reduce(DataFrame.unionAll, [_carried(samples, part) for part in parts])


def _carried(samples: DataFrame, grid: DataFrame) -> DataFrame:
    cells = grid.agg(F.collect_list(F.struct(*grid.columns))).scalar()
    return samples.withColumn("_cell", F.explode(cells)).select(*samples.columns, "_cell.*")
