"""Size checks that decide between a broadcast and a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A side is broadcast only below both bounds; beyond them the salted shuffle runs.
MAX_BROADCAST_ROWS = 50_000
MAX_BROADCAST_BYTES = 16 * 1024 * 1024


def fits_broadcast(
    side: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES
) -> bool:
    """Measure a side, reading at most ``max_rows + 1`` of its rows."""
    head = side.limit(max_rows + 1)
    size = head.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0)).alias("n_bytes"),
    ).first()
    return size["n_rows"] <= max_rows and size["n_bytes"] <= max_bytes


def with_salt(df: DataFrame, salts: int, *columns: str) -> DataFrame:
    """Spread equal join keys of the large side over ``salts`` sub-keys."""
    return df.withColumn("_salt", F.pmod(F.xxhash64(*columns), F.lit(salts)).cast("int"))


def for_every_salt(df: DataFrame, salts: int) -> DataFrame:
    """Repeat the small side once per sub-key."""
    return df.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


def spread(df: DataFrame) -> DataFrame:
    """Give every core a share of a table that is stored in too few splits.

    For work that is heavy per row, such as normalizing long texts.  A table
    with at least as many splits as the cluster has cores is left where it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def dealt(df: DataFrame, per_core: int = 2) -> DataFrame:
    """Deal a narrow table out evenly, for work that makes much more of each row than moves.

    However its files are cut: a small table is one split, and of the splits of
    one file only those that hold a row group's middle have rows.
    """
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism * per_core)
