"""Cells as jobs of their own: a time limit, an attempt log, and a commit record per cell.

Each cell of a wave is one Spark job under a tag of its own.  What it answers goes
to a new folder; only when the job has ended in time is a record appended that
names the folder.  Readers go by the records, so they never see part of a cell, a
crash costs the cells in flight, and finding what is stored costs the records,
not a listing of the data files.
"""

from __future__ import annotations

import datetime
import threading
import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import partial

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalsweep.functions.measures import CELL_TIMEOUT_SECONDS
from evalsweep.operators.attempts import attempt_outcome
from evalsweep.operators.infer import Factory, infer_cells
from evalsweep.sources.store import CELL_PARTITIONS

KEYS = list(CELL_PARTITIONS)
RECORD = (
    "experiment string, run_ts string, cell_idx int, attempt int, exit_code int, payload string, reason string, "
    "started timestamp, ended timestamp"
)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """All attempts, finished or not; none if nothing was run yet."""
    try:
        return spark.read.schema(RECORD).parquet(f"{path}/attempts/*")
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], RECORD)


def committed(log: DataFrame) -> DataFrame:
    """The folder of each cell's newest attempt that ended well: keys, ``attempt``, ``payload``."""
    good = log.filter((F.col("exit_code") == 0) & F.col("payload").isNotNull())
    return good.groupBy(*KEYS).agg(F.max("attempt").alias("attempt"), F.max_by("payload", "attempt").alias("payload"))


def cell_outcomes(log: DataFrame) -> DataFrame:
    """Status and error of each cell: its newest good attempt, or else the newest of all."""
    good = (F.coalesce(F.col("exit_code") == 0, F.lit(False)) & F.col("payload").isNotNull()).cast("int")
    columns = [name for name in log.columns if name not in KEYS]
    last = log.groupBy(*KEYS).agg(F.max_by(F.struct(*columns), F.struct(good, "attempt")).alias("last"))
    return attempt_outcome(last.select(*KEYS, "last.*"), reason="reason")


def read_committed(spark: SparkSession, path: str, schema: T.StructType | str, log: DataFrame | None = None) -> DataFrame:
    """Rows of all committed cells; the driver holds one folder name per cell."""
    folders = [row["payload"] for row in committed(read_log(spark, path) if log is None else log).select("payload").collect()]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def _record(spark: SparkSession, path: str, values: dict) -> None:
    """One small file in a folder of its own, which appears whole: writers at the same time do not meet."""
    row = tuple(values[field.name] for field in T.StructType.fromDDL(RECORD))
    spark.createDataFrame([row], RECORD).coalesce(1).write.parquet(f"{path}/attempts/{uuid.uuid4().hex}")


def run_attempts(
    samples: DataFrame,
    cells: DataFrame,
    factory: Factory,
    path: str,
    run_ts: str,
    limit_s: float = CELL_TIMEOUT_SECONDS,
    at_once: int = 4,
    options: Sequence[str] | None = None,
) -> DataFrame:
    """Ask the model for every cell that is not committed yet; returns the attempt log of this run.

    ``cells`` is a wave (all its rows come to the driver) with ``experiment`` and
    ``cell_idx``; ``samples`` holds ``sample_idx, prompt``.  At most ``at_once``
    cells run side by side, where waiting for cores counts.  A cell that takes longer than ``limit_s`` is
    cancelled by its tag and logged without an exit code, while the others go on;
    a job that fails is logged with exit code 1 and its message.  Neither leaves
    anything that a reader sees, and calling again tries them once more.
    """
    spark = samples.sparkSession
    context = spark.sparkContext
    cells = cells.withColumn("run_ts", F.lit(run_ts)).withColumn("experiment", F.col("experiment").cast("string"))
    log = read_log(spark, path).filter(F.col("run_ts") == run_ts)
    done = committed(log).select(*KEYS)
    tried = log.groupBy(*KEYS).agg(F.max("attempt").alias("_tried"))
    # Names that no column of the grid has, so that rows can be rebuilt from them.
    todo = cells.join(done, KEYS, "left_anti").join(tried, KEYS, "left").collect()

    def attempt(row: T.Row) -> None:
        tag, folder = f"cell-{uuid.uuid4().hex}", f"{path}/answers/{uuid.uuid4().hex}"
        late, started = threading.Event(), datetime.datetime.now(datetime.timezone.utc)

        def stop() -> None:
            late.set()
            context.cancelJobsWithTag(tag)

        one = spark.createDataFrame([tuple(row[name] for name in cells.columns)], cells.schema)
        values = {"exit_code": 0, "payload": folder, "reason": None}
        timer = threading.Timer(limit_s, stop)
        timer.daemon = True
        context.addJobTag(tag)
        timer.start()
        try:
            infer_cells(samples.select("sample_idx", "prompt"), one, factory, KEYS, options).write.parquet(folder)
        except Exception as exc:
            values = {"exit_code": 1, "payload": None, "reason": str(exc)[:2000]}
        finally:
            timer.cancel()
            context.removeJobTag(tag)
        if late.is_set():  # also when the job ended while it was being cancelled
            values = {"exit_code": None, "payload": None, "reason": None}
        ended = datetime.datetime.now(datetime.timezone.utc)
        key = {name: row[name] for name in KEYS}
        _record(spark, path, {**key, **values, "attempt": (row["_tried"] or 0) + 1, "started": started, "ended": ended})

    # Wrapped one by one: a wrapper owns one set of job tags, which cells must not share.
    jobs = [inheritable_thread_target(spark)(partial(attempt, row)) for row in todo]
    with ThreadPoolExecutor(at_once) as pool:
        # The first failure to write a record ends the call.
        list(pool.map(lambda job: job(), jobs))
    return read_log(spark, path).filter(F.col("run_ts") == run_ts)
