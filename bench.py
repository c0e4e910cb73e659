"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local cores.
Every query runs over its whole tables and is written to Spark's no-op sink;
each is run twice and the second run counts, so that class loading and code
generation do not.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from evalsweep.operators.grid import cell_samples  # noqa: E402
from evalsweep.operators.score import reference_forms, score_rows  # noqa: E402
from evalsweep.plans import views  # noqa: E402
from evalsweep.plans.queries import QUERIES  # noqa: E402

HEADLINE = (
    "build_prompt",
    "cell_samples",
    "normalize_text",
    "score_samples",
    "score_documents",
    "parse_judge_reply",
    "align_outputs",
    "cell_accuracy",
    "cell_results",
    "sweep_summary",
    "cell_telemetry",
    "attribute_telemetry",
    "grid_cells",
    "check_allowed",
    "nest_cells",
    "checkpoint_cells",
    "export_predictions",
    "telemetry_rollup_stream",
    "batch_infer",
)


def score_documents_all_cells(spark, sf_dir):
    """Whole documents scored in all sixteen cells."""
    forms = reference_forms(views.qa_open(spark, sf_dir))
    rows = cell_samples(forms, views.grid(spark).select("cell_idx"))
    form = ((F.col("sample_idx") + F.col("cell_idx")) % 8).cast("int")
    scored = score_rows(rows.withColumn("prediction", views.open_answer(form)), judge="heuristic")
    return scored.groupBy("cell_idx").agg(
        F.count_if("exact_match").alias("n_exact"),
        F.count_if("normalized_match").alias("n_normalized"),
        F.avg("judge_score").alias("judge_avg_score"),
    )


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("evalsweep-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        # The tables are small: keep all cores busy after a shuffle.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    runs = {name: QUERIES[name] for name in HEADLINE}
    runs["score_documents_all_cells"] = score_documents_all_cells
    times = {}
    for name, run in runs.items():
        for _ in range(2):
            started = time.perf_counter()
            run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - started, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
