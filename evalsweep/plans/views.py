"""Input views of the registered queries, derived from the given tables.

The views stand for what a deployment has in store: question sets, the answers
of sixteen sweep cells, judge replies, hardware readings, attempt logs and sweep
specs.  ``plans/sql_views.py`` states the same views in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalsweep.operators.grid import cell_samples, grid_cells
from evalsweep.operators.prompts import build_samples
from evalsweep.operators.score import score_samples
from evalsweep.operators.sizing import dealt, spread

EXPERIMENT = "Tier One"
RUN_TS = "20240131T120000Z"

# Texts of the eleven answer forms that multiple-choice predictions take.
ANSWER_FORMS = (
    "A",
    " b ",
    "C. third option",
    "D",
    "E",
    "The answer is C.",
    "Option A is right",
    "",
    "42",
    "f) no hit",
    "...",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(index: Column, *values: Column) -> Column:
    """The value at a position; only that value is computed."""
    chain = F.when(index == 0, values[0])
    for position, value in enumerate(values[1:-1], start=1):
        chain = chain.when(index == position, value)
    return chain.otherwise(values[-1])


def grid(spark: SparkSession) -> DataFrame:
    """Sixteen cells: 2 models x 2 quantizations x 2 cache presets x 2 limits."""
    spec = spark.range(0, 1, 1, 1).select(
        F.lit(EXPERIMENT).alias("experiment"),
        F.expr(
            "array(named_struct('id', 'model-a', 'backend', 'vllm'),"
            " named_struct('id', 'model-b', 'backend', 'api'))"
        ).alias("models"),
        F.expr("array(cast(null as string), 'int4')").alias("quantization"),
        F.expr(
            "array(named_struct('name', 'baseline', 'kv_cache', false, 'prefix_cache', false),"
            " named_struct('name', 'kv_only', 'kv_cache', true, 'prefix_cache', false))"
        ).alias("cache_config"),
        F.expr("array(128, 256)").alias("max_new_tokens"),
    )
    return grid_cells(spec)


def qa_mc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One multiple-choice question per part."""
    key = F.col("p_partkey")
    return dealt(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")).select(
        key.alias("sample_idx"),
        F.concat(F.lit("  "), F.col("p_name"), F.lit(" [[placeholder]]? ")).alias("question"),
        F.array(
            F.col("p_brand"),
            F.col("p_type"),
            F.col("p_name"),
            F.col("p_size").cast("string"),
            F.lit("none of these"),
        ).alias("choices"),
        F.substring(F.lit("ABCDE"), (key % 5).cast("int") + 1, F.lit(1)).alias("answer"),
    )


def samples_mc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_samples(qa_mc(spark, sf_dir), "sample_idx")


def predictions_mc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of all cells to all parts; cells 3, 6, 11 and 14 have failures."""
    parts = dealt(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("sample_idx")))
    rows = cell_samples(parts, grid(spark).select("cell_idx"))
    sample, cell = F.col("sample_idx"), F.col("cell_idx")
    form = ((sample * 7 + cell * 3) % 11).cast("int")
    oom = (cell % 8 == 3) & (sample % 97 == 5)
    bad = (cell % 8 == 6) & (sample % 89 == 7)
    return rows.select(
        "cell_idx",
        "sample_idx",
        pick(form, *[F.lit(text) for text in ANSWER_FORMS]).alias("prediction"),
        F.when(sample % 4 == 0, F.lit(None)).otherwise(F.lit(0.12)).cast("double").alias("ttft_s"),
        (((sample + cell) % 50).cast("double") / 20.0).alias("total_s"),
        ((sample * 3 + cell) % 57).cast("int").alias("n_tokens"),
        F.when(oom & (cell > 8), F.lit("AcceleratorError"))
        .when(oom, F.lit("RuntimeError"))
        .when(bad, F.lit("ValueError"))
        .alias("error_type"),
        F.when(oom, F.lit(True)).when(bad, F.lit(False)).alias("error_is_runtime"),
        F.when(oom, F.concat(F.lit("GPU Out Of Memory at "), sample.cast("string")))
        .when(bad, F.lit("out of memory, but wrong type"))
        .alias("error"),
    )


def predictions_faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with strangers, gaps and repeats: what pairing has to find."""
    rows = predictions_mc(spark, sf_dir)
    sample, cell = F.col("sample_idx"), F.col("cell_idx")
    given = rows.filter(~((cell == 2) & (sample % 10 == 0)))
    strangers = rows.filter((cell == 5) & (sample % 7 == 0)).withColumn("sample_idx", -sample)
    repeats = rows.filter((cell == 9) & (sample % 5 == 0))
    unknown = rows.filter((cell == 1) & (sample % 100 == 0)).withColumn("cell_idx", F.lit(99))
    return given.unionByName(strangers).unionByName(repeats).unionByName(unknown)


def scores_faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores in which cell 14 failed on every sample and failing rows of cell 3 are stored twice."""
    rows = scores_mc(spark, sf_dir)
    broken = F.col("cell_idx") == 14
    rows = rows.withColumns(
        {
            "error_type": F.when(broken, F.lit("OSError")).otherwise(F.col("error_type")),
            "error": F.when(broken, F.lit("no such model")).otherwise(F.col("error")),
            "error_is_runtime": F.when(broken, F.lit(False)).otherwise(F.col("error_is_runtime")),
        }
    )
    twice = rows.filter((F.col("cell_idx") == 3) & F.col("error_type").isNotNull())
    return rows.unionByName(twice)


def scores_mc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_samples(samples_mc(spark, sf_dir), predictions_mc(spark, sf_dir), judge="heuristic")


def qa_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as reference answers to open questions."""
    doc = F.col("doc_id")
    return spread(table(spark, sf_dir, "documents")).select(
        doc.alias("sample_idx"),
        F.concat(F.lit("Summarise document "), doc.cast("string")).alias("prompt"),
        F.col("text").alias("reference"),
        "lang",
        "source",
    )


def open_answer(form: Column) -> Column:
    """Eight ways to answer an open question, from whole texts."""
    text = F.col("reference")
    return pick(
        form,
        text,
        F.concat(F.lit("  "), text, F.lit("!! ")),
        F.concat(F.lit("The "), F.lower(text)),
        F.concat(F.lit("Note: "), text),
        F.col("lang"),
        F.lit(""),
        F.concat_ws(" ", "source", "lang"),
        F.concat(F.lit("<answer> "), text, F.lit(" </response> tail")),
    )


def answers_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One answer per document."""
    form = (F.col("sample_idx") % 8).cast("int")
    return qa_open(spark, sf_dir).withColumn("prediction", open_answer(form))


def all_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents, conversations and the benchmark, whole."""
    documents = spread(table(spark, sf_dir, "documents")).select(
        F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), "text"
    )
    turns = table(spark, sf_dir, "conversations").select(
        F.lit("conversations").alias("origin"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        "text",
    )
    items = table(spark, sf_dir, "benchmark").select(
        F.lit("benchmark").alias("origin"), F.col("item_id").alias("id"), "text"
    )
    return documents.unionByName(turns).unionByName(items)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records whose keys vary; every tenth has no question key."""
    text, lang = F.col("text"), F.col("lang")

    def record(*pairs: Column) -> Column:
        return F.create_map(*pairs)

    nothing = F.lit(None).cast("string")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        pick(
            (F.col("doc_id") % 10).cast("int"),
            record(F.lit("other"), text),
            record(F.lit("question"), text, F.lit("answer"), lang),
            record(F.lit("text"), text, F.lit("label"), F.concat(F.lit(" \t"), lang, F.lit("\n"))),
            record(F.lit("prompt"), text, F.lit("input"), lang),
            record(F.lit("question"), nothing, F.lit("text"), text, F.lit("answer"), nothing),
            record(F.lit("text"), text, F.lit("target"), lang, F.lit("output"), text),
            record(F.lit("input"), text, F.lit("answer"), F.lit("  ")),
            record(F.lit("prompt"), text, F.lit("label"), lang, F.lit("answer"), text),
            record(F.lit("text"), text),
            record(F.lit("question"), lang, F.lit("text"), text, F.lit("label"), lang),
        ).alias("record"),
    )


def qa_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn, answered or not."""
    turns = table(spark, sf_dir, "conversations")
    return turns.filter(F.col("role") == "user").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("sample_idx"), F.col("text").alias("prompt")
    )


# Judge replies in ten forms; %d is a digit that varies by row.
REPLY_FORMS = (
    '{"score": 0.%d, "label": "partial"}',
    'Sure! {"score": 1, "label": "correct"} done',
    '{"score": 3}',
    '{"score": -1, "label": "incorrect"}',
    "no json here",
    '{"label": "correct"}',
    '{"score": null}',
    '{"score": "0.7"}',
    '{"score": "high", "label": "correct"}',
    '{"score":\n0.25}',
)


def judge_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    event = F.col("event_id")
    digit = F.floor(event % 100 / 10).cast("int").cast("string")
    head, tail = REPLY_FORMS[0].split("%d")
    forms = [F.concat(F.lit(head), digit, F.lit(tail)), *[F.lit(text) for text in REPLY_FORMS[1:]]]
    return spread(table(spark, sf_dir, "events")).select(
        event.alias("sample_idx"),
        (1 + event % 16).cast("int").alias("cell_idx"),
        pick((event % 10).cast("int"), *forms).alias("reply"),
    )


def readings_of(events: DataFrame) -> DataFrame:
    """Events as raw hardware readings; works on a table and on a stream."""
    event, value = F.col("event_id"), F.col("value")
    mib = F.floor(value * 1048576).cast("bigint")
    return events.select(
        "event_id",
        "ts",
        (1 + F.col("user_id") % 16).cast("int").alias("cell_idx"),
        mib.alias("vram_used_bytes"),
        F.lit(85899345920).cast("bigint").alias("vram_total_bytes"),
        F.when(event % 13 != 0, F.floor(value * 1000).cast("bigint")).alias("power_mw"),
        (event % 101).cast("double").alias("gpu_util_pct"),
        F.when(event % 17 != 0, (event % 97).cast("double")).alias("cpu_util_pct"),
        (mib * 2).alias("ram_used_bytes"),
        (F.col("event_type") != "error").alias("gpu_ok"),
    )


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings_of(table(spark, sf_dir, "events"))


def cell_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day-long window per day with events and an hour-long one per hour."""
    ts = table(spark, sf_dir, "events").select("ts")
    days = ts.select(F.date_trunc("day", "ts").alias("start_ts")).distinct()
    hours = ts.select(F.date_trunc("hour", "ts").alias("start_ts")).distinct()
    day = F.dayofmonth("start_ts")
    return days.select(
        day.alias("window_idx"),
        "start_ts",
        (F.col("start_ts") + F.expr("INTERVAL '1' DAY")).alias("end_ts"),
    ).unionByName(
        hours.select(
            (day * 100 + F.hour("start_ts")).alias("window_idx"),
            "start_ts",
            (F.col("start_ts") + F.expr("INTERVAL '1' HOUR")).alias("end_ts"),
        )
    )


def host_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of cells that run side by side on four hosts: a day-long one per host and day."""
    events = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 4).alias("host"), F.date_trunc("day", "ts").alias("start_ts")
    )
    return events.distinct().select(
        "host",
        (F.dayofmonth("start_ts") * 10 + F.col("host")).cast("int").alias("window_idx"),
        "start_ts",
        (F.col("start_ts") + F.expr("INTERVAL '36' HOUR")).alias("end_ts"),
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        order.alias("attempt_id"),
        F.when(F.col("o_orderstatus") == "P", F.lit(None).cast("int"))
        .when(F.col("o_orderstatus") == "O", F.lit(0))
        .otherwise((F.col("o_custkey") % 3).cast("int"))
        .alias("exit_code"),
        F.when(order % 3 != 0, F.col("o_orderpriority")).alias("payload"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as finished sweep runs: one experiment per priority, one run a day."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("experiment"),
        F.date_format("o_orderdate", "yyyyMMdd").alias("run_ts"),
        (F.col("o_orderstatus") == "F").alias("finished"),
    )


def spec_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sweep spec per customer, with every way to state an axis."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("spec_id"),
        pick(
            (key % 3).cast("int"),
            F.expr("array(named_struct('id', c_mktsegment, 'backend', 'vllm'))"),
            F.expr(
                "array(named_struct('id', c_mktsegment, 'backend', cast(null as string)),"
                " named_struct('id', c_name, 'backend', 'api'))"
            ),
            F.expr(
                "array(named_struct('id', 'model-a', 'backend', 'hf'),"
                " named_struct('id', 'model-b', 'backend', 'mock'),"
                " named_struct('id', c_name, 'backend', 'api'))"
            ),
        ).alias("models"),
        pick(
            (key % 5).cast("int"),
            F.expr("cast(null as array<string>)"),
            F.expr("array(cast(null as string))"),
            F.expr("array(cast(null as string), 'int4')"),
            F.expr("cast(array() as array<string>)"),
            F.expr("array('int8', 'int4')"),
        ).alias("quantization"),
        pick(
            (key % 4).cast("int"),
            F.expr("cast(array() as array<struct<name:string,kv_cache:boolean,prefix_cache:boolean>>)"),
            F.expr(
                "array(named_struct('name', 'baseline', 'kv_cache', false, 'prefix_cache', false),"
                " named_struct('name', 'kv_only', 'kv_cache', true, 'prefix_cache', false))"
            ),
            F.expr("cast(null as array<struct<name:string,kv_cache:boolean,prefix_cache:boolean>>)"),
            F.expr("array(named_struct('name', 'both', 'kv_cache', true, 'prefix_cache', true))"),
        ).alias("cache_config"),
        F.when(key % 6 < 4, F.expr("array(true, false)")).alias("kv_cache"),
        pick(
            (key % 7).cast("int"),
            F.expr("cast(null as array<boolean>)"),
            F.expr("cast(array() as array<boolean>)"),
            F.expr("array(false, true)"),
        ).alias("prefix_cache"),
        pick(
            (key % 11).cast("int"),
            F.expr("cast(null as array<int>)"),
            F.expr("array(128)"),
            F.expr("array(128, 256)"),
        ).alias("max_new_tokens"),
    )


def spec_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat sweep settings gathered from many teams, some of them wrong."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("spec_id"),
        pick(
            (key % 6).cast("int"),
            *[F.lit(name) for name in ("hf", "vllm", "api", "mock", "other")],
            F.lit(None).cast("string"),
        ).alias("backend"),
        F.when(key % 4 != 0, F.col("c_mktsegment")).alias("api_config"),
        F.when(key % 10 != 9, pick((key % 3).cast("int"), F.lit("mock"), F.lit("api"), F.lit("human"))).alias(
            "judge_provider"
        ),
        F.when(key % 5 == 0, F.col("c_name")).alias("judge_api_config"),
        pick(
            (key % 8).cast("int"),
            *[F.lit(name) for name in ("snappy", "gzip", "brotli", "zstd", "none", "lz4")],
            F.lit(None).cast("string"),
        ).alias("compress"),
        F.when(key % 9 != 0, F.col("c_nationkey") - 2).cast("int").alias("max_samples"),
        (key % 40).cast("int").alias("monitor_interval_ms"),
        F.when(key % 12 != 0, F.col("c_acctbal") / 5000.0).alias("oom_probability"),
        (key % 14).cast("int").alias("base_latency_ms"),
        (key % 15).cast("int").alias("tokens_per_second"),
        F.when(key % 13 != 0, key % 7 == 0).alias("mock_enabled"),
    )


def spec_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings as key-value maps, some with misspelt or unsupported keys."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("spec_id"),
        F.map_concat(
            F.create_map(F.lit("id"), F.col("c_name"), F.lit("backend"), F.lit("hf")),
            F.when(key % 6 == 0, F.create_map(F.lit("execution"), F.lit("distributed"))).otherwise(
                F.expr("cast(map() as map<string,string>)")
            ),
            F.when(key % 10 == 0, F.create_map(F.lit("do_sample"), F.lit("false"))).otherwise(
                F.expr("cast(map() as map<string,string>)")
            ),
        ).alias("settings"),
    )
