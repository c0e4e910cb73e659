"""Registered queries: one per operator, over the whole of the given tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalsweep.functions import judging, measures, text
from evalsweep.operators import (
    attempts,
    grid,
    infer,
    inspect,
    judge,
    prompts,
    rollup,
    rules,
    score,
    telemetry,
)
from evalsweep.plans import cell_jobs, sweep, views
from evalsweep.sources import store
from evalsweep.sources.workspace import work_folder
from evalsweep.streaming import telemetry_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, so that the order of additions does not show."""
    return df.select(
        *[
            F.round(F.col(name), 6).alias(name) if kind == "double" else F.col(name)
            for name, kind in df.dtypes
        ]
    )


# Sources and sinks -----------------------------------------------------------


@query
def scan_dataset(spark, sf_dir):
    return store.scan_dataset(spark, f"{sf_dir}/documents.parquet", split="en", split_col="lang")


@query
def head_sample(spark, sf_dir):
    return store.head_sample(views.table(spark, sf_dir, "documents"), 100, "doc_id")


def _results(spark, sf_dir) -> DataFrame:
    return rollup.cell_results(
        views.grid(spark),
        views.scores_mc(spark, sf_dir),
        views.telemetry(spark, sf_dir),
        keys=("cell_idx",),
        failures=views.predictions_mc(spark, sf_dir),
    ).select("experiment", *[c for c in store.RESULT_COLUMNS if c not in ("experiment", "run_ts")])


def _foreign(results: DataFrame) -> DataFrame:
    """Result rows as other writers leave them: types inferred from values."""
    return results.select(
        *[
            F.col(name).cast("double").alias(name) if name in ("n_samples", "hw_sample_count") else F.col(name)
            for name in results.columns
            if name != "avg_ram_used_mb"
        ]
    )


@query
def read_results(spark, sf_dir):
    path = f"{work_folder(spark, 'read-results')}/sweep_tier_one_{views.RUN_TS}.parquet"
    store.write_results(_foreign(rounded(_results(spark, sf_dir))), path)
    return store.read_results(spark, path).drop("run_ts", "avg_ram_used_mb")


@query
def latest_sweep(spark, sf_dir):
    folder = work_folder(spark, "latest-sweep")
    results = rounded(_results(spark, sf_dir))
    stored = work_folder(spark, "latest-sweep-results")
    store.write_results(results, stored)
    results = spark.read.parquet(stored)
    for name, model in (
        ("sweep_alpha_20240301T000000Z", "model-a"),
        ("sweep_beta_20240101T000000Z", "model-a"),
        ("sweep_beta_20240201T000000Z", "model-b"),
        # Neither a deeper folder nor another name is a sweep of this folder.
        ("tier1/sweep_zeta_20240501T000000Z", "model-a"),
        ("old_sweep_zeta_20240501T000000Z", "model-a"),
    ):
        store.write_results(
            _foreign(results.filter(F.col("model_id") == model)), f"{folder}/{name}.parquet"
        )
    return store.latest_sweep(spark, folder).drop("run_ts", "avg_ram_used_mb")


@query
def latest_runs(spark, sf_dir):
    newest = store.latest_runs(views.runs(spark, sf_dir))
    return newest.groupBy("experiment", "run_ts").agg(F.count(F.lit(1)).alias("n_rows"))


@query
def list_sweeps(spark, sf_dir):
    return store.list_sweeps(views.runs(spark, sf_dir))


@query
def list_sweep_files(spark, sf_dir):
    """Files of the newest run of each experiment, among files that are no sweeps of the folder."""
    folder = work_folder(spark, "sweep-files")
    newest = store.latest_runs(views.runs(spark, sf_dir))
    named = newest.withColumn("name", store.sweep_name(F.col("experiment"), F.col("run_ts")))
    for row in named.select("name").distinct().collect():  # one per experiment
        own = named.filter(F.col("name") == row["name"])
        for place in (row["name"], f"tier1/sweep_zz_{row['name']}", f"old_{row['name']}"):
            store.write_results(own, f"{folder}/{place}")
    return store.list_sweep_files(spark, folder)


@query
def write_results(spark, sf_dir):
    path = work_folder(spark, "write-results")
    store.write_results(views.predictions_mc(spark, sf_dir), path, codec="zstd")
    return spark.read.parquet(path)


@query
def checkpoint_cells(spark, sf_dir):
    """All cells stored, then the failed ones run again without failures."""
    path = work_folder(spark, "checkpoint-cells")
    first = views.predictions_mc(spark, sf_dir).select(
        F.lit(views.EXPERIMENT).alias("experiment"),
        F.lit(views.RUN_TS).alias("run_ts"),
        "cell_idx",
        "sample_idx",
        "prediction",
        "error_type",
    )
    store.write_cells(first, path)
    again = first.filter(F.col("cell_idx").isin(3, 6, 11, 14)).select(
        "experiment",
        "run_ts",
        "cell_idx",
        "sample_idx",
        F.concat(F.col("prediction"), F.lit(" (again)")).alias("prediction"),
        F.lit(None).cast("string").alias("error_type"),
    )
    store.write_cells(again, path)
    return store.read_cells(spark, path, first.schema)


@query
def export_metrics(spark, sf_dir):
    path = work_folder(spark, "export-metrics")
    results = rounded(_results(spark, sf_dir))
    columns = store.export_metrics(results, path)
    schema = ", ".join(f"{name} {results.schema[name].dataType.simpleString()}" for name in columns)
    return store.read_csv(spark, path, schema)


def _exported(spark, sf_dir) -> str:
    path = work_folder(spark, "export-predictions")
    stored = work_folder(spark, "export-scores")
    views.scores_mc(spark, sf_dir).write.parquet(stored)
    scores = spark.read.parquet(stored)
    summed = work_folder(spark, "export-results")
    rounded(rollup.cell_results(views.grid(spark), scores)).write.parquet(summed)
    store.export_predictions(spark.read.parquet(summed), scores, path)
    return path


@query
def export_predictions(spark, sf_dir):
    path = f"{_exported(spark, sf_dir)}/predictions"
    schema = "prompt string, reference string, prediction string, cell_pos int"
    # CSV keeps no difference between a missing and an empty text.
    return store.read_csv(spark, path, schema).na.fill("")


@query
def export_summary(spark, sf_dir):
    path = f"{_exported(spark, sf_dir)}/summary"
    schema = (
        "model string, backend string, exact_match_pct double, normalized_match_pct double, "
        "mean_tps double, mean_total_s double, cell_pos int"
    )
    return store.read_csv(spark, path, schema)


def _sample_rows(spark, sf_dir) -> DataFrame:
    return views.scores_mc(spark, sf_dir).select(
        "cell_idx", "sample_idx", "prompt", "reference", "prediction"
    )


@query
def nest_cells(spark, sf_dir):
    nested = store.nest_cells(_sample_rows(spark, sf_dir))
    return nested.select(
        "cell_idx",
        "chunk_idx",
        "part_idx",
        F.size("sample_ids").cast("bigint").alias("n_samples"),
        F.array_join(F.col("sample_ids").cast("array<string>"), ",").alias("sample_ids"),
        F.md5(F.array_join("prompts", "\n")).alias("prompts_md5"),
        F.array_join("references", ",").alias("references"),
        F.array_join("predictions", "|").alias("predictions"),
    )


@query
def unnest_cells(spark, sf_dir):
    return store.unnest_cells(store.nest_cells(_sample_rows(spark, sf_dir)))


# Projections, filters, predicates --------------------------------------------


@query
def resolve_question(spark, sf_dir):
    resolved = prompts.resolve_question(views.records(spark, sf_dir), record="record")
    return resolved.select("doc_id", "question")


@query
def resolve_answer(spark, sf_dir):
    resolved = prompts.resolve_answer(views.records(spark, sf_dir), record="record")
    return resolved.select("doc_id", "reference")


@query
def join_list_value(spark, sf_dir):
    lines = views.table(spark, sf_dir, "documents").select(
        "doc_id", F.split("text", "\n").alias("question")
    )
    return prompts.resolve_question(lines, name="joined").select("doc_id", "joined")


@query
def clean_question(spark, sf_dir):
    marked = F.concat(F.lit("\t [[placeholder]]"), F.replace("text", F.lit("e "), F.lit("e [[placeholder]]")))
    return views.table(spark, sf_dir, "documents").select(
        "doc_id", text.clean_question(marked).alias("question")
    )


def _choice_layouts(spark, sf_dir) -> DataFrame:
    """The same five options as a list, a map, a struct of lists and a struct of texts."""
    option = [F.col("choices")[i] for i in range(5)]
    last = F.when(F.col("sample_idx") % 7 != 0, option[4])
    return views.qa_mc(spark, sf_dir).select(
        "sample_idx",
        F.col("choices").alias("as_list"),
        F.create_map(F.lit("B"), option[1], F.lit("A"), option[0], F.lit("C"), last).alias("as_map"),
        F.struct(
            F.col("choices").alias("text"), F.array(*[F.lit(x) for x in "WXYZ"]).alias("label")
        ).alias("as_lists"),
        F.struct(F.col("choices").alias("text")).alias("as_texts"),
        F.struct(option[1].alias("B"), option[0].alias("A")).alias("as_struct"),
        F.transform(F.sequence(F.lit(0), F.lit(299)), lambda i: (F.col("sample_idx") + i).cast("string")).alias(
            "as_many"
        ),
    )


@query
def format_options(spark, sf_dir):
    layouts = _choice_layouts(spark, sf_dir)
    return layouts.select(
        "sample_idx",
        *[
            prompts.format_options(F.col(name), layouts.schema[name].dataType).alias(name)
            for name in layouts.columns
            if name != "sample_idx"
        ],
    )


@query
def first_choices(spark, sf_dir):
    key = F.col("sample_idx")
    none, empty = F.expr("cast(null as array<string>)"), F.expr("cast(array() as array<string>)")
    both = views.qa_mc(spark, sf_dir).select(
        "sample_idx",
        views.pick((key % 3).cast("int"), none, empty, F.col("choices")).alias("alternatives"),
        views.pick((key % 4).cast("int"), none, empty, F.reverse("choices")).alias("choices"),
    )
    chosen = both.withColumn("chosen", prompts.first_choices(both))
    return chosen.select("sample_idx", F.array_join("chosen", "|").alias("chosen"))


@query
def build_prompt(spark, sf_dir):
    """Multiple-choice prompts of the parts and essay prompts of the records."""
    choice = views.samples_mc(spark, sf_dir).withColumn("origin", F.lit("part"))
    essay = prompts.build_samples(views.records(spark, sf_dir), "doc_id", record="record")
    return choice.unionByName(essay.withColumn("origin", F.lit("documents")))


@query
def drop_keyless(spark, sf_dir):
    return prompts.drop_keyless(views.records(spark, sf_dir), "record").select("doc_id")


@query
def count_keyless(spark, sf_dir):
    return prompts.count_keyless(views.records(spark, sf_dir), "record")


def _mixed_prompts(spark, sf_dir) -> DataFrame:
    """Multiple-choice prompts, essay prompts, and essays that name the marker."""
    choice = views.samples_mc(spark, sf_dir).select(
        F.lit("part").alias("origin"), "sample_idx", "prompt"
    )
    body = F.when(F.col("id") % 5 == 0, F.concat("text", F.lit(" Options: none"))).otherwise(F.col("text"))
    essay = views.all_texts(spark, sf_dir).select(
        "origin", F.col("id").alias("sample_idx"), prompts.build_prompt(body).alias("prompt")
    )
    return choice.unionByName(essay)


@query
def is_multiple_choice(spark, sf_dir):
    return _mixed_prompts(spark, sf_dir).select(
        "origin", "sample_idx", measures.is_multiple_choice(F.col("prompt")).alias("is_mc")
    )


@query
def token_budget(spark, sf_dir):
    limit = F.when(F.col("sample_idx") % 3 != 0, (F.col("sample_idx") % 512 + 1).cast("int"))
    is_mc = measures.is_multiple_choice(F.col("prompt"))
    return _mixed_prompts(spark, sf_dir).select(
        "origin", "sample_idx", measures.token_budget(is_mc, limit).alias("budget")
    )


@query
def chat_messages(spark, sf_dir):
    chats = views.qa_chat(spark, sf_dir).withColumn("messages", prompts.chat_messages(F.col("prompt")))
    return chats.select(
        "sample_idx",
        F.size("messages").cast("bigint").alias("n_messages"),
        F.col("messages")[0]["role"].alias("role"),
        F.col("messages")[0]["content"].alias("content"),
    )


@query
def answer_tag(spark, sf_dir):
    body = F.col("prediction")
    tagged = views.pick(
        (F.col("sample_idx") % 3).cast("int"),
        body,
        F.concat(F.lit("thinking <response>\n"), body, F.lit("\n</answer> <answer>late</answer>")),
        F.concat(F.lit("<answer>never closed "), body),
    )
    return views.answers_open(spark, sf_dir).select("sample_idx", text.answer_tag(tagged).alias("body"))


@query
def clean_response(spark, sf_dir):
    reply = F.when(F.col("id") % 6 != 0, F.concat(F.lit(" \t "), "text", F.lit("　\n")))
    return views.all_texts(spark, sf_dir).select("origin", "id", text.clean_response(reply).alias("reply"))


@query
def token_count(spark, sf_dir):
    reported = F.when(F.col("id") % 3 != 0, (F.col("id") % 4).cast("int"))
    return views.all_texts(spark, sf_dir).select(
        "origin", "id", text.token_count(F.col("text"), reported).cast("bigint").alias("n_tokens")
    )


@query
def throughput(spark, sf_dir):
    rate = measures.throughput(F.col("n_tokens"), F.col("total_s"))
    return rounded(views.predictions_mc(spark, sf_dir).select("cell_idx", "sample_idx", rate.alias("tps")))


@query
def classify_failure(spark, sf_dir):
    failed = measures.failure_status(F.col("error_type"), F.col("error"), F.col("error_is_runtime"))
    status = F.coalesce(failed, F.lit("ok"))
    return views.predictions_mc(spark, sf_dir).select(
        "cell_idx", "sample_idx", status.alias("status"), "error"
    )


@query
def attempt_outcome(spark, sf_dir):
    return attempts.attempt_outcome(views.attempts(spark, sf_dir))


@query
def ok_cells(spark, sf_dir):
    return rounded(rollup.ok_cells(_results(spark, sf_dir)))


# Grid ------------------------------------------------------------------------


@query
def permutations(spark, sf_dir):
    return grid.permutations(views.spec_axes(spark, sf_dir), keys=("spec_id",))


@query
def grid_cells(spark, sf_dir):
    return grid.grid_cells(views.spec_axes(spark, sf_dir), keys=("spec_id",))


@query
def grid_size(spark, sf_dir):
    return grid.grid_size(views.spec_axes(spark, sf_dir), keys=("spec_id",))


@query
def cell_samples(spark, sf_dir):
    return grid.cell_samples(
        views.samples_mc(spark, sf_dir), views.grid(spark).select("cell_idx", "model_id", "max_new_tokens")
    )


@query
def align_outputs(spark, sf_dir):
    aligned = score.align_outputs(
        views.samples_mc(spark, sf_dir), views.predictions_mc(spark, sf_dir), views.grid(spark)
    )
    return aligned.select("cell_idx", "sample_idx", "prompt", "reference", "prediction")


@query
def alignment_report(spark, sf_dir):
    """Counts after every failed prediction is taken away."""
    given = views.predictions_mc(spark, sf_dir).filter(F.col("error_type").isNull())
    return score.alignment_report(views.samples_mc(spark, sf_dir), given, views.grid(spark))


@query
def alignment_faults(spark, sf_dir):
    """The report over strangers, gaps, repeats and an unknown cell."""
    return score.alignment_report(
        views.samples_mc(spark, sf_dir), views.predictions_faulty(spark, sf_dir), views.grid(spark)
    )


@query
def attribute_telemetry_hosts(spark, sf_dir):
    """Windows that overlap on every host: readings get those of their own host only."""
    readings = views.table(spark, sf_dir, "events").select("event_id", "ts", (F.col("user_id") % 4).alias("host"))
    windows = views.host_windows(spark, sf_dir)
    return telemetry.attribute_telemetry(readings, windows, on=("host",)).select("event_id", "window_idx")


@query
def attribute_telemetry(spark, sf_dir):
    return telemetry.attribute_telemetry(
        views.table(spark, sf_dir, "events").select("event_id", "ts"), views.cell_windows(spark, sf_dir)
    ).select("event_id", "window_idx")


# Data-quality rules ------------------------------------------------------------


@query
def check_unknown_columns(spark, sf_dir):
    return rules.violations(
        views.spec_settings(spark, sf_dir),
        "spec_id",
        [rules.known_keys("settings", ("id", "backend", "description", "max_seq_length"))],
    )


@query
def check_unknown_fields(spark, sf_dir):
    """Misspelt settings three levels down, in lists and structs, and in how many rows."""
    name, balance = F.col("c_name"), F.col("c_acctbal")
    rich = F.when(balance > 0, balance)
    specs = views.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("spec_id"),
        F.struct(
            name.alias("id"),
            F.array(F.struct(name.alias("backend"), rich.alias("bakend"))).alias("models"),
            F.struct(F.struct(rich.alias("tempreature"), balance.alias("top_p")).alias("sampling")).alias("generation"),
        ).alias("spec"),
        F.col("c_mktsegment").alias("contact"),
    )
    sampling = {"temperature": None, "top_p": None}
    allowed = {
        "spec_id": None,
        "spec": {"id": None, "models": {"backend": None}, "generation": {"sampling": sampling}},
    }
    return rules.count_unknown_fields(specs, allowed)


@query
def check_allowed(spark, sf_dir):
    return rules.violations(
        views.spec_rows(spark, sf_dir),
        "spec_id",
        [
            rules.allowed_values("backend", rules.BACKENDS),
            rules.allowed_values("compress", rules.CODECS),
            rules.allowed_values("judge_provider", rules.JUDGE_PROVIDERS),
        ],
    )


@query
def check_ranges(spark, sf_dir):
    return rules.violations(
        views.spec_rows(spark, sf_dir),
        "spec_id",
        [
            rules.in_range("max_samples", exclusive_minimum=0),
            rules.in_range("monitor_interval_ms", minimum=10),
            rules.in_range("oom_probability", minimum=0.0, maximum=1.0),
            rules.in_range("base_latency_ms", exclusive_minimum=0),
            rules.in_range("tokens_per_second", exclusive_minimum=0),
        ],
    )


@query
def check_required_if(spark, sf_dir):
    return rules.violations(
        views.spec_rows(spark, sf_dir),
        "spec_id",
        [
            rules.required_if("backend", "api", "api_config"),
            rules.required_if("judge_provider", "api", "judge_api_config"),
        ],
    )


@query
def admit_specs(spark, sf_dir):
    """Specs let in or put aside in one pass over them, with the number of rules that each breaks."""
    every = [
        rules.allowed_values("backend", rules.BACKENDS),
        rules.allowed_values("compress", rules.CODECS),
        rules.in_range("max_samples", exclusive_minimum=0),
        rules.in_range("oom_probability", minimum=0.0, maximum=1.0),
        rules.required_if("backend", "api", "api_config"),
        rules.required_if("judge_provider", "api", "judge_api_config"),
    ]
    found = rules.admit(views.spec_rows(spark, sf_dir), every, work_folder(spark, "admitted"))
    good = found.good.select("spec_id", F.lit(True).alias("admitted"), F.lit(0).cast("bigint").alias("n_broken"))
    n_broken = F.size("broken").cast("bigint").alias("n_broken")
    return good.unionByName(found.rejected.select("spec_id", F.lit(False).alias("admitted"), n_broken))


@query
def fill_defaults(spark, sf_dir):
    return rounded(rules.fill_defaults(views.spec_rows(spark, sf_dir)))


# Text and scoring ----------------------------------------------------------------


def _per_text(spark, sf_dir, value: Column, name: str) -> DataFrame:
    return views.all_texts(spark, sf_dir).select("origin", "id", value.alias(name))


@query
def strip(spark, sf_dir):
    padded = F.concat(F.lit(" \t \x1f"), "text", F.lit(" \n　 "))
    return _per_text(spark, sf_dir, text.strip(padded), "stripped")


@query
def normalize_text(spark, sf_dir):
    return _per_text(spark, sf_dir, text.normalize_text(F.col("text")), "normalized")


@query
def extract_choice(spark, sf_dir):
    return _per_text(spark, sf_dir, text.extract_choice(F.col("text")), "choice")


@query
def reduce_mc_prediction(spark, sf_dir):
    """Every text read as an answer, to a multiple-choice and to an essay prompt."""
    answer = F.col("text")
    return views.all_texts(spark, sf_dir).select(
        "origin",
        "id",
        score.reduce_mc_prediction(answer, F.lit(True)).alias("as_choice"),
        score.reduce_mc_prediction(answer, F.lit(False)).alias("as_essay"),
    )


@query
def exact_match(spark, sf_dir):
    return views.scores_mc(spark, sf_dir).select("cell_idx", "sample_idx", "processed", "exact_match")


@query
def normalized_match(spark, sf_dir):
    return views.scores_mc(spark, sf_dir).select("cell_idx", "sample_idx", "normalized_match")


@query
def heuristic_judge(spark, sf_dir):
    """Whole documents as references, in all their answer forms."""
    return _scores_open(spark, sf_dir).select("sample_idx", "judge_score", "judge_label")


@query
def judge_prompt(spark, sf_dir):
    answers = views.answers_open(spark, sf_dir)
    return answers.select(
        "sample_idx",
        judging.judge_prompt(F.col("prompt"), F.col("reference"), F.col("prediction")).alias("judge_prompt"),
    )


@query
def parse_judge_reply(spark, sf_dir):
    parsed = judge.parse_judge_replies(views.judge_replies(spark, sf_dir))
    return rounded(parsed.select("sample_idx", "verdict.*"))


def _scores_open(spark, sf_dir) -> DataFrame:
    answers = views.answers_open(spark, sf_dir)
    return score.score_rows(score.reference_forms(answers), judge="heuristic")


@query
def score_samples(spark, sf_dir):
    return views.scores_mc(spark, sf_dir).select(
        "cell_idx",
        "sample_idx",
        "reference",
        "prediction",
        "processed",
        "exact_match",
        "normalized_match",
        "judge_score",
        "judge_label",
    )


@query
def score_documents(spark, sf_dir):
    return _scores_open(spark, sf_dir).select(
        "sample_idx", "processed", "exact_match", "normalized_match", "judge_score", "judge_label"
    )


# Inference -----------------------------------------------------------------------


def _length_model(model_id: str, options: dict):
    """Stand-in model: the letter depends on prompt, backend and temperature, and some prompts fail."""
    shift = (1 if options["backend"] == "api" else 0) + (2 if options["temperature"] > 0 else 0)

    def answer(prompt: str, budget: int) -> dict:
        if len(prompt) % 97 == 13:
            raise RuntimeError(f"out of memory at {len(prompt)}")
        letter = "ABCDE"[(len(prompt) + shift) % 5]
        return {"text": f" {letter}. ", "ttft_s": 0.25, "total_s": 0.5, "n_tokens": budget}

    return lambda asked, budgets: [answer(p, b) for p, b in zip(asked, budgets)]


@query
def batch_infer(spark, sf_dir):
    choice = views.samples_mc(spark, sf_dir).select("sample_idx", "prompt")
    essays = views.table(spark, sf_dir, "documents").select(
        (-F.col("doc_id") - 1).alias("sample_idx"), prompts.build_prompt(F.col("text")).alias("prompt")
    )
    warm = F.when(F.col("cell_idx") % 2 == 0, 0.7).otherwise(0.0)
    cells = views.grid(spark).drop("experiment").withColumn("temperature", warm)
    stored = work_folder(spark, "prompts")
    choice.unionByName(essays).write.parquet(stored)  # built once, not once per cell
    return infer.infer_cells(spark.read.parquet(stored), cells, _length_model)


def _crashing_model(model_id: str, options: dict):
    """The stand-in model, whose worker dies on one of the quantizations."""

    def engine(asked: list[str], budgets: list[int]) -> list:
        if options["quantization"] == "int8" and options["kv_cache"] and model_id.endswith("b"):
            os._exit(3)
        return [f"{len(prompt)}" for prompt in asked]

    return engine


@query
def run_attempts(spark, sf_dir):
    """Every cell of the grid as a job of its own; those whose worker dies are logged, the others committed."""
    folder = work_folder(spark, "attempts")
    samples = views.samples_mc(spark, sf_dir).select("sample_idx", "prompt")
    stored = f"{folder}/samples"
    samples.write.parquet(stored)
    cells = views.grid(spark).withColumn("experiment", F.lit("e"))
    log = cell_jobs.run_attempts(spark.read.parquet(stored), cells, _crashing_model, folder, "20240131T000000Z")
    schema = "experiment string, run_ts string, cell_idx int, sample_idx bigint, prediction string"
    answers = cell_jobs.read_committed(spark, folder, schema, log)
    counted = answers.groupBy("cell_idx").agg(F.count("*").alias("n_samples"), F.sum(F.col("prediction").cast("bigint")).alias("n_chars"))
    outcome = cell_jobs.cell_outcomes(log).select("cell_idx", "attempt", "exit_code", "status", "error")
    return outcome.join(counted, "cell_idx", "left")


def _sweep_model(model_id: str, options: dict):
    """Stand-in model: model-a gives letters; model-b explains, and fails when quantized."""

    def answer(prompt: str) -> dict:
        letter = "ABCDE"[len(prompt) % 5]
        if model_id == "model-a":
            return {"text": f"{letter}.", "ttft_s": 0.125, "total_s": 0.5, "n_tokens": 2}
        if options["quantization"] is not None and len(prompt) % 17 == 3:
            raise RuntimeError(f"out of memory at {len(prompt)}")
        return {"text": f"Option ({letter})", "total_s": 0.25, "n_tokens": 3}

    return lambda asked, budgets: [answer(prompt) for prompt in asked]


@query
def run_sweep(spark, sf_dir):
    """All sixteen cells from prompts to stored results, in two waves, under names that look like numbers."""
    results = sweep.run_sweep(
        views.samples_mc(spark, sf_dir),
        views.grid(spark).withColumn("experiment", F.lit("007")),
        _sweep_model,
        work_folder(spark, "run-sweep"),
        "20240131",
        judge="heuristic",
        cells_per_wave=8,
    )
    return rounded(results)


def _tagging_model(model_id: str, options: dict):
    """Stand-in reasoning model: the answers of the other one, in a tag."""
    engine = _sweep_model(model_id, options)

    def tagged(asked: list[str], budgets: list[int]) -> list[dict]:
        return [{**a, "text": f"Let me see <answer> {a['text']} </answer>"} for a in engine(asked, budgets)]

    return tagged


def _grading_model(model_id: str, options: dict):
    """Stand-in judge: the score depends on the length of what it is asked; some replies are no JSON."""

    def reply(prompt: str) -> str:
        if len(prompt) % 11 == 0:
            return "I cannot say."
        return f'Grade: {{"score": {len(prompt) % 5 * 0.25}, "label": "partial"}}'

    return lambda asked, budgets: [reply(prompt) for prompt in asked]


@query
def run_sweep_judged(spark, sf_dir):
    """A sweep over a reasoning model whose answers a judge model grades."""
    results = sweep.run_sweep(
        views.samples_mc(spark, sf_dir),
        views.grid(spark),
        _tagging_model,
        work_folder(spark, "run-sweep-judged"),
        views.RUN_TS,
        judge=_grading_model,
        tagged=True,
    )
    return rounded(results)


# Roll-ups ------------------------------------------------------------------------


@query
def cell_accuracy(spark, sf_dir):
    return rounded(rollup.cell_accuracy(views.grid(spark), views.scores_mc(spark, sf_dir)))


@query
def cell_judge(spark, sf_dir):
    """Parsed judge replies rolled up per cell."""
    parsed = judge.parse_judge_replies(views.judge_replies(spark, sf_dir))
    return rounded(rollup.cell_judge(views.grid(spark), parsed.select("cell_idx", "verdict.judge_score")))


@query
def cell_perf(spark, sf_dir):
    return rounded(rollup.cell_perf(views.grid(spark), views.predictions_mc(spark, sf_dir)))


@query
def cell_telemetry(spark, sf_dir):
    return rounded(telemetry.cell_telemetry(views.grid(spark), views.telemetry(spark, sf_dir)))


@query
def cell_telemetry_cpu(spark, sf_dir):
    """Hosts without a GPU: no GPU readings and no word of one."""
    readings = views.telemetry(spark, sf_dir).select("cell_idx", "cpu_util_pct", "ram_used_bytes")
    return rounded(telemetry.cell_telemetry(views.grid(spark), readings))


@query
def cell_results(spark, sf_dir):
    return rounded(_results(spark, sf_dir))


@query
def cell_results_faulty(spark, sf_dir):
    """A subclass of a runtime error, failing rows stored twice, a cell in which all failed."""
    results = rollup.cell_results(views.grid(spark), views.scores_faulty(spark, sf_dir))
    return results.select("cell_idx", "status", "error", "n_samples")


@query
def sweep_summary(spark, sf_dir):
    return rounded(rollup.sweep_summary(_results(spark, sf_dir), by=("model_id",)))


@query
def summary_ttft(spark, sf_dir):
    return rounded(rollup.summary_ttft(_results(spark, sf_dir), by=("model_id",)))


@query
def sweep_progress(spark, sf_dir):
    progress = rollup.sweep_progress(_results(spark, sf_dir), by=("experiment",))
    return progress.withColumn("n_columns", F.col("n_columns").cast("bigint"))


# Telemetry -----------------------------------------------------------------------


@query
def telemetry_units(spark, sf_dir):
    return rounded(telemetry.telemetry_units(views.telemetry(spark, sf_dir)).drop("ts"))


@query
def telemetry_rollup_stream(spark, sf_dir):
    """The events in six files or more, taken two per micro-batch."""
    events = views.table(spark, sf_dir, "events")
    folder = work_folder(spark, "telemetry-rollup")
    events.repartition(max(6, events.rdd.getNumPartitions())).write.parquet(f"{folder}/events")
    arriving = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/events")
    running = telemetry_stream.telemetry_rollup_stream(
        views.readings_of(arriving), f"{folder}/out", f"{folder}/checkpoint"
    )
    running.awaitTermination()
    return rounded(telemetry_stream.read_rollup(spark, f"{folder}/out"))


@query
def telemetry_rollup_slices(spark, sf_dir):
    """The events in six stretches of time, one after the other; every fiftieth comes one stretch late."""
    events = views.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    folder = work_folder(spark, "telemetry-slices")
    first, last = events.agg(F.min(F.unix_seconds("ts")), F.max(F.unix_seconds("ts"))).first()
    step = max(1, -(-(last + 1 - first) // 6))
    due = F.floor((F.unix_seconds("ts") - first) / step) + (F.col("event_id") % 50 == 0).cast("int")
    for part in range(7):
        events.filter(due == part).coalesce(4).write.mode("append").parquet(f"{folder}/events")
    arriving = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 4).parquet(f"{folder}/events")
    width = f"{max(1, step // 4)} seconds"
    running = telemetry_stream.telemetry_slices_stream(
        views.readings_of(arriving), f"{folder}/out", f"{folder}/checkpoint", width=width, delay=f"{2 * step} seconds"
    )
    running.awaitTermination()
    return rounded(telemetry_stream.read_slices(spark, f"{folder}/out"))


def _in_stretches(df: DataFrame, ts: str, first: int, step: int, folder: str) -> None:
    """Write a table as files of six stretches of time, one after the other."""
    due = F.floor((F.unix_seconds(F.col(ts)) - first) / step)
    for part in range(7):
        df.filter(due == part).coalesce(2).write.mode("append").parquet(folder)


@query
def attribute_telemetry_stream(spark, sf_dir):
    """Readings and windows both arrive in stretches of time and are joined on the way."""
    events = views.table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    windows = views.cell_windows(spark, sf_dir)
    windows = windows.select("window_idx", *[F.col(c).cast("timestamp").alias(c) for c in ("start_ts", "end_ts")])
    folder = work_folder(spark, "attribution")
    low, high = windows.agg(F.min(F.unix_seconds("start_ts")), F.max(F.unix_seconds("end_ts"))).first()
    step = max(1, -(-(high + 1 - low) // 6))
    sides = []
    for name, df, ts in (("events", events, "ts"), ("windows", windows, "start_ts")):
        _in_stretches(df, ts, low, step, f"{folder}/{name}")
        reader = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2)
        sides.append(reader.parquet(f"{folder}/{name}"))
    running = telemetry_stream.attribute_telemetry_stream(
        *sides, f"{folder}/out", f"{folder}/checkpoint", longest_s=86_400, delay=f"{2 * step} seconds"
    )
    running.awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("event_id", "window_idx")


# Inspection ----------------------------------------------------------------------


@query
def cell_detail(spark, sf_dir):
    return rounded(inspect.cell_detail(_results(spark, sf_dir)))


@query
def show_predictions(spark, sf_dir):
    results = rollup.cell_results(
        views.grid(spark), views.scores_mc(spark, sf_dir), failures=views.predictions_mc(spark, sf_dir)
    )
    return inspect.show_predictions(results, _sample_rows(spark, sf_dir), cell_pos=4, n=20)
