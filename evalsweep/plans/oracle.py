"""DuckDB SQL for the registered queries, used to check their results."""

from __future__ import annotations

from evalsweep.plans.sql_views import choice, norm, processed, quoted, strip, verdict, with_views, words

# Stated again, so that a wrong value in the package shows.
RUN_TS = "20240131T120000Z"
ESSAY_SYSTEM = "Answer the question in full sentences and give your reasons."
JUDGE_SYSTEM = (
    "Grade a model's answer against the reference answer. Give a score between 0.0 (wrong) and "
    '1.0 (right) and answer with a single JSON object: {"score": <number>, '
    '"label": "correct" or "partial" or "incorrect"}.'
)

_RESULT_COLUMNS = """experiment, cell_idx, model_id, backend, quantization, kv_cache, prefix_cache,
    max_new_tokens, status, error, n_samples, mean_ttft_s, mean_tps, mean_total_s, exact_match_pct,
    normalized_match_pct, judge_avg_score, peak_vram_mb, avg_vram_mb, peak_power_w, avg_power_w,
    avg_gpu_util_pct, avg_cpu_util_pct, hw_sample_count, gpu_available"""

_MESSAGES = """SELECT spec_id, v.rule AS rule, v.message AS message
    FROM (SELECT spec_id, unnest(list_filter([{checks}], lambda x: x IS NOT NULL)) AS v FROM {table})"""


def _rule(broken: str, rule: str, message: str) -> str:
    return f"CASE WHEN {broken} THEN {{'rule': '{rule}', 'message': {message}}} END"


def _allowed(column: str, values: str) -> str:
    return _rule(
        f"{column} IS NULL OR {column} NOT IN ({values})",
        f"allowed:{column}",
        f"concat('{column} not allowed: ', coalesce({column}, 'NULL'))",
    )


def _range(column: str, broken: str) -> str:
    return _rule(f"coalesce({broken}, false)", f"range:{column}", f"'{column} out of range'")


def _required(trigger: str, value: str, needed: str) -> str:
    return _rule(
        f"{trigger} = '{value}' AND {needed} IS NULL",
        f"required:{needed}",
        quoted(f"{trigger}='{value}' requires {needed}"),
    )


def _first_key(keys: list[str]) -> str:
    # Presence decides, also for a key whose value is NULL.
    arms = " ".join(
        f"WHEN list_contains(map_keys(record), '{k}') THEN coalesce(record['{k}'], 'None')" for k in keys
    )
    return f"CASE {arms} END"


_QUESTION = _first_key(["question", "text", "input", "prompt"])
_ANSWER = _first_key(["answer", "label", "output", "target"])
_HAS_QUESTION = f"({_QUESTION}) IS NOT NULL"
_REFERENCE = f"coalesce({strip('(' + _ANSWER + ')')}, '')"


def _essay(body: str) -> str:
    cleaned = strip(f"replace({body}, '[[placeholder]]', '')")
    return (
        f"concat({quoted(ESSAY_SYSTEM)}, chr(10), chr(10), 'Question: ', {cleaned}, "
        "chr(10), chr(10), 'Answer:')"
    )


_MIXED = f"""(SELECT 'part' AS origin, sample_idx, prompt FROM samples_mc
    UNION ALL
    SELECT origin, id, {_essay("CASE WHEN id % 5 = 0 THEN concat(text, ' Options: none') ELSE text END")}
    FROM all_texts)"""

_OPEN_SCORE, _OPEN_LABEL = verdict("rn", "rc", "pn", "pc")
_OPEN = f"""(SELECT *, {norm('reference')} AS rn, {choice('reference')} AS rc, {norm('prediction')} AS pn,
    {choice('prediction')} AS pc, {processed('prediction', "contains(prompt, 'Options:')")} AS processed
    FROM answers_open)"""

_INFER_ROWS = f"""(SELECT g.cell_idx, g.backend, s.sample_idx, s.prompt,
        CASE WHEN contains(s.prompt, 'Options:') THEN 10 ELSE g.max_new_tokens END AS budget
    FROM (SELECT sample_idx, prompt FROM samples_mc
          UNION ALL SELECT -doc_id - 1, {_essay('text')} FROM documents) s CROSS JOIN grid g)"""


_SWEEP_ROWS = f"""(SELECT *, {norm('reference')} AS rn, {choice('reference')} AS rc, {norm('prediction')} AS pn,
        {choice('prediction')} AS pc, {processed('prediction', 'true')} AS processed,
        {len(JUDGE_SYSTEM) + len("..# Task...# Expected answer...# Answer to grade...Reply with the JSON object only.")}
            + length(prompt) + length(reference) + length(prediction) AS asked
    FROM (SELECT g.cell_idx, s.sample_idx, s.reference, s.prompt, g.model_id,
            model_id = 'model-b' AND quantization IS NOT NULL AND length(prompt) % 17 = 3 AS failed,
            concat('out of memory at ', CAST(length(prompt) AS VARCHAR)) AS message,
            concat(CASE WHEN model_id = 'model-a' THEN '' ELSE 'Option (' END,
                   substr('ABCDE', CAST(length(prompt) % 5 AS INT) + 1, 1),
                   CASE WHEN model_id = 'model-a' THEN '.' ELSE ')' END) AS prediction
          FROM samples_mc s CROSS JOIN grid g))"""
_SWEEP_CELLS = f"""(SELECT cell_idx, count(*) AS n, bool_or(failed) AS bad,
        arg_min(message, sample_idx) FILTER (WHERE failed) AS error,
        count(*) FILTER (WHERE {strip('reference')} = processed) / count(*) * 100 AS exact,
        count(*) FILTER (WHERE rn = {norm('processed')} OR rc = {choice('processed')}) / count(*) * 100 AS loose,
        avg({_OPEN_SCORE}) AS judged,
        avg(CASE WHEN asked % 11 = 0 THEN 0.0::DOUBLE ELSE asked % 5 * 0.25::DOUBLE END) AS graded
    FROM {_SWEEP_ROWS} GROUP BY cell_idx)"""


def _sweep_results(experiment: str, run_ts: str, judged: str) -> str:
    return f"""SELECT '{experiment}' AS experiment, '{run_ts}' AS run_ts, g.cell_idx, g.model_id, g.backend,
            g.quantization, g.kv_cache, g.prefix_cache, g.max_new_tokens,
            CASE WHEN c.bad THEN 'oom' ELSE 'ok' END AS status, c.error,
            CASE WHEN NOT c.bad THEN c.n END AS n_samples,
            CASE WHEN NOT c.bad AND g.model_id = 'model-a' THEN 0.125::DOUBLE END AS mean_ttft_s,
            CASE WHEN NOT c.bad THEN CASE WHEN g.model_id = 'model-a' THEN 4.0::DOUBLE ELSE 12.0::DOUBLE END END
                AS mean_tps,
            CASE WHEN NOT c.bad THEN CASE WHEN g.model_id = 'model-a' THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END END
                AS mean_total_s,
            CASE WHEN NOT c.bad THEN round(c.exact, 6) END AS exact_match_pct,
            CASE WHEN NOT c.bad THEN round(c.loose, 6) END AS normalized_match_pct,
            CASE WHEN NOT c.bad THEN round({judged}, 6) END AS judge_avg_score
        FROM grid g JOIN {_SWEEP_CELLS} c ON c.cell_idx = g.cell_idx"""


def _text_of(option: str, mark: str) -> str:
    return f"'  {mark}. ', {option}"


_LIST_LINES = "concat(" + ", chr(10), ".join(
    _text_of(f"opt_{c}", c.upper()) for c in "abcde"
) + ")"

_ANSWERS_REVERSED = "[opt_e, opt_d, opt_c, opt_b, opt_a]"

_SQL: dict[str, str] = {
    "scan_dataset": "SELECT * FROM documents WHERE lang = 'en'",
    "head_sample": "SELECT * FROM documents ORDER BY doc_id LIMIT 100",
    "read_results": f"SELECT {_RESULT_COLUMNS} FROM cell_results",
    "latest_sweep": f"SELECT {_RESULT_COLUMNS} FROM cell_results WHERE model_id = 'model-b'",
    "latest_runs": """SELECT experiment, run_ts, count(*) AS n_rows FROM runs r
        WHERE run_ts = (SELECT max(run_ts) FROM runs x WHERE x.experiment = r.experiment)
        GROUP BY experiment, run_ts""",
    "list_sweeps": """SELECT CAST(row_number() OVER (ORDER BY name) AS INT) AS position, name
        FROM (SELECT DISTINCT concat('sweep_', lower(replace(experiment, ' ', '_')), '_', run_ts, '.parquet')
                     AS name FROM runs ORDER BY name DESC LIMIT 10)""",
    "list_sweep_files": """SELECT CAST(row_number() OVER (ORDER BY name) AS INT) AS position, name
        FROM (SELECT concat('sweep_', lower(replace(experiment, ' ', '_')), '_', max(run_ts), '.parquet') AS name
              FROM runs GROUP BY experiment)""",
    "write_results": "SELECT * FROM predictions_mc",
    "checkpoint_cells": """SELECT 'Tier One' AS experiment, '20240131T120000Z' AS run_ts, cell_idx, sample_idx,
            CASE WHEN cell_idx IN (3, 6, 11, 14) THEN concat(prediction, ' (again)') ELSE prediction END
                AS prediction,
            CASE WHEN cell_idx IN (3, 6, 11, 14) THEN NULL ELSE error_type END AS error_type
        FROM predictions_mc""",
    "export_metrics": """SELECT model_id, backend, quantization, kv_cache, prefix_cache, max_new_tokens, status,
            error, n_samples, exact_match_pct, normalized_match_pct, judge_avg_score, mean_tps, mean_total_s,
            peak_vram_mb, avg_vram_mb, avg_power_w, avg_gpu_util_pct, hw_sample_count, experiment
        FROM cell_results""",
    "export_predictions": """SELECT s.prompt, s.reference, s.prediction, CAST(s.cell_idx - 1 AS INT) AS cell_pos
        FROM scores_mc s JOIN cell_results r ON r.cell_idx = s.cell_idx WHERE r.status = 'ok'""",
    "export_summary": """SELECT model_id AS model, backend, exact_match_pct, normalized_match_pct, mean_tps,
            mean_total_s, CAST(cell_idx - 1 AS INT) AS cell_pos
        FROM cell_results WHERE status = 'ok'""",
    "nest_cells": """SELECT cell_idx, sample_idx // 1024 AS chunk_idx, CAST(0 AS BIGINT) AS part_idx, count(*) AS n_samples,
            string_agg(CAST(sample_idx AS VARCHAR), ',' ORDER BY sample_idx) AS sample_ids,
            md5(string_agg(prompt, chr(10) ORDER BY sample_idx)) AS prompts_md5,
            string_agg(reference, ',' ORDER BY sample_idx) AS references,
            string_agg(prediction, '|' ORDER BY sample_idx) AS predictions
        FROM joined_mc GROUP BY cell_idx, sample_idx // 1024""",
    "unnest_cells": "SELECT cell_idx, sample_idx, prompt, reference, prediction FROM joined_mc",
    "resolve_question": f"SELECT doc_id, {_QUESTION} AS question FROM records",
    "resolve_answer": f"SELECT doc_id, {_REFERENCE} AS reference FROM records",
    "join_list_value": "SELECT doc_id, array_to_string(string_split(text, chr(10)), '; ') AS joined FROM documents",
    "clean_question": f"""SELECT doc_id, {strip("replace(concat(chr(9), ' [[placeholder]]', "
        "replace(text, 'e ', 'e [[placeholder]]')), '[[placeholder]]', '')")} AS question FROM documents""",
    "format_options": f"""SELECT sample_idx, {_LIST_LINES} AS as_list,
            CASE WHEN sample_idx % 7 = 0 THEN '' ELSE concat({_text_of('opt_a', 'A')}, chr(10),
                {_text_of('opt_b', 'B')}, chr(10), {_text_of('opt_e', 'C')}) END AS as_map,
            concat({_text_of('opt_a', 'W')}, chr(10), {_text_of('opt_b', 'X')}, chr(10),
                {_text_of('opt_c', 'Y')}, chr(10), {_text_of('opt_d', 'Z')}) AS as_lists,
            {_LIST_LINES} AS as_texts,
            concat({_text_of('opt_a', 'A')}, chr(10), {_text_of('opt_b', 'B')}) AS as_struct,
            array_to_string(list_transform(range(300), lambda i: concat('  ', chr(CAST(65 + i AS INT)), '. ',
                CAST(sample_idx + i AS VARCHAR))), chr(10)) AS as_many
        FROM qa_mc""",
    "first_choices": f"""SELECT sample_idx,
            CASE WHEN sample_idx % 3 = 2 THEN array_to_string([opt_a, opt_b, opt_c, opt_d, opt_e], '|')
                 WHEN sample_idx % 4 >= 2 THEN array_to_string({_ANSWERS_REVERSED}, '|') END AS chosen
        FROM qa_mc""",
    "build_prompt": f"""SELECT sample_idx, prompt, reference, 'part' AS origin FROM samples_mc
        UNION ALL
        SELECT doc_id, {_essay('(' + _QUESTION + ')')}, {_REFERENCE}, 'documents'
        FROM records WHERE {_HAS_QUESTION}""",
    "drop_keyless": f"SELECT doc_id FROM records WHERE {_HAS_QUESTION}",
    "count_keyless": f"""SELECT count(*) FILTER (WHERE {_HAS_QUESTION}) AS n_kept,
            count(*) FILTER (WHERE NOT ({_HAS_QUESTION})) AS n_dropped FROM records""",
    "is_multiple_choice": f"SELECT origin, sample_idx, contains(prompt, 'Options:') AS is_mc FROM {_MIXED}",
    "token_budget": f"""SELECT origin, sample_idx,
            CAST(CASE WHEN contains(prompt, 'Options:') THEN 10
                 WHEN sample_idx % 3 <> 0 THEN sample_idx % 512 + 1 ELSE 256 END AS INT) AS budget
        FROM {_MIXED}""",
    "chat_messages": """SELECT sample_idx, CAST(1 AS BIGINT) AS n_messages, 'user' AS role, prompt AS content
        FROM qa_chat""",
    "answer_tag": f"""SELECT sample_idx, CASE WHEN regexp_matches(t, '(?s)<(?:answer|response)>(.*?)</(?:answer|response)>')
            THEN {strip("regexp_extract(t, '(?s)<(?:answer|response)>(.*?)</(?:answer|response)>', 1)")}
            ELSE t END AS body
        FROM (SELECT sample_idx, CASE CAST(sample_idx % 3 AS INT) WHEN 0 THEN prediction
                WHEN 1 THEN concat('thinking <response>', chr(10), prediction, chr(10),
                                   '</answer> <answer>late</answer>')
                ELSE concat('<answer>never closed ', prediction) END AS t FROM answers_open)""",
    "clean_response": f"""SELECT origin, id, coalesce({strip(
        "CASE WHEN id % 6 <> 0 THEN concat(' ', chr(9), chr(160), text, chr(12288), chr(10)) END")}, '') AS reply
        FROM all_texts""",
    "token_count": f"""SELECT origin, id, CAST(CASE WHEN id % 3 <> 0 AND id % 4 <> 0 THEN id % 4
            ELSE greatest(len({words('text')}), 1) END AS BIGINT) AS n_tokens FROM all_texts""",
    "throughput": """SELECT cell_idx, sample_idx,
            CASE WHEN total_s > 0 THEN round(n_tokens / total_s, 6) ELSE 0.0::DOUBLE END AS tps
        FROM predictions_mc""",
    "classify_failure": """SELECT cell_idx, sample_idx,
            CASE WHEN error_type IS NULL THEN 'ok'
                 WHEN error_type IN ('RuntimeError', 'AcceleratorError') AND contains(lower(error), 'out of memory')
                     THEN 'oom'
                 ELSE 'error' END AS status, error
        FROM predictions_mc""",
    "attempt_outcome": """SELECT attempt_id, exit_code,
            CASE WHEN exit_code IS NOT NULL AND payload IS NOT NULL THEN 'ok' ELSE 'error' END AS status,
            CASE WHEN exit_code IS NULL THEN 'Worker process timeout: did not complete within 3600s'
                 WHEN payload IS NOT NULL THEN NULL
                 WHEN exit_code <> 0 THEN concat('Worker exited with code ', CAST(exit_code AS VARCHAR))
                 ELSE 'Worker produced no output: ' END AS error,
            CASE WHEN exit_code IS NOT NULL THEN payload END AS payload
        FROM attempts""",
    "ok_cells": "SELECT * FROM cell_results WHERE status = 'ok'",
    "permutations": """SELECT spec_id, perm_idx, quantization, kv_cache, prefix_cache, max_new_tokens
        FROM spec_perms""",
    "grid_cells": """SELECT spec_id, CAST(m_pos * n_perms + perm_idx + 1 AS INT) AS cell_idx,
            models[m_pos + 1].id AS model_id, coalesce(models[m_pos + 1].backend, 'hf') AS backend,
            quantization, kv_cache, prefix_cache, max_new_tokens
        FROM (SELECT *, unnest(range(len(models))) AS m_pos FROM spec_perms)""",
    "grid_size": """SELECT spec_id, CAST(len(models) * len(quants) * len(caches) * len(limits) AS BIGINT) AS n_cells
        FROM spec_axes""",
    "cell_samples": """SELECT s.sample_idx, s.prompt, s.reference, g.cell_idx, g.model_id, g.max_new_tokens
        FROM samples_mc s CROSS JOIN grid g""",
    "align_outputs": "SELECT cell_idx, sample_idx, prompt, reference, prediction FROM joined_mc",
    "alignment_report": """SELECT cell_idx, count(*) AS n_asked,
            count(*) FILTER (WHERE error_type IS NULL) AS n_given,
            count(*) FILTER (WHERE error_type IS NOT NULL) AS n_missing,
            CAST(0 AS BIGINT) AS n_unasked, CAST(0 AS BIGINT) AS n_repeated
        FROM predictions_mc GROUP BY cell_idx""",
    "alignment_faults": """SELECT coalesce(g.cell_idx, c.cell_idx) AS cell_idx,
            CASE WHEN g.cell_idx IS NULL THEN 0 ELSE n.n END AS n_asked, coalesce(c.n_given, 0) AS n_given,
            CASE WHEN g.cell_idx IS NULL THEN 0 ELSE n.n - coalesce(c.paired, 0) END AS n_missing,
            coalesce(c.n_unasked, 0) AS n_unasked, coalesce(c.n_repeated, 0) AS n_repeated
        FROM grid g FULL JOIN counts_faulty c ON c.cell_idx = g.cell_idx
        CROSS JOIN (SELECT count(*) AS n FROM samples_mc) n""",
    "attribute_telemetry_hosts": """SELECT e.event_id, w.window_idx FROM events e
        JOIN host_windows w ON e.user_id % 4 = w.host AND e.ts >= w.start_ts AND e.ts < w.end_ts""",
    "attribute_telemetry": """SELECT e.event_id, w.window_idx FROM events e
        JOIN cell_windows w ON e.ts >= w.start_ts AND e.ts < w.end_ts""",
    "attribute_telemetry_stream": """SELECT e.event_id, w.window_idx FROM events e
        JOIN cell_windows w ON e.ts >= w.start_ts AND e.ts < w.end_ts""",
    "check_unknown_columns": """SELECT c_custkey AS spec_id, 'unknown:settings' AS rule,
            concat('unknown keys: ', CASE WHEN c_custkey % 10 = 0 AND c_custkey % 6 = 0 THEN 'do_sample, execution'
                WHEN c_custkey % 10 = 0 THEN 'do_sample' ELSE 'execution' END) AS message
        FROM customer WHERE c_custkey % 6 = 0 OR c_custkey % 10 = 0""",
    "check_unknown_fields": """SELECT v.path AS "column", concat('unknown:', v.path) AS rule, v.n AS n_rows
        FROM (SELECT unnest([{'path': 'spec.models.bakend', 'n': rich},
                {'path': 'spec.generation.sampling.tempreature', 'n': rich}, {'path': 'contact', 'n': contacts}]) AS v
              FROM (SELECT count(*) FILTER (WHERE c_acctbal > 0) AS rich, count(c_mktsegment) AS contacts FROM customer))""",
    "check_allowed": _MESSAGES.format(
        table="spec_rows",
        checks=", ".join(
            [
                _allowed("backend", "'hf', 'vllm', 'mock', 'api'"),
                _allowed("compress", "'snappy', 'gzip', 'brotli', 'zstd', 'none'"),
                _allowed("judge_provider", "'mock', 'api'"),
            ]
        ),
    ),
    "check_ranges": _MESSAGES.format(
        table="spec_rows",
        checks=", ".join(
            [
                _range("max_samples", "max_samples <= 0"),
                _range("monitor_interval_ms", "monitor_interval_ms < 10"),
                _range("oom_probability", "oom_probability < 0 OR oom_probability > 1"),
                _range("base_latency_ms", "base_latency_ms <= 0"),
                _range("tokens_per_second", "tokens_per_second <= 0"),
            ]
        ),
    ),
    "check_required_if": _MESSAGES.format(
        table="spec_rows",
        checks=", ".join(
            [
                _required("backend", "api", "api_config"),
                _required("judge_provider", "api", "judge_api_config"),
            ]
        ),
    ),
    "admit_specs": "SELECT s.spec_id, count(b.rule) = 0 AS admitted, count(b.rule) AS n_broken "
    "FROM spec_rows s LEFT JOIN ("
    + _MESSAGES.format(
        table="spec_rows",
        checks=", ".join(
            [
                _allowed("backend", "'hf', 'vllm', 'mock', 'api'"),
                _allowed("compress", "'snappy', 'gzip', 'brotli', 'zstd', 'none'"),
                _range("max_samples", "max_samples <= 0"),
                _range("oom_probability", "oom_probability < 0 OR oom_probability > 1"),
                _required("backend", "api", "api_config"),
                _required("judge_provider", "api", "judge_api_config"),
            ]
        ),
    )
    + ") b ON b.spec_id = s.spec_id GROUP BY s.spec_id",
    "fill_defaults": """SELECT spec_id, coalesce(backend, 'hf') AS backend, api_config,
            coalesce(judge_provider, 'mock') AS judge_provider, judge_api_config,
            coalesce(compress, 'snappy') AS compress, coalesce(max_samples, 100) AS max_samples,
            monitor_interval_ms, round(oom_probability, 6) AS oom_probability, base_latency_ms,
            tokens_per_second, mock_enabled
        FROM spec_rows""",
    "strip": f"""SELECT origin, id, {strip("concat(chr(8195), chr(9), ' ', chr(31), text, chr(160), chr(10), "
        "chr(12288), ' ')")} AS stripped FROM all_texts""",
    "normalize_text": f"SELECT origin, id, {norm('text')} AS normalized FROM all_texts",
    "extract_choice": f"SELECT origin, id, {choice('text')} AS choice FROM all_texts",
    "reduce_mc_prediction": f"""SELECT origin, id, {processed('text', 'true')} AS as_choice,
            {strip('text')} AS as_essay FROM all_texts""",
    "exact_match": "SELECT cell_idx, sample_idx, processed, exact_match FROM scores_mc",
    "normalized_match": "SELECT cell_idx, sample_idx, normalized_match FROM scores_mc",
    "heuristic_judge": f"""SELECT sample_idx, {_OPEN_SCORE} AS judge_score, {_OPEN_LABEL} AS judge_label
        FROM {_OPEN}""",
    "judge_prompt": f"""SELECT sample_idx, concat({quoted(JUDGE_SYSTEM)}, chr(10), chr(10), '# Task', chr(10),
            prompt, chr(10), chr(10), '# Expected answer', chr(10), reference, chr(10), chr(10),
            '# Answer to grade', chr(10), prediction, chr(10), chr(10), 'Reply with the JSON object only.')
            AS judge_prompt
        FROM answers_open""",
    "parse_judge_reply": "SELECT sample_idx, round(judge_score, 6) AS judge_score, judge_label FROM verdicts",
    "score_samples": """SELECT cell_idx, sample_idx, reference, prediction, processed, exact_match,
            normalized_match, judge_score, judge_label FROM scores_mc""",
    "score_documents": f"""SELECT sample_idx, processed, {strip('reference')} = processed AS exact_match,
            (rn = {norm('processed')} OR rc = {choice('processed')}) AS normalized_match,
            {_OPEN_SCORE} AS judge_score, {_OPEN_LABEL} AS judge_label
        FROM {_OPEN}""",
    "batch_infer": f"""SELECT cell_idx, sample_idx,
            CASE WHEN n % 97 <> 13 THEN concat(substr('ABCDE', CAST(
                (n + CASE WHEN backend = 'api' THEN 1 ELSE 0 END + CASE WHEN cell_idx % 2 = 0 THEN 2 ELSE 0 END)
                % 5 AS INT) + 1, 1), '.') END AS prediction,
            CASE WHEN n % 97 <> 13 THEN 0.25::DOUBLE END AS ttft_s,
            CASE WHEN n % 97 <> 13 THEN 0.5::DOUBLE END AS total_s,
            CASE WHEN n % 97 <> 13 THEN CAST(budget AS INT) END AS n_tokens,
            CASE WHEN n % 97 = 13 THEN 'RuntimeError' END AS error_type,
            CASE WHEN n % 97 = 13 THEN concat('out of memory at ', CAST(n AS VARCHAR)) END AS error,
            CASE WHEN n % 97 = 13 THEN true END AS error_is_runtime
        FROM (SELECT *, length(prompt) AS n FROM {_INFER_ROWS})""",
    "run_attempts": """SELECT g.cell_idx, CAST(1 AS INT) AS attempt, CAST(f.failed AS INT) AS exit_code,
            CASE WHEN f.failed THEN 'error' ELSE 'ok' END AS status,
            CASE WHEN f.failed THEN 'Worker exited with code 1' END AS error,
            CASE WHEN NOT f.failed THEN s.n END AS n_samples, CASE WHEN NOT f.failed THEN s.n_chars END AS n_chars
        FROM grid g JOIN (SELECT cell_idx, coalesce(quantization = 'int8', false) AND kv_cache
                AND model_id LIKE '%b' AS failed FROM grid) f ON f.cell_idx = g.cell_idx,
            (SELECT count(*) AS n, CAST(sum(length(prompt)) AS BIGINT) AS n_chars FROM samples_mc) s""",
    "run_sweep": _sweep_results("007", "20240131", "c.judged"),
    "run_sweep_judged": _sweep_results("Tier One", RUN_TS, "c.graded"),
    "cell_accuracy": """SELECT g.cell_idx, n.n_samples, n.n_exact, n.n_normalized,
            round(n.n_exact / n.n_samples * 100, 6) AS exact_match_pct,
            round(n.n_normalized / n.n_samples * 100, 6) AS normalized_match_pct
        FROM grid g JOIN numbers_mc n ON n.cell_idx = g.cell_idx""",
    "cell_judge": """SELECT g.cell_idx, round(coalesce(avg(v.judge_score), 0.0), 6) AS judge_avg_score
        FROM grid g LEFT JOIN verdicts v ON v.cell_idx = g.cell_idx GROUP BY g.cell_idx""",
    "cell_perf": """SELECT g.cell_idx, n.n_samples, round(n.mean_ttft_s, 6) AS mean_ttft_s,
            round(n.mean_tps, 6) AS mean_tps, round(n.mean_total_s, 6) AS mean_total_s
        FROM grid g JOIN numbers_mc n ON n.cell_idx = g.cell_idx""",
    "cell_telemetry": """SELECT g.cell_idx, round(coalesce(peak_vram_mb, 0), 6) AS peak_vram_mb,
            round(coalesce(avg_vram_mb, 0), 6) AS avg_vram_mb,
            round(coalesce(peak_power_w, 0), 6) AS peak_power_w,
            round(coalesce(avg_power_w, 0), 6) AS avg_power_w,
            round(coalesce(avg_gpu_util_pct, 0), 6) AS avg_gpu_util_pct,
            round(coalesce(avg_cpu_util_pct, 0), 6) AS avg_cpu_util_pct,
            round(coalesce(avg_ram_used_mb, 0), 6) AS avg_ram_used_mb,
            coalesce(hw_sample_count, 0) AS hw_sample_count, coalesce(gpu_available, false) AS gpu_available
        FROM grid g LEFT JOIN rolled r ON r.cell_idx = g.cell_idx""",
    "cell_telemetry_cpu": """SELECT g.cell_idx, 0.0::DOUBLE AS peak_vram_mb, 0.0::DOUBLE AS avg_vram_mb,
            0.0::DOUBLE AS peak_power_w, 0.0::DOUBLE AS avg_power_w, 0.0::DOUBLE AS avg_gpu_util_pct,
            round(coalesce(avg_cpu_util_pct, 0), 6) AS avg_cpu_util_pct,
            round(coalesce(avg_ram_used_mb, 0), 6) AS avg_ram_used_mb,
            coalesce(hw_sample_count, 0) AS hw_sample_count, false AS gpu_available
        FROM grid g LEFT JOIN rolled r ON r.cell_idx = g.cell_idx""",
    "cell_results_faulty": """SELECT cell_idx, CASE WHEN cell_idx = 14 THEN 'error' ELSE status END AS status,
            CASE WHEN cell_idx = 14 THEN 'no such model' ELSE error END AS error, n_samples FROM cell_results""",
    "cell_results": "SELECT * FROM cell_results",
    "sweep_summary": """SELECT model_id, round(avg(exact_match_pct), 6) AS exact_mean,
            round(stddev_samp(exact_match_pct), 6) AS exact_std,
            round(avg(normalized_match_pct), 6) AS normalized_mean,
            round(stddev_samp(normalized_match_pct), 6) AS normalized_std,
            round(avg(judge_avg_score), 6) AS judge_mean, round(avg(mean_tps), 6) AS tps_mean,
            round(avg(mean_total_s), 6) AS total_s_mean, round(avg(peak_vram_mb), 6) AS peak_vram_mean,
            round(avg(avg_vram_mb), 6) AS avg_vram_mean, round(avg(peak_power_w), 6) AS peak_power_mean,
            round(avg(avg_power_w), 6) AS avg_power_mean, round(avg(avg_gpu_util_pct), 6) AS gpu_util_mean,
            round(avg(avg_cpu_util_pct), 6) AS cpu_util_mean
        FROM raw_results WHERE status = 'ok' GROUP BY model_id""",
    "summary_ttft": """SELECT model_id, round(avg(mean_ttft_s), 6) AS ttft_mean,
            CASE WHEN avg(mean_ttft_s) IS NULL THEN 'N/A' ELSE printf('%.2fs', avg(mean_ttft_s)) END AS ttft_text
        FROM raw_results WHERE status = 'ok' GROUP BY model_id""",
    "sweep_progress": """SELECT experiment, count(*) FILTER (WHERE status = 'ok') AS n_ok, count(*) AS n_rows,
            CAST(26 AS BIGINT) AS n_columns
        FROM cell_results GROUP BY experiment""",
    "telemetry_units": """SELECT event_id, cell_idx, gpu_ok, round(vram_used_mb, 6) AS vram_used_mb,
            round(vram_total_mb, 6) AS vram_total_mb, round(power_draw_w, 6) AS power_draw_w,
            round(gpu_util_pct, 6) AS gpu_util_pct, round(cpu_util_pct, 6) AS cpu_util_pct,
            round(ram_used_mb, 6) AS ram_used_mb
        FROM units""",
    "telemetry_rollup_stream": """SELECT cell_idx, round(peak_vram_mb, 6) AS peak_vram_mb,
            round(avg_vram_mb, 6) AS avg_vram_mb, round(peak_power_w, 6) AS peak_power_w,
            round(avg_power_w, 6) AS avg_power_w, round(avg_gpu_util_pct, 6) AS avg_gpu_util_pct,
            round(avg_cpu_util_pct, 6) AS avg_cpu_util_pct, round(avg_ram_used_mb, 6) AS avg_ram_used_mb,
            hw_sample_count, gpu_available
        FROM rolled""",
    "telemetry_rollup_slices": """SELECT cell_idx, round(peak_vram_mb, 6) AS peak_vram_mb,
            round(avg_vram_mb, 6) AS avg_vram_mb, round(peak_power_w, 6) AS peak_power_w,
            round(avg_power_w, 6) AS avg_power_w, round(avg_gpu_util_pct, 6) AS avg_gpu_util_pct,
            round(avg_cpu_util_pct, 6) AS avg_cpu_util_pct, round(avg_ram_used_mb, 6) AS avg_ram_used_mb,
            hw_sample_count, gpu_available
        FROM rolled""",
    "cell_detail": """SELECT CAST(cell_idx - 1 AS INT) AS cell_pos, model_id, backend,
            concat('quant=', coalesce(quantization, 'None'), ', kv=', CASE WHEN kv_cache THEN 'True' ELSE 'False' END,
                   ', prefix=', CASE WHEN prefix_cache THEN 'True' ELSE 'False' END,
                   ', tokens=', CAST(max_new_tokens AS VARCHAR)) AS config,
            status, n_samples, exact_match_pct, normalized_match_pct, judge_avg_score, mean_tps, mean_total_s,
            peak_vram_mb, avg_vram_mb, avg_power_w, CASE WHEN status <> 'ok' THEN error END AS error
        FROM cell_results""",
    "show_predictions": f"""SELECT CAST(row_number() OVER (ORDER BY sample_idx) - 1 AS INT) AS pos,
            CASE WHEN {strip('prediction')} = reference THEN '✓' ELSE '✗' END AS mark,
            CASE WHEN length(prediction) > 70 THEN concat(substr(prediction, 1, 70), '...')
                 ELSE prediction END AS prediction,
            reference, CAST(NULL AS VARCHAR) AS message
        FROM (SELECT * FROM joined_mc WHERE cell_idx = 5 ORDER BY sample_idx LIMIT 20)""",
}

ORACLE_SQL = {name: with_views(sql) for name, sql in _SQL.items()}
