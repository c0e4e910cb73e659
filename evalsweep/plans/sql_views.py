"""The input views in DuckDB SQL, and SQL text for the text rules.

Used only to check the Spark results.
"""

from __future__ import annotations

import re

from evalsweep.plans.views import ANSWER_FORMS, EXPERIMENT, REPLY_FORMS

# Stated again, so that a wrong value in the package shows.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
CHOICE_SYSTEM = "Answer the multiple-choice question with the letter of the right option only."

# Same character set as functions.text.WHITESPACE, as a regular expression.
WS = (
    r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(t: str) -> str:
    return rf"regexp_replace({t}, '\A{WS}+|{WS}+\z', '', 'g')"


def words(t: str) -> str:
    return f"list_filter(string_split_regex({t}, '{WS}+'), lambda x: x <> '')"


def norm(t: str) -> str:
    return (
        f"array_to_string(list_filter(string_split_regex(translate(lower({t}), {quoted(PUNCTUATION)}, ''), "
        f"'{WS}+'), lambda x: x NOT IN ('', 'a', 'an', 'the')), ' ')"
    )


def choice(t: str) -> str:
    letter = rf"regexp_extract({t}, '(?:\A|[^\pL\pN_])([A-Fa-f])(?:[^\pL\pN_]|\z)', 1)"
    return (
        f"CASE WHEN {letter} <> '' THEN upper({letter}) "
        f"WHEN {strip(t)} <> '' THEN upper(substr({strip(t)}, 1, 1)) ELSE {t} END"
    )


def processed(t: str, is_mc: str) -> str:
    letter = f"regexp_extract({t}, '[A-Ea-e]')"
    return (
        f"CASE WHEN {is_mc} AND {letter} <> '' THEN upper({letter}) "
        rf"WHEN {is_mc} AND regexp_matches({choice(t)}, '^\pL$') THEN {choice(t)} "
        f"ELSE {strip(t)} END"
    )


def verdict(rn: str, rc: str, pn: str, pc: str) -> tuple[str, str]:
    right = f"({rn} = {pn} OR ({rc} <> '' AND {rc} = {pc}))"
    part = f"({rn} <> '' AND {pn} <> '' AND (contains({pn}, {rn}) OR contains({rn}, {pn})))"
    return (
        f"CASE WHEN {right} THEN 1.0::DOUBLE WHEN {part} THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END",
        f"CASE WHEN {right} THEN 'correct' WHEN {part} THEN 'partial' ELSE 'incorrect' END",
    )


def cases(index: str, values: list[str]) -> str:
    arms = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values[:-1]))
    return f"CASE {index} {arms} ELSE {values[-1]} END"


_HEAD, _TAIL = REPLY_FORMS[0].split("%d")
_REPLIES = [
    f"concat({quoted(_HEAD)}, CAST(CAST(floor((event_id % 100) / 10) AS INT) AS VARCHAR), {quoted(_TAIL)})",
    *[quoted(form) for form in REPLY_FORMS[1:]],
]

_RIGHT_SCORE, _RIGHT_LABEL = verdict("ref_norm", "ref_choice", "pred_norm", "pred_choice")

VIEWS: dict[str, str] = {
    "grid": f"""
        SELECT '{EXPERIMENT}' AS experiment,
               CAST(m_pos * 8 + q_pos * 4 + c_pos * 2 + t_pos + 1 AS INT) AS cell_idx,
               model_id, backend, quantization, kv_cache, prefix_cache, max_new_tokens
        FROM (VALUES (0, 'model-a', 'vllm'), (1, 'model-b', 'api')) AS m(m_pos, model_id, backend)
        CROSS JOIN (VALUES (0, CAST(NULL AS VARCHAR)), (1, 'int4')) AS q(q_pos, quantization)
        CROSS JOIN (VALUES (0, false, false), (1, true, false)) AS c(c_pos, kv_cache, prefix_cache)
        CROSS JOIN (VALUES (0, 128), (1, 256)) AS t(t_pos, max_new_tokens)""",
    "qa_mc": """
        SELECT p_partkey AS sample_idx, concat('  ', p_name, ' [[placeholder]]? ') AS question,
               p_brand AS opt_a, p_type AS opt_b, p_name AS opt_c, CAST(p_size AS VARCHAR) AS opt_d,
               'none of these' AS opt_e,
               substr('ABCDE', CAST(p_partkey % 5 AS INT) + 1, 1) AS answer
        FROM part""",
    "samples_mc": f"""
        SELECT sample_idx,
               concat({quoted(CHOICE_SYSTEM)}, chr(10), chr(10), 'Question: ',
                      {strip("replace(question, '[[placeholder]]', '')")},
                      chr(10), chr(10), 'Options:', chr(10),
                      '  A. ', opt_a, chr(10), '  B. ', opt_b, chr(10), '  C. ', opt_c, chr(10),
                      '  D. ', opt_d, chr(10), '  E. ', opt_e,
                      chr(10), chr(10), 'Answer:') AS prompt,
               {strip('answer')} AS reference
        FROM qa_mc""",
    "predictions_mc": f"""
        SELECT g.cell_idx, s.sample_idx,
               {cases('CAST((s.sample_idx * 7 + g.cell_idx * 3) % 11 AS INT)', [quoted(t) for t in ANSWER_FORMS])}
                   AS prediction,
               CASE WHEN s.sample_idx % 4 = 0 THEN NULL ELSE CAST(0.12 AS DOUBLE) END AS ttft_s,
               CAST((s.sample_idx + g.cell_idx) % 50 AS DOUBLE) / 20.0 AS total_s,
               CAST((s.sample_idx * 3 + g.cell_idx) % 57 AS INT) AS n_tokens,
               CASE WHEN g.cell_idx = 11 AND s.sample_idx % 97 = 5 THEN 'AcceleratorError'
                    WHEN g.cell_idx % 8 = 3 AND s.sample_idx % 97 = 5 THEN 'RuntimeError'
                    WHEN g.cell_idx % 8 = 6 AND s.sample_idx % 89 = 7 THEN 'ValueError' END AS error_type,
               CASE WHEN g.cell_idx % 8 = 3 AND s.sample_idx % 97 = 5
                        THEN concat('GPU Out Of Memory at ', CAST(s.sample_idx AS VARCHAR))
                    WHEN g.cell_idx % 8 = 6 AND s.sample_idx % 89 = 7
                        THEN 'out of memory, but wrong type' END AS error,
               CASE WHEN g.cell_idx % 8 = 3 AND s.sample_idx % 97 = 5 THEN true
                    WHEN g.cell_idx % 8 = 6 AND s.sample_idx % 89 = 7 THEN false END AS error_is_runtime
        FROM qa_mc s CROSS JOIN grid g""",
    "predictions_faulty": """
        SELECT cell_idx, sample_idx FROM predictions_mc WHERE NOT (cell_idx = 2 AND sample_idx % 10 = 0)
        UNION ALL SELECT cell_idx, -sample_idx FROM predictions_mc WHERE cell_idx = 5 AND sample_idx % 7 = 0
        UNION ALL SELECT cell_idx, sample_idx FROM predictions_mc WHERE cell_idx = 9 AND sample_idx % 5 = 0
        UNION ALL SELECT 99, sample_idx FROM predictions_mc WHERE cell_idx = 1 AND sample_idx % 100 = 0""",
    "pairs_faulty": """
        SELECT cell_idx, sample_idx, count(*) AS k,
               sample_idx IN (SELECT sample_idx FROM samples_mc) AS known
        FROM predictions_faulty GROUP BY cell_idx, sample_idx""",
    "counts_faulty": """
        SELECT cell_idx, CAST(sum(k) AS BIGINT) AS n_given, count(*) FILTER (WHERE known) AS paired,
               count(*) FILTER (WHERE NOT known) AS n_unasked, count(*) FILTER (WHERE k > 1) AS n_repeated
        FROM pairs_faulty GROUP BY cell_idx""",
    "joined_mc": """
        SELECT p.*, s.prompt, s.reference, contains(s.prompt, 'Options:') AS is_mc
        FROM predictions_mc p JOIN samples_mc s ON s.sample_idx = p.sample_idx""",
    "forms_mc": f"""
        SELECT *, {strip('reference')} AS ref_strip, {norm('reference')} AS ref_norm,
               {choice('reference')} AS ref_choice, {norm('prediction')} AS pred_norm,
               {choice('prediction')} AS pred_choice, {processed('prediction', 'is_mc')} AS processed
        FROM joined_mc""",
    "scores_mc": f"""
        SELECT cell_idx, sample_idx, prompt, reference, prediction, processed, ttft_s, total_s, n_tokens,
               error_type, error,
               ref_strip = processed AS exact_match,
               (ref_norm = {norm('processed')} OR ref_choice = {choice('processed')}) AS normalized_match,
               {_RIGHT_SCORE} AS judge_score, {_RIGHT_LABEL} AS judge_label
        FROM forms_mc""",
    "numbers_mc": """
        SELECT cell_idx, count(*) AS n_samples,
               count(*) FILTER (WHERE exact_match) AS n_exact,
               count(*) FILTER (WHERE normalized_match) AS n_normalized,
               avg(judge_score) AS judge_avg_score, avg(ttft_s) AS mean_ttft_s,
               avg(CASE WHEN total_s > 0 THEN n_tokens / total_s ELSE 0.0 END) AS mean_tps,
               avg(total_s) AS mean_total_s,
               arg_min(error_type, sample_idx) FILTER (WHERE error_type IS NOT NULL) AS error_type,
               arg_min(error, sample_idx) FILTER (WHERE error_type IS NOT NULL) AS error
        FROM scores_mc GROUP BY cell_idx""",
    "telemetry": """
        SELECT event_id, ts, CAST(1 + user_id % 16 AS INT) AS cell_idx,
               CAST(floor(value * 1048576) AS BIGINT) AS vram_used_bytes,
               CAST(85899345920 AS BIGINT) AS vram_total_bytes,
               CASE WHEN event_id % 13 <> 0 THEN CAST(floor(value * 1000) AS BIGINT) END AS power_mw,
               CAST(event_id % 101 AS DOUBLE) AS gpu_util_pct,
               CASE WHEN event_id % 17 <> 0 THEN CAST(event_id % 97 AS DOUBLE) END AS cpu_util_pct,
               CAST(floor(value * 1048576) AS BIGINT) * 2 AS ram_used_bytes,
               (event_type <> 'error') AS gpu_ok
        FROM events""",
    "units": """
        SELECT event_id, ts, cell_idx, gpu_ok,
               coalesce(vram_used_bytes / 1048576.0::DOUBLE, 0.0::DOUBLE) AS vram_used_mb,
               coalesce(vram_total_bytes / 1048576.0::DOUBLE, 0.0::DOUBLE) AS vram_total_mb,
               coalesce(power_mw / 1000.0::DOUBLE, 0.0::DOUBLE) AS power_draw_w,
               coalesce(gpu_util_pct, 0.0::DOUBLE) AS gpu_util_pct,
               coalesce(cpu_util_pct, 0.0::DOUBLE) AS cpu_util_pct,
               coalesce(ram_used_bytes / 1048576.0::DOUBLE, 0.0::DOUBLE) AS ram_used_mb
        FROM telemetry""",
    "rolled": """
        SELECT cell_idx, max(vram_used_mb) AS peak_vram_mb, avg(vram_used_mb) AS avg_vram_mb,
               max(power_draw_w) AS peak_power_w, avg(power_draw_w) AS avg_power_w,
               avg(gpu_util_pct) AS avg_gpu_util_pct, avg(cpu_util_pct) AS avg_cpu_util_pct,
               avg(ram_used_mb) AS avg_ram_used_mb, count(*) AS hw_sample_count,
               bool_or(gpu_ok) AS gpu_available
        FROM units GROUP BY cell_idx""",
    "status_mc": """
        SELECT g.*, n.* EXCLUDE (cell_idx), r.* EXCLUDE (cell_idx),
               CASE WHEN n.error_type IS NULL THEN 'ok'
                    WHEN n.error_type IN ('RuntimeError', 'AcceleratorError')
                        AND contains(lower(n.error), 'out of memory') THEN 'oom'
                    ELSE 'error' END AS status
        FROM grid g LEFT JOIN numbers_mc n ON n.cell_idx = g.cell_idx
        LEFT JOIN rolled r ON r.cell_idx = g.cell_idx""",
    "raw_results": """
        SELECT experiment, cell_idx, model_id, backend, quantization, kv_cache, prefix_cache,
               max_new_tokens, status, error,
               CASE WHEN status = 'ok' THEN n_samples END AS n_samples,
               CASE WHEN status = 'ok' THEN mean_ttft_s END AS mean_ttft_s,
               CASE WHEN status = 'ok' THEN mean_tps END AS mean_tps,
               CASE WHEN status = 'ok' THEN mean_total_s END AS mean_total_s,
               CASE WHEN status = 'ok' THEN n_exact / n_samples * 100 END AS exact_match_pct,
               CASE WHEN status = 'ok' THEN n_normalized / n_samples * 100 END AS normalized_match_pct,
               CASE WHEN status = 'ok' THEN judge_avg_score END AS judge_avg_score,
               CASE WHEN status = 'ok' THEN coalesce(peak_vram_mb, 0) END AS peak_vram_mb,
               CASE WHEN status = 'ok' THEN coalesce(avg_vram_mb, 0) END AS avg_vram_mb,
               CASE WHEN status = 'ok' THEN coalesce(peak_power_w, 0) END AS peak_power_w,
               CASE WHEN status = 'ok' THEN coalesce(avg_power_w, 0) END AS avg_power_w,
               CASE WHEN status = 'ok' THEN coalesce(avg_gpu_util_pct, 0) END AS avg_gpu_util_pct,
               CASE WHEN status = 'ok' THEN coalesce(avg_cpu_util_pct, 0) END AS avg_cpu_util_pct,
               CASE WHEN status = 'ok' THEN coalesce(avg_ram_used_mb, 0) END AS avg_ram_used_mb,
               CASE WHEN status = 'ok' THEN coalesce(hw_sample_count, 0) END AS hw_sample_count,
               CASE WHEN status = 'ok' THEN coalesce(gpu_available, false) END AS gpu_available
        FROM status_mc""",
    "cell_results": """
        SELECT experiment, cell_idx, model_id, backend, quantization, kv_cache, prefix_cache,
               max_new_tokens, status, error, n_samples,
               round(mean_ttft_s, 6) AS mean_ttft_s,
               round(mean_tps, 6) AS mean_tps,
               round(mean_total_s, 6) AS mean_total_s,
               round(exact_match_pct, 6) AS exact_match_pct,
               round(normalized_match_pct, 6) AS normalized_match_pct,
               round(judge_avg_score, 6) AS judge_avg_score,
               round(peak_vram_mb, 6) AS peak_vram_mb,
               round(avg_vram_mb, 6) AS avg_vram_mb,
               round(peak_power_w, 6) AS peak_power_w,
               round(avg_power_w, 6) AS avg_power_w,
               round(avg_gpu_util_pct, 6) AS avg_gpu_util_pct,
               round(avg_cpu_util_pct, 6) AS avg_cpu_util_pct,
               round(avg_ram_used_mb, 6) AS avg_ram_used_mb,
               hw_sample_count, gpu_available
        FROM raw_results""",
    "qa_open": """
        SELECT doc_id AS sample_idx, concat('Summarise document ', CAST(doc_id AS VARCHAR)) AS prompt,
               text AS reference, lang, source FROM documents""",
    "answers_open": """
        SELECT *, CASE CAST(sample_idx % 8 AS INT)
            WHEN 0 THEN reference WHEN 1 THEN concat('  ', reference, '!! ')
            WHEN 2 THEN concat('The ', lower(reference)) WHEN 3 THEN concat('Note: ', reference)
            WHEN 4 THEN lang WHEN 5 THEN '' WHEN 6 THEN concat(source, ' ', lang)
            ELSE concat('<answer> ', reference, ' </response> tail') END AS prediction
        FROM qa_open""",
    "all_texts": """
        SELECT 'documents' AS origin, doc_id AS id, text FROM documents
        UNION ALL SELECT 'conversations', conv_id * 1000 + turn, text FROM conversations
        UNION ALL SELECT 'benchmark', item_id, text FROM benchmark""",
    "records": """
        SELECT doc_id, CASE CAST(doc_id % 10 AS INT)
            WHEN 0 THEN MAP{'other': text}
            WHEN 1 THEN MAP{'question': text, 'answer': lang}
            WHEN 2 THEN MAP{'text': text, 'label': concat(' ', chr(9), lang, chr(10))}
            WHEN 3 THEN MAP{'prompt': text, 'input': lang}
            WHEN 4 THEN MAP{'question': CAST(NULL AS VARCHAR), 'text': text, 'answer': CAST(NULL AS VARCHAR)}
            WHEN 5 THEN MAP{'text': text, 'target': lang, 'output': text}
            WHEN 6 THEN MAP{'input': text, 'answer': '  '}
            WHEN 7 THEN MAP{'prompt': text, 'label': lang, 'answer': text}
            WHEN 8 THEN MAP{'text': text}
            ELSE MAP{'question': lang, 'text': text, 'label': lang} END AS record
        FROM documents""",
    "qa_chat": """
        SELECT conv_id * 1000 + turn AS sample_idx, text AS prompt FROM conversations WHERE role = 'user'""",
    "judge_replies": f"""
        SELECT event_id AS sample_idx, CAST(1 + event_id % 16 AS INT) AS cell_idx,
               {cases('CAST(event_id % 10 AS INT)', _REPLIES)} AS reply
        FROM events""",
    "reply_json": r"""
        SELECT sample_idx, cell_idx,
               try_cast(CASE WHEN regexp_extract(reply, '(?s)\{.*\}') <> ''
                             THEN regexp_extract(reply, '(?s)\{.*\}') ELSE reply END AS JSON) AS j
        FROM judge_replies""",
    "reply_fields": """
        SELECT sample_idx, cell_idx, coalesce(json_type(j) = 'OBJECT', false) AS is_object,
               CASE WHEN list_contains(json_keys(j), 'score') THEN try_cast(j->>'score' AS DOUBLE)
                    ELSE 0.0::DOUBLE END AS num,
               CASE WHEN list_contains(json_keys(j), 'label') THEN coalesce(j->>'label', 'None')
                    ELSE 'incorrect' END AS lab
        FROM reply_json""",
    "verdicts": """
        SELECT sample_idx, cell_idx,
               CASE WHEN is_object AND num IS NOT NULL THEN greatest(0.0, least(1.0, num))
                    ELSE 0.0::DOUBLE END AS judge_score,
               CASE WHEN is_object AND num IS NOT NULL THEN lab ELSE 'incorrect' END AS judge_label
        FROM reply_fields""",
    "cell_windows": """
        SELECT CAST(extract(day FROM start_ts) AS INT) AS window_idx, start_ts,
               start_ts + INTERVAL '1' DAY AS end_ts
        FROM (SELECT DISTINCT date_trunc('day', ts) AS start_ts FROM events)
        UNION ALL
        SELECT CAST(extract(day FROM start_ts) * 100 + extract(hour FROM start_ts) AS INT), start_ts,
               start_ts + INTERVAL '1' HOUR
        FROM (SELECT DISTINCT date_trunc('hour', ts) AS start_ts FROM events)""",
    "host_windows": """
        SELECT host, CAST(extract(day FROM start_ts) * 10 + host AS INT) AS window_idx, start_ts,
               start_ts + INTERVAL '36' HOUR AS end_ts
        FROM (SELECT DISTINCT user_id % 4 AS host, date_trunc('day', ts) AS start_ts FROM events)""",
    "attempts": """
        SELECT o_orderkey AS attempt_id,
               CASE o_orderstatus WHEN 'P' THEN NULL WHEN 'O' THEN 0
                    ELSE CAST(o_custkey % 3 AS INT) END AS exit_code,
               CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS payload
        FROM orders""",
    "runs": """
        SELECT o_orderpriority AS experiment, strftime(o_orderdate, '%Y%m%d') AS run_ts,
               o_orderstatus = 'F' AS finished
        FROM orders""",
    "spec_axes": """
        SELECT c_custkey AS spec_id,
               CASE c_custkey % 3 WHEN 0 THEN [{'id': c_mktsegment, 'backend': 'vllm'}]
                    WHEN 1 THEN [{'id': c_mktsegment, 'backend': CAST(NULL AS VARCHAR)},
                                 {'id': c_name, 'backend': 'api'}]
                    ELSE [{'id': 'model-a', 'backend': 'hf'}, {'id': 'model-b', 'backend': 'mock'},
                          {'id': c_name, 'backend': 'api'}] END AS models,
               CASE c_custkey % 5 WHEN 1 THEN [CAST(NULL AS VARCHAR)] WHEN 2 THEN [NULL, 'int4']
                    WHEN 3 THEN CAST([] AS VARCHAR[]) WHEN 4 THEN ['int8', 'int4']
                    ELSE [NULL, 'int8', 'int4'] END AS quants,
               CASE WHEN c_custkey % 4 = 1 THEN [{'kv': false, 'px': false}, {'kv': true, 'px': false}]
                    WHEN c_custkey % 4 = 3 THEN [{'kv': true, 'px': true}]
                    WHEN c_custkey % 6 < 4 AND c_custkey % 7 >= 2
                        THEN [{'kv': true, 'px': false}, {'kv': true, 'px': true},
                              {'kv': false, 'px': false}, {'kv': false, 'px': true}]
                    ELSE [{'kv': false, 'px': false}] END AS caches,
               CASE c_custkey % 11 WHEN 0 THEN [256] WHEN 1 THEN [128] ELSE [128, 256] END AS limits
        FROM customer""",
    "spec_perms": """
        SELECT spec_id, models,
               CAST(q_pos * len(caches) * len(limits) + c_pos * len(limits) + t_pos AS INT) AS perm_idx,
               len(quants) * len(caches) * len(limits) AS n_perms,
               quants[q_pos + 1] AS quantization, caches[c_pos + 1].kv AS kv_cache,
               caches[c_pos + 1].px AS prefix_cache, CAST(limits[t_pos + 1] AS INT) AS max_new_tokens
        FROM (SELECT *, unnest(range(len(limits))) AS t_pos
              FROM (SELECT *, unnest(range(len(caches))) AS c_pos
                    FROM (SELECT *, unnest(range(len(quants))) AS q_pos FROM spec_axes)))""",
    "spec_rows": """
        SELECT c_custkey AS spec_id,
               CASE c_custkey % 6 WHEN 0 THEN 'hf' WHEN 1 THEN 'vllm' WHEN 2 THEN 'api' WHEN 3 THEN 'mock'
                    WHEN 4 THEN 'other' END AS backend,
               CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS api_config,
               CASE WHEN c_custkey % 10 <> 9 THEN
                   CASE c_custkey % 3 WHEN 0 THEN 'mock' WHEN 1 THEN 'api' ELSE 'human' END END AS judge_provider,
               CASE WHEN c_custkey % 5 = 0 THEN c_name END AS judge_api_config,
               CASE c_custkey % 8 WHEN 0 THEN 'snappy' WHEN 1 THEN 'gzip' WHEN 2 THEN 'brotli'
                    WHEN 3 THEN 'zstd' WHEN 4 THEN 'none' WHEN 5 THEN 'lz4' END AS compress,
               CASE WHEN c_custkey % 9 <> 0 THEN CAST(c_nationkey - 2 AS INT) END AS max_samples,
               CAST(c_custkey % 40 AS INT) AS monitor_interval_ms,
               CASE WHEN c_custkey % 12 <> 0 THEN c_acctbal / 5000.0::DOUBLE END AS oom_probability,
               CAST(c_custkey % 14 AS INT) AS base_latency_ms,
               CAST(c_custkey % 15 AS INT) AS tokens_per_second,
               CASE WHEN c_custkey % 13 <> 0 THEN c_custkey % 7 = 0 END AS mock_enabled
        FROM customer""",
}


def _mentioned(sql: str) -> list[str]:
    return [name for name in VIEWS if re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", sql)]


def with_views(sql: str) -> str:
    """The query with every view it needs, directly or not, as WITH clauses."""
    needed: set[str] = set()
    pending = _mentioned(sql)
    while pending:
        name = pending.pop()
        if name not in needed:
            needed.add(name)
            pending.extend(_mentioned(VIEWS[name]))
    if not needed:
        return sql
    clauses = ", ".join(f"{name} AS ({VIEWS[name]})" for name in VIEWS if name in needed)
    return f"WITH {clauses} {sql}"
