"""DuckDB SQL for every registered query (the correctness oracle).

Each statement reads the pre-registered driver views and produces the same
columns (names and values) as the Spark query of the same key. Helpers below
spell the word/recall rules in DuckDB's dialect (RE2 regex, list lambdas).
"""

from __future__ import annotations

# ---- fixed values (the word and whitespace classes of the scoring rules) ----
WORD = r"[\p{L}\p{N}_]+"
WS = (r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
      r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
# ---------------------------------------------------------------------------


def words(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '{WORD}')"


def tokens(x: str) -> str:
    return f"list_distinct({words(x)})"


def token_recall_one(pred_tokens: str, truth: str) -> str:
    t = tokens(truth)
    return (f"(CASE WHEN len({t}) = 0 THEN 0.0 ELSE "
            f"len(list_intersect({t}, {pred_tokens}))::DOUBLE / len({t}) END)")


def substring_recall_one(pred_lower: str, truth: str) -> str:
    w = words(truth)
    return (f"(CASE WHEN len({w}) = 0 THEN 0.0 ELSE "
            f"len(list_filter({w}, lambda w: contains({pred_lower}, w)))::DOUBLE / len({w}) END)")


def token_recall_list(pred_tokens: str, truths: str) -> str:
    return (f"coalesce(list_max(list_transform(list_filter({truths}, lambda t: len({tokens('t')}) > 0), "
            f"lambda t: {token_recall_one(pred_tokens, 't')})), 0.0)")


def substring_recall_list(pred_lower: str, truths: str) -> str:
    return (f"coalesce(list_max(list_transform(list_filter({truths}, lambda t: t IS NOT NULL AND t <> ''), "
            f"lambda t: {substring_recall_one(pred_lower, 't')})), 0.0)")


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def collapse(x: str) -> str:
    return strip(f"regexp_replace({x}, '{WS}+', ' ', 'g')")


PAIRS = """
  pairs AS (
    SELECT u.conv_id, u.turn, u.text AS question, a.text AS prediction
    FROM conversations u JOIN conversations a
      ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
    WHERE u.role = 'user' AND a.role = 'assistant')"""

SCORED_PAIRS = PAIRS + f""",
  scored AS (
    SELECT conv_id, turn, question, prediction,
           {substring_recall_one('lower(prediction)', 'question')} AS substring_recall,
           {token_recall_one(tokens('prediction'), 'question')} AS token_recall
    FROM pairs)"""


def _sql() -> dict[str, str]:
    q: dict[str, str] = {}

    q["q01_has_question"] = """
SELECT conv_id, turn, text AS question
FROM conversations WHERE role = 'user' AND text IS NOT NULL AND text <> ''"""

    q["q23_recalls"] = f"""
WITH {SCORED_PAIRS}
SELECT conv_id, turn, substring_recall, token_recall FROM scored"""

    q["q08_run_quality"] = f"""
WITH {SCORED_PAIRS},
  runs AS (SELECT DISTINCT conv_id FROM conversations)
SELECT r.conv_id,
       round(coalesce(avg(s.substring_recall), 0.0), 6) AS substring_recall,
       round(coalesce(avg(s.token_recall), 0.0), 6) AS token_recall,
       count(s.conv_id)::BIGINT AS num_examples
FROM runs r LEFT JOIN scored s ON s.conv_id = r.conv_id
GROUP BY r.conv_id"""

    q["q02_dataset_stats"] = """
SELECT d.source,
       count(*)::BIGINT AS eval_size,
       count(*) FILTER (WHERE l.quality = 1)::BIGINT AS valid_count,
       least(count(*) FILTER (WHERE l.quality = 1), 50)::BIGINT AS to_process
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
GROUP BY d.source"""

    q["q03_cap_samples"] = f"""
WITH {PAIRS}
SELECT conv_id, turn, question, prediction AS answer
FROM pairs WHERE question IS NOT NULL AND question <> ''
ORDER BY conv_id, turn LIMIT 50"""

    q["q03b_cap_per_run"] = """
SELECT (conv_id % 2)::BIGINT AS run, conv_id, turn, text AS question FROM conversations
WHERE role = 'user' AND text IS NOT NULL AND text <> ''
QUALIFY row_number() OVER (PARTITION BY conv_id % 2 ORDER BY conv_id, turn) <= 50"""

    q["q04_predictions"] = f"""
WITH {SCORED_PAIRS}
SELECT conv_id::VARCHAR || ':' || turn::VARCHAR AS question_id, question, prediction AS predicted_answer,
       1::BIGINT AS n_truths, 'none' AS context_type, 'assistant' AS model_name,
       'conversations' AS dataset_name, substring_recall, token_recall,
       prediction IN ('No answer generated', 'Error generating answer') AS is_sentinel
FROM scored"""

    q["q05_run_grid"] = """
WITH m AS (SELECT n_name AS model, lower(replace(n_name, ' ', '_')) AS model_stem FROM nation),
     d AS (SELECT r_name AS dataset, lower(replace(r_name, ' ', '_')) AS dataset_stem FROM region)
SELECT model, model_stem, dataset, dataset_stem, 'no_context' AS experiment_mode,
       concat_ws('_', model, dataset, 'no_context') AS run_name,
       concat_ws('_', model_stem, dataset_stem, 'no_context') AS task_id,
       'no_context/' || concat_ws('_', model, dataset, 'no_context') AS output_dir,
       'no-context' AS bucket
FROM m CROSS JOIN d"""

    q["q06_metric_long"] = """
WITH w AS (
  SELECT l_returnflag AS run_id,
         round(avg(l_discount), 6) AS substring_recall, round(avg(l_tax), 6) AS token_recall,
         count(*)::DOUBLE AS num_examples, sum(l_quantity)::DOUBLE AS duration_seconds,
         max(l_extendedprice)::DOUBLE AS cpu_ram_used_mb,
         count(DISTINCT l_orderkey)::DOUBLE AS model_size_bytes
  FROM lineitem GROUP BY l_returnflag)
SELECT run_id, 'substring_recall' AS metric, substring_recall AS value, 'quality' AS category,
       printf('%.4f', substring_recall) AS display FROM w
UNION ALL SELECT run_id, 'token_recall', token_recall, 'quality', printf('%.4f', token_recall) FROM w
UNION ALL SELECT run_id, 'num_examples', num_examples, 'other', num_examples::BIGINT::VARCHAR FROM w
UNION ALL SELECT run_id, 'duration_seconds', duration_seconds, 'other', printf('%.2f', duration_seconds) FROM w
UNION ALL SELECT run_id, 'cpu_ram_used_mb', cpu_ram_used_mb, 'memory', printf('%.2f', cpu_ram_used_mb) FROM w
UNION ALL SELECT run_id, 'model_size_bytes', model_size_bytes, 'size', format('{:,}', model_size_bytes::BIGINT) FROM w"""

    size_txt = """CASE WHEN p_size % 4 = 0 THEN (p_size * 15)::VARCHAR || 'M'
                   WHEN p_size % 4 = 1 THEN (p_size // 10)::VARCHAR || '.' || (p_size % 10)::VARCHAR || 'B'
                   WHEN p_size % 4 = 2 THEN p_type
                   ELSE p_size::VARCHAR || 'B' END"""
    s_ = strip("replace(model_size, 'B', '')")
    q["q07_memory_plan"] = f"""
WITH m AS (SELECT p_partkey, p_name AS model_name, {size_txt} AS model_size, p_size FROM part),
     e AS (SELECT p_partkey,
             CASE WHEN TRY_CAST({s_} AS DOUBLE) IS NOT NULL THEN TRY_CAST({s_} AS DOUBLE) * 2.5
                  WHEN contains({s_}, '0.6') OR contains(lower(model_name), '135m') THEN 2.0
                  WHEN contains({s_}, '1.7') OR contains(lower(model_name), '360m') THEN 4.0
                  WHEN contains({s_}, '4') THEN 9.0
                  ELSE 3.0 END AS est
           FROM m WHERE p_size <= 40)
SELECT m.p_partkey, m.model_name, m.model_size, coalesce(e.est, 3.0) AS estimated_memory_gb
FROM m LEFT JOIN e ON e.p_partkey = m.p_partkey"""

    q["q09_context_stats"] = """
WITH j AS (SELECT d.lang AS context_type, coalesce(l.quality, 0) AS recall, l.quality AS gt
           FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
SELECT context_type, grouping(context_type) = 1 AS is_total, count(*)::BIGINT AS count,
       sum(recall)::DOUBLE AS total_recall, count(gt)::BIGINT AS has_ground_truth,
       sum(recall)::DOUBLE / count(*) AS avg_recall, count(gt)::DOUBLE / count(*) AS ground_truth_ratio
FROM j GROUP BY ROLLUP (context_type)"""

    q["q10_distinct_models"] = """
WITH d AS (SELECT DISTINCT lang, source FROM documents WHERE source IS NOT NULL)
SELECT lang, source,
       row_number() OVER (PARTITION BY lang ORDER BY source)::BIGINT AS value_rank,
       count(*) OVER (PARTITION BY lang)::BIGINT AS n_distinct
FROM d"""

    samples = """
  s AS (SELECT user_id, ts, event_id,
          CASE WHEN event_type = 'view' THEN value END AS cpu_ram_used_mb,
          CASE WHEN event_type = 'click' THEN value END AS gpu_ram_used_mb,
          CASE WHEN event_type = 'purchase' THEN value END AS gpu_ram_peak_mb,
          CASE WHEN event_type = 'signup' THEN value END AS reserved_gpu_ram_mb,
          CASE WHEN event_type = 'error' THEN value END AS gpu_power_draw_w,
          CASE WHEN event_type = 'error' THEN json_extract(props, '$.k')::DOUBLE END AS gpu_power_limit_w
        FROM events)"""
    peaks = """
  p AS (SELECT user_id,
          max(coalesce(cpu_ram_used_mb, 0.0)) AS cpu_ram_used_mb,
          max(coalesce(gpu_ram_used_mb, 0.0)) AS gpu_ram_used_mb,
          max(coalesce(gpu_ram_peak_mb, 0.0)) AS gpu_ram_peak_mb,
          max(coalesce(reserved_gpu_ram_mb, 0.0)) AS reserved_gpu_ram_mb,
          coalesce(max(gpu_power_draw_w) FILTER (WHERE gpu_power_draw_w <> 0), 0.0) AS gpu_power_draw_w,
          coalesce(arg_max(gpu_power_limit_w, struct_pack(t := ts, e := event_id))
                   FILTER (WHERE gpu_power_limit_w <> 0), 0.0) AS gpu_power_limit_w,
          count(*)::BIGINT AS n_samples
        FROM s GROUP BY user_id)"""
    q["q11_peaks"] = f"WITH {samples}, {peaks} SELECT * FROM p"

    q["q12_run_record"] = f"""
WITH {SCORED_PAIRS}, {samples}, {peaks},
  runs AS (SELECT DISTINCT conv_id AS run_id FROM conversations),
  qual AS (SELECT r.run_id, coalesce(avg(x.substring_recall), 0.0) AS sr,
                  coalesce(avg(x.token_recall), 0.0) AS tr, count(x.conv_id)::BIGINT AS n
           FROM runs r LEFT JOIN scored x ON x.conv_id = r.run_id GROUP BY r.run_id),
  dur AS (SELECT user_id, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS d FROM events GROUP BY user_id)
SELECT qual.run_id, round(sr, 6) AS substring_recall, round(tr, 6) AS token_recall, n AS num_examples,
       coalesce(dur.d, 0.0) AS duration_seconds, 1024::BIGINT AS model_size_bytes,
       1024 / 1048576.0 AS model_size_mb, 0::BIGINT AS retriever_index_size_bytes,
       0.0::DOUBLE AS retriever_index_size_mb,
       coalesce(p.cpu_ram_used_mb, 0.0) AS cpu_ram_used_mb, coalesce(p.gpu_ram_used_mb, 0.0) AS gpu_ram_used_mb,
       coalesce(p.gpu_ram_peak_mb, 0.0) AS gpu_ram_peak_mb,
       coalesce(p.reserved_gpu_ram_mb, 0.0) AS reserved_gpu_ram_mb,
       coalesce(p.gpu_power_draw_w, 0.0) AS gpu_power_draw_w,
       coalesce(p.gpu_power_limit_w, 0.0) AS gpu_power_limit_w
FROM qual LEFT JOIN dur ON dur.user_id = qual.run_id LEFT JOIN p ON p.user_id = qual.run_id"""

    latest = """
  st AS (SELECT user_id, ts, event_id, props,
           CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed'
                           WHEN 'click' THEN 'running' WHEN 'view' THEN 'running'
                           WHEN 'signup' THEN 'queued' END AS status
         FROM events),
  lt AS (SELECT user_id,
           arg_max(status, struct_pack(t := ts, e := event_id)) AS status,
           arg_max(props, struct_pack(t := ts, e := event_id)) AS props,
           count(*) FILTER (WHERE status = 'failed')::BIGINT AS attempts_failed
         FROM st GROUP BY user_id)"""
    q["q13_batch_rollup"] = f"""
WITH {latest},
  c AS (SELECT count(*) FILTER (WHERE status = 'completed')::BIGINT AS completed,
               count(*) FILTER (WHERE status = 'failed')::BIGINT AS failed,
               count(*) FILTER (WHERE status = 'running')::BIGINT AS running,
               count(*) FILTER (WHERE status = 'queued')::BIGINT AS remaining FROM lt)
SELECT completed, failed, running, remaining, (completed + failed + running + remaining)::BIGINT AS total,
       CASE WHEN completed + failed + running + remaining > 0
            THEN completed * 100.0 / (completed + failed + running + remaining) ELSE 0.0 END::DOUBLE AS progress_pct
FROM c"""
    q["q13b_failed_runs"] = f"""
WITH {latest}
SELECT user_id, attempts_failed AS attempts, props AS failure_reason FROM lt WHERE status = 'failed'"""

    pred14 = "CASE WHEN len(" + words("a.text") + ") < 8 THEN 'No answer generated' ELSE a.text END"
    q["q14_sentinels"] = f"""
WITH p AS (
  SELECT u.conv_id, u.turn, u.text AS question, {pred14} AS prediction
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')
SELECT conv_id, turn, prediction IN ('No answer generated', 'Error generating answer') AS is_sentinel,
       {substring_recall_list('lower(prediction)', "[question, 'No']")} AS substring_recall,
       {token_recall_list(tokens('prediction'), "[question, 'No']")} AS token_recall
FROM p"""

    q["q15_latest_value"] = """
SELECT user_id, event_type, arg_max(value, struct_pack(t := ts, e := event_id)) AS latest_value,
       arg_max(ts, struct_pack(t := ts, e := event_id)) AS latest_ts,
       arg_max(event_id, struct_pack(t := ts, e := event_id)) AS latest_event_id, count(*)::BIGINT AS n_writes
FROM events GROUP BY user_id, event_type"""

    q["q16_progress"] = f"""
WITH {SCORED_PAIRS},
  r AS (SELECT (conv_id % 2)::BIGINT AS run, conv_id, turn, substring_recall FROM scored),
  w AS (SELECT run, conv_id, turn,
          row_number() OVER (PARTITION BY run ORDER BY conv_id, turn)::BIGINT AS position,
          count(*) OVER (PARTITION BY run)::BIGINT AS run_count,
          avg(substring_recall) OVER (PARTITION BY run ORDER BY conv_id, turn
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rm
        FROM r)
SELECT run, conv_id, turn, position, run_count, round(rm, 6) AS running_mean,
       round(position * 100.0::DOUBLE / run_count, 6) AS progress_pct, position % 100 = 0 AS is_report
FROM w WHERE position = 1 OR position % 10 = 0"""

    q["q16b_running_nulls"] = """
WITH e AS (SELECT nullif(event_type, 'error') AS run, ts, event_id,
             CASE WHEN event_id % 3 <> 0 THEN value::DECIMAL(18,4) END AS value FROM events)
SELECT run, event_id, row_number() OVER (PARTITION BY run ORDER BY ts, event_id)::BIGINT AS position,
       count(*) OVER (PARTITION BY run)::BIGINT AS run_count,
       (sum(value) OVER (PARTITION BY run ORDER BY ts, event_id
                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::DOUBLE AS running_sum
FROM e"""

    q["q17_series"] = f"""
WITH {SCORED_PAIRS},
  r AS (SELECT (conv_id % 2)::BIGINT AS run,
               (row_number() OVER (PARTITION BY conv_id % 2 ORDER BY conv_id, turn) - 1)::BIGINT AS iteration,
               substring_recall, token_recall FROM scored)
SELECT run, 'Training Progress' AS title, 'substring_recall' AS series, iteration, substring_recall AS value FROM r
UNION ALL
SELECT run, 'Training Progress', 'token_recall', iteration, token_recall FROM r"""

    q["q17b_telemetry_series"] = """
WITH r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS iteration,
                  value, json_extract(props, '$.k')::DOUBLE AS k FROM events)
SELECT user_id, 'telemetry' AS title, 'value' AS series, iteration, value FROM r
UNION ALL SELECT user_id, 'telemetry', 'k', iteration, k FROM r"""

    q["q18_preview"] = """
WITH r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id)::BIGINT AS position,
                  count(*) OVER (PARTITION BY lang)::BIGINT AS run_count FROM documents)
SELECT lang, doc_id, position, run_count, greatest(run_count - 100, 0)::BIGINT AS n_more
FROM r WHERE position <= 100"""

    q["q19_recall_join"] = f"""
WITH b AS (SELECT item_id, {tokens('text')} AS t FROM benchmark),
     d AS (SELECT doc_id, {tokens('text')} AS dt FROM documents),
     x AS (SELECT item_id, doc_id, len(list_intersect(t, dt))::BIGINT AS overlap, len(t)::BIGINT AS n_tokens
           FROM b, d WHERE len(t) > 0)
SELECT item_id, doc_id, overlap, n_tokens, overlap::DOUBLE / n_tokens AS token_recall
FROM x WHERE overlap::DOUBLE / n_tokens >= 0.8"""

    q["q20_retrieve_dense"] = """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n
           FROM embeddings),
     s AS (SELECT a.vec_id AS query_id, b.vec_id AS context_id,
                  CASE WHEN a.n > 0 AND b.n > 0 THEN list_dot_product(a.v, b.v) / (a.n * b.n) ELSE 0.0 END AS score
           FROM e a, e b WHERE a.vec_id <> b.vec_id),
     r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, context_id)::BIGINT AS rank FROM s)
SELECT query_id, rank, context_id, round(score, 6) AS score FROM r WHERE rank <= 3"""

    q["q20b_dense_index"] = q["q20_retrieve_dense"]

    q["q21_retrieve_lexical"] = f"""
WITH b AS (SELECT item_id, {tokens('text')} AS t FROM benchmark),
     d AS (SELECT doc_id, {tokens('text')} AS dt FROM documents),
     s AS (SELECT item_id AS query_id, doc_id AS context_id,
                  CASE WHEN len(t) = 0 THEN 0.0 ELSE len(list_intersect(t, dt))::DOUBLE / len(t) END AS score
           FROM b, d),
     r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, context_id)::BIGINT AS rank FROM s)
SELECT query_id, rank, context_id, score FROM r WHERE rank <= 3"""

    q["q21b_retrieve_from_index"] = q["q21_retrieve_lexical"]

    q["q21c_index_size"] = f"""
WITH p AS (SELECT doc_id, unnest({tokens('text')}) AS token FROM documents)
SELECT count(*)::BIGINT AS postings, count(DISTINCT token)::BIGINT AS tokens, sum(strlen(token))::BIGINT AS token_bytes FROM p"""

    q["q22_tokens"] = f"""
SELECT doc_id, len({words('text')})::BIGINT AS n_words, len({tokens('text')})::BIGINT AS n_tokens
FROM documents"""

    q["q24_multi_answer"] = f"""
WITH f AS (SELECT conv_id, arg_min(text, turn) AS prediction FROM conversations WHERE role = 'user' GROUP BY conv_id),
     t AS (SELECT conv_id, list(text) AS truths FROM conversations WHERE role = 'assistant' GROUP BY conv_id)
SELECT f.conv_id,
       {substring_recall_list('lower(f.prediction)', 't.truths')} AS substring_recall,
       {token_recall_list(tokens('f.prediction'), 't.truths')} AS token_recall,
       len(t.truths)::BIGINT AS n_truths
FROM f JOIN t ON t.conv_id = f.conv_id"""

    ctx = """
  u AS (SELECT conv_id, turn, text AS question FROM conversations WHERE role = 'user'),
  pr AS (SELECT conv_id, turn + 1 AS turn, text AS ctx FROM conversations WHERE role = 'assistant'),
  j AS (SELECT u.conv_id, u.turn, u.question, pr.ctx FROM u LEFT JOIN pr ON pr.conv_id = u.conv_id AND pr.turn = u.turn)"""
    tmpl = "'Context:' || chr(10) || '{context}' || chr(10) || chr(10) || 'Question: {question}'"
    filled = f"CASE WHEN ctx IS NOT NULL THEN replace(replace({tmpl}, '{{context}}', ctx), '{{question}}', question) " \
             f"ELSE replace({tmpl}, '{{question}}', question) END"
    q["q25_prompts"] = f"""
WITH {ctx}
SELECT conv_id, turn,
       'Question: ' || question || chr(10) || 'Answer:' AS prompt_plain,
       {filled} AS prompt_ctx,
       'Answer briefly.' || chr(10) || chr(10) || {filled} AS prompt_sys
FROM j"""

    q["q26_messages"] = f"""
WITH {ctx},
  sy AS (SELECT conv_id, arg_min(text, turn) AS system_prompt FROM conversations WHERE role = 'system' GROUP BY conv_id),
  m AS (SELECT j.conv_id, j.turn,
          CASE WHEN sy.system_prompt IS NOT NULL AND sy.system_prompt <> '' THEN sy.system_prompt
               WHEN j.ctx IS NOT NULL THEN 'Context: ' || j.ctx END AS sys_content,
          j.question
        FROM j LEFT JOIN sy ON sy.conv_id = j.conv_id)
SELECT conv_id, turn, 0::BIGINT AS msg_pos, 'system' AS role, sys_content AS content FROM m WHERE sys_content IS NOT NULL
UNION ALL
SELECT conv_id, turn, (CASE WHEN sys_content IS NOT NULL THEN 1 ELSE 0 END)::BIGINT, 'user', question
FROM m WHERE question IS NOT NULL"""

    raw = "('  <THINK>' || question || '</think>' || chr(10) || prediction || chr(9) || '<think/> ' || chr(160))"
    cleaned = collapse(
        "regexp_replace(regexp_replace(regexp_replace(" + collapse(raw) + ", '(?is)<think>.*?</think>', '', 'g'), "
        f"'(?i)<think{WS}*/>', '', 'g'), '(?i)</?think>', '', 'g')")
    q["q27_clean"] = f"""
WITH {PAIRS}, c AS (SELECT conv_id, turn, {cleaned} AS c FROM pairs)
SELECT conv_id, turn, CASE WHEN c = '' THEN 'No answer generated' ELSE c END AS cleaned FROM c"""

    q["q28_gpu_utilisation"] = """
WITH s AS (SELECT user_id AS gpu, ts, json_extract(props, '$.k')::DOUBLE / 4.0 AS total_gb, value FROM events),
     f AS (SELECT gpu, ts, total_gb, total_gb - least(value / 20.0, total_gb) AS free_gb FROM s),
     u AS (SELECT gpu, ts, total_gb, total_gb - free_gb AS used_gb FROM f),
     p AS (SELECT gpu, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, used_gb,
                  CASE WHEN total_gb <> 0 THEN used_gb * 100.0 / total_gb ELSE 0.0 END AS usage_pct FROM u)
SELECT gpu, day, max(usage_pct) AS max_usage_pct, max(used_gb) AS max_used_gb,
       count(*) FILTER (WHERE usage_pct > 5.0)::BIGINT AS busy_samples, count(*)::BIGINT AS n_samples
FROM p GROUP BY gpu, day"""

    q["q29_power"] = """
WITH e AS (SELECT event_id, value, json_extract(props, '$.k')::DOUBLE AS lim FROM events),
     p AS (SELECT event_id, CASE WHEN lim IS NOT NULL AND lim <> 0 THEN value * 100.0 / lim ELSE 0.0 END AS power_pct
           FROM e)
SELECT event_id, power_pct, power_pct > 90.0 AS power_warn FROM p"""

    q["q30_object_paths"] = """
WITH p AS (SELECT page_id, regexp_extract(url, '^[a-zA-Z0-9]+://([^/]*)', 1) AS bucket,
                  regexp_extract(url, '^[a-zA-Z0-9]+://[^/]*/(.*)$', 1) AS key FROM pages)
SELECT page_id, bucket, key, translate(key, '/\\', '__') AS stem, translate(key, '/ ', '__') AS series,
       lower(replace(bucket, '_', '-')) AS bucket_name,
       's3://' || lower(replace(bucket, '_', '-')) || '/' || translate(key, '/\\', '__') || '/experiment_results/'
         || translate(translate(key, '/\\', '__'), '/\\', '__') || '_metrics.json' AS results_path
FROM p"""

    nl = "chr(10)"
    plain = f"(question || {nl} || 'Answer: ' || prediction)"
    chat = (f"('<|im_start|>user' || {nl} || question || '<|im_end|>' || {nl} || '<|im_start|>assistant' || {nl} "
            f"|| prediction || '<|im_end|>' || {nl})")
    after_marker = strip(f"string_split({plain}, 'Answer:')[-1]")
    after_prompt = strip("substring(question || prediction, length(question) + 1)")
    from_chat = strip(f"regexp_replace({strip(f'string_split({chat}, {chr(39)}<|im_start|>assistant{chr(39)})[-1]')}, "
                      "'(?s)<\\|im_end\\|>.*$', '')")
    q["q31_extract_answer"] = f"""
WITH {PAIRS}
SELECT conv_id, turn, {after_marker} AS after_marker, {after_prompt} AS after_prompt, {from_chat} AS from_chat
FROM pairs"""

    q["q32_flatten_config"] = """
SELECT event_id, 'model' AS section, 'name' AS key, event_type AS value FROM events
UNION ALL SELECT event_id, 'model', 'size', user_id::VARCHAR FROM events
UNION ALL SELECT event_id, 'seed', NULL, json_extract(props, '$.k')::VARCHAR FROM events"""

    q["q33_ingest"] = f"""
SELECT conv_id::VARCHAR || '.' || turn::VARCHAR AS question_id, text AS question,
       CASE WHEN role = 'assistant' THEN (CASE WHEN {strip('text')} <> '' THEN 1 ELSE 0 END)
            WHEN role = 'user' THEN (CASE WHEN {strip("' ' || text || ' '")} <> '' THEN 1 END)
       END::BIGINT AS n_answers,
       CASE WHEN role = 'assistant' THEN (CASE WHEN {strip('text')} <> '' THEN text ELSE '' END)
            WHEN role = 'user' AND {strip("' ' || text || ' '")} <> '' THEN {strip("' ' || text || ' '")}
       END AS answer_text,
       CASE WHEN role = 'assistant' THEN {strip('text')} <> ''
            WHEN role = 'user' THEN {strip("' ' || text || ' '")} <> '' ELSE false END AS scorable
FROM conversations WHERE text IS NOT NULL AND text <> ''"""

    q["q34_sql_recalls"] = q["q23_recalls"]

    tmpl = "'Context:' || chr(10) || '{context}' || chr(10) || chr(10) || 'Question: {question}'"
    q["q35_context_prompts"] = f"""
WITH b AS (SELECT item_id, text, {tokens('text')} AS t FROM benchmark),
     d AS (SELECT doc_id, text, {tokens('text')} AS dt FROM documents),
     s AS (SELECT b.item_id AS query_id, d.doc_id AS context_id, d.text AS ctx,
                  CASE WHEN len(t) = 0 THEN 0.0 ELSE len(list_intersect(t, dt))::DOUBLE / len(t) END AS score
           FROM b, d),
     r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, context_id) AS rank FROM s),
     c AS (SELECT query_id, count(*)::BIGINT AS n_contexts, string_agg(ctx, chr(10) ORDER BY rank) AS ctx_text
           FROM r WHERE rank <= 3 GROUP BY query_id)
SELECT c.query_id, c.n_contexts,
       replace(replace({tmpl}, '{{context}}', c.ctx_text), '{{question}}', b.text) AS prompt
FROM c JOIN benchmark b ON b.item_id = c.query_id"""

    q["q36_telemetry_lines"] = """
WITH e AS (SELECT event_id, user_id::BIGINT AS gpu_index, value AS power_draw,
                  json_extract(props, '$.k')::DOUBLE AS power_limit FROM events)
SELECT event_id, gpu_index, power_draw, power_limit,
       CASE WHEN power_limit IS NOT NULL AND power_limit <> 0 THEN power_draw * 100.0 / power_limit ELSE 0.0 END
         AS power_pct,
       power_draw / 1024.0 AS memory_gb
FROM e"""

    const = "'Test answer'"
    q["q37_evaluate_constant"] = f"""
WITH u AS (SELECT conv_id, turn, text AS question FROM conversations WHERE role = 'user'),
     a AS (SELECT conv_id, turn - 1 AS turn, text AS reply FROM conversations WHERE role = 'assistant'),
     i AS (SELECT u.question, a.reply FROM u LEFT JOIN a ON a.conv_id = u.conv_id AND a.turn = u.turn),
     s AS (SELECT {substring_recall_one('lower(' + const + ')', 'reply')} AS sr,
                  {token_recall_one(tokens(const), 'reply')} AS tr
           FROM i WHERE question IS NOT NULL AND question <> '' AND reply IS NOT NULL)
SELECT 'constant_conversations_no_context' AS run_id,
       round(coalesce((SELECT avg(sr) FROM s), 0.0), 6) AS substring_recall,
       round(coalesce((SELECT avg(tr) FROM s), 0.0), 6) AS token_recall,
       (SELECT count(*) FROM s)::BIGINT AS num_examples,
       0.0::DOUBLE AS duration_seconds, 1024::BIGINT AS model_size_bytes, 1024 / 1048576.0::DOUBLE AS model_size_mb,
       0::BIGINT AS retriever_index_size_bytes,
       (SELECT count(*) FROM i)::BIGINT AS dataset_eval_size,
       (SELECT count(*) FROM i WHERE question IS NOT NULL AND question <> '' AND reply IS NOT NULL)::BIGINT
         AS dataset_valid_count,
       (SELECT count(*) FROM i WHERE question IS NOT NULL AND question <> '' AND reply IS NOT NULL)::BIGINT
         AS dataset_to_process"""

    q["q38_prediction_records"] = f"""
WITH {PAIRS}
SELECT conv_id AS run_id, turn::VARCHAR AS question_id, question, coalesce(question, '') AS ground_truth, prediction AS predicted_answer
FROM pairs"""

    q["q39_metric_records"] = f"""
SELECT *, conv_id::VARCHAR AS experiment_name, '2024-01-01T00:00:00' AS timestamp, '1.0' AS format_version
FROM ({q["q08_run_quality"]})"""

    q["q40_config_records"] = """
SELECT event_id AS run_id, json_object('event_type', event_type, 'user_id', user_id)::VARCHAR AS config FROM events"""

    q["q41_series_records"] = """
SELECT user_id AS run_id, 'usage_' || translate(event_type, '/ ', '__') AS title,
       'k_of_' || translate(event_type, '/ ', '__') AS series, event_id AS iteration, value FROM events"""

    q["q42_single_values"] = """
SELECT user_id AS run_id, event_type, arg_max(value, (ts, event_id)) AS latest_value FROM events GROUP BY user_id, event_type"""

    q["q43_table_records"] = """
SELECT source AS run_id, 'documents' AS title, 'by source' AS series, 1::BIGINT AS iteration, 'doc_id,lang,n_chars' AS columns,
       count(*)::BIGINT AS n_rows, '2024-01-01T00:00:00' AS timestamp FROM documents GROUP BY source"""

    q["q44_manifest"] = """
SELECT source || '_' || lang AS name, '/in/' || source AS original_path, '/out/' || source AS saved_path,
       '2024-01-01T00:00:00' AS timestamp, json_object('kind', 'texts', 'lang', lang, 'n', count(*))::VARCHAR AS metadata
FROM documents GROUP BY source, lang"""

    q["q45_live_pairs"] = f"""
WITH pairs AS (
    SELECT a.conv_id, a.text AS prediction, u.text AS truth, u.conv_id IS NOT NULL AS paired
    FROM conversations a LEFT JOIN conversations u
      ON u.conv_id = a.conv_id AND u.turn = a.turn + 1 AND u.role = 'user'
    WHERE a.role = 'assistant'),
  scored AS (
    SELECT conv_id, paired,
           CASE WHEN paired THEN {substring_recall_list("lower(coalesce(prediction, ''))", "[truth]")} END AS substring_recall,
           CASE WHEN paired THEN {token_recall_list(tokens("coalesce(prediction, '')"), "[truth]")} END AS token_recall
    FROM pairs)
SELECT conv_id, round(coalesce(avg(substring_recall), 0.0), 6) AS substring_recall, round(coalesce(avg(token_recall), 0.0), 6) AS token_recall,
       count(*) FILTER (WHERE paired)::BIGINT AS num_examples, count(*) FILTER (WHERE NOT paired)::BIGINT AS num_missing
FROM scored GROUP BY conv_id"""

    q["q46_stored_answers"] = """
WITH t AS (SELECT conv_id, turn::BIGINT AS turn, text, length(coalesce(text, '')) AS n FROM conversations),
     known AS (SELECT DISTINCT text FROM t WHERE turn = 0 AND n % 7 <> 0)
SELECT t.conv_id, t.turn, CASE WHEN n % 7 = 0 THEN 'Error generating answer' ELSE n::VARCHAR || ' characters' END AS raw_answer,
       CASE WHEN n % 7 = 0 THEN 'ValueError: no answer' END AS error,
       EXISTS (SELECT 1 FROM known WHERE known.text IS NOT DISTINCT FROM t.text) AS was_known
FROM t"""

    after_split = strip(f"string_split_regex(chat, '(?i)assistant{WS}*:?{WS}*')[-1]")
    opened = "opened"
    for phrase in ("Step-by-Step Explanation:", "Let me think", "First,"):     # the rest goes up to the next word character
        opened = f"regexp_replace({opened}, '(?i){phrase}[^\\p{{L}}\\p{{N}}_]*([\\p{{L}}\\p{{N}}_])', '\\1', 'g')"
    q["q47_answer_cleanup"] = f"""
WITH c AS (SELECT conv_id, turn::BIGINT AS turn, role, coalesce(text, '') AS t FROM conversations),
     x AS (SELECT *, 'user: q' || chr(10) || CASE WHEN turn % 2 = 0 THEN 'Assistant : ' ELSE 'assistant' || chr(10) END || t AS chat,
                  ['Step-by-Step Explanation: ... ', 'let me think  -- ', 'First, '][turn % 3 + 1] || '[' || t AS opened FROM c)
SELECT conv_id, turn, role, {after_split} AS from_chat, {opened} AS opened,
       'No answer generated' AS emptied, role || ' ' || turn::VARCHAR || ' ' || t AS joined
FROM x"""

    default = ("CASE WHEN ctx IS NOT NULL THEN 'Context: ' || ctx || chr(10) || chr(10) ELSE '' END "
               "|| 'Question: ' || question || chr(10) || 'Answer:'")
    q["q48_default_prompts"] = f"""
WITH {ctx}
SELECT conv_id, turn, {default} AS prompt, 'Answer briefly.' || chr(10) || chr(10) || {default} AS prompt_sys FROM j"""

    return q


ORACLE_SQL = _sql()
