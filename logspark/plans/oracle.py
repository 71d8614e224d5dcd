"""DuckDB SQL that states the result of a registered query independently of its Spark plan."""

from __future__ import annotations

import re

from logspark.functions.text import CLEAN_PATTERNS, LINE_PATTERN, SERVICE_PREFIX, TEMPLATE_PATTERNS

#: Words of the token column, written out here so that the library cannot be its own judge.
WORDS = r"\[[A-Z]+\]|[\p{L}\p{N}_]+"

ORACLES: dict[str, str] = {}


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _replace(expr: str, patterns: list[tuple[str, str]]) -> str:
    for pattern, tag in patterns:
        expr = f"regexp_replace({expr}, {_q(pattern)}, {_q(tag)}, 'g')"
    return expr


def generalize(expr: str) -> str:
    present = f"coalesce({expr}, '')"
    return f"trim({_replace(present, TEMPLATE_PATTERNS)}, ' ')"


def strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^\\s+|\\s+$', '', 'g')"


def clean(expr: str) -> str:
    named = f"regexp_replace({strip(f'lower({expr})')}, {_q(SERVICE_PREFIX)}, '[SERVICE] ')"
    return f"trim({_replace(named, CLEAN_PATTERNS)}, ' ')"


EPOCH = "epoch_us(ts) / 1e6"

CTES: dict[str, str] = {
    "log_lines": f"""
        SELECT event_id AS line_no, {EPOCH} AS timestamp, 'svc-' || (user_id % 4) AS service,
               CAST(user_id AS VARCHAR) AS session_id,
               CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' ELSE 'INFO' END AS level,
               concat_ws(' ', strftime(ts, '%Y-%m-%d %H:%M:%S'),
                   CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' ELSE 'INFO' END,
                   event_type, 'blk_' || event_id, 'src 10.0.' || (user_id % 256) || '.' || (event_id % 256) || ':8080',
                   'file /api/' || event_type || '/' || (user_id % 7), 'retry ' || (user_id % 5),
                   'value=' || CAST(floor(value) AS BIGINT)) AS message,
               CAST(event_type = 'error' AS INTEGER) AS label
        FROM events""",
    "doc_lines": """
        SELECT doc_id, i - 1 AS line_no, parts[i] AS line
        FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents), unnest(range(1, len(parts) + 1)) AS u(i)""",
    "lines": """
        SELECT row_number() OVER (ORDER BY doc_id, line_no) - 1 AS line_no, line
        FROM (SELECT -1 AS doc_id, line_no, message AS line FROM log_lines UNION ALL SELECT doc_id, line_no, line FROM doc_lines)""",
    "texts": """
        SELECT 'log' AS source, line_no AS id, message FROM log_lines
        UNION ALL SELECT 'document', doc_id, text FROM documents
        UNION ALL SELECT 'page', page_id, html FROM pages""",
    "templated": f"SELECT *, {generalize('message')} AS template_text FROM log_lines",
    "doc_templates": f"SELECT doc_id, line_no, {generalize('line')} AS template_text FROM doc_lines",
    "doc_stats": "SELECT template_text, count(*) AS count FROM doc_templates GROUP BY template_text",
    "doc_dictionary": """
        SELECT row_number() OVER (ORDER BY template_text) AS template_id, template_text
        FROM (SELECT DISTINCT template_text FROM doc_templates)""",
    "normal_dictionary": """
        SELECT row_number() OVER (ORDER BY template_text) AS template_id, template_text
        FROM (SELECT DISTINCT template_text FROM templated WHERE label = 0)""",
    "dictionary": """
        SELECT row_number() OVER (ORDER BY template_text) AS template_id, template_text
        FROM (SELECT DISTINCT event_type AS template_text FROM events)""",
    "tokens": f"""
        SELECT event_id AS line_no, {EPOCH} AS timestamp, 'svc-' || (user_id % 4) AS service,
               CAST(user_id AS VARCHAR) AS session_id, 'svc-' || (user_id % 4) || ':' || user_id AS stream_key,
               template_id, template_id + 2 AS token_id, CAST(event_type = 'error' AS INTEGER) AS label
        FROM events JOIN dictionary ON template_text = event_type""",
    "roles": """
        SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS line_no, dense_rank() OVER (ORDER BY role) AS template_id
        FROM conversations""",
    "order_tokens": """
        SELECT CAST(l_orderkey AS VARCHAR) AS session_id, l_shipdate, l_linenumber, l_partkey, l_suppkey,
               dense_rank() OVER (ORDER BY l_returnflag || l_linestatus) AS template_id
        FROM lineitem""",
    "scores": f"""
        SELECT event_id AS item_id, {EPOCH} AS timestamp, 'svc-' || (user_id % 4) AS service,
               CAST(user_id AS VARCHAR) AS session_id, value AS score,
               CAST(json_extract_string(props, '$.k') AS DOUBLE) AS score_b, CAST(event_type = 'error' AS INTEGER) AS label
        FROM events""",
    "model_scores": """
        SELECT item_id, label, 'a' AS model, score FROM scores UNION ALL SELECT item_id, label, 'b', score_b FROM scores""",
    "model_p95": "SELECT model, quantile_cont(score, 0.95) AS threshold FROM model_scores WHERE label = 0 GROUP BY model",
    "counts": "SELECT session_id, template_id AS token, count(*) AS cnt FROM tokens GROUP BY ALL",
    "scalars": """
        SELECT session_id, CAST(sum(cnt) AS BIGINT) AS sequence_length, count(*) AS unique_count,
               count(*) / sum(cnt) AS unique_ratio
        FROM counts GROUP BY session_id""",
    "pairs": """
        SELECT * FROM (SELECT session_id, template_id AS token,
                              lead(template_id) OVER (PARTITION BY session_id ORDER BY timestamp, line_no) AS next_token
                       FROM tokens) WHERE next_token IS NOT NULL""",
    "pair_counts": "SELECT session_id, token, next_token, count(*) AS cnt FROM pairs GROUP BY ALL",
    "session_split": """
        SELECT session_id, CASE WHEN rn <= nt THEN 'test' WHEN rn <= nt + nt THEN 'val' ELSE 'train' END AS split
        FROM (SELECT session_id, row_number() OVER (ORDER BY md5(session_id), session_id) AS rn,
                     greatest(1, round_even(count(*) OVER () * 0.2, 0)) AS nt
              FROM (SELECT DISTINCT session_id FROM tokens))""",
    "vocab": "SELECT count(DISTINCT template_id) AS v FROM tokens",
    "transitions": """
        SELECT token, next_token, cnt, CAST(sum(cnt) OVER (PARTITION BY token) AS BIGINT) AS from_cnt,
               (cnt + 0.1) / (sum(cnt) OVER (PARTITION BY token) + 0.1 * v) AS prob
        FROM (SELECT token, next_token, count(*) AS cnt FROM pairs GROUP BY ALL), vocab""",
    "limit80": "SELECT quantile_cont(score, 0.8) AS threshold FROM scores WHERE label = 0",
    "risks": """
        SELECT service || ':' || session_id AS stream_key, timestamp, item_id, score AS risk_score, threshold,
               score >= threshold AS is_anomaly, CAST(score_b AS INTEGER) % 10 AS window_size
        FROM scores, limit80""",
}

SEVERITY = """CASE WHEN risk_score / greatest(threshold, 1e-9) >= 1.5 THEN 'critical'
                   WHEN risk_score / greatest(threshold, 1e-9) >= 1.2 THEN 'high'
                   WHEN risk_score / greatest(threshold, 1e-9) >= 1.0 THEN 'medium' ELSE 'low' END"""


def sql(body: str, recursive: bool = False, **local: str) -> str:
    """``body`` preceded by the shared and local common tables it refers to."""
    known = {**CTES, **local}
    # names only count where a table is read
    tables = lambda text: " ".join(re.findall(r"(?:FROM|JOIN|,)\s+([a-z_0-9]+)", text))
    seen: dict[str, None] = {}

    def visit(text: str) -> None:
        for name in re.findall(r"[a-z_0-9]+", tables(text)):
            if name in known and name not in seen:
                seen[name] = None
                visit(known[name])
                seen.pop(name)
                seen[name] = None

    visit(body)
    head = ", ".join(f"{n} AS ({known[n]})" for n in seen)
    return f"WITH {'RECURSIVE ' if recursive else ''}{head} {body}" if head else body


def oracle(name: str, body: str, **kw) -> None:
    ORACLES[name] = sql(body, **kw)


# ---- sources and sinks -------------------------------------------------------------------------

oracle("src_block_lines", f"""
    SELECT line_no, 'hdfs' AS dataset, regexp_extract(line, '(blk_-?\\d+)', 1) AS session_id, {strip('line')} AS message
    FROM lines WHERE regexp_matches(line, 'blk_-?\\d+')""")
oracle("src_chunk_sessions", f"""
    SELECT line_no, 'bgl' AS dataset, 'window_' || (line_no // 50) AS session_id, {strip('line')} AS message,
           CAST(starts_with(line, '-') AS INTEGER) AS label FROM lines""")
oracle("src_text_files", "SELECT line_no, message FROM log_lines")
oracle("scan_unified", """
    SELECT line_no, round(timestamp, 6) AS timestamp, service AS dataset, session_id, message, label FROM log_lines""")
oracle("ground_truth", "SELECT 'doc-' || doc_id AS session_id, CAST(toxic = 1 AS INTEGER) AS label FROM labels")
oracle("dq_required_columns", """
    SELECT c AS column_name, c <> 'session_id' AS present, n AS n_values, (SELECT count(*) FROM documents) AS n_rows FROM (
        SELECT 'doc_id' AS c, count(doc_id) AS n FROM documents UNION ALL SELECT 'text', count(text) FROM documents
        UNION ALL SELECT 'lang', count(lang) FROM documents UNION ALL SELECT 'source', count(source) FROM documents
        UNION ALL SELECT 'n_chars', count(n_chars) FROM documents UNION ALL SELECT 'session_id', 0)""")
oracle("sink_canonical", "SELECT line_no, round(timestamp, 6) AS timestamp, service, session_id, level, message, label FROM log_lines")
oracle("sink_results", """
    SELECT service, n, format FROM (SELECT service, count(*) AS n FROM log_lines GROUP BY service),
           (SELECT unnest(['csv', 'json', 'parquet']) AS format)""")
oracle("resolve_thresholds", """
    SELECT model, round(CASE model WHEN 'a' THEN (SELECT quantile_cont(score, 0.99) FROM scores WHERE label = 0)
                                   ELSE threshold END, 6) AS threshold, model = 'a' AS overridden FROM model_p95""")

# ---- projections and parsing -------------------------------------------------------------------

oracle("parse_text_logs", f"""
    SELECT line_no, upper(regexp_extract(message, {_q(LINE_PATTERN)}, 2)) AS level,
           {strip(f"regexp_extract(message, {_q(LINE_PATTERN)}, 3)")} AS message FROM log_lines""")
oracle("parse_json_logs", """
    SELECT event_id, CASE WHEN ok THEN floor(sec) END AS timestamp, 'default' AS service,
           CASE WHEN ok THEN upper(event_type) ELSE '' END AS level,
           CASE WHEN ok THEN 'value ' || whole ELSE substr('{"ts": ' || CAST(sec AS BIGINT) || ', "severity": "' || event_type || '", "msg":', 1, 30) END AS message,
           CASE WHEN ok THEN CAST(event_type = 'error' AS INTEGER) ELSE -1 END AS label,
           CASE WHEN ok THEN 'props,user' ELSE '' END AS meta_keys,
           CASE WHEN ok THEN CAST(user_id AS VARCHAR) ELSE '' END AS meta_user,
           CASE WHEN ok THEN CAST(user_id AS VARCHAR) ELSE '' END AS round_trip_user
    FROM (SELECT *, event_type <> 'purchase' AS ok, epoch_us(ts) // 1000000 AS sec, CAST(floor(value) AS BIGINT) AS whole FROM events)""")
oracle("normalize_schema", """
    SELECT line_no, round(timestamp, 6) AS timestamp, service, '' AS level, message, session_id, label FROM log_lines""")
oracle("generalize_message", f"SELECT source, id, {generalize('message')} AS template_text FROM texts")
oracle("clean_message", f"SELECT source, id, {clean('message')} AS cleaned FROM texts")
oracle("tokenize_message", f"""
    SELECT source, id, len(t) AS n_tokens, array_to_string(t, ' ') AS tokens
    FROM (SELECT source, id, regexp_extract_all({clean('message')}, {_q(WORDS)}) AS t FROM texts)""")
oracle("message_corpus", f"""
    SELECT doc_id, line_no, array_to_string(t, ' ') AS tokens
    FROM (SELECT doc_id, line_no, regexp_extract_all({clean('line')}, {_q(WORDS)}) AS t FROM doc_lines) WHERE len(t) > 0""")
oracle("coerce_events", """
    SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN 0.0 ELSE value END AS timestamp,
           CASE WHEN user_id % 3 <> 0 THEN user_id % 3 WHEN event_id % 2 <> 0 THEN event_id % 2 ELSE 1 END AS token_id,
           '' AS service_key_session, CAST(user_id AS VARCHAR) AS session_id FROM events""")
oracle("stream_key", """
    SELECT line_no, CASE WHEN label = 1 OR level = 'WARN' THEN 'unknown' ELSE service END || ':' ||
                    CASE WHEN level = 'WARN' THEN '' ELSE session_id END AS v1_key,
           CASE WHEN level = 'WARN' THEN service ELSE service || '/' || session_id END AS v2_key,
           service || ':' AS service_key FROM log_lines""")
oracle("event_time", "SELECT event_id AS line_no, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS event_time FROM events")
oracle("flatten_meta", """
    SELECT event_id, 'node-' || (user_id % 7) AS host, event_type AS component,
           json_extract_string(props, '$.k') AS scenario_id, '' AS phase FROM events""")

# ---- templates and tokens ----------------------------------------------------------------------

oracle("template_dictionary", """
    SELECT row_number() OVER (ORDER BY template_text) AS template_id, template_text
    FROM (SELECT template_text FROM templated UNION SELECT template_text FROM doc_templates)""")
oracle("assign_templates", """
    SELECT line_no, coalesce(d.template_id, 0) AS template_id FROM templated LEFT JOIN normal_dictionary AS d USING (template_text)""")
oracle("template_stats", """
    SELECT row_number() OVER (ORDER BY template_text) AS template_id, template_text, count(*) AS count,
           round(avg(label), 6) AS anomaly_rate FROM templated GROUP BY template_text""")
oracle("templates_per_source", """
    SELECT source, count(DISTINCT template_text) AS unique_templates FROM doc_templates JOIN documents USING (doc_id) GROUP BY source""")
oracle("top_templates", "SELECT template_text, count FROM doc_stats ORDER BY count DESC, template_text LIMIT 20")
oracle("template_freq_buckets", """
    SELECT CASE WHEN count = 1 THEN '1' WHEN count < 5 THEN '2-4' WHEN count < 10 THEN '5-9' WHEN count < 50 THEN '10-49'
                WHEN count < 100 THEN '50-99' WHEN count < 500 THEN '100-499' WHEN count < 1000 THEN '500-999'
                WHEN count < 5000 THEN '1k-4k' WHEN count < 10000 THEN '5k-9k' ELSE '10k+' END AS freq_bucket,
           count(*) AS n_templates FROM doc_stats GROUP BY 1""")
oracle("encode_tokens", """
    SELECT event_id, event_id % 9 AS template_id, CASE WHEN event_id % 9 IN (SELECT template_id FROM dictionary) THEN event_id % 9 + 2 ELSE 1 END AS token_id
    FROM events""")
oracle("decode_tokens", """
    SELECT event_id, event_id % 10 AS token_id, coalesce(d.template_id, -1) AS template_id,
           CASE WHEN event_id % 10 = 0 THEN '<PAD>' ELSE coalesce(d.template_text, '<UNK>') END AS text
    FROM events LEFT JOIN dictionary AS d ON d.template_id = event_id % 10 - 2""")
oracle("vocab_table", """
    SELECT 0 AS token_id, '<PAD>' AS text UNION ALL SELECT 1, '<UNK>' UNION ALL SELECT template_id + 2, template_text FROM dictionary""")
oracle("raw_to_token", """
    SELECT line_no, coalesce(d.template_id + 2, 1) AS token_id FROM templated LEFT JOIN normal_dictionary AS d USING (template_text)""")
FAMILIES = """
    SELECT family, 0 AS part, count(*) AS n, string_agg(template_id + 2, ',' ORDER BY template_id) AS tokens FROM (
        SELECT template_id, CASE WHEN len(w) = 0 THEN '_other' ELSE array_to_string(w[1:4], ' ') END AS family
        FROM (SELECT template_id, list_filter(string_split(template_text, ' '),
                     lambda x: x <> '' AND NOT (starts_with(x, '<') AND ends_with(x, '>'))) AS w FROM doc_dictionary))
    GROUP BY family"""
oracle("template_families", FAMILIES)

# ---- sessions and sequences --------------------------------------------------------------------

oracle("session_sequences", """
    SELECT session_id, arg_min(service, line_no) AS dataset, max(label) AS label, count(*) AS sequence_length,
           count(DISTINCT template_id) AS unique_template_count, 0 AS part,
           string_agg(template_id, ',' ORDER BY timestamp, line_no) AS sequence FROM tokens GROUP BY session_id""")
oracle("session_sequences_orders", """
    SELECT session_id, 0 AS part, string_agg(template_id, ',' ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey) AS sequence
    FROM order_tokens GROUP BY session_id""")
oracle("label_sessions", """
    SELECT CAST(doc_id AS VARCHAR) AS session_id, source, coalesce(toxic, 0) AS label FROM documents LEFT JOIN labels USING (doc_id)""")
oracle("union_sources", """
    SELECT line_no AS id, 'log' AS dataset, message, label FROM log_lines
    UNION ALL SELECT conv_id, 'talk', text, -1 FROM conversations""")
WINDOWS = """
    SELECT {keys} n, pos, list(token_id) OVER w AS tokens, list(timestamp) OVER w AS times, max(label) OVER w AS label
    FROM (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY timestamp, line_no) - 1 AS pos,
                 count(*) OVER (PARTITION BY {part}) AS n FROM tokens)
    WINDOW w AS (PARTITION BY {part} ORDER BY pos ROWS BETWEEN CURRENT ROW AND {last} FOLLOWING)"""
oracle("sliding_sequences", """
    SELECT 'window_' || pos AS sequence_id, array_to_string(tokens, ',') AS tokens, label, len(times) AS n_timestamps
    FROM cut WHERE pos % 10 = 0 AND pos < greatest(1, n - 49)""", cut=WINDOWS.format(keys="", part="1", last=49))
oracle("sliding_sequences_by_session", """
    SELECT session_id, 'window_' || pos AS sequence_id, array_to_string(tokens, ',') AS tokens, label
    FROM cut WHERE pos % 20 = 0 AND pos < greatest(1, n - 59)""", cut=WINDOWS.format(keys="session_id,", part="session_id", last=59))
oracle("parse_sequences", """
    SELECT session_id, CASE WHEN max(label) = 0 OR count(*) % 5 = 0 THEN 0 ELSE count(*) END AS n,
           CASE WHEN max(label) = 0 OR count(*) % 5 = 0 THEN 0 ELSE CAST(sum(template_id) AS BIGINT) END AS total
    FROM tokens GROUP BY session_id""")
VEC_WINDOWS = """
    SELECT pos, n, list(embedding) OVER w AS vectors, max(CAST(label <> 0 AS INTEGER)) OVER w AS label
    FROM (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS pos, count(*) OVER () AS n FROM embeddings)
    WINDOW w AS (ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)"""
oracle("embedding_windows", """
    SELECT pos AS start, len(vectors) AS n, len(flatten(vectors)) AS n_values,
           round(list_sum(list_transform(flatten(vectors), lambda x: CAST(x AS DOUBLE))), 4) AS total, label
    FROM cut WHERE pos % 5 = 0 AND pos <= n - 10""", cut=VEC_WINDOWS)
oracle("window_label_counts", """
    SELECT count(*) FILTER (label = 0) AS normal, count(*) FILTER (label <> 0) AS anomaly
    FROM cut WHERE pos % 5 = 0 AND pos <= n - 10""", cut=VEC_WINDOWS)
oracle("session_windows", """
    SELECT session_id, pos AS start, array_to_string(tokens, ',') AS tokens FROM cut WHERE pos <= n - 20""",
       cut=WINDOWS.format(keys="session_id,", part="session_id", last=19))
oracle("thinned_windows", """
    SELECT pos AS start, stride, array_to_string(tokens, ',') AS tokens
    FROM (SELECT *, greatest(1, (n - 20) // 1000) AS stride FROM cut) WHERE pos % stride = 0 AND pos <= n - 20""",
       cut=WINDOWS.format(keys="", part="1", last=19))
SAMPLE = """
    SELECT line_no, label, service FROM (
        SELECT *, row_number() OVER (PARTITION BY label, service ORDER BY md5(CAST(line_no AS VARCHAR)), line_no) AS rn FROM log_lines)
    JOIN quotas USING (label, service) WHERE rn <= quota"""
QUOTAS = """
    SELECT label, service, n, CAST(CASE WHEN r = k THEN target - coalesce(sum(share) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
           ELSE share END AS BIGINT) AS quota
    FROM (SELECT *, row_number() OVER (ORDER BY label, service) AS r, count(*) OVER () AS k,
                 round_even(n / sum(n) OVER () * target, 0) AS share
          FROM (SELECT label, service, count(*) AS n, (SELECT count(*) // 10 FROM log_lines) AS target FROM log_lines GROUP BY ALL))"""
oracle("stratified_sample", "SELECT * FROM sample", sample=SAMPLE, quotas=QUOTAS)
oracle("sample_report", """
    SELECT label, service, n AS input_rows, count(s.line_no) AS sampled_rows, round(count(s.line_no) / n, 6) AS fraction
    FROM quotas LEFT JOIN sample AS s USING (label, service) GROUP BY label, service, n""", sample=SAMPLE, quotas=QUOTAS)
oracle("split_stratified", """
    SELECT line_no, label, CASE WHEN rn <= nt THEN 'test' WHEN rn <= 2 * nt THEN 'val' ELSE 'train' END AS split
    FROM (SELECT line_no, label, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(line_no AS VARCHAR)), line_no) AS rn,
                 greatest(1, round_even(count(*) OVER (PARTITION BY label) * 0.1, 0)) AS nt FROM log_lines)""")
oracle("split_by_time", """
    SELECT line_no, CASE WHEN pos < n - nv - nt THEN 'train' WHEN pos < n - nt THEN 'val' ELSE 'test' END AS split
    FROM (SELECT line_no, row_number() OVER (ORDER BY timestamp, line_no) - 1 AS pos, count(*) OVER () AS n,
                 greatest(1, round_even(count(*) OVER () * 0.1, 0)) AS nt, greatest(1, round_even(count(*) OVER () * 0.15, 0)) AS nv
          FROM log_lines)""")
oracle("token_corpus", """
    SELECT 'sequences' AS source, count(*) AS n, string_agg(template_id, ' ' ORDER BY line_no) AS sentence FROM roles GROUP BY session_id
    UNION ALL SELECT 'sessions', count(*), string_agg(token_id, ' ' ORDER BY timestamp, line_no) FROM tokens GROUP BY session_id HAVING count(*) >= 3
    UNION ALL SELECT 'families', n, replace(tokens, ',', ' ') FROM families""", families=FAMILIES)
oracle("first_n_events", "SELECT line_no, service, label FROM log_lines ORDER BY timestamp, line_no LIMIT 500")
oracle("select_sessions", """
    SELECT session_id, label, n_events FROM picked JOIN (SELECT session_id, count(*) AS n_events FROM tokens GROUP BY 1) USING (session_id)""",
       eligible="""SELECT session_id, CAST(avg(label) > 0.25 AS INTEGER) AS label FROM tokens GROUP BY session_id HAVING count(*) >= 10""",
       halves="""SELECT *, row_number() OVER (PARTITION BY label ORDER BY session_id) <= 30 AS first_half FROM eligible""",
       picked="""SELECT session_id, label FROM (SELECT *, row_number() OVER (ORDER BY NOT first_half, session_id) AS r FROM halves) WHERE r <= 60""")
oracle("phase_labels", """
    SELECT line_no, phase, round(greatest(0.0, least(1.0, (t - n_normal) / greatest(n_deg, 1))), 6) AS progress,
           CAST(phase <> 'normal' AS INTEGER) AS phase_label, session_id || '_s' || (t // 50) AS phase_session FROM phased""",
       placed="""SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY timestamp, line_no) - 1 AS t,
                        CAST(floor(count(*) OVER (PARTITION BY session_id) * CAST(0.6 AS DOUBLE)) AS BIGINT) AS n_normal,
                        CAST(floor(count(*) OVER (PARTITION BY session_id) * CAST(0.3 AS DOUBLE)) AS BIGINT) AS n_deg FROM log_lines""",
       phased="""SELECT *, CASE WHEN t < n_normal THEN 'normal' WHEN t < n_normal + n_deg THEN 'degradation' ELSE 'failure' END AS phase FROM placed""")

# ---- session features --------------------------------------------------------------------------

oracle("session_scalars", "SELECT session_id, sequence_length, unique_count, round(unique_ratio, 6) AS unique_ratio FROM scalars")
oracle("session_entropy", """
    SELECT session_id, round(sum(-p * log2(greatest(p, 1e-12))), 6) AS entropy, round(sum(-p * log2(p + 1e-12)), 6) AS runtime_entropy
    FROM (SELECT session_id, cnt / sequence_length AS p FROM counts JOIN scalars USING (session_id)) GROUP BY session_id""")
oracle("topk_vocab", """
    SELECT template_id AS token, count(*) AS cnt FROM order_tokens GROUP BY 1 ORDER BY cnt DESC, token LIMIT 3""")
TOP_TOKENS = "SELECT token, sum(cnt) AS s FROM counts GROUP BY token ORDER BY s DESC, token LIMIT {}"
TOP_PAIRS = "SELECT token, next_token, count(*) AS s FROM pairs GROUP BY ALL ORDER BY s DESC, token, next_token LIMIT {}"
TID_LONG = """
    SELECT session_id, 'tid_' || token AS feature, CAST(cnt AS DOUBLE) AS value FROM counts WHERE token IN (SELECT token FROM top_tokens)
    UNION ALL SELECT session_id, 'tid_' || token || '_norm', cnt / sequence_length FROM counts JOIN scalars USING (session_id)
    WHERE token IN (SELECT token FROM top_tokens)"""
PAIR_LONG = """
    SELECT session_id, 'bgram_' || token || '_to_' || next_token AS feature, CAST(cnt AS DOUBLE) AS value
    FROM pair_counts JOIN top_pairs USING (token, next_token)
    UNION ALL SELECT session_id, 'bgram_' || token || '_to_' || next_token || '_norm', cnt / greatest(sequence_length - 1, 1)
    FROM pair_counts JOIN top_pairs USING (token, next_token) JOIN scalars USING (session_id)"""
TOPS = {"top_tokens": TOP_TOKENS.format(3), "top_pairs": TOP_PAIRS.format(5), "tid_long": TID_LONG, "pair_long": PAIR_LONG}
oracle("tid_features", "SELECT session_id, feature, round(value, 6) AS value FROM tid_long", **TOPS)
oracle("bigram_counts", "SELECT session_id, token, next_token, cnt FROM pair_counts")
oracle("bigram_counts_orders", """
    SELECT token, next_token, count(*) AS cnt FROM (
        SELECT template_id AS token, lead(template_id) OVER (PARTITION BY session_id ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey) AS next_token
        FROM order_tokens) WHERE next_token IS NOT NULL GROUP BY ALL""")
oracle("top_bigrams", """
    SELECT token || '>' || next_token AS bigram, s AS cnt FROM top_pairs""", top_pairs=TOP_PAIRS.format(10))
oracle("bigram_features", "SELECT session_id, feature, round(value, 6) AS value FROM pair_long", **TOPS)
oracle("session_features", """
    SELECT s.session_id, CAST(sequence_length AS DOUBLE) AS f0, CAST(unique_count AS DOUBLE) AS f1, round(unique_ratio, 6) AS f2,
           round(sum(-(cnt / sequence_length) * log2(cnt / sequence_length)), 6) AS f3,
           CAST(coalesce(sum(cnt) FILTER (r = 1), 0) AS DOUBLE) AS f4, round(coalesce(sum(cnt) FILTER (r = 1), 0) / sequence_length, 6) AS f5,
           CAST(coalesce(sum(cnt) FILTER (r = 2), 0) AS DOUBLE) AS f6, round(coalesce(sum(cnt) FILTER (r = 2), 0) / sequence_length, 6) AS f7,
           CAST(coalesce(sum(cnt) FILTER (r = 3), 0) AS DOUBLE) AS f8, round(coalesce(sum(cnt) FILTER (r = 3), 0) / sequence_length, 6) AS f9
    FROM scalars AS s JOIN counts AS c USING (session_id) LEFT JOIN ranked AS t USING (token)
    GROUP BY s.session_id, sequence_length, unique_count, unique_ratio""",
       ranked="SELECT token, row_number() OVER (ORDER BY token) AS r FROM top_tokens", top_tokens=TOP_TOKENS.format(3))
oracle("features_fit_transform", """
    SELECT session_id, feature, round(value, 6) AS value FROM (
        SELECT session_id, 'sequence_length' AS feature, CAST(sequence_length AS DOUBLE) AS value FROM scalars
        UNION ALL SELECT session_id, 'unique_template_count', unique_count FROM scalars
        UNION ALL SELECT session_id, 'unique_ratio', unique_ratio FROM scalars
        UNION ALL SELECT session_id, 'template_entropy', sum(-(cnt / sequence_length) * log2(cnt / sequence_length))
                  FROM counts JOIN scalars USING (session_id) GROUP BY session_id
        UNION ALL SELECT * FROM tid_long UNION ALL SELECT * FROM pair_long)
    WHERE session_id IN (SELECT session_id FROM session_split WHERE split <> 'train')""",
       tid_long=TID_LONG, pair_long=PAIR_LONG,
       top_tokens="""SELECT token, sum(cnt) AS s FROM counts JOIN session_split USING (session_id) WHERE split = 'train'
                     GROUP BY token ORDER BY s DESC, token LIMIT 2""",
       top_pairs="""SELECT token, next_token, count(*) AS s FROM pairs JOIN session_split USING (session_id) WHERE split = 'train'
                    GROUP BY ALL ORDER BY s DESC, token, next_token LIMIT 4""")
oracle("session_summary", """
    SELECT count(*) AS n_sessions, round(avg(n), 6) AS mean_length, max(n) AS max_length, median(n) AS median_length,
           (SELECT count(DISTINCT template_id) FROM order_tokens) AS vocabulary
    FROM (SELECT session_id, count(*) AS n FROM order_tokens GROUP BY 1)""")
oracle("longest_sessions", """
    SELECT session_id, count(*) AS sequence_length FROM order_tokens GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
oracle("session_distributions", """
    SELECT 'label' AS field, CAST(label AS VARCHAR) AS value, count(*) AS n FROM s GROUP BY label
    UNION ALL SELECT 'dataset', service, count(*) FROM s GROUP BY service""",
       s="SELECT session_id, max(label) AS label, arg_min(service, line_no) AS service FROM tokens GROUP BY 1")
oracle("feature_totals", """
    SELECT feature, sum(value) AS total FROM (SELECT * FROM tid_long UNION ALL SELECT * FROM pair_long)
    WHERE NOT ends_with(feature, '_norm') GROUP BY feature""", **TOPS)
MEANS = "SELECT label + 3 AS token, " + ", ".join(f"avg(CAST(embedding[{i + 1}] AS DOUBLE)) AS d{i}" for i in range(8)) + \
    " FROM embeddings GROUP BY label HAVING label <> 1"
oracle("mean_pool", "SELECT session_id, " + ", ".join(f"round(coalesce(avg(d{i}), 0.0), 6) AS v{i}" for i in range(8)) +
       " FROM tokens LEFT JOIN means ON token = token_id GROUP BY session_id", means=MEANS)
oracle("embed_tokens", """
    SELECT line_no, token_id, round(coalesce(d0, 0.0), 6) AS v0, round(coalesce(d7, 0.0), 6) AS v7
    FROM tokens LEFT JOIN means ON token = token_id""", means=MEANS)

# ---- scoring -----------------------------------------------------------------------------------

AP = """
    SELECT sum((pos / n_pos) * (cum_pos / cum)) AS ap FROM (
        SELECT score, sum(label) AS pos, sum(sum(label)) OVER w AS cum_pos, sum(count(*)) OVER w AS cum,
               sum(sum(label)) OVER () AS n_pos
        FROM scores GROUP BY score WINDOW w AS (ORDER BY score DESC))"""
oracle("contamination_sweep", """
    SELECT contamination, round(threshold, 6) AS threshold, count(*) FILTER (score > threshold) AS n_flagged,
           count(*) FILTER (score > threshold AND label = 1) AS n_true, round(ap, 6) AS pr_auc
    FROM cuts, scores, ap GROUP BY ALL""",
       cuts="""SELECT CAST(0.05 AS DOUBLE) AS contamination, quantile_cont(score, CAST(0.95 AS DOUBLE)) AS threshold FROM scores
               UNION ALL SELECT 0.10, quantile_cont(score, CAST(0.9 AS DOUBLE)) FROM scores
               UNION ALL SELECT 0.20, quantile_cont(score, CAST(0.8 AS DOUBLE)) FROM scores""", ap=AP)
oracle("transition_model", "SELECT token, next_token, cnt, from_cnt, round(prob, 6) AS prob FROM transitions")
NLL = """
    SELECT p.session_id, p.cnt, -ln(coalesce(t.prob, 0.1 / (coalesce(f.from_cnt, 0) + 0.1 * v))) AS nll
    FROM pair_counts AS p LEFT JOIN transitions AS t USING (token, next_token)
    LEFT JOIN (SELECT DISTINCT token, from_cnt FROM transitions) AS f ON f.token = p.token, vocab"""
oracle("next_token_nll", """
    SELECT session_id, round(coalesce(sum(cnt * nll) / sum(cnt), 0.0), 6) AS mean_nll, round(coalesce(max(nll), 0.0), 6) AS max_nll
    FROM (SELECT DISTINCT session_id FROM tokens) LEFT JOIN nll USING (session_id) GROUP BY session_id""", nll=NLL)
oracle("validation_loss", """
    SELECT alpha, round(avg(-ln((coalesce(c, 0) + alpha) / (coalesce(f, 0) + alpha * v))), 6) AS loss
    FROM (SELECT CAST(unnest([0.01, 0.1, 1.0, 10.0]) AS DOUBLE) AS alpha), vocab, val_pairs GROUP BY alpha""",
       split_pairs="SELECT token, next_token, split FROM pairs JOIN session_split USING (session_id)",
       val_pairs="""SELECT v.token, v.next_token, c, f FROM split_pairs AS v
                    LEFT JOIN (SELECT token, next_token, count(*) AS c FROM split_pairs WHERE split = 'train' GROUP BY ALL) USING (token, next_token)
                    LEFT JOIN (SELECT token, count(*) AS f FROM split_pairs WHERE split = 'train' GROUP BY ALL) USING (token)
                    WHERE v.split = 'val'""")
oracle("top_predictions", """
    SELECT session_id, token, rank, next_token, round(prob, 6) AS prob, substr(template_text, 1, 60) AS text
    FROM (SELECT session_id, arg_max(template_id, (timestamp, line_no)) AS token FROM tokens GROUP BY 1)
    JOIN (SELECT *, row_number() OVER (PARTITION BY token ORDER BY prob DESC, next_token) AS rank FROM transitions) USING (token)
    JOIN dictionary ON template_id = next_token WHERE rank <= 3""")
oracle("context_vector", "SELECT pos AS start, " + ", ".join(
    f"round(list_sum(list_transform(vectors, lambda v, i: CAST(v[{j + 1}] AS DOUBLE) * i)) / 55.0, 6) AS c{j}" for j in (0, 31, 63)) +
    " FROM cut WHERE pos % 5 = 0 AND pos <= n - 10", cut=VEC_WINDOWS)
oracle("select_model", """
    SELECT model, round(ap, 6) AS average_precision, round(auc, 6) AS roc_auc, row_number() OVER (ORDER BY ap DESC, model) AS rank
    FROM (SELECT model, sum((pos / n_pos) * (cum_pos / cum)) AS ap FROM curve GROUP BY model)
    JOIN (SELECT model, sum(pos * (n_neg - (cum - cum_pos) + (n - pos) / 2)) / max(n_pos * n_neg) AS auc FROM curve GROUP BY model) USING (model)""",
       long="""SELECT 'model_' || model AS model, score, label FROM model_scores""",
       curve="""SELECT model, score, CAST(sum(label) AS DOUBLE) AS pos, count(*) AS n, CAST(sum(sum(label)) OVER w AS DOUBLE) AS cum_pos, sum(count(*)) OVER w AS cum,
                       CAST(sum(sum(label)) OVER (PARTITION BY model) AS DOUBLE) AS n_pos, sum(count(*) - sum(label)) OVER (PARTITION BY model) AS n_neg
                FROM long GROUP BY model, score WINDOW w AS (PARTITION BY model ORDER BY score DESC)""")
oracle("ensemble_score", """
    SELECT item_id, s AS score, s >= 1.0 AS is_anomaly
    FROM (SELECT item_id, round(avg(score / (threshold + 1e-9)), 6) AS s FROM model_scores JOIN model_p95 USING (model) GROUP BY item_id)""")
oracle("decide", """
    SELECT item_id, score >= t AS at_least, score > t AS above, score > 0.0 AS uncalibrated
    FROM scores, (SELECT quantile_cont(score, 0.95) AS t FROM scores WHERE label = 0)""")
oracle("score_with_fallback", """
    SELECT item_id, label, CASE WHEN label = 0 THEN score ELSE 2.0 END AS score,
           CASE WHEN label = 0 THEN '' ELSE 'no model score' END AS fallback_reason FROM scores""")
oracle("severity_terciles", """
    SELECT item_id, CASE WHEN score >= p66 THEN 2 WHEN score >= p33 THEN 1 ELSE 0 END AS severity
    FROM scores, (SELECT quantile_cont(score, 0.33) AS p33, quantile_cont(score, 0.66) AS p66 FROM scores)""")

# ---- thresholds and evaluation -----------------------------------------------------------------

SWEEP = """
    SELECT g, i, CASE WHEN i = {n} - 1 THEN hi ELSE lo + i * ((hi - lo) / ({n} - 1)) END AS threshold
    FROM ends, (SELECT unnest(range(0, {n})) AS i)"""
SWEPT = """
    SELECT c.g, i, threshold, CAST(count(*) FILTER (score >= threshold AND label = 1) AS DOUBLE) AS tp,
           CAST(count(*) FILTER (score >= threshold AND label = 0) AS DOUBLE) AS fp, CAST(count(*) FILTER (score < threshold AND label = 1) AS DOUBLE) AS fn,
           count(*) AS n
    FROM candidates AS c JOIN input AS s ON s.g = c.g GROUP BY ALL"""
F1_BEST = """
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY f1 DESC, i) AS r
                   FROM (SELECT *, coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0.0) AS f1 FROM swept)) WHERE r = 1"""


def _f1(group: str) -> dict[str, str]:
    return {
        "input": f"SELECT *, {group} AS g FROM scores",
        "ends": "SELECT g, quantile_cont(score, 0.01) AS lo, quantile_cont(score, 0.99) AS hi FROM input GROUP BY g",
        "candidates": SWEEP.format(n=300), "swept": SWEPT, "best": F1_BEST,
    }


F1_OUT = """round(threshold, 6) AS threshold, round(f1, 6) AS f1, round(coalesce(tp / nullif(tp + fp, 0), 0.0), 6) AS precision,
    round(coalesce(tp / nullif(tp + fn, 0), 0.0), 6) AS recall, round((tp + fp) / n, 6) AS pct_pred, CAST(tp + fn AS BIGINT) AS support, n"""
oracle("f1_threshold", f"SELECT {F1_OUT} FROM best", **_f1("'all'"))
oracle("threshold_by_group", f"SELECT g AS service, {F1_OUT} FROM best", **_f1("service"))
BOTH = {
    **{f"{k}_all": re.sub(r"\b(input|ends|candidates|swept|best)\b", r"\1_all", v) for k, v in _f1("'all'").items()}, **_f1("service"),
    "both_modes": """SELECT s.*, CAST(score >= a.threshold AS INTEGER) AS pred_overall, CAST(score >= b.threshold AS INTEGER) AS pred_by_group
                     FROM scores AS s JOIN best AS b ON b.g = s.service JOIN best_all AS a ON TRUE""",
}
oracle("predictions_by_group", "SELECT item_id, pred_overall, pred_by_group FROM both_modes", **BOTH)
oracle("percentile_threshold", "SELECT service, round(quantile_cont(score, 0.95), 6) AS threshold FROM scores WHERE label = 0 GROUP BY service")
oracle("runtime_threshold", """
    SELECT q.g AS model, round(CASE WHEN usable THEN thr ELSE q END, 6) AS threshold, CASE WHEN usable THEN 'f1' ELSE 'percentile' END AS method
    FROM (SELECT g, quantile_cont(score, CAST(0.98 AS DOUBLE)) AS q FROM everything GROUP BY g) AS q
    LEFT JOIN (SELECT e.g, any_value(b.threshold) AS thr, count(label) >= 20 AND min(label) <> max(label) AND avg(CAST(score >= b.threshold AS INTEGER)) <= 0.5 AS usable
               FROM everything AS e JOIN best AS b ON b.g = e.g GROUP BY e.g) AS u ON u.g = q.g""",
       everything="""SELECT model AS g, score, CASE WHEN model = 'a' THEN label END AS label FROM model_scores
                     UNION ALL SELECT 'c', score * score, CAST(score > 100 AS INTEGER) FROM scores""",
       input="SELECT * FROM everything WHERE label IS NOT NULL",
       ends="SELECT g, min(score) AS lo, max(score) AS hi FROM input GROUP BY g", candidates=SWEEP.format(n=200), swept=SWEPT,
       best="""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY 2 * p * r / (p + r + 1e-9) DESC, i) AS rn
               FROM (SELECT *, tp / (tp + fp + 1e-9) AS p, tp / (tp + fn + 1e-9) AS r FROM swept)) WHERE rn = 1""")
oracle("score_stats", """
    SELECT model, round(min(score), 6) AS min, round(quantile_cont(score, 0.5), 6) AS p50, round(quantile_cont(score, 0.95), 6) AS p95,
           round(quantile_cont(score, 0.99), 6) AS p99, round(max(score), 6) AS max, round(avg(CAST(score >= threshold AS INTEGER)), 6) AS alert_rate
    FROM model_scores JOIN model_p95 USING (model) GROUP BY model""")


def _rates(total: str) -> str:
    return f"""round(coalesce(tp / nullif(tp + fp, 0), 0.0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0.0), 6) AS recall,
        round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0.0), 6) AS f1, round(coalesce(fp / nullif(fp + tn, 0), 0.0), 6) AS fpr,
        round(coalesce((tp + fp) / nullif({total}, 0), 0.0), 6) AS pct_pred"""


CONFUSION = """count(label) AS total, count(*) - count(label) AS skipped,
    count(*) FILTER (p = 1 AND label = 1) AS tp, count(*) FILTER (p = 1 AND label = 0) AS fp,
    count(*) FILTER (p = 0 AND label = 0) AS tn, count(*) FILTER (p = 0 AND label = 1) AS fn"""
oracle("confusion_metrics", f"SELECT *, {_rates('total')} FROM (SELECT service, {CONFUSION} FROM predicted GROUP BY service)",
       predicted="""SELECT service, CASE WHEN score_b > 5 THEN CAST(score >= (SELECT quantile_cont(score, 0.95) FROM scores WHERE label = 0) AS INTEGER) ELSE 0 END AS p,
                           CASE WHEN score_b < 90 THEN label END AS label FROM scores""")
CURVE = """SELECT service, score, CAST(sum(label) AS DOUBLE) AS pos, count(*) AS n, CAST(sum(sum(label)) OVER w AS DOUBLE) AS cum_pos, sum(count(*)) OVER w AS cum,
                  CAST(sum(sum(label)) OVER (PARTITION BY service) AS DOUBLE) AS n_pos, sum(count(*) - sum(label)) OVER (PARTITION BY service) AS n_neg
           FROM scores GROUP BY service, score WINDOW w AS (PARTITION BY service ORDER BY score DESC)"""
oracle("roc_auc", """
    SELECT service, round(sum(pos * (n_neg - (cum - cum_pos) + (n - pos) / 2)) / max(n_pos * n_neg), 6) AS roc_auc FROM curve GROUP BY service""", curve=CURVE)
oracle("average_precision", """
    SELECT service, round(sum((pos / n_pos) * (cum_pos / cum)), 6) AS average_precision FROM curve GROUP BY service""", curve=CURVE)
oracle("curve_points", """
    SELECT service, score AS threshold, round((cum - cum_pos) / n_neg, 6) AS fpr, round(cum_pos / n_pos, 6) AS recall, round(cum_pos / cum, 6) AS precision FROM curve""", curve=CURVE)
oracle("score_histogram", """
    SELECT label, bin, n, round(lo + bin * width, 6) AS bin_start, round(n / (sum(n) OVER (PARTITION BY label) * width), 6) AS density
    FROM (SELECT label, lo, width, CAST(least(58, floor((score - lo) / width)) AS INTEGER) AS bin, count(*) AS n
          FROM scores, (SELECT min(score) AS lo, (max(score) - min(score)) / 59 AS width FROM scores) GROUP BY ALL)""")
oracle("eval_by_group", f"""
    SELECT *, {_rates('total')} FROM (SELECT scope, mode, {CONFUSION} FROM long GROUP BY scope, mode)""",
       long="""SELECT unnest([service, 'ALL']) AS scope, label, 'pred_overall' AS mode, pred_overall AS p FROM both_modes
               UNION ALL SELECT unnest([service, 'ALL']), label, 'pred_by_group', pred_by_group FROM both_modes""", **BOTH)
oracle("class_report", """
    SELECT class, round(coalesce(tp / nullif(predicted, 0), 0.0), 6) AS precision, round(coalesce(tp / nullif(support, 0), 0.0), 6) AS recall,
           round(coalesce(2.0 * tp / nullif(predicted + support, 0), 0.0), 6) AS f1, support
    FROM (SELECT class, count(*) FILTER (label = class AND p = class) AS tp, count(*) FILTER (label = class) AS support, count(*) FILTER (p = class) AS predicted
          FROM (SELECT label, CAST(score_b >= 50 AS INTEGER) AS p FROM scores), (SELECT unnest([0, 1]) AS class) GROUP BY class)""")
oracle("session_verdict", """
    SELECT session_id, coalesce(max(CAST(hit AS INTEGER)), -1) AS raw_verdict, coalesce(max(CAST(hit AS INTEGER)), 0) AS pred
    FROM (SELECT DISTINCT session_id FROM tokens) LEFT JOIN
         (SELECT session_id, len(list_filter(tokens, lambda t: t = 4)) >= 14 AS hit FROM cut WHERE pos % 5 = 0 AND pos <= n - 60) USING (session_id)
    GROUP BY session_id""", cut=WINDOWS.format(keys="session_id,", part="session_id", last=59))
oracle("compare_runs", f"""
    SELECT metric, round(max(v) FILTER (run = 'a'), 6) AS value_a, round(max(v) FILTER (run = 'b'), 6) AS value_b,
           round(max(v) FILTER (run = 'b') - max(v) FILTER (run = 'a'), 6) AS delta
    FROM (SELECT * FROM wide UNPIVOT (v FOR metric IN (tp, fp, tn, fn, precision, recall, f1, fpr))) GROUP BY metric""",
       runs="""SELECT 'a' AS run, label, CAST(score >= 100 AS INTEGER) AS p FROM scores UNION ALL SELECT 'b', label, CAST(score_b >= 50 AS INTEGER) FROM scores""",
       wide=f"""SELECT run, CAST(tp AS DOUBLE) AS tp, CAST(fp AS DOUBLE) AS fp, CAST(tn AS DOUBLE) AS tn, CAST(fn AS DOUBLE) AS fn,
                       coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0.0) AS recall,
                       coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0.0) AS f1, coalesce(fp / nullif(fp + tn, 0), 0.0) AS fpr
                FROM (SELECT run, {CONFUSION} FROM runs GROUP BY run)""")
oracle("latency_summary", """
    SELECT service, count(*) AS n_events, round(avg(score), 6) AS mean_latency, round(count(*) / (max(timestamp) - min(timestamp)), 6) AS events_per_sec,
           round(avg(label) * 100, 6) AS anomaly_rate_pct, round(max(score) FILTER (rn = greatest(1, floor(n * CAST(0.95 AS DOUBLE)))), 6) AS p95_latency
    FROM (SELECT *, row_number() OVER (PARTITION BY service ORDER BY score) AS rn, count(*) OVER (PARTITION BY service) AS n FROM scores) GROUP BY service""")
oracle("dq_report", """
    SELECT "check", CASE WHEN (n > 0) = wanted THEN 'pass' ELSE 'fail' END AS status, n FROM (
        SELECT 'row_count' AS "check", TRUE AS wanted, count(*) AS n FROM log_lines
        UNION ALL SELECT 'label_normal_present', TRUE, count(*) FILTER (label = 0) FROM log_lines
        UNION ALL SELECT 'label_anomaly_present', TRUE, count(*) FILTER (label = 1) FROM log_lines
        UNION ALL SELECT 'label_other', FALSE, count(*) FILTER (label IS NULL OR label NOT IN (0, 1)) FROM log_lines
        UNION ALL SELECT 'empty_message', FALSE, count(*) FILTER (trim(coalesce(message, '')) = '') FROM log_lines
        UNION ALL SELECT 'missing_number', FALSE, count(*) FILTER (timestamp IS NULL) FROM log_lines
        UNION ALL SELECT 'phase_normal', TRUE, sum(a) FROM s UNION ALL SELECT 'phase_degradation', TRUE, sum(b) FROM s
        UNION ALL SELECT 'phase_failure', TRUE, sum(n - a - b) FROM s)""",
       s="""SELECT count(*) AS n, CAST(floor(count(*) * CAST(0.6 AS DOUBLE)) AS BIGINT) AS a, CAST(floor(count(*) * CAST(0.3 AS DOUBLE)) AS BIGINT) AS b
            FROM log_lines GROUP BY session_id""")
oracle("distribution_report", """
    SELECT service, count(*) AS n, CAST(sum(label) AS BIGINT) AS n_anomaly, round(avg(label), 6) AS label_rate FROM log_lines GROUP BY service""")
oracle("first_messages", """
    SELECT service, rank, message FROM (SELECT service, message, row_number() OVER (PARTITION BY service ORDER BY timestamp, line_no) AS rank FROM log_lines)
    WHERE rank <= 3""")

# ---- windows and alerts ------------------------------------------------------------------------

ROLLING = """
    SELECT stream_key, stream_key || '_w' || (pos // 10) AS sequence_id, pos // 10 AS emit_index, array_to_string(tokens, ',') AS tokens, label,
           round(times[1], 6) AS start_ts, round(times[50], 6) AS end_ts
    FROM cut WHERE pos % 10 = 0 AND pos <= n - 50"""
KEY_CUT = WINDOWS.format(keys="stream_key,", part="stream_key", last=49)
oracle("rolling_windows", ROLLING, cut=KEY_CUT)
oracle("stream_rolling_windows", ROLLING, cut=KEY_CUT)
SHORT_CUT = WINDOWS.format(keys="stream_key,", part="stream_key", last=9)
oracle("evidence_window", """
    SELECT stream_key || '_w' || (pos // 5) AS sequence_id, array_to_string(tokens, ',') AS tokens,
           array_to_string(list_transform(tokens, lambda t: t - 2), ',') AS template_ids,
           array_to_string(list_transform(tokens[1:5], lambda t: 'tid=' || (t - 2) || ': ' || texts[t - 2]), '|') AS previews,
           round(times[1], 6) AS start_ts, round(times[10], 6) AS end_ts
    FROM cut, (SELECT list(template_text ORDER BY template_id) AS texts FROM dictionary) WHERE pos % 5 = 0 AND pos <= n - 10""", cut=SHORT_CUT)


def _surprise(window: int, stride: int, q: float) -> dict[str, str]:
    return {
        "steps": """SELECT *, row_number() OVER k - 1 AS pos, count(*) OVER (PARTITION BY stream_key) AS n, lead(template_id) OVER k AS next_token
                    FROM tokens WINDOW k AS (PARTITION BY stream_key ORDER BY timestamp, line_no)""",
        "surprised": """SELECT s.*, -ln(t.prob) AS nll FROM steps AS s LEFT JOIN transitions AS t ON t.token = s.template_id AND t.next_token = s.next_token""",
        "cut_scores": f"""SELECT stream_key, pos, n, timestamp, avg(nll) OVER (w ROWS BETWEEN CURRENT ROW AND {window - 2} FOLLOWING) AS score,
                           max(label) OVER (w ROWS BETWEEN CURRENT ROW AND {window - 1} FOLLOWING) AS label,
                           max(timestamp) OVER (w ROWS BETWEEN CURRENT ROW AND {window - 1} FOLLOWING) AS end_ts,
                           list(template_id) OVER (w ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS tids
                    FROM surprised WINDOW w AS (PARTITION BY stream_key ORDER BY pos)""",
        "windows": f"SELECT *, pos // {stride} AS emit_index FROM cut_scores WHERE pos % {stride} = 0 AND pos <= n - {window}",
        "window_risks": f"""SELECT stream_key, emit_index, emit_index + 1 AS emit_number, end_ts AS timestamp, label, tids, score, round(score, 6) AS risk_score, threshold,
                              score >= threshold - 1e-12 AS is_anomaly
                       FROM windows, (SELECT quantile_cont(score, CAST({q} AS DOUBLE)) AS threshold FROM windows)""",
    }


def _cooldown(source: str, order: str, seconds: float) -> dict[str, str]:
    """Row-by-row recursion over the ordered rows of each key; ``source`` has stream_key and timestamp."""
    return {
        "ordered": f"SELECT *, row_number() OVER (PARTITION BY stream_key ORDER BY {order}) AS seq FROM {source}",
        "fold": f"""SELECT stream_key, seq, timestamp AS last, TRUE AS fired FROM ordered WHERE seq = 1
                    UNION ALL SELECT o.stream_key, o.seq, CASE WHEN o.timestamp - f.last >= {seconds} THEN o.timestamp ELSE f.last END,
                                     o.timestamp - f.last >= {seconds}
                    FROM fold AS f JOIN ordered AS o ON o.stream_key = f.stream_key AND o.seq = f.seq + 1""",
        "flagged": "SELECT o.*, f.fired FROM ordered AS o JOIN fold AS f USING (stream_key, seq)",
    }


oracle("risk_results", """
    SELECT stream_key, emit_number, 'transitions' AS model, risk_score, round(threshold, 6) AS threshold, is_anomaly, 10 AS window_size, label FROM window_risks""",
       **_surprise(10, 5, 0.95))
oracle("alert_gate", "SELECT item_id, risk_score FROM risks WHERE is_anomaly AND risk_score >= 90 AND window_size >= 3")
oracle("alert_severity", f"""
    SELECT item_id, {SEVERITY} AS severity, CASE WHEN risk_score / threshold >= 3 THEN 'page' WHEN risk_score / threshold >= 0.5 THEN 'mail' ELSE 'low' END AS custom FROM risks""")
COOL = {**_cooldown("gated", "timestamp, item_id", 86400.0), "gated": "SELECT * FROM risks WHERE is_anomaly"}
oracle("alert_cooldown", "SELECT stream_key, item_id, fired FROM flagged", recursive=True, **COOL)
oracle("stream_alert_cooldown", "SELECT stream_key, item_id, fired FROM flagged", recursive=True, **COOL)
oracle("suppressed_counts", """
    SELECT stream_key, count(*) FILTER (fired) AS fired, count(*) FILTER (NOT fired) AS suppressed FROM flagged GROUP BY stream_key""", recursive=True, **COOL)
oracle("recent_alerts", "SELECT item_id, stream_key FROM flagged WHERE fired ORDER BY timestamp DESC, item_id DESC LIMIT 50", recursive=True, **COOL)
oracle("recent_alerts_per_key", """
    SELECT item_id, stream_key FROM (SELECT *, row_number() OVER (PARTITION BY stream_key ORDER BY timestamp DESC, item_id DESC) AS r FROM flagged WHERE fired)
    WHERE r <= 3""", recursive=True, **COOL)
WINDOW_COOL = {**_cooldown("gated", "timestamp, emit_index", 86400.0), "gated": "SELECT * FROM window_risks WHERE is_anomaly"}
ALERT_ID = "sha256(concat_ws('|', stream_key, CAST(emit_number AS VARCHAR))) AS alert_id"
oracle("alerts", f"""
    SELECT {ALERT_ID}, {SEVERITY} AS severity, split_part(stream_key, ':', 1) AS service, risk_score AS score, 10 AS token_count,
           array_to_string(list_transform(tids, lambda t: 'tid=' || t || ': ' || texts[t]), '|') AS previews, stream_key,
           emit_number AS emit_index FROM flagged, (SELECT list(template_text ORDER BY template_id) AS texts FROM dictionary) WHERE fired""", recursive=True, **WINDOW_COOL, **_surprise(10, 5, 0.95))
oracle("sink_alert_outbox", f"""
    SELECT {ALERT_ID}, {SEVERITY} AS severity, split_part(stream_key, ':', 1) AS service, stream_key FROM flagged WHERE fired""",
       recursive=True, **WINDOW_COOL, **_surprise(10, 5, 0.95))
oracle("windowed_alerts", f"""
    SELECT stream_key, emit_number, risk_score, label, {SEVERITY} AS severity, fired FROM flagged""", recursive=True, **WINDOW_COOL, **_surprise(50, 10, 0.8))
APPLIED = {
    "parted": """SELECT *, CASE WHEN g < gn - nt - nv THEN 'train' WHEN g < gn - nt THEN 'val' ELSE 'test' END AS part FROM (
                   SELECT *, greatest(1, round_even(gn * 0.4, 0)) AS nt, greatest(1, round_even(gn * 0.1, 0)) AS nv FROM (
                     SELECT *, row_number() OVER (ORDER BY timestamp, line_no) - 1 AS g, count(*) OVER () AS gn FROM tokens))""",
    "fit_ids": "SELECT template_id, row_number() OVER (ORDER BY template_id) AS tid FROM (SELECT DISTINCT template_id FROM parted WHERE part = 'train')",
    "fit_steps": """SELECT p.part, p.stream_key, p.timestamp, p.label, coalesce(tid, 0) AS token, row_number() OVER k - 1 AS pos,
                           count(*) OVER (PARTITION BY p.part, p.stream_key) AS n, lead(coalesce(tid, 0)) OVER k AS next_token
                    FROM parted AS p LEFT JOIN fit_ids USING (template_id) WINDOW k AS (PARTITION BY p.part, p.stream_key ORDER BY p.timestamp, p.line_no)""",
    "fit_vocab": "SELECT count(DISTINCT token) AS v FROM fit_steps WHERE part = 'train'",
    "fit_pairs": "SELECT token, next_token, count(*) AS cnt FROM fit_steps WHERE part = 'train' AND next_token IS NOT NULL GROUP BY ALL",
    "fit_sources": "SELECT token, sum(cnt) AS from_cnt FROM fit_pairs GROUP BY token",
    "fit_nll": """SELECT s.*, CASE WHEN s.next_token IS NOT NULL THEN -ln((coalesce(cnt, 0) + 0.1) / (coalesce(from_cnt, 0) + 0.1 * v)) END AS nll
                  FROM fit_steps AS s CROSS JOIN fit_vocab LEFT JOIN fit_pairs USING (token, next_token) LEFT JOIN fit_sources USING (token)""",
    "fit_windows": """SELECT *, pos // 5 AS emit_index FROM (
                        SELECT part, stream_key, pos, n, avg(nll) OVER (w ROWS BETWEEN CURRENT ROW AND 8 FOLLOWING) AS score,
                               max(label) OVER (w ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS label,
                               max(timestamp) OVER (w ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS timestamp
                        FROM fit_nll WINDOW w AS (PARTITION BY part, stream_key ORDER BY pos)) WHERE pos % 5 = 0 AND pos <= n - 10""",
    "gated": """SELECT stream_key, emit_index, timestamp, label, round(score, 6) AS risk_score, threshold
                FROM fit_windows, (SELECT quantile_cont(score, 0.8) AS threshold FROM fit_windows WHERE part = 'train')
                WHERE part = 'test' AND score >= threshold - 1e-12""",
    **_cooldown("gated", "timestamp, emit_index", 86400.0),
}
for _name in ("windowed_alerts_apply", "stream_windowed_alerts"):
    oracle(_name, f"SELECT stream_key, emit_index, risk_score, label, {SEVERITY} AS severity, fired FROM flagged", recursive=True, **APPLIED)
oracle("windowed_alerts_fallback", """
    SELECT stream_key, emit_index, 0.5::DOUBLE AS risk_score, 'no model' AS fallback_reason, label, fired FROM flagged""", recursive=True, **{
    **_surprise(10, 5, 0.95), **_cooldown("gated", "timestamp, emit_index", 86400.0),
    "gated": "SELECT stream_key, emit_index, end_ts AS timestamp, label FROM windows"})
oracle("alert_message", f"""
    SELECT item_id, printf('Anomaly detected in service ''%s'' — severity=%s score=%.4f confidence=%.2f%%', split_part(stream_key, ':', 1),
                           upper({SEVERITY}), risk_score, window_size / 16.0 * 100) AS message FROM risks WHERE is_anomaly""")
oracle("active_keys", """
    SELECT stream_key, n_events FROM (SELECT stream_key, count(*) AS n_events, min((timestamp, line_no)) AS f FROM tokens GROUP BY 1)
    ORDER BY f DESC, stream_key LIMIT 20""")
oracle("run_counters", """
    SELECT (SELECT count(*) FROM tokens) AS events_total, count(*) AS windows_total, count(*) FILTER (is_anomaly) AS anomalies_total,
           (SELECT count(DISTINCT stream_key) FROM tokens) AS active_streams FROM window_risks""", **_surprise(10, 5, 0.95))
oracle("alerts_v2", """
    SELECT item_id, stream_key, severity, score, confidence FROM flagged WHERE fired""", recursive=True,
       **_cooldown("gated", "timestamp, item_id", 43200.0),
       gated="""SELECT service || '/' || session_id AS stream_key, timestamp, item_id, score, score_b / 100 AS confidence,
                       CASE WHEN score >= p66 THEN 'critical' WHEN score >= p33 THEN 'warning' ELSE 'info' END AS severity
                FROM scores, limit80, (SELECT quantile_cont(score, 0.33) AS p33, quantile_cont(score, 0.66) AS p66 FROM scores) WHERE score > threshold""")

# ---- operational metrics -----------------------------------------------------------------------

HOURLY = """SELECT service, CAST(floor(timestamp / 3600) AS BIGINT) * 3600 AS h, count(*) AS events, CAST(sum(label) AS BIGINT) AS errors,
                   CAST(sum(CAST(round(score * 100, 0) AS BIGINT)) AS BIGINT) AS cents FROM scores GROUP BY ALL"""
TRAILING = """SELECT service, step_start, CAST(coalesce(sum(events), 0) AS BIGINT) AS events, CAST(coalesce(sum(errors), 0) AS BIGINT) AS errors,
                     CAST(coalesce(sum(cents), 0) AS BIGINT) AS cents
              FROM (SELECT service, unnest(range(lo, hi + 1, 3600)) AS step_start
                    FROM (SELECT DISTINCT service FROM hourly), (SELECT min(h) AS lo, max(h) AS hi FROM hourly)) AS s
              LEFT JOIN hourly AS x ON x.service = s.service AND x.h BETWEEN step_start - 4 * 3600 AND step_start
              GROUP BY s.service, step_start"""
TRAILING = TRAILING.replace("SELECT service, step_start, CAST", "SELECT s.service, step_start, CAST")
OPS = {"hourly": HOURLY, "trail": TRAILING}
oracle("increase_5m", "SELECT service, step_start, events, errors FROM trail", **OPS)
oracle("error_rate_5m", "SELECT service, step_start, round(errors / 18000, 9) AS error_rate FROM trail", **OPS)
oracle("alerts_by_severity", f"SELECT {SEVERITY} AS severity, count(*) AS n FROM risks GROUP BY 1")
BUCKETS = """SELECT service, le, count(*) FILTER (score / 1000 <= le) AS cumulative
             FROM scores, (SELECT unnest([0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 'infinity'::DOUBLE]) AS le) GROUP BY ALL"""
oracle("latency_buckets", "SELECT service, CASE WHEN isinf(le) THEN 'Infinity' ELSE CAST(le AS VARCHAR) END AS le, cumulative FROM buckets", buckets=BUCKETS)
oracle("bucket_quantile", """
    SELECT service, round(CASE WHEN isinf(le) THEN low ELSE low + (le - low) * (rank - below) / (cumulative - below) END, 6) AS p95
    FROM (SELECT *, row_number() OVER (PARTITION BY service ORDER BY le) AS r FROM (
            SELECT *, coalesce(lag(le) OVER w, 0) AS low, coalesce(lag(cumulative) OVER w, 0) AS below, max(cumulative) OVER (PARTITION BY service) * 0.95 AS rank
            FROM buckets WINDOW w AS (PARTITION BY service ORDER BY le)) WHERE cumulative >= rank AND below < rank) WHERE r = 1""", buckets=BUCKETS)
oracle("mean_latency_5m", "SELECT service, step_start, round(coalesce(cents / nullif(events, 0) / 100, 0.0), 6) AS mean_latency FROM trail", **OPS)
oracle("sustained_condition", """
    SELECT service, min(step_start) AS since, max(step_start) AS until, count(*) AS n_steps
    FROM (SELECT *, step_start - 3600 * row_number() OVER (PARTITION BY service ORDER BY step_start) AS island FROM trail WHERE errors >= 5)
    GROUP BY service, island HAVING max(step_start) - min(step_start) >= 7200""", **OPS)
oracle("stalled_streams", """
    SELECT service, round(p, 6) AS stalled_from, round(t, 6) AS stalled_to, round(t - p, 6) AS gap_seconds FROM (
        SELECT service, timestamp AS t, lag(timestamp) OVER (PARTITION BY service ORDER BY timestamp) AS p FROM scores
        UNION ALL SELECT service, (SELECT max(timestamp) FROM scores) AS t, max(timestamp) AS p FROM scores GROUP BY service
    ) WHERE t - p >= 7200""")
oracle("health_rollup", """
    SELECT service, day, status, CAST(CASE status WHEN 'healthy' THEN 1.0 WHEN 'degraded' THEN 0.5 ELSE 0.0 END AS DOUBLE) AS gauge
    FROM (SELECT service, h // 86400 * 86400 AS day, CASE WHEN bool_or(errors * 2 > events) THEN 'unhealthy'
                 WHEN bool_or(events < 1 OR events >= 12) THEN 'degraded' ELSE 'healthy' END AS status FROM (
              SELECT service, h, coalesce(events, 0) AS events, coalesce(errors, 0) AS errors
              FROM (SELECT * FROM (SELECT DISTINCT service FROM hourly), (SELECT unnest(range(min(h), max(h) + 1, 3600)) AS h FROM hourly)) AS grid
              LEFT JOIN hourly USING (service, h)) GROUP BY ALL)""", **OPS)
oracle("keyword_topk", """
    SELECT doc_id, item_id, score, CAST(rank AS INTEGER) AS rank FROM (
        SELECT doc_id, item_id, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) AS rank FROM (
            SELECT d.doc_id, b.item_id, len(list_filter(d.words, lambda w: contains(b.body, w))) AS score
            FROM (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')) AS words FROM documents) AS d,
                 (SELECT item_id, lower(item_id || ' ' || text) AS body FROM benchmark) AS b)) WHERE rank <= 3""")
oracle("keyword_answer", """
    SELECT doc_id, CASE WHEN contains(lower(text), 'error') THEN 'about error' WHEN contains(lower(text), 'alert') THEN 'about alert'
                        WHEN contains(lower(text), 'the') THEN 'about the' WHEN contains(lower(text), 'der') THEN 'about der'
                        WHEN contains(lower(text), 'le') THEN 'about le' ELSE 'default' END AS answer FROM documents""")

# ---- streaming ---------------------------------------------------------------------------------

oracle("stream_events", """
    SELECT service, session_id, token_id, count(*) AS n, 0 AS n_labels, round(max(timestamp), 6) AS last_ts FROM tokens GROUP BY ALL""")
oracle("stream_increase", """
    SELECT service, step + 3600 AS window_end, CAST(sum(events) AS BIGINT) AS events, CAST(sum(errors) AS BIGINT) AS errors
    FROM (SELECT *, unnest(range(h, h + 5 * 3600, 3600)) AS step FROM hourly) GROUP BY service, step""", **OPS)

# Column types of the Spark results where DuckDB would infer another integer width.
RESULT_TYPES: dict[str, dict[str, str]] = {
    "tokenize_message": {"n_tokens": "INTEGER"},
    "message_corpus": {"line_no": "INTEGER"},
    "coerce_events": {"token_id": "INTEGER"},
    "template_dictionary": {"template_id": "INTEGER"},
    "assign_templates": {"template_id": "INTEGER"},
    "template_stats": {"template_id": "INTEGER"},
    "encode_tokens": {"template_id": "INTEGER", "token_id": "INTEGER"},
    "decode_tokens": {"token_id": "INTEGER", "template_id": "INTEGER"},
    "vocab_table": {"token_id": "INTEGER"},
    "raw_to_token": {"token_id": "INTEGER"},
    "template_families": {"part": "BIGINT", "n": "INTEGER"},
    "session_sequences": {"part": "BIGINT"},
    "session_sequences_orders": {"part": "BIGINT"},
    "sliding_sequences": {"n_timestamps": "INTEGER"},
    "parse_sequences": {"n": "INTEGER"},
    "embedding_windows": {"n": "INTEGER", "n_values": "INTEGER"},
    "thinned_windows": {"stride": "INTEGER"},
    "token_corpus": {"n": "INTEGER"},
    "topk_vocab": {"token": "INTEGER"},
    "bigram_counts": {"token": "INTEGER", "next_token": "INTEGER"},
    "bigram_counts_orders": {"token": "INTEGER", "next_token": "INTEGER"},
    "embed_tokens": {"token_id": "INTEGER"},
    "transition_model": {"token": "INTEGER", "next_token": "INTEGER"},
    "top_predictions": {"token": "INTEGER", "rank": "INTEGER", "next_token": "INTEGER"},
    "select_model": {"rank": "INTEGER"},
    "dq_report": {"n": "BIGINT"},
    "first_messages": {"rank": "INTEGER"},
    "stream_events": {"token_id": "INTEGER", "n_labels": "BIGINT"},
}
for _name, _types in RESULT_TYPES.items():
    _casts = ", ".join(f"CAST({c} AS {t}) AS {c}" for c, t in _types.items())
    ORACLES[_name] = f"SELECT * REPLACE ({_casts}) FROM ({ORACLES[_name]})"
