"""Record families derived from the driver's star schema, in SQL that Spark and DuckDB read alike.

Table names stand in braces; Spark binds them to DataFrames, DuckDB to its registered views."""

from __future__ import annotations

import re
from string import Formatter

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "agreement_rows": """SELECT d.source AS cluster, CASE WHEN l.quality = 1 THEN 'yes' ELSE 'no' END AS first,
        CASE WHEN l.toxic = 0 THEN 'yes' ELSE 'no' END AS second FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id""",
    "rater_pairs": """SELECT user_id, event_id, first, second FROM (SELECT user_id, event_id, event_type AS first,
        lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS second FROM {events}) x WHERE second IS NOT NULL""",
    "ratings": """SELECT user_id AS rater, CASE WHEN event_id % 3 = 0 THEN 0 ELSE CAST(floor(event_id / 400) AS BIGINT) END AS item, event_type AS choice, event_id AS seq FROM {events}""",
    "votes": """SELECT user_id % 50 AS grp, first, second, CASE WHEN abs(v - w) < 5 THEN 'tie' WHEN v > w THEN 'first' ELSE 'second' END AS winner, user_id AS labeler
        FROM (SELECT user_id, event_type AS first, value AS v, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS second,
              lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS w FROM {events}) x WHERE second IS NOT NULL AND first <> second""",
    "trials": """SELECT CASE WHEN o_custkey % 3 = 0 THEN 'held-in' ELSE 'held-out' END AS split, o_orderkey * 4 + CAST(floor((l_linenumber - 1) / 2) AS BIGINT) AS pair_id, o_custkey AS task_id,
        CASE WHEN l_linenumber % 2 = 1 THEN 'base' ELSE 'edit' END AS arm, l_quantity >= CASE WHEN l_linenumber % 2 = 1 THEN 30 ELSE 24 END AS pass,
        CASE WHEN l_quantity > 48 THEN 'timeout' ELSE 'none' END AS error_class
        FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey""",
    "doctor_runs": """SELECT p_brand AS task, CASE WHEN p_size % 4 = 0 THEN 'reference' ELSE 'mutant' END AS kind,
        CASE WHEN p_size % 4 = 0 THEN CASE WHEN p_partkey % 97 = 0 THEN 'fail' ELSE 'pass' END
             WHEN p_partkey % 5 = 0 THEN 'pass' WHEN p_partkey % 11 = 1 THEN 'timeout' ELSE 'fail' END AS status,
        CASE WHEN p_partkey % 13 = 0 THEN 'equivalent' ELSE 'killed' END AS expect, CASE WHEN p_partkey % 60 = 5 THEN 'hand' ELSE 'generated' END AS origin, p_size % 7 AS band FROM {part}""",
    "band_rows": """SELECT concat(CAST(o_custkey AS VARCHAR(20)), CASE o_custkey % 5 WHEN 0 THEN '_us' WHEN 1 THEN '_ms' ELSE '' END) AS invariant,
        CASE WHEN o_custkey % 7 = 1 THEN CAST(floor(o_totalprice) AS DOUBLE) ELSE CAST(o_totalprice AS DOUBLE) END AS value, CAST(o_totalprice AS DOUBLE) * 0.02 AS ci_half,
        CAST(CASE WHEN o_custkey % 4 = 0 THEN -1000 ELSE 0 END AS DOUBLE) AS band_lo, CAST(CASE WHEN o_custkey % 3 = 0 THEN 1000000 ELSE 200000 END AS DOUBLE) AS band_hi FROM {orders}""",
    "candidates": """SELECT concat('r', CAST(floor(event_id / 3) AS VARCHAR(20))) AS run_id, event_id % 3 AS proposer_id, user_id % 12 AS task_id,
        CASE event_type WHEN 'purchase' THEN 'ok' WHEN 'click' THEN 'ok' WHEN 'view' THEN CASE WHEN event_id % 2 = 0 THEN 'no_diff' ELSE 'timeout' END
             WHEN 'signup' THEN 'malformed' ELSE 'http_error' END AS status,
        CASE WHEN event_type <> 'error' THEN NULL WHEN user_id % 4 = 0 THEN 'HTTP 429 Too Many Requests' WHEN user_id % 4 = 1 THEN 'HTTP 503 unavailable'
             WHEN user_id % 4 = 2 THEN 'HTTP 400: maximum context length' ELSE 'connection   reset' END AS error,
        CASE WHEN value > 80 THEN 'length' ELSE 'stop' END AS finish_reason,
        CASE WHEN event_type NOT IN ('purchase', 'click') THEN NULL WHEN event_id % 7 = 0 THEN 'apply_failed' WHEN event_id % 7 = 1 THEN 'timeout'
             WHEN event_id % 7 < 4 THEN 'pass' ELSE 'fail' END AS verify_status, 1 AS exit_code,
        CASE WHEN user_id % 3 = 0 THEN 'error: patch does not apply' WHEN user_id % 3 = 1 THEN 'corrupt patch at line 3' ELSE 'error: a.go: already exists in working directory' END AS apply_error
        FROM {events}""",
    "trial_items": """SELECT l.doc_id AS item, CASE l.doc_id % 3 WHEN 0 THEN 'D' WHEN 1 THEN 'R' ELSE 'H' END AS set_name, d.lang AS stratum, d.source AS cluster, CASE WHEN l.doc_id % 13 = 0 THEN NULL WHEN l.doc_id % 13 = 1 THEN '' ELSE 'a' END AS reference,
        CASE WHEN l.doc_id % 17 = 0 THEN NULL ELSE CAST(l.quality AS DOUBLE) END AS base, CASE WHEN l.doc_id % 19 = 0 THEN NULL ELSE CAST(1 - l.toxic AS DOUBLE) END AS candidate,
        CAST(d.n_chars AS DOUBLE) / 100 AS base_s, CAST(d.n_chars AS DOUBLE) / 120 AS candidate_s FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id""",
    "assessed": """SELECT o_orderkey AS item, o_custkey AS cluster, CASE o_orderkey % 7 WHEN 0 THEN 'better' WHEN 1 THEN 'alike' WHEN 2 THEN 'worse' WHEN 3 THEN 'unread' WHEN 4 THEN 'poor' WHEN 5 THEN 'few' ELSE 'mixed' END AS assessment,
        CASE WHEN o_orderkey % 7 IN (0, 4) THEN 0.0 WHEN o_orderkey % 7 IN (1, 2) THEN 1.0 WHEN o_totalprice > 150000 THEN 1.0 ELSE 0.0 END AS base,
        CASE WHEN o_orderkey % 7 = 3 AND o_custkey % 5 = 0 THEN NULL WHEN o_orderkey % 7 IN (0, 1) THEN 1.0 WHEN o_orderkey % 7 = 4 THEN 0.0 WHEN o_orderkey % 7 = 2 AND o_custkey % 3 = 0 THEN 0.0 ELSE 1.0 END AS candidate FROM {orders}""",
    "annotations": """SELECT CAST(floor(p_partkey / 3) AS BIGINT) AS item, p_size % 3 AS annotator, CASE WHEN CAST(floor(p_partkey / 3) AS BIGINT) % 2 = 0 THEN 'a' ELSE p_type END AS value FROM {part}""",
    "adjudications": """SELECT CAST(s_suppkey AS BIGINT) AS item, 'judged' AS value FROM {supplier}""",
    "nodes": """SELECT concat('n', CAST(o_orderkey AS VARCHAR(20))) AS id,
        CASE o_orderkey % 6 WHEN 0 THEN 'edit' WHEN 1 THEN 'clause' WHEN 2 THEN 'run' WHEN 3 THEN 'pattern' WHEN 4 THEN 'conform' ELSE CASE WHEN o_custkey % 4 = 0 THEN 'calibration' ELSE 'edit' END END AS kind,
        CASE o_custkey % 5 WHEN 0 THEN 'proposed' WHEN 1 THEN 'accepted' WHEN 2 THEN 'accepted' WHEN 3 THEN 'superseded' ELSE CASE WHEN o_orderkey % 6 = 3 THEN 'resolved' ELSE 'rejected' END END AS status,
        CASE o_custkey % 4 WHEN 0 THEN 'MUST' WHEN 1 THEN 'MAY' WHEN 2 THEN 'SHOULD' ELSE NULL END AS modality,
        CASE WHEN o_custkey % 2 = 0 THEN 'held-in' ELSE 'held-out' END AS split, CASE WHEN o_totalprice > 150000 THEN 'improve' ELSE 'hold' END AS verdict,
        CASE o_custkey % 10 WHEN 0 THEN 'tool-implementation' WHEN 1 THEN 'system-prompt' WHEN 2 THEN 'tool-description' WHEN 3 THEN 'middleware' WHEN 4 THEN 'subagent-config'
             WHEN 5 THEN 'memory' WHEN 6 THEN 'verifier' ELSE 'skill' END AS component, CASE WHEN o_custkey % 7 < 3 THEN 'auto' ELSE 'person' END AS approval,
        CASE o_custkey % 11 WHEN 0 THEN NULL WHEN 1 THEN 'verifier' WHEN 2 THEN 'tracer' WHEN 3 THEN 'model-config' WHEN 4 THEN 'system-prompt' WHEN 5 THEN 'tool-description' WHEN 6 THEN 'tool-implementation'
             WHEN 7 THEN 'middleware' WHEN 8 THEN 'subagent-config' WHEN 9 THEN 'memory' ELSE 'skill' END AS touched,
        CAST(o_orderdate AS DATE) AS in_force_from, CASE WHEN o_custkey % 2 = 0 THEN CAST(o_orderdate AS DATE) + INTERVAL 700 DAY ELSE NULL END AS in_force_until FROM {orders}""",
    "edges": """SELECT concat('n', CAST(l_orderkey AS VARCHAR(20))) AS src, concat('n', CAST(1 + (l_partkey * 7 + l_suppkey) % 1000 AS VARCHAR(20))) AS dst,
        CASE l_partkey % 9 WHEN 0 THEN 'supersedes' WHEN 1 THEN 'enforces' WHEN 2 THEN 'premise' WHEN 3 THEN 'deviates-from' WHEN 4 THEN 'counterexample'
             WHEN 5 THEN 'interop' WHEN 6 THEN 'predicts' WHEN 7 THEN 'validates' ELSE 'about' END AS name FROM {lineitem}""",
    "links": """SELECT concat('u', CAST(user_id AS VARCHAR(20))) AS src, concat('u', CAST(next AS VARCHAR(20))) AS dst, CASE event_type WHEN 'click' THEN 'supersedes' WHEN 'view' THEN 'excepts' ELSE 'about' END AS name
        FROM (SELECT user_id, event_type, value, lead(user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS next FROM {events}) x
        WHERE next IS NOT NULL AND CASE event_type WHEN 'click' THEN user_id % 5 < 2 AND value > 12 ELSE user_id % 7 < 4 AND value > 15 END""",
    "judged": """SELECT CAST(floor(event_id / 3) AS BIGINT) AS item, event_id % 3 AS seed,
        CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'no_candidate' ELSE 'selected' END AS outcome,
        CASE WHEN event_type IN ('error', 'signup') THEN NULL WHEN user_id % 3 = 0 THEN 'a' WHEN user_id % 3 = 1 THEN 'b' ELSE 'c' END AS candidate,
        CASE WHEN event_type = 'signup' THEN CASE user_id % 4 WHEN 0 THEN 'invalid_output' WHEN 1 THEN NULL ELSE 'all_draws' END
             WHEN user_id % 5 = 1 THEN 'condorcet winner' WHEN user_id % 5 = 2 THEN 'copeland score' ELSE NULL END AS reason,
        CASE WHEN user_id % 7 = 0 THEN 'unanimous' ELSE NULL END AS consensus, CASE WHEN user_id % 4 = 3 THEN 'shorter' ELSE NULL END AS tie_break,
        CAST(floor(value * 10) AS BIGINT) AS latency_ms, CASE WHEN event_type = 'error' AND user_id % 2 = 0 OR user_id % 31 = 0 THEN 'exit 1' WHEN user_id % 2 = 1 THEN '' ELSE NULL END AS error,
        CASE WHEN user_id % 6 = 0 THEN NULL ELSE CAST(floor(value * 8) AS DOUBLE) / 4 END AS wall_seconds FROM {events}""",
    "judged_again": """SELECT CASE WHEN value > 5 THEN CAST(floor(event_id / 3) AS BIGINT) ELSE -1 - event_id END AS item, event_id % 3 AS seed,
        CASE event_type WHEN 'signup' THEN 'no_candidate' ELSE 'selected' END AS outcome,
        CASE WHEN event_type = 'signup' THEN NULL WHEN user_id % 3 = 0 OR value > 90 THEN 'a' WHEN user_id % 3 = 1 THEN 'b' ELSE 'c' END AS candidate
        FROM {events}""",
    "human_labels": """SELECT CAST(floor(event_id / 3) AS BIGINT) AS item, concat('h', CAST(user_id % 5 AS VARCHAR(9))) AS labeler,
        CASE user_id % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' ELSE 'tie' END AS choice FROM {events}""",
    "gold": """SELECT o_orderkey AS item, CASE o_custkey % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' ELSE 'tie' END AS gold,
        CASE o_custkey % 3 WHEN 0 THEN 'close' WHEN 1 THEN 'clear' ELSE NULL END AS margin_stratum, CASE WHEN o_custkey % 5 = 0 THEN 'task' ELSE NULL END AS task_stratum FROM {orders}""",
    "orders_judged": """SELECT o_custkey AS item, o_orderkey AS pair_id, l_linenumber AS ord, CASE WHEN l_linenumber = 1 THEN 'a' ELSE 'b' END AS first,
        CASE WHEN l_linenumber = 1 THEN 'b' ELSE 'a' END AS second, CASE CAST(l_quantity AS BIGINT) % 5 WHEN 0 THEN 'tie' WHEN 1 THEN 'first' WHEN 2 THEN 'first' ELSE 'second' END AS choice,
        CASE WHEN o_custkey % 3 = 0 THEN 'disagree' ELSE NULL END AS draw_reason FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey WHERE l_linenumber <= 2""",
    "calibrations": """SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS window_to, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_totalprice / 1000000 END AS human_kappa,
        CASE WHEN o_custkey % 3 = 0 THEN 'unmeasured' WHEN o_totalprice > 200000 THEN 'yes' ELSE 'no' END AS verdict FROM {orders}""",
    "judge_settings": """SELECT o_orderkey AS run, concat('{{ "temperature" : ', CASE o_custkey % 3 WHEN 0 THEN '0.70' WHEN 1 THEN '1e0' ELSE '0' END, ',\n "model": "m<', CAST(o_custkey % 5 AS VARCHAR(9)), '> & co", "timeout_s": ', CAST(o_orderkey AS VARCHAR(20)),
        ', "extra_body": {{"z": [1, 2 , {{"b": "x y", "a": null}}], "a": true}}', CASE WHEN o_custkey % 2 = 0 THEN ', "max_tokens":512' ELSE '' END, CASE WHEN o_custkey % 7 = 0 THEN '' ELSE '}}' END) AS settings FROM {orders}""",
    "reuse_keys": """SELECT o_orderkey AS run, concat('t', CAST(o_custkey AS VARCHAR(20))) AS task, CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE 'r<1>' END AS rubric, CASE WHEN o_custkey % 5 = 0 THEN '' ELSE 'ref&' END AS reference,
        o_orderstatus AS prompt_version, o_custkey % 2 = 0 AS allow_tie, o_orderkey % 3 AS seed, o_custkey AS k FROM {orders}""",
    "saved_runs": """SELECT p_partkey AS run, p_brand AS model, p_type AS suite, p_size % 5 AS seeds FROM {part}""",
    "wanted_runs": """SELECT CASE WHEN p_size > 3 THEN p_partkey ELSE -p_partkey END AS run, CASE WHEN p_partkey % 7 = 0 THEN 'other' ELSE p_brand END AS model, p_type AS suite, p_size % 10 AS seeds FROM {part}""",
    "band_obs": """SELECT CAST(s_nationkey % 3 AS VARCHAR(9)) AS task, s_nationkey AS run_id, concat('i', CAST(s_suppkey % 4 AS VARCHAR(9))) AS invariant,
        CASE WHEN s_nationkey % 3 = 1 AND s_suppkey % 5 = 0 THEN 'r2' ELSE 'r1' END AS rev FROM {supplier}""",
    "user_sets": """SELECT user_id, event_type, CASE WHEN value > 20 THEN 'left' ELSE 'right' END AS side FROM {events}""",
    "errors": """SELECT event_id, CASE user_id % 6 WHEN 0 THEN 'HTTP 429 Too Many Requests' WHEN 1 THEN concat(chr(9), ' status 413:  ', chr(160), ' payload ', chr(10)) WHEN 2 THEN 'HTTP 400: maximum context length'
        WHEN 3 THEN 'HTTP 401' WHEN 4 THEN concat('HTTP 500: ', repeat('é', CAST(event_id % 200 AS INT))) ELSE concat('HTTP 418 ', props, props, props, props, props, props, props, props, props, props, props, props, props, props, props, props, props, props) END AS error FROM {events}""",
}

#: Edits with surfaces that do not follow from their status: any kind of node may name the tool's implementation.
VIEWS["surface_nodes"] = re.sub(r"CASE o_custkey % 10 WHEN 0 THEN 'tool-implementation'.*?END AS component", "CASE WHEN o_custkey % 3 = 0 THEN 'tool-implementation' ELSE 'skill' END AS component", VIEWS["nodes"], flags=re.DOTALL)


def fields(sql: str) -> list[str]:
    return sorted({f for _, f, _, _ in Formatter().parse(sql) if f})


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a table where no view has that name."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name]
    return spark.sql(sql, **{t: load(spark, sf_dir, t) for t in fields(sql)})


def oracle(sql: str) -> str:
    """The views that a statement names, put before it for DuckDB."""
    used = [v for v in VIEWS if re.search(rf"\b(FROM|JOIN)\s+{v}\b", sql)]
    named = [f"{v} AS ({VIEWS[v].format(**{t: t for t in fields(VIEWS[v])})})" for v in used]
    head = ", ".join(named)
    if started := re.match(r"\s*WITH (RECURSIVE )?", sql):
        return f"{started[0]}{head}, {sql[started.end():]}" if head else sql
    return f"WITH {head} {sql}" if head else sql
