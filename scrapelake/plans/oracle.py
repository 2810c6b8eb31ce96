"""The registered queries as SQL over the same tables, written from the semantics alone."""

from __future__ import annotations

from scrapelake.plans.checks import CUTOFF_MS, INSTANTS, MAX_AGE_MS, PRUNED_MS, SIX_HOURS_MS
from scrapelake.plans.fixtures import AT_MS, BODY_CAP, HISTOGRAM_AT_MS, YEAR_MS

_EVENTS = """
WITH ev AS (
  SELECT event_id, user_id, event_type, value AS raw_value, epoch_us(ts) // 1000 AS ts_ms,
    CASE WHEN event_id % 97 = 0 THEN 'NaN' WHEN event_id % 101 = 0 THEN '+Inf'
         WHEN event_id % 103 = 0 THEN '-Inf' END AS value_repr,
    CASE WHEN event_id % 97 = 0 OR event_id % 101 = 0 OR event_id % 103 = 0 THEN NULL
         ELSE value END AS value,
    CASE WHEN user_id % 3 = 0 THEN 'gold' ELSE '' END AS tier,
    '{"event_type":"' || event_type || '",'
      || CASE WHEN user_id % 3 = 0 THEN '"tier":"gold",' ELSE '' END
      || '"user":"' || user_id || '"}' AS labels_key
  FROM events),
ids AS (SELECT *, sha256('event_value|' || labels_key) AS series_id FROM ev)
"""

_SELECTED = f"""'event_value' AS metric_name, labels_key, ts_ms AS sample_timestamp_ms, value,
  value_repr, event_id AS scrape_id, {AT_MS} - ts_ms AS age_ms"""


def _instant(where: str = "TRUE", after: str = "TRUE") -> str:
    return f"""{_EVENTS}, latest AS (
      SELECT * FROM ids WHERE ts_ms <= {AT_MS} AND ({where})
      QUALIFY row_number() OVER (PARTITION BY labels_key ORDER BY ts_ms DESC) = 1)
    SELECT {_SELECTED} FROM latest WHERE {after}"""


_IN_RANGE = f"ts_ms > {AT_MS - SIX_HOURS_MS} AND ts_ms <= {AT_MS}"

_LINES = f"""
WITH li AS (
  SELECT l_returnflag AS flag, l_linestatus AS status, l_quantity AS q,
    epoch_us(date_trunc('month', l_shipdate)) // 1000 AS ts_ms,
    (year(l_shipdate) * 12 + month(l_shipdate)) % 6 AS fault
  FROM lineitem),
hg AS (
  SELECT flag, status, ts_ms, fault,
    count(*) FILTER (q <= 10) AS c10, count(*) FILTER (q <= 20) AS c20,
    count(*) FILTER (q <= 30) AS c30, count(*) FILTER (q <= 40) AS c40, count(*) AS n,
    sum(CAST(q AS DECIMAL(18,2)))::DOUBLE AS total,
    '{{"flag":"' || flag || '","status":"' || status || '"}}' AS labels_key
  FROM li WHERE ts_ms <= {HISTOGRAM_AT_MS} GROUP BY ALL),
latest AS (
  SELECT * FROM hg QUALIFY row_number() OVER (PARTITION BY labels_key ORDER BY ts_ms DESC) = 1),
ranged AS (SELECT * FROM hg WHERE ts_ms > {HISTOGRAM_AT_MS - YEAR_MS})
"""

_ORDERS = f"""
WITH od AS (
  SELECT o_orderpriority AS priority, o_totalprice AS v,
    epoch_us(date_trunc('month', o_orderdate)) // 1000 AS ts_ms,
    (year(o_orderdate) * 12 + month(o_orderdate)) % 5 AS fault
  FROM orders),
sg AS (
  SELECT priority, ts_ms, fault, min(v) AS low, max(v) AS high, count(*) AS n,
    floor((round(min(v) * 100) + round(max(v) * 100)) / 2) / 100 AS middle,
    sum(CAST(v AS DECIMAL(18,2)))::DOUBLE / 100 AS total,
    '{{"priority":"' || priority || '"}}' AS labels_key
  FROM od WHERE ts_ms <= {HISTOGRAM_AT_MS} GROUP BY ALL),
latest AS (
  SELECT * FROM sg QUALIFY row_number() OVER (PARTITION BY labels_key ORDER BY ts_ms DESC) = 1),
ranged AS (SELECT * FROM sg WHERE ts_ms > {HISTOGRAM_AT_MS - YEAR_MS})
"""


def _sample(value: str) -> str:
    """JSON of one component sample of the month ``ts_ms``."""
    return (
        f"""'{{"timestamp_ms":' || ts_ms || ',"value":' || ({value})::DOUBLE """
        f"""|| ',"value_repr":null,"scrape_id":1,"collected_at_ms":' || (ts_ms + 10)"""
        f""" || ',"age_ms":' || ({HISTOGRAM_AT_MS} - ts_ms) || '}}'"""
    )


def _entries(label: str, items: list[tuple[str, str]]) -> str:
    parts = [f"""'{{"{label}":"{b}","sample":' || {_sample(v)} || '}}'""" for b, v in items]
    return " || ',' || ".join(parts)


_BUCKETS = [("10", "c10"), ("20", "c20"), ("30", "c30"), ("40", "c40"), ("+Inf", "n")]
_QUANTILES = [("0", "low"), ("0.5", "middle"), ("1", "high")]


def _group_json(array: str, entries: str, timestamp: str) -> str:
    return (
        f"""'{{"labels":' || labels_key || ',"timestamp_ms":' || {timestamp} || ',"{array}":['"""
        f""" || {entries} || '],"count":' || {_sample("n")} || ',"sum":' || {_sample("total")} || '}}'"""
    )


def _flat(source: str, time: str, name: str, bound: str, items: list[tuple[str, str]]) -> str:
    rows = [(name, b, v) for b, v in items] + [("count", "", "n"), ("sum", "", "total")]
    selects = [
        f"""SELECT labels_key AS labels, {time} AS timestamp_ms, '{part}' AS component,
            '{b}' AS {bound}, CAST(({v})::DOUBLE AS VARCHAR) AS value FROM {source}"""
        for part, b, v in rows
    ]
    return " UNION ALL ".join(selects)


_NULL_TIME = "CAST(NULL AS BIGINT)"

_HISTOGRAM_ERROR = """CASE fault
  WHEN 1 THEN 'incomplete stored histogram group: missing +Inf bucket'
  WHEN 2 THEN 'incomplete stored histogram group' WHEN 3 THEN 'incomplete stored histogram group'
  WHEN 4 THEN 'histogram +Inf bucket does not equal _count'
  WHEN 5 THEN 'histogram bucket is missing its le label' END"""

_SUMMARY_ERROR = """CASE fault WHEN 4 THEN 'summary sample is missing its quantile label'
  WHEN 0 THEN NULL ELSE 'incomplete stored summary group' END"""

_PAYLOADS = f"""{_EVENTS},
pe AS (SELECT *, event_id // 250 AS p, event_id % 250 AS place FROM ids),
g AS (
  SELECT p, max(ts_ms) AS last_ms, min(raw_value) AS low, max(raw_value) AS high,
    count(*) FILTER (raw_value <= 10) AS c10, count(*) FILTER (raw_value <= 20) AS c20,
    count(*) FILTER (raw_value <= 30) AS c30, count(*) FILTER (raw_value <= 40) AS c40,
    count(*) AS n, max(place) AS last_place,
    sum(CAST(raw_value AS DECIMAL(18,2)))::DOUBLE AS total
  FROM pe GROUP BY p),
m AS (
  SELECT *, last_ms + 1000 AS started, last_ms + 1100 + p % 50 AS finished, p % 13 AS fault,
    p % 17 = 16 AS unresolved, 'http://t' || p || '.example/metrics' AS url, p % 3 + 1 AS tries,
    CASE WHEN p % 5 = 0 THEN '2001:db8::' || p
         ELSE '10.0.' || (p // 200) % 200 || '.' || p % 200 END AS ip,
    CASE WHEN p % 5 = 0 THEN '[2001:db8::' || p || ']:9090'
         ELSE '10.0.' || (p // 200) % 200 || '.' || p % 200 || ':9090' END AS instance
  FROM g),
parts AS (
  SELECT p, '' AS event_type, '' AS le, '' AS quantile, '' AS tier, '' AS usr, m.started AS ts_ms,
    'batch_value_count' AS metric_name, 'batch_value' AS family_name,
    'histogram' AS metric_type, n::DOUBLE AS value, NULL AS value_repr, 1000 AS line FROM m
  UNION ALL SELECT p, '', '', '', '', '', started, 'batch_value_sum', 'batch_value', 'histogram', total, NULL, 1000 FROM m
  UNION ALL SELECT p, '', '10', '', '', '', started, 'batch_value_bucket', 'batch_value', 'histogram', c10, NULL, 1000 FROM m
  UNION ALL SELECT p, '', '20', '', '', '', started, 'batch_value_bucket', 'batch_value', 'histogram', c20, NULL, 1000 FROM m
  UNION ALL SELECT p, '', '30', '', '', '', started, 'batch_value_bucket', 'batch_value', 'histogram', c30, NULL, 1000 FROM m
  UNION ALL SELECT p, '', '40', '', '', '', started, 'batch_value_bucket', 'batch_value', 'histogram', c40, NULL, 1000 FROM m
  UNION ALL SELECT p, '', '+Inf', '', '', '', started, 'batch_value_bucket', 'batch_value', 'histogram', n, NULL, 1000 FROM m
  UNION ALL SELECT p, '', '', '0', '', '', started, 'batch_quantile', 'batch_quantile', 'summary', low, NULL, 1000 FROM m
  UNION ALL SELECT p, '', '', '1', '', '', started, 'batch_quantile', 'batch_quantile', 'summary', high, NULL, 1000 FROM m
  UNION ALL SELECT p, '', '', '', '', '', started, 'batch_quantile_count', 'batch_quantile', 'summary', n, NULL, 1000 FROM m
  UNION ALL SELECT p, '', '', '', '', '', started, 'batch_quantile_sum', 'batch_quantile', 'summary', total, NULL, 1000 FROM m
  UNION ALL SELECT p, event_type, '', '', tier, CAST(user_id AS VARCHAR),
    CASE WHEN p % 7 = 0 THEN m.started ELSE pe.ts_ms END, 'event_value', 'event_value', 'gauge',
    value, value_repr, place FROM pe JOIN m USING (p)),
merged AS (
  SELECT parts.*,
    '{{"cluster":"c' || p % 3 || '",'
    || CASE WHEN event_type <> '' THEN '"event_type":"' || event_type || '",' ELSE '' END
    || '"instance":"' || instance || '","job":"m' || p % 4 || '",'
    || CASE WHEN le <> '' THEN '"le":"' || le || '",' ELSE '' END
    || '"module":"m' || p % 4 || '",'
    || CASE WHEN quantile <> '' THEN '"quantile":"' || quantile || '",' ELSE '' END
    || '"resolved_ip":"' || ip || '","role":"primary","system":"shop"'
    || CASE WHEN tier <> '' THEN ',"tier":"gold"' ELSE '' END
    || CASE WHEN usr <> '' THEN ',"user":"' || usr || '"' ELSE '' END || '}}' AS labels_key
  FROM parts JOIN m USING (p)),
helped AS (
  SELECT *, CASE family_name WHEN 'batch_value' THEN 'values of one payload'
      WHEN 'event_value' THEN CASE WHEN line >= 100 THEN 'revised help' ELSE 'value of one event' END
      END AS help,
    CASE WHEN family_name = 'event_value' AND line >= 200 THEN 'points' END AS unit
  FROM merged),
audit AS (
  SELECT *, CASE WHEN unresolved THEN 'cannot resolve t' || p ELSE CASE fault
      WHEN 1 THEN 'metrics response is not valid UTF-8'
      WHEN 2 THEN 'type mismatch for event_value: configured gauge, endpoint counter'
      WHEN 3 THEN 'invalid selected Prometheus text: event_value{{user="1" 5'
      WHEN 4 THEN 'sample limit (300) exceeded'
      WHEN 5 THEN 'label value limit (1024) exceeded for note'
      WHEN 6 THEN 'required metric family is missing: batch_value'
      WHEN 7 THEN 'metrics endpoint returned non-text Content-Type ''application/json'': ' || url
      WHEN 8 THEN 'metrics endpoint returned HTTP 503: ' || url
      WHEN 9 THEN 'histogram batch_value +Inf bucket does not equal _count'
      WHEN 10 THEN 'incomplete summary batch_quantile'
      WHEN 11 THEN 'invalid selected Prometheus text: {{user="1"}} 5'
      WHEN 12 THEN 'incomplete histogram batch_value: bucket lacks le' END END AS error
  FROM m),
scrapes AS (
  SELECT *, CASE WHEN error IS NULL THEN 'success' ELSE 'failed' END AS status,
    CASE WHEN error IS NULL THEN n + 11 ELSE 0 END AS sample_count,
    CASE WHEN unresolved THEN NULL WHEN error IS NULL THEN 200 WHEN fault = 8 THEN 503 END
      AS http_status,
    CASE WHEN unresolved THEN 0 ELSE tries END AS attempts,
    CASE WHEN unresolved THEN '' ELSE ip END AS resolved,
    CASE WHEN unresolved
      THEN '{{"job":"m' || p % 4 || '","module":"m' || p % 4 || '","resolved_ip":"","system":"shop"}}'
      ELSE '{{"cluster":"c' || p % 3 || '","instance":"' || instance || '","job":"m' || p % 4
        || '","module":"m' || p % 4 || '","resolved_ip":"' || ip
        || '","role":"primary","system":"shop"}}' END AS own_labels
  FROM audit)
"""

_SYNTHETIC = " UNION ALL ".join(
    f"""SELECT p AS scrape_id, 'scrapelake_{name}' AS metric_name, own_labels AS labels_key,
        finished AS sample_timestamp_ms, ({value})::DOUBLE AS value FROM scrapes"""
    for name, value in (
        ("up", "CASE WHEN error IS NULL THEN 1 ELSE 0 END"),
        (
            "scrape_duration_seconds",
            "CASE WHEN unresolved THEN 0 ELSE (finished - started) / 1000.0 END",
        ),
        ("scrape_samples", "sample_count"),
        ("scrape_attempts", "attempts"),
    )
)

_STORED_SAMPLES = f"""{_PAYLOADS}
SELECT metric_name, labels_key, ts_ms AS sample_timestamp_ms, value, value_repr, p AS scrape_id
FROM merged
QUALIFY row_number() OVER (PARTITION BY metric_name, labels_key, ts_ms ORDER BY p DESC, line DESC) = 1"""

_UPSERT = f"""{_EVENTS}, daily AS (
  SELECT *, ts_ms // 86400000 * 86400000 AS day_ms FROM ids)
SELECT series_id, day_ms AS sample_timestamp_ms, value, value_repr, event_id AS scrape_id,
  ts_ms + 10 AS collected_at_ms FROM daily
QUALIFY row_number() OVER (PARTITION BY labels_key, day_ms ORDER BY event_id DESC) = 1"""


def _merge(honor: bool) -> str:
    if honor:
        exported = """CASE WHEN event_id % 4 = 0 THEN '"exported_job":"old",' ELSE '' END"""
        job = "CASE WHEN event_id % 2 = 0 THEN 'exporter' ELSE 'api' END"
        user = "CAST(user_id AS VARCHAR)"
    else:
        exported = """CASE WHEN event_id % 4 = 0
            THEN '"exported_exported_job":"exporter","exported_job":"old",'
            WHEN event_id % 2 = 0 THEN '"exported_job":"exporter",' ELSE '' END
          || CASE WHEN event_id % 3 = 0 THEN '"exported_user":"' || user_id || '",' ELSE '' END"""
        job = "'api'"
        user = "CASE WHEN event_id % 3 = 0 THEN 'collector' ELSE CAST(user_id AS VARCHAR) END"
    return f"""SELECT event_id, '{{"cluster":"prod","event_type":"' || event_type || '",'
      || {exported} || '"job":"' || {job} || '","resolved_ip":"10.0.0.' || event_id % 250 || '",'
      || CASE WHEN user_id % 3 = 0 THEN '"tier":"gold",' ELSE '' END
      || '"user":"' || {user} || '"}}' AS labels_key FROM events"""


_RULES = """
WITH r AS (
  SELECT CASE WHEN p_partkey % 11 = 0 THEN '' ELSE p_brand END AS system,
    'm' || p_partkey % 7 AS module,
    CASE WHEN p_partkey % 13 = 0 THEN '9bad-' || p_partkey % 50
         ELSE 'metric_' || p_partkey % 50 END AS name,
    CASE WHEN p_partkey % 17 = 0 THEN 'rate' ELSE 'gauge' END AS metric_type
  FROM part)
"""

_TARGETS = """
t AS (
  SELECT c_custkey AS k,
    'landed/' || (c_custkey // 2 * 2 + CASE WHEN c_custkey % 10 = 1 THEN 0 ELSE c_custkey % 2 END) AS path,
    CASE WHEN c_custkey % 11 = 0 THEN ' ' ELSE 'Brand#' || c_custkey % 30 END AS system,
    'm' || c_custkey % 9 AS module
  FROM customer)
"""

ORACLE: dict[str, str] = {
    "series_key": f"""{_EVENTS} SELECT DISTINCT series_id, 'event_value' AS metric_name, labels_key
        FROM ids""",
    "instant_latest": _instant(),
    "instant_max_age": _instant(after=f"{AT_MS} - ts_ms <= {MAX_AGE_MS}"),
    "range_open_closed": f"{_EVENTS} SELECT {_SELECTED} FROM ids WHERE {_IN_RANGE}",
    "match_eq": _instant("event_type = 'click' AND tier = 'gold'"),
    "match_eq_empty": _instant("tier = ''"),
    "match_ne_missing": _instant("tier <> 'gold'"),
    "match_regex": _instant(
        "regexp_full_match(event_type, 'click|view') AND regexp_full_match(CAST(user_id AS VARCHAR), '[0-9]{1,2}')"
    ),
    "match_regex_classes": _instant("event_type IN ('click', 'view')"),
    "match_not_regex": _instant(
        "NOT regexp_full_match(event_type, '(c.*|v.*)') AND event_type <> 'error'"
    ),
    "limit_counts": f"""{_EVENTS} SELECT count(DISTINCT labels_key) AS series_count,
        count(*) AS sample_count FROM ids WHERE {_IN_RANGE}""",
    "result_flat": f"""{_EVENTS} SELECT 'event_value' AS metric, labels_key AS labels,
        ts_ms AS sample_ms, ts_ms + 10 AS collected_ms, {AT_MS} - ts_ms AS age_ms,
        coalesce(value_repr, CAST(value AS VARCHAR)) AS value
        FROM ids WHERE ts_ms <= {AT_MS}
        QUALIFY row_number() OVER (PARTITION BY labels_key ORDER BY ts_ms DESC) = 1""",
    "result_nested": f"""{_EVENTS}, latest AS (
        SELECT * FROM ids WHERE ts_ms <= {AT_MS}
        QUALIFY row_number() OVER (PARTITION BY labels_key ORDER BY ts_ms DESC) = 1)
        SELECT 'event_value' AS metric_name, labels_key,
        '{{"id":"' || series_id || '","metric_name":"event_value",'
        || '"family_name":"event_value","metric_type":"gauge","labels":' || labels_key
        || ',"samples":[{{"timestamp_ms":' || ts_ms || ',"value":'
          || coalesce(CAST(value AS VARCHAR), 'null') || ',"value_repr":'
          || coalesce('"' || value_repr || '"', 'null') || ',"scrape_id":' || event_id
          || ',"collected_at_ms":' || (ts_ms + 10) || ',"age_ms":' || ({AT_MS} - ts_ms)
        || '}}]}}' AS series_json
        FROM latest""",
    "nested_range": f"""{_EVENTS}
        SELECT 'event_value' AS metric_name, labels_key,
        '{{"id":"' || series_id || '","metric_name":"event_value",'
        || '"family_name":"event_value","metric_type":"gauge","labels":' || labels_key
        || ',"samples":[' || string_agg('{{"timestamp_ms":' || ts_ms || ',"value":'
          || coalesce(CAST(value AS VARCHAR), 'null') || ',"value_repr":'
          || coalesce('"' || value_repr || '"', 'null') || ',"scrape_id":' || event_id
          || ',"collected_at_ms":' || (ts_ms + 10) || ',"age_ms":' || ({AT_MS} - ts_ms)
          || '}}', ',' ORDER BY ts_ms) || ']}}' AS series_json
        FROM ids WHERE {_IN_RANGE} GROUP BY series_id, labels_key""",
    "histogram_view": f"""{_LINES} SELECT labels_key, {_NULL_TIME} AS timestamp_ms,
        {_group_json("buckets", _entries("le", _BUCKETS), "'null'")} AS group_json FROM latest""",
    "histogram_range": f"""{_LINES} SELECT labels_key, ts_ms AS timestamp_ms,
        {_group_json("buckets", _entries("le", _BUCKETS), "ts_ms")} AS group_json FROM ranged""",
    "histogram_matched": f"""{_LINES} SELECT labels_key, 4 AS n_buckets,
        'incomplete stored histogram group: missing +Inf bucket' AS error FROM latest""",
    "histogram_violations": f"""{_LINES} SELECT labels_key, ts_ms AS timestamp_ms,
        {_HISTOGRAM_ERROR} AS error FROM ranged""",
    "summary_view": f"""{_ORDERS} SELECT labels_key, {_NULL_TIME} AS timestamp_ms,
        {_group_json("quantiles", _entries("quantile", _QUANTILES), "'null'")} AS group_json
        FROM latest""",
    "summary_violations": f"""{_ORDERS} SELECT labels_key, ts_ms AS timestamp_ms,
        {_SUMMARY_ERROR} AS error FROM ranged""",
    "view_flat": f"{_LINES} {_flat('ranged', 'ts_ms', 'bucket', 'bound', _BUCKETS)}",
    "summary_flat": f"{_ORDERS} {_flat('latest', _NULL_TIME, 'quantile', 'quantile', _QUANTILES)}",
    "upsert_last_wins": _UPSERT,
    "series_first_wins": f"""{_EVENTS} SELECT series_id, 'family_' || event_id % 5 AS family_name,
        CASE WHEN event_id % 2 = 0 THEN 'gauge' ELSE 'untyped' END AS metric_type FROM ids
        QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY event_id) = 1""",
    "metadata_last_wins": f"""{_PAYLOADS}
        SELECT 'shop' AS system, 'm' || p % 4 AS module, family_name, metric_type, help, unit,
          finished AS updated_at_ms FROM helped JOIN m USING (p)
        QUALIFY row_number() OVER (PARTITION BY p % 4, family_name ORDER BY p DESC, line DESC) = 1""",
    "parse_round_trip": f"""{_PAYLOADS}
        SELECT p AS scrape_id, metric_name, family_name, metric_type, labels_key,
          ts_ms AS sample_timestamp_ms, value, value_repr FROM merged""",
    "parse_errors": f"""{_PAYLOADS}
        SELECT p AS scrape_id, status, error, http_status, attempts, sample_count,
          CASE WHEN unresolved THEN url ELSE instance END AS instance FROM scrapes""",
    "help_unit_carry": f"""{_PAYLOADS}
        SELECT p AS scrape_id, family_name, help, unit, count(*) AS n FROM helped GROUP BY ALL""",
    "merge_honor": _merge(True),
    "merge_exported": _merge(False),
    "merged_limits": """
        WITH c AS (SELECT event_id, 5 + (user_id % 3 = 0)::INT + (event_id % 4 = 0)::INT AS n,
          length('10.0.0.' || event_id % 250) AS bytes FROM events)
        SELECT event_id, CASE WHEN n > 6 THEN 'merged label limit (6) exceeded'
          ELSE 'merged label value limit (8) exceeded for resolved_ip' END AS error
        FROM c WHERE n > 6 OR bytes > 8""",
    "label_rows": f"""{_EVENTS} SELECT DISTINCT series_id, 'event_type' AS name, event_type AS value
        FROM ids UNION ALL SELECT DISTINCT series_id, 'user', CAST(user_id AS VARCHAR) FROM ids
        UNION ALL SELECT DISTINCT series_id, 'tier', 'gold' FROM ids WHERE tier = 'gold'""",
    "label_groups": f"""{_EVENTS} SELECT '{{"event_type":"' || event_type || '"'
          || CASE WHEN tier = 'gold' THEN ',"tier":"gold"' ELSE '' END || '}}' AS group_key,
        count(DISTINCT series_id) AS n_series FROM ids GROUP BY ALL""",
    "scraped": f"""{_PAYLOADS}
        SELECT p AS scrape_id, metric_name, count(*) AS n FROM merged
          WHERE p IN (SELECT p FROM scrapes WHERE error IS NULL) GROUP BY ALL
        UNION ALL SELECT scrape_id, metric_name, 1 FROM ({_SYNTHETIC})""",
    "synthetic_samples": f"{_PAYLOADS} {_SYNTHETIC}",
    "run_status": f"""{_PAYLOADS}
        SELECT p // 8 AS run_id, min(started) AS started_at_ms, max(finished) AS finished_at_ms,
          count(*) FILTER (error IS NULL) AS successful_targets,
          count(*) FILTER (error IS NOT NULL) AS failed_targets,
          CASE WHEN count(error) = 0 THEN 'success' WHEN count(error) < count(*) THEN 'partial'
               ELSE 'failed' END AS status FROM scrapes GROUP BY p // 8""",
    "run_context": f"""{_PAYLOADS}
        SELECT DISTINCT p // 8 AS run_id, '9.1' AS tool_version,
          CASE WHEN (p // 8) % 2 = 0 THEN '{{"host":"h","run":"' || p // 8 || '"}}' ELSE '{{}}' END
            AS context_json FROM scrapes""",
    "limited_result": f"{_EVENTS} SELECT {_SELECTED} FROM ids WHERE {_IN_RANGE}",
    "failure_list": f"""{_PAYLOADS}
        SELECT p // 8 AS run_id, p AS scrape_id, url, CASE WHEN NOT unresolved THEN ip END AS resolved_ip,
          error FROM scrapes WHERE error IS NOT NULL""",
    "catalogue_checks": f"""{_RULES}
        SELECT system, module, name, 'empty system' AS violation FROM r WHERE system = ''
        UNION ALL SELECT system, module, name, 'invalid metric name' FROM r
          WHERE NOT regexp_full_match(name, '[A-Za-z_:][A-Za-z0-9_:]*')
        UNION ALL SELECT system, module, name, 'invalid metric type' FROM r WHERE metric_type = 'rate'
        UNION ALL SELECT system, module, name, 'family declared more than once' FROM r
          GROUP BY ALL HAVING count(*) > 1""",
    "manifest_checks": f"""WITH {_TARGETS}
        SELECT k AS scrape_id, 'empty system' AS violation FROM t WHERE trim(system) = ''
        UNION ALL SELECT k, 'invalid target URL' FROM t WHERE k % 13 = 0
        UNION ALL SELECT k, 'invalid label name' FROM t WHERE k % 7 = 0
        UNION ALL SELECT k, 'repeated label name' FROM t WHERE k % 9 = 0
        UNION ALL SELECT min(k), 'payload path used more than once' FROM t
          GROUP BY path HAVING count(*) > 1""",
    "task_checks": f"""{_RULES}, {_TARGETS}
        SELECT DISTINCT system, module, 'task requires at least one metric' AS violation FROM t
          WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.system = t.system AND r.module = t.module)
        UNION ALL SELECT DISTINCT system, module, 'task requires at least one target' FROM r
          WHERE NOT EXISTS (SELECT 1 FROM t WHERE r.system = t.system AND r.module = t.module)""",
    "value_checks": """
        WITH c AS (SELECT event_id, event_id % 8 AS k FROM events)
        SELECT event_id, CASE k WHEN 1 THEN 'exactly one of value and value_repr must be present'
            WHEN 5 THEN 'exactly one of value and value_repr must be present'
            WHEN 2 THEN 'exactly one of value and value_repr must be present'
            WHEN 4 THEN 'value must be a finite number'
            WHEN 6 THEN 'value must be a finite number'
            WHEN 3 THEN 'value_repr must be NaN, +Inf, or -Inf' END AS violation
        FROM c WHERE k NOT IN (0, 7)""",
    "prune_kept": f"""{_EVENTS} SELECT series_id, ts_ms AS sample_timestamp_ms,
        event_id AS scrape_id FROM ids WHERE ts_ms >= {CUTOFF_MS}""",
    "orphan_series": f"""{_EVENTS} SELECT DISTINCT series_id, labels_key FROM ids
        WHERE ts_ms >= {CUTOFF_MS}""",
    "lake_orphans": f"""{_EVENTS} SELECT DISTINCT series_id, labels_key FROM ids
        WHERE ts_ms >= {CUTOFF_MS}""",
    "series_activity": f"""{_EVENTS} SELECT series_id, CAST(min(ts_ms // 86400000) AS BIGINT) AS first_day,
        CAST(max(ts_ms // 86400000) AS BIGINT) AS last_day, count(DISTINCT ts_ms // 86400000) AS n_days
        FROM ids WHERE ts_ms >= {CUTOFF_MS} OR event_id % 3 = 2 GROUP BY series_id""",
    "lake_pruned": f"""{_EVENTS} SELECT series_id, labels_key, ts_ms AS sample_timestamp_ms,
        event_id AS scrape_id FROM ids WHERE ts_ms >= {CUTOFF_MS}""",
    "compact_current": _UPSERT,
    "lake_recovered": f"""{_EVENTS} SELECT series_id, labels_key, ts_ms AS sample_timestamp_ms,
      event_id AS scrape_id FROM ids WHERE event_id % 2 = 0""",
    "lake_instant": _instant("event_type IN ('click', 'view') AND tier <> 'gold'"),
    "lake_range": f"""{_EVENTS} SELECT {_SELECTED} FROM ids
      WHERE event_type IN ('click', 'view') AND tier <> 'gold' AND {_IN_RANGE}""",
    "lake_replayed": _STORED_SAMPLES,
    "stream_packed": _STORED_SAMPLES,
    "shared_task_module": f"""{_PAYLOADS}
      SELECT p AS scrape_id, family_name, count(*) AS n FROM merged
      WHERE p % 4 = 1 OR family_name <> 'batch_value' GROUP BY ALL""",
    "quarantine": f"""{_RULES},
      t AS (
        SELECT c_custkey AS k, CASE WHEN c_custkey % 6 = 5 THEN c_custkey - 1 ELSE c_custkey END AS scrape_id,
          'landed/' || (c_custkey // 2 * 2 + CASE WHEN c_custkey % 10 = 1 THEN 0
            ELSE c_custkey % 2 END) AS path,
          CASE WHEN c_custkey % 11 = 0 THEN ' ' ELSE 'Brand#' || c_custkey % 30 END AS system,
          'm' || c_custkey % 9 AS module
        FROM customer),
      n AS (
        SELECT *, count(*) OVER (PARTITION BY scrape_id) AS ids,
          count(*) OVER (PARTITION BY path) AS paths FROM t),
      v AS (
        SELECT *, CASE WHEN system = '' THEN 'empty system'
          WHEN NOT regexp_full_match(name, '[A-Za-z_:][A-Za-z0-9_:]*') THEN 'invalid metric name'
          WHEN metric_type = 'rate' THEN 'invalid metric type' END AS bad FROM r
        UNION ALL SELECT system, module, name, '', 'family declared more than once' FROM r
          GROUP BY system, module, name HAVING count(*) > 1),
      f AS (
        SELECT system, module, min('rule ' || name || ': ' || bad) AS fault FROM v GROUP BY ALL)
      SELECT scrape_id, path, CASE WHEN ids > 1 THEN 'scrape id used more than once'
        WHEN paths > 1 THEN 'payload path used more than once'
        WHEN trim(n.system) = '' THEN 'empty system' WHEN k % 13 = 0 THEN 'invalid target URL'
        WHEN k % 7 = 0 THEN 'invalid label name'
        WHEN f.system IS NULL THEN 'task requires at least one metric'
        ELSE coalesce(fault, '') END AS violation
      FROM n LEFT JOIN f ON f.system = n.system AND f.module = n.module""",
    "parse_compressed": f"""{_PAYLOADS}, x AS (
        SELECT *, CASE p % 6 WHEN 3 THEN 'metrics response is not valid gzip data'
          WHEN 4 THEN 'metrics response exceeds {BODY_CAP} decompressed bytes: ' || url
          WHEN 5 THEN 'metrics response has an unsupported Content-Encoding ''br''' END AS fault_text FROM m)
      SELECT p AS scrape_id, CASE WHEN fault_text IS NULL THEN 'success' ELSE 'failed' END AS status,
        fault_text AS error, CASE WHEN fault_text IS NULL THEN n + 11 ELSE 0 END AS sample_count FROM x""",
    "stream_late_manifest": _STORED_SAMPLES,
    "batch_ingest": _STORED_SAMPLES,
    "stream_equals_batch": _STORED_SAMPLES,
}
_LEFT = f"(ts_ms >= {PRUNED_MS} OR event_id % 3 = 2) AND event_type IN ('click', 'view') AND tier <> 'gold'"
ORACLE["lake_instant_indexed"] = f"""{_EVENTS}, ats AS (SELECT unnest({list(INSTANTS)})::BIGINT AS at_ms)
  SELECT at_ms, 'event_value' AS metric_name, labels_key, ts_ms AS sample_timestamp_ms, value, value_repr,
    event_id AS scrape_id, at_ms - ts_ms AS age_ms FROM ids JOIN ats ON ts_ms <= at_ms WHERE {_LEFT}
  QUALIFY row_number() OVER (PARTITION BY at_ms, labels_key ORDER BY ts_ms DESC) = 1"""
ORACLE["view_document_lines"] = f"""{_LINES}
  SELECT '{{"kind": "histogram", "selector": {{"metric_name": "line_quantity", "range_ms": {YEAR_MS}, "matchers": []}}, "at_ms": {HISTOGRAM_AT_MS}}}' AS line
  UNION ALL SELECT {_group_json("buckets", _entries("le", _BUCKETS), "ts_ms")} FROM ranged"""
ORACLE["group_order"] = f"""{_LINES} SELECT labels_key, ts_ms AS timestamp_ms FROM ranged
  ORDER BY labels_key, ts_ms LIMIT 20"""
_MATCHED = {
    "equal": "event_type = 'click' AND tier = 'gold'",
    "absent": "tier = ''",
    "unequal": "tier <> 'gold'",
    "pattern": "event_type IN ('click', 'view') AND user_id BETWEEN 0 AND 99",
    "pattern of nothing": "tier IN ('', 'silver') AND event_type <> 'view'",
    "no pattern": "event_type[1] NOT IN ('c', 'v') AND tier <> 'gold'",
    "repeated": "user_id::VARCHAR LIKE '1%' AND user_id % 5 <> 0 AND user_id <> 11",
    "unknown label": "FALSE",
}
ORACLE["match_by_postings"] = _EVENTS + " UNION ALL ".join(
    f"SELECT DISTINCT '{name}' AS matchers, series_id, labels_key FROM ids WHERE {where}"
    for name, where in _MATCHED.items()
)
ORACLE["compact_days"] = ORACLE["compact_current"]
ORACLE["lake_histogram"] = ORACLE["histogram_view"]
