"""What each registered query must return, as SQL over the same tables."""

from __future__ import annotations

from workloads.fixtures import CHECKED_KINDS, LITERALS

_CLIP = "left({0}, 47) || '...'"

_EV = """
ev AS (
  SELECT *, event_id % 20 AS m, event_id // 50 AS batch_id, CAST(event_id % 50 AS INTEGER) AS pos,
         TIMESTAMP '2024-06-01 00:00:00' + to_seconds(event_id // 50) AS ingest_time
  FROM events
),
good AS (
  SELECT batch_id, pos, ingest_time, event_id, ts, user_id,
         CASE WHEN m = 5 THEN 'unknown' ELSE event_type END AS event_type, value,
         CASE WHEN m = 6 THEN NULL ELSE props END AS props,
         CASE WHEN m = 6 THEN NULL ELSE (event_id % 90) * 60000000000 END AS dur
  FROM ev WHERE m IN (5, 6, 11, 14, 15, 16, 17, 18, 19)
),
bad AS (
  SELECT batch_id, pos, event_id, m,
         CASE WHEN m IN (9, 10) THEN 0 ELSE 1 END AS kind,
         CASE WHEN m IN (9, 10) THEN NULL WHEN m = 0 THEN 'ghost-event' ELSE 'user-event' END AS type_name,
         CASE m WHEN 0 THEN 'item_type_not_defined' WHEN 1 THEN 'missing_required_field'
                WHEN 2 THEN 'invalid_field_type' WHEN 3 THEN 'invalid_json' WHEN 4 THEN 'invalid_datetime'
                WHEN 7 THEN 'invalid_field_type' WHEN 8 THEN 'missing_required_field,invalid_field_type'
                WHEN 9 THEN 'invalid_item_structure' WHEN 10 THEN 'item_data_parsing_failed'
                WHEN 12 THEN 'invalid_timespan' WHEN 13 THEN 'invalid_field_type' END AS codes,
         CASE WHEN m = 9 THEN left('{"other":{},"user-event":{"dur":"' || (event_id % 90) || 'm","event_id":'
                                   || event_id || ',"event_type":', 47) || '...'
              WHEN m = 10 THEN '"not-an-object"' END AS split_value,
         user_id, value
  FROM ev WHERE m NOT IN (5, 6, 11, 14, 15, 16, 17, 18, 19)
)"""


def _events(select: str) -> str:
    return f"WITH {_EV.strip()}\n{select}"


def _measures(**totals: str) -> str:
    rows = [f"SELECT '{name}' AS measure, CAST((SELECT {total}) AS BIGINT) AS value" for name, total in totals.items()]
    return _events("\nUNION ALL ".join(rows))


def _field(field: str, value: str, reason: str) -> str:
    return (
        "'ingest validate_field failed for item type ''user-event'' with input ''field:" + field + " value:' || "
        + value + " || ''': " + reason + "'"
    )


_MESSAGES = f"""CASE m
  WHEN 0 THEN 'ingest convert failed for item type ''ghost-event'' with input ''item type: ghost-event'': item type not defined'
  WHEN 1 THEN {_field("user_id", "'missing'", "missing required field")}
  WHEN 2 THEN {_field("value", "CAST(value AS VARCHAR)", "invalid field type")}
  WHEN 3 THEN {_field("props", "'{bad'", "invalid JSON format")}
  WHEN 4 THEN {_field("ts", "'not-a-date'", "invalid datetime format")}
  WHEN 7 THEN {_field("props", "'<nil>'", "invalid field type")}
  WHEN 8 THEN {_field("user_id", "'missing'", "missing required field")} || ' | ' ||
              {_field("value", "CAST(value AS VARCHAR)", "invalid field type")}
  WHEN 9 THEN 'ingest split failed for item type ''item_' || pos || ''' with input ''' || split_value
              || ''': item does not have exactly one key'
  WHEN 10 THEN 'ingest split failed for item type ''item_' || pos || ''' with input ''' || split_value
              || ''': item data cannot be parsed as JSON object'
  WHEN 12 THEN {_field("dur", "'2days'", "invalid timespan format")}
  WHEN 13 THEN {_field("user_id", "user_id || '.500000'", "invalid field type")}
END"""

_DUR_TEXT = """CASE WHEN dur IS NULL THEN NULL WHEN dur = 0 THEN '0s'
  WHEN dur < 3600000000000 THEN (dur // 60000000000) || 'm0s'
  ELSE (dur // 3600000000000) || 'h' || ((dur // 60000000000) % 60) || 'm0s' END"""

_MINUTES = "(VALUES ('click', 60), ('view', 120), ('error', 7), ('signup', 10), ('purchase', 1440)) w(event_type, minutes)"

_CHAINS = f"""
e AS (SELECT event_type, event_id, date_trunc('millisecond', ts) AS t FROM events),
width AS (SELECT * FROM {_MINUTES}),
starts AS (
  SELECT event_type, min(t) AS start FROM e GROUP BY event_type
  UNION ALL
  SELECT e.event_type, min(e.t) FROM starts s JOIN width USING (event_type) JOIN e
    ON e.event_type = s.event_type AND e.t >= s.start + to_minutes(minutes) GROUP BY e.event_type
),
spans AS (SELECT event_type, start, lead(start) OVER (PARTITION BY event_type ORDER BY start) AS stop FROM starts)"""

_CHAIN = """
WITH RECURSIVE e AS (SELECT event_id, date_trunc('millisecond', ts) AS t FROM events),
starts AS (
  SELECT min(t) AS start FROM e
  UNION ALL
  SELECT t2 FROM (SELECT min(e.t) AS t2 FROM starts s JOIN e ON e.t >= s.start + INTERVAL 120 MINUTES) WHERE t2 IS NOT NULL
),
spans AS (SELECT start, lead(start) OVER (ORDER BY start) AS stop FROM starts)
SELECT event_id, start AS segment_start, strftime(start, '%Y-%m-%d_%H-%M-%S.%g') AS segment
FROM e JOIN spans ON t >= start AND (stop IS NULL OR t < stop)"""

_CHAIN_COUNTS = f"""WITH RECURSIVE {_CHAINS.strip()}
SELECT e.event_type, s.start AS segment_start, count(*) AS n
FROM e JOIN spans s ON e.event_type = s.event_type AND e.t >= s.start AND (s.stop IS NULL OR e.t < s.stop)
GROUP BY 1, 2"""

_WRONG = "invalid_field_type"


def _verdict(literal: str, accepts: str, kind: str) -> str:
    if kind in accepts.split():
        return "ok"
    if literal.startswith('"'):
        return {"datetime": "invalid_datetime", "dynamic": "invalid_json", "timespan": "invalid_timespan"}.get(kind, _WRONG)
    return _WRONG


_MATRIX = ",\n  ".join(
    f"({no}, {k}, '{kind}', '{_verdict(text, accepts, kind)}')"
    for no, (text, accepts) in enumerate(LITERALS)
    for k, kind in enumerate(CHECKED_KINDS)
)

_DRIFT_COLUMN = "'column[{0}] mismatch: stored {{\"{1}\" \"{2}\"}}, definition {{\"{3}\" \"{4}\"}}'"

_DEFINITION_NAME = """CASE WHEN p_partkey % 24 IN (1, 20) THEN NULL WHEN p_partkey % 24 = 2 THEN 'ingest_time'
  WHEN p_partkey % 24 = 3 THEN 'Part-1' WHEN p_partkey % 24 = 4 THEN 'pa' ELSE 'part-' || p_partkey END"""
_BRAND = "lower(replace(p_brand, '#', '-'))"

ORACLES: dict[str, str] = {
    "read_batches": _events(
        "SELECT items, count(*) AS batches FROM (SELECT batch_id, count(*) FILTER (m NOT IN (9, 10)) AS items "
        "FROM ev GROUP BY batch_id) GROUP BY items"
    ),
    "read_batches_ids": _events(
        "SELECT batch_id % 4 AS file, row_number() OVER (PARTITION BY batch_id % 4 ORDER BY batch_id) - 1 AS line "
        "FROM (SELECT DISTINCT batch_id FROM ev)"
    ),
    "split_envelopes_items": _events(
        "SELECT batch_id, pos, CASE WHEN m = 0 THEN 'ghost-event' ELSE 'user-event' END AS type_name, event_id "
        "FROM ev WHERE m NOT IN (9, 10)"
    ),
    "split_errors": _events("SELECT batch_id, pos, codes AS code, split_value AS value FROM bad WHERE kind = 0"),
    "wrap_round_trip": """
SELECT o_orderkey // 100 AS batch_id, CAST(o_orderkey % 100 AS INTEGER) AS pos,
       TIMESTAMP '2024-06-01 00:00:00' + to_seconds(o_orderkey // 100) AS ingest_time,
       o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, false AS open
FROM orders""",
    "malformed_bodies": """
SELECT o_orderkey AS batch_id, items_in, ingested, rejected, status, reason
FROM orders JOIN (VALUES
  (0, 1, 1, 0, 200, NULL), (1, 0, 0, 1, 400, 'not a JSON array'), (2, 0, 0, 1, 400, 'not a JSON array'),
  (3, 0, 0, 0, 400, 'empty input array'), (4, 0, 0, 0, 400, 'empty input array'),
  (5, 0, 0, 1, 400, 'not a JSON array'), (6, 1, 0, 1, 400, 'no valid items'),
  (7, 0, 0, 1, 400, 'not a JSON array'), (8, 0, 0, 1, 400, 'not a JSON array'), (9, 1, 0, 1, 200, NULL),
  (10, 2, 0, 2, 400, 'no valid items'), (11, 0, 0, 1, 400, 'not a JSON array'),
  (12, 0, 0, 0, 400, 'empty input array'), (13, 2, 2, 0, 200, NULL), (14, 2, 1, 1, 200, NULL),
  (15, 0, 0, 1, 400, 'not a JSON array')
) c(k, items_in, ingested, rejected, status, reason) ON o_orderkey % 16 = k""",
    "validated_items": _events("SELECT * FROM good"),
    "type_checks": f"""
SELECT CAST(no AS BIGINT) AS literal_no, kind AS column_type, verdict, count(*) AS items
FROM lineitem JOIN (VALUES
  {_MATRIX}
) m(no, k, kind, verdict) ON (l_orderkey * 7 + l_linenumber) % {len(LITERALS)} = no AND l_partkey % {len(CHECKED_KINDS)} = k
GROUP BY no, kind, verdict""",
    "route_by_type": _events("""
SELECT 'user-event' AS type_name, 'user-event' AS route, count(*) FILTER (m NOT IN (0, 9, 10)) AS items,
       count(*) FILTER (m IN (5, 6, 11, 14, 15, 16, 17, 18, 19)) AS accepted FROM ev
UNION ALL SELECT 'ghost-event', '__none', count(*) FILTER (m = 0), 0 FROM ev
UNION ALL SELECT 'order-placed', 'order-placed', count(*), count(*) FROM orders
UNION ALL SELECT 'customer-seen', 'customer-seen', count(*), count(*) FROM customer"""),
    "mixed_orders": """
SELECT TIMESTAMP '2024-06-01 00:00:00' + to_seconds((o_orderkey * 3 + 1) // 60) AS ingest_time,
       o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderstatus = 'O' AS open
FROM orders""",
    "rejected_items": _events(f"SELECT batch_id, kind, pos, type_name, {_MESSAGES} AS messages FROM bad"),
    "rejected_by_reason": _events("""
, reasons AS (
  SELECT unnest(string_split(codes, ',')) AS code,
         unnest(CASE m WHEN 1 THEN ['user_id'] WHEN 2 THEN ['value'] WHEN 3 THEN ['props'] WHEN 4 THEN ['ts']
                       WHEN 7 THEN ['props'] WHEN 8 THEN ['user_id', 'value'] WHEN 12 THEN ['dur']
                       WHEN 13 THEN ['user_id'] ELSE [NULL] END) AS field
  FROM bad
) SELECT code, field, count(*) AS n FROM reasons GROUP BY code, field"""),
    "quarantine": _events("SELECT batch_id, kind, pos, codes FROM bad"),
    "stamp_ingest_time": _events(
        "SELECT ingest_time + INTERVAL 123 MILLISECONDS AS ingest_time, count(*) AS n FROM good GROUP BY ingest_time"
    ),
    "timespans": """
WITH n AS (
  SELECT event_id, (event_id % 3) * 86400000000000 AS d,
         (event_id % 24) * 3600000000000 + (event_id % 60) * 60000000000 + (event_id % 61) * 1000000000 + 250000000 AS r,
         event_id % 7 = 6 AS negative
  FROM events
), v AS (SELECT event_id, CASE WHEN negative THEN d - r ELSE d + r END AS nanos FROM n),
a AS (SELECT event_id, nanos, abs(nanos) AS x, abs(nanos) // 3600000000000 AS h,
             abs(nanos) // 60000000000 % 60 AS mi, abs(nanos) // 1000000000 % 60 AS s,
             rtrim(lpad(CAST(abs(nanos) % 1000000000 AS VARCHAR), 9, '0'), '0') AS f FROM v)
SELECT event_id, nanos,
       CASE WHEN x < 1000000000 THEN (x // 1000000) || 'ms'
            ELSE (CASE WHEN h > 0 THEN h || 'h' ELSE '' END) || (CASE WHEN h > 0 OR mi > 0 THEN mi || 'm' ELSE '' END)
                 || s || (CASE WHEN f <> '' THEN '.' || f ELSE '' END) || 's' END AS shown,
       x // 86400000000000 AS days
FROM a""",
    "batch_report": _events("""
SELECT batch_id, ingest_time, count(*) AS items_in,
       count(*) FILTER (m IN (5, 6, 11, 14, 15, 16, 17, 18, 19)) AS ingested,
       count(*) FILTER (m NOT IN (5, 6, 11, 14, 15, 16, 17, 18, 19)) AS rejected,
       200 AS status, CAST(NULL AS VARCHAR) AS reason
FROM ev GROUP BY batch_id, ingest_time"""),
    "write_ledger": _events("""
SELECT 'user-event' AS type_name, make_timestamp((epoch(ingest_time)::BIGINT // 120) * 120000000) AS segment,
       count(*) AS rows_written, max(ingest_time) AS last_write
FROM good GROUP BY 2"""),
    "operational_tables": _measures(
        batches="count(DISTINCT batch_id) FROM ev",
        items_in="count(*) FROM ev",
        ingested="count(*) FROM good",
        rejected="count(*) FROM bad",
        status="200",
        flushed="count(*) FROM good",
    ),
    "scan_table": _events("SELECT * EXCLUDE (batch_id, pos) FROM good"),
    "scan_where": _events("SELECT * EXCLUDE (batch_id, pos) FROM good WHERE value >= 20 AND event_type = 'click'"),
    "scan_project": _events("SELECT event_type, value FROM good"),
    "summarize_count": _events("SELECT event_type, count(*) AS count_ FROM good WHERE value > 100 GROUP BY event_type"),
    "chain_where_project": _events("SELECT ingest_time, event_id, user_id FROM good WHERE user_id >= 50"),
    "take_n": _events("SELECT least(5, count(*)) AS taken FROM good"),
    "null_cells": _events("""
SELECT event_type, count(*) AS n, count(*) FILTER (props IS NULL) AS no_props, count(*) FILTER (dur IS NULL) AS no_dur
FROM good GROUP BY event_type"""),
    "rows_as_json": _events(f"""
SELECT CAST(event_id AS VARCHAR) AS event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS ts,
       strftime(ingest_time, '%Y-%m-%d %H:%M:%S.%g') AS ingest_time, event_type,
       {_DUR_TEXT} AS dur, props, dur IS NULL AS dur_is_null
FROM good"""),
    "where_key": """
SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 50 = 7 ORDER BY c_custkey LIMIT 3""",
    "time_range_scan": _events("""
SELECT * EXCLUDE (batch_id, pos) FROM good
WHERE ingest_time >= TIMESTAMP '2024-06-01 00:00:05' AND ingest_time < TIMESTAMP '2024-06-01 00:01:05'"""),
    "historical_query": _events("""
SELECT event_type, count(*) AS count_,
       'ingest_time:datetime,event_id:int,ts:datetime,user_id:int,event_type:string,value:real,props:dynamic,dur:timespan'
         AS columns
FROM good GROUP BY event_type"""),
    "list_tables": _events("""
SELECT typeName, storageBucket, 'file' AS mode,
       CASE WHEN typeName = 'user-event' THEN (SELECT count(*) FROM good) END AS rows
FROM (VALUES ('user-event', 'usage'), ('ingest-event', 'ingest-accounts'), ('writer-flush', 'writer-accounts'),
             ('writer-error', 'writer-accounts')) t(typeName, storageBucket)"""),
    "multi_root_union": _events("""
SELECT ingest_time, event_id, value FROM good
UNION ALL SELECT ingest_time + INTERVAL 1 DAY, event_id, value FROM good"""),
    "csv_round_trip": """
SELECT TIMESTAMP '2024-06-01 00:00:00' + to_seconds(doc_id) AS ingest_time, doc_id, nullif(text, '') AS text,
       nullif(lang, '') AS lang, nullif(source, '') AS source, n_chars
FROM documents""",
    "csv_time_range_scan": _events("""
SELECT * EXCLUDE (batch_id, pos) FROM good
WHERE ingest_time >= TIMESTAMP '2024-06-01 00:02:10' AND ingest_time < TIMESTAMP '2024-06-01 00:03:10'"""),
    "segments_aligned": f"""
SELECT event_id, event_type,
       strftime(min(ts) OVER (PARTITION BY event_type, epoch_ms(ts) // (minutes * 60000)), '%Y-%m-%d_%H-%M-%S.%g') AS segment
FROM events JOIN {_MINUTES} USING (event_type)""",
    "segments_anchored": _CHAIN,
    "segments_anchored_tree": _CHAIN,
    "segments_anchored_by_type": _CHAIN_COUNTS,
    "segments_aligned_busy_window": """
WITH moved AS (
  SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN TIMESTAMP '2024-01-01' + to_seconds(event_id % 3000) ELSE ts END AS ts FROM events
)
SELECT event_id, strftime(min(ts) OVER (PARTITION BY epoch_ms(ts) // 3600000), '%Y-%m-%d_%H-%M-%S.%g') AS segment FROM moved""",
    "stream_rotation": _CHAIN_COUNTS,
    "close_segment_under_readers": _events(
        "SELECT count(*) AS rows, sum(event_id)::BIGINT AS ids, max(ingest_time) AS last, 1 AS closers_that_won FROM good"
    ),
    "time_range_of_many_loads": _events("""
SELECT * EXCLUDE (batch_id, pos) FROM good
WHERE ingest_time >= TIMESTAMP '2024-06-01 00:00:05' AND ingest_time < TIMESTAMP '2024-06-01 00:00:15'"""),
    "deep_and_long_values": """
WITH placed AS (
  SELECT c_custkey % 40 AS m, c_custkey::BIGINT AS no,
    c_custkey // 50 * 50 + row_number() OVER (PARTITION BY c_custkey // 50 ORDER BY c_custkey) - 1 AS place
  FROM customer
)
SELECT CASE m WHEN 0 THEN 'item_data_parsing_failed' WHEN 3 THEN 'invalid_field_type' ELSE 'accepted' END AS verdict,
  CASE WHEN m IN (0, 3) THEN place ELSE no END AS no
FROM placed""",
    "many_types": """
SELECT 'part-' || (p_partkey % 200) AS type_name, count(*) AS items,
  count(*) FILTER (NOT (p_partkey % 5 = 0 OR (p_partkey % 7 = 0 AND p_partkey % 2 = 0))) AS accepted,
  (count(*) FILTER (p_partkey % 5 = 0) + count(*) FILTER (p_partkey % 7 = 0 AND p_partkey % 2 = 0))::BIGINT AS faults
FROM part GROUP BY 1""",
    "close_segment": _events("SELECT ingest_time, event_id, value, dur FROM good"),
    "lint_definitions_verdicts": f"""
SELECT p_partkey AS seq, {_DEFINITION_NAME} AS name,
       CASE p_partkey % 24 WHEN 0 THEN {_BRAND} WHEN 22 THEN 'part-' || p_partkey END AS folder,
       CAST(CASE p_partkey % 24 WHEN 0 THEN p_size WHEN 22 THEN 1 END AS BIGINT) AS latency_minutes,
       CASE p_partkey % 24
         WHEN 0 THEN 'ok' WHEN 1 THEN 'missing_name' WHEN 2 THEN 'reserved_name' WHEN 3 THEN 'invalid_file_name'
         WHEN 4 THEN 'invalid_file_name' WHEN 5 THEN 'invalid_documentation' WHEN 6 THEN 'invalid_folder'
         WHEN 7 THEN 'invalid_folder' WHEN 8 THEN 'invalid_latency' WHEN 9 THEN 'negative_latency'
         WHEN 10 THEN 'invalid_latency' WHEN 11 THEN 'missing_columns' WHEN 12 THEN 'empty_columns'
         WHEN 13 THEN 'invalid_column_name' WHEN 14 THEN 'reserved_name' WHEN 15 THEN 'missing_column_type'
         WHEN 16 THEN 'unsupported_column_type' WHEN 17 THEN 'inconsistent_default'
         WHEN 18 THEN 'inconsistent_default' WHEN 19 THEN 'duplicate_column' WHEN 20 THEN 'invalid_json'
         WHEN 21 THEN 'inconsistent_default' WHEN 22 THEN 'ok' WHEN 23 THEN 'inconsistent_default' END AS verdict
FROM part""",
    "lint_definition_columns": """
SELECT 'part-' || p_partkey AS type_name, pos, name, type
FROM part JOIN (VALUES (0, 0, 'size', 'int'), (0, 1, 'price', 'real'), (0, 2, 'seen', 'datetime'),
                       (22, 0, 'v', 'timespan')) c(k, pos, name, type) ON p_partkey % 24 = k""",
    "dedupe_definitions_first_wins": """
WITH d AS (SELECT p_partkey AS seq, CASE WHEN p_partkey % 3 = 0 THEN 'brand-hot' ELSE 'brand-' || (p_partkey % 50) END AS name FROM part)
SELECT seq, name, CASE WHEN seq = min(seq) OVER (PARTITION BY name) THEN 'ok' ELSE 'already_exists' END AS verdict FROM d""",
    "definition_sidecars": f"""
SELECT 'part-' || p_partkey AS type_name,
       CASE p_partkey % 24 WHEN 0 THEN {_BRAND} ELSE 'part-' || p_partkey END AS folder,
       '{{"name":"part-' || p_partkey || '","orderedColumns":[{{"name":"ingest_time","type":"datetime"}},' ||
       CASE p_partkey % 24
         WHEN 0 THEN '{{"name":"size","type":"int"}},{{"name":"price","type":"real"}},{{"name":"seen","type":"datetime"}}'
         ELSE '{{"name":"v","type":"timespan"}}' END || ']}}' AS sidecar
FROM part WHERE p_partkey % 24 IN (0, 22)""",
    "schema_drift": f"""
SELECT 'part-' || p_partkey AS type_name,
       CASE p_partkey % 6 WHEN 1 THEN 'column_count' WHEN 2 THEN 'column_mismatch' WHEN 3 THEN 'column_mismatch'
                          WHEN 4 THEN 'unreadable' ELSE 'ok' END AS verdict,
       CASE p_partkey % 6
         WHEN 1 THEN 'column count mismatch: stored schema has 2 user columns, definition has 3'
         WHEN 2 THEN {_DRIFT_COLUMN.format(2, "cost", "real", "price", "real")}
         WHEN 3 THEN {_DRIFT_COLUMN.format(3, "seen", "string", "seen", "datetime")}
         WHEN 4 THEN 'invalid JSON' END AS detail
FROM part""",
    "discover_catalog": """
SELECT 'supplier-' || s_suppkey AS type_name, 'bucket=nation-' || s_nationkey AS storage_bucket, 'file' AS mode,
       'ingest_time:datetime,acctbal:real' AS columns
FROM supplier""",
    "discover_catalog_lenient": """
SELECT 'supplier-' || s_suppkey AS name, 'bucket=nation-' || s_nationkey AS storage_bucket, 2 AS columns, 'ok' AS state
FROM supplier WHERE s_suppkey % 5 IN (0, 4)
UNION ALL
SELECT '', '', CAST(count(*) AS INTEGER), CASE s_suppkey % 5 WHEN 1 THEN 'empty name' WHEN 2 THEN 'no columns'
                                                          ELSE 'unknown column type' END
FROM supplier WHERE s_suppkey % 5 IN (1, 2, 3) GROUP BY s_suppkey % 5""",
    "stream_ingest": _events("""
SELECT 'user-event' AS type_name, count(*) AS n, CAST(3 AS BIGINT) AS epochs FROM good
UNION ALL SELECT 'order-placed', count(*), 3 FROM orders
UNION ALL SELECT 'customer-seen', count(*), 3 FROM customer"""),
    "stream_report": _measures(
        batches="count(DISTINCT batch_id) FROM ev",
        items_in="count(*) FROM ev",
        ingested="count(*) FROM good",
        rejected="count(*) FROM bad",
        flushed="count(*) FROM good",
        flushes="2",
        quarantined="count(*) FROM bad",
    ),
    "stream_hot_add_remove": _measures(
        stored="count(*) FROM good WHERE batch_id % 3 = 1",
        first="min(event_id) FROM good WHERE batch_id % 3 = 1",
        last="max(event_id) FROM good WHERE batch_id % 3 = 1",
        undefined="count(*) FROM ev WHERE m NOT IN (9, 10) AND (batch_id % 3 <> 1 OR m = 0)",
    ),
    "stream_rotated_tables": _events("""
SELECT CASE WHEN batch_id % 3 = 2 THEN 'open' ELSE 'closed' END AS state, count(*) AS n, min(event_id) AS first,
       max(event_id) AS last, count(DISTINCT batch_id % 3) AS epochs
FROM good GROUP BY 1"""),
    "stream_item_limit": _events("""
SELECT 7::BIGINT AS bodies, (n // 7)::BIGINT AS epochs FROM (SELECT count(DISTINCT batch_id) AS n FROM ev)
UNION ALL SELECT n % 7, 1 FROM (SELECT count(DISTINCT batch_id) AS n FROM ev) WHERE n % 7 > 0"""),
    "stream_quiet_type": _events("""
SELECT 'user-event' AS type_name, 'closed' AS state, count(*) AS n FROM good
UNION ALL SELECT 'order-placed', 'open', count(*) FROM orders"""),
    "stream_write_failure": _events("""
SELECT 'order-placed' AS itemType, 'flush' AS operation, CAST(1 AS BIGINT) AS count_
UNION ALL SELECT 'user-event', 'stored', count(*) FROM good
UNION ALL SELECT 'order-placed', 'stored', count(*) FROM orders
UNION ALL SELECT 'customer-seen', 'stored', count(*) FROM customer"""),
}
