"""The registered queries as SQL over the same tables, written without the operators' shortcuts."""

from __future__ import annotations

HOUR, DAY = 3600, 86_400

ORACLES: dict[str, str] = {}


def iso(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%dT%H:%M:%S.%fZ')"


def iso_seconds(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%dT%H:%M:%SZ')"


def window_start(ts: str, seconds: int, back: str = "0") -> str:
    size = seconds * 1_000_000
    return f"make_timestamp((epoch_us({ts}) // {size} - {back}) * {size})"


def uuid(*parts: str) -> str:
    digest = f"md5(concat_ws('~', {', '.join(parts)}))"
    return "concat_ws('-', " + ", ".join(
        f"substr({digest}, {start}, {size})" for start, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    ) + ")"


BLANK = r"'^[\t\n\x0B\f\r\x{85}\p{Z}]*$'"


def utf16(text: str) -> str:
    return f"(length({text}) + length(regexp_replace({text}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"


CHAT = """chat AS (
  SELECT CAST(event_id AS VARCHAR) AS message_id,
         CASE WHEN event_type = 'purchase' THEN 'DirectMessage' ELSE 'Channel' END AS scope_type,
         event_type || '-' || (user_id % 30) AS scope_id,
         'user-' || user_id AS sender_id,
         event_type || ':' || props || CASE event_type WHEN 'purchase' THEN '\U0001F389'
           WHEN 'signup' THEN '\U0001F44B' WHEN 'error' THEN '⚠' ELSE '' END AS text,
         ts AS created_at,
         'pod-' || (event_id % 3) AS origin_pod_id,
         event_id AS n
  FROM events)"""

REQUESTS = """requests AS (
  SELECT CAST(doc_id AS VARCHAR) AS message_id,
         CASE WHEN doc_id % 41 = 0 THEN ' ' || chr(9) ELSE lang END AS sender_id,
         CASE WHEN doc_id % 43 = 0 THEN '' WHEN doc_id % 47 = 0 THEN NULL ELSE source END AS scope_id,
         text,
         CASE WHEN doc_id % 37 = 0 THEN repeat('p', 257) ELSE source END AS origin_pod_id,
         make_timestamp((1704067200 + doc_id) * 1000000) AS requested_at
  FROM documents)"""

MEMBERS = """members AS (
  SELECT scope_type, scope_id, sender_id AS user_id, min(created_at) AS joined_at, max(created_at) AS left_at
  FROM chat GROUP BY ALL)"""

PAIRS = """pairs AS (
  SELECT c.message_id, c.scope_type, c.scope_id, m.user_id
  FROM chat c JOIN members m ON c.scope_type = m.scope_type AND c.scope_id = m.scope_id
   AND c.created_at >= m.joined_at AND c.created_at < m.left_at)"""

PRESENCE = """presence AS (
  SELECT 'user-' || user_id AS user_id, 'pod-' || (user_id % 3) AS pod_id, 'conn-' || (event_id % 2) AS connection_id,
         CASE event_type WHEN 'signup' THEN 'online' WHEN 'error' THEN 'offline' ELSE 'heartbeat' END AS kind, ts
  FROM events)"""

CUT = "TIMESTAMP '2024-01-20 12:00:00'"

# The user's beats are one chain while less than a day apart; members seen in the chain that holds at the cut live.
LIVE = f"""beats AS (
  SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before
  FROM presence WHERE kind <> 'offline' AND ts <= {CUT}),
chains AS (
  SELECT user_id, max(ts) FILTER (before IS NULL OR ts >= before + INTERVAL 1 DAY) AS since, max(ts) AS renewed
  FROM beats GROUP BY user_id),
last_event AS (
  SELECT user_id, pod_id, connection_id, kind, ts,
         row_number() OVER (PARTITION BY user_id, pod_id, connection_id ORDER BY ts DESC, kind = 'offline' DESC) AS k
  FROM presence WHERE ts <= {CUT}),
live AS (
  SELECT e.user_id, e.pod_id, e.connection_id, e.ts AS last_seen
  FROM last_event e JOIN chains c ON e.user_id = c.user_id
  WHERE k = 1 AND kind <> 'offline' AND e.ts >= c.since AND c.renewed + INTERVAL 1 DAY > {CUT})"""

LOGS = f"""logs AS (
  SELECT event_id AS line_id, ts,
    CASE event_type WHEN 'error' THEN 'Error' WHEN 'signup' THEN 'Warning' ELSE 'Information' END AS level,
    event_type || CASE WHEN event_type = 'error' THEN
       [' no host AVAILABLE ', ' query timeout ', ' bad input ', ' lost connection '][event_id % 4 + 1]
       ELSE ' ' END || props AS message,
    CASE event_id % 10 WHEN 0 THEN 'broken-' || event_id WHEN 1 THEN upper('corr_' || {uuid('event_id')})
       ELSE 'corr_' || {uuid('event_id')} END AS correlation_id,
    event_type || '-' || (user_id % 30) AS scope, 'pod-' || (user_id % 3) AS pod,
    CASE WHEN event_type = 'error' THEN ['UnauthorizedAccessException', 'KeyNotFoundException',
      'InvalidOperationException', 'TimeoutException', 'ArgumentNullException', 'ArgumentException',
      'IOException'][event_id % 7 + 1] END AS exception,
    CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'Connection refused' END AS inner_message,
    'pod-' || (user_id % 3) AS machine_name,
    ['chat-api', 'history-consumer', 'fan-worker', 'redis', 'web-frontend'][event_id % 5 + 1] AS container_name,
    CASE WHEN event_id % 3 = 0 THEN 'app-' || event_type END AS name_label,
    CASE WHEN event_id % 3 = 0 THEN ['api', 'db'][event_id % 2 + 1] END AS component_label,
    value AS latency_ms
  FROM events),
classified AS (
  SELECT *, pod AS pod_id, coalesce(name_label, container_name) AS app_name,
    CASE WHEN component_label = 'api' THEN 'app'
         WHEN container_name = 'chat-api' THEN 'duplicate_to_drop'
         WHEN container_name IN ('history-consumer', 'fan-worker', 'web-frontend') THEN 'app'
         ELSE 'system' END AS log_type
  FROM logs)"""

CHAT_HISTORY = CHAT + """,
history AS (
  SELECT scope_type || ':' || scope_id AS scope_key, created_at, message_id, sender_id, text, origin_pod_id,
         CAST(n % 3 AS INTEGER) AS broker_partition, n // 3 AS broker_offset
  FROM chat)"""

WATERMARK = "(SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 5 SECOND FROM events)"


# --- analytics


def analytics(source: str, size: int, slide: int | None = None, extra: str = "", with_id: bool = True,
              closed_only: bool = False) -> str:
    slide = slide or size
    keys = f"{extra}scope_type, scope_id"
    start = window_start("created_at", slide, "k")
    end = f"w + INTERVAL {size} SECOND"
    ident = f"{uuid(chr(39) + 'analytics' + chr(39), 'scope_type', 'scope_id', 'epoch_us(w)', str(size))} AS analytics_id,"
    return f"""WITH {source},
placed AS (SELECT *, {start} AS w FROM src, range({size // slide}) AS r(k))
SELECT {ident if with_id else ''} {keys}, {iso('w')} AS window_start, {iso(end)} AS window_end,
  CAST({size} AS BIGINT) AS window_duration_seconds, count(*) AS message_count,
  count(DISTINCT sender_id) AS active_user_count, count(DISTINCT sender_id) AS unique_sender_count,
  CAST(sum({utf16('text')}) AS BIGINT) AS total_character_count,
  CAST(sum({utf16('text')}) AS DOUBLE) / count(*) AS average_message_length,
  {iso('min(created_at)')} AS first_event_at, {iso('max(created_at)')} AS last_event_at,
  'palaver-analytics' AS compute_task_id
FROM placed {f'WHERE {end} <= {WATERMARK}' if closed_only else ''} GROUP BY {keys}, w"""


CHAT_SRC = CHAT + ", src AS (SELECT * FROM chat)"
ORACLES["scope_analytics"] = analytics(CHAT_SRC, HOUR)
ORACLES["scope_analytics_sliding"] = analytics(CHAT_SRC, 6 * HOUR, HOUR)
ORACLES["stream_scope_analytics"] = analytics(CHAT_SRC, HOUR, closed_only=True)
ORACLES["scope_analytics_by_tenant"] = analytics(
    CHAT + ", src AS (SELECT *, origin_pod_id AS tenant FROM chat)", DAY, extra="tenant, ", with_id=False
)
ORACLES["dialogue_analytics"] = analytics(
    """src AS (SELECT 'DirectMessage' AS scope_type, 'conv-' || conv_id AS scope_id, role AS sender_id, text,
      make_timestamp((1704067200 + conv_id * 3600 + turn * 17) * 1000000) AS created_at FROM conversations)""",
    60, with_id=False,
)
ORACLES["scope_counts"] = f"""WITH {CHAT}
SELECT scope_type, scope_id, {iso(window_start('created_at', HOUR))} AS window_start,
  {iso(window_start('created_at', HOUR) + ' + INTERVAL 1 HOUR')} AS window_end, count(*) AS message_count
FROM chat GROUP BY ALL"""
ORACLES["scope_analytics_approx"] = f"""WITH {CHAT}
SELECT scope_type, scope_id, {iso(window_start('created_at', DAY))} AS window_start, count(*) AS message_count,
  CAST(sum({utf16('text')}) AS BIGINT) AS total_character_count, true AS within_bound
FROM chat GROUP BY scope_type, scope_id, {window_start('created_at', DAY)}"""
ORACLES["latency_summary_approx"] = """SELECT DISTINCT 'pod-' || (user_id % 3) AS machine_name, true AS p50_within_bound,
  true AS p95_within_bound, true AS p99_within_bound FROM events"""
ORACLES["analytics_records"] = f"""WITH {CHAT},
stats AS (
  SELECT scope_type, scope_id, {window_start('created_at', DAY)} AS w, count(*) AS messages,
    count(DISTINCT sender_id) AS senders, CAST(sum({utf16('text')}) AS BIGINT) AS characters
  FROM chat GROUP BY ALL)
SELECT scope_id AS key, CAST(json_object('analyticsId', {uuid("'analytics'", 'scope_type', 'scope_id', 'epoch_us(w)', str(DAY))},
  'scopeType', scope_type, 'scopeId', scope_id, 'windowStartUtc', {iso_seconds('w')},
  'windowEndUtc', {iso_seconds('w + INTERVAL 1 DAY')}, 'windowDurationSeconds', {DAY}, 'messageCount', messages,
  'activeUserCount', senders, 'uniqueSenderCount', senders, 'totalCharacterCount', characters,
  'averageMessageLength', CAST(characters AS DOUBLE) / messages, 'computedAtUtc', '2026-01-15T10:31:05Z',
  'computeTaskId', 'palaver-analytics') AS VARCHAR) AS value
FROM stats"""


# --- abuse


def rates(extra: str = "") -> str:
    return f"""placed AS (
  SELECT *, {window_start('created_at', 6 * HOUR, 'k')} AS w FROM chat, range(4) AS r(k)),
rates AS (
  SELECT {extra}sender_id AS user_id, w, count(*) AS message_count,
    CAST(count(*) AS DOUBLE) / {DAY} AS messages_per_second,
    first(scope_type || ':' || scope_id ORDER BY created_at, message_id) AS first_scope,
    min(created_at) AS first_event_at, max(created_at) AS last_event_at
  FROM placed GROUP BY {extra}sender_id, w)"""


RATE_COLUMNS = f"""user_id, {iso('w')} AS window_start, {iso('w + INTERVAL 1 DAY')} AS window_end, message_count,
  messages_per_second, first_scope, {iso('first_event_at')} AS first_event_at, {iso('last_event_at')} AS last_event_at"""

LEVELS = """(VALUES ('Flag', 8, 'User exceeded flag threshold'), ('Throttle', 6, 'User exceeded throttle threshold'),
  ('Warning', 4, 'User exceeded warning threshold')) AS levels(event_type, threshold, context)"""

ALERT_COLUMNS = f"""event_type, user_id, split_part(first_scope, ':', 1) AS scope_type,
  split_part(first_scope, ':', 2) AS scope_id, {iso('w')} AS window_start, {iso('w + INTERVAL 1 DAY')} AS window_end,
  CAST({DAY} AS BIGINT) AS window_duration_seconds, message_count, CAST(threshold AS BIGINT) AS threshold,
  CAST(message_count - threshold AS BIGINT) AS excess_count, messages_per_second,
  {iso('first_event_at')} AS first_event_at, {iso('last_event_at')} AS last_event_at,
  'palaver-abuse' AS detector_task_id, context"""

ALERT_ID = uuid("'rate'", "user_id", "event_type", "epoch_us(w)", str(DAY))

ORACLES["user_rate"] = f"WITH {CHAT}, {rates()} SELECT {RATE_COLUMNS} FROM rates"
ORACLES["user_rate_by_tenant"] = (
    f"WITH {CHAT}, {rates('origin_pod_id, ')} SELECT origin_pod_id AS tenant, {RATE_COLUMNS} FROM rates"
)
ORACLES["user_rate_scopes"] = f"""WITH {CHAT}, {rates()}
SELECT sender_id AS user_id, {iso('w')} AS window_start, {iso('w + INTERVAL 1 DAY')} AS window_end, scope_type,
  scope_id, count(*) AS message_count FROM placed GROUP BY sender_id, w, scope_type, scope_id"""
ORACLES["rate_alerts"] = f"""WITH {CHAT}, {rates()}
SELECT {ALERT_ID} AS rate_limit_event_id, {ALERT_COLUMNS} FROM rates JOIN {LEVELS} ON message_count >= threshold"""
ORACLES["rate_alerts_of_rates"] = ORACLES["rate_alerts"]
ORACLES["stream_rate_alerts"] = ORACLES["rate_alerts"] + f" WHERE w + INTERVAL 1 DAY <= {WATERMARK}"
ORACLES["rate_alerts_highest"] = f"""WITH {CHAT}, {rates()}
SELECT {ALERT_COLUMNS} FROM rates JOIN {LEVELS} ON message_count >= threshold
QUALIFY row_number() OVER (PARTITION BY user_id, w ORDER BY threshold DESC) = 1"""
ORACLES["rate_alerts_by_tenant"] = f"""WITH {CHAT}, {rates('origin_pod_id, ')}
SELECT {uuid("'rate'", "origin_pod_id", "user_id", "event_type", "epoch_us(w)", str(DAY))} AS rate_limit_event_id,
  origin_pod_id AS tenant, {ALERT_COLUMNS} FROM rates JOIN {LEVELS} ON message_count >= threshold"""
ORACLES["first_alerts"] = f"""WITH {CHAT}, {rates()}
SELECT {ALERT_COLUMNS} FROM rates JOIN {LEVELS} ON message_count >= threshold
QUALIFY coalesce(w - lag(w) OVER (PARTITION BY user_id, event_type ORDER BY w) > INTERVAL 6 HOUR, true)"""
ORACLES["rate_alerts_by_policy"] = f"""WITH {CHAT}, {rates()},
policies AS (SELECT 'user-' || user_id AS user_id, count(*) % 3 AS shift FROM events
             WHERE event_type = 'signup' GROUP BY ALL),
levels AS (
  SELECT r.*, event_type, context,
    CASE WHEN p.user_id IS NULL THEN l.threshold ELSE l.threshold - 1 + p.shift END AS threshold
  FROM rates r LEFT JOIN policies p ON r.user_id = p.user_id, {LEVELS.replace('levels(', 'l(')})
SELECT {ALERT_COLUMNS} FROM levels WHERE message_count >= threshold"""
AS_OF = f"""versions AS (
  SELECT 'user-' || user_id AS user_id, ts, max(event_id % 3) AS shift FROM events WHERE event_type = 'signup' GROUP BY ALL),
chosen AS (
  SELECT r.*, v.shift FROM rates r LEFT JOIN versions v ON v.user_id = r.user_id AND v.ts <= r.w + INTERVAL 1 DAY
  QUALIFY row_number() OVER (PARTITION BY r.user_id, r.w ORDER BY v.ts DESC NULLS LAST) = 1),
levels AS (
  SELECT r.*, event_type, context, CASE WHEN shift IS NULL THEN l.threshold ELSE l.threshold - 1 + shift END AS threshold
  FROM chosen r, {LEVELS.replace('levels(', 'l(')})"""
ORACLES["rate_alerts_as_of"] = f"""WITH {CHAT}, {rates()}, {AS_OF}
SELECT {ALERT_COLUMNS} FROM levels WHERE message_count >= threshold"""
ORACLES["stream_rate_alerts_as_of"] = ORACLES["rate_alerts_as_of"] + f" AND w + INTERVAL 1 DAY <= {WATERMARK}"
ORACLES["rate_limit_records"] = f"""WITH {CHAT}, {rates()}
SELECT user_id AS key, {ALERT_ID} AS "rateLimitEventId", event_type AS "eventType", user_id AS "userId",
  split_part(first_scope, ':', 1) AS "scopeType", split_part(first_scope, ':', 2) AS "scopeId",
  {iso_seconds('w')} AS "windowStartUtc", {iso_seconds('w + INTERVAL 1 DAY')} AS "windowEndUtc",
  CAST({DAY} AS BIGINT) AS "windowDurationSeconds", message_count AS "messageCount",
  CAST(threshold AS BIGINT) AS threshold, CAST(message_count - threshold AS BIGINT) AS "excessCount",
  messages_per_second AS "messagesPerSecond", '2026-01-15T10:31:05Z' AS "detectedAtUtc",
  'palaver-abuse' AS "detectorTaskId", context
FROM rates JOIN {LEVELS} ON message_count >= threshold"""


# --- decoding


def wire_json(sender: str) -> str:
    return f"""json_object('messageId', message_id, 'scopeType', spelled,
      'scopeId', CASE WHEN n % 50 = 13 THEN chr(8195) ELSE scope_id END, {sender}
      'text', CASE n % 50 WHEN 4 THEN chr(9) WHEN 10 THEN 'nested' ELSE text END, 'createdAtUtc', {iso('created_at')},
      'originPodId', origin_pod_id)"""


WIRE = f"""spelt AS (
  SELECT *, CASE WHEN n % 50 = 6 THEN 'Group'
    WHEN n % 3 = 0 THEN CASE WHEN scope_type = 'Channel' THEN '0' ELSE '1' END
    WHEN n % 3 = 1 THEN scope_type
    WHEN scope_type = 'Channel' THEN 'CHANNEL' ELSE 'DIRECT_MESSAGE' END AS spelled
  FROM chat),
whole AS (
  SELECT *, CAST(n % 3 AS INTEGER) AS partition, n // 3 AS "offset",
    CAST(CASE WHEN n % 50 = 5 THEN {wire_json('')} ELSE {wire_json("'senderId', sender_id,")} END AS VARCHAR) AS json
  FROM spelt),
wire AS (
  SELECT *, CASE n % 50 WHEN 0 THEN left(json, 40) WHEN 1 THEN '' WHEN 2 THEN 'null' WHEN 7 THEN json || '{{}}'
    WHEN 8 THEN json || ' end' WHEN 9 THEN replace(json, '"', '''') WHEN 10 THEN replace(json, '"nested"', '{{"a":1}}')
    WHEN 11 THEN replace(json, {iso('created_at')}, '10:30') WHEN 12 THEN replace(json, {iso('created_at')}, '2026')
    WHEN 14 THEN json || ',' || json ELSE json END AS body
  FROM whole),
judged AS (
  SELECT *, CASE n % 50 WHEN 0 THEN 'bad_json' WHEN 1 THEN 'empty' WHEN 2 THEN 'null_event' WHEN 5 THEN 'missing_field'
    WHEN 6 THEN 'bad_scope_type' WHEN 7 THEN 'bad_json' WHEN 8 THEN 'bad_json' WHEN 9 THEN 'bad_json'
    WHEN 10 THEN 'bad_json' WHEN 11 THEN 'bad_timestamp' WHEN 12 THEN 'bad_timestamp' WHEN 13 THEN 'blank_scope'
    WHEN 14 THEN 'bad_json' END AS reason
  FROM wire)"""

ORACLES["decode_events"] = f"""WITH {CHAT}, {WIRE}
SELECT message_id, scope_type, scope_id, CASE WHEN n % 50 = 3 THEN chr(8195) || ' ' ELSE sender_id END AS sender_id,
  CASE WHEN n % 50 = 4 THEN chr(9) ELSE text END AS text, {iso('created_at')} AS created_at, origin_pod_id,
  partition, "offset"
FROM judged WHERE reason IS NULL"""
ORACLES["classify_payload"] = f"""WITH {CHAT}, {WIRE},
stored AS (SELECT *, coalesce(reason, CASE n % 50 WHEN 3 THEN 'blank_sender' WHEN 4 THEN 'blank_text' END) AS why FROM judged)
SELECT partition, "offset", CASE WHEN why IS NULL THEN 'Success' ELSE 'PermanentFailure' END AS status, why AS reason
FROM stored"""
ORACLES["quarantine"] = f"""WITH {CHAT}, {WIRE}
SELECT partition, "offset", reason, CASE WHEN strlen(body) > 256 THEN left(body, whole)
    || CASE WHEN strlen(left(body, whole)) < 256 THEN '�' ELSE '' END || '...' ELSE body END AS preview
FROM (SELECT *, list_max(list_filter(range(0, 257), lambda k: strlen(left(body, k)) <= 256)) AS whole FROM judged)
WHERE reason IS NOT NULL"""
ORACLES["publish_events"] = f"""WITH {CHAT}
SELECT scope_id AS key, CAST(json_object('messageId', message_id,
  'scopeType', CASE WHEN scope_type = 'Channel' THEN 0 ELSE 1 END, 'scopeId', scope_id, 'senderId', sender_id,
  'text', text, 'createdAtUtc', {iso('created_at')}, 'originPodId', origin_pod_id) AS VARCHAR) AS value
FROM chat"""
ORACLES["payload_preview"] = """WITH cut AS (
  SELECT doc_id, text, strlen(text) AS bytes,
    list_max(list_filter(range(0, 257), lambda k: strlen(left(text, k)) <= 256)) AS whole
  FROM documents)
SELECT doc_id,
  left(text, whole) || CASE WHEN bytes > 256 AND strlen(left(text, whole)) < 256 THEN '�' ELSE '' END
    || CASE WHEN bytes > 256 THEN '...' ELSE '' END AS by_bytes,
  CASE WHEN bytes = 0 THEN '<empty>' WHEN length(text) > 256 THEN left(text, 256) || '...' ELSE text END
    AS by_characters
FROM cut"""


# --- scope keys and users

ORACLES["scope_key_roundtrip"] = """WITH keys AS (
  SELECT event_id, event_type, user_id, CASE event_type
    WHEN 'view' THEN 'Channel' || user_id WHEN 'click' THEN 'Group:' || user_id
    WHEN 'error' THEN CASE WHEN user_id % 2 = 0 THEN 'Channel:' ELSE ':general' END
    WHEN 'signup' THEN 'Channel:a:' || user_id ELSE 'DirectMessage:conv-' || user_id END AS scope_key
  FROM events)
SELECT event_id, scope_key,
  CASE event_type WHEN 'signup' THEN 'Channel' WHEN 'purchase' THEN 'DirectMessage' END AS scope_type,
  CASE event_type WHEN 'signup' THEN 'a:' || user_id WHEN 'purchase' THEN 'conv-' || user_id END AS scope_id,
  CASE event_type WHEN 'view' THEN 'format' WHEN 'click' THEN 'scope_type' WHEN 'error' THEN 'format' END AS error,
  CASE WHEN event_type IN ('view', 'signup') OR scope_key = 'Channel:' THEN 'Channel'
       WHEN event_type = 'purchase' THEN 'DirectMessage' END AS lenient_type,
  CASE WHEN event_type = 'view' THEN scope_key ELSE substr(scope_key, instr(scope_key, ':') + 1) END AS lenient_id
FROM keys"""
ORACLES["resolve_users"] = """SELECT event_id,
  CASE WHEN event_type IN ('purchase', 'signup') THEN 'user-' || user_id ELSE 'anon_conn-' || event_id END AS user,
  CASE WHEN event_type = 'purchase' THEN 'user-' || user_id ELSE 'anonymous' END AS user_name
FROM events"""


# --- admission


def id_rule(column: str) -> str:
    return f"""CASE WHEN {column} IS NULL THEN '{column}:null' WHEN regexp_matches({column}, {BLANK}) THEN '{column}:blank'
      WHEN {utf16(column)} > 256 THEN '{column}:too_long' END"""


CHECKED = f"""{REQUESTS},
checked AS (
  SELECT *, coalesce({id_rule('sender_id')}, {id_rule('scope_id')},
      CASE WHEN text IS NULL THEN 'text:null' WHEN {utf16('text')} > 4096 THEN 'text:too_long' END) AS request_problem,
    {id_rule('origin_pod_id')} AS pod_problem
  FROM requests)"""

OUTCOME = """SELECT c.message_id,
  CASE WHEN request_problem IS NOT NULL THEN 'VALIDATION_ERROR' WHEN NOT allowed THEN 'RATE_LIMIT_EXCEEDED'
       WHEN pod_problem IS NOT NULL THEN 'CONFIGURATION_ERROR' ELSE 'ACCEPTED' END AS code,
  CASE WHEN request_problem IS NOT NULL THEN request_problem WHEN allowed THEN pod_problem END AS problem
FROM checked c LEFT JOIN gated g ON c.message_id = g.message_id"""


def rolling(source: str, time: str, limit: int, seconds: int) -> str:
    """The rolling counter call by call."""
    return f"""calls AS (
  SELECT sender_id, message_id, {time} AS called_at, row_number() OVER (PARTITION BY sender_id ORDER BY {time}, message_id) AS k
  FROM {source}),
gated AS (
  SELECT sender_id, message_id, k, called_at, true AS allowed, 1 AS used, called_at AS last_at FROM calls WHERE k = 1
  UNION ALL
  SELECT c.sender_id, c.message_id, c.k, c.called_at,
    g.used < {limit} OR c.called_at >= g.last_at + INTERVAL {seconds} SECOND,
    CASE WHEN c.called_at >= g.last_at + INTERVAL {seconds} SECOND THEN 1 WHEN g.used < {limit} THEN g.used + 1 ELSE g.used END,
    CASE WHEN g.used < {limit} OR c.called_at >= g.last_at + INTERVAL {seconds} SECOND THEN c.called_at ELSE g.last_at END
  FROM gated g JOIN calls c ON c.sender_id = g.sender_id AND c.k = g.k + 1)"""


ORACLES["validate_message"] = f"WITH {CHECKED} SELECT message_id, request_problem, pod_problem FROM checked"
ORACLES["persistable"] = f"""WITH {REQUESTS} SELECT message_id, sender_id FROM requests
WHERE NOT regexp_matches(sender_id, {BLANK}) AND NOT regexp_matches(text, {BLANK})"""
ORACLES["admission_outcome"] = f"""WITH {CHECKED},
gated AS (
  SELECT message_id, row_number() OVER (PARTITION BY sender_id, {window_start('requested_at', 60)}
    ORDER BY requested_at, message_id) <= 12 AS allowed
  FROM checked WHERE request_problem IS NULL)
{OUTCOME}"""
ORACLES["admission_outcome_rolling"] = f"""WITH RECURSIVE {CHECKED},
{rolling('checked WHERE request_problem IS NULL', 'requested_at', 12, 60)}
{OUTCOME}"""
ORACLES["gate_fixed"] = f"""WITH {CHAT}
SELECT message_id, sender_id, row_number() OVER (PARTITION BY sender_id, {window_start('created_at', DAY)}
  ORDER BY created_at, message_id) <= 3 AS allowed FROM chat"""
ORACLES["stream_gate_fixed"] = f"""WITH {CHAT},
gated AS (SELECT *, row_number() OVER (PARTITION BY sender_id, {window_start('created_at', DAY)}
  ORDER BY created_at, message_id) <= 3 AS allowed FROM chat)
SELECT sender_id, message_id, {iso('created_at')} AS created_at, allowed FROM gated WHERE created_at <= {WATERMARK}"""
ORACLES["gate_rolling"] = f"""WITH RECURSIVE {CHAT}, {rolling('chat', 'created_at', 3, DAY)}
SELECT message_id, sender_id, allowed FROM gated"""
ORACLES["stream_gate_rolling"] = f"""WITH RECURSIVE {CHAT}, {rolling('chat', 'created_at', 3, DAY)}
SELECT sender_id, message_id, {iso('called_at')} AS created_at, allowed FROM gated
WHERE called_at <= {WATERMARK}"""


# --- history

HISTORY_COLUMNS = f"""scope_key, {iso('created_at')} AS created_at, message_id, sender_id, text, origin_pod_id,
  broker_partition, broker_offset"""

ORACLES["append_history"] = f"""WITH {CHAT}
SELECT scope_type || ':' || scope_id AS scope_key, {iso('created_at')} AS created_at, message_id, sender_id, text,
  origin_pod_id, CAST(0 AS INTEGER) AS broker_partition, n AS broker_offset
FROM chat WHERE created_at >= TIMESTAMP '2024-01-16'"""
ORACLES["append_history_table"] = f"""WITH {CHAT}
SELECT scope_type || ':' || scope_id AS scope_key, {iso('created_at')} AS created_at, message_id, sender_id, text,
  origin_pod_id, CAST(0 AS INTEGER) AS broker_partition, n AS broker_offset
FROM chat"""
ORACLES["delete_history_table"] = f"""WITH {CHAT}
SELECT scope_type || ':' || scope_id AS scope_key, {iso('created_at')} AS created_at, message_id, sender_id, text,
  origin_pod_id
FROM chat WHERE created_at >= TIMESTAMP '2024-01-11 07:30:00'
  AND NOT (scope_type || ':' || scope_id = 'Channel:view-3' AND created_at < TIMESTAMP '2024-01-20 18:00:00')"""
ORACLES["browse"] = "SELECT least(10, count(*)) AS found FROM events"
ORACLES["distinct_messages"] = f"""WITH {CHAT}
SELECT message_id, scope_type, scope_id, sender_id, text, {iso('created_at')} AS created_at, origin_pod_id FROM chat"""
ORACLES["stream_dedupe"] = ORACLES["distinct_messages"]


def lookup(condition: str) -> str:
    return f"""WITH {CHAT_HISTORY},
page AS (SELECT * FROM history WHERE scope_key = 'Channel:view-3' {condition} ORDER BY created_at, message_id LIMIT 25)
SELECT {HISTORY_COLUMNS} FROM page"""


FROM, TO = "TIMESTAMP '2024-01-08'", "TIMESTAMP '2024-01-22'"
ORACLES["history_all"] = lookup("")
ORACLES["history_from"] = lookup(f"AND created_at >= {FROM}")
ORACLES["history_to"] = lookup(f"AND created_at <= {TO}")
ORACLES["history_range"] = lookup(f"AND created_at BETWEEN {FROM} AND {TO}")
ORACLES["next_page"] = lookup(f"AND (created_at, message_id) > ({FROM}, '0')")
ORACLES["history_events"] = f"""WITH {CHAT}
SELECT message_id, scope_type, scope_id, sender_id, text, {iso('created_at')} AS created_at, origin_pod_id,
  CAST(n % 3 AS INTEGER) AS broker_partition, n // 3 AS broker_offset FROM chat"""
ORACLES["latest_per_scope"] = f"""WITH {CHAT_HISTORY},
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY scope_key ORDER BY created_at DESC, message_id DESC)
  AS INTEGER) AS recency FROM history)
SELECT {HISTORY_COLUMNS}, recency FROM ranked WHERE recency <= 3"""
ORACLES["scope_sizes"] = f"""WITH {CHAT_HISTORY}
SELECT scope_key, count(*) AS rows, count(*) > 70 AS is_wide FROM history GROUP BY scope_key"""
ORACLES["scope_size_distribution"] = f"""WITH {CHAT_HISTORY},
sizes AS (SELECT scope_key, count(*) AS n FROM history GROUP BY scope_key)
SELECT count(*) AS scopes, CAST(sum(n) AS BIGINT) AS total_rows, max(n) AS max_rows,
  count(*) FILTER (n > 70) AS wide_scopes, quantile_cont(CAST(n AS DOUBLE), 0.5) AS p50,
  quantile_cont(CAST(n AS DOUBLE), 0.95) AS p95, quantile_cont(CAST(n AS DOUBLE), 0.99) AS p99
FROM sizes"""
ORACLES["time_bucket_sizes"] = f"""WITH {CHAT_HISTORY}
SELECT scope_key, {iso("date_trunc('day', created_at)")} AS time_bucket, count(*) AS rows FROM history GROUP BY ALL"""
ORACLES["bucket_widths"] = f"""WITH {CHAT_HISTORY},
filled AS (SELECT scope_key, CAST(w AS INTEGER) AS w, count(*) AS n FROM history, (VALUES (604800), (86400), (21600), (3600)) AS widths(w)
  GROUP BY scope_key, w, epoch_us(created_at) // (w * 1000000::BIGINT)),
measured AS (SELECT scope_key, w, CAST(sum(n) AS BIGINT) AS rows, max(n) AS largest FROM filled GROUP BY scope_key, w)
SELECT scope_key, w AS bucket_seconds, rows, largest FROM measured WHERE largest <= 20 OR w = 3600
QUALIFY row_number() OVER (PARTITION BY scope_key ORDER BY w DESC) = 1"""
ORACLES["bucketed_history_table"] = ORACLES["append_history_table"]
ORACLES["bucketed_history_range"] = ORACLES["history_range"]
ORACLES["bucketed_next_page"] = ORACLES["next_page"]
ORACLES["retention_by_scope"] = f"""WITH {CHAT_HISTORY}
SELECT scope_key, {iso('created_at')} AS created_at, message_id FROM history
WHERE NOT (scope_key = 'Channel:view-3' AND created_at < {TO})"""
ORACLES["retention_by_age"] = f"""WITH {CHAT_HISTORY}
SELECT scope_key, {iso('created_at')} AS created_at, message_id FROM history
WHERE created_at > TIMESTAMP '2024-01-17'"""
ORACLES["by_message_id"] = f"""WITH {CHAT_HISTORY}
SELECT message_id, scope_key, {iso('created_at')} AS created_at, sender_id, text,
  CAST(CAST('0x' || left(md5(message_id), 8) AS BIGINT) % 256 AS INTEGER) AS id_bucket FROM history"""
ORACLES["pending"] = """SELECT DISTINCT event_type AS module_name, strftime(ts, '%Y-%m-%d') AS migration_id
FROM events WHERE ts >= TIMESTAMP '2024-01-16'"""


# --- delivery

ORACLES["fan_out"] = f"WITH {CHAT}, {MEMBERS}, {PAIRS} SELECT * FROM pairs"
ORACLES["stream_fan_out"] = ORACLES["fan_out"]
ORACLES["stream_fan_out_by_changes"] = f"""WITH {CHAT}, {MEMBERS}
SELECT c.message_id, c.scope_type, c.scope_id, m.user_id
FROM chat c JOIN members m ON c.scope_type = m.scope_type AND c.scope_id = m.scope_id
 AND c.created_at >= m.joined_at AND c.created_at < m.left_at WHERE c.created_at <= {WATERMARK}"""
ORACLES["fan_out_by_scope_id"] = f"""WITH {CHAT}, {MEMBERS}
SELECT c.message_id, count(*) AS recipients FROM chat c JOIN members m ON c.scope_id = m.scope_id
 AND c.created_at >= m.joined_at AND c.created_at < m.left_at GROUP BY c.message_id"""
ORACLES["fan_out_counts"] = f"""WITH {CHAT}, {MEMBERS}, {PAIRS}
SELECT c.message_id, c.scope_type, c.scope_id, count(p.message_id) AS recipients
FROM chat c LEFT JOIN pairs p ON c.message_id = p.message_id GROUP BY ALL"""
ORACLES["route_to_pods"] = f"""WITH {CHAT}, {MEMBERS}, {PAIRS}, {PRESENCE}, {LIVE}
SELECT p.user_id, p.message_id, l.pod_id, l.connection_id FROM pairs p LEFT JOIN live l ON p.user_id = l.user_id"""
ORACLES["route_given_pairs"] = ORACLES["route_to_pods"]
ORACLES["undelivered"] = f"""WITH {CHAT}, {MEMBERS}, {PAIRS}, {PRESENCE}, {LIVE}
SELECT user_id, message_id FROM pairs WHERE user_id NOT IN (SELECT user_id FROM live)"""


def offsets(time: str, source: str = "chat") -> str:
    return f"""placed AS (
  SELECT *, CAST(CAST('0x' || left(md5(scope_id), 8) AS BIGINT) % 3 AS INTEGER) AS partition FROM {source}),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY partition ORDER BY {time}, message_id) - 1 AS "offset" FROM placed)"""


ORACLES["assign_offsets"] = f"""WITH {CHAT}, {offsets('created_at')}
SELECT message_id, scope_id, partition, "offset" FROM numbered"""
ORACLES["partition_counts"] = f"""WITH {CHAT}, {offsets('created_at')}
SELECT partition, count(*) AS events, max("offset") + 1 AS next_offset FROM numbered GROUP BY partition"""
ORACLES["ordering_audit"] = f"""WITH {CHAT},
sent AS (SELECT chat.*, created_at + to_minutes(CAST(trunc(value) AS BIGINT)) AS arrived_at
         FROM chat JOIN events ON n = event_id),
{offsets('arrived_at', 'sent')},
compared AS (SELECT *, lag(created_at) OVER o AS t, lag(message_id) OVER o AS m FROM numbered
             WINDOW o AS (PARTITION BY scope_type, scope_id, partition ORDER BY "offset"))
SELECT scope_type, scope_id, count(*) AS messages, count(DISTINCT partition) AS partitions,
  count(*) FILTER (t > created_at OR (t = created_at AND m > message_id)) AS inversions,
  count(*) FILTER (t > created_at OR (t = created_at AND m > message_id)) = 0 AND count(DISTINCT partition) = 1
    AS in_order
FROM compared GROUP BY scope_type, scope_id"""


# --- presence

ORACLES["presence_state"] = f"""WITH {PRESENCE}, {LIVE}
SELECT user_id, pod_id, connection_id, {iso('last_seen')} AS last_seen FROM live"""
ORACLES["presence_state_by_connection"] = f"""WITH {PRESENCE}, {LIVE}
SELECT user_id, pod_id, connection_id, {iso('ts')} AS last_seen FROM last_event
WHERE k = 1 AND kind <> 'offline' AND ts + INTERVAL 1 DAY > {CUT}"""
ORACLES["connection_counts"] = f"""WITH {PRESENCE}, {LIVE}
SELECT u.user_id, count(l.user_id) AS connections, count(l.user_id) > 0 AS is_online
FROM (SELECT DISTINCT user_id FROM presence WHERE ts <= {CUT}) u LEFT JOIN live l ON u.user_id = l.user_id
GROUP BY u.user_id"""
ORACLES["connections"] = f"""WITH {PRESENCE}, {LIVE}
SELECT user_id, connection_id, pod_id, pod_id || ':' || connection_id AS member,
  epoch_us(last_seen) // 1000000 AS score FROM live ORDER BY user_id, score, member"""

INTERVALS = f"""{PRESENCE},
marked AS (
  SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR
    THEN 0 ELSE 1 END AS starts
  FROM presence WHERE kind <> 'offline'),
numbered AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts) AS interval_no FROM marked),
intervals AS (
  SELECT user_id, interval_no, min(ts) AS f, max(ts) + INTERVAL 6 HOUR AS u, count(*) AS beats
  FROM numbered GROUP BY user_id, interval_no)
SELECT user_id, {iso('f')} AS online_from, {iso('u')} AS online_until, beats FROM intervals"""
ORACLES["online_intervals"] = f"WITH {INTERVALS}"
ORACLES["stream_online_intervals"] = f"WITH {INTERVALS} WHERE u <= {WATERMARK}"

# Each user's connections event by event; a user whose expiry has come loses all of them.
ORACLES["stream_presence"] = f"""WITH RECURSIVE {PRESENCE},
ordered AS (
  SELECT user_id, ts, kind = 'offline' AS off, pod_id || ':' || connection_id AS member,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, kind = 'offline', pod_id || ':' || connection_id) AS k
  FROM presence WHERE ts <= {WATERMARK}),
steps AS (
  SELECT user_id, k, ts, CASE WHEN off THEN CAST([] AS VARCHAR[]) ELSE [member] END AS members,
    CASE WHEN off THEN NULL ELSE ts + INTERVAL 1 DAY END AS expires, CAST(NULL AS TIMESTAMP) AS gone_at, 0 AS before
  FROM ordered WHERE k = 1
  UNION ALL
  SELECT user_id, k, ts,
    CASE WHEN off THEN list_filter(base, lambda m: m <> member) ELSE list_distinct(list_append(base, member)) END,
    CASE WHEN off THEN expires ELSE ts + INTERVAL 1 DAY END,
    CASE WHEN len(members) > 0 AND expires <= ts THEN expires END, len(base)
  FROM (
    SELECT o.*, s.members, s.expires,
      CASE WHEN len(s.members) > 0 AND s.expires <= o.ts THEN CAST([] AS VARCHAR[]) ELSE s.members END AS base
    FROM steps s JOIN ordered o ON o.user_id = s.user_id AND o.k = s.k + 1)),
changes AS (
  SELECT user_id, gone_at AS at_time, 0 AS n FROM steps WHERE gone_at IS NOT NULL
  UNION ALL
  SELECT user_id, ts, len(members) FROM steps WHERE len(members) <> before
  UNION ALL
  SELECT user_id, expires, 0 FROM steps WHERE len(members) > 0 AND expires <= {WATERMARK}
    AND k = (SELECT max(k) FROM ordered o WHERE o.user_id = steps.user_id))
SELECT user_id, {iso('at_time')} AS changed_at, CAST(n AS INTEGER) AS connections, n > 0 AS is_online FROM changes"""


# --- logs

ORACLES["classify_log"] = f"WITH {LOGS} SELECT line_id, pod_id, app_name, log_type FROM classified"
ORACLES["route_logs"] = f"""WITH {LOGS}
SELECT CASE log_type WHEN 'app' THEN 'logs-' ELSE 'system-logs-' END || strftime(ts, '%Y.%m.%d') AS index_name,
  log_type, count(*) AS lines FROM classified WHERE log_type <> 'duplicate_to_drop' GROUP BY ALL"""
ORACLES["search_logs"] = f"""WITH {LOGS} SELECT line_id, {iso('ts')} AS ts, message FROM logs
WHERE level = 'Error' AND pod = 'pod-1' AND message ILIKE '%connection%'"""
ORACLES["search_logs_by_scope"] = f"""WITH {LOGS} SELECT line_id, {iso('ts')} AS ts, message FROM logs
WHERE level = 'Information' AND scope = 'view-3'"""
ORACLES["recent_logs"] = f"""WITH {LOGS}, page AS (SELECT * FROM logs ORDER BY ts DESC, message DESC LIMIT 10)
SELECT line_id, {iso('ts')} AS ts, level, message FROM page"""
ORACLES["log_levels"] = f"WITH {LOGS} SELECT level, machine_name, count(*) AS lines FROM logs GROUP BY ALL"
ORACLES["log_levels_by_series"] = f"""WITH {LOGS}
SELECT level, count(*) FILTER (machine_name = 'pod-0') AS "pod-0", count(*) FILTER (machine_name = 'pod-1') AS "pod-1",
  count(*) FILTER (machine_name = 'pod-2') AS "pod-2" FROM logs GROUP BY level"""
ORACLES["latency_summary"] = f"""WITH {LOGS}
SELECT machine_name, quantile_cont(latency_ms, 0.95) > 100 AS alert, round(quantile_cont(latency_ms, 0.5), 6) AS p50,
  round(quantile_cont(latency_ms, 0.95), 6) AS p95, round(quantile_cont(latency_ms, 0.99), 6) AS p99
FROM logs GROUP BY machine_name"""
ORACLES["clean_correlation_ids"] = f"""WITH {LOGS}
SELECT line_id, 'corr_' || {uuid('line_id')} AS correlation_id FROM logs"""
ORACLES["exception_statuses"] = f"""WITH {LOGS},
statuses(exception, status, title, detail, rfc_section) AS (VALUES
  ('UnauthorizedAccessException', 401, 'Unauthorized', 'Authentication is required to access this resource.', '6.5.2'),
  ('KeyNotFoundException', 404, 'Not Found', 'The requested resource was not found.', '6.5.4'),
  ('InvalidOperationException', 409, 'Conflict', 'The request could not be completed due to a conflict.', '6.5.8'),
  ('TimeoutException', 504, 'Gateway Timeout', 'The request timed out while processing.', '6.6.5'),
  ('ArgumentNullException', 400, 'Bad Request', 'The request was invalid or missing required parameters.', '6.5.1'),
  ('ArgumentException', 400, 'Bad Request', 'The request was invalid or missing required parameters.', '6.5.1'),
  ('IOException', 500, 'Internal Server Error',
   'An error occurred while processing your request. Please try again later.', '6.6.1'))
SELECT line_id, l.exception, status, title, detail, rfc_section, status >= 500 AS is_server_error,
  CASE WHEN status >= 500 THEN 'Error' ELSE 'Warning' END AS log_level
FROM logs l JOIN statuses s ON l.exception = s.exception"""
ORACLES["transient_errors"] = f"""WITH {LOGS}
SELECT line_id, exception, exception = 'TimeoutException' OR message ILIKE '%no host available%'
  OR message ILIKE '%query timeout%' OR message ILIKE '%connection%' OR inner_message IS NOT NULL AS is_transient
FROM logs WHERE exception IS NOT NULL"""


# --- content

ORACLES["word_frequency"] = f"""WITH words AS (
  SELECT source AS scope_id, {window_start('make_timestamp((1704067200 + doc_id * 3600) * 1000000)', 7 * DAY)} AS w,
    unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS word
  FROM documents)
SELECT 'Channel' AS scope_type, scope_id, {iso('w')} AS window_start, {iso('w + INTERVAL 7 DAY')} AS window_end, word,
  count(*) AS occurrences
FROM words WHERE word <> '' GROUP BY ALL"""
ORACLES["emoji_counts"] = f"""WITH {CHAT},
found AS (SELECT scope_type, scope_id, {window_start('created_at', DAY)} AS w,
  unnest(regexp_extract_all(text, '[\\x{{1F300}}-\\x{{1F64F}}\\x{{1F680}}-\\x{{1F6FF}}\\x{{1F900}}-\\x{{1FAFF}}\\x{{2600}}-\\x{{27BF}}]')) AS emoji
  FROM chat)
SELECT scope_type, scope_id, {iso('w')} AS window_start, {iso('w + INTERVAL 1 DAY')} AS window_end, emoji,
  count(*) AS occurrences FROM found GROUP BY ALL"""
