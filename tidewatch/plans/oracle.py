"""DuckDB text of the stages that several queries share."""

from __future__ import annotations

RAW = r"""
e0 AS (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events),
raw AS (
  SELECT event_id AS _seq, ts, 'user_' || user_id AS username,
    CASE event_type WHEN 'signup' THEN '4624' WHEN 'error' THEN '4625' WHEN 'click' THEN '4663' WHEN 'view' THEN '4688' WHEN 'purchase' THEN '3' ELSE '' END AS event_id,
    '10.0.0.' || (k % 8) AS src_ip,
    CASE WHEN event_type = 'click' THEN (CASE WHEN k < 20 THEN 'C:\Sensitive\' ELSE 'C:\Users\' END) || 'doc_' || k ELSE '' END AS file_path,
    CASE WHEN event_type = 'view' THEN 'proc_' || (k % 5) ELSE '' END AS process_name,
    CASE WHEN event_type = 'view' THEN 'cmd_' || (k % 7) ELSE '' END AS command_line,
    CASE WHEN event_type = 'purchase' THEN CAST(floor(value * 100) AS BIGINT) ELSE 0 END AS bytes_sent
  FROM e0)"""


def sessions(minutes: int) -> str:
    return rf"""{RAW},
gaps AS (SELECT *, lag(ts) OVER (PARTITION BY username ORDER BY ts, _seq) AS before FROM raw),
nums AS (SELECT *, sum(CASE WHEN before IS NULL OR ts - before > INTERVAL {minutes} MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY username ORDER BY ts, _seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid FROM gaps),
cmds AS (SELECT username, sid, sum(c) AS n, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS h FROM (SELECT username, sid, command_line, CAST(count(*) AS DOUBLE) AS c FROM nums WHERE event_id IN ('4688', '1') AND command_line <> '' GROUP BY ALL) GROUP BY ALL),
sess AS (
  SELECT username, sid, min(ts) AS start_ts, max(ts) AS last_ts, count(*) AS nb_events,
    count(*) FILTER (WHERE event_id = '4624') AS login_count, count(*) FILTER (WHERE event_id = '4634') AS logout_count,
    count(*) FILTER (WHERE event_id = '4625') AS nb_failed_logins,
    count(*) FILTER (WHERE event_id IN ('4663', '11') AND file_path <> '') AS nb_files_accessed,
    count(*) FILTER (WHERE event_id IN ('4663', '11') AND contains(lower(file_path), 'c:\sensitive\')) AS nb_sensitive_files,
    count(*) FILTER (WHERE event_id IN ('4688', '1') AND process_name <> '') AS nb_processes,
    CAST(coalesce(sum(bytes_sent) FILTER (WHERE event_id = '3'), 0) AS BIGINT) AS bytes_sent,
    CAST(count(DISTINCT src_ip) FILTER (WHERE event_id = '4624' AND src_ip <> '') > 1 AS INT) AS new_ip,
    coalesce(arg_min(src_ip, (ts, _seq)) FILTER (WHERE event_id = '4624' AND src_ip <> ''), '') AS first_ip,
    coalesce(arg_min(process_name, (ts, _seq)) FILTER (WHERE event_id IN ('4688', '1') AND process_name <> ''), '') AS process_name,
    coalesce(arg_min(command_line, (ts, _seq)) FILTER (WHERE event_id IN ('4688', '1') AND command_line <> ''), '') AS command_line
  FROM nums GROUP BY username, sid),
feat AS (
  SELECT strftime(start_ts, '%Y-%m-%dT%H:%M:%S+00:00') AS timestamp, s.username, CAST(hour(start_ts) AS INT) AS hour,
    CAST(hour(start_ts) < 9 OR hour(start_ts) >= 18 AS INT) AS is_night, CAST(isodow(start_ts) >= 6 AS INT) AS is_weekend,
    nb_files_accessed, nb_sensitive_files, nb_failed_logins, nb_processes, bytes_sent, new_ip, CAST(nb_sensitive_files > 0 AS INT) AS sensitive_path_access,
    process_name, command_line,
    (epoch_us(last_ts) - epoch_us(start_ts)) / 1e6 / 60 AS mins, greatest(coalesce(h, 0), 0) AS entropy, start_ts, last_ts, s.sid
  FROM sess s LEFT JOIN cmds c ON s.username = c.username AND s.sid = c.sid),
f AS (
  SELECT * EXCLUDE (mins, entropy), round_even(nb_files_accessed / greatest(mins, 1.0), 4) AS velocity,
    round_even(entropy, 4) AS entropy_commands, round_even(greatest(mins, 1.0), 2) AS session_duration_min FROM feat)"""


def z(column: str, frame: str) -> str:
    return f"CASE WHEN count(*) OVER {frame} <= 1 OR max({column}) OVER {frame} = min({column}) OVER {frame} THEN 0.0 ELSE round_even(({column} - avg({column}) OVER {frame}) / stddev_samp({column}) OVER {frame}, 4) + 0.0 END"


def scored(minutes: int) -> str:
    """Features with both z-scores over all of a user's sessions, as table g."""
    return f"""{sessions(minutes)},
g AS (SELECT *, {z('nb_files_accessed', 'u')} AS z_score_files, {z('nb_failed_logins', 'u')} AS z_score_logins FROM f WINDOW u AS (PARTITION BY username))"""


def voted(minutes: int) -> str:
    """Votes of three fixed rules in place of models, and a label from other columns, as table v."""
    return f"""{scored(minutes)},
r AS (SELECT *, abs(z_score_files) > 1.0 AS a, bytes_sent > 50000 AS b, entropy_commands > 0.5 AS c, CASE WHEN nb_failed_logins >= 3 THEN 2 WHEN nb_sensitive_files > 0 THEN 1 ELSE 0 END AS label FROM g),
v AS (SELECT *, CAST(a AS INT) + CAST(b AS INT) + CAST(c AS INT) AS votes FROM r),
w AS (SELECT *, votes >= 2 AS is_anomaly, round_even(votes / 3.0, 2) AS confidence FROM v)"""
