"""Wide-column queries: partitions, clustering ranges, last-write-wins, tombstones, time to live, cluster views.

Keys stay typed. Newest versions come from max_by over (_ts, _seq), which aggregates before the shuffle.
"""

from __future__ import annotations

_NOW = "TIMESTAMP '2024-06-01 00:00:00'"
#: events as versions of rows (user_id, event_type); every seventh is a tombstone.
_V = "(SELECT user_id, event_type, value, ts AS _ts, event_id AS _seq, event_id % 7 = 0 AS _tombstone FROM events) v"
_LWW = f"SELECT user_id, event_type, max_by(value, struct(_ts, _seq)) AS value, max_by(_tombstone, struct(_ts, _seq)) AS dead FROM {_V} GROUP BY user_id, event_type"
_LWW_DUCK = f"SELECT user_id, event_type, value, _tombstone AS dead FROM {_V} QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY _ts DESC, _seq DESC) = 1"


def _ring(alive: str) -> str:
    """Each key against each token, for the SQL that the ring's plan is held against."""
    tokens = f"(SELECT n_nationkey AS node, md5(CAST(n_nationkey AS VARCHAR) || ':vn' || CAST(v.range AS VARCHAR)) AS h FROM nation CROSS JOIN range(150) v WHERE {alive})"
    return f"SELECT k.key, COALESCE(arg_min(r.node, r.h) FILTER (WHERE r.h > k.hk), arg_min(r.node, r.h)) AS node FROM (SELECT c_custkey AS key, md5(CAST(c_custkey AS VARCHAR)) AS hk FROM customer) k CROSS JOIN {tokens} r GROUP BY k.key, k.hk"


_CK = "SELECT user_id, ts, event_type FROM events WHERE user_id = 3 AND ts >= {t} '2024-01-08 00:00:00' AND ts < {t} '2024-01-22 12:00:00'"

QUERIES: dict[str, tuple[str, str, str | None]] = {
    "partition_scan": ("events", "SELECT user_id, ts, event_type, value FROM events WHERE user_id = 7", None),
    "point_get": ("events", "SELECT user_id, ts, value FROM events WHERE user_id = 7 AND ts = (SELECT MAX(ts) FROM events WHERE user_id = 7)", None),
    "lww_resolve": ("events", f"SELECT user_id, event_type, value FROM ({_LWW}) t", f"SELECT user_id, event_type, value FROM ({_LWW_DUCK}) t"),
    "lww_tombstone": ("events", f"SELECT user_id, event_type, value FROM ({_LWW}) t WHERE NOT dead", f"SELECT user_id, event_type, value FROM ({_LWW_DUCK}) t WHERE NOT dead"),
    "replica_merge": ("events", "SELECT user_id, event_type, max_by(value, struct(ts, event_id)) AS value FROM (SELECT * FROM events WHERE event_id % 3 <> 0 UNION ALL SELECT * FROM events WHERE event_id % 3 <> 1) r GROUP BY user_id, event_type", "SELECT user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1"),
    "ttl_expired": ("events", f"SELECT user_id, ts, value FROM events WHERE ts + make_interval(0, 0, 0, CAST(event_id % 400 AS INT)) > CAST({_NOW} AS TIMESTAMP_NTZ)", f"SELECT user_id, ts, value FROM events WHERE ts + to_days(CAST(event_id % 400 AS INT)) > {_NOW}"),
    "ck_point": ("events", "SELECT e.user_id, e.ts, e.value FROM events e JOIN (SELECT user_id, MIN(ts) AS ts FROM events GROUP BY user_id) f ON e.user_id = f.user_id AND e.ts = f.ts", None),
    "ck_range": ("events", _CK.format(t="TIMESTAMP_NTZ"), _CK.format(t="TIMESTAMP")),
    "ck_desc_limit": ("events", "SELECT user_id, ts, value FROM events WHERE user_id = 5 ORDER BY ts DESC LIMIT 10", None),
    "cql_count": ("events", "SELECT COUNT(*) AS count FROM events WHERE user_id = 5 AND event_type = 'click'", None),
    "cql_filter": ("events", "SELECT ts, value FROM events WHERE user_id = 5 AND value > 20 ORDER BY ts LIMIT 50", None),
    "upsert_replace": ("events", f"SELECT user_id, event_type, CASE WHEN dead THEN -1.0 ELSE value END AS value FROM ({_LWW}) t", f"SELECT user_id, event_type, CASE WHEN dead THEN -1.0 ELSE value END AS value FROM ({_LWW_DUCK}) t"),
    "heartbeat_status": ("events", "SELECT user_id AS node, CASE WHEN unix_timestamp(m) - unix_timestamp(seen) > 86400 * 8 THEN 'DOWN' WHEN unix_timestamp(m) - unix_timestamp(seen) > 86400 * 3 THEN 'SUSPECT' ELSE 'UP' END AS status FROM (SELECT user_id, CAST(MAX(ts) AS TIMESTAMP) AS seen FROM events GROUP BY user_id) e CROSS JOIN (SELECT CAST(MAX(ts) AS TIMESTAMP) AS m FROM events) l", "SELECT user_id AS node, CASE WHEN date_diff('second', date_trunc('second', seen), date_trunc('second', m)) > 86400 * 8 THEN 'DOWN' WHEN date_diff('second', date_trunc('second', seen), date_trunc('second', m)) > 86400 * 3 THEN 'SUSPECT' ELSE 'UP' END AS status FROM (SELECT user_id, MAX(ts) AS seen FROM events GROUP BY user_id) e CROSS JOIN (SELECT MAX(ts) AS m FROM events) l"),
    "ring_distribution": ("nation customer", None, _ring("TRUE")),
    "ring_after_stop": ("nation customer", None, _ring("n_nationkey NOT IN (3, 7)")),
    "quorum_available": ("nation", "SELECT n_regionkey AS shard, COUNT(*) AS replicas, SUM(CASE WHEN n_nationkey % 3 > 0 THEN 1 ELSE 0 END) >= CAST(FLOOR(COUNT(*) / 2) AS BIGINT) + 1 AS quorum, MIN(n_nationkey % 3) > 0 AS all_up FROM nation GROUP BY n_regionkey", None),
    "describe_table": ("events", None, "SELECT column_name AS col, CASE column_name WHEN 'user_id' THEN 'partition' WHEN 'ts' THEN 'clustering' ELSE 'regular' END AS role FROM information_schema.columns WHERE table_name = 'events'"),
}
