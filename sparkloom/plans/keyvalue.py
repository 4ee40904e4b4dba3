"""Key-value queries in set form: a command over all keys at once.

Lists are rows (key, idx, elem), hashes rows (key, field, value), sets rows (key, member) and sorted sets
rows (key, member, score): a huge value is many rows and no single one. Ranks are windows by key.
"""

from __future__ import annotations

from ..functions.text import glob_regex

#: sorted set: customers of a nation by balance
_Z = "(SELECT c_nationkey AS k, c_custkey AS m, c_acctbal AS s FROM customer) z"
_RANKED = f"(SELECT k, m, s, CAST(row_number() OVER (PARTITION BY k ORDER BY s, m) AS BIGINT) - 1 AS r, CAST(row_number() OVER (PARTITION BY k ORDER BY s DESC, m DESC) AS BIGINT) - 1 AS rr FROM {_Z}) t"


def _ends(last: int, order: str = "s, m", first: int = 1) -> str:
    """Members of certain ranks: a filter on the row number itself, so that each task passes on only so many of a key."""
    low = f" AND x >= {first}" if first > 1 else ""
    return f"SELECT k, m, s FROM (SELECT k, m, s, row_number() OVER (PARTITION BY k ORDER BY {order}) AS x FROM {_Z}) t WHERE x <= {last}{low}"


#: second versions of scores, for conditional updates
_NEW = "(SELECT c_nationkey AS k, c_custkey AS m, c_acctbal / 2 AS s FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_nationkey AS k, c_custkey + 1000000 AS m, 1.0 AS s FROM customer WHERE c_custkey % 10 = 0) n"


def _zadd(keep: str) -> str:
    return f"SELECT COALESCE(o.k, n.k) AS k, COALESCE(o.m, n.m) AS m, CASE WHEN {keep} THEN n.s ELSE o.s END AS s FROM {_Z.replace(') z', ') o')} FULL JOIN {_NEW} ON o.k = n.k AND o.m = n.m WHERE NOT (o.m IS NULL AND NOT ({keep}))"


#: set: parts of a supplier; list: events of a user in order; hash: last value of each type of a user
_S = "(SELECT DISTINCT l_suppkey AS k, l_partkey AS m FROM lineitem)"
_L = "(SELECT user_id AS k, event_type AS e, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) - 1 AS i, CAST(COUNT(*) OVER (PARTITION BY user_id) AS BIGINT) AS n FROM events) l"
_H = "(SELECT user_id AS k, event_type AS f, value AS v FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) x WHERE r = 1) h"
#: strings: one for each customer; expiry in seconds from now, null for none
_K = "(SELECT concat('user:', CAST(c_custkey AS {s})) AS k, c_name AS v, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey % 50 - 10 END AS left_s, CASE c_custkey % 5 WHEN 0 THEN 'string' WHEN 1 THEN 'list' WHEN 2 THEN 'hash' WHEN 3 THEN 'set' ELSE 'zset' END AS t, CAST(c_custkey % 2 AS BIGINT) AS db, c_custkey FROM customer) s"
_KS, _KD = _K.format(s="STRING"), _K.format(s="VARCHAR")


_GLOB, _KEYS = "us?r:[1-3]*[!05]", "SELECT k FROM {k} WHERE k {test}"


def _both(sql: str) -> tuple[str, str]:
    return sql.replace("@K", _KS), sql.replace("@K", _KD)


QUERIES: dict[str, tuple[str, str, str | None]] = {
    "zrank": ("customer", f"SELECT k, m, r FROM {_RANKED}", None),
    "zrevrank": ("customer", f"SELECT k, m, rr FROM {_RANKED}", None),
    "zrange": ("customer", _ends(7, first=3), None),
    "zrevrange": ("customer", _ends(5, "s DESC, m DESC"), None),
    "zrangebyscore": ("customer", f"SELECT k, m, s FROM {_Z} WHERE s > 100 AND s <= 2500", None),
    "zrevrangebyscore": ("customer", f"SELECT k, m, s FROM (SELECT k, m, s, row_number() OVER (PARTITION BY k ORDER BY s DESC, m DESC) AS x FROM {_Z} WHERE s BETWEEN 100 AND 2500) t WHERE x > 1 AND x <= 4", None),
    "zcount": ("customer", f"SELECT k, COUNT(*) AS n FROM {_Z} WHERE s >= 0 AND s < 5000 GROUP BY k", None),
    "zcard": ("customer", f"SELECT k, COUNT(*) AS n FROM {_Z} GROUP BY k", None),
    "zscore": ("customer", f"SELECT k, m, s FROM {_Z} WHERE m IN (1, 2, 3, 500)", None),
    "zincrby": ("customer", f"SELECT k, m, ROUND(s + 5, 2) AS s FROM {_Z}", None),
    "zadd_nx": ("customer", _zadd("o.m IS NULL"), None),
    "zadd_xx": ("customer", _zadd("o.m IS NOT NULL AND n.m IS NOT NULL"), None),
    "zadd_gt": ("customer", _zadd("n.m IS NOT NULL AND (o.m IS NULL OR n.s > o.s)"), None),
    "zadd_lt": ("customer", _zadd("n.m IS NOT NULL AND (o.m IS NULL OR n.s < o.s)"), None),
    "zpopmin": ("customer", _ends(3), None),
    "zpopmax": ("customer", _ends(3, "s DESC, m DESC"), None),
    "zrem": ("customer", f"SELECT k, m, s FROM {_Z} WHERE m % 4 <> 0", None),
    "sunion": ("lineitem", f"SELECT m FROM {_S} a WHERE k = 1 UNION SELECT m FROM {_S} b WHERE k = 2", None),
    "sinter": ("lineitem", f"SELECT m FROM {_S} a WHERE k <= 50 INTERSECT SELECT m FROM {_S} b WHERE k > 50", None),
    "sdiff": ("lineitem", f"SELECT m FROM {_S} a WHERE k <= 10 EXCEPT SELECT m FROM {_S} b WHERE k > 80", None),
    "sunionstore": ("lineitem", f"SELECT 'dest' AS k, m FROM (SELECT m FROM {_S} a WHERE k = 1 UNION SELECT m FROM {_S} b WHERE k = 3) u", None),
    "sinterstore": ("lineitem", f"SELECT 'dest' AS k, m FROM (SELECT m FROM {_S} a WHERE k <= 20 INTERSECT SELECT m FROM {_S} b WHERE k > 80) u", None),
    "smembers": ("lineitem", f"SELECT k, m FROM {_S} a", None),
    "sismember": ("lineitem supplier", f"SELECT s_suppkey AS k, CASE WHEN m IS NULL THEN 0 ELSE 1 END AS found FROM supplier LEFT JOIN (SELECT k, m FROM {_S} b WHERE m = 10) a ON k = s_suppkey", None),
    "smismember": ("lineitem supplier part", f"SELECT s_suppkey AS k, p_partkey AS q, CASE WHEN m IS NULL THEN 0 ELSE 1 END AS found FROM supplier CROSS JOIN (SELECT p_partkey FROM part WHERE p_partkey <= 3) p LEFT JOIN {_S} a ON k = s_suppkey AND m = p_partkey", None),
    "scard": ("lineitem", f"SELECT k, COUNT(*) AS n FROM {_S} a GROUP BY k", None),
    "sadd": ("lineitem", f"SELECT k, COUNT(*) AS n FROM (SELECT k, m FROM {_S} a UNION SELECT DISTINCT l_suppkey AS k, 0 AS m FROM lineitem) u GROUP BY k", None),
    "srem": ("lineitem", f"SELECT k, m FROM {_S} a WHERE m % 2 = 1", None),
    "lpush": ("events", f"SELECT k, i + 2 AS i, e FROM {_L} UNION ALL SELECT DISTINCT user_id AS k, CAST(0 AS BIGINT) AS i, 'b' AS e FROM events UNION ALL SELECT DISTINCT user_id AS k, CAST(1 AS BIGINT) AS i, 'a' AS e FROM events", None),
    "rpush": ("events", f"SELECT k, i, e FROM {_L} UNION ALL SELECT user_id AS k, COUNT(*) AS i, 'z' AS e FROM events GROUP BY user_id", None),
    "lrange": ("events", f"SELECT k, i, e FROM {_L} WHERE i BETWEEN 1 AND n - 3", None),
    "lindex": ("events", f"SELECT k, e FROM {_L} WHERE i = n - 2", None),
    "llen": ("events", "SELECT user_id AS k, COUNT(*) AS n FROM events GROUP BY user_id", None),
    "lset": ("events", f"SELECT k, i, CASE WHEN i = 3 THEN 'set' ELSE e END AS e FROM {_L}", None),
    "lrem": ("events", f"SELECT k, i, e FROM (SELECT k, i, e, SUM(CASE WHEN e = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY i) AS c FROM {_L}) t WHERE NOT (e = 'click' AND c <= 2)", None),
    "lpop": ("events", f"SELECT k, i - 1 AS i, e FROM {_L} WHERE i >= 1", None),
    "rpop": ("events", f"SELECT k, i, e FROM {_L} WHERE i < n - 2", None),
    "hset": ("events", f"SELECT k, f, CASE WHEN f = 'click' THEN -1.0 ELSE v END AS v FROM {_H} UNION ALL SELECT DISTINCT user_id AS k, 'new' AS f, 1.0 AS v FROM events", None),
    "hget": ("events", f"SELECT k, v FROM {_H} WHERE f = 'click'", None),
    "hmget": ("events", f"SELECT k, f, v FROM {_H} WHERE f IN ('click', 'view', 'none')", None),
    "hgetall": ("events", f"SELECT k, f, v FROM {_H}", None),
    "hdel": ("events", f"SELECT k, f, v FROM {_H} WHERE f <> 'click'", None),
    "hexists": ("events", f"SELECT k, MAX(CASE WHEN f = 'click' THEN 1 ELSE 0 END) AS found FROM {_H} GROUP BY k", None),
    "hlen": ("events", f"SELECT k, COUNT(*) AS n FROM {_H} GROUP BY k", None),
    "hkeys": ("events", f"SELECT k, f FROM {_H}", None),
    "hvals": ("events", f"SELECT k, v FROM {_H}", None),
    "hincrby": ("events", "SELECT user_id AS k, event_type AS f, SUM(event_id) AS v FROM events GROUP BY user_id, event_type", "SELECT user_id AS k, event_type AS f, CAST(SUM(event_id) AS BIGINT) AS v FROM events GROUP BY user_id, event_type"),
    "hincrbyfloat": ("events", "SELECT user_id AS k, event_type AS f, ROUND(SUM(value), 3) AS v FROM events GROUP BY user_id, event_type", None),
    "get": ("customer", *_both("SELECT k, v FROM @K WHERE k = 'user:10' AND t = 'string'")),
    "mget": ("customer", *_both("SELECT q.x AS k, s.v FROM (SELECT 'user:10' AS x UNION ALL SELECT 'user:20' UNION ALL SELECT 'nobody') q LEFT JOIN @K ON q.x = s.k")),
    "incrby_replay": ("events", "SELECT user_id AS k, SUM(CASE WHEN event_id % 3 = 0 THEN -1 ELSE event_id % 5 END) AS v FROM events GROUP BY user_id", "SELECT user_id AS k, CAST(SUM(CASE WHEN event_id % 3 = 0 THEN -1 ELSE event_id % 5 END) AS BIGINT) AS v FROM events GROUP BY user_id"),
    "incrbyfloat": ("events", "SELECT user_id AS k, ROUND(SUM(value), 3) AS v FROM events GROUP BY user_id", None),
    "append": ("customer", *_both("SELECT k, concat(v, '!') AS v, CAST(length(v) + 1 AS BIGINT) AS n FROM @K")),
    "strlen": ("documents", "SELECT doc_id, CAST(octet_length(text) AS BIGINT) AS n FROM documents", "SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS n FROM documents"),
    "getrange": ("documents", "SELECT doc_id, substring(text, 3, 8) AS head, right(text, 4) AS tail FROM documents", None),
    "keys_glob": ("customer", _KEYS.format(k=_KS, test="RLIKE '" + glob_regex(_GLOB).replace("\\", "\\\\") + "'"), _KEYS.format(k=_KD, test=f"GLOB '{_GLOB}'")),
    "scan_page": ("customer", *_both("SELECT k FROM @K ORDER BY k LIMIT 10 OFFSET 20")),
    "type_of": ("customer", *_both("SELECT k, t FROM @K")),
    "exists": ("customer", *_both("SELECT COUNT(*) AS n FROM @K JOIN (SELECT 'user:1' AS x UNION ALL SELECT 'user:1' UNION ALL SELECT 'none') q ON q.x = s.k")),
    "expire_filter": ("customer", *_both("SELECT k, v FROM @K WHERE left_s IS NULL OR left_s > 0")),
    "del_keys": ("customer", *_both("SELECT k FROM @K WHERE k NOT IN ('user:1', 'user:2')")),
    "dbsize": ("customer", *_both("SELECT db, COUNT(*) AS n FROM @K WHERE left_s IS NULL OR left_s > 0 GROUP BY db")),
    "flushdb": ("customer", *_both("SELECT k FROM @K WHERE db <> 0")),
    "select_db": ("customer", *_both("SELECT k, v FROM @K WHERE db = 1")),
    "object_encoding": ("customer", *_both("SELECT k, CASE t WHEN 'string' THEN 'raw' WHEN 'list' THEN 'linkedlist' WHEN 'zset' THEN 'skiplist' ELSE 'hashtable' END AS enc FROM @K")),
    "publish_counts": ("events customer", "SELECT channel, messages, receivers FROM (SELECT event_type AS channel, COUNT(*) AS messages FROM events GROUP BY event_type) e JOIN (SELECT c_custkey % 5 AS r, COUNT(DISTINCT c_custkey) AS receivers FROM customer GROUP BY c_custkey % 5) c ON r = length(channel) % 5", "SELECT event_type AS channel, COUNT(DISTINCT event_id) AS messages, COUNT(DISTINCT c_custkey) AS receivers FROM events JOIN customer ON c_custkey % 5 = length(event_type) % 5 GROUP BY event_type"),
    "spop": ("lineitem", f"SELECT k, m FROM (SELECT k, m, row_number() OVER (PARTITION BY k ORDER BY md5(CAST(m AS STRING)), m) AS x FROM {_S} a) t WHERE x <= 3", f"SELECT k, m FROM (SELECT k, m, row_number() OVER (PARTITION BY k ORDER BY md5(CAST(m AS VARCHAR)), m) AS x FROM {_S} a) t WHERE x <= 3"),
    "numsub": ("events", "SELECT event_type AS channel, COUNT(DISTINCT user_id) AS n FROM events GROUP BY event_type", None),
    "compact": ("events", "SELECT user_id AS k, max_by(value, struct(ts, event_id)) AS v, COUNT(*) AS versions FROM events GROUP BY user_id", "SELECT k, v, versions FROM (SELECT user_id AS k, value AS v, COUNT(*) OVER (PARTITION BY user_id) AS versions, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) t WHERE r = 1"),
}
