"""Logs of key-value commands over the tables, run as they are, with equivalent SQL for their replies or for the state that they leave."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.keyspace import execute


def _log(spark: SparkSession, sf_dir: str, table: str, commands: list[tuple[str, str, str]], where: str = "TRUE") -> DataFrame:
    """Rows (seq, at, op, args): of each row of a table its commands (op, seconds, arguments as SQL), all of the first command before those of the second."""
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    part = "SELECT {k} * CAST(100000000 AS BIGINT) + n AS seq, CAST({at} * 1000000 AS BIGINT) AS at, '{op}' AS op, array({args}) AS args FROM t"
    order = {"customer": "c_custkey", "events": "event_id", "nation": "n_nationkey"}[table]
    sql = " UNION ALL ".join(part.format(k=k, at=at, op=op, args=args) for k, (op, at, args) in enumerate(commands))
    return spark.sql(f"WITH t AS (SELECT *, CAST({order} AS BIGINT) AS n, CAST({order} AS STRING) AS id FROM {{rows}} WHERE {where}) {sql}", rows=rows)


_KEY = "concat('user:', id)"


def _sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    log = _log(spark, sf_dir, "customer", [("SET", "0", f"{_KEY}, c_name, 'EX', '50'"), ("SET", "1", f"{_KEY}, 'kept', 'NX', 'GET'"), ("SET", "2", "concat(if(n % 2 = 0, 'user:', 'none:'), id), 'new', 'XX', 'PX', '9500'"), ("SET", "3", "concat(if(n % 3 = 0, 'user:', 'more:'), id), 'first', 'NX'")])
    return execute(log)


def set_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State after SET with EX, NX and GET, XX and PX."""
    return _sets(spark, sf_dir)[1]


def set_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sets(spark, sf_dir)[0]


def deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of EXPIRE, PEXPIRE, EXPIREAT, PERSIST and TTL, before and after deadlines."""
    log = _log(spark, sf_dir, "customer", [("SET", "0", f"{_KEY}, 'x'"), ("EXPIRE", "1", f"{_KEY}, CAST(n % 10 + 1 AS STRING)"), ("PERSIST", "2", "concat(if(n % 4 = 0, 'user:', 'none:'), id)"), ("TTL", "2.5", _KEY), ("PEXPIRE", "3", "concat(if(n % 10 > 4, 'user:', 'none:'), id), '4500'"), ("PTTL", "4", _KEY), ("EXPIREAT", "5", f"{_KEY}, '9'"), ("TTL", "6", _KEY), ("GET", "9", _KEY)])
    return execute(log)[0]


def renamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State after RENAME of one key a nation, deadlines included, between writes of all keys."""
    log = _log(spark, sf_dir, "nation", [("SET", "0", "concat('n:', id), n_name, 'EX', '100'"), ("RENAME", "1", "concat('n:', id), concat('m:', CAST(n % 20 AS STRING))"), ("APPEND", "2", "concat('m:', id), '!'")])
    return execute(log)[1]


def got_and_gone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State after GETSET and GETDEL."""
    log = _log(spark, sf_dir, "customer", [("SET", "0", f"{_KEY}, c_name, 'EX', '9'"), ("GETSET", "1", "concat('user:', CAST(n - n % 2 AS STRING)), concat('by ', id)"), ("GETDEL", "2", "concat('user:', CAST(n * 5 AS STRING))")])
    return execute(log)[1]


def list_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of LRANGE after RPUSH of all events, LREM from the head, the tail and everywhere, and LPOP."""
    user = "concat('l:', CAST(user_id AS STRING))"
    log = _log(spark, sf_dir, "events", [("RPUSH", "0", f"{user}, concat(event_type, if(n % 3 = 0, '', CAST(n AS STRING)))")])
    ends = [("LREM", "1", "u, '2', 'click'"), ("LREM", "2", "u, '-1', 'click'"), ("LREM", "3", "u, '0', 'view'"), ("LPOP", "4", "u, '3'"), ("LRANGE", "5", "u, '-7', '-2'")]
    users = spark.sql("SELECT DISTINCT CAST(user_id AS BIGINT) AS n, concat('l:', CAST(user_id AS STRING)) AS u FROM {e}", e=spark.read.parquet(f"{sf_dir}/events.parquet"))
    part = "SELECT {k} * CAST(100000000 AS BIGINT) + n AS seq, CAST({at} AS BIGINT) AS at, '{op}' AS op, array({args}) AS args FROM {{users}}"
    for k, (op, at, args) in enumerate(ends, 10):
        log = log.unionByName(spark.sql(part.format(k=k, at=at, op=op, args=args), users=users))
    return execute(log)[0].where("seq >= 1400000000")


def zadd_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of ZADD with GT and CH, with INCR, and of ranges by score with REV and LIMIT and by rank."""
    key, member = "concat('z:', CAST(user_id % 5 AS STRING))", "concat('m', CAST(user_id AS STRING))"
    log = _log(spark, sf_dir, "events", [("ZADD", "0", f"{key}, 'GT', 'CH', CAST(CAST(floor(value) AS BIGINT) AS STRING), {member}")])
    more = _log(spark, sf_dir, "nation", [("ZRANGE", "1", "concat('z:', id), '50', '(10', 'BYSCORE', 'REV', 'LIMIT', '1', '3', 'WITHSCORES'"), ("ZADD", "2", "concat('z:', id), 'INCR', '1.5', 'm7'"), ("ZREVRANGE", "3", "concat('z:', id), '0', '1'"), ("ZCOUNT", "4", "concat('z:', id), '-inf', '(20'"), ("ZADD", "5", "concat('z:', id), 'XX', 'INCR', '1', 'nobody'")], "n_nationkey < 5")
    more = more.selectExpr("seq + CAST(1000000000 AS BIGINT) AS seq", "at", "op", "args")
    return execute(log.unionByName(more))[0]


def set_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of SUNIONSTORE, SINTERSTORE, SDIFF and SCARD on sets of the customers of a nation."""
    log = _log(spark, sf_dir, "customer", [("SADD", "0", "concat('s:', CAST(c_nationkey AS STRING)), CAST(n % 7 AS STRING)")])
    more = _log(spark, sf_dir, "nation", [("SUNIONSTORE", "1", "'to', 's:0', concat('s:', id)"), ("SINTERSTORE", "2", "'both', 'to', 's:1'"), ("SDIFF", "3", "concat('s:', id), 's:2'"), ("SCARD", "4", "'both'")], "n_nationkey < 4")
    return execute(log.unionByName(more.selectExpr("seq + CAST(1000000000 AS BIGINT) AS seq", "at", "op", "args")))[0].where("seq >= 1000000000")


def text_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of APPEND, STRLEN, GETRANGE, INCRBY, INCRBYFLOAT and a command of another type."""
    log = _log(spark, sf_dir, "customer", [("APPEND", "0", f"{_KEY}, c_name"), ("APPEND", "1", f"{_KEY}, 'é'"), ("STRLEN", "2", _KEY), ("GETRANGE", "3", f"{_KEY}, '-4', '-1'"), ("INCRBY", "4", "concat('n:', CAST(n % 9 AS STRING)), id"), ("INCRBYFLOAT", "5", "concat('f:', id), '10.5'"), ("INCRBYFLOAT", "6", "concat('f:', id), '-0.25'"), ("LPUSH", "7", f"{_KEY}, 'x'"), ("INCR", "8", _KEY)])
    return execute(log)[0]


def many_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of MSET, MGET, EXISTS, DEL, DBSIZE and FLUSHDB."""
    both = "concat('b:', CAST(n DIV 2 AS STRING))"
    log = _log(spark, sf_dir, "customer", [("MSET", "0", f"{_KEY}, id, {both}, c_name"), ("MGET", "1", f"{_KEY}, 'none', {_KEY}"), ("EXISTS", "2", f"{_KEY}, {_KEY}, {both}, 'none'"), ("DEL", "3", f"{_KEY}, {both}, 'none'")])
    ends = _log(spark, sf_dir, "nation", [("DBSIZE", "4", ""), ("SET", "5", "id, id"), ("DBSIZE", "6", ""), ("FLUSHDB", "7", ""), ("DBSIZE", "8", "")], "n_nationkey = 3")
    return execute(log.unionByName(ends.selectExpr("seq + CAST(1000000000 AS BIGINT) AS seq", "at", "op", "IF(size(args) = 0, CAST(array() AS array<string>), args) AS args")))[0]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "set_flags": set_options,
    "setnx": set_replies,
    "ttl_left": deadlines,
    "rename": renamed,
    "getdel": got_and_gone,
    "list_commands": list_commands,
    "zadd_flags": zadd_flags,
    "set_stores": set_stores,
    "text_commands": text_commands,
    "mset": many_keys,
}

_C = "c AS (SELECT CAST(c_custkey AS BIGINT) AS n, CAST(c_custkey AS VARCHAR) AS id, c_name, c_nationkey FROM customer)"
_STATE = "CAST(NULL AS BIGINT)"
ORACLE_SQL = {
    "set_flags": f"""WITH {_C} SELECT 'user:' || id AS key, 'string' AS type, CASE WHEN n % 2 = 0 THEN '"new"' ELSE '"' || c_name || '"' END AS value, CAST(CASE WHEN n % 2 = 0 THEN 11500000 ELSE 50000000 END AS BIGINT) AS deadline FROM c
        UNION ALL SELECT 'more:' || id, 'string', '"first"', {_STATE} FROM c WHERE n % 3 <> 0""",
    "setnx": f"""WITH {_C} SELECT n AS seq, '"OK"' AS reply FROM c UNION ALL SELECT 100000000 + n, '"' || c_name || '"' FROM c
        UNION ALL SELECT 200000000 + n, CASE WHEN n % 2 = 0 THEN '"OK"' ELSE 'null' END FROM c UNION ALL SELECT 300000000 + n, CASE WHEN n % 3 = 0 THEN 'null' ELSE '"OK"' END FROM c""",
    "ttl_left": f"""WITH {_C}, d AS (SELECT n, 1 + n % 10 + 1 AS due, n % 4 = 0 AS free, n % 10 > 4 AS again FROM c),
        e AS (SELECT n, due, free, again, CASE WHEN free AND due > 2 THEN NULL ELSE due END AS due1 FROM d),
        f AS (SELECT *, due1 IS NOT NULL AND due1 <= 3 AS dead3 FROM e),
        g AS (SELECT *, CASE WHEN again AND NOT dead3 THEN 7.5 ELSE due1 END AS due2 FROM f),
        h AS (SELECT *, dead3 OR (due2 IS NOT NULL AND due2 <= 5) AS dead5 FROM g)
        SELECT n AS seq, '"OK"' AS reply FROM h UNION ALL SELECT 100000000 + n, '1' FROM h
        UNION ALL SELECT 200000000 + n, CASE WHEN free AND due > 2 THEN '1' ELSE '0' END FROM h
        UNION ALL SELECT 300000000 + n, CASE WHEN free AND due > 2 THEN '-1' WHEN due <= 2.5 THEN '-2' ELSE CAST(CAST(floor(due - 2.5) AS BIGINT) AS VARCHAR) END FROM h
        UNION ALL SELECT 400000000 + n, CASE WHEN again AND NOT dead3 THEN '1' ELSE '0' END FROM h
        UNION ALL SELECT 500000000 + n, CASE WHEN due2 IS NULL THEN '-1' WHEN due2 <= 4 THEN '-2' ELSE CAST(CAST(floor((due2 - 4) * 1000) AS BIGINT) AS VARCHAR) END FROM h
        UNION ALL SELECT 600000000 + n, CASE WHEN dead5 THEN '0' ELSE '1' END FROM h
        UNION ALL SELECT 700000000 + n, CASE WHEN dead5 THEN '-2' ELSE '3' END FROM h UNION ALL SELECT 800000000 + n, 'null' FROM h""",
    "rename": """WITH m AS (SELECT n_nationkey % 20 AS k, arg_max(n_name, n_nationkey) AS v FROM nation GROUP BY 1), a AS (SELECT n_nationkey AS k FROM nation)
        SELECT 'm:' || CAST(a.k AS VARCHAR) AS key, 'string' AS type, '"' || coalesce(v, '') || '!"' AS value, CASE WHEN v IS NULL THEN NULL ELSE CAST(100000000 AS BIGINT) END AS deadline FROM a LEFT JOIN m ON a.k = m.k""",
    "getdel": f"""WITH {_C}, s AS (SELECT n - n % 2 AS k, max(n) AS by_n FROM c GROUP BY 1), a AS (SELECT n AS k FROM c UNION SELECT k FROM s)
        SELECT 'user:' || CAST(a.k AS VARCHAR) AS key, 'string' AS type, '"' || CASE WHEN by_n IS NOT NULL THEN 'by ' || CAST(by_n AS VARCHAR) ELSE c_name END || '"' AS value, CASE WHEN by_n IS NULL THEN CAST(9000000 AS BIGINT) END AS deadline
        FROM a LEFT JOIN s ON a.k = s.k LEFT JOIN c ON c.n = a.k WHERE NOT EXISTS (SELECT 1 FROM c x WHERE x.n * 5 = a.k)""",
    "list_commands": """WITH l AS (SELECT user_id AS u, event_id AS i, event_type || CASE WHEN event_id % 3 = 0 THEN '' ELSE CAST(event_id AS VARCHAR) END AS e FROM events),
        a AS (SELECT u, i, e FROM l QUALIFY NOT (e = 'click' AND sum(CASE WHEN e = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY u ORDER BY i) <= 2)),
        b AS (SELECT u, i, e FROM a QUALIFY NOT (e = 'click' AND sum(CASE WHEN e = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY u ORDER BY i DESC) <= 1)),
        d AS (SELECT u, i, e, row_number() OVER (PARTITION BY u ORDER BY i) AS r, row_number() OVER (PARTITION BY u ORDER BY i DESC) AS back FROM b WHERE e <> 'view'),
        o AS (SELECT u, string_agg('"' || e || '"', ',' ORDER BY i) AS s FROM d WHERE r > 3 AND back BETWEEN 2 AND 7 GROUP BY u)
        SELECT 1400000000 + t.u AS seq, '[' || coalesce(s, '') || ']' AS reply FROM (SELECT DISTINCT CAST(user_id AS BIGINT) AS u FROM events) t LEFT JOIN o ON o.u = t.u""",
    "zadd_flags": """WITH v AS (SELECT user_id % 5 AS z, 'm' || CAST(user_id AS VARCHAR) AS m, CAST(floor(value) AS BIGINT) AS s, CAST(event_id AS BIGINT) AS i FROM events),
        w AS (SELECT *, max(s) OVER (PARTITION BY z, m ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM v), x AS (SELECT z, m, max(s) AS s FROM v GROUP BY 1, 2),
        k AS (SELECT CAST(n_nationkey AS BIGINT) AS z FROM nation WHERE n_nationkey < 5),
        p AS (SELECT z, m, s, row_number() OVER (PARTITION BY z ORDER BY s DESC, m DESC) AS r FROM x WHERE s <= 50 AND s > 10),
        y AS (SELECT k.z, u.m, CAST(coalesce(max(x.s) FILTER (WHERE x.m = u.m), 0) AS DOUBLE) + CASE WHEN u.m = 'm7' THEN 1.5 ELSE 0 END AS s FROM k JOIN (SELECT DISTINCT z, m FROM x UNION SELECT z, 'm7' FROM k) u ON u.z = k.z LEFT JOIN x ON x.z = u.z AND x.m = u.m GROUP BY 1, 2),
        q AS (SELECT z, m, s, row_number() OVER (PARTITION BY z ORDER BY s DESC, m DESC) AS r FROM y)
        SELECT i AS seq, CASE WHEN best IS NULL OR s > best THEN '1' ELSE '0' END AS reply FROM w
        UNION ALL SELECT 1000000000 + k.z, '[' || coalesce(string_agg('"' || m || '","' || CAST(s AS VARCHAR) || '"', ',' ORDER BY r), '') || ']' FROM k LEFT JOIN p ON p.z = k.z AND r BETWEEN 2 AND 4 GROUP BY k.z
        UNION ALL SELECT 1100000000 + z, '"' || CASE WHEN s = floor(s) THEN CAST(CAST(s AS BIGINT) AS VARCHAR) ELSE CAST(s AS VARCHAR) END || '"' FROM y WHERE m = 'm7'
        UNION ALL SELECT 1200000000 + z, '[' || string_agg('"' || m || '"', ',' ORDER BY r) || ']' FROM q WHERE r <= 2 GROUP BY z
        UNION ALL SELECT 1300000000 + z, CAST(count(*) FILTER (WHERE s < 20) AS VARCHAR) FROM y GROUP BY z
        UNION ALL SELECT 1400000000 + z, 'null' FROM k""",
    "set_stores": f"""WITH {_C}, s AS (SELECT DISTINCT c_nationkey AS k, CAST(n % 7 AS VARCHAR) AS m FROM c), k AS (SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation WHERE n_nationkey < 4)
        SELECT 1000000000 + k.k AS seq, CAST(count(DISTINCT m) AS VARCHAR) AS reply FROM k JOIN s ON s.k IN (0, k.k) GROUP BY k.k
        UNION ALL SELECT 1100000000 + k.k, CAST((SELECT count(*) FROM (SELECT m FROM s WHERE k IN (0, 3) INTERSECT SELECT m FROM s WHERE k = 1) i) AS VARCHAR) FROM k
        UNION ALL SELECT 1200000000 + k.k, '[' || coalesce(string_agg('"' || m || '"', ',' ORDER BY m), '') || ']' FROM k LEFT JOIN s ON s.k = k.k AND m NOT IN (SELECT m FROM s t WHERE t.k = 2) GROUP BY k.k
        UNION ALL SELECT 1300000000 + k.k, CAST((SELECT count(*) FROM (SELECT m FROM s WHERE k IN (0, 3) INTERSECT SELECT m FROM s WHERE k = 1) i) AS VARCHAR) FROM k""",
    "text_commands": f"""WITH {_C} SELECT n AS seq, CAST(length(c_name) AS VARCHAR) AS reply FROM c UNION ALL SELECT 100000000 + n, CAST(length(c_name) + 2 AS VARCHAR) FROM c
        UNION ALL SELECT 200000000 + n, CAST(length(c_name) + 2 AS VARCHAR) FROM c UNION ALL SELECT 300000000 + n, '"' || right(c_name, 3) || 'é"' FROM c
        UNION ALL SELECT 400000000 + n, CAST(CAST(sum(n) OVER (PARTITION BY n % 9 ORDER BY n) AS BIGINT) AS VARCHAR) FROM c
        UNION ALL SELECT 500000000 + n, '"10.5"' FROM c UNION ALL SELECT 600000000 + n, '"10.25"' FROM c
        UNION ALL SELECT 700000000 + n, '{{"error":"WRONGTYPE Operation against a key holding the wrong kind of value"}}' FROM c
        UNION ALL SELECT 800000000 + n, '{{"error":"ERR value is not an integer or out of range"}}' FROM c""",
    "mset": f"""WITH {_C}, b AS (SELECT n // 2 AS k, min(n) AS first FROM c GROUP BY 1) SELECT n AS seq, '"OK"' AS reply FROM c
        UNION ALL SELECT 100000000 + n, '["' || id || '",null,"' || id || '"]' FROM c UNION ALL SELECT 200000000 + n, '3' FROM c
        UNION ALL SELECT 300000000 + n, CASE WHEN first = n THEN '2' ELSE '1' END FROM c JOIN b ON n // 2 = k
        UNION ALL SELECT * FROM (VALUES (1000000003, '0'), (1100000003, '"OK"'), (1200000003, '1'), (1300000003, '"OK"'), (1400000003, '0')) v""",
}
