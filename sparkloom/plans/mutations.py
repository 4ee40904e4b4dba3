"""Queries through the SQL and wide-column front ends on version tables, and log replay, with equivalent SQL for the final state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.cql import Keyspaces
from ..operators.replay import replay
from ..operators.sql import Database

_COLUMNS = "c_custkey INT PRIMARY KEY, c_name TEXT, c_nationkey INT, c_acctbal DOUBLE"
_ALL = "SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customers"


def _customers(spark: SparkSession, sf_dir: str) -> Database:
    db = Database(spark)
    db.execute(f"CREATE TABLE customers ({_COLUMNS})")
    db._own.session.read.parquet(f"{sf_dir}/customer.parquet").createOrReplaceTempView("customer")
    db.execute("INSERT INTO customers SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer")
    return db


def insert_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _customers(spark, sf_dir)
    db.execute("INSERT INTO customers (c_custkey, c_name, c_acctbal) VALUES (-1, 'it''s', 1.5), (-2, UPPER('x'), 2 * 3)")
    return db.execute(_ALL)


def update_expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _customers(spark, sf_dir)
    db.execute("UPDATE customers SET c_acctbal = c_acctbal + c_nationkey, c_nationkey = NULL WHERE c_nationkey < 5 AND c_acctbal > 0")
    return db.execute("SELECT c_custkey, c_nationkey, ROUND(c_acctbal, 2) AS c_acctbal FROM customers")


def delete_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _customers(spark, sf_dir)
    db.execute("DELETE FROM customers WHERE c_acctbal < 1000 OR c_nationkey IN (2, 4)")
    return db.execute(_ALL)


def rollback_invisible(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _customers(spark, sf_dir)
    for s in ("BEGIN", "DELETE FROM customers WHERE c_nationkey > 3", "INSERT INTO customers (c_custkey) VALUES (-9)", "ROLLBACK"):
        db.execute(s)
    return db.execute(_ALL)


def own_writes_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _customers(spark, sf_dir)
    mine, other = db.connect(), db.connect()
    for s in ("BEGIN", "DELETE FROM customers WHERE c_nationkey > 3", "UPDATE customers SET c_name = 'mine' WHERE c_nationkey = 1"):
        mine.execute(s)
    count = "SELECT '{}' AS reader, c_name = 'mine' AS changed, COUNT(*) AS n FROM customers GROUP BY c_name = 'mine'"
    return mine.execute(count.format("mine")).unionAll(other.execute(count.format("other")))


def index_then_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one session inserts while another, in a transaction, makes an index and drops it again, stays."""
    db = _customers(spark, sf_dir)
    mine, other = db.connect(), db.connect()
    mine.execute("BEGIN")
    mine.execute("CREATE INDEX by_nation ON customers (c_nationkey)")
    other.execute("INSERT INTO customers SELECT -c_custkey, c_name, c_nationkey, c_acctbal FROM customers WHERE c_custkey % 3 = 0")
    mine.execute("COMMIT")
    mine.execute("DROP INDEX by_nation")
    return db.execute(_ALL)


def catalog_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = Keyspaces(spark)
    for s in ("CREATE KEYSPACE tides WITH replication = {'class': 'NetworkTopologyStrategy', 'replication_factor': 2}", "USE tides", "CREATE TABLE levels (harbour TEXT, month INT, moment TIMESTAMP, metres DOUBLE, datum TEXT STATIC, PRIMARY KEY ((harbour, month), moment))"):
        k.execute(s)
    return k.execute("DESCRIBE TABLE levels")


def upsert_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last values of events, rewritten by CQL: a row replaced, a column updated, a partition's rows deleted."""
    k = Keyspaces(spark)
    for s in ("CREATE KEYSPACE k", "USE k", "CREATE TABLE e (user_id BIGINT, event_id BIGINT, event_type TEXT, value DOUBLE, PRIMARY KEY ((user_id), event_id))"):
        k.execute(s)
    k.write("e", k.spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "event_type", "value"))
    for s in ("DELETE FROM e WHERE user_id = 3", "UPDATE e SET value = -1 WHERE user_id = 5", "INSERT INTO e (user_id, event_id, value) VALUES (3, 1, 0.5)"):
        k.execute(s)
    return k.execute("SELECT user_id, event_id, event_type, value FROM e")


_LOG = """SELECT event_id AS seq, CASE WHEN event_id % 41 = 0 THEN 'DEL' WHEN event_id % 7 = 0 THEN 'HDEL' ELSE 'HSET' END AS op,
    concat('user:', CAST(user_id AS {s})) AS key, event_type AS field, CAST(CAST(FLOOR(value) AS BIGINT) AS {s}) AS value FROM events
    UNION ALL SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 'SET' ELSE 'INCRBY' END, concat('n:', event_type), '', CAST(event_id % 9 AS {s}) FROM events"""


def aof_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return replay(spark.sql(_LOG.format(s="STRING").replace("FROM events", "FROM {events}"), events=events))


_AOF = f"""WITH log AS ({_LOG.format(s="VARCHAR")}), h AS (SELECT * FROM log WHERE key LIKE 'user:%'), n AS (SELECT * FROM log WHERE key LIKE 'n:%'),
    cut AS (SELECT key, MAX(seq) AS ended FROM h WHERE op = 'DEL' GROUP BY key), base AS (SELECT key, MAX(seq) AS ended, arg_max(value, seq) AS v FROM n WHERE op = 'SET' GROUP BY key)
    SELECT key, 'hash' AS type, field, value FROM (SELECT h.* FROM h LEFT JOIN cut USING (key) WHERE ended IS NULL OR seq > ended QUALIFY row_number() OVER (PARTITION BY key, field ORDER BY seq DESC) = 1) l WHERE op = 'HSET'
    UNION ALL SELECT key, 'string', '', CAST(SUM(CASE WHEN op = 'INCRBY' AND (ended IS NULL OR seq > ended) THEN CAST(value AS BIGINT) ELSE 0 END) + COALESCE(MAX(CAST(v AS BIGINT)), 0) AS VARCHAR) FROM n LEFT JOIN base USING (key) GROUP BY key"""

QUERIES = {f.__name__: f for f in (insert_values, update_expr, delete_where, rollback_invisible, own_writes_visible, index_then_insert, catalog_describe, upsert_partition, aof_replay)}
_C = "SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer"
ORACLE_SQL = {
    "insert_values": f"{_C} UNION ALL SELECT -1, 'it''s', NULL, 1.5 UNION ALL SELECT -2, 'X', NULL, 6.0",
    "update_expr": "SELECT c_custkey, CASE WHEN c_nationkey < 5 AND c_acctbal > 0 THEN NULL ELSE c_nationkey END AS c_nationkey, ROUND(CASE WHEN c_nationkey < 5 AND c_acctbal > 0 THEN c_acctbal + c_nationkey ELSE c_acctbal END, 2) AS c_acctbal FROM customer",
    "delete_where": f"{_C} WHERE NOT (c_acctbal < 1000 OR c_nationkey IN (2, 4))",
    "rollback_invisible": _C,
    "own_writes_visible": "SELECT 'mine' AS reader, c_nationkey = 1 AS changed, COUNT(*) AS n FROM customer WHERE c_nationkey <= 3 GROUP BY c_nationkey = 1 UNION ALL SELECT 'other', FALSE, COUNT(*) FROM customer",
    "index_then_insert": f"{_C} UNION ALL SELECT -c_custkey, c_name, c_nationkey, c_acctbal FROM customer WHERE c_custkey % 3 = 0",
    "catalog_describe": "SELECT * FROM (VALUES ('harbour', 'string', 'partition', FALSE), ('month', 'bigint', 'partition', FALSE), ('moment', 'timestamp_ntz', 'clustering', FALSE), ('metres', 'double', 'regular', FALSE), ('datum', 'string', 'regular', TRUE)) v(col, type, role, static)",
    "upsert_partition": "SELECT user_id, event_id, event_type, CASE WHEN user_id = 5 THEN -1.0 ELSE value END AS value FROM events WHERE user_id <> 3 UNION ALL SELECT 3, 1, NULL, 0.5",
    "aof_replay": _AOF,
}
