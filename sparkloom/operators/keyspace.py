"""Key-value commands over tables: a whole log at once, or one command at a time on a store.

A log has rows (seq, at, op, args): commands in order of seq, at a time in microseconds. Commands on one key are folded
in that key's order, all keys at once: one shuffle by key, then a streaming pass in which a key's log is never held,
only its value. Commands on several keys that do not depend on each other (MSET, MGET, DEL, EXISTS) are dealt to their
keys and their replies put together; those that do (RENAME, set operations) and those on all keys divide the log, and
their keys alone come to the driver. State has rows (key, type, value, deadline), a value as JSON; a value that is too
large for a row belongs in the row form of `replay`.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import glob_regex
from ..sources.storage import materialize, scope
from ..sources.versions import Store
from . import commands as C

LOG = "seq bigint, at bigint, op string, args array<string>"
STATE = "key string, type string, value string, deadline bigint"
REPLIES = "seq bigint, reply string"
_FOLDED = f"{STATE}, seq bigint, part int, op string, reply string"
DEALT = ("MSET", "MGET", "DEL", "EXISTS")
LINKED = ("RENAME", "SUNION", "SINTER", "SDIFF", "SUNIONSTORE", "SINTERSTORE")
WHOLE = ("DBSIZE", "FLUSHDB", "FLUSHALL")
DIVIDERS = 10_000  # of these in a log, at most: each is a step of the driver


def shown(reply) -> str:
    """A reply as JSON; a failure is an object."""
    return json.dumps({"error": str(reply)} if isinstance(reply, C.Failure) else reply, ensure_ascii=False, separators=(",", ":"))


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by key, each key's state first and then its commands in order: replies, and the state that is left."""
    names = [c.split()[0] for c in _FOLDED.split(", ")]
    types = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string())
    out: list[tuple] = []
    space, now = C.Space(), None

    def left() -> None:
        for key, e in space.items():
            if e.deadline is None or e.deadline > space.now:
                out.append((key, e.kind, e.dump(), e.deadline, None, None, None, None))
        space.clear()

    def batch() -> pa.RecordBatch:
        cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
        out.clear()
        return pa.RecordBatch.from_arrays(cols, names=names)

    for rows in batches:
        for r in rows.to_pylist():
            if r["key"] != now:
                left()
                now, space.now = r["key"], -(1 << 62)
            if r["seq"] is None:
                space[now] = C.Entry.load(r["type"], r["value"], r["deadline"])
            else:
                space.now = max(space.now, r["at"] or 0)
                out.append((now, None, None, None, r["seq"], r["part"], r["op"], shown(C.run(space, r["op"], r["args"]))))
            if len(out) >= 2000:
                yield batch()
    left()
    if out:
        yield batch()


def _dealt(log: DataFrame) -> DataFrame:
    """seq, part, at, op, key and args of each command for each key."""
    rows = log.select("seq", "at", F.upper("op").alias("op"), F.coalesce("args", F.expr("cast(array() as array<string>)")).alias("args"))
    single = F.array(F.struct(F.lit(0).alias("part"), F.when(F.col("op") == "OBJECT", F.get("args", F.lit(1))).otherwise(F.get("args", F.lit(0))).alias("key"), F.col("args").alias("args")))
    each = F.transform("args", lambda k, i: F.struct(i.alias("part"), k.alias("key"), F.array(k).alias("args")))
    pairs = F.filter(F.transform("args", lambda k, i: F.struct(i.alias("part"), k.alias("key"), F.slice("args", i + 1, 2).alias("args"))), lambda x: x["part"] % 2 == 0)
    several = F.size("args") > 0
    split = F.when((F.col("op") == "MSET") & several & (F.size("args") % 2 == 0), pairs).when(F.col("op").isin("MGET", "DEL", "EXISTS") & several, each).otherwise(single)
    rows = rows.select("seq", "at", "op", F.explode(split).alias("x")).select("seq", "at", "op", "x.*")
    return rows.withColumn("key", F.coalesce("key", F.lit("")))


def _step(state: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """State and replies after commands on single keys."""
    none = lambda kind: F.lit(None).cast(kind)
    old = state.select("key", "type", "value", "deadline", *[none(k).alias(c) for c, k in (("seq", "bigint"), ("part", "int"), ("at", "bigint"), ("op", "string"), ("args", "array<string>"))])
    new = _dealt(log).select("key", none("string").alias("type"), none("string").alias("value"), none("bigint").alias("deadline"), "seq", "part", "at", "op", "args")
    n = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    done = materialize(old.unionByName(new).repartition(n, "key").sortWithinPartitions("key", F.col("seq").asc_nulls_first(), "part").mapInArrow(_fold, _FOLDED), "folded")
    replies = done.filter("seq IS NOT NULL")
    parts = replies.filter(F.col("op").isin(*DEALT)).groupBy("seq").agg(F.max("op").alias("op"), F.sum(F.expr("try_cast(reply AS bigint)")).cast("string").alias("n"), F.array_sort(F.collect_list(F.struct("part", "reply"))).alias("all"))
    # each part of MGET replies a list of one
    inner = F.array_join(F.transform("all", lambda x: F.substring(x["reply"], F.lit(2), F.char_length(x["reply"]) - 2)), ",")
    joined = F.when(F.col("op") == "MGET", F.concat(F.lit("["), inner, F.lit("]"))).when(F.col("op") == "MSET", F.col("all")[0]["reply"]).otherwise(F.coalesce("n", F.col("all")[0]["reply"]))
    whole = parts.select("seq", F.when(F.col("all")[0]["reply"].startswith('{"error"'), F.col("all")[0]["reply"]).otherwise(joined).alias("reply"))
    return done.filter("seq IS NULL").select("key", "type", "value", "deadline"), replies.filter(~F.col("op").isin(*DEALT)).select("seq", "reply").unionByName(whole)


def _entries(rows: DataFrame, keys: list[str]) -> dict[str, C.Entry]:
    return {r.key: C.Entry.load(r.type, r.value, r.deadline) for r in rows.filter(F.col("key").isin(keys)).collect()}


def execute(log: DataFrame, state: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Replies (seq, reply as JSON) and state after a log.

    seq is unique; rows without a seq or op are ignored; null args are none, a null at is time 0; times of a key do not go back. Keys
    whose deadline has passed when their last command comes are not in the state; others may still have one that has passed. Of the
    commands of a server (PING, KEYS and the like) only DBSIZE, FLUSHDB and FLUSHALL can be in a log; others are unknown.
    """
    spark = log.sparkSession
    log = log.filter("seq IS NOT NULL AND op IS NOT NULL").select("seq", "at", "op", "args")
    empty = spark.createDataFrame([], STATE)
    state = empty if state is None else state.select("key", "type", "value", "deadline")
    dividers = log.filter(F.upper("op").isin(*LINKED, *WHOLE)).orderBy("seq").limit(DIVIDERS + 1).collect()
    if len(dividers) > DIVIDERS:
        raise ValueError(f"more than {DIVIDERS} commands on several keys or all: cut the log")
    plain = log.filter(~F.upper("op").isin(*LINKED, *WHOLE))
    cuts = [r.seq for r in dividers]
    if not cuts:
        state, replies = _step(state, plain)
        return replies, state
    between = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(zip([-(1 << 62), *cuts], [*cuts, 1 << 62], strict=True))], "low bigint, high bigint, segment int")
    plain = plain.join(F.broadcast(between), (F.col("seq") > F.col("low")) & (F.col("seq") < F.col("high"))).drop("low", "high")  # at most DIVIDERS + 1 rows
    filled = {r.segment for r in plain.select("segment").distinct().collect()}
    over: dict[str, C.Entry | None] = {}  # what dividers changed since the state was last folded
    told, replies = [], []

    def settled(rows: DataFrame) -> DataFrame:
        if not over:
            return rows
        new = spark.createDataFrame([(k, e.kind, e.dump(), e.deadline) for k, e in over.items() if e], STATE)
        rows = rows.filter(~F.col("key").isin([*over])).unionByName(new)
        over.clear()
        return rows

    for i in range(len(cuts) + 1):
        if i in filled:
            state, got = _step(settled(state), plain.filter(F.col("segment") == i))
            replies.append(got)
        if i == len(cuts):
            break
        r = dividers[i]
        op, args, now = r.op.upper(), r.args or [], r.at or 0
        if op in WHOLE:
            if op == "DBSIZE":
                state = settled(state)
                told.append((r.seq, shown(state.filter(F.col("deadline").isNull() | (F.col("deadline") > now)).count())))
            else:
                over.clear()
                state = empty
                told.append((r.seq, shown(C.OK)))
            continue
        missing = [k for k in args if k not in over]
        space = C.Space(_entries(state, missing) | {k: over[k] for k in args if over.get(k)})
        space.now, before = now, dict(space)
        told.append((r.seq, shown(C.run(space, op, args))))
        over.update({k: space.get(k) for k in args if space.get(k) != before.get(k)})
    state = settled(state)
    out = spark.createDataFrame(told, REPLIES)
    for got in replies:
        out = out.unionByName(got)
    return out, state


class Server:
    """One command at a time on a store: numbered databases, channels, and the server's own commands."""

    def __init__(self, spark: SparkSession, path: str | None = None, clock: Callable[[], float] = time.time):
        self.spark, self.clock, self.db = spark, clock, 0
        self.began = clock()
        self.store = Store(spark, path)
        self.settings = {"appendonly": "yes", "maxmemory": "0", "save": ""}
        self.listeners: dict[str, dict[str, Callable[[str, str], None]]] = {}
        tx = self.store.begin()
        if "kv" not in tx.view()["tables"]:
            tx.create("kv", [("db", "bigint", True), ("key", "string", True), ("type", "string", False), ("value", "string", False), ("deadline", "bigint", False)], key=["db", "key"])
            tx.commit()

    def _now(self) -> int:
        return int(self.clock() * C.SECOND)

    def rows(self, db: int | None = None) -> DataFrame:
        """Live keys of a database (the selected one)."""
        rows = self.store.begin().read("kv").filter(F.col("db") == (self.db if db is None else db))
        return rows.filter(F.col("deadline").isNull() | (F.col("deadline") > self._now())).drop("db")

    def _write(self, rows: DataFrame, dead: bool = False) -> None:
        tx = self.store.begin()
        tx.append("kv", rows.withColumn("_dead", F.lit(dead)), update=True)
        tx.commit()

    def execute(self, *words: str):
        """The reply of a command."""
        if not words:
            return C.ARITY
        op, args = words[0].upper(), list(words[1:])
        own = getattr(self, f"_do_{op.lower()}", None)
        if own:
            try:
                return own(*args)
            except TypeError:
                return C.ARITY
        keys = args[::2] if op == "MSET" else args[1:2] if op == "OBJECT" else args if op in DEALT + LINKED else args[:1]
        space = C.Space(_entries(self.rows(), keys))
        space.now, before = self._now(), dict(space)
        reply = C.run(space, op, args)
        changed = [(self.db, k, e.kind, e.dump(), e.deadline) for k, e in space.items() if e != before.get(k)]
        gone = [(self.db, k, None, None, None) for k in before if k not in space]
        kind = "db bigint, key string, type string, value string, deadline bigint"
        if changed or gone:
            tx = self.store.begin()
            rows = self.spark.createDataFrame([(*r, False) for r in changed] + [(*r, True) for r in gone], f"{kind}, _dead boolean")
            tx.append("kv", rows.coalesce(1), update=True)
            tx.commit()
        return reply

    def replay(self, log: DataFrame) -> DataFrame:
        """Replies of a log (seq, at, op, args) on the selected database, whose new state is one commit."""
        with scope() as keep:
            old = materialize(self.rows(), "before")
            replies, state = execute(log, old)
            state = materialize(state, "state")
            tx = self.store.begin()
            gone = old.join(state.select("key"), "key", "left_anti").withColumn("_dead", F.lit(True))
            tx.append("kv", state.withColumn("_dead", F.lit(False)).unionByName(gone).withColumn("db", F.lit(self.db)), update=True)
            tx.commit()
            return keep(materialize(replies, "replies"))

    def _do_ping(self, message: str = "PONG"):
        return message

    def _do_echo(self, message: str):
        return message

    def _do_select(self, n: str):
        if not n.isdigit() or int(n) > 15:
            return C.Failure("ERR DB index is out of range")
        self.db = int(n)
        return C.OK

    def _do_dbsize(self):
        return self.rows().count()

    def _do_flushdb(self):
        self._write(self.rows().withColumn("db", F.lit(self.db)), dead=True)
        return C.OK

    def _do_flushall(self):
        tx = self.store.begin()
        tx.truncate("kv")
        tx.commit()
        return C.OK

    def _do_keys(self, glob: str):
        return [r.key for r in self.rows().filter(F.col("key").rlike(glob_regex(glob))).select("key").orderBy("key").collect()]

    def _do_scan(self, cursor: str, *options: str):
        """Pages in the order of keys: the cursor is a number of keys that came before."""
        words = [o.upper() for o in options]
        n = int(options[words.index("COUNT") + 1]) if "COUNT" in words else 10
        rows = self.rows().select("key")
        if "MATCH" in words:
            rows = rows.filter(F.col("key").rlike(glob_regex(options[words.index("MATCH") + 1])))
        page = [r.key for r in rows.orderBy("key").offset(int(cursor)).limit(n + 1).collect()]
        return [str(int(cursor) + n) if len(page) > n else "0", page[:n]]

    def _do_info(self):
        return f"# Server\r\nengine:sparkloom\r\nuptime_in_seconds:{int(self.clock() - self.began)}\r\n# Keyspace\r\ndb{self.db}:keys={self.rows().count()}\r\n"

    def _do_config(self, what: str, name: str, value: str | None = None):
        """Settings can be read; a change is accepted and does nothing, as there is nothing that they set."""
        if what.upper() == "SET":
            return C.OK if name in self.settings else C.Failure(f"ERR unknown setting '{name}'")
        if what.upper() != "GET":
            return C.SYNTAX
        return [x for k, v in self.settings.items() if re.match(glob_regex(name), k) for x in (k, v)]

    def _do_wait(self, *_: str):
        return 0

    def _do_lolwut(self, *_: str):
        return "sparkloom: keys and values, woven\n"

    def _do_save(self):
        self.store.compact("kv", self._now())
        return C.OK

    _do_bgsave = _do_save

    def subscribe(self, client: str, channel: str, call: Callable[[str, str], None]) -> int:
        """call(channel, message) for each message; the number of the client's channels."""
        self.listeners.setdefault(channel, {})[client] = call
        return sum(client in c for c in self.listeners.values())

    def unsubscribe(self, client: str, channel: str | None = None) -> int:
        for name in [channel] if channel else [*self.listeners]:
            self.listeners.get(name, {}).pop(client, None)
            if not self.listeners.get(name, True):
                del self.listeners[name]
        return sum(client in c for c in self.listeners.values())

    def _do_subscribe(self, *_: str):
        return C.Failure("ERR a connection that can be called back is needed")

    def _do_publish(self, channel: str, message: str):
        calls = [*self.listeners.get(channel, {}).values()]
        for call in calls:
            call(channel, message)
        return len(calls)

    def _do_pubsub(self, what: str, *names: str):
        if what.upper() == "CHANNELS":
            return sorted(c for c in self.listeners if re.match(glob_regex(names[0] if names else "*"), c))
        return [x for c in names for x in (c, len(self.listeners.get(c, {})))] if what.upper() == "NUMSUB" else C.SYNTAX
