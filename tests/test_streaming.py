"""Streaming jobs on small files, and log replay against an ordered fold."""

import datetime as dt
import random

import pytest

from sparkloom.operators.replay import LOG, replay
from sparkloom.sources.versions import Store
from sparkloom.streaming import jobs


def fold(log):
    """The log one command at a time."""
    state = {}
    for _, op, key, field, value in sorted(log, key=lambda r: r[0]):
        if key is None or op is None:
            continue
        field, value = field or "", value or ""
        kind = {"H": "hash", "Z": "zset"}.get(op[0], "set" if op in ("SADD", "SREM") else "string")
        if op == "DEL":
            state.pop(key, None)
        elif op == "SET":
            state[key] = ("string", {"": value})
        elif op == "INCRBY":
            t, v = state.get(key, ("string", {"": "0"}))
            if t == "string":
                try:
                    state[key] = (t, {"": str(int(v[""]) + int(value))})
                except ValueError:
                    state.setdefault(key, (t, v))
        elif op in ("HSET", "SADD", "ZADD"):
            t, v = state.setdefault(key, (kind, {}))
            if t == kind:
                v[field] = "" if kind == "set" else value
        elif op in ("HDEL", "SREM", "ZREM") and state.get(key, ("",))[0] == kind:
            state[key][1].pop(field, None)
    return sorted((k, t, f, v) for k, (t, d) in state.items() for f, v in d.items())


@pytest.mark.parametrize("seed", range(3))
def test_replay(spark, seed):
    r = random.Random(seed)
    families = [["SET", "INCRBY", "DEL"], ["HSET", "HSET", "HDEL", "DEL"], ["SADD", "SREM"], ["ZADD", "ZREM", "DEL"]]
    log = []
    for seq in range(400):
        k = 0 if r.random() < 0.3 else r.randrange(12)
        log.append((seq, r.choice(families[k % 4]), f"k{k}", r.choice("abc"), str(r.randrange(9)) if r.random() < 0.95 else "text"))
    log += [(900, "SET", None, None, None), (901, None, "k1", "a", "1"), (902, "HSET", "k9", None, None), (903, "SADD", "k0", "x", "")]
    df = spark.createDataFrame(log, LOG).repartition(5)
    assert sorted(tuple(x) for x in replay(df).collect()) == fold(log)


def test_replay_of_nothing(spark):
    assert replay(spark.createDataFrame([], LOG)).collect() == []


def test_replay_into_a_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    tx = store.begin()
    tx.create("kv", [("key", "string", True), ("value", "bigint", False)], key=["key"])
    tx.commit()
    for k in range(3):
        spark.createDataFrame([("a", k), (f"b{k}", k)], "key string, value bigint").coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        stream = spark.readStream.schema("key string, value bigint").json(f"{tmp_path}/in")
        jobs.replay_into(stream, store, "kv", f"file://{tmp_path}/ck").awaitTermination(60)
    got = {r.key: r.value for r in store.begin().read("kv").collect()}
    assert got == {"a": 2, "b0": 0, "b1": 1, "b2": 2}


def test_publish(spark):
    subs = spark.createDataFrame([("c1", "news"), ("c2", "news"), ("c1", "news"), ("c1", "n.x")], "client string, channel string")
    sent = spark.createDataFrame([("news", "hi"), ("none", "x")], "channel string, message string")
    assert {(r.channel, r.receivers) for r in jobs.receivers(sent, subs).collect()} == {("news", 2), ("none", 0)}
    assert {r.client for r in jobs.deliveries(sent, subs).collect()} == {"c1", "c2"}
    assert {(r.channel, r.subscribers) for r in jobs.channels(subs, "n?ws").collect()} == {("news", 2)}


def test_heartbeats(spark):
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    beats = spark.createDataFrame([("a", at(10)), ("a", at(1)), ("b", at(6)), ("c", at(1))], "node string, at timestamp_ntz").selectExpr("node", "CAST(at AS timestamp) AS at")
    now = dt.datetime(2024, 1, 1, 0, 0, 10, tzinfo=dt.UTC).timestamp()
    assert {(r.node, r.status) for r in jobs.heartbeats(beats, now).collect()} == {("a", "UP"), ("b", "SUSPECT"), ("c", "DOWN")}


def test_expiries(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00", 5.0), ("b", "2024-01-01 00:00:00", 50.0), ("c", "2024-01-01 00:00:00", None), ("z", "2024-01-01 00:00:20", None)]
    for k in range(2):
        later = [(key, at.replace(":00", f":{30 * k:02d}", 1) if key == "z" else at, ttl) for key, at, ttl in rows if k == 0 or key == "z"]
        spark.createDataFrame(later, "key string, at string, ttl_s double").coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        stream = spark.readStream.schema("key string, at timestamp, ttl_s double").json(f"{tmp_path}/in")
        out = jobs.expiries(stream)
        out.writeStream.format("json").option("checkpointLocation", f"{tmp_path}/ck").option("path", f"{tmp_path}/out").trigger(availableNow=True).start().awaitTermination(90)
    assert {r.key for r in spark.read.schema("key string").json(f"{tmp_path}/out").collect()} == {"a", "b"}
