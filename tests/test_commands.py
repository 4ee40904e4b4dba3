"""Key-value commands: one by one, as logs against an ordered run, on a store, and on the wire."""

import random

import pytest

from sparkloom.operators import commands as C
from sparkloom.operators.keyspace import LOG, STATE, Server, execute, shown


def run(*lines, now=0):
    space = C.Space()
    space.now = now
    return [C.run(space, line.split()[0], line.split()[1:]) for line in lines], space


@pytest.mark.parametrize(
    ("lines", "replies"),
    [
        (["SET k v", "SET k w NX", "SET k w XX GET", "SET j w XX", "GET k", "GET j", "SET k"], ["OK", None, "v", None, "w", None, C.ARITY]),
        (["SET k v EX 5 PX 3", "SET k v NX XX", "SET k v EX 0", "SET k v ODD"], [C.SYNTAX, C.SYNTAX, "ERR invalid expire time in 'set' command", C.SYNTAX]),
        (["SETNX k 1", "SETNX k 2", "GETSET k 3", "GETDEL k", "GETDEL k", "MSET a 1 b 2", "MSET a", "MGET a x b"], [1, 0, "1", "3", None, "OK", C.ARITY, ["1", None, "2"]]),
        (["INCR n", "INCRBY n 41", "DECR n", "DECRBY n 1", "SET n x", "INCR n", "INCRBYFLOAT f 10.5", "INCRBYFLOAT f 0.25", "INCRBYFLOAT f 0.25", "INCRBYFLOAT n 1"], [1, 42, 41, 40, "OK", C.NOT_INT, "10.5", "10.75", "11", C.NOT_FLOAT]),
        (["APPEND k aé", "APPEND k b", "STRLEN k", "GETRANGE k -2 -1", "GETRANGE k 5 9", "GETRANGE none 0 -1", "STRLEN none"], [3, 4, 4, "éb", "", "", 0]),
        (["EXISTS k", "SET k 1", "EXISTS k k x", "TYPE k", "TYPE x", "RENAME k j", "RENAME k j", "DEL j j x", "OBJECT ENCODING j"], [0, "OK", 2, "string", "none", "OK", "ERR no such key", 1, None]),
        (["EXPIRE k 5", "SET k 1 PX 1500", "TTL k", "PTTL k", "PERSIST k", "PERSIST k", "TTL k", "EXPIREAT k 9", "TTL k", "PEXPIRE k 20", "TTL x", "EXPIRE k 0", "GET k"], [0, "OK", 1, 1500, 1, 0, -1, 1, 9, 1, -2, 1, None]),
        (["RPUSH l a b c", "LPUSH l y z", "LRANGE l 0 -1", "LLEN l", "LINDEX l -1", "LINDEX l 9", "LSET l 1 Y", "LSET l 9 x", "LSET none 0 x", "LPOP l", "RPOP l 2", "RPOP l 0", "LRANGE l 0 9"], [3, 5, ["z", "y", "a", "b", "c"], 5, "c", None, "OK", "ERR index out of range", "ERR no such key", "z", ["c", "b"], [], ["Y", "a"]]),
        (["RPUSH l x a x b x", "LREM l 1 x", "LREM l -1 x", "LRANGE l 0 -1", "LREM l 0 x", "LPOP l 9", "EXISTS l", "LPOP l", "LPOP l 2", "SET l 1", "LPUSH l 1"], [5, 1, 1, ["a", "x", "b"], 1, ["a", "b"], 0, None, [], "OK", C.WRONG_TYPE]),
        (["HSET h a 1 b 2", "HSET h a 3 c 4", "HGET h a", "HMGET h a x", "HGETALL h", "HKEYS h", "HVALS h", "HLEN h", "HEXISTS h x", "HDEL h a a x", "HINCRBY h b 5", "HINCRBYFLOAT h d 1.5", "HINCRBY h d 1", "HMSET h z"], [2, 1, "3", ["3", None], ["a", "3", "b", "2", "c", "4"], ["a", "b", "c"], ["3", "2", "4"], 3, 0, 1, 7, "1.5", C.NOT_INT, C.ARITY]),
        (["SADD s b a b", "SADD t b c", "SMEMBERS s", "SISMEMBER s a", "SMISMEMBER s a x", "SCARD s", "SUNION s t", "SINTER s t", "SDIFF s t", "SUNIONSTORE u s t x", "SINTERSTORE u s x", "EXISTS u", "SREM s a x", "SPOP t 9", "SPOP t", "SINTER s none"], [2, 2, ["a", "b"], 1, [1, 0], 2, ["a", "b", "c"], ["b"], ["a"], 3, 0, 0, 1, ["c", "b"], None, []]),
        (["ZADD z 1 a 2 b 2 c", "ZADD z XX CH 5 a 1 q", "ZADD z GT 1 a 9 d", "ZADD z LT CH 1 a", "ZADD z NX INCR 1 a", "ZADD z INCR 2.5 a", "ZADD z NX GT 1 a", "ZSCORE z a", "ZSCORE z q", "ZRANK z c", "ZREVRANK z c", "ZRANK z q", "ZCARD z"], [3, 1, 1, 1, None, "3.5", C.SYNTAX, "3.5", None, 1, 2, None, 4]),
        (["ZADD z 1 a 2 b 2 c 4 d", "ZRANGE z 1 -2 WITHSCORES", "ZRANGE z 0 1 REV", "ZRANGE z (1 2 BYSCORE LIMIT 1 5", "ZRANGE z 4 (1 BYSCORE REV LIMIT 0 2", "ZRANGE z 0 -1 LIMIT 0 1", "ZREVRANGE z 9 12", "ZRANGEBYSCORE z -inf +inf LIMIT 0 0", "ZREVRANGEBYSCORE z 2 1 WITHSCORES", "ZCOUNT z (1 (4", "ZINCRBY z 0.5 a", "ZREM z a x", "ZPOPMIN z", "ZPOPMAX z 0", "ZPOPMAX z 5", "EXISTS z", "ZRANGE z 0 -1", "ZADD z nan a"], [4, ["b", "2", "c", "2"], ["d", "c"], ["c"], ["d", "c"], C.SYNTAX, [], [], ["c", "2", "b", "2", "a", "1"], 2, "1.5", 1, ["b", "2"], [], ["d", "4", "c", "2"], 0, [], C.NOT_FLOAT]),
        (["NOPE a", "GET", "GET a b", "INCRBY k x"], ["ERR unknown command 'NOPE'", C.ARITY, C.ARITY, C.NOT_INT]),
    ],
)
def test_commands(lines, replies):
    assert run(*lines)[0] == replies


def test_deadlines_pass():
    space = C.Space()
    for now, line, want in [(0, "SET k v EX 2", "OK"), (1_999_999, "GET k", "v"), (1_999_999, "TTL k", 0), (2_000_000, "GET k", None), (2_000_000, "SETNX k w", 1), (9_000_000, "GET k", "w"), (9_000_000, "SET k x EX 5", "OK"), (9_000_000, "SET k y KEEPTTL", "OK"), (9_000_000, "PTTL k", 5000), (9_000_000, "APPEND k z", 2), (9_000_000, "TTL k", 5), (9_000_000, "RENAME k j", "OK"), (9_500_000, "PTTL j", 4500), (9_000_000, "SET j q", "OK"), (9_000_000, "TTL j", -1)]:
        space.now = now
        assert C.run(space, line.split()[0], line.split()[1:]) == want, line


def test_every_command_of_a_log_gets_its_reply(spark):
    """A log of all kinds against the same commands run in order; one key has a third of them."""
    r = random.Random(6)
    texts = ["SET {k} {v}", "SET {k} {v} NX GET", "SET {k} {v} EX 3", "INCR {k}", "APPEND {k} {v}", "LPUSH {k} {v} {v}", "LREM {k} -1 {v}", "LRANGE {k} 0 -1", "HSET {k} {v} {v}", "HGETALL {k}", "SADD {k} {v}", "ZADD {k} CH {v} m{v}", "ZRANGE {k} 0 -1 WITHSCORES", "DEL {k} {j} {k}", "MGET {k} {j}", "MSET {k} {v} {j} {v}", "EXISTS {k} {j} {j}", "EXPIRE {k} 2", "TTL {k}", "TYPE {k}", "GETDEL {k}", "NOPE {k}", "MSET {k}", "OBJECT ENCODING {k}"]
    rare = ["RENAME {k} {j}", "SUNIONSTORE {k} {j} {j}", "SINTER {k} {j}", "DBSIZE", "FLUSHDB"]
    key = lambda: "k0" if r.random() < 0.33 else f"k{r.randrange(12)}"
    log, space, want = [], C.Space(), {}
    for seq in range(400):
        line = r.choice(rare if seq in (120, 121, 200, 290, 291, 330) else texts).format(k=key(), j=key(), v=r.randrange(6)).split()
        log.append((seq, seq * 300_000, line[0].lower() if seq % 2 else line[0], line[1:]))
        space.now = seq * 300_000
        if line[0] == "DBSIZE":
            want[seq] = shown(sum(space.find(k) is not None for k in space))
        elif line[0] == "FLUSHDB":
            space.clear()
            want[seq] = '"OK"'
        else:
            want[seq] = shown(C.run(space, line[0], line[1:])).replace("'nope'", "'NOPE'")
    replies, state = execute(spark.createDataFrame([*log, (None, 0, "GET", ["k0"]), (401, 0, None, ["k0"])], LOG).repartition(4))
    assert {x.seq: x.reply for x in replies.collect()} == want
    live = {k: (e.kind, e.dump(), e.deadline) for k in space if (e := space.find(k))}
    got = {x.key: (x.type, x.value, x.deadline) for x in state.collect()}
    assert {k: v for k, v in got.items() if v[2] is None or v[2] > space.now} == live


def test_logs_of_nothing(spark):
    replies, state = execute(spark.createDataFrame([], LOG), spark.createDataFrame([("a", "string", '"x"', None)], STATE))
    assert replies.count() == 0 and [r.key for r in state.collect()] == ["a"]


def test_server(spark):
    t = [1000.0]
    s = Server(spark, clock=lambda: t[0])
    do = lambda line: s.execute(*line.split())
    for line, want in [("PING", "PONG"), ("PING hi", "hi"), ("ECHO x", "x"), ("ECHO", C.ARITY), ("SET a 1 EX 10", "OK"), ("MSET b 2 cc 3", "OK"), ("DBSIZE", 3), ("KEYS ?", ["a", "b"]), ("SCAN 0 COUNT 2", ["2", ["a", "b"]]), ("SCAN 2 COUNT 2 MATCH *", ["0", ["cc"]]), ("INCR a", 2), ("RENAME a d", "OK"), ("TTL d", 10), ("SELECT 1", "OK"), ("GET b", None), ("SELECT 16", C.Failure("ERR DB index is out of range")), ("SELECT 0", "OK"), ("CONFIG GET max*", ["maxmemory", "0"]), ("CONFIG SET maxmemory 1", "OK"), ("WAIT 1 0", 0), ("SAVE", "OK"), ("OBJECT ENCODING b", "raw"), ("SUBSCRIBE c", C.Failure("ERR a connection that can be called back is needed"))]:
        assert do(line) == want, line
    assert "db0:keys=3" in do("INFO") and "woven" in do("LOLWUT")
    t[0] += 10
    assert do("DBSIZE") == 2
    log = spark.createDataFrame([(1, 1010_000_000, "LPUSH", ["l", "x", "y"]), (2, 1010_000_000, "DEL", ["b"]), (3, 1010_000_000, "RENAME", ["l", "m"])], LOG)
    assert {r.seq: r.reply for r in s.replay(log).collect()} == {1: "2", 2: "1", 3: '"OK"'}
    assert do("LRANGE m 0 -1") == ["y", "x"] and do("KEYS *") == ["cc", "m"]
    assert do("FLUSHDB") == "OK" and do("DBSIZE") == 0
    do("SET z 1")
    assert do("FLUSHALL") == "OK" and do("KEYS *") == []


def test_channels(spark):
    s, heard = Server(spark), []
    for client, channel in [("a", "news"), ("b", "news"), ("a", "other")]:
        s.subscribe(client, channel, lambda c, m, who=client: heard.append((who, c, m)))
    assert s.execute("PUBLISH", "news", "hi") == 2 and s.execute("PUBLISH", "none", "x") == 0 and heard == [("a", "news", "hi"), ("b", "news", "hi")]
    assert s.execute("PUBSUB", "CHANNELS", "n*") == ["news"] and s.execute("PUBSUB", "NUMSUB", "news", "x") == ["news", 2, "x", 0]
    assert s.unsubscribe("a") == 0 and s.execute("PUBSUB", "CHANNELS") == ["news"]


def test_wire():
    d = C.Decoder()
    raw = b"*3\r\n$3\r\nSET\r\n$1\r\nk\r\n$4\r\n\xc3\xa9\r\n\r\n" + b"PING  x\r\n" + b"*1\r\n$4\r\nPING\r\n"
    got = [c for i in range(len(raw)) for c in d.feed(raw[i : i + 1])]
    assert got == [["SET", "k", "é\r\n"], ["PING", "x"], ["PING"]]
    assert C.Decoder().feed(b"\r\n") == []
    with pytest.raises(ValueError):
        C.Decoder().feed(b"*1\r\n:4\r\n")
    assert [C.encode(x) for x in ("OK", "é", None, 3, ["a", None, [1]], C.WRONG_TYPE)] == [b"+OK\r\n", b"$2\r\n\xc3\xa9\r\n", b"$-1\r\n", b":3\r\n", b"*3\r\n$1\r\na\r\n$-1\r\n*1\r\n:1\r\n", f"-{C.WRONG_TYPE}\r\n".encode()]
