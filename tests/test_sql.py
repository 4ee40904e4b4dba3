"""SQL and wide-column front ends over version tables."""

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators.cql import Keyspaces
from sparkloom.operators.sql import Database
from sparkloom.sources.versions import Conflict, Store


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture
def db(spark):
    """Parcels on their way: many missing values, equal names, a text of each boolean."""
    d = Database(spark)
    d.execute("CREATE TABLE parcels (code INT PRIMARY KEY, label VARCHAR(40) NOT NULL, depot INT, kilos FLOAT, fragile BOOL, due TIMESTAMP)")
    d.execute("INSERT INTO parcels VALUES (11, 'vase', 7, 2.25, TRUE, '2023-03-04 05:06:07'), (12, 'rug''s end', 8, 31, 'no', NULL), (13, 'vase', NULL, 0.5, 'YES', '2023-03-05T00:00:00'), (14, 'crate', 7, NULL, NULL, NULL)")
    return d


def test_dml(db):
    assert rows(db.execute("SELECT code, label, kilos, fragile FROM parcels ORDER BY code")) == [(11, "vase", 2.25, True), (12, "rug's end", 31.0, False), (13, "vase", 0.5, True), (14, "crate", None, None)]
    assert db.execute("UPDATE parcels SET kilos = kilos + depot, depot = NULL WHERE depot = 7").rows == 2
    assert db.execute("DELETE FROM parcels WHERE fragile = FALSE").rows == 1
    assert db.execute("INSERT INTO parcels (label, code) VALUES ('late', 20), ('later', 21)").rows == 2
    assert rows(db.execute("SELECT code, depot, kilos FROM parcels p ORDER BY code")) == [(11, None, 9.25), (13, None, 0.5), (14, None, None), (20, None, None), (21, None, None)]
    db.store.compact("parcels")
    assert rows(db.execute("SELECT COUNT(*), COUNT(kilos), COUNT(DISTINCT label), 7 / 0 FROM parcels")) == [(5, 2, 4, None)]
    assert db.execute("DELETE FROM parcels").rows == 5
    assert rows(db.execute("SELECT * FROM parcels")) == []


def test_values_that_do_not_fit(db):
    for bad in ["INSERT INTO parcels (code, label) VALUES ('x', 'n')", "INSERT INTO parcels (code) VALUES (5)", "INSERT INTO parcels (nope) VALUES (5)", "UPDATE parcels SET label = NULL"]:
        with pytest.raises(Exception):
            db.execute(bad)
    assert rows(db.execute("SELECT COUNT(*) FROM parcels")) == [(4,)]


def test_backslashes_are_plain(db):
    db.execute(r"INSERT INTO parcels (code, label) VALUES (20, 'a\nb''c')")
    assert rows(db.execute(r"SELECT label, 'x\t' FROM parcels WHERE label = 'a\nb''c'")) == [(r"a\nb'c", r"x\t")]


def test_transactions(db):
    a, b = db.connect(), db.connect()
    a.execute("BEGIN")
    a.execute("INSERT INTO parcels (code, label) VALUES (50, 'unseen')")
    assert rows(a.execute("SELECT COUNT(*) FROM parcels")) == [(5,)]
    assert rows(b.execute("SELECT COUNT(*) FROM parcels")) == [(4,)]
    a.execute("ROLLBACK")
    assert rows(a.execute("SELECT COUNT(*) FROM parcels")) == [(4,)]
    a.execute("BEGIN")
    b.execute("BEGIN")
    a.execute("UPDATE parcels SET kilos = 1 WHERE code = 13")
    b.execute("UPDATE parcels SET kilos = 2 WHERE label = 'vase'")
    a.execute("COMMIT")
    with pytest.raises(Conflict):
        b.execute("COMMIT")
    assert rows(b.execute("SELECT kilos FROM parcels WHERE code = 13")) == [(1.0,)]
    a.execute("BEGIN")
    a.execute("UPDATE parcels SET kilos = 5 WHERE code = 11")
    b.execute("UPDATE parcels SET kilos = 7 WHERE code = 12")
    a.execute("COMMIT")
    assert rows(b.execute("SELECT kilos FROM parcels WHERE code < 13 ORDER BY code")) == [(5.0,), (7.0,)]


def test_definitions_do_not_undo_rows_of_others(db):
    a, b = db.connect(), db.connect()
    a.execute("BEGIN")
    a.execute("CREATE INDEX by_depot ON parcels (depot)")
    b.execute("INSERT INTO parcels (code, label) VALUES (60, 'between')")
    a.execute("COMMIT")
    assert rows(a.execute("SELECT COUNT(*) FROM parcels")) == [(5,)]
    tx = db.store.begin()
    tx.truncate("parcels")
    b.execute("INSERT INTO parcels (code, label) VALUES (61, 'after')")
    tx.commit()
    assert rows(b.execute("SELECT code FROM parcels")) == [(61,)]
    a.execute("BEGIN")
    a.execute("INSERT INTO parcels (code, label) VALUES (62, 'lost')")
    b.execute("DROP TABLE parcels")
    b.execute("CREATE TABLE parcels (code INT, label TEXT)")
    with pytest.raises(Conflict):
        a.execute("COMMIT")
    assert rows(b.execute("SELECT * FROM parcels")) == []


@pytest.mark.parametrize("seed", [1, 2])
def test_interleaved_sessions_are_a_serial_fold(spark, seed):
    """Two sessions insert, update, empty, alter and compact in random order, held against a plain model."""
    r = random.Random(seed)
    store = Store(spark)
    tx = store.begin()
    tx.create("t", [("id", "bigint", True), ("v", "bigint", False)])
    tx.commit()
    there, version, epoch, emptied = {}, {}, 0, 0  # committed values, the commit that wrote each, commits so far, the last that emptied the table
    open_ = {}

    def visible(own):
        return ({k: v for k, v in there.items() if k not in own["gone"]} | own["rows"]) if own else dict(there)

    for step in range(26):
        who = r.choice("ab")
        if who not in open_:
            open_[who] = (Store(spark, store.path).begin(), {"rows": {}, "gone": set(), "cut": False, "read": {}, "at": []})
        tx, own = open_[who]
        act = r.choice(["insert", "insert", "update", "alter", "truncate", "compact", "commit", "commit", "rollback"])
        if act == "insert":
            tx.append("t", spark.createDataFrame([(step, step)], "id bigint, v bigint"))
            own["rows"][step] = step
        elif act == "update" and visible(own):
            k = r.choice(sorted(visible(own)))
            old = tx.read("t", hidden=True).where(f"id = {k}")
            tx.append("t", old.withColumn("v", F.lit(1000 + step).cast("bigint")), update=True)
            if k not in own["rows"]:
                own["read"][k] = version[k]
            own["at"].append(epoch)
            own["rows"][k] = 1000 + step
        elif act == "alter":
            tx.alter("t", indexes={f"i{step}": {"columns": ["v"], "unique": False}})
        elif act == "truncate":
            tx.truncate("t")
            own.update(gone=own["gone"] | set(there), cut=True, rows={}, read={}, at=[])
        elif act == "compact":
            store.compact("t")
            epoch += 1
        elif act == "rollback":
            tx.rollback()
            del open_[who]
        elif act == "commit":
            del open_[who]
            must = any(version.get(k) != v for k, v in own["read"].items()) or any(at < emptied for at in own["at"])
            try:
                tx.commit()
            except Conflict:
                assert epoch > min(own["at"], default=epoch) or own["cut"]
                tx.rollback()
            else:
                assert not must
                if own["rows"] or own["cut"]:
                    epoch += 1
                    emptied = epoch if own["cut"] else emptied
                    there = visible(own)
                    version = {k: epoch if k in own["rows"] else version[k] for k in there}
        for name, (tx, own) in [*open_.items()]:
            try:
                assert dict(rows(tx.read("t"))) == visible(own), (step, act)
            except Conflict:  # what it emptied was rewritten by another: it cannot go on
                assert own["cut"]
                tx.rollback()
                del open_[name]
        assert dict(rows(store.begin().read("t"))) == there, (step, act)


def test_sequence_grows_over_all_stores_of_a_path(spark):
    one = Store(spark)
    two = Store(spark, one.path)
    got = [s.next_seq(0) for _ in range(1500) for s in (one, two)]
    assert all(x < y for x, y in zip(got, got[1:])) and two.next_seq(10**19) > 10**19


def test_many_statements_leave_few_folders(spark):
    store = Store(spark)
    tx = store.begin()
    tx.create("t", [("id", "bigint", True), ("v", "bigint", False)], key=["id"])
    tx.commit()
    held = None
    for i in range(36):
        tx = store.begin()
        tx.append("t", spark.createDataFrame([(i % 5, i)], "id bigint, v bigint"), update=True)
        tx.commit()
        held = held or store.begin().read("t")
    assert dict(rows(store.begin().read("t"))) == {k: max(i for i in range(36) if i % 5 == k) for k in range(5)}
    assert len(store.state()["tables"]["t"]["dirs"]) < 16 and store._fs.listStatus(store._at("_commits")).__len__() <= 40
    assert held.count() == 1  # a reader of folders that were merged since


def test_ddl_and_reopening(spark, db):
    db.execute("CREATE UNIQUE INDEX by_label ON parcels (label)")
    assert rows(db.execute("SHOW TABLES")) == [("parcels",)]
    assert rows(db.execute("DESCRIBE parcels"))[0] == ("code", "bigint", False)
    assert rows(Database(spark, db.store.path).execute("SELECT COUNT(*) FROM parcels")) == [(4,)]
    assert db.execute("DROP INDEX by_label").message == "index by_label dropped" and db.execute("DROP INDEX IF EXISTS by_label").message == "no such index"
    db.execute("CREATE INDEX by_label ON parcels (label)")
    db.execute("CREATE TABLE counts (depot INT, n INT)")
    db.execute("INSERT INTO counts SELECT depot, COUNT(*) FROM parcels GROUP BY depot")
    assert rows(db.execute("SELECT p.label, c.n FROM parcels p JOIN counts c ON c.depot = p.depot WHERE n = 1")) == [("rug's end", 1)]
    db.execute("DROP TABLE counts")
    assert db.execute("DROP TABLE IF EXISTS counts").message == "no such table"
    for bad in ["DROP TABLE counts", "DROP INDEX nope", "CREATE TABLE parcels (x INT)", "VACUUM", "CREATE TABLE t (x JSON)", "SELECT 'open"]:
        with pytest.raises(Exception):
            db.execute(bad)


def test_insert_only_tables_are_scanned_plainly(db):
    plan = db.execute("SELECT label FROM parcels WHERE code = 12")._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "EqualTo(code,12)" in plan and "ReadSchema: struct<code:bigint,label:string>" in plan


def test_wide_columns(spark):
    """Water levels of harbours: replaced rows, late writes, columns and ranges deleted, a time to live."""
    t = [1000.0]
    k = Keyspaces(spark, clock=lambda: t[0])
    k.execute("CREATE KEYSPACE tides WITH replication = {'class': 'NetworkTopologyStrategy', 'replication_factor': 2}")
    k.execute("USE tides")
    k.execute("CREATE TABLE levels (harbour TEXT, minute BIGINT, metres DOUBLE, seen TEXT, PRIMARY KEY ((harbour), minute))")
    for minute in (30, 10, 20, 40):
        k.execute(f"INSERT INTO levels (harbour, minute, metres, seen) VALUES ('Whitby', {minute}, {minute}.25, 'gauge')")
    k.execute("INSERT INTO tides.levels (harbour, minute, metres) VALUES ('Brest', 5, -1) USING TTL 90")
    k.execute("INSERT INTO levels (harbour, minute, metres) VALUES ('Whitby', 30, 0.5)")
    assert rows(k.execute("SELECT minute, metres, seen FROM levels WHERE harbour = 'Whitby' AND minute >= 20 AND minute < 40")) == [(20, 20.25, "gauge"), (30, 0.5, None)]
    assert rows(k.execute("SELECT minute FROM levels WHERE harbour = 'Whitby' ORDER BY minute DESC LIMIT 3")) == [(40,), (30,), (20,)]
    assert rows(k.execute("SELECT COUNT(*) FROM levels WHERE metres < 1 ALLOW FILTERING")) == [(2,)]
    for bad in ("SELECT * FROM levels WHERE metres < 1", "SELECT * FROM levels WHERE harbour > 'A'", "UPDATE levels SET metres = 1 WHERE minute = 5", "DELETE FROM levels WHERE minute = 5"):
        with pytest.raises(ValueError, match="partition key"):
            k.execute(bad)
    t[0] += 91
    assert rows(k.execute("SELECT COUNT(*) FROM levels WHERE harbour IN ('Brest', 'Kiel')")) == [(0,)]
    k.execute("UPDATE levels SET metres = metres * 2, seen = 'eye' WHERE harbour = 'Whitby' AND minute = 10")
    k.execute("UPDATE levels SET metres = 3 WHERE harbour = 'Kiel' AND minute = 1")
    k.execute("DELETE seen FROM levels WHERE harbour = 'Whitby' AND minute = 20")
    k.execute("DELETE FROM levels WHERE harbour = 'Whitby' AND minute > 25")
    k.execute("UPDATE levels USING TIMESTAMP 7 SET metres = 100 WHERE harbour = 'Whitby' AND minute = 20")
    assert sorted(rows(k.execute("SELECT harbour, minute, metres, seen FROM levels"))) == [("Kiel", 1, 3.0, None), ("Whitby", 10, 20.5, "eye"), ("Whitby", 20, 20.25, None)]
    assert rows(k.execute("DESCRIBE TABLE levels"))[:2] == [("harbour", "string", "partition", False), ("minute", "bigint", "clustering", False)]
    assert rows(k.execute("DESCRIBE KEYSPACE tides")) == [("tides", "NetworkTopologyStrategy", 2)]
    k.execute("TRUNCATE levels")
    assert rows(k.execute("SELECT * FROM levels")) == []
    k.execute("DROP KEYSPACE tides")
    assert rows(k.execute("DESCRIBE KEYSPACES")) == []


def test_key_filter_reaches_the_scan_of_versions(spark):
    k = Keyspaces(spark)
    for s in ("CREATE KEYSPACE a", "USE a", "CREATE TABLE t (k BIGINT PRIMARY KEY, v TEXT)", "INSERT INTO t (k, v) VALUES (1, 'x')"):
        k.execute(s)
    assert "EqualTo(k,1)" in k.execute("SELECT v FROM t WHERE k = 1")._jdf.queryExecution().executedPlan().toString()


def test_text():
    assert T.tokens("a<=1 -- c\n 'it''s'") == ["a", "<=", "1", "'it''s'"]
    assert T.join(T.tokens("x.y + 1.5")) == "x.y + 1.5"
    import re

    for glob, yes, no in [("user:*", "user:1", "xuser:1"), ("a?c", "abc", "ac"), ("[a-c]x", "bx", "dx"), ("[!a]x", "bx", "ax"), (r"\*", "*", "a"), ("a.b", "a.b", "axb")]:
        assert re.fullmatch(T.glob_regex(glob), yes) and not re.fullmatch(T.glob_regex(glob), no)
