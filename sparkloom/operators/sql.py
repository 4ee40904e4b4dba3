"""SQL front end over version tables. Spark parses and plans SELECT and all expressions; only statements that Parquet lacks are read here.

PRIMARY KEY makes a column NOT NULL; neither it nor UNIQUE forbids equal values, and an index is a record in
the catalogue: scans are pruned by Parquet statistics. One Connection is one session: BEGIN, COMMIT, ROLLBACK, else each statement commits by itself. Its Spark
session has ANSI off so that x/0 is NULL; values that a column cannot hold raise on INSERT and UPDATE all the same.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.versions import HIDDEN_NAMES, Store, Transaction


@dataclass
class Done:
    """What a statement without rows reports."""

    message: str
    rows: int = 0


def coerced(value: Column, kind: str, found: str, not_null: bool, name: str) -> Column:
    """value as the column's type. Booleans: the texts true, 1 and yes in any case, all other texts false; times: ISO text or epoch seconds."""
    if kind == "boolean" and found == "string":
        out = F.when(value.isNotNull(), F.lower(value).isin("true", "1", "yes"))
    elif kind == "timestamp_ntz" and found not in ("string", "void", "timestamp", "timestamp_ntz", "date"):
        out = F.timestamp_seconds(value).cast(kind)
    else:
        out = value.cast(kind)
    bad = value.isNotNull() & out.isNull()
    out = F.when(bad, F.raise_error(F.concat(F.lit(f"column {name} cannot hold "), value.cast("string"))).cast(kind)).otherwise(out)
    return F.when(out.isNull(), F.raise_error(F.lit(f"column {name} is NOT NULL")).cast(kind)).otherwise(out) if not_null else out


def fitted(df: DataFrame, columns: list) -> DataFrame:
    """df with its columns coerced to a table's; missing ones are NULL."""
    found = dict(df.dtypes)
    hidden = [c for c in HIDDEN_NAMES if c in found]
    value = lambda c: (F.col(f"`{c}`"), found[c]) if c in found else (F.lit(None), "void")
    return df.select(*[coerced(value(c)[0], kind, value(c)[1], nn, c).alias(c) for c, kind, nn in columns], *hidden)


class Database:
    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.store = spark, Store(spark, path)
        self._own = self.connect()

    def connect(self) -> Connection:
        return Connection(self)

    def execute(self, sql: str) -> DataFrame | Done:
        return self._own.execute(sql)


class Connection:
    def __init__(self, db: Database):
        self.session = db.spark.newSession()
        for k, v in {"spark.sql.ansi.enabled": "false", "spark.sql.session.timeZone": "UTC"}.items():
            self.session.conf.set(k, v)
        self.store = Store(self.session, db.store.path)
        self.open: Transaction | None = None

    def execute(self, sql: str) -> DataFrame | Done:
        parts = T.tokens(sql)
        if not parts:
            return Done("empty statement")
        word = parts[0].upper()
        if word in ("BEGIN", "COMMIT", "ROLLBACK"):
            if len(parts) > 2 or parts[1:] and parts[1].upper() not in ("TRANSACTION", "WORK"):
                raise ValueError(f"unexpected {parts[-1]}")
            return self._transaction(word)
        if word in ("SELECT", "WITH", "EXPLAIN"):
            return self._select(T.spark_text(sql).strip().rstrip(";"), parts)
        run = getattr(self, f"_{word.lower()}", None) if word in ("CREATE", "DROP", "INSERT", "UPDATE", "DELETE", "DESCRIBE", "SHOW") else None
        if run is None:
            raise ValueError(f"unknown statement {parts[0]}")
        if self.open:
            return run(self.open, parts[1:])
        tx = self.store.begin()
        try:
            out = run(tx, parts[1:])
            tx.commit()
        except Exception:
            tx.rollback()
            raise
        return out

    def _transaction(self, word: str) -> Done:
        if word == "BEGIN":
            if self.open:
                return Done("transaction already active")
            self.open = self.store.begin()
            return Done("BEGIN")
        tx, self.open = self.open, None
        if tx is None:
            return Done("no active transaction")
        if word == "ROLLBACK":
            tx.rollback()
            return Done("ROLLBACK")
        try:
            tx.commit()
        except Exception:
            tx.rollback()
            raise
        return Done("COMMIT")

    def _select(self, sql: str, parts: list[str]) -> DataFrame:
        tx = self.open or self.store.begin()
        words = {T.name(p).lower() for p in parts}
        for t in tx.view()["tables"]:
            if t.lower() in words:
                tx.read(t).createOrReplaceTempView(t)
        return self.session.sql(sql)

    def _create(self, tx: Transaction, p: list[str]) -> Done:
        unique = p[0].upper() == "UNIQUE"
        kind, p = p[unique].upper(), p[unique + 1 :]
        if kind == "INDEX":
            if p[1].upper() != "ON":
                raise ValueError("CREATE INDEX name ON table (columns)")
            table, columns = T.name(p[2]), [T.name(c) for c in T.inside(p[3:]) if c != ","]
            t = tx.table(table)
            if missing := set(columns) - {c for c, _, _ in t["columns"]}:
                raise ValueError(f"no column {missing}")
            if t.get("indexes", {}).get(T.name(p[0])):
                raise ValueError(f"index {p[0]} exists")
            tx.alter(table, indexes={T.name(p[0]): {"columns": columns, "unique": unique}})
            return Done(f"index {p[0]} created")
        if kind != "TABLE" or unique:
            raise ValueError(f"cannot CREATE {kind}")
        columns = []
        for c in T.split(T.inside(p[1:])):
            words = " ".join(c[1:]).upper()
            if c[0].upper() in ("PRIMARY", "UNIQUE"):
                continue
            if rest := re.sub(r"^\w+( \( \d+( , \d+)? \))?|NOT NULL|\bNULL\b|PRIMARY KEY|UNIQUE", "", words).strip():
                raise ValueError(f"unexpected {rest}")
            columns.append((T.name(c[0]), T.spark_type(c[1]), "NOT NULL" in words or "PRIMARY KEY" in words))
        tx.create(T.name(p[0]), columns)
        return Done(f"table {p[0]} created")

    def _drop_index(self, tx: Transaction, p: list[str]) -> Done:
        quiet = [w.upper() for w in p[:2]] == ["IF", "EXISTS"]
        index = T.name(p[2] if quiet else p[0])
        for table, t in tx.view()["tables"].items():
            if t.get("indexes", {}).get(index):
                tx.alter(table, indexes={index: None})
                return Done(f"index {index} dropped")
        if quiet:
            return Done("no such index")
        raise ValueError(f"no index {index}")

    def _drop(self, tx: Transaction, p: list[str]) -> Done:
        if p[0].upper() == "INDEX":
            return self._drop_index(tx, p[1:])
        if p[0].upper() != "TABLE":
            raise ValueError(f"cannot DROP {p[0]}")
        if quiet := [w.upper() for w in p[1:3]] == ["IF", "EXISTS"]:
            p = p[2:]
        if quiet and T.name(p[1]) not in tx.view()["tables"]:
            return Done("no such table")
        tx.drop(T.name(p[1]))
        return Done(f"table {p[1]} dropped")

    def _insert(self, tx: Transaction, p: list[str]) -> Done:
        if p[0].upper() != "INTO":
            raise ValueError("INSERT INTO expected")
        table, rest = T.name(p[1]), p[2:]
        t = tx.table(table)
        names = [c for c, _, _ in t["columns"]]
        if rest[0] == "(":
            end = rest.index(")")
            names, rest = [T.name(c) for c in rest[1:end] if c != ","], rest[end + 1 :]
        if unknown := set(names) - {c for c, _, _ in t["columns"]}:
            raise ValueError(f"no column {unknown}")
        if rest[0].upper() == "VALUES":
            tuples = [T.split(T.inside(v)) for v in T.split(rest[1:])]
            if any(len(v) != len(names) for v in tuples):
                raise ValueError(f"{len(names)} values expected")
            rows = [f"({', '.join(T.join(e) for e in v)})" for v in tuples]
            try:
                source = fitted(self.session.sql("VALUES " + ", ".join(rows)).toDF(*names), t["columns"])
            except AnalysisException:  # rows of different types: each is coerced by itself
                source = reduce(DataFrame.unionAll, [fitted(self.session.sql(f"VALUES {r}").toDF(*names), t["columns"]) for r in rows])
        else:
            source = self._select(T.join(rest), rest)
            if len(source.columns) != len(names):
                raise ValueError(f"{len(names)} columns expected")
            source = fitted(source.toDF(*names), t["columns"])
        n = tx.append(table, source).count()
        return Done(f"{n} rows inserted", n)

    def _update(self, tx: Transaction, p: list[str]) -> Done:
        table, clauses = T.name(p[0]), T.cut(p[1:], "SET", "WHERE")
        t = tx.table(table)
        changes = {T.name(c[0]): F.expr(T.join(c[2:])) for c in T.split(clauses["SET"])}
        if unknown := set(changes) - {c for c, _, _ in t["columns"]}:
            raise ValueError(f"no column {unknown}")
        rows = tx.read(table, hidden=True)
        if "WHERE" in clauses:
            rows = rows.where(T.join(clauses["WHERE"]))
        n = tx.append(table, fitted(rows.withColumns(changes), t["columns"]), update=True).count()
        return Done(f"{n} rows updated", n)

    def _delete(self, tx: Transaction, p: list[str]) -> Done:
        if p[0].upper() != "FROM":
            raise ValueError("DELETE FROM expected")
        clauses = T.cut(p[2:], "WHERE")
        if clauses[""]:
            raise ValueError(f"unexpected {clauses[''][0]}")
        rows = tx.read(T.name(p[1]), hidden=True)
        if "WHERE" in clauses:
            rows = rows.where(T.join(clauses["WHERE"]))
        n = tx.append(T.name(p[1]), rows.withColumn("_dead", F.lit(True)), update=True).count()
        return Done(f"{n} rows deleted", n)

    def _describe(self, tx: Transaction, p: list[str]) -> DataFrame:
        t = tx.table(T.name(p[-1]))
        return self.session.createDataFrame([(c, kind, not nn) for c, kind, nn in t["columns"]], "col string, type string, nullable boolean")

    def _show(self, tx: Transaction, p: list[str]) -> DataFrame:
        if [w.upper() for w in p] != ["TABLES"]:
            raise ValueError("SHOW TABLES expected")
        return self.session.createDataFrame([(t,) for t in sorted(tx.view()["tables"])], "table string")
