"""Queries of the engine's operators with equivalent SQL, for the driver's contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.ring import owners
from . import commands, keyvalue, mutations, relational, widecolumn

_SQL = relational.QUERIES | widecolumn.QUERIES | keyvalue.QUERIES


def _runner(tables: str, sql: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(sql_for(tables, sql), **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables.split()})

    return run


def sql_for(tables: str, sql: str) -> str:
    """The text with each table as a parameter, so that nothing is registered in the session and concurrent queries don't meet."""
    names = tables.split()
    return f"WITH {', '.join(f'{t} AS (SELECT * FROM {{{t}}})' for t in names)} {sql}" if names else sql


def describe_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of events and their roles: user_id partitions, ts clusters."""
    role = {"user_id": "partition", "ts": "clustering"}
    return spark.createDataFrame([(c, role.get(c, "regular")) for c in spark.read.parquet(f"{sf_dir}/events.parquet").columns], "col string, role string")


def ring_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The owner of each customer on a ring of all nations."""
    return owners(spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr("n_nationkey AS node"), spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey AS key"))


def ring_after_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with two nodes stopped."""
    return owners(spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr("n_nationkey AS node").where("node NOT IN (3, 7)"), spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey AS key"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {name: _runner(tables, sql) for name, (tables, sql, _) in _SQL.items() if sql}
    return out | {f.__name__: f for f in (describe_table, ring_distribution, ring_after_stop)} | mutations.QUERIES | commands.QUERIES


def oracle_sql() -> dict[str, str]:
    return {name: duck or sql for name, (_, sql, duck) in _SQL.items()} | mutations.ORACLE_SQL | commands.ORACLE_SQL
