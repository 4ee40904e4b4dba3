"""Connected components of a table of links, by contraction of neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(links: DataFrame) -> DataFrame:
    """id and comp (the smallest id reachable) for every id in links (a, b). links should be a written table.

    Each round, a node goes over to the least of itself and its neighbours, and links are drawn anew between
    the nodes that are left, until there are none. The two first rounds go by id, which ends stars, then every
    other by a hash that is new each time: of those, a node is the least of its neighbourhood half the time at
    most, so that rounds are logarithmic whatever the order of ids along a chain. In any order the greatest node
    of a component goes, so that the rounds end. Only whether links are left reaches the driver. No links: an
    empty table.
    """
    with common.scope() as keep:
        ends = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        both = common.materialize(ends.distinct(), "links")
        label = both.select(F.col("a").alias("id"), F.col("a").alias("comp")).distinct()
        both = both.filter("a <> b")
        step = 0
        while both.limit(1).count():
            rank = (lambda c: F.struct(F.col(c).alias("h"), F.col(c).alias("id"))) if step < 2 or step % 2 else (lambda c, s=step: F.struct(F.xxhash64(F.col(c), F.lit(s)).alias("h"), F.col(c).alias("id")))
            least = both.groupBy("a").agg(F.min(rank("b")).alias("low"))
            least = common.materialize(least.select(F.col("a").alias("node"), F.least("low", rank("a"))["id"].alias("to")), "least")
            label = common.materialize(label.join(least, F.col("comp") == F.col("node"), "left").select("id", F.coalesce("to", "comp").alias("comp")), "label")
            both = both.join(least.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(least.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
            both = common.materialize(both.filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "links")
            step += 1
        least = label.groupBy("comp").agg(F.min("id").alias("least"))
        return keep(common.materialize(label.join(least, "comp").select("id", F.col("least").alias("comp")), "label"))
