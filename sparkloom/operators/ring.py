"""Consistent hashing: which node owns a key. Nodes come, go and stop; owners are found by a plan, for any number of keys.

A node has VNODES tokens, the MD5 of `node:vn` and a number; a key belongs to the first token after its own MD5, the
last one's successor being the first. Keys and tokens meet in ranges of the hash (its first three digits), sorted there: a
running minimum from the range's end gives each key its token, or the first token of a later range. No key meets
more than the tokens of its range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VNODES = 150

_OWNERS = """WITH ring AS (SELECT node, md5(concat(CAST(node AS STRING), ':vn', CAST(v.id AS STRING))) AS h FROM {nodes} CROSS JOIN range({vnodes}) v),
keys AS (SELECT DISTINCT key, md5(CAST(key AS STRING)) AS h FROM {keys} WHERE key IS NOT NULL),
both AS (SELECT substr(h, 1, 3) AS b, h, key, CAST(NULL AS STRING) AS token FROM keys UNION ALL SELECT substr(h, 1, 3), h, NULL, h FROM ring),
own AS (SELECT b, key, MIN(token) OVER (PARTITION BY b ORDER BY h DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS token FROM both),
ranges AS (SELECT lpad(lower(hex(id)), 3, '0') AS b FROM range(4096)),
firsts AS (SELECT substr(h, 1, 3) AS b, MIN(h) AS first FROM ring GROUP BY 1),
later AS (SELECT b, MIN(first) OVER (ORDER BY b DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS next FROM ranges LEFT JOIN firsts USING (b)),
found AS (SELECT key, COALESCE(own.token, next, (SELECT MIN(h) FROM ring)) AS h FROM own JOIN later USING (b) WHERE key IS NOT NULL)
SELECT key, node FROM found JOIN (SELECT h, MIN(node) AS node FROM ring GROUP BY h) r USING (h)"""


def owners(nodes: DataFrame, keys: DataFrame, vnodes: int = VNODES) -> DataFrame:
    """key and node for each different key of keys (key), by the ring of nodes (node), which are few. Null keys have no owner; no nodes: no rows."""
    return keys.sparkSession.sql(_OWNERS.replace("{vnodes}", str(vnodes)), nodes=nodes.select("node").distinct(), keys=keys.select("key"))


class Ring:
    """Nodes of a cluster; stopped ones keep their place but own nothing until they start again."""

    def __init__(self, spark: SparkSession, nodes: list[str] = (), vnodes: int = VNODES):
        self.spark, self.vnodes, self.up = spark, vnodes, dict.fromkeys(nodes, True)

    def add(self, node: str) -> None:
        if node in self.up:
            raise ValueError(f"node {node} is there")
        self.up[node] = True

    def remove(self, node: str) -> None:
        del self.up[node]

    def stop(self, node: str) -> None:
        self.up[node] = self.up[node] and False  # unknown nodes are an error

    def start(self, node: str) -> None:
        self.up[node] = self.up[node] or True

    def owners(self, keys: DataFrame) -> DataFrame:
        return owners(self.spark.createDataFrame([(n,) for n, up in self.up.items() if up], "node string"), keys, self.vnodes)
