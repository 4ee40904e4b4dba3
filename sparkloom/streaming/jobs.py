"""Streaming jobs: log replay into a store, pub/sub, expiry, heartbeats. Sources are any streaming DataFrame.

State is bounded by watermarks or by the number of keys; each job takes the checkpoint folder of its
query, so that it goes on where a lost driver or executor left off.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import glob_regex
from ..sources.versions import Store

SUSPECT_S, DOWN_S = 3, 8


def replay_into(stream: DataFrame, store: Store, table: str, checkpoint: str) -> StreamingQuery:
    """Append each micro-batch of versions to a keyed table. A repeated batch is recognised by its id and not written twice."""

    def write(batch: DataFrame, batch_id: int) -> None:
        tx = store.begin()
        t = tx.table(table)
        if t.get("stream", {}).get(checkpoint, -1) >= batch_id:
            return
        tx.append(table, batch, update=True)
        tx.alter(table, stream={checkpoint: batch_id}, plain=False)
        tx.commit()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deliveries(messages: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Messages (channel, message) with each subscriber of their channel: an equi-join with (client, channel), which is static."""
    return messages.join(subscriptions.select("client", "channel").distinct(), "channel")


def receivers(messages: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """PUBLISH: each message with its number of receivers, zero if no one listens."""
    counts = subscriptions.select("client", "channel").distinct().groupBy("channel").agg(F.count("*").alias("receivers"))
    return messages.join(counts, "channel", "left").withColumn("receivers", F.coalesce("receivers", F.lit(0)))


def channels(subscriptions: DataFrame, glob: str = "*") -> DataFrame:
    """PUBSUB CHANNELS and NUMSUB: channels with subscribers that match."""
    return subscriptions.where(F.col("channel").rlike(glob_regex(glob))).groupBy("channel").agg(F.countDistinct("client").alias("subscribers"))


def heartbeats(beats: DataFrame, now: Callable[[], float] | float) -> DataFrame:
    """Newest beat (node, at timestamp) of each node and its status: over 3 s old SUSPECT, over 8 s DOWN. Batch or update mode."""
    at = F.lit(now() if callable(now) else now)
    seen = beats.groupBy("node").agg(F.max("at").alias("seen"))
    age = at - F.unix_micros("seen") / 1_000_000
    return seen.withColumn("status", F.when(age > DOWN_S, "DOWN").when(age > SUSPECT_S, "SUSPECT").otherwise("UP"))


def expiries(sets: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """Keys that run out: of rows (key, at timestamp, ttl_s double; null: no expiry) one row (key, expired_at) when event time passes the last deadline of a key.

    A later row of the key replaces its deadline; a key without one holds no state.
    """

    def step(key: tuple, frames, state: GroupState):
        if state.hasTimedOut:
            (due,) = state.get
            state.remove()
            yield pd.DataFrame({"key": [key[0]], "expired_at": pd.to_datetime([due], unit="ms")})
            return
        newest = None
        for rows in frames:
            last = rows.loc[rows["at"].idxmax()]
            newest = last if newest is None or last["at"] >= newest["at"] else newest
        if pd.isna(newest["ttl_s"]):
            state.remove()
            return
        due = int(newest["at"].timestamp() * 1000 + newest["ttl_s"] * 1000)
        if due <= state.getCurrentWatermarkMs():
            state.remove()
            yield pd.DataFrame({"key": [key[0]], "expired_at": pd.to_datetime([due], unit="ms")})
            return
        state.update((due,))
        state.setTimeoutTimestamp(due)

    rows = sets.select("key", "at", F.col("ttl_s").cast("double")).withWatermark("at", delay)
    return rows.groupBy("key").applyInPandasWithState(step, "key string, expired_at timestamp", "due bigint", "append", GroupStateTimeout.EventTimeTimeout)
