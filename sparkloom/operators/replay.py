"""Key-value commands in set form: a log of commands over all keys, folded into state by one plan.

The log has rows (seq, op, key, field, value). State is rows (key, type, field, value): a string has one with
an empty field, a hash one a field, a set one a member, a sorted set one a member with its score; a large
value is many rows and no single one. Commands that overwrite are max_by on (key, field), counters are sums, both
combined before the shuffle, so one key may have any share of the log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOG = "seq bigint, op string, key string, field string, value string"
_TYPE = {"SET": "string", "INCRBY": "string", "HSET": "hash", "HDEL": "hash", "SADD": "set", "SREM": "set", "ZADD": "zset", "ZREM": "zset"}


def replay(log: DataFrame) -> DataFrame:
    """State after SET, DEL, INCRBY, HSET, HDEL, SADD, SREM, ZADD and ZREM, in order of seq (unique).

    SET and DEL end what a key was before; a command of another type than the key has then fails and changes
    nothing: the type is that of the first command after the last end. INCRBY starts at the SET value, or 0;
    on a value that is no integer it fails. Null keys, null or unknown ops are ignored; a null field or value is the empty text, and a null or unreadable INCRBY adds nothing.
    """
    # a SET ends the former value and is the first command of the next
    ops = log.where(F.col("key").isNotNull() & (F.col("op") == "DEL") | F.col("key").isNotNull() & F.col("op").isin(*_TYPE))
    ops = ops.select("seq", "op", "key", F.coalesce("field", F.lit("")).alias("field"), F.coalesce("value", F.lit("")).alias("value"))
    kind = F.create_map(*[F.lit(x) for pair in _TYPE.items() for x in pair])[F.col("op")]
    ops = ops.withColumn("type", kind).withColumn("field", F.when(F.col("type") == "string", "").otherwise(F.col("field")))
    ended = ops.where("op IN ('SET', 'DEL')").groupBy("key").agg(F.max("seq").alias("end"))
    later = ops.join(ended, "key", "left").where("end IS NULL OR seq >= end").where("op <> 'DEL'")
    first = later.where("op NOT IN ('HDEL', 'SREM', 'ZREM')").groupBy("key").agg(F.min_by("type", "seq").alias("is"))
    typed = later.join(first, "key").where(F.col("type") == F.col("is"))
    added = F.when(F.col("op") == "INCRBY", F.expr("try_cast(value AS bigint)"))
    newest = typed.groupBy("key", "type", "field").agg(
        F.max_by("op", "seq").alias("op"),
        F.max_by("value", "seq").alias("value"),
        F.max(F.when(F.col("op") == "SET", F.col("value"))).alias("base"),
        F.coalesce(F.sum(added), F.lit(0)).alias("added"),
    )
    start = F.coalesce("base", F.lit("0"))
    number = F.expr("try_cast(coalesce(base, '0') AS bigint)")
    text = F.when(F.col("added") == 0, start).when(number.isNull(), F.col("base")).otherwise((number + F.col("added")).cast("string"))
    value = F.when(F.col("type") == "string", text).when(F.col("type") == "set", F.lit("")).otherwise(F.col("value"))
    return newest.where("op NOT IN ('HDEL', 'SREM', 'ZREM')").select("key", "type", "field", value.alias("value"))
