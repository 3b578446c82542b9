"""State kept as logs: versions, tombstones, ownership, recall and the assembly of a session."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.session import shuffle_partitions


def accepted_updates(updates: DataFrame, key: str, seq: str, expected: str) -> DataFrame:
    """Adds ``accepted`` and ``version``: of each key's updates in the order of ``seq``, one is accepted if it expects the
    version that the accepted ones before it have made, which it raises by one.

    The rows of a key pass through one task in order and none are held; only the key's version is kept. Null keys and
    expectations are never accepted."""
    rows = updates.repartition(shuffle_partitions(updates.sparkSession), key).sortWithinPartitions(key, seq)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    at_key, at_expected = rows.columns.index(key), rows.columns.index(expected)

    def run(batches):
        current, version = None, 0
        for batch in batches:
            keys, wanted = batch.column(at_key).to_pylist(), batch.column(at_expected).to_pylist()
            taken, versions = np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
            for i, (k, e) in enumerate(zip(keys, wanted)):
                if k != current:
                    current, version = k, 0
                if k is not None and e == version:
                    taken[i], version = True, version + 1
                versions[i] = version
            yield pa.record_batch([*batch.columns, pa.array(taken), pa.array(versions)], [*batch.schema.names, "accepted", "version"])

    return rows.mapInArrow(run, f"{schema}, accepted boolean, version long")


def current_rows(log: DataFrame, keys: list[str], order: list[str], deleted: Column) -> DataFrame:
    """The newest row of each key by ``order``, unless it is a deletion. Partial aggregates, so a hot key is no burden."""
    rest = [c for c in log.columns if c not in keys]
    newest = log.withColumn("gone", deleted).groupBy(*keys).agg(F.max_by(F.struct(*rest, "gone"), F.struct(*order)).alias("r"))
    return newest.where("not coalesce(r.gone, false)").select(*keys, *(F.col(f"r.{c}") for c in rest))


def owned(rows: DataFrame, owners: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose session belongs to their user, by ``owners(*keys)``."""
    return rows.join(owners.select(*keys).distinct(), keys, "left_semi")


def out_of_scope(rows: DataFrame, owners: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose session does not belong to their user; a write that has some is to be refused."""
    return rows.join(owners.select(*keys).distinct(), keys, "left_anti")


def available(memories: DataFrame, as_of: str) -> DataFrame:
    """Confirmed and active memories that have not expired at ``as_of``."""
    return memories.where(F.col("confirmed") & F.col("active") & (F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(as_of).cast("timestamp"))))


def top_memories(memories: DataFrame, k: int, *order: Column | str, by: str = "user_id") -> DataFrame:
    """The ``k`` first memories of each user with their ``rank``; the window keeps k rows a user in each task before it
    shuffles."""
    return memories.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def repeated_reads(messages: DataFrame, by: str, order: list[str], keep: int) -> DataFrame:
    """``(by, n_messages, n_reads, n_repeated)``: if every turn reads the ``keep`` messages before it, how often messages
    are read, and how often again. A message is read by as many of the turns after it as ``keep`` allows, so counts of
    the group suffice: of n messages all but the last ``keep`` are read ``keep`` times."""
    n = messages.groupBy(by).agg(F.count("*").alias("n_messages"))
    short = F.least(F.col("n_messages"), F.lit(keep))
    reads = (F.col("n_messages") - short) * keep + (short * (short - 1)) / 2
    once = F.greatest(F.col("n_messages") - 1, F.lit(0))
    return n.select(by, "n_messages", reads.cast("long").alias("n_reads"), (reads - once).cast("long").alias("n_repeated"))


def session_context(sessions: DataFrame, messages: DataFrame, memories: DataFrame, profiles: DataFrame, n_messages: int, n_memories: int) -> DataFrame:
    """``(user_id, history, memories, profile_version)`` of ``sessions(user_id)``: ids of the last messages in order, of the
    first memories, and the profile's version; what is missing is empty or null. ``messages(user_id, seq, message_id)``,
    ``memories(user_id, importance, memory_id)`` and ``profiles(user_id, version)`` are bounded a user before they meet."""
    last = top_memories(messages, n_messages, F.desc("seq"), F.desc("message_id"))
    history = last.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "message_id"))), lambda x: x["message_id"]).alias("history"))
    first = top_memories(memories, n_memories, F.desc("importance"), "memory_id")
    known = first.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "memory_id"))), lambda x: x["memory_id"]).alias("memories"))
    rows = sessions.select("user_id").distinct().join(history, "user_id", "left").join(known, "user_id", "left").join(profiles.select("user_id", F.col("version").alias("profile_version")), "user_id", "left")
    none = lambda rows, c: F.coalesce(c, F.array().cast(rows.schema[c].dataType))
    return rows.select("user_id", none(history, "history").alias("history"), none(known, "memories").alias("memories"), "profile_version")
