"""Sessions, join policy and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping

from pyspark.sql import SparkSession

AUTO_BROADCAST = "spark.sql.autoBroadcastJoinThreshold"
DEFAULT_AUTO_BROADCAST = "10485760b"
SHUFFLE_PARTITIONS = "spark.sql.shuffle.partitions"
INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
MERGED = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
MERGED_BYTES = "32m"
TASK_BYTES = 16 << 20  # of compressed files, whose rows take several times that in a sort or an aggregate

# AQE splits skewed join partitions, even where that costs a shuffle, and merges small ones, so the
# number of shuffle partitions is only the upper bound it starts from. Session windows, which streams
# use, are merged map-side before their shuffle, and the state of streams is kept on disk.
CLUSTER_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sessionWindow.merge.sessions.in.local.partition": "true",
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def build_session(
    app: str, master: str | None = None, options: Mapping[str, str] | None = None
) -> SparkSession:
    """Session with the settings the operators are written for; ``options`` override them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**CLUSTER_DEFAULTS, **(options or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def set_join_policy(spark: SparkSession, auto_broadcast: bool = True) -> SparkSession:
    """Turn automatic broadcast joins on or off for this session.

    Explicit ``broadcast`` hints keep their effect either way. Turning it on keeps a threshold that the
    session has.
    """
    if not auto_broadcast:
        spark.conf.set(AUTO_BROADCAST, "-1")
    elif spark.conf.get(AUTO_BROADCAST, "-1").startswith("-"):
        spark.conf.set(AUTO_BROADCAST, DEFAULT_AUTO_BROADCAST)
    return spark


def join_policy(spark: SparkSession, auto_broadcast: bool = True) -> SparkSession:
    """A sibling session with the given policy; the session passed in is left as it is.

    Plans are made lazily, so a setting switched back after a DataFrame was defined would not
    reach it. DataFrames read through the returned session keep the policy. It shares the context
    and the catalog and starts from the SQL settings of ``spark``.
    """
    return set_join_policy(_sibling(spark), auto_broadcast)


def _sibling(spark: SparkSession) -> SparkSession:
    sibling = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and sibling.conf.isModifiable(key):
            sibling.conf.set(key, value)
    return sibling


def sized_session(spark: SparkSession, size: int, per_task: int = TASK_BYTES) -> SparkSession:
    """A sibling session whose shuffles have a partition for every ``per_task`` of ``size`` bytes of files at least.

    The rows of a task then stay the same as a table grows. Never fewer partitions than ``spark`` has; AQE merges what is
    too small, but in such a session to ``MERGED_BYTES`` of shuffled rows at most.
    """
    sibling = _sibling(spark)
    least = -(-size // per_task)
    for key in (SHUFFLE_PARTITIONS, INITIAL_PARTITIONS):
        now = sibling.conf.get(key, None)
        if now is not None and int(now) < least:
            sibling.conf.set(key, str(least))
    sibling.conf.set(MERGED, MERGED_BYTES)
    return sibling


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which every executor can reach.

    Without that setting a local session gets a temporary folder; a cluster session is refused,
    since a folder of one machine would be lost with it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tidemark-")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
