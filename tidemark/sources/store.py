"""Snapshots of a cumulative table, a bucketed folder for each period, and tables that are updated by key.

A snapshot store keeps every period; a step from one period to the next reads the one before and joins it with the new
rows, and since it is bucketed by the key, only the new rows are shuffled. A keyed table keeps one row for each key; an
update rewrites only the buckets that have a changed key, and the others stay the files they are.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.sources.versions import ConcurrentWrite, VersionLog, bucket_of, read_buckets, write_buckets

BUCKETS = 16
ATTEMPTS = 5
DAY = 86_400.0


class SnapshotStore:
    """Snapshots below ``path``, one for each value of the column ``period``, in buckets of ``keys``.

    The number of buckets is that of the first write: choose it so that a bucket of a period fits a task.
    """

    def __init__(
        self, spark: SparkSession, path: str, schema: StructType, period: str, keys: Sequence[str], buckets: int = BUCKETS
    ):
        self.spark, self.schema, self.period, self.keys = spark, schema, period, list(keys)
        self.log = VersionLog(spark, path)
        self.buckets = self.log.read().get("buckets", buckets)

    def periods(self, version: int | None = None) -> dict[str, dict[str, Any]]:
        """Folder and rows of each stored period, by its text."""
        return self.log.read(version).get("periods", {})

    def read(self, period: Any, version: int | None = None) -> DataFrame:
        """One period, bucketed; empty if it is not stored. Nothing else is listed or read."""
        found = self.periods(version).get(str(period))
        if found is None:
            return self.spark.createDataFrame([], self.schema)
        return read_buckets(self.spark, f"{self.log.path}/{found['folder']}", self.schema, self.keys, self.buckets)

    def read_all(self, version: int | None = None) -> DataFrame:
        """All periods of a version, as one scan over their folders."""
        folders = [f"{self.log.path}/{p['folder']}" for p in self.periods(version).values() if p["rows"]]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def write(self, df: DataFrame, period: Any, clustered: bool = False) -> int:
        """Make ``df`` the snapshot of ``period``, in place of what it was; the number of its rows.

        ``df`` runs once. An empty one clears the period. Rows of another period are an error, and so is a writer that
        publishes the same period meanwhile; either leaves the last version as it was.
        """
        before = self.log.read()
        stored, folder = before.get("periods", {}).get(str(period)), f"data/{period}-{uuid.uuid4().hex}"
        rows = df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema))
        other = F.count_if(~F.col(self.period).eqNullSafe(F.lit(period).cast(self.schema[self.period].dataType)))
        seen = write_buckets(rows, f"{self.log.path}/{folder}", self.keys, self.buckets, clustered, other=other)
        if seen["other"]:
            raise ValueError(f"{seen['other']} rows are not of {self.period} {period}")
        for _ in range(ATTEMPTS):
            periods = {**before.get("periods", {}), str(period): {"folder": folder, "rows": seen["rows"]}}
            try:
                self.log.publish(before["version"], {"buckets": self.buckets, "periods": periods})
                return seen["rows"]
            except ConcurrentWrite:
                before = self.log.read()
                if before.get("periods", {}).get(str(period)) != stored:
                    raise
        raise ConcurrentWrite(f"{self.log.path}: other writers were faster {ATTEMPTS} times")

    def advance(self, before: Any, period: Any, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Store ``step(snapshot of before)`` as ``period`` and read it back."""
        known = str(before) in self.periods()
        # The step joins the stored buckets on their keys, so its rows are dealt like them.
        self.write(step(self.read(before)), period, clustered=known)
        return self.read(period)

    def fold(self, periods: Iterable[Any], step: Callable[[DataFrame, Any], DataFrame], start: Any = None) -> DataFrame:
        """Store ``step(snapshot before, period)`` for each period in turn; all that is stored.

        The first one follows ``start``, or the stored period right before it; so a loop goes on where another ended.
        Whole-number periods must follow each other, so a gap is refused.
        """
        before = start
        for period in periods:
            if before is None and isinstance(period, int):
                earlier = [int(p) for p, found in self.periods().items() if int(p) < period and found["rows"]]
                before = max(earlier, default=None)
            if isinstance(period, int) and before is not None and before != period - 1:
                raise ValueError(f"period {period - 1} is not stored, but {before} is")
            self.advance(before, period, lambda stored, period=period: step(stored, period))
            before = period
        return self.read_all()

    def vacuum(self, keep: int = 1, older_than: float = DAY) -> list[str]:
        """Delete what none of the last ``keep`` versions points to; the names of the folders that went."""
        last = self.log.latest()
        named = {p["folder"] for v in range(max(1, last - keep + 1), last + 1) for p in self.periods(v).values()}
        return self.log.vacuum(named, keep, older_than)


class KeyedTable:
    """A table below ``path`` with one row for each key, updated in place, bucket by bucket."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: Sequence[str], buckets: int = BUCKETS):
        self.spark, self.schema, self.keys = spark, schema, list(keys)
        self.log = VersionLog(spark, path)
        self.buckets = self.log.read().get("buckets", buckets)

    def files(self, version: int | None = None) -> dict[str, list[str]]:
        """The files of each bucket, by its number."""
        return self.log.read(version).get("files", {})

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the last one if none is given."""
        return self._rows([f for files in self.files(version).values() for f in files])

    def _typed(self, df: DataFrame) -> DataFrame:
        return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema))

    def has_batch(self, writer: str, number: int) -> bool:
        """Whether that batch of the writer, or a later one, is in the table."""
        return self.log.read().get("batches", {}).get(writer, -1) >= number

    def _rows(self, files: Sequence[str]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.log.path}/{f}" for f in files))

    def _write(self, df: DataFrame) -> dict[str, list[str]]:
        """``df`` in new files; those of each bucket that has rows."""
        folder = f"data/{uuid.uuid4().hex}"
        write_buckets(df, f"{self.log.path}/{folder}", self.keys, self.buckets)
        found: dict[str, list[str]] = {}
        for name in sorted(self.log.names(folder)):
            if name.startswith("part-"):
                found.setdefault(str(bucket_of(name)), []).append(f"{folder}/{name}")
        return found

    def upsert(self, new: DataFrame, batch: tuple[str, int] | None = None, add: bool = False) -> int:
        """Rows of ``new``, one for each key (NULL is a key), in place of stored ones with their key; the version.

        With ``add`` the columns besides the keys are added to the stored values instead, as sums and counts that go on.

        The new rows are written first, in the buckets of the table, so their files tell which buckets change; only
        those are read, merged and written anew. ``batch`` names a writer and the number of its batch: a number that
        the log has already, or a smaller one, is a repeated batch and changes nothing. The number is published with
        the data, so a crash before that leaves neither, and after it both.
        """
        rows = self._typed(new)
        fresh = None
        for _ in range(ATTEMPTS):
            before = self.log.read()
            batches = before.get("batches", {})
            if batch is not None and batches.get(batch[0], -1) >= batch[1]:
                return before["version"]
            fresh = self._write(rows) if fresh is None else fresh
            stored = before.get("files", {})
            changed = {b: files for b, files in fresh.items() if b in stored}
            merged = dict(fresh)
            if changed:
                added = self._rows([f for files in changed.values() for f in files])
                old = self._rows([f for b in changed for f in stored[b]])
                if add:
                    sums = [F.sum(f.name).alias(f.name) for f in self.schema if f.name not in self.keys]
                    both = old.unionByName(added).groupBy(*self.keys).agg(*sums)
                else:
                    same = reduce(Column.__and__, (old[k].eqNullSafe(added[k]) for k in self.keys))
                    both = old.join(added, same, "left_anti").unionByName(added)
                merged |= self._write(self._typed(both))
            content = {
                "buckets": self.buckets,
                "files": {**stored, **merged},
                "batches": batches if batch is None else {**batches, batch[0]: batch[1]},
            }
            try:
                return self.log.publish(before["version"], content)
            except ConcurrentWrite:
                continue
        raise ConcurrentWrite(f"{self.log.path}: other writers were faster {ATTEMPTS} times")

    def vacuum(self, keep: int = 1, older_than: float = DAY) -> list[str]:
        """Delete folders that none of the last ``keep`` versions has files in; the names of those that went."""
        last = self.log.latest()
        versions = range(max(1, last - keep + 1), last + 1)
        named = {f.rpartition("/")[0] for v in versions for files in self.files(v).values() for f in files}
        return self.log.vacuum(named, keep, older_than)
