"""Keyed tables for streams and repeated jobs: rows in buckets of their key, written batch by batch, merged as they grow.

A batch is one folder with a sub-folder per bucket of the key's hash. What a batch has to know of the table lies in the buckets that its own
keys fall into, and only their key columns are read. Every ``merge_every`` folders of one size are merged to one folder
with one row per key, so that the folders stay few and a row is rewritten a logarithmic number of times. A small
manifest per batch names the folders that make up the table; a repeated batch writes the same folders and the same manifest
again, so a restart neither doubles nor loses rows. Nothing is changed in place: readers of an older manifest are not disturbed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from merchloom.operators.dedup import has_key
from merchloom.operators.ranking import first_per_key

BUCKET, FOLDER = "_bucket", "_folder"
_MANIFEST = "version BIGINT, folders ARRAY<STRUCT<name: STRING, level: INT>>"


@dataclass
class KeyedTable:
    """A table under ``path`` with one row per key.

    ``buckets`` bounds what a batch reads: about its share of the table for every bucket its keys fall into. Choose it
    by the rows that are expected; it must not change afterwards. Rows with a null or blank key are never stored.
    Of several rows of a key the first in ``order`` stands, whichever batch brought it; where that leaves a tie, or without
    an order, the one of the latest batch.
    """

    spark: SparkSession
    path: str
    schema: T.StructType
    keys: Sequence[str]
    buckets: int = 64
    merge_every: int = 8
    order: Sequence[Column] = ()

    def _folders(self, before: int | None = None) -> list[tuple[str, int]]:
        """(name, level) of the folders of the newest version, or of the newest one before a version."""
        try:
            found = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest/*")
        except AnalysisException:  # nothing has been written yet
            return []
        found = found if before is None else found.where(F.col("version") < before)
        newest = found.orderBy(F.desc("version")).limit(1).collect()
        return [(f["name"], f["level"]) for f in newest[0]["folders"]] if newest else []

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.where(has_key(self.keys)).withColumn(BUCKET, F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _stored(self, folders: Sequence[tuple[str, int]]) -> DataFrame | None:
        """All rows of the folders with their bucket and the number of their folder, later ones being greater."""
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema.fields)
        parts = [self.spark.read.schema(f"{ddl}, {BUCKET} INT").parquet(f"{self.path}/data/{name}").withColumn(FOLDER, F.lit(at))
                 for at, (name, _) in enumerate(folders)]
        if not parts:
            return None
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        return whole

    def _newest(self, rows: DataFrame) -> DataFrame:
        return first_per_key(rows, [BUCKET, *self.keys], [*self.order, F.desc(FOLDER)]).drop(FOLDER)

    def _write(self, rows: DataFrame, name: str) -> None:
        # a task per bucket at most, so a batch leaves one file a bucket
        rows.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.path}/data/{name}")

    def _commit(self, rows: DataFrame, version: int, folders: list[tuple[str, int]]) -> None:
        name = f"{version:012d}-0"
        self._write(rows, name)
        folders = [*folders, (name, 0)]
        level = 0
        while sum(at == level for _, at in folders) >= self.merge_every:
            merged = [f for f in folders if f[1] == level]
            name = f"{version:012d}-{level + 1}"
            self._write(self._newest(self._stored(merged)), name)
            # folders of a level lie next to each other, so the merged one takes their place in time
            first = folders.index(merged[0])
            folders = [*folders[:first], (name, level + 1), *folders[first + len(merged):]]
            level += 1
        entry = self.spark.createDataFrame([(version, [{"name": n, "level": at} for n, at in folders])], _MANIFEST)
        entry.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/{version:012d}")

    def known_keys(self, buckets: Sequence[int], before: int | None = None) -> DataFrame | None:
        """The stored keys of some buckets; other buckets are not read."""
        stored = self._stored(self._folders(before))
        return None if stored is None else stored.where(F.col(BUCKET).isin(list(buckets))).select(BUCKET, *self.keys)

    def insert_absent(self, batch: DataFrame, version: int, last_first: Sequence[Column], also: DataFrame | None = None) -> None:
        """Store the rows whose key is neither stored nor in ``also``; of several rows of a key in the batch the first in ``last_first``."""
        fresh = self._bucketed(first_per_key(batch.where(has_key(self.keys)), list(self.keys), [*last_first, *[F.desc(c) for c in batch.columns]]))
        touched = [r[BUCKET] for r in fresh.select(BUCKET).distinct().collect()]  # at most ``buckets`` numbers
        known = self.known_keys(touched, version)
        if known is not None:
            fresh = fresh.join(known, [BUCKET, *self.keys], "left_anti")
        if also is not None:
            fresh = fresh.join(also.select(*self.keys).distinct(), list(self.keys), "left_anti")
        self._commit(fresh, version, self._folders(version))

    def put(self, batch: DataFrame, version: int, order: Sequence[Column]) -> None:
        """Store rows in place of those of the same key; of several rows of a key in the batch the first in ``order``. Nothing is read."""
        newest = first_per_key(batch.where(has_key(self.keys)), list(self.keys), [*order, *[F.desc(c) for c in batch.columns]])
        self._commit(self._bucketed(newest), version, self._folders(version))

    def rows(self) -> DataFrame:
        """One row per key, the newest or the first in ``order``."""
        stored = self._stored(self._folders())
        if stored is None:
            return self.spark.createDataFrame([], self.schema)
        return self._newest(stored).drop(BUCKET).select(*self.schema.names)
