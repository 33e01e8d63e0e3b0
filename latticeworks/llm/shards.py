"""Sharded storage with size-tiered compaction and a versioned manifest.

Arrivals are appended as small immutable Parquet files. Files of similar size
(one tier: sizes within a factor of ``FAN``) are runs; when a tier has ``FAN``
files or more, they are merged into files of about the target size. Merging
reads whole small files packed to the target, one task for each file it
writes, without a shuffle. Every append and merge commits the next version of
the manifest: the list of files that count, written under a temporary name and
renamed to its number, which fails if that number exists. A failed or repeated
job therefore leaves files behind but never changes what a version holds.

Writers at once: who finds the next version taken reads it and commits the one
after, an append always, a merge if the files it merged still count (if not,
it leaves things as they are). Before a writer writes, it leaves a pending
record of its folder and takes it away after its commit;
:meth:`Store.vacuum` deletes what neither the kept versions nor the pending
records name. A record older than ``GRACE`` seconds is taken for abandoned.

Defined cases: rows come back as they came, with all columns, nulls, very long
texts and repeated rows; an empty arrival commits a version without new files
(the schema is kept in the manifest, so an empty store reads as an empty
table); a column that clashes with the store's own arrival column keeps its
name.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh_path

#: Bytes of a merged file; files of one tier differ by less than FAN times, and FAN of them are merged.
TARGET, FAN = 128 << 20, 4
SMALLEST = 1 << 20
#: Seconds that a writer's files are safe from a vacuum without being committed.
GRACE = 7 * 24 * 3600
#: Files that one job of a merge writes, and commits that a writer tries.
JOB, TRIES = 64, 100


class Conflict(RuntimeError):
    """Another writer committed the version first."""


class Store:
    """A folder of immutable files and numbered manifests."""

    def __init__(self, spark: SparkSession, path: str | None = None, target: int = TARGET):
        self.spark, self.path, self.target = spark, path or fresh_path(spark, "store"), target
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.path).getFileSystem(self._conf)
        for folder in ("manifests", "pending"):
            self._fs.mkdirs(self._path(f"{self.path}/{folder}"))

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/manifests"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """Schema and files (name, bytes, tier) of a version; the last by default."""
        have = self.versions()
        if not have:
            return {"version": 0, "schema": None, "files": []}
        stream = self._fs.open(self._path(f"{self.path}/manifests/{have[-1] if version is None else version:010d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commit(self, before: dict, files: list[dict], schema: str | None) -> dict:
        """The next version with these files; Conflict if it exists already."""
        after = {"version": before["version"] + 1, "schema": schema or before["schema"], "files": sorted(files, key=lambda f: f["name"])}
        temporary = self._path(f"{self.path}/manifests/.{uuid.uuid4().hex}.tmp")
        stream = self._fs.create(temporary, False)
        try:
            stream.write(bytearray(json.dumps(after).encode()))
        finally:
            stream.close()
        jvm, gateway = self.spark._jvm, self.spark._sc._gateway
        final = self._path(f"{self.path}/manifests/{after['version']:010d}.json")
        none = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self._conf)
        try:
            context.rename(self._fs.makeQualified(temporary), self._fs.makeQualified(final), none)
        except Exception as e:
            self._fs.delete(temporary, False)
            if self._fs.exists(final):
                raise Conflict(f"version {after['version']} exists") from e
            raise
        return after

    @contextmanager
    def _pending(self, folder: str) -> Iterator[None]:
        """A record that ``folder`` is being written; it stays if the writer fails."""
        record = self._path(f"{self.path}/pending/{folder.rsplit('/', 1)[1]}")
        self._fs.create(record, False).close()
        yield
        self._fs.delete(record, False)

    def _commit_last(self, change) -> dict:
        """Commit ``change(manifest)``, (files, schema), after the last version, whoever else commits; None changes nothing."""
        for _ in range(TRIES):
            now = self.manifest()
            wanted = change(now)
            if wanted is None:
                return now
            try:
                return self.commit(now, *wanted)
            except Conflict:
                continue
        raise Conflict(f"{TRIES} versions were committed by others first")

    def _files(self, folder: str) -> list[dict]:
        """The Parquet files of a folder within the store."""
        where = self._path(f"{self.path}/{folder}")
        if not self._fs.exists(where):
            return []
        found = [(s.getPath().getName(), s.getLen()) for s in self._fs.listStatus(where)]
        return [{"name": f"{folder}/{n}", "bytes": b, "tier": self.tier(b)} for n, b in found if n.endswith(".parquet")]

    def tier(self, size: int) -> int:
        return max(0, int(math.log(max(size, 1) / SMALLEST, FAN))) if size > SMALLEST else 0

    def append(self, rows: DataFrame) -> dict:
        """One arrival: its files and a new version."""
        folder = f"data/{uuid.uuid4().hex}"
        with self._pending(folder):
            rows.write.parquet(f"{self.path}/{folder}")
            new = self._files(folder)
            return self._commit_last(lambda now: (now["files"] + new, rows.schema.json()))

    def append_each(self, rows: DataFrame, arrival: Column, n: int, merge: bool = True) -> dict:
        """``n`` arrivals, written in one pass and committed one by one; ``arrival`` numbers them from 0.

        After each, tiers that are full are merged."""
        own = "_arrival"
        while own in rows.columns:
            own += "_"
        folder = f"data/{uuid.uuid4().hex}"
        with self._pending(folder):
            rows.withColumn(own, arrival).write.partitionBy(own).parquet(f"{self.path}/{folder}")
            now = self.manifest()
            for i in range(n):
                new = self._files(f"{folder}/{own}={i}")
                now = self._commit_last(lambda m, new=new: (m["files"] + new, rows.schema.json()))
                if merge:
                    now = self.compact()
        return now

    def full_tiers(self, files: list[dict]) -> list[dict]:
        """Files to merge: those below half the target in tiers of at least FAN files that can fill one of the next tier."""
        by_tier: dict[int, list[dict]] = {}
        for f in files:
            if f["bytes"] < self.target // 2:
                by_tier.setdefault(f["tier"], []).append(f)
        out = []
        for own in by_tier.values():
            size = sum(f["bytes"] for f in own)
            if len(own) >= FAN and size >= min(self.target, FAN * max(f["bytes"] for f in own)):
                out += own
        return out

    def packed(self, files: list[dict]) -> list[list[dict]]:
        """Files, the largest first, in bins of the target size at most."""
        bins: list[tuple[int, list[dict]]] = []
        for f in sorted(files, key=lambda f: (-f["bytes"], f["name"])):
            if not bins or bins[-1][0] + f["bytes"] > self.target:
                bins.append((0, []))
            bins[-1] = (bins[-1][0] + f["bytes"], [*bins[-1][1], f])
        return [own for _, own in bins]

    def compact(self, everything: bool = False) -> dict:
        """Merge full tiers (or all small files) into files of about the target size."""
        now = self.manifest()
        chosen = [f for f in now["files"] if f["bytes"] < self.target // 2] if everything else self.full_tiers(now["files"])
        if len(chosen) < 2:
            return now
        bins, folder = self.packed(chosen), f"data/{uuid.uuid4().hex}"
        gone = {f["name"] for f in chosen}

        def swapped(last: dict) -> tuple[list[dict], None] | None:
            have = {f["name"] for f in last["files"]}
            return ([f for f in last["files"] if f["name"] not in gone] + self._files(folder), None) if gone <= have else None

        with self._pending(folder):
            for lo in range(0, len(bins), JOB):
                # one task a file: it reads its bin's files whole
                parts = [self._read(own, now["schema"]).coalesce(1) for own in bins[lo : lo + JOB]]
                every = parts[0]
                for p in parts[1:]:
                    every = every.unionAll(p)
                every.write.mode("append").parquet(f"{self.path}/{folder}")
            return self._commit_last(swapped)

    def _read(self, files: list[dict], schema: str) -> DataFrame:
        kind = T.StructType.fromJson(json.loads(schema))
        if not files:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*(f"{self.path}/{f['name']}" for f in files))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version."""
        m = self.manifest(version)
        if m["schema"] is None:
            raise ValueError("nothing was appended yet")
        return self._read(m["files"], m["schema"])

    def vacuum(self, keep: int = 1, grace: float = GRACE) -> int:
        """Delete data that neither the last ``keep`` versions nor pending writers name, and older manifests; files deleted.

        Files are listed first, then pending records, then versions: a writer that
        commits meanwhile is seen in one of the two."""
        there = []
        if self._fs.exists(self._path(f"{self.path}/data")):
            every = self._fs.listFiles(self._path(f"{self.path}/data"), True)
            while every.hasNext():
                there.append(every.next().getPath())
        safe, old = set(), []
        for s in self._fs.listStatus(self._path(f"{self.path}/pending")):
            if s.getModificationTime() / 1000 >= time.time() - grace:
                safe.add(s.getPath().getName())
            else:
                old.append(s.getPath())
        versions = self.versions()
        named = {f["name"] for v in versions[-keep:] for f in self.manifest(v)["files"]}
        root = self._fs.makeQualified(self._path(self.path)).toString().rstrip("/") + "/"
        n = 0
        for p in there:
            name = p.toString().removeprefix(root)
            if p.getName().endswith(".parquet") and name not in named and name.split("/")[1] not in safe:
                self._fs.delete(p, False)
                n += 1
        for v in versions[:-keep]:
            self._fs.delete(self._path(f"{self.path}/manifests/{v:010d}.json"), False)
        for p in old:
            self._fs.delete(p, False)
        return n


def arrivals(id_col: str, n: int) -> Column:
    """Deals rows over n arrivals by a hash of the id."""
    return F.pmod(F.xxhash64(F.col(id_col)), F.lit(n)).cast("int")


def reshard(rows: DataFrame, n: int = 8, id_col: str = "doc_id", target: int = TARGET) -> DataFrame:
    """Rows as they come back from a store to which they came in n arrivals, tiers merged on the way."""
    store = Store(rows.sparkSession, target=target)
    store.append_each(rows, arrivals(id_col, n), n)
    store.vacuum()
    return store.read()
