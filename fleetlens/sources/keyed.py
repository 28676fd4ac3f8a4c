"""Tables of the latest row of each key, replaced as a whole or not at all.

A table stands in buckets of its key. A merge rewrites the buckets that the new rows touch, under a new version's folder, and then
puts a manifest that says for each bucket which version holds it: one file that appears by a rename. Readers take the newest
manifest, so they never see half a merge; a merge that failed leaves a folder that no manifest names. A version
that has its manifest is not merged again, so a micro-batch that Spark repeats changes nothing. Nothing has to be compacted, as
a bucket is always whole; folders that only old manifests name are removed.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.operators.history import latest
from fleetlens.sources.shared import Files

KEPT = 3


class KeyedTable:
    """key: its columns; order: what says which row of a key is the latest; by: the columns of the key that deal it into buckets."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], order: list[str], by: list[str] | None = None, buckets: int = 16) -> None:
        self.spark, self.path, self.schema, self.key, self.order = spark, path, schema, key, order
        self.by, self.buckets, self.files = by or key, buckets, Files(spark, path)

    def bucket(self) -> Column:
        return F.expr(f"CAST(pmod(xxhash64({', '.join(self.by)}), {self.buckets}) AS INT)")

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self.files.names("manifests") if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict[int, int]:
        """Which version holds each bucket, as of a version (the newest)."""
        known = self.versions()
        if not known:
            return {}
        rows = self.spark.read.text(f"{self.path}/manifests/{known[-1] if version is None else version:012d}.json", wholetext=True).first()
        return {int(b): v for b, v in json.loads(rows[0]).items()}

    def read(self, buckets: list[int] | None = None, version: int | None = None) -> DataFrame:
        held = self.manifest(version)
        paths = [f"{self.path}/data/{v}/_b={b}" for b, v in held.items() if buckets is None or b in buckets]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets of some rows: as many numbers as the table has buckets, at most."""
        return [r[0] for r in rows.select(self.bucket()).distinct().collect()]

    def dealt(self, rows: DataFrame) -> DataFrame:
        """rows with `_b`, a task for each bucket."""
        return rows.withColumn("_b", self.bucket()).repartitionById(self.buckets, "_b")

    def merge(self, rows: DataFrame, version: int, buckets: list[int] | None = None) -> bool:
        """Keeps the latest of what is there and of rows, which touch some buckets (None: looked up, by making rows once more). False
        where the version is there already. Rows move once: a bucket is merged in the task that writes it."""
        known = self.versions()
        if known and known[-1] >= version:
            return False
        columns = self.spark.createDataFrame([], self.schema).columns
        rows = rows.select(*columns)
        buckets = self.touched(rows) if buckets is None else buckets
        both = self.dealt(self.read(buckets).unionByName(rows))
        return self._put(latest(both, [*self.key, "_b"], self.order).select(*columns, "_b"), buckets, version)

    def replace(self, rows: DataFrame, buckets: list[int], version: int) -> bool:
        """Puts rows in the place of some buckets."""
        return self._put(self.dealt(rows), buckets, version)

    def _put(self, rows: DataFrame, buckets: list[int], version: int) -> bool:
        known, held = self.versions(), self.manifest()
        if buckets:
            # a bucket without rows has no folder, and no place in the manifest
            rows.write.mode("overwrite").partitionBy("_b").parquet(f"{self.path}/data/{version}")
        made = {int(n.removeprefix("_b=")) for n in self.files.names(f"data/{version}") if n.startswith("_b=")} if buckets else set()
        held = {b: v for b, v in held.items() if b not in buckets} | dict.fromkeys(sorted(made), version)
        if not self.files.put(f"manifests/{version:012d}.json", json.dumps(held)):
            return False
        self._clean([*known, version])
        return True

    def back_to(self, version: int) -> None:
        """Forgets what was merged after a version (one of the last)."""
        for v in self.versions():
            if v > version:
                self.files.delete(f"manifests/{v:012d}.json")

    def _clean(self, known: list[int]) -> None:
        """Leaves the last manifests and what they name; readers of older ones have had their time."""
        kept = known[-KEPT:]
        named = {v for k in kept for v in self.manifest(k).values()}
        for v in known[:-KEPT]:
            self.files.delete(f"manifests/{v:012d}.json")
        for name in self.files.names("data"):
            if int(name) not in named and int(name) <= known[-1]:
                self.files.delete(f"data/{name}")


class StatusHistory:
    """Status rows of every tick, and the latest row of each key beside them. A tick's rows stand under a folder that is new for each
    write, and one manifest names them all: a tick that is written again is replaced in one step. `latest` reads the rows of one
    table, however long the history is."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], order: list[str], buckets: int = 16) -> None:
        self.spark, self.path, self.schema, self.key, self.order = spark, path, schema, key, order
        self.files = Files(spark, path)
        self.current = KeyedTable(spark, f"{path}/current", schema, key, order, buckets=buckets)

    def _ticks(self) -> tuple[int, dict[str, int]]:
        """The newest write, and which write holds each tick."""
        names = [n for n in self.files.names("ticks") if n.endswith(".json")]
        if not names:
            return -1, {}
        return int(names[-1].removesuffix(".json")), json.loads(self.spark.read.text(f"{self.path}/ticks/{names[-1]}", wholetext=True).first()[0])

    def write(self, rows: DataFrame, tick: str) -> None:
        """Keeps rows as those of a tick, in place of what it had. A write that fails on the way can be made again."""
        last, held = self._ticks()
        number = last + 1
        self.current.back_to(last)  # of a write that failed after its merge
        rows.write.mode("overwrite").parquet(f"{self.path}/rows/{number}")
        new = self.spark.read.schema(self.schema).parquet(f"{self.path}/rows/{number}")
        if tick in held:
            # keys of the tick are judged from all their history, others stay
            keys = self.history([tick]).select(*self.key).unionByName(new.select(*self.key)).distinct()
            rest = self.history([t for t in held if t != tick]).join(keys, self.key, "left_semi")
            buckets = self.current.touched(keys)
            others = self.current.read(buckets).join(keys, self.key, "left_anti")
            self.current.replace(others.unionByName(latest(rest.unionByName(new), self.key, self.order).select(*new.columns)), buckets, number)
        else:
            self.current.merge(new, number)
        if not self.files.put(f"ticks/{number:012d}.json", json.dumps(held | {tick: number})):
            raise RuntimeError(f"another writer has put write {number}")
        if tick in held:
            self.files.delete(f"rows/{held[tick]}")

    def history(self, ticks: list[str] | None = None) -> DataFrame:
        """The rows of some ticks (all); only their folders are read."""
        held = self._ticks()[1]
        paths = [f"{self.path}/rows/{n}" for t, n in held.items() if ticks is None or t in ticks]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def latest(self) -> DataFrame:
        """The latest row of each key, as of the newest write that is whole."""
        version = self._ticks()[0]
        return self.current.read(version=version) if version >= 0 else self.spark.createDataFrame([], self.schema)
