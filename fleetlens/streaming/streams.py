"""Stream forms of the operators, on stock Structured Streaming."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, StructField, StructType

from fleetlens.operators.decisions import cluster_status, gathered
from fleetlens.operators.members import KEY
from fleetlens.sources.keyed import KeyedTable
from fleetlens.sources.shared import Files, folder, remove

#: About how many rows of a replayed micro-batch one task writes.
FILE_ROWS = 1 << 18


def probe_ticks(probes: DataFrame, tick: str = "1 hour", late: str = "30 seconds") -> DataFrame:
    """Probes, healthy ones and endpoints of each cluster and tick. A tick comes out once the watermark has passed it."""
    w = probes.withWatermark("ts", late).groupBy(F.window("ts", tick).alias("w"), "cluster_id")
    counted = w.agg(F.count("*").alias("probes"), F.count_if("health").alias("healthy"), F.approx_count_distinct("ordinal").alias("endpoints"))
    return counted.select("cluster_id", F.col("w.start").alias("tick"), "probes", "healthy", "endpoints")


def dedup_probes(probes: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each probe once, however often it is delivered within the watermark."""
    return probes.withWatermark("ts", late).dropDuplicatesWithinWatermark(["probe_id"])


class _Ordered(StatefulProcessor):
    """Keeps rows until the watermark has passed them, so that they are taken in order of time however they came."""

    def later(self, us: int) -> None:
        """Asks to be called once the watermark has passed a time."""
        self.handle.registerTimer(us // 1000 + 1)

    def close(self) -> None:
        pass


class _Transitions(_Ordered):
    """Keeps a key's last status; emits a row when it changes. A key that is idle for longer than `idle` is forgotten: its next row
    counts as its first."""

    def __init__(self, idle: int) -> None:
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us bigint, probe_id bigint, status string")
        self.last = handle.getValueState("last", "status string, run bigint, us bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = [(int(u), int(p), s) for pdf in rows for u, p, s in zip(pdf["us"], pdf["probe_id"], pdf["status"])]
        self.waiting.appendList(new)
        self.later(min(new)[0])
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(self.waiting.get(), key=lambda r: (r[0], r[1])) if self.waiting.exists() else []
        due, rest = [r for r in rows if r[0] < now], [tuple(r) for r in rows if r[0] >= now]
        status, run, until = self.last.get() if self.last.exists() else (None, 0, 0)
        out = []
        for us, probe, said in due:
            if run and us - until > self.idle:
                run = 0
            if run == 0 or said != status:
                status, run = said, run + 1
                out.append((key[0], key[1], probe, us, status, run))
            until = us
        if due:
            self.last.update((status, run, until))
            self.waiting.clear()
            if rest:
                self.waiting.put(rest)
        if rest:
            self.later(rest[0][0])
        elif run:
            if now - until > self.idle:
                self.last.clear()
            else:
                self.later(until + self.idle)
        yield pd.DataFrame(out, columns=["cluster_id", "ordinal", "probe_id", "us", "status", "run"])


def condition_transitions(rows: DataFrame, late: str = "10 minutes", idle: str = "90 days") -> DataFrame:
    """(cluster_id, ordinal, probe_id, ts, status, run). A row comes out once the watermark, `late` behind the newest time, has passed it;
    rows that come behind the watermark are dropped. Rows may come in any order before that. Needs the RocksDB state store."""
    timed = rows.withWatermark("ts", late).withColumn("us", F.unix_micros("ts")).select("cluster_id", "ordinal", "probe_id", "ts", "us", "status")
    schema = "cluster_id bigint, ordinal bigint, probe_id bigint, us bigint, status string, run bigint"
    out = timed.groupBy("cluster_id", "ordinal").transformWithStateInPandas(_Transitions(_us(idle)), schema, "Append", "EventTime")
    return out.select("cluster_id", "ordinal", "probe_id", F.timestamp_micros("us").alias("ts"), "status", "run")


class _FirstReady(_Ordered):
    """Keeps open changes, and reports that one of them or a later one can still meet."""

    def __init__(self, deadline: int) -> None:
        self.deadline = deadline

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "us bigint, change_id bigint")
        self.reports = handle.getListState("reports", "us bigint")

    def _wait(self, changes: list[tuple[int, int]], reports: list[int]) -> None:
        """Keeps both, and asks for the first time at which one of them is settled."""
        for state, rows in ((self.open, changes), (self.reports, [(r,) for r in reports])):
            state.clear()
            if rows:
                state.put(rows)
        times = [min([r for r in reports[bisect_left(reports, us) :][:1]] + [us + self.deadline]) for us, _ in changes]
        if times or reports:
            self.later(min(times) if times else reports[-1])

    def _known(self) -> tuple[set, set]:
        return {tuple(r) for r in self.open.get()} if self.open.exists() else set(), {r[0] for r in self.reports.get()} if self.reports.exists() else set()

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        changes, reports = self._known()
        for pdf in rows:
            for us, change, is_change in zip(pdf["us"], pdf["change_id"], pdf["is_change"]):
                if is_change:
                    changes.add((int(us), int(change)))
                else:
                    reports.add(int(us))
        self._wait(sorted(changes), sorted(reports))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        changes, reports = map(sorted, self._known())
        out, left = [], []
        for us, change in changes:
            first = next(iter(reports[bisect_left(reports, us) :][:1]), None)
            met = first is not None and first <= us + self.deadline
            if met and first < now or not met and us + self.deadline < now:
                out.append((key[0], change, us, first if met else None))
            else:
                left.append((us, change))
        # a change that is yet to come is not behind the watermark
        since = min([now, *(us for us, _ in left)])
        self._wait(left, reports[bisect_left(reports, since) :])
        yield pd.DataFrame(out, columns=["cluster_id", "change_id", "us", "ready_us"]).astype({"ready_us": "Int64"})


def time_to_ready(changes: DataFrame, ready: DataFrame, deadline: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """(cluster_id, change_id, ts, ready_at): one row for each change, when the watermark passes its first ready report inside the deadline
    or, without one, the deadline. Rows that come behind the watermark are dropped. Needs the RocksDB state store."""
    both = changes.select("cluster_id", "change_id", "ts", F.lit(True).alias("is_change")).unionByName(ready.select("cluster_id", F.lit(0).cast("bigint").alias("change_id"), "ts", F.lit(False).alias("is_change")))
    timed = both.withWatermark("ts", late).withColumn("us", F.unix_micros("ts"))
    schema = "cluster_id bigint, change_id bigint, us bigint, ready_us bigint"
    out = timed.groupBy("cluster_id").transformWithStateInPandas(_FirstReady(_us(deadline)), schema, "Append", "EventTime")
    return out.select("cluster_id", "change_id", F.timestamp_micros("us").alias("ts"), F.timestamp_micros("ready_us").alias("ready_at"))


def _us(interval: str) -> int:
    return int(pd.Timedelta(interval).total_seconds() * 1_000_000)


class FleetStatus:
    """The status of every cluster, kept up from one stream of tagged rows of all feeds: (cluster_id, feed, item, version, deleted, a
    struct for each feed). The latest version of each item is state; each micro-batch gathers the clusters that it touches
    again and replaces their status. A batch that Spark repeats changes nothing, also if it ended between the two tables."""

    def __init__(self, spark: SparkSession, path: str, rows: StructType, buckets: int = 16) -> None:
        self.state = KeyedTable(spark, f"{path}/state", rows, [KEY, "feed", "item"], ["version"], [KEY], buckets)
        empty = spark.createDataFrame([], rows)
        self.status = KeyedTable(spark, f"{path}/status", self.status_of(empty, empty.select(KEY)).schema, [KEY], ["version"], buckets=buckets)

    @staticmethod
    def status_of(rows: DataFrame, clusters: DataFrame) -> DataFrame:
        """The status of clusters by their tagged rows, and a deleted row for those without a spec."""
        now = cluster_status(gathered(rows.filter("NOT deleted").join(clusters, KEY, "left_semi")), F.col("version"))
        return clusters.join(now, KEY, "left").withColumns({"version": F.lit(0).cast("bigint"), "deleted": F.col("observed_generation").isNull() & F.col("member_count").isNull()})

    def apply(self, batch: DataFrame, number: int) -> None:
        """For foreachBatch. Both tables deal clusters into the same buckets, and what a batch touches is looked up once."""
        batch = batch.select(*self.state.schema.names)
        clusters = batch.select(KEY).distinct().persist()
        try:
            buckets = self.state.touched(clusters)
            self.state.merge(batch, number, buckets)
            status = self.status_of(self.state.read(buckets, number), clusters)
            self.status.merge(status.withColumn("version", F.lit(number).cast("bigint")), number, buckets)
        finally:
            clusters.unpersist()

    def current(self) -> DataFrame:
        return self.status.read().filter("NOT deleted").drop("deleted", "version")


def replay(rows: DataFrame, path: str, batches: list[Column]) -> DataFrame:
    """rows as a file stream that gives those of each condition in a micro-batch of its own, in this order. rows are made once, and many
    tasks write a batch: each has as many files as the largest needs, empty ones where it has too few, as a trigger takes so many."""
    spark = rows.sparkSession
    which = F.explode(F.array_compact(F.array(*[F.when(condition, k) for k, condition in enumerate(batches)])))
    made = folder(spark, "replay")
    rows.withColumn("_batch", which).write.partitionBy("_batch").parquet(made)
    dealt = spark.read.schema(StructType([*rows.schema.fields, StructField("_batch", IntegerType())])).parquet(made)
    most = dealt.groupBy("_batch").count().agg(F.max("count")).first()[0] or 0
    each, files = max(1, -(-most // FILE_ROWS)), Files(spark, path)
    for k in range(len(batches)):
        batch = dealt.filter(F.col("_batch") == k).drop("_batch").withColumn("_r", F.xxhash64(*rows.columns[:2], F.lit(k)))
        batch.repartition(each, "_r").sortWithinPartitions("_r").drop("_r").write.mode("append").parquet(path)
        for _ in range((k + 1) * each - len([n for n in files.names("") if n.startswith("part-")])):
            spark.createDataFrame([], rows.schema).write.mode("append").parquet(path)
    remove(spark, made)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", each).parquet(path)


def run_once(stream: DataFrame, path: str, each: Callable[[DataFrame, int], None] | None = None) -> DataFrame | None:
    """Runs a stream over what is there now, into Parquet under path, and reads that; or gives each micro-batch to a function."""
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{path}/checkpoint")
    writer = writer.foreachBatch(each) if each else writer.format("parquet").option("path", f"{path}/rows").outputMode("append")
    q = writer.start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    Files(stream.sparkSession, path).delete("checkpoint")
    return None if each else stream.sparkSession.read.parquet(f"{path}/rows")


@contextmanager
def with_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB; the session's setting is put back after."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)
