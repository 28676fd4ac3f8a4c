"""Streams over split, shuffled, repeated and late input give what the batch operators give of the rows that count."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import decisions, history
from fleetlens.plans.registry import flat_status
from fleetlens.plans.streams import status_feed
from fleetlens.sources.keyed import KeyedTable
from fleetlens.streaming import streams

START = dt.datetime(2024, 1, 1)
PROBES = "probe_id long, cluster_id long, ordinal long, ts timestamp, status string, health boolean, event_type string, batch int"


def minute(m):
    return START + dt.timedelta(minutes=m)


def stream(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, PROBES)
    batches = sorted({r[-1] for r in rows})
    return streams.replay(df, f"{tmp_path}/in", [F.col("batch") == b for b in batches]).drop("batch")


def run(spark, tmp_path, out):
    with streams.with_rocksdb(spark):
        return streams.run_once(out, f"{tmp_path}/out").collect()


def probe(i, at, batch, cluster=1, ordinal=0, status="True", kind="view"):
    return (i, cluster, ordinal, minute(at), status, status == "True", kind, batch)


def test_transitions_of_shuffled_and_late_rows(spark, tmp_path):
    random.seed(7)
    rows = [probe(i, i, i // 50, cluster=i % 3, ordinal=i % 2, status=random.choice(["True", "True", "False"])) for i in range(200)]
    # up to 8 minutes later than their time, so also in the next micro-batch: inside the 10 minutes
    rows = [(*r[:-1], min(3, (r[0] + random.randint(0, 8)) // 50)) for r in rows]
    late = [probe(1000 + i, i, 3, cluster=i % 3, status="Late") for i in range(40)]
    got = run(spark, tmp_path, streams.condition_transitions(stream(spark, tmp_path, rows + late).select("cluster_id", "ordinal", "probe_id", "ts", "status")))
    df = spark.createDataFrame(rows, PROBES).select("cluster_id", "ordinal", "probe_id", "ts", "status")
    expected = history.condition_transitions(df, ["cluster_id", "ordinal"], ["ts", "probe_id"]).filter(F.col("ts") < minute(189)).collect()
    assert sorted(map(tuple, got)) == sorted((r.cluster_id, r.ordinal, r.probe_id, r.ts, r.status, r.run) for r in expected) and len(got) > 30


def test_idle_keys_are_forgotten(spark, tmp_path):
    rows = [probe(1, 0, 0), probe(2, 1, 0, status="False"), probe(3, 200, 1, cluster=2), probe(4, 210, 2, status="False"), probe(5, 300, 3, cluster=2)]
    out = streams.condition_transitions(stream(spark, tmp_path, rows).select("cluster_id", "ordinal", "probe_id", "ts", "status"), idle="1 hour")
    # 4 has the status of 2, but comes when the key was forgotten: it counts as a first row
    assert sorted((r.probe_id, r.run) for r in run(spark, tmp_path, out)) == [(1, 1), (2, 2), (3, 1), (4, 1)]


def test_first_ready_report_once(spark, tmp_path):
    rows = [
        probe(1, 0, 0, kind="change"), probe(2, 400, 2, kind="ready"), probe(3, 30, 0, kind="ready"), probe(4, 20, 1, kind="ready"),  # 4 is earlier than 3 and comes later
        probe(5, 100, 1, kind="change"), probe(6, 100, 2, kind="ready"), probe(1, 0, 1, kind="change"),  # at the same time; and a repeat
        probe(7, 110, 2, kind="change"), probe(8, 10, 4, kind="ready"),  # 7 finds 400 inside six hours; 8 is behind the watermark
        probe(9, 500, 3, cluster=2, kind="change"), probe(10, 1500, 4, cluster=3, kind="change"), probe(11, 861, 3, cluster=2, kind="ready"),  # one minute after the deadline
    ]
    rows = [(*r[:-1], {0: 0, 1: 0, 2: 1, 3: 2, 4: 3}[r[-1]]) for r in rows]
    h = stream(spark, tmp_path, rows)
    out = streams.time_to_ready(h.filter("event_type = 'change'").select("cluster_id", F.col("probe_id").alias("change_id"), "ts"), h.filter("event_type = 'ready'"))
    got = sorted((r.change_id, r.ready_at) for r in run(spark, tmp_path, out))
    assert got == [(1, minute(20)), (5, minute(100)), (7, minute(400)), (9, None)]  # 10 is still open


def test_many_reports_give_one_row_a_change(spark, tmp_path):
    rows = [probe(i, i / 10, i // 400, kind="ready") for i in range(1200)] + [probe(5000 + i, i * 10, (i * 100) // 400, kind="change") for i in range(12)] + [probe(9999, 2000, 3, cluster=9, kind="ready")]
    h = stream(spark, tmp_path, rows)
    out = streams.time_to_ready(h.filter("event_type = 'change'").select("cluster_id", F.col("probe_id").alias("change_id"), "ts"), h.filter("event_type = 'ready'"))
    assert sorted((r.change_id, r.ready_at) for r in run(spark, tmp_path, out)) == [(5000 + i, minute(i * 10)) for i in range(12)]


def test_ticks_and_repeats_of_late_rows(spark, tmp_path):
    rows = [probe(i, i * 10, i // 12, ordinal=i % 3, status="False" if i % 5 == 0 else "True") for i in range(36)]
    late = [probe(100 + i, i * 10, 2) for i in range(6)]  # of the first hour, in the last batch: counted nowhere
    again = [(*rows[20][:-1], 1), (*rows[30][:-1], 2), (*rows[30][:-1], 2)]
    ticks = run(spark, tmp_path / "t", streams.probe_ticks(stream(spark, tmp_path / "t", rows + late)))
    closed = 5  # hours that end before the newest time less 30 seconds
    assert sorted((r.tick, r.probes, r.endpoints) for r in ticks) == [(minute(60 * h), 6, 3) for h in range(closed)]
    assert sum(r.healthy for r in ticks) == sum(r[5] for r in rows[: 6 * closed])
    once = run(spark, tmp_path / "d", streams.dedup_probes(stream(spark, tmp_path / "d", rows + late + again)))
    assert sorted(r.probe_id for r in once) == list(range(36))


@pytest.mark.parametrize("batches", [3])
def test_status_after_each_batch_is_that_of_its_rows(spark, tmp_path, batches):
    rows = status_feed(spark, "/root/testdata/sf0.001").filter("cluster_id < 400").cache()
    table = streams.FleetStatus(spark, f"{tmp_path}/table", rows.schema, buckets=4)
    comes = F.pmod(F.xxhash64("cluster_id", "feed", "item", "version"), F.lit(batches))
    key = ["cluster_id", "feed", "item"]
    for k in range(batches):
        table.apply(rows.filter(comes == k), k)
        table.apply(rows.filter(comes == 0), k)  # repeated by Spark: nothing changes
        now = history.latest(rows.filter(comes <= k), key, ["version"]).filter("NOT deleted")
        expected = flat_status(decisions.cluster_status(decisions.gathered(now), F.col("version")))
        got = flat_status(table.current())
        assert sorted(map(tuple, got.select(*expected.columns).collect())) == sorted(map(tuple, expected.collect()))
    assert got.count() > 50
    # a cluster whose spec is deleted has no status, until it comes back
    gone = rows.filter("feed = 'spec' AND version = 2").limit(1).withColumns({"version": F.lit(9).cast("bigint"), "deleted": F.lit(True)}).cache()
    one = gone.first().cluster_id
    table.apply(gone, batches)
    assert table.current().filter(F.col("cluster_id") == one).count() == 0
    table.apply(gone.withColumns({"version": F.lit(10).cast("bigint"), "deleted": F.lit(False)}), batches + 1)
    assert table.current().filter(F.col("cluster_id") == one).count() == 1
    # stopped after the first of the two tables: the repeated batch finishes it
    table.state.merge(gone.withColumns({"version": F.lit(11).cast("bigint")}), batches + 2)
    table.apply(gone.withColumns({"version": F.lit(11).cast("bigint")}), batches + 2)
    assert table.current().filter(F.col("cluster_id") == one).count() == 0


def test_many_tasks_write_a_replayed_batch(spark, tmp_path, monkeypatch):
    """A batch was one task's, and rows were made anew for each."""
    monkeypatch.setattr(streams, "FILE_ROWS", 50, raising=False)
    made = spark.sparkContext.accumulator(0)

    def seen(value):
        made.add(1)
        return value

    rows = spark.range(1000).select("id", F.udf(seen, "bigint")("id").alias("n"))
    batches = [F.col("n") % 10 < 7, F.col("n") < 0, F.col("n") % 10 == 7, F.col("n") >= 990, F.lit(None).cast("boolean")]
    replayed, got = streams.replay(rows, f"{tmp_path}/feed", batches), {}
    assert made.value == 1000
    files = [p.name for p in (tmp_path / "feed").iterdir() if p.name.startswith("part-")]
    assert len(files) == 14 * len(batches)  # 700 rows are the most
    streams.run_once(replayed, f"{tmp_path}/out", lambda batch, k: got.__setitem__(k, sorted(r.n for r in batch.collect())))
    assert got == {0: [n for n in range(1000) if n % 10 < 7], 1: [], 2: list(range(7, 1000, 10)), 3: list(range(990, 1000)), 4: []}


def test_a_batch_of_status_is_looked_up_once(spark, tmp_path, monkeypatch):
    rows = status_feed(spark, "/root/testdata/sf0.001").filter("cluster_id < 50").cache()
    table, calls, touched = streams.FleetStatus(spark, f"{tmp_path}/table", rows.schema, buckets=4), [], KeyedTable.touched
    monkeypatch.setattr(KeyedTable, "touched", lambda self, batch: calls.append(self.path) or touched(self, batch))
    table.apply(rows, 0)
    assert len(calls) == 1 and table.current().count() > 10
    # one task writes a bucket, and no bucket is in two files
    for kept in (table.state, table.status):
        assert sorted(f.split("_b=")[1].split("/")[0] for f in kept.read().inputFiles()) == sorted(map(str, kept.manifest()))
