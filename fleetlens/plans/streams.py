"""Streaming queries over the fixture views: replayed in several micro-batches, out of order, with repeats and with rows that come too late."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.operators.decisions import tagged
from fleetlens.plans.fixtures import view, with_views
from fleetlens.plans.registry import _queries, _sql, flat_status
from fleetlens.sources.shared import folder
from fleetlens.streaming import streams


def _folder(spark: SparkSession) -> str:
    return folder(spark, "stream")


def history_stream(spark: SparkSession, sf_dir: str, spans: int = 4) -> DataFrame:
    """fx_history as a stream of micro-batches, one for each span of time. A row comes up to 20 seconds out of order; the last batch also
    holds a fifth of the first span's rows once more, with another status: they are behind every watermark, and count nowhere."""
    rows = view(spark, sf_dir, "fx_history").withColumn("ts", F.col("ts").cast("timestamp"))
    first, last = rows.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    comes = F.unix_micros("ts") + F.col("probe_id") % 20 * 1_000_000
    span = F.least(F.floor((comes - first) / ((last - first) / spans + 1)), F.lit(spans - 1))
    rows = rows.withColumn("span", span)
    again = rows.filter("span = 0 AND probe_id % 5 = 0").withColumns({"span": F.lit(spans - 1).cast("bigint"), "status": F.lit("Late"), "health": F.lit(False), "probe_id": -F.col("probe_id")})
    return streams.replay(rows.unionByName(again), folder(spark, "history"), [F.col("span") == k for k in range(spans)]).drop("span")


def _add(name: str, run, sql: str | None = None) -> None:
    _queries[name] = run
    if sql:
        _sql[name] = sql if sql.startswith("WITH fx_") else with_views(sql)


def _ntz(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


_add(
    "stream_probe_ticks",
    lambda spark, d: _ntz(streams.run_once(streams.probe_ticks(history_stream(spark, d)), _folder(spark)), "tick"),
    """SELECT cluster_id, date_trunc('hour', ts) AS tick, count(*) AS probes, count(*) FILTER (WHERE health) AS healthy, count(DISTINCT ordinal) AS endpoints FROM fx_history
       GROUP BY 1, 2 HAVING date_trunc('hour', min(ts)) + INTERVAL '1' HOUR <= (SELECT max(ts) - INTERVAL '30' SECOND FROM fx_history)""",
)


def _twice(spark: SparkSession, d: str) -> DataFrame:
    h = history_stream(spark, d).select("probe_id", "cluster_id", "ts")
    return _ntz(streams.run_once(streams.dedup_probes(h.unionByName(h)), _folder(spark)), "ts")


_add("stream_dedup_probes", _twice, "SELECT probe_id, cluster_id, ts FROM fx_history")


def _transitions(spark: SparkSession, d: str) -> DataFrame:
    rows = history_stream(spark, d).select("cluster_id", "ordinal", "probe_id", "ts", "status")
    with streams.with_rocksdb(spark):
        return _ntz(streams.run_once(streams.condition_transitions(rows), _folder(spark)), "ts")


_add("stream_condition_transitions", _transitions, f"SELECT * FROM ({_sql['condition_transitions'][_sql['condition_transitions'].rindex('SELECT cluster_id, ordinal, probe_id'):]}) t WHERE ts < (SELECT max(ts) - INTERVAL '10' MINUTE FROM fx_history)")


def status_feed(spark: SparkSession, d: str) -> DataFrame:
    """Rows of all feeds, tagged: each as it is (version 2), as it was (1), and members that came (2) and went (3)."""
    c, w, m, p = (view(spark, d, v) for v in ("fx_clusters", "fx_workloads", "fx_members", "fx_probes"))
    item = {"spec": F.lit(""), "workload": F.lit(""), "member": F.col("member_id").cast("string"), "probe": F.col("endpoint")}

    def versions(t: DataFrame, ghosts: str = "false") -> DataFrame:
        """Each row as it is and as it was; where there are ghosts, also as one that came and one that went. t is made once."""
        return t.selectExpr("*", f"inline(IF({ghosts}, array((2L, false, 0), (1L, false, 0), (2L, false, 50), (3L, true, 50)), array((2L, false, 0), (1L, false, 0)))) AS (version_, deleted, more)")

    was = F.col("version_") == 1
    m = versions(m, "cluster_id % 7 = 0 AND ordinal = 0").withColumn("member_id", F.col("member_id") + F.col("more"))
    tables = {
        "spec": versions(c).withColumn("generation", F.col("generation") - was.cast("int")), "workload": versions(w).withColumn("replicas", F.col("replicas") + was.cast("int")),
        "member": m.withColumn("is_learner", F.col("is_learner") != was), "probe": versions(p).withColumn("health", F.col("health") != was),
    }
    return tagged({k: t.withColumn("item", item[k]) for k, t in tables.items()}, "item", "version_", "deleted").withColumnRenamed("version_", "version")


def _status(spark: SparkSession, d: str, batches: int = 4) -> DataFrame:
    rows = status_feed(spark, d)
    # a bucket's rows are those of some 100,000 clusters, as a task merges it
    table = streams.FleetStatus(spark, _folder(spark), rows.schema, buckets=max(16, view(spark, d, "fx_clusters").count() // 100_000))
    comes = F.pmod(F.xxhash64("cluster_id", "feed", "item", "version"), F.lit(batches))
    streams.run_once(streams.replay(rows, folder(spark, "feed"), [comes == k for k in range(batches)]), _folder(spark), table.apply)
    return flat_status(table.current())


_add("stream_status_upsert", _status, _sql["cluster_status"])


def _ready(spark: SparkSession, d: str) -> DataFrame:
    h = history_stream(spark, d)
    changes = h.filter("event_type = 'signup'").select("cluster_id", F.col("probe_id").alias("change_id"), "ts")
    with streams.with_rocksdb(spark):
        return _ntz(streams.run_once(streams.time_to_ready(changes, h.filter("event_type = 'purchase'")), _folder(spark)), "ts", "ready_at")


_add("stream_time_to_ready", _ready, """
    WITH q AS (SELECT c.cluster_id, c.probe_id AS change_id, c.ts, min(r.ts) AS ready_at FROM fx_history c LEFT JOIN fx_history r ON r.cluster_id = c.cluster_id AND r.event_type = 'purchase' AND r.ts >= c.ts AND r.ts <= c.ts + INTERVAL '6' HOUR
      WHERE c.event_type = 'signup' GROUP BY 1, 2, 3), e AS (SELECT max(ts) - INTERVAL '1' HOUR AS mark FROM fx_history WHERE event_type IN ('signup', 'purchase'))
    SELECT cluster_id, change_id, ts, ready_at FROM q, e WHERE ready_at < mark OR ready_at IS NULL AND ts + INTERVAL '6' HOUR < mark""")
