"""Histories dealt out by spans of time give what one window a key gives; no task holds a busy key."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetlens.operators import decisions, history
from fleetlens.operators.members import snapshot_diff

ROWS = "cluster_id long, probe_id long, at long, status string, revision long, leads boolean"


def events(spark, n=600, busy=0.5):
    random.seed(8)
    rows = []
    for i in range(n):
        # one cluster has half of all rows; days without any; several rows at one time
        rows.append((1 if random.random() < busy else random.choice([2, 3, 4, None]), i, random.choice([0, 1, 2, 5, 9]) * 86_400 + random.randint(0, 300) * 60, random.choice(["True", "False", None, "True"]), random.choice([None, 5, 8, 13]), random.random() < 0.1))
    return spark.createDataFrame(rows, ROWS).withColumn("ts", F.timestamp_seconds("at").cast("timestamp_ntz"))


def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect())) and a.count() > 0


def test_transitions(spark):
    rows = events(spark)
    for key in (["cluster_id"], ["cluster_id", "leads"]):
        w = Window.partitionBy(*key).orderBy("ts", "probe_id")
        plain = rows.withColumn("c", ~F.col("status").eqNullSafe(F.lag("status").over(w)) | (F.row_number().over(w) == 1)).withColumn("run", F.sum(F.col("c").cast("long")).over(w)).filter("c").drop("c")
        same(history.condition_transitions(rows, key, ["ts", "probe_id"], by=history.span()), plain)
        same(history.condition_transitions(rows, key, ["ts", "probe_id"]), plain)
        same(history.condition_transitions(rows, key, ["ts", "probe_id"], by=history.span("ts", "HOUR")), plain)


@pytest.mark.parametrize("width", ["HOUR", "DAY", "YEAR"])
def test_lag_and_time_to_ready(spark, width):
    rows = events(spark)
    w = Window.partitionBy("cluster_id").orderBy("ts", "probe_id").rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.withColumn("leader_revision", F.last(F.when(F.col("leads"), F.struct("revision")), ignorenulls=True).over(w)["revision"]).filter("NOT leads")
    plain = seen.select("cluster_id", "probe_id", "revision", "leader_revision", (F.col("leader_revision") - F.col("revision")).alias("lag"))
    same(history.learner_lag_asof(rows, F.col("leads"), width=width), plain)
    changes, ready = rows.filter("probe_id % 3 = 0").withColumn("change_id", F.col("probe_id") % 50), rows.filter("probe_id % 7 = 1")
    r = ready.select(F.col("cluster_id").alias("k"), F.col("ts").alias("t"))
    met = F.col("cluster_id").eqNullSafe(F.col("k")) & (F.col("t") >= F.col("ts")) & (F.col("t") <= F.col("ts") + F.expr("INTERVAL 30 HOURS"))
    plain = changes.join(r, met, "left").groupBy("cluster_id", "change_id", "ts").agg(F.min("t").alias("ready_at")).withColumn("timed_out", F.col("ready_at").isNull())
    same(history.time_to_ready(changes, ready, "30 HOURS", width=width), plain)


def test_a_busy_cluster_is_dealt_out(spark):
    """Half of all rows are of one cluster: by the cluster, one partition holds half of them; by the spans, a tenth at most."""
    rows = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("cluster_id"), F.col("id").alias("probe_id"), F.timestamp_seconds(F.col("id") * 600).cast("timestamp_ntz").alias("ts"))

    def largest(*by):
        return rows.repartition(64, *by).groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]

    assert largest("cluster_id") > 9_900 and largest("cluster_id", history.span()) < 2_000


def test_numbers_and_tiles(spark):
    for n in (0, 1, 2, 3, 10, 101):
        df = spark.range(n).select((F.col("id") % 7).alias("a"), F.concat(F.lit("o"), "id").alias("b")).repartition(3)
        got = history.numbered(df, ["a", "b"]).withColumn("third", history.tile(3))
        w = Window.orderBy("a", "b")
        expected = df.withColumns({"row": F.row_number().over(w).cast("long"), "rows": F.lit(n).cast("long"), "third": F.ntile(3).over(w)})
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))


def test_signed_counts(spark):
    t = lambda *names: spark.createDataFrame([(1, x) for x in names], "cluster_id long, member_name string")
    got = sorted(map(tuple, snapshot_diff(t("a", "a", "a", "b", "c"), t("a", "c", "d", "d", "b")).collect()))
    assert got == [(1, "a", "missing"), (1, "a", "missing"), (1, "d", "unexpected"), (1, "d", "unexpected")]
    assert snapshot_diff(t(), t()).count() == 0


def exchanges(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange hashpartitioning")


def test_one_exchange_a_cluster(spark, tmp_path):
    """All feeds meet in one exchange on the cluster, whichever decision is taken; the version line is a few rows."""
    feeds = {
        "spec": "SELECT id AS cluster_id, id AS uid, 'n' AS namespace, 'c' AS name, 3 AS size, 1L AS generation, '3.5.1' AS version FROM range(50)",
        "workload": "SELECT id AS cluster_id, 3 AS replicas, 3 AS ready_replicas, id AS owner_uid, true AS is_controller, 'r:3.5.0' AS image FROM range(45)",
        "member": "SELECT id DIV 3 AS cluster_id, CAST(id % 3 AS INT) AS position, id AS member_id, concat('c-', id % 3) AS member_name, false AS is_learner FROM range(150)",
        "probe": "SELECT id DIV 3 AS cluster_id, concat('e', id % 3) AS endpoint, CAST(id % 3 AS INT) AS ordinal, true AS health, true AS has_status, id AS member_id, id - id % 3 AS leader, id AS revision, '3.5.0' AS version, false AS is_learner FROM range(150)",
        "line": "SELECT 3L AS major, id AS minor, id AS idx FROM range(7)",
    }
    tables = []
    for name, sql in feeds.items():
        spark.sql(sql).write.parquet(f"{tmp_path}/{name}")
        tables.append(spark.read.parquet(f"{tmp_path}/{name}"))
    *four, line = tables
    state = decisions.observed(*four)
    assert exchanges(decisions.conditions(state)) == 1
    assert exchanges(decisions.cluster_status(state, F.col("version"))) == 1
    actions = decisions.next_action(decisions.judged(state, line))
    assert exchanges(actions) == 1
    assert {(r.action, r.victim_is_leader) for r in actions.collect()} == {("up_to_date", False), ("bootstrap_create", False)}
