"""Small literal cases of the fleet operators."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from fleetlens.functions import scalar as s
from fleetlens.operators import decisions, history, members


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_endpoints(spark):
    n, ns = F.lit("test-sts"), F.lit("default")
    assert one(spark, s.client_endpoint(n, ns, F.lit(0))) == "http://test-sts-0.test-sts.default.svc.cluster.local:2379"
    assert len(one(spark, s.client_endpoints(n, ns, F.lit(3)))) == 3 and one(spark, s.client_endpoints(n, ns, F.lit(0))) is None
    assert one(spark, s.bootstrap_state(F.lit(3))) == "existing" and one(spark, s.bootstrap_state(F.lit(1))) == "new"
    assert one(spark, s.bootstrap_list(n, ns, F.lit(2))).split(",")[1] == "test-sts-1=http://test-sts-1.test-sts.default.svc.cluster.local:2380"
    assert one(spark, s.bootstrap_list(n, ns, F.lit(0))) == ""


@pytest.mark.parametrize("option, name", [("--a=b", "--a"), ("--a b", "--a"), (" --flag ", ""), ("--flag", "--flag"), ("", "")])
def test_arg_name(spark, option, name):
    assert one(spark, s.arg_name(F.lit(option))) == name


def test_effective_args(spark):
    args = one(spark, s.effective_args(F.lit("c"), F.array(F.lit("--name=x"), F.lit("--quota 5"))))
    assert args[-2:] == ["--name=x", "--quota 5"] and len(args) == 6 and not any(a.startswith("--name=$") for a in args)
    assert len(one(spark, s.effective_args(F.lit("c"), F.lit(None).cast("array<string>")))) == 5


def test_labels(spark):
    defaults = F.create_map(F.lit("app"), F.lit("c"))
    assert one(spark, s.merge_labels(F.create_map(F.lit("app"), F.lit("mine"), F.lit("x"), F.lit("y")), defaults)) == {"app": "c", "x": "y"}
    assert one(spark, s.merge_labels(F.lit(None).cast("map<string,string>"), defaults)) == {"app": "c"}


@pytest.mark.parametrize("text, ns", [("", 7), ("1h30m", 5_400_000_000_000), ("1.5s", 1_500_000_000), ("8760h", 31_536_000_000_000_000), ("365d", None), ("-2ms", -2_000_000), ("0", 0), ("5", None), ("h", None), (".5m", 30_000_000_000), ("3µs", 3000), (None, None), ("999999999999h", None), ("0.0000001h", 360_000), ("1.0000000019s", 1_000_000_001), ("1.s", 1_000_000_000), ("-0.5us", -500)])
def test_duration(spark, text, ns):
    assert one(spark, s.duration_ns(F.lit(text).cast("string"), 7)) == ns


@pytest.mark.parametrize("text, units", [("1Mi", "1048576"), ("1.5Gi", "1610612736"), ("100", "100"), ("2e3", "2000"), ("5m", "0.005"), ("1GB", None), ("", None), (None, None), ("-1k", "-1000"), ("3Pi", "3377699720527872"), ("7Ei", "8070450532247928832"), ("8E", "8000000000000000000"), ("2P", "2000000000000000"), ("64n", "0.000000064"), ("1500u", "0.0015"), ("1e1.0", "10"), ("12345678901234567", "12345678901234567"), ("1048575999m", "1048575.999"), ("12345678901k", "12345678901000"), ("1KI", None), ("1e", None), ("12345678901234567890", "12345678901234567890"), ("-12345678901234567890.5", "-12345678901234567890.5"), ("0.0000000001", "0.000000001"), ("0.1n", "0.000000001"), ("-0.1n", "-0.000000001"), ("1.5n", "0.000000002"), ("0.00000000000000000001k", "0.000000001"), ("999999999999999999999999999999", "99999999999999999999999999999.999999999"), ("0.5u", "0.0000005"), (".5Ki", "512")])
def test_quantity(spark, text, units):
    got = one(spark, s.quantity(F.lit(text).cast("string")))
    assert (got is None) == (units is None) and (units is None or got == Decimal(units))


@pytest.mark.parametrize("text, parts", [("3.5.17", (3, 5, 17)), ("v3.5.1", None), ("3.5", None), ("3.6.0-rc.1+b", (3, 6, 0)), ("03.1.1", None), ("latest", None), ("99999999999999999999.1.1", (None, 1, 1))])
def test_semver(spark, text, parts):
    got = one(spark, s.semver(F.lit(text)))
    assert (tuple(got) if got else None) == parts


def test_tags_and_ids(spark):
    assert one(spark, s.image_tag(F.lit("host:5000/kv:3.5"))) == "5000/kv:3.5" and one(spark, s.image_tag(F.lit("host:5000/kv:3.5"), "last")) == "3.5"
    assert one(spark, s.image_tag(F.lit("bar"))) is None and one(spark, s.image_tag(F.lit("bar"), "last")) is None
    assert one(spark, s.hex_id(F.lit("18446744073709551615").cast("decimal(20,0)"))) == "f" * 16


def test_pairing_audit_status_and_time_to_ready(spark):
    m = spark.createDataFrame([(1, 10, 0, "c-0", False), (1, 11, 1, "c-1", True), (2, 20, 0, "d-0", None)], "cluster_id long, member_id long, position int, member_name string, is_learner boolean")
    p = spark.createDataFrame([(1, "b", 10, True, "v", 10), (1, "a", 11, False, "w", 10), (1, "c", None, True, None, None)], "cluster_id long, endpoint string, member_id long, health boolean, version string, leader long")
    assert sorted((r.member_id, r.by_id, r.by_position) for r in members.pairing_audit(m, p).collect()) == [(10, "b", "a"), (11, "a", "b")]
    p = p.withColumns({"ordinal": F.lit(0), "has_status": F.col("leader").isNotNull(), "revision": F.lit(1), "is_learner": F.lit(False)})
    spec = m.select("cluster_id", F.lit(1).alias("uid"), F.lit("ns").alias("namespace"), F.lit("c").alias("name"), F.lit(3).alias("size"), F.lit(1).alias("generation"), F.lit("v").alias("version")).distinct()
    w = spec.select("cluster_id", F.lit(3).alias("replicas"), F.lit(3).alias("ready_replicas"), F.lit(1).alias("owner_uid"), F.lit(True).alias("is_controller"), F.lit("r:v").alias("image"))
    status = decisions.cluster_status(decisions.observed(spec, w, m, p), F.lit("before"))
    got = {r.cluster_id: [tuple(x) for x in r.members] for r in status.collect()}
    assert got == {1: [(0, "a", "c-0", True, "v", True, False), (1, "b", "c-1", False, "w", False, True)], 2: [(0, "14", "d-0", False, None, False, False)]}
    t = lambda *rows: spark.createDataFrame(rows, "cluster_id long, change_id long, t string").select("cluster_id", "change_id", F.col("t").cast("timestamp_ntz").alias("ts"))
    out = history.time_to_ready(t((1, 1, "2020-01-01 00:00:00"), (1, 2, "2020-01-01 05:00:00"), (2, 3, "2020-01-01 00:00:00")), t((1, 0, "2020-01-01 00:00:00"), (1, 0, "2020-01-01 06:00:01"), (2, 0, "2020-01-01 06:00:01")), "6 HOURS")
    assert sorted((r.change_id, str(r.ready_at), r.timed_out) for r in out.collect()) == [(1, "2020-01-01 00:00:00", False), (2, "2020-01-01 06:00:01", False), (3, "None", True)]


PROBE = "cluster_id long, endpoint string, ordinal int, health boolean, has_status boolean, member_id long, leader long, revision long, version string, is_learner boolean"


def probes(spark, *rows):
    return spark.createDataFrame([(1, f"e{i}", i, *r) for i, r in enumerate(rows)], PROBE)


@pytest.mark.parametrize("revisions, ready", [((100, 90), True), ((100, 80), False), ((100, 95), True), ((0, 1), True), ((0, 0), False)])
def test_learner_ready(spark, revisions, ready):
    p = probes(spark, (True, True, 1, 1, revisions[0], "v", False), (True, True, 2, 1, revisions[1], "v", True))
    assert members.learner_ready(p).first().ready is ready


def test_leader_and_unhealthy(spark):
    p = probes(spark, (True, True, 1, 2, 5, "a", False), (False, True, 255, 3, 5, "b", False), (False, False, None, None, None, None, None))
    got = members.probe_summary(p).first()
    assert got.leader is None and got.probes == 3 and got.healthy == 1
    assert members.unhealthy_members(p).first().members == "ff" and members.unhealthy_members(p, True).first().members == "ff, 0"


@pytest.mark.parametrize("image, target, verdict", [("kv:3.5.17", "3.6.17", "supported"), ("#notag", "3.6.1", "unvalidated"), ("kv:3.5.17", "3.7.1", "unknown_target"), ("kv:3.6.10", "3.5.1", "downgrade"), ("kv:bar", "foo", "unvalidated"), ("kv:bar", "bar", "unchanged"), ("kv:3.4.1", "3.6.0", "skips_minor"), ("kv:3.6.9", "4.0.0", "supported"), ("kv:9.9.9", "3.6.0", "unknown_current"), ("kv:3.6.2", "3.6.1", "downgrade")])
def test_upgrade_verdict(spark, image, target, verdict):
    line = spark.createDataFrame([(3, i, i) for i in range(7)] + [(4, 0, 7)], "major long, minor long, idx long")
    c = spark.createDataFrame([(1, target)], "cluster_id long, version string")
    w = spark.createDataFrame([(1, image)], "cluster_id long, image string")
    assert decisions.upgrade_verdict(c, w, line).first().verdict == verdict


def test_transitions_ignore_nulls_safely(spark):
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate(["a", "a", None, None, "b", "a"])], "k long, t long, status string")
    got = [(r.t, r.run) for r in history.condition_transitions(rows, ["k"], ["t"]).orderBy("t").collect()]
    assert got == [(0, 1), (2, 2), (4, 3), (5, 4)]


def test_invariants_on_the_fixture(spark):
    from fleetlens.plans.registry import queries

    q, d = queries(), "/root/testdata/sf0.001"
    three = q["conditions"](spark, d).groupBy("cluster_id").count().select("count").distinct().collect()
    assert [r[0] for r in three] == [3]
    actions = q["next_action"](spark, d)
    assert actions.count() == actions.select("cluster_id").distinct().count() == q["default_registry"](spark, d).count()


def test_registry_without_the_training_subpackage():
    """The fleet part stands alone."""
    import subprocess
    import sys

    code = "import sys; sys.modules['fleetlens.llm'] = None; sys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e; q = e.queries(); assert 'conditions' in q and not any(k.startswith('op') for k in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/", 2)[0])
