import random

import pytest
from pyspark.sql import functions as F

from fleetlens.sources.keyed import KEPT, KeyedTable, StatusHistory
from fleetlens.sources.readers import LiveTable

SCHEMA = "k long, part string, v long, t long"


def rows(spark, *r):
    return spark.createDataFrame(list(r), SCHEMA)


def content(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_merges_in_any_order_keep_the_latest(spark, tmp_path):
    random.seed(5)
    table = KeyedTable(spark, f"{tmp_path}/t", SCHEMA, ["k", "part"], ["t"], by=["k"], buckets=4)
    seen = {}
    assert content(table.read()) == []
    for version in range(6):
        batch = {(random.randint(1, 9), random.choice("ab")): random.randint(0, 100) for _ in range(6)}
        some = [(k, p, 10 * t, t) for (k, p), t in batch.items()]
        assert table.merge(rows(spark, *some), version)
        for k, p, v, t in some:
            if (k, p) not in seen or seen[k, p][1] <= t:
                seen[k, p] = (v, t)
        assert content(table.read()) == sorted(((k, p, v, t) for (k, p), (v, t) in seen.items()), key=str)
    assert len(table.versions()) == KEPT
    before = table.files.names("data")
    assert not table.merge(rows(spark, (1, "a", -1, 10**6)), 5) and table.files.names("data") == before  # a repeated micro-batch
    assert {int(n) for n in before} <= {v for n in table.versions() for v in table.manifest(n).values()}


def test_a_failed_merge_is_never_seen(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/t", SCHEMA, ["k"], ["t"], buckets=3)
    table.merge(rows(spark, (1, "a", 1, 1), (2, "a", 2, 1)), 0)
    table.files.put = lambda *a: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        table.merge(rows(spark, (1, "b", 9, 9)), 1)
    again = KeyedTable(spark, f"{tmp_path}/t", SCHEMA, ["k"], ["t"], buckets=3)
    assert content(again.read()) == [(1, "a", 1, 1), (2, "a", 2, 1)]
    assert again.merge(rows(spark, (1, "b", 9, 9)), 1)
    assert content(again.read()) == [(1, "b", 9, 9), (2, "a", 2, 1)]


def test_ticks_are_replaced_whole(spark, tmp_path):
    h = StatusHistory(spark, f"{tmp_path}/h", SCHEMA, ["k"], ["t"], buckets=3)
    assert content(h.latest()) == []
    h.write(rows(spark, (1, "a", 1, 10), (2, "a", 2, 10), (3, "a", 3, 10)), "mon")
    h.write(rows(spark, (1, "b", 4, 20), (3, "b", 5, 20)), "tue")
    assert content(h.latest()) == [(1, "b", 4, 20), (2, "a", 2, 10), (3, "b", 5, 20)]
    h.write(rows(spark, (1, "c", 6, 21)), "tue")  # the tick again, without the row of 3
    assert content(h.latest()) == [(1, "c", 6, 21), (2, "a", 2, 10), (3, "a", 3, 10)]
    assert content(h.history(["tue"])) == [(1, "c", 6, 21)] and h.history().count() == 4
    assert len(h.history(["tue"]).inputFiles()) <= 4 and all("/rows/2/" in f for f in h.history(["tue"]).inputFiles())
    assert all("/current/" in f for f in h.latest().inputFiles())
    put, h.files.put = h.files.put, lambda *a: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        h.write(rows(spark, (2, "z", 0, 99)), "wed")
    h.files.put = put
    assert content(h.latest()) == [(1, "c", 6, 21), (2, "a", 2, 10), (3, "a", 3, 10)]
    h.write(rows(spark, (2, "y", 7, 98)), "wed")
    assert content(h.latest()) == [(1, "c", 6, 21), (2, "y", 7, 98), (3, "a", 3, 10)]


def test_live_objects_follow_the_feed(spark, tmp_path):
    """Versions out of order, deletes before their object, and repeats: after each batch the same as the whole feed at once."""
    random.seed(6)
    live = LiveTable(spark, f"{tmp_path}/live", buckets=3)
    seen = []
    for number in range(5):
        batch = [("workload", random.choice(["update", "delete"]), "ns", f"c{random.randint(0, 6)}", random.randint(0, 10**6)) for _ in range(7)]
        batch += seen[:2]
        seen += batch
        live.apply(spark.createDataFrame(batch, "kind string, op string, namespace string, name string, version long"), number)
        last = {}
        for kind, op, ns, name, version in seen:
            last[name] = max(last.get(name, (-1, "")), (version, op))
        assert {(r.name, r.version) for r in live.objects().collect()} == {(n, v) for n, (v, op) in last.items() if op != "delete"}
    live.forget(before=10**7)
    assert live.table.read().filter("op = 'delete'").count() == 0 and live.objects().count() == len([1 for v, op in last.values() if op != "delete"])
