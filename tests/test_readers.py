"""Texts that can't be read are kept apart, each once, with the reason; nested fields of exported objects arrive."""

import json

from pyspark.sql import functions as F

from fleetlens.operators import certificates
from fleetlens.sources import readers

GOOD = {
    "metadata": {"namespace": "n", "name": "a", "uid": "1", "generation": 2},
    "spec": {
        "size": 3, "version": "3.5.1", "storeOptions": ["--x=1"], "podTemplate": {"metadata": {"annotations": {"k": "v"}, "labels": {"l": "m"}}},
        "tls": {"provider": "cert-manager", "providerCfg": {"certManagerCfg": {"commonName": "cn", "organizations": ["o1", "o2"], "altNames": {"dnsNames": ["d1", "d2"], "ipAddresses": ["10.0.0.1", "::1"]}, "validityDuration": "100h", "issuerKind": "Issuer", "issuerName": "ca"}}},
    },
}


def texts(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_nested_fields_and_the_callers_option_name(spark):
    (c,) = readers.clusters(texts(spark, json.dumps(GOOD)), options="storeOptions").collect()
    assert c.options == ["--x=1"] and c.pod_annotations == {"k": "v"} and c.pod_labels == {"l": "m"}
    cfg = c.tls.providerCfg.certManagerCfg
    assert (cfg.organizations, cfg.altNames.dnsNames, cfg.altNames.ipAddresses, cfg.validityDuration) == (["o1", "o2"], ["d1", "d2"], ["10.0.0.1", "::1"], "100h")
    assert readers.clusters(texts(spark, json.dumps(GOOD))).first().options is None


def test_every_text_is_read_or_rejected(spark):
    one, other = json.dumps(GOOD), {"spec": {"size": 1}}
    many = json.dumps({"items": [GOOD, other, GOOD]})
    wrong = json.dumps({**GOOD, "spec": {"size": "three"}})
    t = texts(spark, one, many, one[:-5], "", None, "[]", "not json", json.dumps(other), wrong)
    schema = readers.cluster_schema("storeOptions")
    assert readers.clusters(t, "storeOptions").count() == 3
    got = {(r.value, r.reason, r.item) for r in readers.rejected(t, schema).collect()}
    broken = {(v, "unreadable", None) for v in (one[:-5], "[]", "not json", wrong)}
    assert got == broken | {("", "empty", None), (None, "empty", None), (many, "no metadata", 1), (json.dumps(other), "no metadata", 0)}
    assert [r.item for r in readers.rejected(texts(spark, many), schema).collect()] == [1]
    work = texts(spark, '{"metadata":{"name":"w","namespace":"n"},"spec":{"replicas":3}}', '{"metadata"')
    assert readers.workloads(work).count() == 1 and [r.reason for r in readers.rejected(work, readers.WORKLOAD).collect()] == ["unreadable"]


def test_certificates(spark, tmp_path):
    lines = ['{"namespace":"n","secret_name":"s","dns_names":["a","b"],"not_after":"2024-01-01T00:00:00Z"}', '{"namespace":"n"}', "{", '{"secret_name":"t","data_keys":"no list"}']
    t = texts(spark, *lines)
    t.write.text(f"{tmp_path}/certs")
    assert [r.secret_name for r in readers.certs(spark, f"{tmp_path}/certs").collect()] == ["s"]
    assert sorted((r.value, r.reason) for r in readers.rejected_certs(t).collect()) == sorted([(lines[1], "no name"), (lines[2], "unreadable"), (lines[3], "unreadable")])


def test_requests_keep_all_names(spark):
    bare = {"metadata": {**GOOD["metadata"], "name": "b", "uid": "2"}, "spec": {"size": 1, "tls": {}}}
    none = {"metadata": {**GOOD["metadata"], "name": "c", "uid": "3"}, "spec": {"size": 1}}
    c = readers.clusters(texts(spark, *map(json.dumps, (GOOD, bare, none)))).withColumn("cluster_id", F.col("uid"))
    got = {r.cluster_id: r for r in certificates.requests(c).collect()}
    assert set(got) == {"1", "2"}
    a, b = got["1"], got["2"]
    assert (a.provider, a.common_name, a.dns_names, a.ip_addresses, a.organizations, a.validity_ns, a.validity_years, a.issuer_kind, a.issuer_name) == ("cert-manager", "cn", ["d1", "d2"], ["10.0.0.1", "::1"], ["o1", "o2"], 360_000 * 10**9, 0, "Issuer", "ca")
    assert (b.provider, b.common_name, b.dns_names, b.ip_addresses, b.organizations, b.validity_years, b.issuer_kind) == ("auto", "b.n.svc.cluster.local", ["*.b.n.svc.cluster.local", "b.n.svc.cluster.local"], [], None, 1, None)
    certs = spark.createDataFrame([("n", "a-client-tls"), ("n", "a-peer-tls"), ("m", "a-server-tls")], "namespace string, secret_name string")
    assert [r.secret_name for r in certificates.coverage(c.filter("uid = '1'"), certs).collect()] == ["a-server-tls"]
