"""Registered fleet queries over the fixture views, each with its SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions import scalar as s
from fleetlens.operators import certificates, decisions, history, members, readiness, rules
from fleetlens.plans.fixtures import view, with_views
from fleetlens.sources.keyed import StatusHistory
from fleetlens.sources.shared import folder

AS_OF = "1998-01-01 00:00:00"
Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(name: str, *views: str, sql: str | None = None):
    """Registers a function of view DataFrames under a name."""

    def add(f):
        _queries[name] = lambda spark, sf_dir: f(*[view(spark, sf_dir, v) for v in views])
        if sql:
            _sql[name] = with_views(sql)
        return f

    return add


def queries() -> dict[str, Query]:
    from fleetlens.plans import source_queries, streams  # noqa: F401  they register more queries

    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    from fleetlens.plans import source_queries, streams  # noqa: F401

    return dict(_sql)


# Scalar layer -------------------------------------------------------------------------------------------------------

URL = "concat('http://', {n}, '-', {i}, '.', {n}, '.', {ns}, '.svc.cluster.local:{p}')"


def url(n: str, ns: str, i: str, p: int) -> str:
    return URL.format(n=n, ns=ns, i=i, p=p)


query("peer_endpoint", "fx_members", sql=f"SELECT cluster_id, ordinal, concat(name, '-', ordinal) AS member, {url('name', 'namespace', 'ordinal', 2380)} AS url FROM fx_members")(
    lambda m: m.select("cluster_id", "ordinal", s.member_name("name", "ordinal").alias("member"), s.peer_endpoint("name", "namespace", "ordinal").alias("url"))
)
query("client_endpoint", "fx_members", sql=f"SELECT cluster_id, ordinal, {url('name', 'namespace', 'ordinal', 2379)} AS url FROM fx_members")(
    lambda m: m.select("cluster_id", "ordinal", s.client_endpoint("name", "namespace", "ordinal").alias("url"))
)
query("client_endpoints", "fx_workloads", sql=f"""
    SELECT w.cluster_id, i.i AS position, CASE WHEN i.i IS NOT NULL THEN {url('w.name', 'w.namespace', 'i.i', 2379)} END AS url
    FROM fx_workloads w LEFT JOIN (SELECT unnest(range(64)) AS i) i ON i.i < w.replicas""")(
    lambda w: w.select("cluster_id", F.posexplode_outer(s.client_endpoints("name", "namespace", "replicas")).alias("position", "url"))
)
query("bootstrap_config", "fx_workloads", sql=f"""
    SELECT cluster_id, CASE WHEN replicas <= 1 THEN 'new' ELSE 'existing' END AS state,
      coalesce((SELECT string_agg(concat(name, '-', i, '=', {url('name', 'namespace', 'i', 2380)}), ',' ORDER BY i) FROM (SELECT unnest(range(replicas)) AS i) q), '') AS members, '/var/lib/kv' AS data_dir
    FROM fx_workloads""")(lambda w: w.select("cluster_id", s.bootstrap_config("name", "namespace", "replicas").alias("c")).select("cluster_id", *[F.col("c")[k].alias(k) for k in ("state", "members", "data_dir")]))

ARG = "CASE WHEN instr({o}, '=') > 0 THEN split_part({o}, '=', 1) WHEN instr({o}, ' ') > 0 THEN split_part({o}, ' ', 1) ELSE trim({o}) END"
query("arg_name", "fx_options", sql=f"SELECT option_id, {ARG.format(o='option_text')} AS arg FROM fx_options")(lambda o: o.select("option_id", s.arg_name("option_text").alias("arg")))
_defaults = ", ".join(f"({i}, '{d}')" for i, d in enumerate(s.DEFAULT_ARGS))


def _with_args(c: DataFrame, o: DataFrame) -> DataFrame:
    given = o.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("option_id", "option_text"))), lambda x: x["option_text"]).alias("options"))
    return c.select("cluster_id", "name").join(given, "cluster_id", "left").withColumn("args", s.effective_args("name", "options"))




def effective_sql(options: str = "fx_options", n: str = "") -> str:
    """The tables up to effective{n}(cluster_id, position, arg), for the options of a view."""
    return f"""d{n} AS (SELECT * FROM (VALUES {_defaults}) t(k, arg)),
    given{n} AS (SELECT cluster_id, option_text, row_number() OVER (PARTITION BY cluster_id ORDER BY option_id) AS k, {ARG.format(o='option_text')} AS arg_name FROM {options}),
    kept{n} AS (SELECT c.cluster_id, d.k, replace(d.arg, '{{name}}', c.name) AS arg FROM fx_clusters c, d{n} d
      WHERE NOT EXISTS (SELECT 1 FROM given{n} g WHERE g.cluster_id = c.cluster_id AND g.arg_name = split_part(d.arg, '=', 1))),
    both_{n} AS (SELECT cluster_id, 0 AS part, k, arg FROM kept{n} UNION ALL SELECT g.cluster_id, 1, k, option_text FROM given{n} g JOIN fx_clusters c ON c.cluster_id = g.cluster_id),
    effective{n} AS (SELECT cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY part, k) - 1 AS position, arg FROM both_{n})"""


EFFECTIVE = effective_sql()
query("effective_args", "fx_clusters", "fx_options", sql=f"WITH {EFFECTIVE} SELECT * FROM effective")(lambda c, o: _with_args(c, o).select("cluster_id", F.posexplode("args").alias("position", "arg")))
_only = lambda x, y: f"(SELECT cluster_id, string_agg(arg, ',' ORDER BY position) AS args FROM (SELECT cluster_id, arg, min(position) AS position FROM {x} e WHERE NOT EXISTS (SELECT 1 FROM {y} o WHERE o.cluster_id = e.cluster_id AND o.arg = e.arg) GROUP BY cluster_id, arg) q GROUP BY cluster_id)"
query("rule_args_drift", "fx_clusters", "fx_options", "fx_deployed", sql=f"""
    WITH {EFFECTIVE}, {effective_sql("fx_deployed", "2")}, flat AS (SELECT cluster_id, string_agg(arg, ' ' ORDER BY position) AS args FROM effective GROUP BY cluster_id), flat2 AS (SELECT cluster_id, string_agg(arg, ' ' ORDER BY position) AS args FROM effective2 GROUP BY cluster_id)
    SELECT a.cluster_id, a.args AS expected, b.args AS deployed, coalesce(m.args, '') AS missing, coalesce(x.args, '') AS extra FROM flat a JOIN flat2 b ON b.cluster_id = a.cluster_id
      LEFT JOIN {_only("effective", "effective2")} m ON m.cluster_id = a.cluster_id LEFT JOIN {_only("effective2", "effective")} x ON x.cluster_id = a.cluster_id WHERE a.args <> b.args""")(
    lambda c, o, d: rules.args_drift(_with_args(c, o), _with_args(c, d)).select("cluster_id", *[F.array_join(n, " ").alias(n) for n in ("expected", "deployed")], *[F.array_join(n, ",").alias(n) for n in ("missing", "extra")])
)
query("merge_labels", "fx_clusters", sql="""
    SELECT cluster_id, 'app' AS label, name AS value FROM fx_clusters UNION ALL SELECT cluster_id, 'controller', name FROM fx_clusters
    UNION ALL SELECT cluster_id, 'tier', namespace FROM fx_clusters WHERE cluster_id % 3 <> 0""")(
    lambda c: c.select(
        "cluster_id",
        F.explode(s.merge_labels(F.when(F.col("cluster_id") % 3 != 0, F.create_map(F.lit("app"), F.lit("mine"), F.lit("tier"), F.col("namespace"))), F.create_map(F.lit("app"), F.col("name"), F.lit("controller"), F.col("name")))).alias("label", "value"),
    )
)
query("default_registry", "fx_clusters", sql="SELECT cluster_id, CASE WHEN image_registry = '' THEN 'registry.example/store' ELSE image_registry END AS registry FROM fx_clusters")(
    lambda c: c.select("cluster_id", s.default_registry("image_registry", "registry.example/store").alias("registry"))
)
query("image_ref", "fx_clusters", sql="SELECT cluster_id, concat(image_registry, ':', version) AS image, version AS tag FROM fx_clusters")(
    lambda c: c.withColumn("image", s.image_ref("image_registry", "version")).select("cluster_id", "image", s.image_tag("image").alias("tag"))
)
query("image_tag", "fx_workloads", sql="SELECT cluster_id, CASE WHEN instr(i, ':') > 0 THEN substr(i, instr(i, ':') + 1) END AS tag, CASE WHEN instr(i, ':') > 0 THEN split_part(i, ':', -1) END AS last_tag FROM (SELECT cluster_id, CASE cluster_id % 3 WHEN 0 THEN concat('host:5000/', image) WHEN 1 THEN replace(image, ':', '#') ELSE image END AS i FROM fx_workloads) q")(
    lambda w: w.withColumn("i", F.when(F.col("cluster_id") % 3 == 0, F.concat(F.lit("host:5000/"), "image")).when(F.col("cluster_id") % 3 == 1, F.replace("image", F.lit(":"), F.lit("#"))).otherwise(F.col("image"))).select("cluster_id", s.image_tag("i").alias("tag"), s.image_tag("i", "last").alias("last_tag"))
)
query("hex_id", "fx_members", sql="SELECT member_id, format('{:x}', CAST(member_id AS UBIGINT)) AS hex FROM fx_members")(lambda m: m.select("member_id", s.hex_id("member_id").alias("hex")))
query("parse_duration", "fx_texts", sql="""
    SELECT text_id, CASE text_id % 8 WHEN 0 THEN 7776000000000000 WHEN 1 THEN CAST(regexp_extract(duration_text, '^([0-9]+)h', 1) AS BIGINT) * 3600000000000 + text_id % 60 * 60000000000
      WHEN 2 THEN text_id % 90 * 1000000000 + 500000000 WHEN 3 THEN CASE duration_text WHEN '0.0000001h' THEN 360000 WHEN '-1.0000000019s.5us' THEN -1000000501 END WHEN 4 THEN -(text_id % 50) * 1000000 WHEN 5 THEN text_id * 1000 + text_id % 9 WHEN 7 THEN CAST(regexp_extract(duration_text, '^([0-9]+)h', 1) AS BIGINT) * 3600000000000 END AS ns FROM fx_texts""")(
    lambda t: t.select("text_id", s.duration_ns("duration_text", rules.QUARTER_NS).alias("ns"))
)
query("parse_quantity", "fx_texts", sql="""
    SELECT text_id, CAST(CASE text_id % 7 WHEN 0 THEN CAST(replace(quantity_text, 'Mi', '') AS DOUBLE) * 1048576 WHEN 1 THEN CAST(text_id % 40 AS DOUBLE) * 1073741824 WHEN 2 THEN (text_id % 90 + 0.5) * 1024
      WHEN 3 THEN CAST(replace(quantity_text, 'M', '') AS DOUBLE) * 1000000 WHEN 4 THEN CASE WHEN quantity_text = '4e1.5' THEN 126.491106407 ELSE text_id % 13 * 1000.0 END
      WHEN 5 THEN CASE quantity_text WHEN '3Pi' THEN 3377699720527872 WHEN '7Ei' THEN 8070450532247928832 WHEN '2P' THEN 2000000000000000 WHEN '8E' THEN 8000000000000000000 WHEN '1500u' THEN 0.0015 WHEN '64n' THEN 0.000000064 END WHEN 6 THEN text_id / 1000.0 END AS DOUBLE) AS units FROM fx_texts""")(
    lambda t: t.select("text_id", s.quantity("quantity_text").cast("double").alias("units"))
)
SEM = "regexp_extract({c}, '^(0|[1-9][0-9]*)\\.(0|[1-9][0-9]*)\\.(0|[1-9][0-9]*)(-[0-9A-Za-z.-]+)?(\\+[0-9A-Za-z.-]+)?$', {i})"
query("semver_parts", "fx_texts", sql=f"SELECT text_id, {', '.join(f'TRY_CAST({SEM.format(c="version_text", i=i)} AS BIGINT) AS {n}' for i, n in ((1, 'major'), (2, 'minor'), (3, 'patch')))} FROM fx_texts")(
    lambda t: t.withColumn("v", s.semver("version_text")).select("text_id", "v.major", "v.minor", "v.patch")
)
query("probe_text", "fx_probes", sql="""
    SELECT endpoint, concat('endpoint: ', endpoint, ', health: ', CASE WHEN health THEN 'true' ELSE 'false' END, ', took: ', took, CASE WHEN has_status THEN concat(', isLearner: ', CASE WHEN is_learner THEN 'true' ELSE 'false' END) ELSE '' END,
      CASE WHEN error <> '' THEN concat('error: ', error) ELSE '' END) AS line FROM fx_probes""")(lambda p: p.select("endpoint", s.probe_text("endpoint", "health", "took", "has_status", "is_learner", "error").alias("line")))
query("cert_secret_names", "fx_clusters", sql="SELECT cluster_id, purpose, concat(name, '-', purpose, '-tls') AS secret FROM fx_clusters, (VALUES ('client'), ('server'), ('peer')) t(purpose)")(
    lambda c: c.select("cluster_id", "name", F.explode(F.array(*map(F.lit, ("client", "server", "peer")))).alias("purpose")).select("cluster_id", "purpose", F.concat_ws("-", "name", "purpose", F.lit("tls")).alias("secret"))
)


def exported(specs: DataFrame) -> DataFrame:
    """fx_specs as exported objects in JSON: (cluster_id, value). Names, addresses and organisations are lists."""
    split = lambda name: F.split(name, ",")
    common = [F.col("common_name").alias("commonName"), split("organisation").alias("organizations"), F.struct(split("dns_name").alias("dnsNames"), split("ip_address").alias("ipAddresses")).alias("altNames"), F.col("validity").alias("validityDuration")]
    auto, manager = F.when(F.col("has_auto"), F.struct(*common)), F.when(F.col("has_manager"), F.struct(*common, F.col("issuer_kind").alias("issuerKind"), F.col("issuer_name").alias("issuerName")))
    tls = F.when(F.col("has_tls"), F.struct("provider", F.struct(auto.alias("autoCfg"), manager.alias("certManagerCfg")).alias("providerCfg")))
    storage = F.when(F.col("has_storage"), F.struct(F.col("access_mode").alias("accessModes"), F.col("pvc_name").alias("pvcName"), F.col("request_text").alias("volumeSizeRequest"), F.col("limit_text").alias("volumeSizeLimit")))
    notes = F.struct(F.create_map(F.lit("app"), F.col("name")).alias("labels"), F.create_map(F.lit("team"), F.concat(F.lit("t"), F.col("uid") % 5)).alias("annotations"))
    spec = F.struct("size", "version", F.array(F.concat(F.lit("--name="), "name")).alias("options"), storage.alias("storageSpec"), tls.alias("tls"), F.struct(notes.alias("metadata")).alias("podTemplate"))
    meta = F.struct("namespace", "name", F.col("uid").cast("string").alias("uid"), F.lit(1).alias("generation"))
    return specs.select("cluster_id", "namespace", F.to_json(F.struct(meta.alias("metadata"), spec.alias("spec"))).alias("value"))


# Rules --------------------------------------------------------------------------------------------------------------

_SPEC_SQL = {
    "rule_size": "SELECT cluster_id, 'error' AS severity, CAST(size AS VARCHAR) AS detail FROM fx_specs WHERE size < 1",
    "rule_required": "SELECT cluster_id, 'error' AS severity, concat_ws(',', CASE WHEN size IS NULL THEN 'size' END, CASE WHEN version IS NULL THEN 'version' END) AS detail FROM fx_specs WHERE size IS NULL OR version IS NULL",
    "rule_volume_min": "SELECT cluster_id, 'error' AS severity, concat(CASE request_text WHEN '1Ki' THEN '1024' ELSE '1048575' END, ' of ', CASE WHEN limit_text <> '0' THEN replace(limit_text, 'k', '000') WHEN request_text = '1Ki' THEN '1024' ELSE '1048575' END) AS detail FROM fx_specs WHERE has_storage AND request_text IN ('1Ki', '1048575999m')",
    "rule_access_mode": "SELECT cluster_id, 'error' AS severity, access_mode AS detail FROM fx_specs WHERE has_storage AND (access_mode = 'ReadOnlyMany' OR access_mode = 'ReadWriteMany' AND pvc_name = '')",
    "rule_auto_validity": "SELECT cluster_id, 'error' AS severity, validity AS detail FROM fx_specs WHERE has_tls AND provider IN ('', 'auto') AND validity = '100h'",
    "rule_provider": "SELECT cluster_id, 'error' AS severity, CASE WHEN provider = 'other' THEN provider ELSE concat_ws(',', provider, CASE WHEN NOT has_manager THEN 'no config' END, CASE WHEN issuer_kind IS NULL THEN 'no kind' END, CASE WHEN issuer_name IS NULL THEN 'no name' END) END AS detail FROM fx_specs WHERE has_tls AND (provider = 'other' OR provider = 'cert-manager' AND (NOT has_manager OR issuer_kind IS NULL OR issuer_name IS NULL))",
    "rule_cn_length": "SELECT cluster_id, 'warn' AS severity, CAST(length(common_name) AS VARCHAR) AS detail FROM fx_specs WHERE length(common_name) > 64",
    "rule_tls_missing": "SELECT cluster_id, 'warn' AS severity, 'no tls' AS detail FROM fx_specs WHERE NOT has_tls",
}
for _name, _text in _SPEC_SQL.items():
    query(_name, "fx_specs", sql=_text)(lambda c, n=_name: rules.check_rules(rules.parsed_specs(c), [r for r in rules.spec_rules() if r[0] == n]).drop("rule"))
query("check_rules", "fx_specs", sql=" UNION ALL ".join(f"SELECT cluster_id, '{n}' AS rule, severity, detail FROM ({t}) r{i}" for i, (n, t) in enumerate(_SPEC_SQL.items())))(rules.check_specs)
query("rule_condition_format", "fx_conditions", sql="""
    SELECT condition_id, bad AS detail FROM (SELECT condition_id, concat_ws(',', CASE WHEN type IN ('-bad', 'a/b/c') OR length(type) > 316 THEN 'type' END, CASE WHEN reason IN ('9lives', '') OR length(reason) > 1024 THEN 'reason' END, CASE WHEN length(message) > 32768 THEN 'message' END,
      CASE WHEN observed_generation < 0 THEN 'generation' END, CASE WHEN status = 'yes' THEN 'status' END) AS bad FROM fx_conditions) q WHERE bad <> ''""")(lambda c: rules.check_rules(c, rules.condition_rules()[:1], "condition_id").select("condition_id", "detail"))
query("rule_required_condition", "fx_conditions", sql="SELECT condition_id, concat_ws(',', CASE WHEN type IS NULL THEN 'type' END, CASE WHEN transition_at IS NULL THEN 'transition_at' END) AS detail FROM fx_conditions WHERE type IS NULL OR transition_at IS NULL")(
    lambda c: rules.check_rules(c, rules.condition_rules()[1:], "condition_id").select("condition_id", "detail")
)
query("rule_required_member", "fx_probes", sql="SELECT endpoint, 'id' AS detail FROM fx_probes WHERE member_id IS NULL")(lambda p: rules.check_rules(p, rules.member_rules(), "endpoint").select("endpoint", "detail"))
_now = f"TIMESTAMP '{AS_OF}'"
_STATUS = "CASE WHEN first_condition = 'Issuing' THEN 'pending' WHEN first_condition <> 'Ready' THEN 'unknown' END"
_STRICT = "CASE WHEN first_condition = 'Issuing' OR first_condition = 'Ready' AND first_status <> 'True' THEN 'pending' WHEN first_condition <> 'Ready' THEN 'unknown' END"
_LACKS = "concat_ws(',', CASE WHEN NOT list_contains(string_split(key_names, ','), 'tls.crt') THEN 'tls.crt' END, CASE WHEN NOT list_contains(string_split(key_names, ','), 'tls.key') THEN 'tls.key' END)"


def _with_keys(certs: DataFrame) -> DataFrame:
    return certs.withColumn("data_keys", F.split("key_names", ","))


for _name, _cond, _detail in (
    ("rule_cert_window", f"not_before > {_now} OR not_after < {_now}", f"CASE WHEN not_before > {_now} THEN 'not yet valid' ELSE 'expired' END"),
    ("rule_cert_keys", f"{_LACKS} <> ''", _LACKS), ("rule_cert_status", f"{_STATUS} IS NOT NULL", _STATUS), ("rule_cert_status_strict", f"{_STRICT} IS NOT NULL", _STRICT),
):
    query(_name, "fx_certs", sql=f"SELECT secret_name, {_detail} AS detail FROM fx_certs WHERE {_cond}")(
        lambda c, n=_name: rules.check_rules(_with_keys(c), [r for r in rules.cert_rules(AS_OF, n.endswith("_strict")) if r[0] == n.removesuffix("_strict")], "secret_name").select("secret_name", "detail")
    )
query("rule_owned", "fx_clusters", "fx_workloads", sql="SELECT w.cluster_id FROM fx_workloads w JOIN fx_clusters c ON c.cluster_id = w.cluster_id WHERE NOT (w.is_controller AND w.owner_uid = c.uid)")(rules.owned)
query("rule_issuer", "fx_specs", "fx_issuers", sql="""
    SELECT cluster_id, issuer_kind, issuer_name FROM fx_specs s WHERE has_tls AND provider = 'cert-manager' AND has_manager AND issuer_kind IS NOT NULL AND issuer_name IS NOT NULL
      AND NOT EXISTS (SELECT 1 FROM fx_issuers i WHERE i.kind = s.issuer_kind AND i.name = s.issuer_name AND i.namespace IS NOT DISTINCT FROM CASE WHEN s.issuer_kind = 'Issuer' THEN s.namespace END)""")(rules.issuer_missing)

# Joins --------------------------------------------------------------------------------------------------------------

query("join_cluster_workload", "fx_clusters", "fx_workloads", sql="SELECT c.cluster_id, c.size, w.replicas, w.ready_replicas FROM fx_clusters c LEFT JOIN fx_workloads w ON w.namespace = c.namespace AND w.name = c.name")(readiness.with_workload)
query("join_member_probe", "fx_members", "fx_probes", sql="SELECT m.cluster_id, m.member_id, m.position, m.member_name, p.endpoint, p.health FROM fx_members m LEFT JOIN fx_probes p ON p.cluster_id = m.cluster_id AND p.member_id = m.member_id")(members.pair)
_PLACE = "SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY endpoint) - 1 AS place FROM "
query("join_member_probe_position", "fx_members_all", sql=f"SELECT m.cluster_id, m.member_id, m.position, m.member_name, p.endpoint, p.health FROM fx_members_all m LEFT JOIN ({_PLACE} fx_members_all) p ON p.cluster_id = m.cluster_id AND p.place = m.position")(
    lambda m: members.pair(m, m, "position")
)
query("pairing_audit", "fx_members_all", sql=f"SELECT m.cluster_id, m.member_id, m.endpoint AS by_id, p.endpoint AS by_position FROM fx_members_all m JOIN ({_PLACE} fx_members_all) p ON p.cluster_id = m.cluster_id AND p.place = m.position WHERE m.endpoint <> p.endpoint")(
    lambda m: members.pairing_audit(m, m)
)
query("join_version_line", "fx_workloads", "fx_version_line", sql=f"SELECT w.cluster_id, w.tag, l.idx FROM (SELECT cluster_id, substr(image, instr(image, ':') + 1) AS tag FROM fx_workloads) w LEFT JOIN fx_version_line l ON l.major = TRY_CAST({SEM.format(c='w.tag', i=1)} AS BIGINT) AND l.minor = TRY_CAST({SEM.format(c='w.tag', i=2)} AS BIGINT)")(readiness.version_index)
query("cert_coverage", "fx_clusters", "fx_certs", sql="SELECT cluster_id, concat(name, '-', t.purpose, '-tls') AS secret_name FROM fx_clusters c, (VALUES ('client'), ('server'), ('peer')) t(purpose) WHERE NOT EXISTS (SELECT 1 FROM fx_certs k WHERE k.namespace = c.namespace AND k.secret_name = concat(c.name, '-', t.purpose, '-tls'))")(certificates.coverage)
_AFTER = "SELECT cluster_id, member_name, CASE WHEN cluster_id % 19 = 0 THEN member_id + 1000000 ELSE member_id END AS member_id FROM fx_members WHERE NOT (cluster_id % 23 = 0 AND ordinal = 1)"
query("member_identity_drift", "fx_members", sql=f"SELECT m.cluster_id, m.member_name, m.member_id AS old_id, a.member_id AS new_id, CASE WHEN a.member_id IS NULL THEN 'lost' ELSE 'changed' END AS kind FROM fx_members m LEFT JOIN ({_AFTER}) a ON a.cluster_id = m.cluster_id AND a.member_name = m.member_name WHERE m.member_id IS DISTINCT FROM a.member_id")(
    lambda m: members.identity_drift(m, m.filter("NOT (cluster_id % 23 = 0 AND ordinal = 1)").select("cluster_id", "member_name", F.expr("CASE WHEN cluster_id % 19 = 0 THEN member_id + 1000000 ELSE member_id END").alias("member_id")))
)
query("replicate_mismatch", "fx_workloads", "fx_members", sql="SELECT w.cluster_id, w.replicas, m.members, CASE WHEN w.replicas < m.members THEN 'grow' ELSE 'shrink' END AS direction FROM fx_workloads w JOIN (SELECT cluster_id, count(*) AS members FROM fx_members GROUP BY cluster_id) m ON m.cluster_id = w.cluster_id WHERE w.replicas <> m.members")(readiness.replicate_mismatch)


@query("time_to_ready", "fx_history", sql="""
    SELECT c.cluster_id, c.probe_id AS change_id, c.ts, min(r.ts) AS ready_at, min(r.ts) IS NULL AS timed_out FROM fx_history c LEFT JOIN fx_history r
      ON r.cluster_id = c.cluster_id AND r.event_type = 'purchase' AND r.ts >= c.ts AND r.ts <= c.ts + INTERVAL '6' HOUR WHERE c.event_type = 'signup' GROUP BY 1, 2, 3""")
def time_to_ready(h: DataFrame) -> DataFrame:
    return history.time_to_ready(h.filter("event_type = 'signup'").select("cluster_id", F.col("probe_id").alias("change_id"), "ts"), h.filter("event_type = 'purchase'"), "6 HOUR")


query("learner_lag_asof", "fx_history", sql="""
    SELECT cluster_id, probe_id, revision, leader_revision, leader_revision - revision AS lag FROM (SELECT *, last_value(CASE WHEN ordinal = 0 THEN revision END IGNORE NULLS) OVER (PARTITION BY cluster_id ORDER BY ts, probe_id ROWS UNBOUNDED PRECEDING) AS leader_revision FROM fx_history) q WHERE ordinal <> 0""")(
    lambda h: history.learner_lag_asof(h, F.col("ordinal") == 0)
)

# Aggregations and rankings ------------------------------------------------------------------------------------------

_HEALTH = "SELECT cluster_id, count(*) FILTER (WHERE health) AS healthy, count(*) AS probes FROM fx_probes GROUP BY cluster_id"
_MEMBERS = "SELECT cluster_id, count(*) AS members, bool_or(is_learner) AS any_learner FROM fx_members GROUP BY cluster_id"
query("health_counts", "fx_probes", sql=_HEALTH)(members.health_counts)
query("quorum", "fx_members", "fx_probes", sql=f"SELECT m.cluster_id, members, coalesce(healthy, 0) AS healthy, members // 2 + 1 AS quorum, coalesce(healthy, 0) >= members // 2 + 1 AS available FROM ({_MEMBERS}) m LEFT JOIN ({_HEALTH}) h ON h.cluster_id = m.cluster_id")(members.quorum_state)
_BAD = "SELECT cluster_id, string_agg(format('{:x}', CAST(coalesce(member_id, 0) AS UBIGINT)), ', ' ORDER BY endpoint) AS members FROM fx_probes WHERE NOT health AND has_status GROUP BY cluster_id"
query("unhealthy_members", "fx_probes", sql=_BAD)(members.unhealthy_members)
query("any_learner", "fx_members", sql=f"SELECT cluster_id, any_learner FROM ({_MEMBERS}) m")(lambda m: members.member_summary(m).select("cluster_id", "any_learner"))
query("all_healthy", "fx_clusters", "fx_probes", sql="SELECT c.cluster_id, coalesce(bool_and(p.health), true) AS all_healthy FROM fx_clusters c LEFT JOIN fx_probes p ON p.cluster_id = c.cluster_id GROUP BY c.cluster_id")(readiness.all_healthy)
query("member_count", "fx_members", sql=f"SELECT cluster_id, members FROM ({_MEMBERS}) m")(lambda m: members.member_summary(m).select("cluster_id", "members"))
query("kv_consistency", "fx_kv_hashes", sql="SELECT cluster_id, count(*) AS responses, count(DISTINCT hash) AS hashes, count(DISTINCT hash) = 1 AS consistent FROM fx_kv_hashes GROUP BY cluster_id")(members.kv_consistency)
query("probe_errors", "fx_probes", sql="""
    SELECT cluster_id, string_agg(line, '; ' ORDER BY line) AS errors FROM (SELECT DISTINCT cluster_id, concat('endpoint: ', endpoint, ', health: false, took: ', took, CASE WHEN has_status THEN concat(', isLearner: ', CASE WHEN is_learner THEN 'true' ELSE 'false' END) ELSE '' END,
      CASE WHEN error <> '' THEN concat('error: ', error) ELSE '' END) AS line FROM fx_probes WHERE NOT health) q GROUP BY cluster_id""")(readiness.probe_errors)
query("voters_settled", "fx_clusters", "fx_members", sql=f"SELECT c.cluster_id, coalesce(members, 0) = size AND NOT coalesce(any_learner, false) AS settled FROM fx_clusters c LEFT JOIN ({_MEMBERS}) m ON m.cluster_id = c.cluster_id")(readiness.voters_settled)
query("rollout_ready", "fx_clusters", "fx_workloads", sql="SELECT w.cluster_id, replicas = size AND observed_generation >= w.generation AND status_replicas = size AND ready_replicas = size AS ready FROM fx_workloads w JOIN fx_clusters c ON c.cluster_id = w.cluster_id")(readiness.rollout_ready)
query("workload_ready", "fx_workloads", sql="SELECT cluster_id, ready_replicas = replicas AS ready FROM fx_workloads")(readiness.workload_ready)


@query("survey_summary", "fx_answers", sql="""
    WITH one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY organisation ORDER BY clusters DESC, respondent DESC) AS k FROM fx_answers WHERE complete AND interested) q WHERE k = 1),
    thirds AS (SELECT *, ntile(3) OVER (ORDER BY clusters, organisation) AS third FROM one),
    long AS (SELECT third, 'wants_backup' AS feature, wants_backup AS w FROM thirds UNION ALL SELECT third, 'wants_upgrade', wants_upgrade FROM thirds UNION ALL SELECT third, 'wants_tls', wants_tls FROM thirds),
    sums AS (SELECT third, feature, count(*) AS answers, count(*) FILTER (WHERE w) AS wanting FROM long GROUP BY third, feature)
    SELECT *, CASE WHEN 100.0 * wanting / answers > 78 THEN 'most' WHEN 100.0 * wanting / answers > 52 THEN 'many' WHEN 100.0 * wanting / answers >= 33 THEN 'some' ELSE 'few' END AS bucket FROM sums""")
def survey_summary(a: DataFrame) -> DataFrame:
    return history.survey_summary(a, ["wants_backup", "wants_upgrade", "wants_tls"])


_FIRST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY endpoint) AS k FROM fx_probes WHERE {c}) q WHERE k = 1"
_LEADER, _LEARNER, _ANY = _FIRST.format(c="leader = member_id"), _FIRST.format(c="is_learner"), _FIRST.format(c="true")
query("find_leader", "fx_probes", sql=f"SELECT c.cluster_id, l.member_id AS leader_id FROM (SELECT DISTINCT cluster_id FROM fx_probes) c LEFT JOIN ({_LEADER}) l ON l.cluster_id = c.cluster_id")(lambda p: members.probe_summary(p).select("cluster_id", F.col("leader.member_id").alias("leader_id")))
query("find_learner", "fx_probes", sql=f"SELECT cluster_id, member_id AS learner_id FROM ({_LEARNER}) l")(lambda p: members.probe_summary(p).filter("learner IS NOT NULL").select("cluster_id", F.col("learner.member_id").alias("learner_id")))
query("learner_ready", "fx_probes", sql=f"SELECT a.cluster_id, a.revision AS learner_revision, b.revision AS leader_revision, CASE WHEN b.revision = 0 THEN a.revision > 0 ELSE CAST(a.revision AS DOUBLE) / b.revision >= 0.9 END AS ready FROM ({_LEARNER}) a JOIN ({_LEADER}) b ON b.cluster_id = a.cluster_id")(members.learner_ready)
query("scale_in_victim", "fx_members_all", sql="SELECT cluster_id, arg_max(member_id, endpoint) AS by_text, arg_max(member_id, ordinal) AS by_ordinal FROM fx_members_all GROUP BY cluster_id")(readiness.scale_in_victim)
query("probe_targets", "fx_workloads", "fx_members", sql=f"SELECT w.cluster_id, i.i AS ordinal, {url('w.name', 'w.namespace', 'i.i', 2379)} AS endpoint FROM fx_workloads w JOIN ({_MEMBERS}) m ON m.cluster_id = w.cluster_id JOIN (SELECT unnest(range(64)) AS i) i ON i.i < least(w.replicas, m.members)")(members.probe_targets)
query("health_report", "fx_probes", sql="SELECT cluster_id, endpoint, health, row_number() OVER (PARTITION BY cluster_id ORDER BY endpoint) AS place FROM fx_probes")(readiness.health_report)
_VERSION = f"SELECT c.cluster_id, coalesce(l.version, CASE WHEN f.has_status THEN f.version END, c.version) AS version FROM fx_clusters c LEFT JOIN ({_LEADER}) l ON l.cluster_id = c.cluster_id LEFT JOIN ({_ANY}) f ON f.cluster_id = c.cluster_id"
query("current_version", "fx_probes", "fx_clusters", sql=_VERSION)(lambda p, c: members.current_version(p, c.select("cluster_id", F.col("version").alias("previous"))))
_WANTED = "SELECT c.cluster_id, concat(c.name, '-', i.i) AS member_name FROM fx_clusters c JOIN (SELECT unnest(range(64)) AS i) i ON i.i < c.size"
_THERE = "SELECT cluster_id, member_name FROM fx_members"
query("snapshot_diff", "fx_clusters", "fx_members", sql=f"SELECT *, 'missing' AS side FROM ({_WANTED} EXCEPT ALL {_THERE}) a UNION ALL SELECT *, 'unexpected' FROM ({_THERE} EXCEPT ALL {_WANTED}) b")(
    lambda c, m: members.snapshot_diff(c.select("cluster_id", "name", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("i")).select("cluster_id", s.member_name("name", "i").alias("member_name")), m.select("cluster_id", "member_name"))
)
query("ordinal_gaps", "fx_members_gaps", sql="""
    WITH h AS (SELECT cluster_id, ordinal FROM fx_members_gaps), g AS (SELECT cluster_id, max(ordinal) AS last FROM h GROUP BY cluster_id)
    SELECT g.cluster_id, string_agg(CAST(i.i AS VARCHAR), ',' ORDER BY i.i) AS missing FROM g JOIN (SELECT unnest(range(64)) AS i) i ON i.i <= g.last WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.cluster_id = g.cluster_id AND h.ordinal = i.i) GROUP BY g.cluster_id""")(members.ordinal_gaps)

# Decisions ----------------------------------------------------------------------------------------------------------

_PARTS = ", ".join(f"TRY_CAST({SEM.format(c=c, i=i)} AS BIGINT) AS {n}{i}" for n, c in (("c", "cur"), ("t", "target")) for i in (1, 2, 3))
_VERDICT = f"""SELECT cluster_id, cur AS current, target, CASE WHEN cur = target THEN 'unchanged' WHEN c1 IS NULL OR t1 IS NULL THEN 'unvalidated' WHEN a.idx IS NULL THEN 'unknown_current' WHEN b.idx IS NULL THEN 'unknown_target'
      WHEN b.idx < a.idx OR b.idx = a.idx AND t3 < c3 THEN 'downgrade' WHEN b.idx - a.idx > 1 THEN 'skips_minor' ELSE 'supported' END AS verdict
    FROM (SELECT *, {_PARTS} FROM (SELECT c.cluster_id, c.version AS target, substr(w.image, instr(w.image, ':') + 1) AS cur FROM fx_clusters c JOIN fx_workloads w ON w.cluster_id = c.cluster_id) q) q2
      LEFT JOIN fx_version_line a ON a.major = c1 AND a.minor = c2 LEFT JOIN fx_version_line b ON b.major = t1 AND b.minor = t2"""
query("upgrade_verdict", "fx_clusters", "fx_workloads", "fx_version_line", sql=_VERDICT)(decisions.upgrade_verdict)
_STATE = f"""state AS (SELECT c.cluster_id, c.uid, c.namespace, c.name, c.size, c.generation, w.replicas, w.ready_replicas, w.owner_uid, w.is_controller, coalesce(m.members, 0) AS members, m.any_learner, coalesce(h.probes, 0) AS probes, coalesce(h.healthy, 0) AS healthy,
      l.member_id AS leader_id, l.revision AS leader_rev, n.member_id AS learner_id, n.revision AS learner_rev, x.members AS bad, z.victim
    FROM fx_clusters c LEFT JOIN fx_workloads w ON w.cluster_id = c.cluster_id LEFT JOIN ({_MEMBERS}) m ON m.cluster_id = c.cluster_id LEFT JOIN ({_HEALTH}) h ON h.cluster_id = c.cluster_id LEFT JOIN ({_LEADER}) l ON l.cluster_id = c.cluster_id
      LEFT JOIN ({_LEARNER}) n ON n.cluster_id = c.cluster_id LEFT JOIN ({_BAD}) x ON x.cluster_id = c.cluster_id
      LEFT JOIN (SELECT cluster_id, member_id AS victim FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY endpoint DESC) AS k FROM fx_probes) q WHERE k = 1) z ON z.cluster_id = c.cluster_id)"""
_CONDITIONS = f"""WITH {_STATE}
    SELECT cluster_id, 'Available' AS type, CASE WHEN members > 0 AND healthy >= members // 2 + 1 THEN 'True' ELSE 'False' END AS status, CASE WHEN members > 0 AND healthy >= members // 2 + 1 THEN 'ClusterAvailable' ELSE 'ClusterNotReady' END AS reason,
      CASE WHEN members = 0 THEN 'Cluster is not yet available' WHEN healthy >= members // 2 + 1 THEN concat('Cluster has ', healthy, '/', members, ' healthy members with quorum') ELSE concat('Cluster has ', healthy, '/', members, ' healthy members, quorum requires ', members // 2 + 1) END AS message FROM state
    UNION ALL SELECT cluster_id, 'Progressing', CASE WHEN replicas IS NOT NULL AND (any_learner OR replicas <> size OR members > 0 AND members <> size) THEN 'True' ELSE 'False' END,
      CASE WHEN replicas IS NULL THEN 'ClusterStable' WHEN any_learner THEN 'LearnerPromotion' WHEN replicas <> size THEN 'ScalingInProgress' WHEN members > 0 AND members <> size THEN 'MembershipChanging' ELSE 'ClusterStable' END,
      CASE WHEN replicas IS NULL THEN 'Cluster is stable' WHEN any_learner THEN 'Promoting learner to voting member' WHEN replicas <> size THEN concat('Scaling from ', replicas, ' to ', size, ' replicas') WHEN members > 0 AND members <> size THEN concat('Membership changing from ', members, ' to ', size) ELSE 'Cluster is stable' END FROM state
    UNION ALL SELECT cluster_id, 'Degraded', CASE WHEN bad IS NULL THEN 'False' ELSE 'True' END, CASE WHEN bad IS NULL THEN 'ClusterHealthy' ELSE 'UnhealthyMembers' END, CASE WHEN bad IS NULL THEN 'All members are healthy' ELSE concat('Unhealthy members: ', bad) END FROM state"""
_four = ("fx_clusters", "fx_workloads", "fx_members", "fx_probes")
query("conditions", *_four, sql=_CONDITIONS)(lambda *v: decisions.conditions(decisions.observed(*v)))
_ACTION = f"""{_STATE}, verdicts AS ({_VERDICT}), acted AS (SELECT s.*, coalesce(CASE WHEN leader_rev = 0 THEN learner_rev > 0 ELSE CAST(learner_rev AS DOUBLE) / leader_rev >= 0.9 END, false) AS ready,
      CASE WHEN owner_uid IS NOT NULL AND NOT (owner_uid = uid AND is_controller) THEN 'error_not_controlled' WHEN verdict IN ('unknown_current', 'unknown_target', 'downgrade', 'skips_minor') THEN 'error_upgrade_path' WHEN owner_uid IS NULL THEN 'bootstrap_create'
        WHEN replicas = 0 THEN 'bootstrap_one' WHEN probes > healthy THEN 'error_unhealthy' WHEN replicas < members THEN 'workload_grow' WHEN replicas > members THEN 'workload_shrink' WHEN members > 0 AND leader_id IS NULL THEN 'error_no_leader'
        WHEN learner_id IS NOT NULL AND leader_id IS NOT NULL AND NOT coalesce(CASE WHEN leader_rev = 0 THEN learner_rev > 0 ELSE CAST(learner_rev AS DOUBLE) / leader_rev >= 0.9 END, false) THEN 'wait_learner'
        WHEN replicas = size THEN 'up_to_date' WHEN replicas < size THEN 'scale_out' ELSE 'scale_in' END AS action
    FROM state s LEFT JOIN verdicts v ON v.cluster_id = s.cluster_id),
    decided AS (SELECT cluster_id, action, CASE action WHEN 'workload_grow' THEN CAST(replicas + 1 AS VARCHAR) WHEN 'workload_shrink' THEN CAST(replicas - 1 AS VARCHAR) WHEN 'scale_out' THEN {url('name', 'namespace', 'replicas', 2380)} WHEN 'scale_in' THEN format('{{:x}}', CAST(victim AS UBIGINT)) END AS argument,
      action IN ('up_to_date', 'scale_out', 'scale_in') AND learner_id IS NOT NULL AND leader_id IS NOT NULL AND ready AS promote, coalesce(action = 'scale_in' AND leader_id = victim, false) AS victim_is_leader FROM acted)"""
query("next_action", *_four, "fx_version_line", sql=f"WITH {_ACTION} SELECT * FROM decided")(lambda c, w, m, p, line: decisions.next_action(decisions.judged(decisions.observed(c, w, m, p), line)))
query("fleet_summary", *_four, "fx_version_line", sql=f"WITH {_ACTION} SELECT action, count(*) AS clusters, count(*) FILTER (WHERE promote) AS promoting FROM decided GROUP BY action")(
    lambda c, w, m, p, line: decisions.next_action(decisions.judged(decisions.observed(c, w, m, p), line)).groupBy("action").agg(F.count("*").alias("clusters"), F.count_if("promote").alias("promoting"))
)
query("fleet_summary_conditions", *_four, sql=f"""WITH cond AS ({_CONDITIONS.replace("WITH state", "WITH state", 1)}), each_ AS (SELECT cluster_id, max(status) FILTER (WHERE type = 'Available') AS available, max(status) FILTER (WHERE type = 'Progressing') AS progressing,
    max(status) FILTER (WHERE type = 'Degraded') AS degraded FROM cond GROUP BY cluster_id) SELECT available, progressing, degraded, count(*) AS clusters FROM each_ GROUP BY ALL""")(lambda *v: decisions.condition_summary(decisions.conditions(decisions.observed(*v))))


def flat_status(status: DataFrame) -> DataFrame:
    """The member array as one text."""
    return status.withColumn("members", F.expr("array_join(transform(members, m -> concat_ws(':', m.position, m.id, m.name, m.is_healthy, coalesce(m.version, ''), m.is_leader, m.is_learner)), ',')"))


_EACH = """SELECT m.cluster_id, string_agg(concat(m.position, ':', format('{:x}', CAST(m.member_id AS UBIGINT)), ':', m.member_name, ':', CASE WHEN p.health THEN 'true' ELSE 'false' END, ':', coalesce(p.version, ''), ':',
    CASE WHEN p.leader = p.member_id THEN 'true' ELSE 'false' END, ':', CASE WHEN m.is_learner THEN 'true' ELSE 'false' END), ',' ORDER BY m.position) AS members FROM fx_members m LEFT JOIN fx_probes p ON p.cluster_id = m.cluster_id AND p.member_id = m.member_id GROUP BY m.cluster_id"""
query("cluster_status", *_four, sql=f"""WITH {_STATE}, v AS ({_VERSION}), e AS ({_EACH}) SELECT s.cluster_id, e.members, generation AS observed_generation, coalesce(replicas, 0) AS current_replicas, coalesce(ready_replicas, 0) AS ready_replicas, s.members AS member_count,
    format('{{:x}}', CAST(leader_id AS UBIGINT)) AS leader_id, v.version AS current_version FROM state s JOIN v ON v.cluster_id = s.cluster_id LEFT JOIN e ON e.cluster_id = s.cluster_id""")(
    lambda c, w, m, p: flat_status(decisions.cluster_status(decisions.observed(c, w, m, p), F.col("version")))
)
_EXPECTED = "SELECT s.cluster_id, s.provider, concat(s.name, '-', t.purpose, '-tls') AS secret_name FROM fx_specs s, (VALUES ('client'), ('server'), ('peer')) t(purpose) WHERE s.has_tls"


def _expected(specs: DataFrame) -> DataFrame:
    return specs.filter("has_tls").select("cluster_id", "provider", F.explode(certificates.secret_names()).alias("secret_name"))


for _name, _said in (("cert_verdict", _STATUS), ("cert_verdict_strict", _STRICT)):
    query(_name, "fx_specs", "fx_certs", sql=f"""SELECT cluster_id, secret_name, CASE WHEN key_names IS NULL THEN 'missing' WHEN provider = 'cert-manager' AND said = 'pending' THEN 'pending' WHEN provider = 'cert-manager' AND said = 'unknown' THEN 'unknown_status'
        WHEN lacks LIKE 'tls.crt%' THEN 'no_cert' WHEN lacks <> '' THEN 'no_key' WHEN not_before > {_now} THEN 'not_yet' WHEN not_after < {_now} THEN 'expired' ELSE 'ok' END AS verdict
      FROM (SELECT e.cluster_id, e.secret_name, e.provider, key_names, {_said} AS said, {_LACKS} AS lacks, not_before, not_after FROM ({_EXPECTED}) e LEFT JOIN fx_certs k ON k.cluster_id = e.cluster_id AND k.secret_name = e.secret_name) q""")(
        lambda c, k, strict=_name.endswith("strict"): decisions.cert_verdict(_expected(c), _with_keys(k), AS_OF, strict)
    )

# History ------------------------------------------------------------------------------------------------------------

_RUNS = "SELECT *, lag(status) OVER (PARTITION BY cluster_id, ordinal ORDER BY ts, probe_id) AS before FROM fx_history"
query("condition_transitions", "fx_history", sql=f"SELECT cluster_id, ordinal, probe_id, ts, status, row_number() OVER (PARTITION BY cluster_id, ordinal ORDER BY ts, probe_id) AS run FROM ({_RUNS}) q WHERE before IS DISTINCT FROM status")(
    lambda h: history.condition_transitions(h.select("cluster_id", "ordinal", "probe_id", "ts", "status"), ["cluster_id", "ordinal"], ["ts", "probe_id"], by=history.span())
)
@query("sink_status", "fx_history", sql="SELECT cluster_id, ts, probe_id, status, revision FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY ts DESC, probe_id DESC) AS k FROM fx_history) q WHERE k = 1")
def sink_status(h: DataFrame) -> DataFrame:
    """A status row for each cluster and day, written by day in four writes, the second of them twice; the latest of what is there."""
    key, order, columns = ["cluster_id"], ["ts", "probe_id"], ["cluster_id", "ts", "probe_id", "status", "revision"]
    rows = h.select(*columns)
    sink = StatusHistory(h.sparkSession, folder(h.sparkSession, "status"), rows.schema, key, order)
    for quarter in (0, 2, 1, 3, 2):
        sink.write(history.latest(rows.filter(F.pmod(F.dayofmonth("ts"), F.lit(4)) == quarter), key, order).select(*columns), f"days {quarter}")
    return sink.latest()
