"""Rule checks: every rule is a condition, and one scan of a table gives the violations of all its rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.scalar import duration_ns, quantity

YEAR_NS, QUARTER_NS = 365 * 24 * 3_600_000_000_000, 90 * 24 * 3_600_000_000_000
#: 1 Mi, the least size of a volume.
LEAST_VOLUME = 1048576
Rule = tuple[str, Column, str, Column]  # name, broken, severity, detail


def check_rules(df: DataFrame, rules: list[Rule], key: str = "cluster_id") -> DataFrame:
    """(key, rule, severity, detail): one row for each rule that a row breaks."""
    none = F.lit(None).cast("struct<rule:string,severity:string,detail:string>")
    each = [F.when(F.coalesce(broken, F.lit(False)), F.struct(F.lit(n).alias("rule"), F.lit(sev).alias("severity"), F.coalesce(d.cast("string"), F.lit("")).alias("detail"))).otherwise(none) for n, broken, sev, d in rules]
    return df.select(key, F.explode(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("v")).select(key, "v.*")


def parsed_specs(specs: DataFrame) -> DataFrame:
    """specs with `validity_ns`, `requested` and `limited`, parsed once for all rules that mention them."""
    return specs.withColumns({"validity_ns": duration_ns("validity", YEAR_NS), "requested": quantity("request_text"), "limited": quantity("limit_text")})


def check_specs(specs: DataFrame) -> DataFrame:
    """The violations of all rules for specs."""
    return check_rules(parsed_specs(specs), spec_rules())


def spec_rules() -> list[Rule]:
    """For `parsed_specs`."""
    c = F.col
    validity = F.when(c("validity_ns") == 0, YEAR_NS).otherwise(c("validity_ns"))  # none set is the default
    requested = c("requested")
    limit = F.coalesce(F.nullif(c("limited"), F.lit(0)), requested)
    volume = F.concat(F.coalesce(requested.cast("bigint").cast("string"), F.lit("?")), F.lit(" of "), F.coalesce(limit.cast("bigint").cast("string"), F.lit("?")))
    mode_bad = ~c("access_mode").isin("", "ReadWriteOnce", "ReadWriteMany") | ((c("access_mode") == "ReadWriteMany") & (c("pvc_name") == ""))
    manager = c("has_tls") & (c("provider") == "cert-manager")
    return [
        ("rule_size", c("size") < 1, "error", c("size")),
        ("rule_required", c("size").isNull() | c("version").isNull(), "error", F.concat_ws(",", F.when(c("size").isNull(), "size"), F.when(c("version").isNull(), "version"))),
        ("rule_volume_min", c("has_storage") & (requested.isNull() | (requested < LEAST_VOLUME)), "error", volume),
        ("rule_access_mode", c("has_storage") & mode_bad, "error", c("access_mode")),
        ("rule_auto_validity", c("has_tls") & c("provider").isin("", "auto") & (validity.isNull() | (validity < YEAR_NS)), "error", c("validity")),
        ("rule_provider", c("has_tls") & (~c("provider").isin("", "auto", "cert-manager") | (manager & (~c("has_manager") | c("issuer_kind").isNull() | c("issuer_name").isNull()))), "error", F.concat_ws(",", "provider", F.when(manager & ~c("has_manager"), "no config"), F.when(manager & c("issuer_kind").isNull(), "no kind"), F.when(manager & c("issuer_name").isNull(), "no name"))),
        ("rule_cn_length", F.length("common_name") > 64, "warn", F.length("common_name")),
        ("rule_tls_missing", ~c("has_tls"), "warn", F.lit("no tls")),
    ]


def condition_rules() -> list[Rule]:
    c = F.col
    # The patterns and lengths of a condition's type and reason.
    kind = r"^([a-z0-9]([-a-z0-9]*[a-z0-9])?(\.[a-z0-9]([-a-z0-9]*[a-z0-9])?)*/)?(([A-Za-z0-9][-A-Za-z0-9_.]*)?[A-Za-z0-9])$"
    reason = r"^[A-Za-z]([A-Za-z0-9_,:]*[A-Za-z0-9_])?$"
    bad = F.concat_ws(
        ",", F.when(~c("type").rlike(kind) | (F.length("type") > 316), "type"), F.when(~c("reason").rlike(reason) | (F.length("reason") > 1024), "reason"), F.when(F.length("message") > 32768, "message"),
        F.when(c("observed_generation") < 0, "generation"), F.when(~c("status").isin("True", "False", "Unknown"), "status"),
    )
    missing = F.concat_ws(",", *[F.when(c(name).isNull(), name) for name in ("type", "status", "reason", "message", "transition_at")])
    return [("rule_condition_format", bad != "", "error", bad), ("rule_required_condition", missing != "", "error", missing)]


def member_rules() -> list[Rule]:
    missing = F.concat_ws(",", F.when(F.col("member_id").isNull(), "id"), F.when(F.col("health").isNull(), "health"))
    return [("rule_required_member", missing != "", "error", missing)]


def missing_keys(keys: Column) -> Column:
    """Which of the certificate and its key a secret lacks, in that order."""
    return F.concat_ws(",", *[F.when(~F.array_contains(keys, k), k) for k in ("tls.crt", "tls.key")])


def not_ready(strict: bool = False) -> Column:
    """What the first condition says of a certificate: null if ready or if there is none. strict: Ready must be True as well."""
    kind = F.col("first_condition")
    waits = (kind == "Issuing") | ((kind == "Ready") & (F.col("first_status") != "True")) if strict else kind == "Issuing"
    return F.when(waits, "pending").when(kind != "Ready", "unknown")


def cert_rules(as_of: str, strict: bool = False) -> list[Rule]:
    c, now = F.col, F.lit(as_of).cast("timestamp_ntz")
    return [
        ("rule_cert_window", (c("not_before") > now) | (c("not_after") < now), "error", F.when(c("not_before") > now, "not yet valid").otherwise("expired")),
        ("rule_cert_keys", missing_keys(c("data_keys")) != "", "error", missing_keys(c("data_keys"))),
        ("rule_cert_status", not_ready(strict).isNotNull(), "warn", not_ready(strict)),
    ]


def args_drift(expected: DataFrame, deployed: DataFrame, key: str = "cluster_id") -> DataFrame:
    """(key, expected, deployed, missing, extra) where the args that a cluster should have aren't those deployed, in this order; both of
    expected and deployed(key, args). missing and extra are empty where only the order, or how often one stands there, differs."""
    both = expected.select(key, F.col("args").alias("expected")).join(deployed.select(key, F.col("args").alias("deployed")), key)
    wrong = both.filter(~F.col("expected").eqNullSafe(F.col("deployed")))
    return wrong.withColumns({"missing": F.array_except("expected", "deployed"), "extra": F.array_except("deployed", "expected")})


def owned(clusters: DataFrame, workloads: DataFrame) -> DataFrame:
    """Workloads that their cluster doesn't control."""
    mine = clusters.select("cluster_id", F.col("uid").alias("owner_uid"))
    return workloads.filter("NOT is_controller").select("cluster_id").unionByName(workloads.filter("is_controller").join(mine, ["cluster_id", "owner_uid"], "left_anti").select("cluster_id"))


def issuer_missing(specs: DataFrame, issuers: DataFrame) -> DataFrame:
    """Clusters with a certificate manager whose issuer kind is unknown or whose issuer doesn't exist."""
    asked = specs.filter("has_tls AND provider = 'cert-manager' AND has_manager AND issuer_kind IS NOT NULL AND issuer_name IS NOT NULL")
    place = F.when(F.col("issuer_kind") == "Issuer", F.col("namespace"))
    asked = asked.select("cluster_id", "issuer_kind", "issuer_name", place.alias("place"))
    there = issuers.select("kind", F.col("namespace").alias("ns"), F.col("name").alias("n"))
    return asked.join(there, (F.col("issuer_kind") == F.col("kind")) & F.col("place").eqNullSafe(F.col("ns")) & (F.col("issuer_name") == F.col("n")), "left_anti").select("cluster_id", "issuer_kind", "issuer_name")
