"""What is asked of a certificate provider, and which secrets are there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.scalar import default_registry, duration_ns
from fleetlens.operators.rules import QUARTER_NS, YEAR_NS

PURPOSES = ("client", "server", "peer")


def secret_names(name: str = "name") -> Column:
    """An array of the names of a cluster's secrets."""
    return F.transform(F.array(*map(F.lit, PURPOSES)), lambda p: F.concat_ws("-", F.col(name), p, F.lit("tls")))


def requests(clusters: DataFrame, key: str = "cluster_id") -> DataFrame:
    """clusters(key, namespace, name, tls as `readers.clusters` gives it): a row for each with a tls block. Names default to the cluster's
    where the provider's block is absent, the common name only then; addresses are passed on as they are; a validity that is
    empty or zero is the provider's default. Arrays stay arrays; null names are no names."""
    c = clusters.filter("tls IS NOT NULL").withColumn("provider", default_registry("tls.provider", "auto"))
    auto, manager = F.col("tls.providerCfg.autoCfg"), F.col("tls.providerCfg.certManagerCfg")
    common = [F.coalesce(*[F.when(own, block[n]) for own, block in ((F.col("provider") == "auto", auto), (F.col("provider") != "auto", manager))]).alias(n) for n in ("commonName", "organizations", "altNames", "validityDuration")]
    there = F.when(F.col("provider") == "auto", auto.isNotNull()).otherwise(manager.isNotNull())
    c = c.withColumns({"cfg": F.struct(*common), "there": there, "fqdn": F.concat(F.concat_ws(".", "name", "namespace"), F.lit(".svc.cluster.local"))})
    default = F.when(F.col("provider") == "auto", YEAR_NS).otherwise(QUARTER_NS).cast("bigint")
    validity = F.coalesce(F.nullif(F.when(F.col("there"), duration_ns(F.coalesce("cfg.validityDuration", F.lit("")), 0)), F.lit(0)), default)
    asked = F.when(F.col("there"), F.col("cfg.altNames.dnsNames"))
    c = c.withColumns({"validity_ns": validity, "dns_names": F.coalesce(asked, F.array(F.concat(F.lit("*."), "fqdn"), F.col("fqdn")))})
    issuer = F.col("there") & (F.col("provider") == "cert-manager")
    return c.select(
        key, "provider", F.when(F.col("there"), F.col("cfg.commonName")).otherwise(F.col("fqdn")).alias("common_name"), "dns_names",
        F.coalesce(F.when(F.col("there"), F.col("cfg.altNames.ipAddresses")), F.array().cast("array<string>")).alias("ip_addresses"), F.when(F.col("there"), F.col("cfg.organizations")).alias("organizations"),
        "validity_ns", F.floor(F.col("validity_ns") / YEAR_NS).cast("int").alias("validity_years"), F.when(issuer, manager["issuerKind"]).alias("issuer_kind"), F.when(issuer, manager["issuerName"]).alias("issuer_name"),
    )


def coverage(clusters: DataFrame, certs: DataFrame, key: str = "cluster_id") -> DataFrame:
    """(key, secret_name) of the secrets that clusters should have and don't."""
    wanted = clusters.select(key, "namespace", F.explode(secret_names()).alias("secret_name"))
    return wanted.join(certs.select("namespace", "secret_name"), ["namespace", "secret_name"], "left_anti").select(key, "secret_name")
