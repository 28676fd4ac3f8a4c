"""Joins and checks of single questions: is a cluster's workload there, rolled out, healthy, and of the right size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.scalar import image_tag, probe_text, semver
from fleetlens.operators.members import KEY, member_summary


def with_workload(clusters: DataFrame, workloads: DataFrame) -> DataFrame:
    """(KEY, size, replicas, ready_replicas): each cluster with the workload of its namespace and name; without one, nulls."""
    w = workloads.select("namespace", "name", "replicas", "ready_replicas")
    return clusters.select(KEY, "namespace", "name", "size").join(w, ["namespace", "name"], "left").drop("namespace", "name")


def version_index(workloads: DataFrame, line: DataFrame) -> DataFrame:
    """(KEY, tag, idx): where each workload's image stands in line(major, minor, idx), a few rows; null where it doesn't."""
    w = workloads.withColumn("tag", image_tag("image")).withColumn("v", semver("tag"))
    return w.join(line, (F.col("v.major") == line["major"]) & (F.col("v.minor") == line["minor"]), "left").select(KEY, "tag", "idx")


def replicate_mismatch(workloads: DataFrame, members: DataFrame) -> DataFrame:
    """Clusters whose list of members and replicas differ in number, and which way the workload has to go."""
    both = workloads.join(member_summary(members), KEY).filter("replicas <> members")
    return both.select(KEY, "replicas", "members", F.when(F.col("replicas") < F.col("members"), "grow").otherwise("shrink").alias("direction"))


def all_healthy(clusters: DataFrame, probes: DataFrame) -> DataFrame:
    """Whether all of a cluster's probes are healthy; true where it has none."""
    each = probes.groupBy(KEY).agg(F.every("health").alias("_all"))
    return clusters.select(KEY).join(each, KEY, "left").select(KEY, F.coalesce("_all", F.lit(True)).alias("all_healthy"))


def probe_errors(probes: DataFrame) -> DataFrame:
    """The texts of a cluster's unhealthy probes, each once, in order."""
    line = probe_text("endpoint", "health", "took", "has_status", "is_learner", "error")
    return probes.filter("NOT health").groupBy(KEY).agg(F.array_join(F.array_sort(F.collect_set(line)), "; ").alias("errors"))


def voters_settled(clusters: DataFrame, members: DataFrame) -> DataFrame:
    """Whether a cluster has as many members as it should, none of them a learner."""
    full = F.coalesce("members", F.lit(0)) == F.col("size")
    return clusters.join(member_summary(members), KEY, "left").select(KEY, (full & ~F.coalesce("any_learner", F.lit(False))).alias("settled"))


def rollout_ready(clusters: DataFrame, workloads: DataFrame) -> DataFrame:
    """Whether the workload has seen its newest generation and has all replicas, of the wanted size, ready."""
    ready = F.expr("replicas = size AND observed_generation >= generation AND status_replicas = size AND ready_replicas = size")
    return workloads.join(clusters.select(KEY, "size"), KEY).select(KEY, ready.alias("ready"))


def workload_ready(workloads: DataFrame) -> DataFrame:
    """Whether all replicas that a workload asks for are ready; null where it asks for no number."""
    return workloads.select(KEY, (F.col("ready_replicas") == F.col("replicas")).alias("ready"))


def scale_in_victim(members: DataFrame) -> DataFrame:
    """The member to remove: the last by endpoint text, and the one of the highest ordinal."""
    return members.groupBy(KEY).agg(F.max_by("member_id", "endpoint").alias("by_text"), F.max_by("member_id", "ordinal").alias("by_ordinal"))


def health_report(probes: DataFrame) -> DataFrame:
    """A cluster's probes by endpoint text, with their place from 1."""
    lists = probes.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("endpoint", "health"))).alias("_r"))
    return lists.select(KEY, F.posexplode("_r").alias("_i", "_x")).select(KEY, "_x.endpoint", "_x.health", (F.col("_i") + 1).alias("place"))
