"""Sources: exported objects and reports as DataFrames, with schemas that are never inferred; and the status sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.sources.keyed import KeyedTable
from fleetlens.sources.shared import staged

_COMMON = "commonName:string,organizations:array<string>,altNames:struct<dnsNames:array<string>,ipAddresses:array<string>>,validityDuration:string,caBundleSecret:string"
TLS = f"struct<provider:string,providerCfg:struct<autoCfg:struct<{_COMMON}>,certManagerCfg:struct<{_COMMON},issuerKind:string,issuerName:string>>>"


def cluster_schema(options: str = "options") -> str:
    """The schema of an exported cluster; options: the name under which the store's options are exported."""
    return (
        "metadata struct<namespace:string,name:string,uid:string,generation:bigint>,"
        f"spec struct<size:int,version:string,imageRegistry:string,{options}:array<string>,"
        "storageSpec:struct<accessModes:string,storageClassName:string,pvcName:string,volumeSizeRequest:string,volumeSizeLimit:string>,"
        f"tls:{TLS},podTemplate:struct<metadata:struct<labels:map<string,string>,annotations:map<string,string>>>>"
    )


WORKLOAD = (
    "metadata struct<namespace:string,name:string,generation:bigint,ownerReferences:array<struct<uid:string,kind:string,controller:boolean>>>,"
    "spec struct<replicas:int,template:struct<spec:struct<containers:array<struct<image:string,args:array<string>>>>>>,"
    "status struct<readyReplicas:int,replicas:int,observedGeneration:bigint>"
)
MEMBERS = "members array<struct<ID:decimal(20,0),name:string,peerURLs:array<string>,isLearner:boolean>>"
PROBE = (
    "endpoint string, health boolean, took string, error string,"
    "Status struct<header:struct<member_id:decimal(20,0),revision:bigint>,leader:decimal(20,0),version:string,isLearner:boolean,errors:array<string>>"
)
CERT = "namespace string, secret_name string, common_name string, organizations array<string>, dns_names array<string>, ip_addresses array<string>, not_before timestamp, not_after timestamp, data_keys array<string>, issuer_kind string, issuer_name string, conditions array<struct<type:string,status:string,reason:string,message:string>>"
CHANGE = "kind string, op string, namespace string, name string, version bigint"


BROKEN = "_broken"


def _parsed(text: DataFrame, schema: str, column: str) -> DataFrame:
    """The texts with `_items`, the objects in each (one, or those of a list), and `_reason`, why a text can't be read as a whole."""
    form = f"items array<struct<{_nested(schema)}>>, {schema}, {BROKEN} string"
    out = text.withColumn("_o", F.from_json(F.col(column), form, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN}))
    single = F.array(F.struct(*[F.col(f"_o.{n}").alias(n) for n in _names(schema)]))
    # null items: the text is one object
    many = F.when(F.col("_o.items").isNotNull(), F.col("_o.items")).otherwise(single)
    reason = F.when(F.col(column).isNull() | (F.trim(F.col(column)) == ""), "empty").when(F.col(f"_o.{BROKEN}").isNotNull() | F.col("_o").isNull(), "unreadable")
    return out.select(*text.columns, reason.alias("_reason"), many.alias("_items"))


def objects(text: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """One row for each object of JSON texts that are an object or a list with items. Texts that can't be read, also those with a
    value of another type than the schema's, and objects without metadata give no rows here: see `rejected`."""
    out = _parsed(text, schema, column).filter("_reason IS NULL")
    return out.select(F.explode("_items").alias("x")).select("x.*").filter("metadata IS NOT NULL")


def rejected(text: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """(column, reason, item): the texts that give no objects, with their whole text, and objects without metadata, with their place in the
    list. A text gives objects, or one row here, or for a list both."""
    out = _parsed(text, schema, column)
    whole = out.filter("_reason IS NOT NULL").select(column, F.col("_reason").alias("reason"), F.lit(None).cast("int").alias("item"))
    each = out.filter("_reason IS NULL").select(column, F.posexplode("_items").alias("item", "x")).filter("x.metadata IS NULL")
    return whole.unionByName(each.select(column, F.lit("no metadata").alias("reason"), "item"))


def _fields(schema: str) -> list[tuple[str, str]]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(schema + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            name, kind = schema[start:i].strip().split(" ", 1)
            out.append((name, kind))
            start = i + 1
    return out


def _names(schema: str) -> list[str]:
    return [n for n, _ in _fields(schema)]


def _nested(schema: str) -> str:
    return ",".join(f"{n}:{k}" for n, k in _fields(schema))


def read_text(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """Whole files, or one object a line."""
    return spark.read.text(path, wholetext=whole)


def clusters(text: DataFrame, options: str = "options") -> DataFrame:
    """options: the name under which the store's options are exported."""
    c = objects(text, cluster_schema(options))
    return c.select(
        "metadata.*", F.col("spec.size").alias("size"), F.col("spec.version").alias("version"), F.col("spec.imageRegistry").alias("image_registry"), F.col(f"spec.{options}").alias("options"), F.col("spec.storageSpec").alias("storage"),
        F.col("spec.tls").alias("tls"), F.col("spec.podTemplate.metadata.labels").alias("pod_labels"), F.col("spec.podTemplate.metadata.annotations").alias("pod_annotations"),
    )


def workloads(text: DataFrame) -> DataFrame:
    w = objects(text, WORKLOAD)
    owner = F.get(F.filter("metadata.ownerReferences", lambda o: F.coalesce(o["controller"], F.lit(False))), 0)
    container = F.get(F.col("spec.template.spec.containers"), 0)
    return w.select(
        "metadata.namespace", "metadata.name", "metadata.generation", owner["uid"].alias("owner_uid"), owner["kind"].alias("owner_kind"), owner.isNotNull().alias("is_controller"), F.col("spec.replicas").alias("replicas"),
        F.col("status.readyReplicas").alias("ready_replicas"), F.col("status.replicas").alias("status_replicas"), F.col("status.observedGeneration").alias("observed_generation"), container["image"].alias("image"), container["args"].alias("args"),
    )


def member_list(text: DataFrame, key: str, column: str = "value") -> DataFrame:
    """One row for each member, with its place in the list; ids up to 2^64 - 1."""
    m = text.select(key, F.from_json(column, MEMBERS).alias("m")).select(key, F.posexplode("m.members").alias("position", "x"))
    return m.select(key, "position", F.col("x.ID").alias("member_id"), F.col("x.name").alias("member_name"), F.coalesce("x.isLearner", F.lit(False)).alias("is_learner"), F.col("x.peerURLs").alias("peer_urls"))


def probes(text: DataFrame, key: str, column: str = "value") -> DataFrame:
    p = text.select(key, F.from_json(column, f"array<struct<{_nested(PROBE)}>>").alias("p")).select(key, F.explode("p").alias("x"))
    st = F.col("x.Status")
    return p.select(key, "x.endpoint", "x.health", "x.took", "x.error", st.isNotNull().alias("has_status"), st["header"]["member_id"].alias("member_id"), st["leader"].alias("leader"), st["header"]["revision"].alias("revision"), st["version"].alias("version"), st["isLearner"].alias("is_learner"))


def kv_hashes(text: DataFrame, key: str, column: str = "value") -> DataFrame:
    h = text.select(key, F.from_json(column, "array<struct<Endpoint:string,HashKV:struct<hash:bigint>>>").alias("h")).select(key, F.explode("h").alias("x"))
    return h.select(key, F.col("x.Endpoint").alias("endpoint"), F.col("x.HashKV.hash").alias("hash"))


def certs(spark: SparkSession, path: str) -> DataFrame:
    """From JSON lines."""
    return certs_text(read_text(spark, path, whole=False))


def _certs(text: DataFrame, column: str) -> DataFrame:
    return text.withColumn("_c", F.from_json(F.col(column), f"{CERT}, {BROKEN} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN})).withColumn(
        "_reason", F.when(F.col(f"_c.{BROKEN}").isNotNull() | F.col("_c").isNull(), "unreadable").when(F.col("_c.secret_name").isNull(), "no name")
    )


def certs_text(text: DataFrame, column: str = "value") -> DataFrame:
    """Certificates from JSON texts in a column; those that can't be read or have no name give no rows here."""
    return _certs(text, column).filter("_reason IS NULL").select("_c.*").drop(BROKEN)


def rejected_certs(text: DataFrame, column: str = "value") -> DataFrame:
    """(column, reason): the others."""
    return _certs(text, column).filter("_reason IS NOT NULL").select(column, F.col("_reason").alias("reason"))


def changes(spark: SparkSession, path: str, files: int = 1000) -> DataFrame:
    """The change feed as a stream of JSON lines, some files in a micro-batch at most."""
    return spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", files).json(path)


def live(feed: DataFrame) -> DataFrame:
    """The objects of a feed that weren't deleted by their last change."""
    last = feed.groupBy("kind", "namespace", "name").agg(F.max_by("op", "version").alias("op"), F.max("version").alias("version"))
    return last.filter("op <> 'delete'")


class LiveTable:
    """The live objects of a change feed, kept up batch by batch. The last change of every object stays, a delete as well, so that
    an older change that comes later doesn't bring the object back; `forget` drops deletes that no such change can follow any more."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16) -> None:
        self.table = KeyedTable(spark, path, CHANGE, ["kind", "namespace", "name"], ["version"], buckets=buckets)

    def apply(self, batch: DataFrame, number: int) -> None:
        """For foreachBatch."""
        self.table.merge(batch, number)

    def objects(self) -> DataFrame:
        return self.table.read().filter("op <> 'delete'")

    def forget(self, before: int) -> None:
        """Drops deletes of versions less than `before`, in the place of the newest version."""
        kept = staged(self.table.read().filter(~((F.col("op") == "delete") & (F.col("version") < before))), "live")
        self.table.replace(kept, list(range(self.table.buckets)), self.table.versions()[-1] + 1)
