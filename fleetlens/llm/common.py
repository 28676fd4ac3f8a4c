"""What several operators of this subpackage share: table access, staged tables, range buckets."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but space and the control characters tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the one that the cluster names, else one in the warehouse; a folder of the
    driver's own machine only where Spark runs on that machine alone (tests)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        if warehouse.startswith("file:"):
            raise ValueError("set spark.checkpoint.dir: the warehouse is a folder of each machine's own")
        return f"{warehouse.rstrip('/')}/_staged"
    global _own
    if _own is None:
        _own = tempfile.mkdtemp(prefix="spark-stage-", dir="/tmp")
    return _own


_own: str | None = None
_where: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
#: With it, Spark removes a query's shuffle files when the query ends; a written table needs them no more.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of rows that Spark hands to a Python worker at once, besides its bound on their number; and enough of them for texts.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 1 << 21


def staged(df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
    """Writes df once into the shared folder and reads it back: later uses neither recompute it nor depend on
    the executors that made it. `unstage` removes it, at the latest the end of the driver does. batch: of about how many
    bytes the workers that make df get their rows; wide rows else come by thousands, held on both sides at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{re.sub(r'[^a-z0-9_]', '_', name.lower())}-{uuid.uuid4().hex}"
    during = {CLEANUP: "true"} | ({} if batch is None else {BATCH: str(batch)})
    before = {k: spark.conf.get(k) for k in during}
    try:
        for k, v in during.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    _where[out] = path
    atexit.register(_remove, spark, path)
    return out


def unstage(*tables: DataFrame) -> None:
    """Removes staged tables that nothing reads any more."""
    for df in tables:
        path = _where.pop(df, None)
        if path:
            _remove(df.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session is gone already; nothing is left to remove it with
        pass


def parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Rows of two numbers that are few enough for every task to hold, and how many tasks write so few.
FEW, TASKS = 50_000, 8


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df, a staged table of two numbers a row, told to be broadcast if it has few rows (rows: no less than its own)."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= FEW else df


def fitted(df: DataFrame, rows: int) -> DataFrame:
    """df in few tasks, if it has few rows of two numbers: many steps on a small table else cost a task and a file for every
    shuffle partition. Not for what sorts, as a task keeps the memory of all sorts of its partitions."""
    return df.coalesce(TASKS) if rows <= FEW and TASKS < parts(df.sparkSession) else df


#: Bits of the map that `likely` sends to all tasks: 4 MB of bits, in at most 524,288 rows, however many keys there are.
LIKELY = 1 << 25


def likely(df: DataFrame, key: Column, wanted: DataFrame, wanted_key: str) -> DataFrame:
    """df with `_likely` boolean: true where the key is one of the wanted ones (hashes as longs), and by chance elsewhere, for a
    share of (wanted keys) / LIKELY at most. So rows can be told from others before they are moved; what is true must be
    joined exactly."""
    bit = F.pmod(F.col(wanted_key), F.lit(LIKELY)).alias("_bit")
    words = wanted.select(bit).groupBy(F.expr("_bit DIV 64").alias("_word")).agg(F.expr("bit_or(shiftleft(1L, CAST(_bit % 64 AS INT)))").alias("_bits"))
    found = df.withColumn("_bit", F.pmod(key, F.lit(LIKELY))).withColumn("_word", F.expr("_bit DIV 64")).join(F.broadcast(words), "_word", "left")
    return found.withColumn("_likely", F.expr("coalesce(getbit(_bits, CAST(_bit % 64 AS INT)) = 1, false)")).select(*[F.col(f"`{c}`") for c in df.columns], "_likely")


def splitters(df: DataFrame, col: str, buckets: int) -> list[int]:
    """At most buckets - 1 values that cut the column into ranges of about equal numbers of rows. Only these
    values reach the driver; the quantile sketch is merged from per-task sketches."""
    buckets = max(1, buckets)
    if buckets == 1:
        return []
    cuts = ", ".join(f"{i / buckets}D" for i in range(1, buckets))
    row = df.select(F.expr(f"percentile_approx(`{col}`, array({cuts}), {max(10_000, 20 * buckets)}) AS q")).first()
    return sorted({int(x) for x in row["q"] or [] if x is not None})


def longs(values: list[int | None]) -> str:
    """A constant array as SQL text."""
    return "array(" + ", ".join("CAST(NULL AS BIGINT)" if v is None else f"{v}L" if v > -(2**63) else "CAST('-9223372036854775808' AS BIGINT)" for v in values) + ")" if values else "CAST(array() AS ARRAY<BIGINT>)"


def range_bucket(col: str, cuts: list[int]) -> Column:
    """How many of the sorted cuts are at most the value, by binary search; null values go to bucket 0."""
    if not cuts:
        return F.lit(0)
    steps = [1 << k for k in reversed(range(len(cuts).bit_length()))]
    return F.expr(
        f"aggregate(array({', '.join(map(str, steps))}), 0, (lo, s) -> "
        f"IF(lo + s <= {len(cuts)} AND get({longs(cuts)}, lo + s - 1) <= `{col}`, lo + s, lo))"
    )


def packed_row(df: DataFrame, used: list[str], made: list[str]) -> DataFrame:
    """The input's columns as one struct `_row` beside the used ones as `_<name>`, so that no name of an
    operator clashes with a caller's column. Columns named as the operator's results are left out of `_row`."""
    keep = [c for c in df.columns if c not in made]
    row = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(None).cast("string").alias("_none"))
    return df.select(row.alias("_row"), *[F.col(f"`{c}`").alias(f"_{c}") for c in dict.fromkeys(used)])
