"""Operators over history: transitions, time to ready, as-of lag, latest rows, survey condensation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.sources.shared import staged


def span(ts: str = "ts", width: str = "DAY") -> Column:
    """The span of time that a row is in: what the operators below deal a key's history out by."""
    return F.date_trunc(width, F.col(ts))


def _carry(rows: DataFrame, key: list[str], *made: Column) -> DataFrame:
    """A row for each key and span: a few values, by partial aggregation. rows are dealt out by key and span already."""
    return rows.groupBy(*key, "_span").agg(*made)


def condition_transitions(rows: DataFrame, key: list[str], order: list[str], status: str = "status", by: Column | None = None) -> DataFrame:
    """The rows at which a key's status differs from the row before, with a run number; the first row counts.

    by: spans that follow the order (`span()`); a task then holds one span of a key, and one row a span carries the
    last status and the number of changes on. Without it, a task holds a key's history."""
    rows = rows.withColumn("_span", F.lit(0) if by is None else by)
    w = Window.partitionBy(*key, "_span").orderBy(*order)
    place = F.row_number().over(w)
    local = rows.withColumns({"_first": place == 1, "_c": (place > 1) & ~F.col(status).eqNullSafe(F.lag(status).over(w))})
    local = local.withColumn("_run", F.sum(F.col("_c").cast("bigint")).over(w))
    # struct: a status may be null
    ends = _carry(local, key, F.max_by(F.struct(status), F.struct(*order)).alias("_last"), F.min_by(F.struct(status), F.struct(*order)).alias("_begin"), F.max("_run").alias("_runs"))
    spans = Window.partitionBy(*key).orderBy("_span")
    ends = ends.withColumn("_new", ~F.col("_begin").eqNullSafe(F.lag("_last").over(spans)))
    ends = ends.withColumn("_before", F.sum(F.col("_runs") + F.col("_new").cast("bigint")).over(spans) - F.col("_runs"))
    on = [rows[k].eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key)]
    ends = ends.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], F.col("_span").alias("_s"), "_new", "_before")
    out = local.join(ends, [*on, F.col("_span") == F.col("_s")]).filter(F.col("_c") | (F.col("_first") & F.col("_new")))
    return out.withColumn("run", F.col("_before") + F.col("_run")).select(*[c for c in rows.columns if c != "_span"], "run")


def time_to_ready(changes: DataFrame, ready: DataFrame, deadline: str, key: str = "cluster_id", width: str = "DAY") -> DataFrame:
    """changes(key, change_id, ts), ready(key, ts): the first ready time within the deadline; null where none came.
    A task holds one span of a key, in order of time, so that a change meets its first report there and not each of them; one row a span
    carries the first report of the spans after it."""
    kind = ready.schema["ts"].dataType
    both = changes.select(key, "change_id", "ts", F.lit(None).cast(kind).alias("_t"), F.lit(True).alias("_c"))
    both = both.unionByName(ready.select(key, F.lit(None).cast(changes.schema["change_id"].dataType).alias("change_id"), "ts", F.col("ts").alias("_t"), F.lit(False).alias("_c")))
    both = both.withColumn("_span", span("ts", width))
    here = F.min("_t").over(Window.partitionBy(key, "_span").orderBy("ts").rangeBetween(Window.currentRow, Window.unboundedFollowing))
    firsts = _carry(both, [key], F.min("_t").alias("_t0"))
    after = F.first("_t0", ignorenulls=True).over(Window.partitionBy(key).orderBy("_span").rowsBetween(1, Window.unboundedFollowing))
    firsts = firsts.select(F.col(key).alias("_k"), F.col("_span").alias("_s"), after.alias("_next"))
    out = both.withColumn("_here", here).filter("_c").join(firsts, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_span") == F.col("_s")), "left")
    first = F.coalesce("_here", "_next")
    # repeated changes are one; the grouping needs no exchange beyond that of the span
    out = out.groupBy(key, "_span", "change_id", "ts").agg(F.min(F.when(first <= F.col("ts") + F.expr(f"INTERVAL {deadline}"), first)).alias("ready_at"))
    return out.drop("_span").withColumn("timed_out", F.col("ready_at").isNull())


def learner_lag_asof(rows: DataFrame, leads: Column, key: str = "cluster_id", width: str = "DAY") -> DataFrame:
    """Rows that don't lead, with the revision last seen of one that did, at or before their time: in their own span of time, or else
    in the last span before it that has one (a row a span carries it on)."""
    rows = rows.withColumns({"_span": span("ts", width), "_r": F.when(leads, F.struct("revision")), "_lead": leads})
    w = Window.partitionBy(key, "_span").orderBy("ts", "probe_id").rowsBetween(Window.unboundedPreceding, 0)
    here = rows.withColumn("_here", F.last("_r", ignorenulls=True).over(w))
    lasts = _carry(rows, [key], F.max_by("_r", F.when(F.col("_r").isNotNull(), F.struct("ts", "probe_id"))).alias("_l"))
    before = F.last("_l", ignorenulls=True).over(Window.partitionBy(key).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1))
    lasts = lasts.select(F.col(key).alias("_k"), F.col("_span").alias("_s"), before.alias("_before"))
    out = here.filter(~F.col("_lead")).join(lasts, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_span") == F.col("_s")), "left")
    out = out.withColumn("leader_revision", F.coalesce("_here", "_before")["revision"])
    return out.select(key, "probe_id", "revision", "leader_revision", (F.col("leader_revision") - F.col("revision")).alias("lag"))


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: a partial aggregation, no sort of the history."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_l")).select(*key, "_l.*")


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with `row`, their place in the whole order from 1, and `rows`, their number. Ranges of the order are sorted apart and written
    once; the rows before each range are its offset. Only a count a range reaches the driver."""
    spark = rows.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = staged(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranges")
    counts = ranged.groupBy(F.shiftright("_at", 33).alias("part")).agg(F.count("*").alias("n"), F.min("_at").alias("first")).orderBy("part").collect()
    shifts, total = [], 0
    for r in counts:
        shifts += [F.lit(r["part"]), F.lit(total - r["first"] + 1)]
        total += r["n"]
    shift = F.create_map(*shifts)[F.shiftright("_at", 33)] if shifts else F.lit(0)
    return ranged.withColumns({"row": F.col("_at") + shift, "rows": F.lit(total).cast("bigint")}).drop("_at")


def tile(tiles: int) -> Column:
    """Which of `tiles` parts a numbered row is in; the first parts have one row more where they can't be equal."""
    size, more = F.expr(f"rows DIV {tiles}"), F.col("rows") % tiles
    long = (size + 1) * more  # rows in the longer parts
    i = F.col("row") - 1
    return (F.when(i < long, F.call_function("div", i, size + 1)).otherwise(more + F.call_function("div", i - long, F.greatest(size, F.lit(1)))) + 1).cast("int")


def survey_summary(answers: DataFrame, features: list[str]) -> DataFrame:
    """Complete answers of interested organisations, one each, in thirds by fleet size; the share that wants each feature."""
    kept = answers.filter("complete AND interested")
    one = kept.groupBy("organisation").agg(F.max_by(F.struct("respondent", "clusters", *features), F.struct("clusters", "respondent")).alias("a")).select("organisation", "a.*")
    third = numbered(one, ["clusters", "organisation"]).withColumn("third", tile(3))
    long = third.select("third", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("int").alias("wants")) for f in features])).alias("x")).select("third", "x.*")
    share = long.groupBy("third", "feature").agg(F.count("*").alias("answers"), F.sum("wants").alias("wanting"))
    s = 100 * F.col("wanting") / F.col("answers")
    return share.withColumn("bucket", F.when(s > 78, "most").when(s > 52, "many").when(s >= 33, "some").otherwise("few"))
