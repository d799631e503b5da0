"""Read models of metrics, workers, alerts, bindings and migrations; retention."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def snapshot(cursors: DataFrame, leases: DataFrame, deliveries: DataFrame, head: int) -> DataFrame:
    """One row per group: head, frontiers, deliveries by state, the oldest unresolved one and open leases; one pass over the deliveries."""
    s = F.col("status")
    counts = deliveries.groupBy("group_id").agg(*[F.count_if(s == k).alias(k) for k in ("ready", "inflight", "deferred", "dead")], F.min(F.when(s.isin("ready", "inflight", "deferred"), F.col("created_at"))).alias("oldest"))
    rows = cursors.join(counts, "group_id", "left").join(leases.groupBy("group_id").agg(F.count("*").alias("open_leases")), "group_id", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("ready", "inflight", "deferred", "dead")]
    return rows.select("group_id", F.lit(head).cast("long").alias("head"), "claimed", "committed", *zero, "oldest", F.coalesce("open_leases", F.lit(0)).alias("open_leases"))


#: Gauges of a group, in the order in which they are measured.
GAUGES = ("cursor.head", "cursor.claimed", "cursor.committed", "cursor.backlog", "cursor.inflight", "exceptions.ready", "exceptions.inflight", "exceptions.deferred", "exceptions.dead", "exceptions.oldest_unresolved_age", "open_leases", "abandoned_routines.outstanding", "abandoned_routines.total", "abandoned_routines.self_clear_latency_avg")


def group_gauges(snapshot_: DataFrame, abandoned_: DataFrame, as_of: datetime) -> DataFrame:
    """group_id, name and value (double) of all gauges of each group; ages and latencies in milliseconds, absent ones 0. ``abandoned_``: one row, of ``abandoned``."""
    now = F.unix_micros(F.lit(as_of).cast("timestamp"))
    age = F.floor((now - F.unix_micros(F.col("oldest").cast("timestamp"))) / 1000)
    values = [F.col("head"), F.col("claimed"), F.col("committed"), F.col("head") - F.col("committed"), F.col("claimed") - F.col("committed"), F.col("ready"), F.col("inflight"), F.col("deferred"), F.col("dead"), age, F.col("open_leases"), F.col("outstanding"), F.col("total"), F.floor(F.col("mean_latency_us") / 1000)]
    rows = snapshot_.join(abandoned_.where("total IS NOT NULL"), how="left", on=F.lit(True))
    pairs = F.array(*(F.struct(F.lit(n).alias("name"), F.coalesce(v.cast("double"), F.lit(0.0)).alias("value")) for n, v in zip(GAUGES, values, strict=True)))
    return rows.select("group_id", F.explode(pairs).alias("x")).select("group_id", "x.name", "x.value")


def abandoned(events: DataFrame) -> DataFrame:
    """Abandoned routines: all, those never cleared, and the mean time to clearing in whole microseconds."""
    first = events.groupBy("message_id", "attempt").agg(F.min(F.when(F.col("type") == "abandoned", F.col("event_at"))).alias("a"), F.min(F.when(F.col("type") == "cleared", F.col("event_at"))).alias("c")).where("a IS NOT NULL")

    def us(c: str) -> Column:
        return F.unix_micros(F.col(c).cast("timestamp"))

    return first.agg(F.count("*").alias("total"), F.count_if(F.col("c").isNull()).alias("outstanding"), F.sum(us("c") - us("a")).alias("us"), F.count("c").alias("n")).select("total", "outstanding", F.expr("us div nullif(n, 0)").alias("mean_latency_us"))


def worker_snapshot(workers: DataFrame, instances: DataFrame, owners: DataFrame) -> DataFrame:
    live = F.col("live") == F.lit(True)
    counts = instances.groupBy("worker_id").agg(F.count_if(live).alias("n"), F.count_if(live & (F.col("failures") > 0)).alias("failing"), F.max(F.when(live, F.col("age"))).alias("oldest"))
    rows = workers.join(owners, "group_id", "left").join(counts, "worker_id", "left")
    return rows.select("worker_id", "name", F.coalesce("topic_id", "owner_topic").alias("topic_id"), F.coalesce("n", F.lit(0)).alias("live"), F.coalesce("failing", F.lit(0)).alias("failing"), "oldest", "target")


def workers_of(workers: DataFrame, groups: DataFrame, topics: DataFrame, system_id: int | None = None, topic_id: int | None = None, group_id: int | None = None) -> DataFrame:
    """Workers (worker_id, name, system_id, topic_id, group_id) along an owner's chain: those of the group, of its topic and of its system, as far as they are given. A system by itself has all below it: of its topics (topic_id, system_id) and of their groups (group_id, owner_topic)."""
    rows = workers.join(groups, "group_id", "left").withColumn("of_topic", F.coalesce("topic_id", "owner_topic"))
    rows = rows.join(topics.select(F.col("topic_id").alias("of_topic"), F.col("system_id").alias("of_system")), "of_topic", "left")
    own = F.lit(False)
    for column, value in (("system_id", system_id), ("topic_id", topic_id), ("group_id", group_id)):
        own = own | (F.col(column) == value) if value is not None else own
    if topic_id is None and group_id is None:
        own = own | (F.col("of_system") == system_id)
    return rows.where(F.coalesce(own, F.lit(False))).select("worker_id", "name")


def classify_alerts(rows: DataFrame, repeat_after: float) -> DataFrame:
    """Of an alert's last published state (head) and what an evaluation found: publish as active when new, changed in severity or long ago; publish as resolved; or nothing."""
    gone = F.col("head").isNull() | (F.col("head") == "resolved")
    outcome = F.when(F.col("found").isNull(), F.when(gone, "nothing").otherwise("resolved")).when(gone | (F.col("head") != F.col("found")) | (F.col("age") >= repeat_after), "active").otherwise("nothing")
    return rows.select("name", outcome.alias("outcome"))


def lock_threshold(locks: int, connections: int, prepared: int) -> int:
    return locks * (connections + prepared) // 5 // 2


def schema_state(migrations: DataFrame) -> DataFrame:
    """The version of the latest success (not the highest, as one may go back) and the greatest min_compatible of successes up to it."""
    ok = migrations.where("status = 'success'")
    now = ok.agg(F.max_by("version", "id").alias("now"))
    return ok.join(F.broadcast(now), F.col("version") <= F.col("now")).groupBy(F.col("now").alias("version")).agg(F.max("min_compatible").alias("min_compatible"))


def open_waiters(declared: DataFrame) -> DataFrame:
    """The newest waiting declaration of each declarer that differs from its group's installed set and that the declarer didn't install later."""
    waiting = declared.where("status = 'waiting'").groupBy("group_id", "declarer").agg(F.max("id").alias("id"), F.max_by("patterns", "id").alias("patterns"))
    installed = declared.where("status = 'installed'")
    effective = installed.groupBy("group_id").agg(F.max_by("patterns", "id").alias("effective"))
    own = installed.groupBy("group_id", "declarer").agg(F.max("id").alias("own"))
    rows = waiting.join(effective, "group_id", "left").join(own, ["group_id", "declarer"], "left")
    return rows.where(~F.col("patterns").eqNullSafe(F.col("effective")) & (F.col("own").isNull() | (F.col("own") < F.col("id")))).select("group_id", "declarer", "id")


def classify_bindings(rows: DataFrame) -> DataFrame:
    """Declared against stored patterns, as sets: nothing stored, install; equal, join; nobody live, install; else wait."""

    def as_set(c: str) -> Column:
        return F.array_sort(F.array_distinct(F.split(c, ",")))

    outcome = F.when(F.col("stored").isNull(), "install").when(as_set("declared") == as_set("stored"), "join").when(~F.col("live"), "install").otherwise("wait")
    return rows.select("declared", "live", outcome.alias("outcome"))


def clamp(value: Column, least: Column, most: Column) -> Column:
    """Within bounds, of which zero means none."""
    return F.when((least > 0) & (value < least), least).when((most > 0) & (value > most), most).otherwise(value)


def droppable(log: DataFrame, head: int, floor: int, as_of: datetime, ttl: str, size: int) -> DataFrame:
    """Partitions before the active one whose newest message, that with the highest id, has reached the age, and which every group has passed."""
    parts = log.groupBy(F.floor(F.col("id") / size).cast("long").alias("part")).agg(F.max_by("created_at", "id").alias("newest"))
    old = F.col("newest") <= F.lit(as_of).cast("timestamp_ntz") - F.expr(ttl)
    return parts.where((F.col("part") < head // size) & old & ((F.col("part") + 1) * size - 1 <= floor))


def sweepable(log: DataFrame, floor: int, as_of: datetime, ttl: str) -> DataFrame:
    """Ids of messages that are older than the age and that every group has passed."""
    return log.where((F.col("created_at") < F.lit(as_of).cast("timestamp_ntz") - F.expr(ttl)) & (F.col("id") <= floor)).select("id")


def retire_verdict(snapshots: DataFrame, compacted: bool) -> DataFrame:
    """Whether a topic may go: a compacted one never; else if no group lags or has open deliveries."""
    behind = (F.col("head") > F.col("committed")) | (F.col("ready") + F.col("inflight") + F.col("deferred") > 0)
    counts = snapshots.agg(F.count_if(behind).alias("lagging"))
    return counts.select(F.when(F.lit(compacted), "compacted").when(F.col("lagging") == 0, "safe").otherwise("lagging").alias("verdict"), "lagging")
