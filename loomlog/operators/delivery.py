"""The delivery state machine as pure functions of tables, parameters and a clock."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def backoff_seconds(attempt: Column, base: int, most: int, exponent: int = 2) -> Column:
    """base * exponent ** attempt, ``most`` at most; attempts below zero count as zero."""
    return F.least(F.lit(most).cast("double"), F.lit(base) * F.pow(F.lit(exponent), F.greatest(attempt, F.lit(0))))


def fresh_claim(cursors: DataFrame, gate: int, limit: int) -> DataFrame:
    """The next range (low, high] of each group, empty ones left out. Ids count, not the rows that a group receives."""
    high = F.least(F.col("claimed") + limit, F.lit(gate))
    return cursors.select("group_id", F.col("claimed").alias("low"), high.alias("high")).where("low < high")


def gate(settled: Column, head: Column, xmin: Column, xmax: Column, pending_head: Column, pending_xmax: Column) -> Column:
    """The id up to which no message can still appear: what was settled before; the head, if no writer that was open when it was read is still open (xmin has reached xmax); a head that was noted earlier, by the same test. Nulls are passed over."""
    return F.greatest(settled, F.when(xmin >= xmax, head), F.when(xmin >= pending_xmax, pending_head))


def claim_next(cursors: DataFrame, leases: DataFrame, gate_: int, limit: int, most: int) -> DataFrame:
    """The range that each group works on next: an expired lease first, else a fresh range. group_id, low, high, reclaimed."""
    old = reclaim(leases, most).select("group_id", "low", "high", F.lit(True).alias("reclaimed"))
    new = fresh_claim(cursors, gate_, limit).withColumn("reclaimed", F.lit(False))
    return old.unionByName(new.join(old, "group_id", "left_anti"))


def force_reclaimed(leases: DataFrame, which: Column) -> DataFrame:
    """Leases, those of ``which`` expired now and with one reclaim fewer (-1 at least), for the next claim adds one."""
    return leases.withColumn("reclaims", F.when(which, F.greatest(F.col("reclaims") - 1, F.lit(-1))).otherwise(F.col("reclaims"))).withColumn("expired", which | F.col("expired"))


def reclaim(leases: DataFrame, most: int) -> DataFrame:
    """One expired lease of each group, the one that expired first (``until``, where leases have it) and then of the lowest range, with one more reclaim; ``quarantine`` if it had ``most`` already."""
    first = F.row_number().over(Window.partitionBy("group_id").orderBy(*(c for c in ("until", "low") if c in leases.columns)))
    return leases.where("expired").withColumn("r", first).where("r = 1").select("group_id", "low", "high", (F.col("reclaims") + 1).alias("reclaims"), (F.col("reclaims") >= most).alias("quarantine"))


#: Ids in a block when ranges are joined with the log.
BLOCK = 1_024


def in_ranges(log: DataFrame, ranges: DataFrame) -> DataFrame:
    """Messages with the columns of each range (low, high] that holds them: an equality join by blocks of ids, so no side has to be small."""
    blocks = F.sequence(F.floor((F.col("low") + 1) / BLOCK), F.floor(F.col("high") / BLOCK))
    cut = ranges.where("low < high").withColumn("__block", F.explode(blocks))
    rows = log.withColumn("__block", F.floor(F.col("id") / BLOCK)).join(cut, "__block").drop("__block")
    return rows.where((F.col("id") > F.col("low")) & (F.col("id") <= F.col("high")))


def quarantined(log: DataFrame, leases: DataFrame, most: int) -> DataFrame:
    """Every id of expired ranges that were reclaimed ``most`` times, as a ready delivery; routing and compaction don't matter."""
    poison = leases.where(F.col("expired") & (F.col("reclaims") >= most)).select("group_id", "low", "high")
    return in_ranges(log.select("id"), poison).select("group_id", F.col("id").alias("message_id"), F.lit("ready").alias("status"), F.lit(0).alias("attempts"))


def due(as_of: datetime, most: int) -> Column:
    """Ready and due, in flight with an expired lease, or deferred; below ``most`` attempts."""
    clock = F.lit(as_of).cast("timestamp_ntz")
    state = ((F.col("status") == "ready") & (F.col("can_run_after") <= clock)) | ((F.col("status") == "inflight") & (F.col("lease_until") < clock)) | (F.col("status") == "deferred")
    return state & (F.col("attempts") < most)


def eligible(deliveries: DataFrame, log: DataFrame, key_leases: DataFrame, as_of: datetime, most: int) -> DataFrame:
    """Due deliveries whose key isn't held by a live lease of the group."""
    live = key_leases.where(F.col("expires_at") >= F.lit(as_of).cast("timestamp_ntz")).select("group_id", "compaction_key")
    keyed = deliveries.where(due(as_of, most)).join(log.select(F.col("id").alias("message_id"), "compaction_key", "routing_key", "payload"), "message_id")
    return keyed.join(live, ["group_id", "compaction_key"], "left_anti")


def claim(rows: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` rows of each group by message id; attempts rise by one, and in-flight rows leave an ``expired`` entry under the old number."""
    r = F.row_number().over(Window.partitionBy("group_id").orderBy("message_id"))
    taken = rows.withColumn("r", r).where(F.col("r") <= limit)
    return taken.select("group_id", "message_id", (F.col("attempts") + 1).alias("attempts"), F.when(F.col("status") == "inflight", F.col("attempts")).alias("expired_attempt"))


def killed(deliveries: DataFrame, as_of: datetime, most: int) -> DataFrame:
    """In flight, expired, and out of attempts: dead."""
    clock = F.lit(as_of).cast("timestamp_ntz")
    return deliveries.where((F.col("status") == "inflight") & (F.col("lease_until") < clock) & (F.col("attempts") >= most)).select("group_id", "message_id", F.lit("dead").alias("status"), "attempts")


def advance(cursors: DataFrame, leases: DataFrame, deliveries: DataFrame) -> DataFrame:
    """committed of each group: the least of its lowest lease, the id before its first unresolved delivery and what is claimed; never less than before."""
    held = leases.select("group_id", F.col("low").alias("bound")).unionAll(deliveries.where(F.col("status").isin("ready", "inflight", "deferred")).select("group_id", F.col("message_id") - 1))
    bounds = held.groupBy("group_id").agg(F.min("bound").alias("bound"))  # one aggregation over both
    return cursors.join(bounds, "group_id", "left").select("group_id", "claimed", F.greatest("committed", F.least("bound", "claimed")).alias("committed"))


#: What becomes of a message whose handling had an outcome of some kind, and what is logged. Other kinds leave no delivery.
STATUS = {"failure": "ready", "terminal": "dead", "deferred": "deferred"}
LOGGED = {"terminal": "failure"}


def _mapped(kind: Column, known: dict[str, str], other: Column) -> Column:
    out = other
    for k, v in known.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def range_outcomes(outcomes: DataFrame, as_of: datetime, wait_seconds: float) -> tuple[DataFrame, DataFrame]:
    """Deliveries and log rows of a range's outcomes (group_id, message_id, kind, error): failures become ready after the wait, terminal ones dead, deferred ones deferred; the others are done. All are logged as attempt 0."""
    clock, kind = F.lit(as_of).cast("timestamp_ntz"), F.col("kind")
    due_ = F.when(kind.isin("failure", "terminal"), clock + F.make_dt_interval(secs=F.lit(wait_seconds).cast("decimal(18,6)"))).otherwise(clock)
    kept = outcomes.where(kind.isin(*STATUS)).select("group_id", "message_id", _mapped(kind, STATUS, F.lit(None)).alias("status"), F.lit(0).alias("attempts"), due_.alias("can_run_after"), F.when(kind != "deferred", F.col("error")).alias("last_error"))
    logged = outcomes.select("group_id", "message_id", F.lit(0).alias("attempt"), _mapped(kind, LOGGED, kind).alias("status"), "error", clock.alias("at"))
    return kept, logged


def retry_outcomes(taken: DataFrame, as_of: datetime, base: int = 2, most: int = 300) -> tuple[DataFrame, DataFrame]:
    """Deliveries and log rows of outcomes of claimed deliveries (group_id, message_id, attempts, kind, error): success leaves no delivery; failure is ready again after a backoff; terminal is dead; superseded takes the attempt back. Logged under the attempt's number."""
    clock, kind = F.lit(as_of).cast("timestamp_ntz"), F.col("kind")
    wait = backoff_seconds(F.col("attempts") - 1, base, most)
    status = F.when(kind == "superseded", "superseded").otherwise(_mapped(kind, STATUS, F.lit(None)))
    kept = taken.where(kind != "success").select("group_id", "message_id", status.alias("status"), F.when(kind == "superseded", F.col("attempts") - 1).otherwise(F.col("attempts")).cast("int").alias("attempts"), F.when(kind == "failure", clock + F.make_dt_interval(secs=wait.cast("decimal(18,6)"))).otherwise(clock).alias("can_run_after"), F.col("error").alias("last_error"))
    logged = taken.select("group_id", "message_id", F.col("attempts").cast("int").alias("attempt"), _mapped(kind, LOGGED, kind).alias("status"), "error", clock.alias("at"))
    return kept, logged


def lifecycle_status(succeeded: Column, attempts: Column, most: int) -> Column:
    """Done, or dead at ``most`` attempts, else ready; without a backoff."""
    return F.when(succeeded, "done").when(attempts >= most, "dead").otherwise("ready")


def key_verdict(is_head: Column, expires_at: Column, own: Column, as_of: datetime) -> Column:
    """Whether a message may hold its key: superseded unless it is the head, busy while another's lease lives, else acquired."""
    held = F.coalesce((expires_at >= F.lit(as_of).cast("timestamp_ntz")) & ~own, F.lit(False))
    return F.when(~is_head, "superseded").when(held, "busy").otherwise("acquired")


def fan_out(batch: DataFrame, routed: DataFrame, deliveries: DataFrame, limit: int, gate_: int) -> tuple[DataFrame, DataFrame]:
    """What the batch of the next ``limit`` messages gives its groups (routed rows that have no delivery yet), and the mark: the last id of a full batch, else the gate."""
    fresh = routed.select("group_id", F.col("id").alias("message_id")).join(deliveries.select("group_id", "message_id"), ["group_id", "message_id"], "left_anti")
    mark = batch.agg(F.count("*").alias("n"), F.max("id").alias("last")).select(F.when(F.col("n") == limit, F.least("last", F.lit(gate_))).otherwise(F.lit(gate_)).alias("mark"))
    return fresh, mark


def fifo_claimable(open_: DataFrame, as_of: datetime) -> DataFrame:
    """Of unresolved keyed deliveries (ready or in flight) the lowest of each key, if it is ready or its lease has expired and no other of its key is in flight."""
    clock = F.lit(as_of).cast("timestamp_ntz")
    busy = open_.where((F.col("status") == "inflight") & (F.col("lease_until") >= clock)).select("group_id", "compaction_key").distinct()
    first = open_.join(fifo(open_), ["group_id", "compaction_key", "message_id"])
    return first.where((F.col("status") == "ready") | (F.col("lease_until") < clock)).join(busy, ["group_id", "compaction_key"], "left_anti").select("group_id", "message_id")


def prefix(deliveries: DataFrame) -> DataFrame:
    """The last id of each group before its first delivery that isn't done, or its last of all."""
    open_ = F.min(F.when(F.col("status") != "done", F.col("message_id")))
    return deliveries.groupBy("group_id").agg(open_.alias("gap"), F.max("message_id").alias("last"), F.min("message_id").alias("first")).select("group_id", F.coalesce(F.col("gap") - 1, "last").alias("upto"))


def fifo(rows: DataFrame) -> DataFrame:
    """Of unresolved keyed deliveries, the lowest of each key in its group."""
    least = rows.groupBy("group_id", "compaction_key").agg(F.min("message_id").alias("message_id"))
    return least.select("group_id", "compaction_key", "message_id")


def outcomes(log_rows: DataFrame) -> DataFrame:
    """What became of each (group, message): whether an attempt succeeded, failed, or was superseded."""
    s = F.col("status")
    return log_rows.groupBy("group_id", "message_id").agg(F.bool_or(s == "success").alias("succeeded"), F.bool_or(s.isin("failure", "expired", "killed")).alias("failed"), F.bool_or(s == "superseded").alias("superseded"))


def lane_bounds(spark, head: int, lanes: int) -> DataFrame:
    """Blocks (low, high] of lanes over a log of ``head`` messages; the last ends at the head. Every lane needs a message."""
    if not 0 < lanes <= head:
        raise ValueError(f"{lanes} lanes over {head} messages")
    s = F.col("id")
    return spark.range(lanes).select(s.cast("int").alias("lane"), F.floor(F.lit(head) * s / lanes).cast("long").alias("low"), F.when(s == lanes - 1, F.lit(head)).otherwise(F.floor(F.lit(head) * (s + 1) / lanes)).cast("long").alias("high"))


def watermark(lanes: DataFrame) -> DataFrame:
    """The committed id of the first lane that isn't through its block, else the greatest."""
    open_ = F.min(F.when(F.col("committed") < F.col("high"), F.struct("lane", "committed")))
    return lanes.groupBy("group_id").agg(open_.alias("o"), F.max("committed").alias("m")).select("group_id", F.coalesce("o.committed", "m").alias("watermark"), F.col("o").isNull().alias("caught_up"))
