"""The message log and its state tables, derived from the ``events`` table: inputs of the example queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Messages per log partition; ids start at 1.
PARTITION_SIZE = 1000

#: The same views in SQL.
PROLOGUE = """
WITH message_log AS (
  SELECT CAST(event_id + 1 AS BIGINT) AS id,
         CASE WHEN user_id % 10 = 0 THEN NULL ELSE concat('events.', event_type, '.', CASE user_id % 3 WHEN 0 THEN 'us' WHEN 1 THEN 'eu' ELSE 'ap' END) END AS routing_key,
         CASE WHEN user_id % 7 = 0 THEN NULL ELSE concat('user:', CAST(user_id AS VARCHAR)) END AS compaction_key,
         CAST(CASE WHEN event_id % 97 = 0 THEN 100 WHEN event_id % 5 = 0 THEN -1 ELSE 0 END AS BIGINT) AS compaction_rank,
         props AS payload, ts AS created_at
  FROM events),
consumer_group AS (SELECT CAST(group_id AS BIGINT) AS group_id, name FROM (VALUES (1, 'us-only'), (2, 'money'), (3, 'everything'), (4, 'nothing')) AS v(group_id, name)),
binding AS (SELECT CAST(group_id AS BIGINT) AS group_id, pattern FROM (VALUES (1, '^events[.].*[.]us$'), (2, '^events[.]purchase[.].*$'), (2, '^events[.]signup[.].*$'), (4, '^never$')) AS v(group_id, pattern)),
log_head AS (SELECT max(id) AS head FROM message_log),
cursor_state AS (
  SELECT g.group_id, CASE g.group_id WHEN 1 THEN h.head - 100 WHEN 2 THEN h.head - 500 WHEN 3 THEN h.head ELSE CAST(0 AS BIGINT) END AS claimed, CAST(0 AS BIGINT) AS committed
  FROM consumer_group g CROSS JOIN log_head h),
lease AS (
  SELECT CAST(v.group_id AS BIGINT) AS group_id, h.head - v.back AS low, h.head - v.back + 50 AS high, CAST(v.reclaims AS INT) AS reclaims, v.expired = 1 AS expired
  FROM (VALUES (1, 300, 0, 1), (1, 200, 3, 1), (2, 600, 0, 0)) AS v(group_id, back, reclaims, expired) CROSS JOIN log_head h),
delivery AS (
  SELECT g.group_id, m.id AS message_id,
         CASE (m.id - g.group_id) % 120 WHEN 0 THEN 'ready' WHEN 20 THEN 'inflight' WHEN 40 THEN 'deferred' WHEN 60 THEN 'dead' WHEN 80 THEN 'superseded' ELSE 'done' END AS status,
         CAST(CASE (m.id - g.group_id) % 100 WHEN 0 THEN 0 WHEN 20 THEN 1 WHEN 40 THEN 2 WHEN 60 THEN 3 ELSE 4 END AS INT) AS attempts,
         m.created_at + INTERVAL '5' MINUTE AS can_run_after, m.created_at + INTERVAL '30' SECOND AS lease_until, m.created_at
  FROM message_log m CROSS JOIN consumer_group g CROSS JOIN log_head h
  WHERE m.id % 20 = g.group_id AND m.id * 2 > h.head),
delivery_log AS (
  SELECT d.group_id, d.message_id, CAST(a.attempt AS INT) AS attempt,
         CASE (d.message_id + 3 * a.attempt) % 7 WHEN 0 THEN 'success' WHEN 1 THEN 'expired' WHEN 2 THEN 'deferred' WHEN 3 THEN 'killed' WHEN 4 THEN 'superseded' ELSE 'failure' END AS status
  FROM delivery d CROSS JOIN (VALUES (0), (1), (2), (3), (4)) AS a(attempt) WHERE a.attempt <= d.attempts),
key_lease AS (SELECT CAST(1 AS BIGINT) AS group_id, compaction_key, max(created_at) AS expires_at FROM message_log WHERE compaction_key IS NOT NULL GROUP BY compaction_key),
produce_attempt AS (SELECT id AS seq, concat('k:', CAST(CASE WHEN id % 10 = 0 THEN id - 1 ELSE id END AS VARCHAR)) AS idempotency_key, payload FROM message_log),
routine_event AS (
  SELECT CASE event_type WHEN 'error' THEN 'abandoned' ELSE 'cleared' END AS type, user_id AS message_id, CAST(event_id % 3 AS INT) AS attempt, ts AS event_at
  FROM events WHERE event_type IN ('error', 'signup')),
head_of AS (SELECT compaction_key, arg_max(id, (compaction_rank, id)) AS head_id, arg_max(compaction_rank, (compaction_rank, id)) AS head_rank FROM message_log WHERE compaction_key IS NOT NULL GROUP BY compaction_key),
clock AS (SELECT max(created_at) - INTERVAL '1' HOUR AS as_of FROM message_log)
"""

GROUPS = [(1, "us-only"), (2, "money"), (3, "everything"), (4, "nothing")]
BINDINGS = [(1, "^events[.].*[.]us$"), (2, "^events[.]purchase[.].*$"), (2, "^events[.]signup[.].*$"), (4, "^never$")]


class Fixtures:
    """The views over one data directory. Small control tables are literal rows; the rest are projections of ``events``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.events = spark.read.parquet(f"{sf_dir}/events.parquet")
        e = F.col("event_id")
        region = F.element_at(F.array(F.lit("us"), F.lit("eu"), F.lit("ap")), (F.col("user_id") % 3 + 1).cast("int"))
        self.log = self.events.select(
            (e + 1).alias("id"),
            F.when(F.col("user_id") % 10 != 0, F.concat(F.lit("events."), "event_type", F.lit("."), region)).alias("routing_key"),
            F.when(F.col("user_id") % 7 != 0, F.concat(F.lit("user:"), F.col("user_id").cast("string"))).alias("compaction_key"),
            F.when(e % 97 == 0, 100).when(e % 5 == 0, -1).otherwise(0).cast("long").alias("compaction_rank"),
            F.col("props").alias("payload"),
            F.col("ts").alias("created_at"),
        )
        self.groups = spark.createDataFrame(GROUPS, "group_id long, name string")
        self.bindings = spark.createDataFrame(BINDINGS, "group_id long, pattern string")

    @property
    def head(self) -> int:
        """The highest id: one number, read once, so that it can prune as a literal."""
        if not hasattr(self, "_head"):
            self._head = self.events.agg(F.coalesce(F.max("event_id") + 1, F.lit(0))).head()[0]
        return self._head

    @property
    def as_of(self):
        """The queries' clock: an hour before the newest message."""
        if not hasattr(self, "_as_of"):
            self._as_of = self.events.agg(F.max("ts") - F.expr("INTERVAL '1' HOUR")).head()[0]
        return self._as_of

    @property
    def cursors(self) -> DataFrame:
        back = {1: self.head - 100, 2: self.head - 500, 3: self.head, 4: 0}
        return self.spark.createDataFrame([(g, c, 0) for g, c in back.items()], "group_id long, claimed long, committed long")

    @property
    def leases(self) -> DataFrame:
        rows = [(1, 300, 0, True), (1, 200, 3, True), (2, 600, 0, False)]
        return self.spark.createDataFrame([(g, self.head - b, self.head - b + 50, r, x) for g, b, r, x in rows], "group_id long, low long, high long, reclaims int, expired boolean")

    @property
    def deliveries(self) -> DataFrame:
        """The residue of the id names the group, so the cross product with groups is a filter."""
        d = self.log.withColumn("group_id", F.col("id") % 20).where(F.col("group_id").between(1, 4) & (F.col("id") * 2 > self.head))
        off = F.col("id") - F.col("group_id")
        status = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in {0: "ready", 20: "inflight", 40: "deferred", 60: "dead", 80: "superseded"}.items() for x in p]), (off % 120).cast("int")), F.lit("done"))
        return d.select("group_id", F.col("id").alias("message_id"), status.alias("status"), ((off % 100) / 20).cast("int").alias("attempts"), (F.col("created_at") + F.expr("INTERVAL '5' MINUTE")).alias("can_run_after"), (F.col("created_at") + F.expr("INTERVAL '30' SECOND")).alias("lease_until"), "created_at")

    @property
    def delivery_log(self) -> DataFrame:
        d = self.deliveries.select("group_id", "message_id", F.explode(F.sequence(F.lit(0), "attempts")).alias("attempt"))
        names = F.array(*map(F.lit, ("success", "expired", "deferred", "killed", "superseded", "failure", "failure")))
        return d.withColumn("status", F.element_at(names, ((F.col("message_id") + 3 * F.col("attempt")) % 7 + 1).cast("int")))

    @property
    def key_leases(self) -> DataFrame:
        keyed = self.log.where("compaction_key IS NOT NULL").groupBy("compaction_key").agg(F.max("created_at").alias("expires_at"))
        return keyed.select(F.lit(1).cast("long").alias("group_id"), "compaction_key", "expires_at")

    @property
    def attempts(self) -> DataFrame:
        key = F.concat(F.lit("k:"), F.when(F.col("id") % 10 == 0, F.col("id") - 1).otherwise(F.col("id")).cast("string"))
        return self.log.select(F.col("id").alias("seq"), key.alias("idempotency_key"), "payload")

    @property
    def routine_events(self) -> DataFrame:
        kind = F.when(F.col("event_type") == "error", "abandoned").otherwise("cleared")
        return self.events.where(F.col("event_type").isin("error", "signup")).select(kind.alias("type"), F.col("user_id").alias("message_id"), (F.col("event_id") % 3).cast("int").alias("attempt"), F.col("ts").alias("event_at"))
