"""Example queries of metrics, retention and the control plane, with their SQL. Small control tables are literal rows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomlog.functions import cron
from loomlog.operators import control, delivery, log
from loomlog.plans import Registry
from loomlog.sources.fixtures import PARTITION_SIZE

R = Registry()


def table(x, names: str, rows: list[tuple]):
    return x.spark.createDataFrame(rows, names)


def values(names: str, rows: list[tuple]) -> str:
    """The same literal rows in SQL."""
    columns = [c.split() for c in names.split(", ")]
    sql_type = {"long": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}

    def lit(v: object) -> str:
        return "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    picked = ", ".join(f"CAST({n} AS {sql_type[t]}) AS {n}" for n, t in columns)
    return f"(SELECT {picked} FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS v({', '.join(n for n, _ in columns)}))"


SNAPSHOT = "SELECT c.group_id, h.head, c.claimed, c.committed, (SELECT count(*) FROM delivery d WHERE d.group_id = c.group_id AND d.status = 'ready') AS ready, (SELECT count(*) FROM delivery d WHERE d.group_id = c.group_id AND d.status = 'inflight') AS inflight, (SELECT count(*) FROM delivery d WHERE d.group_id = c.group_id AND d.status = 'deferred') AS deferred, (SELECT count(*) FROM delivery d WHERE d.group_id = c.group_id AND d.status = 'dead') AS dead, (SELECT min(created_at) FROM delivery d WHERE d.group_id = c.group_id AND d.status IN ('ready', 'inflight', 'deferred')) AS oldest, (SELECT count(*) FROM lease l WHERE l.group_id = c.group_id) AS open_leases FROM cursor_state c CROSS JOIN log_head h"


@R.add("group_snapshot", SNAPSHOT)
def group_snapshot(x):
    return control.snapshot(x.cursors, x.leases, x.deliveries, x.head)


@R.add("group_lag", f", s AS ({SNAPSHOT}) SELECT group_id, greatest(head - claimed, 0) AS backlog, greatest(head - committed, 0) AS lag, ready + inflight + deferred AS unresolved FROM s")
def group_lag(x):
    s = group_snapshot(x)
    return s.select("group_id", F.greatest(F.col("head") - F.col("claimed"), F.lit(0)).alias("backlog"), F.greatest(F.col("head") - F.col("committed"), F.lit(0)).alias("lag"), (F.col("ready") + F.col("inflight") + F.col("deferred")).alias("unresolved"))


_GAUGE_SQL = ("head", "claimed", "committed", "head - committed", "claimed - committed", "ready", "inflight", "deferred", "dead", "floor((epoch_us(as_of) - epoch_us(oldest)) / 1000)", "open_leases", "outstanding", "total", "floor((us // nullif(n, 0)) / 1000)")
COLLECT = f", s AS ({SNAPSHOT}), f AS (SELECT min(CASE WHEN type = 'abandoned' THEN event_at END) AS a, min(CASE WHEN type = 'cleared' THEN event_at END) AS c FROM routine_event GROUP BY message_id, attempt), ab AS (SELECT count(*) AS total, count(*) FILTER (WHERE c IS NULL) AS outstanding, sum(CASE WHEN c IS NOT NULL THEN epoch_us(c) - epoch_us(a) END) AS us, count(c) AS n FROM f WHERE a IS NOT NULL), u AS (" + " UNION ALL ".join(f"SELECT group_id, '{n}' AS name, coalesce(CAST({v} AS DOUBLE), 0) AS value FROM s, ab, clock" for n, v in zip(control.GAUGES, _GAUGE_SQL, strict=True)) + ") SELECT group_id, name, value, concat(name, '|group=', CAST(group_id AS VARCHAR)) AS series FROM u"


@R.add("collect_measurements", COLLECT)
def collect_measurements(x):
    """All gauges of each group, with their series."""
    rows = control.group_gauges(group_snapshot(x), control.abandoned(x.routine_events), x.as_of)
    attributes = F.create_map(F.lit("group"), F.col("group_id").cast("string"))
    return rows.select("group_id", "name", "value", log.series_key(F.col("name"), attributes).alias("series"))


@R.add("measurement_key", "SELECT event_id, concat('lag|group=', event_type, ',topic=', CAST(user_id AS VARCHAR)) AS series FROM events", prologue=False)
def measurement_key(x):
    attributes = F.create_map(F.lit("topic"), F.col("user_id").cast("string"), F.lit("group"), F.col("event_type"))
    return x.events.select("event_id", log.series_key(F.lit("lag"), attributes).alias("series"))


@R.add("series_filter", "SELECT event_id FROM events WHERE event_type = 'click' AND user_id = 3", prologue=False)
def series_filter(x):
    attributes = F.create_map(F.lit("topic"), F.col("user_id").cast("string"), F.lit("group"), F.col("event_type"))
    return x.events.withColumn("a", attributes).where((F.col("a")["group"] == "click") & (F.col("a")["topic"] == "3")).select("event_id")


@R.add("event_timestamps", "SELECT message_id, attempt, min(event_at) AS first_at FROM routine_event WHERE type = 'abandoned' GROUP BY 1, 2")
def event_timestamps(x):
    return x.routine_events.where("type = 'abandoned'").groupBy("message_id", "attempt").agg(F.min("event_at").alias("first_at"))


@R.add("abandoned_routines", ", a AS (SELECT message_id, attempt, min(event_at) AS t FROM routine_event WHERE type = 'abandoned' GROUP BY 1, 2), c AS (SELECT message_id, attempt, min(event_at) AS t FROM routine_event WHERE type = 'cleared' GROUP BY 1, 2) SELECT count(*) AS total, count(*) FILTER (WHERE c.t IS NULL) AS outstanding, CAST(sum(epoch_us(c.t) - epoch_us(a.t)) // nullif(count(c.t), 0) AS BIGINT) AS mean_latency_us FROM a LEFT JOIN c USING (message_id, attempt)")
def abandoned_routines(x):
    return control.abandoned(x.routine_events)


@R.add("request_outcomes", "SELECT group_id, message_id, bool_or(status = 'success') AS succeeded, bool_or(status IN ('failure', 'expired', 'killed')) AS failed, bool_or(status = 'superseded') AS superseded FROM delivery_log GROUP BY 1, 2")
def request_outcomes(x):
    return delivery.outcomes(x.delivery_log)


@R.add("cron_status", ", o AS (SELECT group_id, message_id, bool_or(status = 'success') AS s, bool_or(status IN ('failure', 'expired', 'killed')) AS f, bool_or(status = 'superseded') AS p FROM delivery_log GROUP BY 1, 2) SELECT group_id, count(*) AS ran, count(*) FILTER (WHERE s) AS succeeded, count(*) FILTER (WHERE NOT s AND f) AS failed, count(*) FILTER (WHERE NOT s AND NOT f AND p) AS superseded FROM o GROUP BY 1")
def cron_status(x):
    o = delivery.outcomes(x.delivery_log)
    return o.groupBy("group_id").agg(F.count("*").alias("ran"), F.count_if("succeeded").alias("succeeded"), F.count_if(~F.col("succeeded") & F.col("failed")).alias("failed"), F.count_if(~F.col("succeeded") & ~F.col("failed") & F.col("superseded")).alias("superseded"))


W = "worker_id long, name string, topic_id long, group_id long, target int"
WORKERS = [(1, "message", None, 1, 2), (2, "exception", None, 2, 1), (3, "janitor", 10, None, 1), (4, "scheduler", None, None, 0), (5, "collector", None, None, -1)]
I = "worker_id long, live boolean, failures int, age double"
INSTANCES = [(1, True, 0, 5.0), (1, True, 3, 9.0), (2, False, 7, 60.0), (3, True, 0, 1.5), (5, True, 2, 2.0), (5, True, 0, 4.0)]
G = "group_id long, owner_topic long"
OWNERS = [(1, 10), (2, 11)]
WI = f"WITH w AS {values(W, WORKERS)}, i AS {values(I, INSTANCES)}, g AS {values(G, OWNERS)} "
WS = "SELECT w.worker_id, w.name, coalesce(w.topic_id, g.owner_topic) AS topic_id, count(*) FILTER (WHERE i.live) AS live, count(*) FILTER (WHERE i.live AND i.failures > 0) AS failing, max(i.age) FILTER (WHERE i.live) AS oldest, w.target FROM w LEFT JOIN g ON g.group_id = w.group_id LEFT JOIN i ON i.worker_id = w.worker_id GROUP BY ALL"


@R.add("worker_snapshot", WI + WS, prologue=False)
def worker_snapshot(x):
    return control.worker_snapshot(table(x, W, WORKERS), table(x, I, INSTANCES), table(x, G, OWNERS))


@R.add("fleet_workers", WI + f", s AS ({WS}) SELECT count(*) FILTER (WHERE live = 0 AND target <> 0) AS unclaimed, count(*) FILTER (WHERE failing > 0) AS failing, max(oldest) AS oldest FROM s", prologue=False)
def fleet_workers(x):
    return worker_snapshot(x).agg(F.count_if((F.col("live") == 0) & (F.col("target") != 0)).alias("unclaimed"), F.count_if(F.col("failing") > 0).alias("failing"), F.max("oldest").alias("oldest"))


@R.add("claimable_workers", WI + f", s AS ({WS}) SELECT worker_id, target < 0 AS unbounded FROM s WHERE target < 0 OR live < target", prologue=False)
def claimable_workers(x):
    return worker_snapshot(x).where((F.col("target") < 0) | (F.col("live") < F.col("target"))).select("worker_id", (F.col("target") < 0).alias("unbounded"))


@R.add("list_workers", WI + "SELECT w.worker_id, w.name FROM w LEFT JOIN g ON g.group_id = w.group_id WHERE coalesce(w.topic_id, g.owner_topic) IS NOT DISTINCT FROM 10", prologue=False)
def list_workers(x):
    """The workers below a topic: its own and those of its groups. A system owner would see all."""
    rows = table(x, W, WORKERS).join(F.broadcast(table(x, G, OWNERS)), "group_id", "left")
    return rows.where(F.coalesce("topic_id", "owner_topic").eqNullSafe(F.lit(10))).select("worker_id", "name")


CW, CWORKERS = "worker_id long, name string, system_id long, topic_id long, group_id long", [(1, "message", None, None, 1), (2, "exception", None, None, 2), (3, "janitor", None, 10, None), (4, "scheduler", 1, None, None), (5, "janitor", None, 11, None), (6, "scheduler", 2, None, None), (7, "janitor", None, 12, None)]
CT, CTOPICS = "topic_id long, system_id long", [(10, 1), (11, 1), (12, 2)]


@R.add("workers_of_owners", f"WITH w AS {values(CW, CWORKERS)}, g AS {values(G, OWNERS)}, t AS {values(CT, CTOPICS)}, o AS {values('owner string, s long, t long, g long', [('system', 1, None, None), ('topic', 1, 10, None), ('group', 1, 11, 2)])} SELECT o.owner, w.worker_id, w.name FROM o, w LEFT JOIN g ON g.group_id = w.group_id LEFT JOIN t ON t.topic_id = coalesce(w.topic_id, g.owner_topic) WHERE w.system_id = o.s OR w.topic_id = o.t OR w.group_id = o.g OR (o.t IS NULL AND o.g IS NULL AND t.system_id = o.s)", prologue=False)
def workers_of_owners(x):
    """The workers that a system, a topic and a group have."""
    tables = table(x, CW, CWORKERS), table(x, G, OWNERS), table(x, CT, CTOPICS)
    found = [control.workers_of(*tables, **ids).withColumn("owner", F.lit(k)) for k, ids in (("system", {"system_id": 1}), ("topic", {"system_id": 1, "topic_id": 10}), ("group", {"system_id": 1, "topic_id": 11, "group_id": 2}))]
    return found[0].unionByName(found[1]).unionByName(found[2]).select("owner", "worker_id", "name")


@R.add("expired_instances", WI + "SELECT worker_id, age FROM i WHERE age >= 9.0", prologue=False)
def expired_instances(x):
    """Instances to sweep; the bound counts."""
    return table(x, I, INSTANCES).where("age >= 9.0").select("worker_id", "age")


J = "job_id long, name string, next_in double, suspended boolean"
JOBS = [(1, "report", -120.0, False), (2, "sweep", 0.0, False), (3, "old", -10.0, True), (4, "later", 60.0, False)]


@R.add("cron_due", f"SELECT job_id, name FROM {values(J, JOBS)} j WHERE next_in <= 0 AND NOT suspended ORDER BY next_in", prologue=False)
def cron_due(x):
    return table(x, J, JOBS).where("next_in <= 0 AND NOT suspended").orderBy("next_in", "job_id").select("job_id", "name")


@R.add("fleet_cron", f"SELECT count(*) FILTER (WHERE next_in < 0 AND NOT suspended) AS overdue, count(*) FILTER (WHERE suspended) AS suspended, max(-next_in) FILTER (WHERE next_in < 0 AND NOT suspended) AS worst FROM {values(J, JOBS)} j", prologue=False)
def fleet_cron(x):
    late = (F.col("next_in") < 0) & ~F.col("suspended")
    return table(x, J, JOBS).agg(F.count_if(late).alias("overdue"), F.count_if("suspended").alias("suspended"), F.max(F.when(late, -F.col("next_in"))).alias("worst"))


@R.add("cron_idempotency_key", "SELECT event_id, concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-7', substr(k, 2, 3), '-8', substr(k, 6, 3), '-', substr(k, 9, 12)) AS idempotency_key FROM (SELECT event_id, lpad(lower(to_hex(epoch_us(ts) // 1000)), 12, '0') AS h, md5(CAST(user_id AS VARCHAR)) AS k FROM events) e", prologue=False)
def cron_idempotency_key(x):
    return x.events.select("event_id", cron.request_key(F.col("ts"), F.col("user_id")).alias("idempotency_key"))


@R.add("cron_next")
def cron_next(x):
    """The next time of each schedule after the newest event: no SQL can say it; tests hold it against a minute-by-minute search."""
    rows = [(e,) for e in ("*/5 * * * *", "0 9 * * mon-fri", "@daily", "@every 90s", "TZ=Europe/Berlin 30 2 * * *", "15 10 1,15 * *", "0 0 29 2 *")]
    return cron.next_times(x.spark.createDataFrame(rows, "schedule string"), x.as_of)


A = "name string, head string, found string, age double"
ALERTS = [("lag", None, None, None), ("lag2", None, "warning", None), ("lag3", "warning", "warning", 10.0), ("lag4", "warning", "warning", 4000.0), ("lag5", "warning", "critical", 10.0), ("lag6", "critical", None, 10.0), ("lag7", "resolved", None, 10.0), ("lag8", "resolved", "warning", 10.0)]


@R.add("alert_classify", f"SELECT name, CASE WHEN found IS NULL THEN CASE WHEN head IS NULL OR head = 'resolved' THEN 'nothing' ELSE 'resolved' END WHEN head IS NULL OR head = 'resolved' OR head <> found OR age >= 3600 THEN 'active' ELSE 'nothing' END AS outcome FROM {values(A, ALERTS)} a", prologue=False)
def alert_classify(x):
    return control.classify_alerts(table(x, A, ALERTS), 3600)


@R.add("fleet_alerts", f"SELECT count(*) FILTER (WHERE head IS NOT NULL AND head <> 'resolved') AS active, count(*) FILTER (WHERE head = 'resolved') AS resolved FROM {values(A, ALERTS)} a", prologue=False)
def fleet_alerts(x):
    return table(x, A, ALERTS).agg(F.count_if(F.col("head").isNotNull() & (F.col("head") != "resolved")).alias("active"), F.count_if(F.col("head") == "resolved").alias("resolved"))


@R.add("partition_alert", ", p AS (SELECT count(DISTINCT id // 1000) AS partitions FROM message_log) SELECT partitions, 64 * (100 + 0) // 5 // 2 AS threshold, partitions >= 64 * (100 + 0) // 5 // 2 AS fires FROM p")
def partition_alert(x):
    """Fires at the threshold, which is half of the ceiling max_locks * (max_connections + max_prepared) / 5."""
    n = x.log.select(log.part_of(F.col("id"), PARTITION_SIZE).alias("part")).agg(F.countDistinct("part").alias("partitions"))
    limit = control.lock_threshold(64, 100, 0)
    return n.select("partitions", F.lit(limit).alias("threshold"), (F.col("partitions") >= limit).alias("fires"))


M = "id long, version long, min_compatible long, status string"
MIGRATIONS = [(1, 1, 1, "success"), (2, 2, 1, "success"), (3, 3, 2, "failure"), (4, 3, 2, "success"), (5, 2, 1, "success")]


@R.add("schema_state", f", m AS {values(M, MIGRATIONS)}, s AS (SELECT arg_max(version, id) AS version FROM m WHERE status = 'success') SELECT s.version, max(m.min_compatible) AS min_compatible FROM s JOIN m ON m.status = 'success' AND m.version <= s.version GROUP BY 1")
def schema_state(x):
    return control.schema_state(table(x, M, MIGRATIONS))


@R.add("schema_gate", f", m AS {values(M, MIGRATIONS)}, s AS (SELECT arg_max(version, id) AS version FROM m WHERE status = 'success'), t AS (SELECT s.version, max(m.min_compatible) AS low FROM s JOIN m ON m.status = 'success' AND m.version <= s.version GROUP BY 1) SELECT CAST(range AS BIGINT) AS build, range BETWEEN low AND version AS supported FROM t, range(5)")
def schema_gate(x):
    s = control.schema_state(table(x, M, MIGRATIONS))
    return x.spark.range(5).crossJoin(F.broadcast(s)).select(F.col("id").alias("build"), F.col("id").between(F.col("min_compatible"), F.col("version")).alias("supported"))


D = "id long, group_id long, declarer string, status string, patterns string, age double"
DECLARED = [(1, 1, "a", "installed", "x", 500.0), (2, 1, "b", "waiting", "y", 400.0), (3, 1, "b", "waiting", "z", 50.0), (4, 2, "a", "installed", "p", 300.0), (5, 2, "c", "waiting", "p", 200.0), (6, 1, "c", "waiting", "q", 100.0), (7, 1, "c", "installed", "q", 10.0)]


@R.add("newest_declaration", f"WITH d AS {values(D, DECLARED)} SELECT group_id, status, declarer, max(id) AS id, arg_max(patterns, id) AS patterns FROM d GROUP BY 1, 2, 3", prologue=False)
def newest_declaration(x):
    return table(x, D, DECLARED).groupBy("group_id", "status", "declarer").agg(F.max("id").alias("id"), F.max_by("patterns", "id").alias("patterns"))


@R.add("open_waiters", f"WITH d AS {values(D, DECLARED)}, e AS (SELECT group_id, arg_max(patterns, id) AS patterns FROM d WHERE status = 'installed' GROUP BY 1), w AS (SELECT group_id, declarer, max(id) AS id, arg_max(patterns, id) AS patterns FROM d WHERE status = 'waiting' GROUP BY 1, 2) SELECT w.group_id, w.declarer, w.id FROM w LEFT JOIN e USING (group_id) WHERE w.patterns IS DISTINCT FROM e.patterns AND NOT EXISTS (SELECT 1 FROM d WHERE d.group_id = w.group_id AND d.declarer = w.declarer AND d.status = 'installed' AND d.id > w.id)", prologue=False)
def open_waiters(x):
    return control.open_waiters(table(x, D, DECLARED))


@R.add("declaration_sweep", f"WITH d AS {values(D, DECLARED)} SELECT id FROM d WHERE status = 'waiting' AND age > 90 AND id <> (SELECT max(id) FROM d n WHERE n.group_id = d.group_id AND n.declarer = d.declarer AND n.status = 'waiting')", prologue=False)
def declaration_sweep(x):
    w = table(x, D, DECLARED).where("status = 'waiting'")
    return w.withColumn("last", F.max("id").over(Window.partitionBy("group_id", "declarer"))).where("age > 90 AND id <> last").select("id")


B = "declared string, stored string, live boolean"
DECLARATIONS = [("a,b", None, True), ("b,a,a", "a,b", True), ("c", "a,b", False), ("c", "a,b", True)]


@R.add("classify_binding", f"WITH d AS {values(B, DECLARATIONS)} SELECT declared, live, CASE WHEN stored IS NULL THEN 'install' WHEN list_sort(list_distinct(string_split(declared, ','))) = list_sort(list_distinct(string_split(stored, ','))) THEN 'join' WHEN NOT live THEN 'install' ELSE 'wait' END AS outcome FROM d", prologue=False)
def classify_binding(x):
    return control.classify_bindings(table(x, B, DECLARATIONS))


P = "worker long, instance string"
DESIRED, RUNNING = [(1, "x"), (2, "x"), (3, "x")], [(2, "y"), (3, "y"), (9, "y")]


@R.add("reconcile_diff", f"WITH d AS {values(P, DESIRED)}, r AS {values(P, RUNNING)} SELECT coalesce(d.worker, r.worker) AS worker, CASE WHEN r.worker IS NULL THEN 'added' WHEN d.worker IS NULL THEN 'removed' ELSE 'kept' END AS change FROM d FULL JOIN r ON d.worker = r.worker", prologue=False)
def reconcile_diff(x):
    d, r = table(x, P, DESIRED).select("worker", F.lit(True).alias("d")), table(x, P, RUNNING).select("worker", F.lit(True).alias("r"))
    change = F.when(F.col("r").isNull(), "added").when(F.col("d").isNull(), "removed").otherwise("kept")
    return d.join(r, "worker", "full_outer").select("worker", change.alias("change"))


O = "message_ns long, least_ns long, most_ns long, default_ns long"
OPTIONS = [(None, 0, 0, 30), (5, 10, 0, 30), (50, 10, 40, 30), (20, 10, 40, 30), (0, 0, 25, 30)]


@R.add("resolve_options", f"WITH o AS {values(O, OPTIONS)}, f AS (SELECT *, coalesce(nullif(message_ns, 0), default_ns) AS v FROM o) SELECT message_ns, least_ns, most_ns, CASE WHEN least_ns > 0 AND v < least_ns THEN least_ns WHEN most_ns > 0 AND v > most_ns THEN most_ns ELSE v END AS timeout_ns FROM f", prologue=False)
def resolve_options(x):
    return table(x, O, OPTIONS).select("message_ns", "least_ns", "most_ns", control.clamp(F.coalesce(F.nullif("message_ns", F.lit(0)), "default_ns"), F.col("least_ns"), F.col("most_ns")).alias("timeout_ns"))


@R.add("advisory_key", "SELECT CAST(range AS BIGINT) AS part, (CAST(83 AS BIGINT) << 20) | CAST(range AS BIGINT) AS lock_key FROM range(6)", prologue=False)
def advisory_key(x):
    """Topic and partition in one number, as 83 and 4 in 87031812."""
    return x.spark.range(6).select(F.col("id").alias("part"), F.shiftleft(F.lit(83).cast("long"), 20).bitwiseOR(F.col("id")).alias("lock_key"))


@R.add("create_ahead", "SELECT id, id // 1000 + 1 AS next_part FROM message_log WHERE id % 1000 = 800")
def create_ahead(x):
    """Ids at four fifths of a partition call for the next one."""
    return x.log.where(F.col("id") % PARTITION_SIZE == PARTITION_SIZE * 4 // 5).select("id", (log.part_of(F.col("id"), PARTITION_SIZE) + 1).alias("next_part"))


@R.add("retention_floor", "SELECT min(committed) AS floor FROM cursor_state")
def retention_floor(x):
    return x.cursors.agg(F.min("committed").alias("floor"))


FLOOR = ", f AS (SELECT head - head // 3 AS floor FROM log_head)"


@R.add("droppable_partitions", FLOOR + ", p AS (SELECT id // 1000 AS part, arg_max(created_at, id) AS newest FROM message_log GROUP BY 1) SELECT part, newest FROM p, log_head, f, clock WHERE part < head // 1000 AND as_of - newest >= INTERVAL '2' DAY AND (part + 1) * 1000 - 1 <= floor")
def droppable_partitions(x):
    return control.droppable(x.log, x.head, x.head - x.head // 3, x.as_of, "INTERVAL '2' DAY", PARTITION_SIZE)


@R.add("sweepable_rows", FLOOR + " SELECT id FROM message_log, f, clock WHERE created_at < as_of - INTERVAL '2' DAY AND id <= floor ORDER BY id LIMIT 500")
def sweepable_rows(x):
    return control.sweepable(x.log, x.head - x.head // 3, x.as_of, "INTERVAL '2' DAY").orderBy("id").limit(500)


@R.add("orphan_deliveries", FLOOR + " SELECT group_id, message_id FROM delivery WHERE message_id IN (SELECT id FROM message_log, f, clock WHERE created_at < as_of - INTERVAL '2' DAY AND id <= floor)")
def orphan_deliveries(x):
    gone = control.sweepable(x.log, x.head - x.head // 3, x.as_of, "INTERVAL '2' DAY")
    return x.deliveries.join(gone.withColumnRenamed("id", "message_id"), "message_id", "left_semi").select("group_id", "message_id")


@R.add("idempotency_sweep", "SELECT id FROM message_log, clock WHERE created_at < as_of - INTERVAL '1' DAY")
def idempotency_sweep(x):
    return x.log.where(F.col("created_at") < F.lit(x.as_of).cast("timestamp_ntz") - F.expr("INTERVAL '1' DAY")).select("id")


@R.add("key_lease_sweep", "SELECT group_id, compaction_key FROM key_lease, clock WHERE expires_at < as_of")
def key_lease_sweep(x):
    return x.key_leases.where(F.col("expires_at") < F.lit(x.as_of).cast("timestamp_ntz")).select("group_id", "compaction_key")


@R.add("retire_verdict", f", s AS ({SNAPSHOT}) SELECT CASE WHEN (SELECT count(compaction_key) FROM message_log) > 0 THEN 'compacted' WHEN count(*) = 0 OR bool_and(head = committed AND ready + inflight + deferred = 0) THEN 'safe' ELSE 'lagging' END AS verdict, count(*) FILTER (WHERE head > committed OR ready + inflight + deferred > 0) AS lagging FROM s")
def retire_verdict(x):
    return control.retire_verdict(group_snapshot(x), not x.log.where("compaction_key IS NOT NULL").isEmpty())


@R.add("event_windows", "SELECT time_bucket(INTERVAL '1' HOUR, ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2", prologue=False)
def event_windows(x):
    """Tumbling windows over the log."""
    return x.events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")


@R.add("event_sessions", ", g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '2' HOUR >= ts THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS first_at, count(*) AS n FROM s GROUP BY user_id, k")
def event_sessions(x):
    """Sessions with gaps of two hours at most."""
    return x.events.groupBy("user_id", F.session_window("ts", "2 hours").alias("w")).agg(F.min("ts").alias("first_at"), F.count("*").alias("n")).select("user_id", "first_at", "n")
