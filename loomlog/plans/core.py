"""Example queries of the log, routing, compaction and delivery operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomlog.functions import routing
from loomlog.operators import delivery, log
from loomlog.plans import Registry, by_group_patterns
from loomlog.sources.fixtures import BINDINGS, GROUPS, PARTITION_SIZE

R = Registry()
PATTERNS = by_group_patterns(BINDINGS)
IDS = [g for g, _ in GROUPS]
ROUTED = "(NOT EXISTS (SELECT 1 FROM binding b WHERE b.group_id = g.group_id) OR EXISTS (SELECT 1 FROM binding b WHERE b.group_id = g.group_id AND regexp_matches(m.routing_key, b.pattern)))"
DUE = "((d.status = 'ready' AND d.can_run_after <= c.as_of) OR (d.status = 'inflight' AND d.lease_until < c.as_of) OR d.status = 'deferred') AND d.attempts < 4"
LIVE = "NOT EXISTS (SELECT 1 FROM key_lease k WHERE k.group_id = d.group_id AND k.compaction_key = m.compaction_key AND k.expires_at >= c.as_of)"


@R.add("range_read", "SELECT id, routing_key, payload FROM message_log, log_head WHERE id > head // 4 AND id <= head // 2")
def range_read(x):
    return log.read_range(x.log, x.head // 4, x.head // 2).select("id", "routing_key", "payload")


@R.add("log_head", "SELECT CAST(coalesce(max(id), 0) AS BIGINT) AS head FROM message_log")
def log_head(x):
    return x.log.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long").alias("head"))


@R.add("routed_compacted_range_read", "SELECT m.id, m.routing_key, m.compaction_key, m.payload FROM message_log m CROSS JOIN log_head h JOIN consumer_group g ON g.group_id = 1 LEFT JOIN head_of k ON k.compaction_key = m.compaction_key WHERE m.id > h.head // 10 AND m.id <= h.head AND " + ROUTED + " AND (m.compaction_key IS NULL OR m.id = k.head_id)")
def routed_compacted_range_read(x):
    rows = routing.routed(log.read_range(x.log, x.head // 10, x.head), PATTERNS, 1)
    return log.compacted(rows, log.heads(x.log)).select("id", "routing_key", "compaction_key", "payload")


@R.add("aligned_lookup", "SELECT d.group_id, d.message_id, coalesce(m.payload, '') AS payload FROM delivery d LEFT JOIN message_log m ON m.id = d.message_id AND m.id % 40 <> 1 WHERE d.status = 'ready'")
def aligned_lookup(x):
    rows = x.log.where("id % 40 <> 1").select(F.col("id").alias("message_id"), "payload")
    return x.deliveries.where("status = 'ready'").join(rows, "message_id", "left").select("group_id", "message_id", F.coalesce("payload", F.lit("")).alias("payload"))


@R.add("key_history", "SELECT id, compaction_rank, payload FROM message_log WHERE compaction_key = 'user:1' ORDER BY id DESC LIMIT 20")
def key_history(x):
    return log.key_history(x.log, "user:1", 20).select("id", "compaction_rank", "payload")


@R.add("key_head", "SELECT m.id, m.compaction_key, m.payload FROM message_log m JOIN head_of h ON m.id = h.head_id WHERE h.compaction_key = 'user:1'")
def key_head(x):
    own = x.log.where("compaction_key = 'user:1'")
    return own.orderBy(F.desc("compaction_rank"), F.desc("id")).limit(1).select("id", "compaction_key", "payload")


@R.add("list_heads", "SELECT h.compaction_key, h.head_id, m.payload FROM head_of h JOIN message_log m ON m.id = h.head_id")
def list_heads(x):
    rows = log.heads(x.log).join(x.log.select(F.col("id").alias("head_id"), "payload"), "head_id")
    return rows.select("compaction_key", "head_id", "payload").orderBy("compaction_key")


@R.add("partition_list", "SELECT id // 1000 AS part, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM message_log GROUP BY 1")
def partition_list(x):
    return x.log.groupBy(log.part_of(F.col("id"), PARTITION_SIZE).alias("part")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@R.add("topic_empty", "SELECT count(*) = 0 AS is_empty, count(compaction_key) > 0 AS is_compacted FROM message_log")
def topic_empty(x):
    some = x.log.limit(1).agg((F.count("*") == 0).alias("is_empty"))
    keyed = x.log.where("compaction_key IS NOT NULL").limit(1).agg((F.count("*") > 0).alias("is_compacted"))
    return some.crossJoin(keyed)


@R.add("route_group", "SELECT g.group_id, m.id FROM message_log m CROSS JOIN consumer_group g WHERE " + ROUTED)
def route_group(x):
    return routing.by_group(x.log, IDS, PATTERNS).select("group_id", "id")


@R.add("matching_groups", "SELECT m.routing_key, g.group_id FROM (SELECT DISTINCT routing_key FROM message_log) m CROSS JOIN consumer_group g WHERE " + ROUTED)
def matching_groups(x):
    return routing.by_group(x.log.select("routing_key").distinct(), IDS, PATTERNS).select("routing_key", "group_id")


@R.add("route_wildcard", "SELECT id FROM message_log WHERE regexp_full_match(routing_key, 'events[.].*[.]us')")
def route_wildcard(x):
    return x.log.where(routing.any_of(F.col("routing_key"), [routing.wildcard("events.*.us")])).select("id")


@R.add("route_nats", "SELECT id, regexp_full_match(routing_key, 'events[.][^.]+') AS two, regexp_full_match(routing_key, 'events[.].+') AS rest FROM message_log WHERE regexp_full_match(routing_key, 'events[.][^.]+[.]eu') OR regexp_full_match(routing_key, 'events[.]click[.].+')")
def route_nats(x):
    key = F.col("routing_key")
    hit = routing.any_of(key, [routing.segments("events.*.eu"), routing.segments("events.click.>")])
    return x.log.where(hit).select("id", routing.any_of(key, [routing.segments("events.*")]).alias("two"), routing.any_of(key, [routing.segments("events.>")]).alias("rest"))


@R.add("route_header", "SELECT id FROM message_log WHERE CAST(json_extract_string(payload, '$.k') AS INTEGER) = 7")
def route_header(x):
    return x.log.where(routing.header_contains(F.col("payload"), {"k": 7})).select("id")


@R.add("route_header_nested", "SELECT id FROM message_log WHERE routing_key LIKE '%.us' AND id % 3 = 0")
def route_header_nested(x):
    """Headers made of the routing key and the id: an object in an object, and a boolean."""
    part = F.coalesce(F.regexp_extract("routing_key", "[^.]*$", 0), F.lit(""))
    headers = F.to_json(F.struct(F.struct(part.alias("region"), F.lit(1).alias("v")).alias("route"), (F.col("id") % 3 == 0).alias("third")))
    return x.log.where(routing.header_contains(headers, {"route": {"region": "us"}, "third": True})).select("id")


@R.add("compacted_read", "SELECT m.id, m.compaction_key FROM message_log m LEFT JOIN head_of h ON h.compaction_key = m.compaction_key WHERE m.compaction_key IS NULL OR h.head_id = m.id")
def compacted_read(x):
    return log.compacted(x.log, log.heads(x.log)).select("id", "compaction_key")


@R.add("compaction_heads", "SELECT compaction_key, head_id, head_rank FROM head_of")
def compaction_heads(x):
    return log.heads(x.log)


@R.add("head_upsert", "SELECT compaction_key, head_id, head_rank FROM head_of")
def head_upsert(x):
    half = x.head // 2
    return log.upsert_heads(log.heads(x.log.where(F.col("id") <= half)), x.log.where(F.col("id") > half))


@R.add("idempotent_append", ", known AS (SELECT DISTINCT idempotency_key FROM produce_attempt WHERE seq <= 100), firsts AS (SELECT idempotency_key, min(seq) AS seq FROM produce_attempt WHERE idempotency_key NOT IN (SELECT idempotency_key FROM known) GROUP BY 1), ids AS (SELECT seq, h.head + row_number() OVER (ORDER BY seq) AS id FROM firsts CROSS JOIN log_head h) SELECT a.seq, a.idempotency_key, CAST(coalesce(i.id, 0) AS BIGINT) AS id, i.id IS NULL AS duplicate FROM produce_attempt a LEFT JOIN ids i ON a.seq = i.seq")
def idempotent_append(x):
    known = x.attempts.where("seq <= 100").select("idempotency_key").distinct()
    return log.append(x.attempts, known, x.head).select("seq", "idempotency_key", "id", "duplicate")


@R.add("compact_superseded", "SELECT m.id, m.compaction_key FROM message_log m JOIN (SELECT compaction_key, max(id) AS last FROM message_log, log_head WHERE id <= head // 2 GROUP BY 1) l ON l.compaction_key = m.compaction_key WHERE m.id < l.last")
def compact_superseded(x):
    return log.superseded(x.log, x.head // 2).select("id", "compaction_key")


@R.add("compact_tombstones", "SELECT compaction_key, max(id) AS id FROM message_log, log_head WHERE id <= head // 2 AND compaction_key IS NOT NULL GROUP BY 1 HAVING arg_max(compaction_rank, id) = -1")
def compact_tombstones(x):
    """Keys whose last message up to the floor is a tombstone (here: of rank -1)."""
    return log.tombstones(x.log, x.head // 2, F.col("compaction_rank") == -1).join(x.log.select("id", "compaction_key"), "id").select("compaction_key", "id")


@R.add("fresh_claim", "SELECT group_id, claimed AS low, least(claimed + 200, head) AS high FROM cursor_state, log_head WHERE claimed < least(claimed + 200, head)")
def fresh_claim(x):
    return delivery.fresh_claim(x.cursors, x.head, 200)


@R.add("lease_reclaim", "SELECT group_id, low, high, CAST(reclaims + 1 AS INT) AS reclaims, reclaims >= 3 AS quarantine FROM lease WHERE expired QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY low) = 1")
def lease_reclaim(x):
    return delivery.reclaim(x.leases, 3)


@R.add("claim_order", ", r AS (SELECT group_id, low, high FROM lease WHERE expired QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY low) = 1) SELECT c.group_id, coalesce(r.low, c.claimed) AS low, coalesce(r.high, least(c.claimed + 200, head)) AS high, r.low IS NOT NULL AS reclaimed FROM cursor_state c CROSS JOIN log_head LEFT JOIN r ON r.group_id = c.group_id WHERE r.low IS NOT NULL OR c.claimed < least(c.claimed + 200, head)")
def claim_order(x):
    return delivery.claim_next(x.cursors, x.leases, x.head, 200, 3)


FENCE = ", fence AS (SELECT CAST(g AS BIGINT) AS group_id, CAST(settled AS BIGINT) AS settled, CAST(xmin AS BIGINT) AS xmin, CAST(xmax AS BIGINT) AS xmax, CAST(pending_xmax AS BIGINT) AS pending_xmax, CAST(pending_head AS BIGINT) AS pending_head FROM (VALUES (1, 7, 100, 100, NULL, NULL), (2, 7, 99, 100, NULL, NULL), (3, 7, 99, 104, 98, 9), (4, 20, 97, 104, 98, 9), (5, 0, 104, 104, 98, 9)) AS v(g, settled, xmin, xmax, pending_xmax, pending_head))"


@R.add("settled_head", FENCE + " SELECT group_id, greatest(settled, CASE WHEN xmin >= xmax THEN head END, CASE WHEN xmin >= pending_xmax THEN pending_head END) AS gate FROM fence, log_head")
def settled_head(x):
    """The gate of a claim: no open writer, one that is open, a noted head that has settled, one that hasn't, both."""
    rows = [(1, 7, 100, 100, None, None), (2, 7, 99, 100, None, None), (3, 7, 99, 104, 98, 9), (4, 20, 97, 104, 98, 9), (5, 0, 104, 104, 98, 9)]
    fence = x.spark.createDataFrame(rows, "group_id long, settled long, xmin long, xmax long, pending_xmax long, pending_head long")
    return fence.select("group_id", delivery.gate(F.col("settled"), F.lit(x.head), F.col("xmin"), F.col("xmax"), F.col("pending_head"), F.col("pending_xmax")).alias("gate"))


@R.add("quarantine_rows", "SELECT l.group_id, m.id AS message_id, 'ready' AS status, 0 AS attempts FROM message_log m JOIN lease l ON m.id > l.low AND m.id <= l.high WHERE l.expired AND l.reclaims >= 3")
def quarantine_rows(x):
    return delivery.quarantined(x.log, x.leases, 3)


@R.add("force_reclaim", "SELECT group_id, low, CAST(greatest(reclaims - 1, -1) AS INT) AS reclaims, true AS expired FROM lease WHERE NOT expired UNION ALL SELECT group_id, low, reclaims, expired FROM lease WHERE expired")
def force_reclaim(x):
    return delivery.force_reclaimed(x.leases, ~F.col("expired")).select("group_id", "low", "reclaims", "expired")


@R.add("exception_eligible", "SELECT d.group_id, d.message_id, d.status FROM delivery d JOIN message_log m ON m.id = d.message_id CROSS JOIN clock c WHERE " + DUE + " AND " + LIVE)
def exception_eligible(x):
    return delivery.eligible(x.deliveries, x.log, x.key_leases, x.as_of, 4).select("group_id", "message_id", "status")


@R.add("exception_claim", "SELECT d.group_id, d.message_id, CAST(d.attempts + 1 AS INT) AS attempts, CASE WHEN d.status = 'inflight' THEN d.attempts END AS expired_attempt FROM delivery d JOIN message_log m ON m.id = d.message_id CROSS JOIN clock c WHERE " + DUE + " AND " + LIVE + " QUALIFY row_number() OVER (PARTITION BY d.group_id ORDER BY d.message_id) <= 10")
def exception_claim(x):
    return delivery.claim(delivery.eligible(x.deliveries, x.log, x.key_leases, x.as_of, 4), 10)


@R.add("lease_renew", "SELECT d.group_id, d.message_id, c.as_of + INTERVAL '30' SECOND AS lease_until FROM delivery d, clock c WHERE d.status = 'inflight' AND d.lease_until >= c.as_of - INTERVAL '100' HOUR")
def lease_renew(x):
    clock = F.lit(x.as_of).cast("timestamp_ntz")
    return x.deliveries.where((F.col("status") == "inflight") & (F.col("lease_until") >= clock - F.expr("INTERVAL '100' HOUR"))).select("group_id", "message_id", (clock + F.expr("INTERVAL '30' SECOND")).alias("lease_until"))


@R.add("kill_backstop", "SELECT group_id, message_id, 'dead' AS status, attempts FROM delivery, clock WHERE status = 'inflight' AND lease_until < as_of AND attempts >= 3")
def kill_backstop(x):
    return delivery.killed(x.deliveries, x.as_of, 3)


@R.add("exception_success", "SELECT group_id, message_id, status FROM delivery WHERE NOT (status = 'inflight' AND attempts = 1)")
def exception_success(x):
    done = x.deliveries.where("status = 'inflight' AND attempts = 1").select("group_id", "message_id")
    return x.deliveries.join(done, ["group_id", "message_id"], "left_anti").select("group_id", "message_id", "status")


@R.add("record_failure", "SELECT group_id, message_id, 'ready' AS status, as_of + to_seconds(CAST(least(300, 2 * pow(2, greatest(attempts - 1, 0))) AS BIGINT)) AS can_run_after, attempts AS logged_attempt FROM delivery, clock WHERE status = 'inflight'")
def record_failure(x):
    kept, logged = _retried(x, "failure")
    return kept.join(logged.select("group_id", "message_id", F.col("attempt").alias("logged_attempt")), ["group_id", "message_id"]).select("group_id", "message_id", "status", "can_run_after", "logged_attempt")


def _retried(x, kind):
    """Deliveries and log rows after all that is in flight had one outcome."""
    taken = x.deliveries.where("status = 'inflight'").select("group_id", "message_id", "attempts", F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("error"))
    return delivery.retry_outcomes(taken, x.as_of)


@R.add("record_terminal", "SELECT group_id, message_id, CASE WHEN status = 'inflight' THEN 'dead' ELSE status END AS status FROM delivery")
def record_terminal(x):
    return x.deliveries.where("status <> 'inflight'").select("group_id", "message_id", "status").unionByName(_retried(x, "terminal")[0].select("group_id", "message_id", "status"))


@R.add("record_superseded", "SELECT group_id, message_id, 'superseded' AS status, CAST(attempts - 1 AS INT) AS attempts, CAST(attempts AS INT) AS logged_attempt FROM delivery WHERE status = 'inflight'")
def record_superseded(x):
    """The attempt is taken back and logged under the number it had."""
    kept, logged = _retried(x, "superseded")
    return kept.join(logged.select("group_id", "message_id", F.col("attempt").alias("logged_attempt")), ["group_id", "message_id"]).select("group_id", "message_id", "status", "attempts", "logged_attempt")


@R.add("range_commit", "SELECT l.group_id, m.id AS message_id, CASE m.id % 5 WHEN 0 THEN 'ready' WHEN 1 THEN 'dead' WHEN 2 THEN 'deferred' END AS status, 0 AS attempts FROM lease l JOIN message_log m ON m.id > l.low AND m.id <= l.high WHERE NOT l.expired AND m.id % 5 < 3")
def range_commit(x):
    """A range's outcomes by the message's residue: exception, terminal and deferred ones become deliveries; the rest, done, leave none."""
    rows = delivery.in_ranges(x.log.select("id"), x.leases.where("NOT expired").select("group_id", "low", "high"))
    kind = F.element_at(F.array(*(F.lit(k) for k in ("failure", "terminal", "deferred", "success", "superseded"))), (F.col("id") % 5 + 1).cast("int"))
    kept, _ = delivery.range_outcomes(rows.select("group_id", F.col("id").alias("message_id"), kind.alias("kind"), F.lit(None).cast("string").alias("error")), x.as_of, 0)
    return kept.select("group_id", "message_id", "status", "attempts")


@R.add("contiguous_prefix", "SELECT group_id, coalesce(min(CASE WHEN status <> 'done' THEN message_id END) - 1, max(message_id)) AS upto FROM delivery GROUP BY group_id")
def contiguous_prefix(x):
    return delivery.prefix(x.deliveries)


@R.add("key_lease_verdict", "SELECT d.group_id, d.message_id, CASE WHEN h.head_id <> d.message_id THEN 'superseded' WHEN k.expires_at >= c.as_of THEN 'busy' ELSE 'acquired' END AS verdict FROM delivery d JOIN message_log m ON m.id = d.message_id JOIN head_of h ON h.compaction_key = m.compaction_key LEFT JOIN key_lease k ON k.group_id = d.group_id AND k.compaction_key = m.compaction_key CROSS JOIN clock c")
def key_lease_verdict(x):
    keyed = x.deliveries.join(x.log.where("compaction_key IS NOT NULL").select(F.col("id").alias("message_id"), "compaction_key"), "message_id")
    rows = keyed.join(log.heads(x.log), "compaction_key").join(x.key_leases, ["group_id", "compaction_key"], "left")
    verdict = delivery.key_verdict(F.col("head_id") == F.col("message_id"), F.col("expires_at"), F.lit(False), x.as_of)
    return rows.select("group_id", "message_id", verdict.alias("verdict"))


BATCH = ", batch AS (SELECT * FROM message_log WHERE id > 100 ORDER BY id LIMIT 300)"


@R.add("fanout_materialize", BATCH + " SELECT g.group_id, m.id AS message_id FROM batch m CROSS JOIN consumer_group g LEFT JOIN head_of h ON h.compaction_key = m.compaction_key WHERE " + ROUTED + " AND (m.compaction_key IS NULL OR h.head_id = m.id) AND NOT EXISTS (SELECT 1 FROM delivery d WHERE d.group_id = g.group_id AND d.message_id = m.id)")
def fanout_materialize(x):
    batch = x.log.where("id > 100").orderBy("id").limit(300)
    return delivery.fan_out(batch, routing.by_group(log.compacted(batch, log.heads(x.log)), IDS, PATTERNS), x.deliveries, 300, x.head)[0]


@R.add("fanout_mark", BATCH + " SELECT CASE WHEN count(*) = 300 THEN least(max(b.id), max(head)) ELSE max(head) END AS mark FROM batch b, log_head")
def fanout_mark(x):
    batch = x.log.where("id > 100").orderBy("id").limit(300)
    return delivery.fan_out(batch, batch.withColumn("group_id", F.lit(1)), x.deliveries, 300, x.head)[1]


@R.add("fanout_all", "SELECT g.group_id, count(*) AS n, sum(m.id) AS ids FROM message_log m CROSS JOIN consumer_group g GROUP BY 1")
def fanout_all(x):
    every = x.log.withColumn("group_id", F.explode(F.array(*[F.lit(g).cast("long") for g in IDS])))
    return every.groupBy("group_id").agg(F.count("*").alias("n"), F.sum("id").cast("decimal(38,0)").alias("ids"))


@R.add("lifecycle_claim", "SELECT d.group_id, d.message_id, 'processing' AS status, CAST(d.attempts + 1 AS INT) AS attempts, m.payload FROM delivery d JOIN message_log m ON m.id = d.message_id WHERE d.status = 'ready' QUALIFY row_number() OVER (PARTITION BY d.group_id ORDER BY d.message_id) <= 5")
def lifecycle_claim(x):
    rows = delivery.claim(x.deliveries.where("status = 'ready'"), 5).join(x.log.select(F.col("id").alias("message_id"), "payload"), "message_id")
    return rows.select("group_id", "message_id", F.lit("processing").alias("status"), "attempts", "payload")


@R.add("lifecycle_outcome", "SELECT group_id, message_id, CASE WHEN message_id % 3 = 0 THEN 'done' WHEN attempts >= 3 THEN 'dead' ELSE 'ready' END AS status FROM delivery WHERE status = 'inflight'")
def lifecycle_outcome(x):
    status = delivery.lifecycle_status(F.col("message_id") % 3 == 0, F.col("attempts"), 3)
    return x.deliveries.where("status = 'inflight'").select("group_id", "message_id", status.alias("status"))


@R.add("advance_committed", "SELECT c.group_id, c.claimed, greatest(c.committed, least((SELECT min(low) FROM lease l WHERE l.group_id = c.group_id), (SELECT min(message_id) - 1 FROM delivery d WHERE d.group_id = c.group_id AND d.status IN ('ready', 'inflight', 'deferred')), c.claimed)) AS committed FROM cursor_state c")
def advance_committed(x):
    return delivery.advance(x.cursors, x.leases, x.deliveries)


@R.add("fifo_eligible", "SELECT d.group_id, m.compaction_key, min(d.message_id) AS message_id FROM delivery d JOIN message_log m ON m.id = d.message_id WHERE d.status IN ('ready', 'inflight') AND m.compaction_key IS NOT NULL GROUP BY 1, 2")
def fifo_eligible(x):
    open_ = x.deliveries.where(F.col("status").isin("ready", "inflight")).join(x.log.select(F.col("id").alias("message_id"), "compaction_key").where("compaction_key IS NOT NULL"), "message_id")
    return delivery.fifo(open_)


@R.add("fifo_claim", ", u AS (SELECT d.*, m.compaction_key FROM delivery d JOIN message_log m ON m.id = d.message_id WHERE d.status IN ('ready', 'inflight') AND m.compaction_key IS NOT NULL), f AS (SELECT group_id, compaction_key, min(message_id) AS message_id FROM u GROUP BY 1, 2) SELECT u.group_id, u.message_id FROM u JOIN f USING (group_id, compaction_key, message_id) CROSS JOIN clock WHERE (u.status = 'ready' OR u.lease_until < as_of) AND NOT EXISTS (SELECT 1 FROM u v WHERE v.group_id = u.group_id AND v.compaction_key = u.compaction_key AND v.status = 'inflight' AND v.lease_until >= as_of)")
def fifo_claim(x):
    open_ = x.deliveries.where(F.col("status").isin("ready", "inflight")).join(x.log.select(F.col("id").alias("message_id"), "compaction_key").where("compaction_key IS NOT NULL"), "message_id")
    return delivery.fifo_claimable(open_, x.as_of)


@R.add("pop_delete", "SELECT group_id, message_id, message_id IN (SELECT d2.message_id FROM delivery d2 WHERE d2.group_id = d.group_id AND d2.status = 'ready' ORDER BY d2.message_id LIMIT 3) AS popped FROM delivery d WHERE d.status = 'ready'")
def pop_delete(x):
    ready = x.deliveries.where("status = 'ready'")
    popped = delivery.claim(ready, 3).select("group_id", "message_id", F.lit(True).alias("popped"))
    return ready.select("group_id", "message_id").join(popped, ["group_id", "message_id"], "left").select("group_id", "message_id", F.coalesce("popped", F.lit(False)).alias("popped"))


@R.add("nack_backoff", "SELECT group_id, message_id, CASE WHEN attempts >= 4 THEN 'dead' ELSE 'ready' END AS status, least(300.0::DOUBLE, 2 * pow(2, attempts)) AS wait_seconds FROM delivery WHERE status = 'inflight'")
def nack_backoff(x):
    return x.deliveries.where("status = 'inflight'").select("group_id", "message_id", F.when(F.col("attempts") >= 4, "dead").otherwise("ready").alias("status"), delivery.backoff_seconds(F.col("attempts"), 2, 300).alias("wait_seconds"))


@R.add("backoff", "SELECT CAST(range AS INT) AS attempt, least(60.0::DOUBLE, 1 * pow(3, range)) AS wait_seconds FROM range(10)", prologue=False)
def backoff(x):
    return x.spark.range(10).select(F.col("id").cast("int").alias("attempt"), delivery.backoff_seconds(F.col("id"), 1, 60, 3).alias("wait_seconds"))


@R.add("materialize", "SELECT c.group_id, m.id AS message_id FROM message_log m CROSS JOIN cursor_state c JOIN consumer_group g ON g.group_id = c.group_id WHERE m.id > c.claimed AND " + ROUTED + " AND NOT EXISTS (SELECT 1 FROM delivery d WHERE d.group_id = c.group_id AND d.message_id = m.id)")
def materialize(x):
    new = routing.by_group(x.log, IDS, PATTERNS).join(x.cursors, "group_id").where("id > claimed").select("group_id", F.col("id").alias("message_id"))
    return new.join(x.deliveries.select("group_id", "message_id"), ["group_id", "message_id"], "left_anti")


@R.add("lane_init", "SELECT CAST(range AS INT) AS lane, head * range // 8 AS low, CASE WHEN range = 7 THEN head ELSE head * (range + 1) // 8 END AS high FROM range(8), log_head")
def lane_init(x):
    return delivery.lane_bounds(x.spark, x.head, 8)


LANES = ", lanes AS (SELECT g.group_id, CAST(r.range AS INT) AS lane, head * (r.range + 1) // 8 AS high, CASE WHEN r.range < g.group_id * 2 THEN head * (r.range + 1) // 8 ELSE head * r.range // 8 + 3 END AS committed FROM consumer_group g, range(8) r, log_head)"


@R.add("lane_watermark", LANES + " SELECT group_id, coalesce(arg_min(committed, lane) FILTER (WHERE committed < high), max(committed)) AS watermark FROM lanes GROUP BY 1")
def lane_watermark(x):
    return delivery.watermark(_lanes(x)).select("group_id", "watermark")


@R.add("caught_up", LANES + " SELECT group_id, bool_and(committed >= high) AS caught_up FROM lanes GROUP BY 1")
def caught_up(x):
    return delivery.watermark(_lanes(x)).select("group_id", "caught_up")


def _lanes(x):
    lanes = x.groups.crossJoin(delivery.lane_bounds(x.spark, x.head, 8))
    through = F.col("lane") < F.col("group_id") * 2
    return lanes.withColumn("committed", F.when(through, F.col("high")).otherwise(F.col("low") + 3))


@R.add("superseded_by", "SELECT id, lead(id) OVER (PARTITION BY compaction_key ORDER BY id) AS superseded_by FROM message_log WHERE compaction_key IS NOT NULL")
def superseded_by(x):
    from pyspark.sql.window import Window

    return x.log.where("compaction_key IS NOT NULL").select("id", F.lead("id").over(Window.partitionBy("compaction_key").orderBy("id")).alias("superseded_by"))


@R.add("exactly_once_audit", ", d AS (SELECT group_id, message_id, count(*) FILTER (WHERE status = 'success') AS n FROM delivery_log GROUP BY 1, 2) SELECT group_id, count(*) AS messages, count(*) FILTER (WHERE n = 0) AS skipped, count(*) FILTER (WHERE n > 1) AS repeated FROM d GROUP BY 1")
def exactly_once_audit(x):
    d = x.delivery_log.groupBy("group_id", "message_id").agg(F.count_if(F.col("status") == "success").alias("n"))
    return d.groupBy("group_id").agg(F.count("*").alias("messages"), F.count_if(F.col("n") == 0).alias("skipped"), F.count_if(F.col("n") > 1).alias("repeated"))
