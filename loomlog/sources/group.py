"""A consumer group of a topic: its cursor, range leases, deliveries, delivery log and key leases, as tables of the topic.

Every change reads one version of the topic and publishes the next (``Topic.update``): what belongs together is one commit, and a
change that another writer overtook is worked out anew. Leases carry a token, which changes with each claim: a worker whose
lease was taken over gets ``LeaseLost``, and nothing that it reports is kept. Nothing reads a clock; times are given.

Cursor and leases, a row per open range, are small and handled as rows; messages, deliveries and outcomes are DataFrames.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta
from typing import Any, NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.errors import LeaseLost
from loomlog.functions import routing
from loomlog.operators import delivery
from loomlog.operators import log as log_ops
from loomlog.sources.store import Topic


class Lease(NamedTuple):
    token: str
    low: int
    high: int
    reclaims: int
    until: datetime


class Group:
    SCHEMA = {
        "cursor": "claimed long, committed long",
        "lease": "token string, low long, high long, reclaims int, until timestamp_ntz",
        "delivery": "group_id long, message_id long, status string, attempts int, can_run_after timestamp_ntz, lease_until timestamp_ntz, token string, last_error string",
        "delivery_log": "group_id long, message_id long, attempt int, status string, error string, at timestamp_ntz",
        "key_lease": "group_id long, compaction_key string, token string, expires_at timestamp_ntz",
    }

    def __init__(self, topic: Topic, group_id: int, patterns: list[str] | None = None, most_attempts: int = 5, most_reclaims: int = 3, log_success: bool = False):
        """``patterns``: regular expressions of routing keys; none: every message. ``log_success``: whether the delivery log keeps successes, too."""
        self.topic, self.group_id, self.patterns = topic, group_id, patterns or []
        self.most_attempts, self.most_reclaims, self.log_success = most_attempts, most_reclaims, log_success

    # tables

    def _name(self, table: str) -> str:
        return f"group-{self.group_id}-{table}"

    def read(self, table: str, version: int | None = None) -> DataFrame:
        found = self.topic.read(self._name(table), version)
        return found if found is not None else self.topic.spark.createDataFrame([], self.SCHEMA[table])

    def _frame(self, table: str, rows: list[tuple]) -> DataFrame:
        return self.topic.spark.createDataFrame(rows, self.SCHEMA[table]).coalesce(1)

    def _leases(self, version: int | None) -> list[Lease]:
        return sorted((Lease(*r) for r in self.read("lease", version).select(*Lease._fields).collect()), key=lambda r: (r.until, r.low))

    def cursor(self, version: int | None = None) -> tuple[int, int]:
        """claimed and committed."""
        found = self.read("cursor", version).head()
        return (found.claimed, found.committed) if found else (0, 0)

    def leases(self) -> list[Lease]:
        return self._leases(None)

    def _tables(self, **frames: DataFrame) -> dict[str, DataFrame]:
        return {self._name(k): self._shaped(k, v) for k, v in frames.items()}

    def _shaped(self, table: str, df: DataFrame) -> DataFrame:
        """All columns of a table in their order, absent ones null."""
        df = df if "group_id" in df.columns or table in ("cursor", "lease") else df.withColumn("group_id", F.lit(self.group_id))
        parts = (c.split() for c in self.SCHEMA[table].split(", "))
        return df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in parts))

    # ranges of the log

    def claim(self, limit: int, as_of: datetime, hold: timedelta = timedelta(seconds=30), gate: int | None = None, token: str | None = None) -> Lease | None:
        """A lease of a range (low, high]: an expired one first, else the next ``limit`` ids up to ``gate`` (by default the head). None if there is none.

        An expired range that was reclaimed ``most_reclaims`` times is quarantined: each of its messages becomes a ready
        delivery of its own, so that a poisonous one can't hold back the others.
        """
        token = token or uuid.uuid4().hex

        def change(base: int) -> tuple[dict[str, Any], Lease | None]:
            leases, poison, taken = self._leases(base), [], None
            for r in [r for r in leases if r.until < as_of]:
                leases.remove(r)
                if r.reclaims < self.most_reclaims:
                    taken = Lease(token, r.low, r.high, r.reclaims + 1, as_of + hold)
                    break
                poison.append(r)
            claimed, committed = self.cursor(base)
            if taken is None:
                high = min(claimed + limit, self.topic.head(base) if gate is None else gate)
                if claimed < high:
                    taken, claimed = Lease(token, claimed, high, 0, as_of + hold), high
            if taken is None and not poison:
                return {}, None
            made = {"replace": self._tables(lease=self._frame("lease", [*leases, *([taken] if taken else [])]), cursor=self._frame("cursor", [(claimed, committed)]))}
            if poison:
                ranges = self.topic.spark.createDataFrame([(self.group_id, r.low, r.high) for r in poison], "group_id long, low long, high long")
                rows = delivery.in_ranges(self.topic.read("log", base).select("id"), ranges).select("group_id", F.col("id").alias("message_id"), F.lit("failure").alias("kind"), F.lit("range quarantined").alias("error"))
                kept, logged = delivery.range_outcomes(rows, as_of, 0)
                made["append"] = self._tables(delivery=kept, delivery_log=logged)
            return made, taken

        return self.topic.update(change)

    def messages(self, low: int, high: int, version: int | None = None) -> DataFrame:
        """What the group receives of a range: routed, and of each key the head alone."""
        log = self.topic.read("log", version)
        rows = log_ops.read_range(log, low, high, self.topic.partition_size)
        return log_ops.compacted(rows.where(routing.any_of(F.col("routing_key"), self.patterns)), self.topic.heads(version))

    def _own(self, leases: list[Lease], token: str) -> Lease:
        found = next((r for r in leases if r.token == token), None)
        if found is None:
            raise LeaseLost(token)
        return found

    def _outcomes(self, outcomes: DataFrame, low: int, high: int, as_of: datetime, wait: timedelta) -> dict[str, DataFrame]:
        rows = outcomes.where((F.col("message_id") > low) & (F.col("message_id") <= high)).withColumn("group_id", F.lit(self.group_id))
        kept, logged = delivery.range_outcomes(rows, as_of, wait.total_seconds())
        return self._tables(delivery=kept, delivery_log=logged if self.log_success else logged.where("status <> 'success'"))

    def commit(self, token: str, outcomes: DataFrame, as_of: datetime, wait: timedelta = timedelta(0)) -> None:
        """End a range: free its lease and keep outcomes (message_id, kind, error; kinds: success, failure, terminal, deferred, superseded). Messages without one count as done."""

        def change(base: int) -> tuple[dict[str, Any], None]:
            leases = self._leases(base)
            own = self._own(leases, token)
            return {"replace": self._tables(lease=self._frame("lease", [r for r in leases if r != own])), "append": self._outcomes(outcomes, own.low, own.high, as_of, wait)}, None

        self.topic.update(change)

    def partial_commit(self, token: str, outcomes: DataFrame, as_of: datetime, wait: timedelta = timedelta(0)) -> int:
        """Narrow a lease to what is behind the last message up to which all have an outcome, and keep those outcomes; the rest stays leased. Gives the new low."""

        def change(base: int) -> tuple[dict[str, Any], int]:
            leases = self._leases(base)
            own = self._own(leases, token)
            open_ = self.messages(own.low, own.high, base).select(F.col("id").alias("message_id")).join(outcomes.select("message_id"), "message_id", "left_anti")
            first = open_.agg(F.min("message_id")).head()[0]
            upto = own.high if first is None else first - 1
            rest = [r._replace(low=upto) if r == own else r for r in leases]
            return {"replace": self._tables(lease=self._frame("lease", rest)), "append": self._outcomes(outcomes, own.low, upto, as_of, wait)}, upto

        return self.topic.update(change)

    def _change_lease(self, held_by: str, **new: Any) -> None:
        def change(base: int) -> tuple[dict[str, Any], None]:
            leases = self._leases(base)
            own = self._own(leases, held_by)
            now = {k: v(own) if callable(v) else v for k, v in new.items()}
            return {"replace": self._tables(lease=self._frame("lease", [r._replace(**now) if r == own else r for r in leases]))}, None

        self.topic.update(change)

    def renew(self, token: str, until: datetime) -> None:
        self._change_lease(token, until=until)

    def force_reclaim(self, token: str, as_of: datetime) -> None:
        """Let the range expire now, for the next claim, without counting that as a reclaim; the token changes, so its worker can't commit any more."""
        self._change_lease(token, until=as_of - timedelta(microseconds=1), reclaims=lambda r: max(r.reclaims - 1, -1), token=uuid.uuid4().hex)

    # single deliveries

    def claim_deliveries(self, limit: int, as_of: datetime, hold: timedelta = timedelta(seconds=30), token: str | None = None) -> DataFrame:
        """Deliveries that are due, whose key nobody holds: in flight under a new token, with one attempt more; message_id, attempts and the message's columns. Those taken from a worker whose lease expired leave ``expired`` in the log."""
        token = token or uuid.uuid4().hex

        def change(base: int) -> tuple[dict[str, Any], int]:
            rows, log = self.read("delivery", base), self.topic.read("log", base)
            if log is None:
                return {}, base
            due = delivery.eligible(rows, log, self.read("key_lease", base), as_of, self.most_attempts)
            first = delivery.claim(due.select("group_id", "message_id", "status", "attempts"), limit).collect()
            if not first:
                return {}, base
            taken = self.topic.spark.createDataFrame(first, "group_id long, message_id long, attempts int, expired_attempt int")  # ``limit`` rows at most
            clock = F.lit(as_of).cast("timestamp_ntz")
            held = taken.select("group_id", "message_id", F.lit("inflight").alias("status"), "attempts", clock.alias("can_run_after"), F.lit(as_of + hold).cast("timestamp_ntz").alias("lease_until"), F.lit(token).alias("token"), F.lit(None).cast("string").alias("last_error"))
            rest = rows.join(taken.select("group_id", "message_id"), ["group_id", "message_id"], "left_anti")
            gone = taken.where("expired_attempt IS NOT NULL").select("group_id", "message_id", F.col("expired_attempt").alias("attempt"), F.lit("expired").alias("status"), F.lit(None).cast("string").alias("error"), clock.alias("at"))
            return {"replace": self._tables(delivery=rest.unionByName(self._shaped("delivery", held))), "append": self._tables(delivery_log=gone)}, base + 1

        version = self.topic.update(change)
        own = self.read("delivery", version).where(F.col("token") == token).select("message_id", "attempts")
        log = self.topic.read("log", version)
        return own.join(log.withColumnRenamed("id", "message_id"), "message_id") if log is not None else own

    def _held(self, base: int, token: str, which: DataFrame | None = None) -> DataFrame:
        rows = self.read("delivery", base).where((F.col("token") == token) & (F.col("status") == "inflight"))
        return rows if which is None else rows.join(which.select("message_id"), "message_id", "left_semi")

    def record(self, token: str, outcomes: DataFrame, as_of: datetime, base_seconds: int = 2, most_seconds: int = 300, release_keys: bool = False) -> None:
        """What became of claimed deliveries (message_id, kind, error; kinds as in ``commit``). If one of them isn't held by the token, none is recorded. ``release_keys``: free the key leases of the token in the same commit."""

        def change(base: int) -> tuple[dict[str, Any], None]:
            rows = self.read("delivery", base)
            taken = self._held(base, token).select("group_id", "message_id", "attempts").join(outcomes, "message_id")
            if taken.count() < outcomes.count():
                raise LeaseLost(token)
            kept, logged = delivery.retry_outcomes(taken, as_of, base_seconds, most_seconds)
            rest = rows.join(outcomes.select("message_id"), "message_id", "left_anti")
            tables = {"delivery": rest.unionByName(self._shaped("delivery", kept))}
            if release_keys:
                tables["key_lease"] = self.read("key_lease", base).where(F.col("token") != token)
            return {"replace": self._tables(**tables), "append": self._tables(delivery_log=logged if self.log_success else logged.where("status <> 'success'"))}, None

        self.topic.update(change)

    def renew_deliveries(self, token: str, until: datetime) -> None:
        def change(base: int) -> tuple[dict[str, Any], None]:
            if self._held(base, token).isEmpty():
                raise LeaseLost(token)
            own = (F.col("token") == token) & (F.col("status") == "inflight")
            rows = self.read("delivery", base).withColumn("lease_until", F.when(own, F.lit(until).cast("timestamp_ntz")).otherwise(F.col("lease_until")))
            return {"replace": self._tables(delivery=rows)}, None

        self.topic.update(change)

    def kill(self, as_of: datetime) -> None:
        """Deliveries in flight whose lease expired at the last attempt are dead; the log says ``killed``."""

        def change(base: int) -> tuple[dict[str, Any], None]:
            rows, clock = self.read("delivery", base), F.lit(as_of).cast("timestamp_ntz")
            dead = delivery.killed(rows, as_of, self.most_attempts)
            if dead.isEmpty():
                return {}, None
            gone = (F.col("status") == "inflight") & (F.col("lease_until") < clock) & (F.col("attempts") >= self.most_attempts)
            now = rows.select("*", gone.alias("gone")).withColumn("last_error", F.when(F.col("gone"), F.concat_ws("; ", "last_error", F.lit("lease expired at the last attempt"))).otherwise(F.col("last_error"))).withColumn("status", F.when(F.col("gone"), "dead").otherwise(F.col("status")))
            logged = dead.select("group_id", "message_id", F.col("attempts").alias("attempt"), F.lit("killed").alias("status"), F.lit(None).cast("string").alias("error"), clock.alias("at"))
            return {"replace": self._tables(delivery=now), "append": self._tables(delivery_log=logged)}, None

        self.topic.update(change)

    def pop(self, limit: int) -> DataFrame:
        """The first ready deliveries, taken out at once: at most once."""

        def change(base: int) -> tuple[dict[str, Any], list]:
            rows = self.read("delivery", base)
            popped = rows.where("status = 'ready'").orderBy("message_id").limit(limit).select("message_id").collect()
            ids = self.topic.spark.createDataFrame(popped, "message_id long")
            return ({"replace": self._tables(delivery=rows.join(ids, "message_id", "left_anti"))} if popped else {}), popped

        return self.topic.spark.createDataFrame(self.topic.update(change), "message_id long")

    # keys

    def claim_key(self, key: str, message_id: int, as_of: datetime, token: str, hold: timedelta = timedelta(seconds=30)) -> str:
        """acquired, busy or superseded: only the head of a key may hold it, and only one token. The same token may claim again."""

        def change(base: int) -> tuple[dict[str, Any], str]:
            head = self.topic.heads(base).where(F.col("compaction_key") == key).head()
            rows = self.read("key_lease", base)
            held = rows.where(F.col("compaction_key") == key).head()
            if head is None or head.head_id != message_id:
                return {}, "superseded"
            if held is not None and held.expires_at >= as_of and held.token != token:
                return {}, "busy"
            mine = self._frame("key_lease", [(self.group_id, key, token, as_of + hold)])
            return {"replace": self._tables(key_lease=rows.where(F.col("compaction_key") != key).unionByName(mine))}, "acquired"

        return self.topic.update(change)

    def release_key(self, key: str, token: str) -> None:
        """Free a key, if the token holds it."""

        def change(base: int) -> tuple[dict[str, Any], None]:
            rows = self.read("key_lease", base)
            own = (F.col("compaction_key") == key) & (F.col("token") == token)
            return ({"replace": self._tables(key_lease=rows.where(~own))} if not rows.where(own).isEmpty() else {}), None

        self.topic.update(change)

    def sweep_keys(self, as_of: datetime) -> None:
        """Drop key leases that have expired."""

        def change(base: int) -> tuple[dict[str, Any], None]:
            return {"replace": self._tables(key_lease=self.read("key_lease", base).where(F.col("expires_at") >= F.lit(as_of).cast("timestamp_ntz")))}, None

        self.topic.update(change)

    # the frontier

    def advance(self) -> int:
        """Move committed up to what no lease and no unresolved delivery holds back; it never falls."""

        def change(base: int) -> tuple[dict[str, Any], int]:
            claimed, committed = self.cursor(base)
            first = self.read("delivery", base).where(F.col("status").isin("ready", "inflight", "deferred")).agg(F.min("message_id")).head()[0]
            now = max(committed, min([claimed, *(r.low for r in self._leases(base)), *([first - 1] if first is not None else [])]))
            return ({"replace": self._tables(cursor=self._frame("cursor", [(claimed, now)]))} if now != committed else {}), now

        return self.topic.update(change)

    def fan_out(self, limit: int, as_of: datetime, gate: int | None = None) -> int:
        """Give the next ``limit`` messages above the mark (the cursor's claimed id) a ready delivery each, if they are routed here and their key's head. Gives the new mark."""

        def change(base: int) -> tuple[dict[str, Any], int]:
            mark, committed = self.cursor(base)
            upto = self.topic.head(base) if gate is None else gate
            if mark >= upto:
                return {}, mark
            batch = log_ops.read_range(self.topic.read("log", base), mark, upto, self.topic.partition_size).orderBy("id").limit(limit)
            routed = log_ops.compacted(batch.where(routing.any_of(F.col("routing_key"), self.patterns)), self.topic.heads(base)).withColumn("group_id", F.lit(self.group_id).cast("long"))
            fresh, new = delivery.fan_out(batch, routed, self.read("delivery", base), limit, upto)
            new = new.head().mark
            rows = fresh.select("group_id", "message_id", F.lit("ready").alias("status"), F.lit(0).alias("attempts"), F.lit(as_of).cast("timestamp_ntz").alias("can_run_after"))
            return {"replace": self._tables(cursor=self._frame("cursor", [(new, committed)])), "append": self._tables(delivery=rows)}, new

        return self.topic.update(change)
