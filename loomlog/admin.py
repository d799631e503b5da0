"""A facade over the topics below one directory: registering, listing, producing, reading and their health."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from loomlog.errors import Conflict, Mismatch, NameTaken, NotEmpty, NotFound
from loomlog.functions import cron, routing
from loomlog.operators import control
from loomlog.operators import log as log_ops
from loomlog.sources.group import Group
from loomlog.sources.store import Topic
from loomlog.sources.workers import Workers


class Admin:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._catalog = Topic(spark, f"{self.root}/_catalog")
        self.workers = Workers(self._catalog)

    def _rows(self, table: str, schema: str, base: int | None = None) -> DataFrame:
        found = self._catalog.read(table, base)
        return found if found is not None else self.spark.createDataFrame([], schema)

    TOPIC = "name string, version long, partition_size long, path string"

    def list_topics(self) -> DataFrame:
        return self._rows("topic", self.TOPIC)

    def register_topic(self, name: str, version: int = 1, partition_size: int = 10_000) -> Topic:
        """Registering again is the same topic; its partition size can't change."""

        def change(base: int) -> tuple[dict[str, Any], None]:
            known = {(r.name, r.version): r.partition_size for r in self._rows("topic", self.TOPIC, base).collect()}
            if (name, version) not in known:
                new = self.spark.createDataFrame([(name, version, partition_size, f"{self.root}/{name}/{version}-{uuid.uuid4().hex}")], self.TOPIC)
                return {"append": {"topic": new}}, None
            if known[name, version] != partition_size:
                raise Mismatch("the partition size of a topic can't change")
            return {}, None

        self._catalog.update(change)
        return self.topic(name, version)

    def topic(self, name: str, version: int = 1, base: int | None = None) -> Topic:
        found = self._rows("topic", self.TOPIC, base).where((F.col("name") == name) & (F.col("version") == version)).head()
        if found is None:
            raise NotFound(f"{name} version {version}")
        return Topic(self.spark, found.path, found.partition_size)

    def destroy_topic(self, name: str, version: int = 1, force: bool = True) -> None:
        """Take the topic and its groups out of the catalog, then delete its data; without ``force`` only if it holds no messages."""
        own = (F.col("name") == name) & (F.col("version") == version)
        groups = (F.col("topic") == name) & (F.col("version") == version)

        def change(base: int) -> tuple[dict[str, Any], Topic]:
            topic = self.topic(name, version, base)
            if not force and topic.read("log") is not None and not topic.read("log").isEmpty():
                raise NotEmpty(name)
            rest = {"topic": self._rows("topic", self.TOPIC, base).where(~own), "group": self._rows("group", self.GROUP, base).where(~groups)}
            return {"replace": {k: v.coalesce(1) for k, v in rest.items()}}, topic

        self._catalog.update(change).destroy()

    def rename_topic(self, name: str, new: str) -> None:
        """All versions of a topic, and their groups, get another name; their data stays where it is, since paths go by the name of registration."""

        def change(base: int) -> tuple[dict[str, Any], None]:
            rows, groups = self._rows("topic", self.TOPIC, base), self._rows("group", self.GROUP, base)
            if rows.where(F.col("name") == new).head() is not None:
                raise NameTaken(f"there is a topic {new}")
            if rows.where(F.col("name") == name).head() is None:
                raise NotFound(name)
            renamed = {"topic": rows.withColumn("name", F.when(F.col("name") == name, new).otherwise(F.col("name"))), "group": groups.withColumn("topic", F.when(F.col("topic") == name, new).otherwise(F.col("topic")))}
            return {"replace": {k: v.coalesce(1) for k, v in renamed.items()}}, None

        self._catalog.update(change)

    def _change(self, table: str, schema: str, key: str, value: str, make: Callable[[Row | None], tuple | None]) -> None:
        """Replace the row with this key by what ``make`` makes of it (None where there is none), or by none."""

        def change(base: int) -> tuple[dict[str, Any], None]:
            rows = self._rows(table, schema, base)
            row = make(rows.where(F.col(key) == value).head())
            rest = rows.where(F.col(key) != value)
            return {"replace": {table: (rest if row is None else rest.unionByName(self.spark.createDataFrame([row], schema))).coalesce(1)}}, None

        self._catalog.update(change)

    # consumer groups

    GROUP = "topic string, version long, name string, group_id long"

    def list_groups(self, topic: str, version: int = 1) -> DataFrame:
        return self._rows("group", self.GROUP).where((F.col("topic") == topic) & (F.col("version") == version))

    def register_group(self, topic: str, version: int, name: str) -> int:
        """The group's id; registering again gives the same."""

        def change(base: int) -> tuple[dict[str, Any], int]:
            self.topic(topic, version, base)
            rows = self._rows("group", self.GROUP, base)
            found = rows.where((F.col("topic") == topic) & (F.col("version") == version) & (F.col("name") == name)).head()
            if found is not None:
                return {}, found.group_id
            group_id = max(int((rows.agg(F.max("group_id")).head()[0]) or 0), int(self._catalog.tables(base).get("#head", ["0"])[0])) + 1
            return {"append": {"group": self.spark.createDataFrame([(topic, version, name, group_id)], self.GROUP)}, "head": group_id}, group_id

        return self._catalog.update(change)

    def group(self, topic: str, version: int, name: str) -> Group:
        """A registered group with its bindings."""
        found = self.list_groups(topic, version).where(F.col("name") == name).head()
        if found is None:
            raise NotFound(f"group {name}")
        log = self.topic(topic, version)
        bound = log.read("binding")
        return Group(log, found.group_id, sorted(r.pattern for r in bound.where(F.col("group_id") == found.group_id).collect()) if bound is not None else [])

    def destroy_group(self, topic: str, version: int, name: str) -> None:
        """Take the group out of the catalog, and its bindings and state out of the topic."""
        own = (F.col("topic") == topic) & (F.col("version") == version) & (F.col("name") == name)

        def leave(base: int) -> tuple[dict[str, Any], int]:
            rows = self._rows("group", self.GROUP, base)
            found = rows.where(own).head()
            if found is None:
                raise NotFound(f"group {name}")
            return {"replace": {"group": rows.where(~own).coalesce(1)}}, found.group_id

        group_id, log = self._catalog.update(leave), self.topic(topic, version)

        def forget(base: int) -> tuple[dict[str, Any], None]:
            bound, state = log.read("binding", base), [k for k in log.tables(base) if k.startswith(f"group-{group_id}-")]
            made = {"replace": {"binding": bound.where(F.col("group_id") != group_id)}} if bound is not None else {}
            return (made | {"drop": {k: [] for k in state}} if made or state else {}), None

        log.update(forget)

    # scheduled jobs

    CRON = "name string, schedule string, data string, suspended boolean, next_at timestamp_ntz, last_at timestamp_ntz"

    def list_cron_jobs(self) -> DataFrame:
        return self._rows("cron_job", self.CRON)

    def get_cron_job(self, name: str) -> Row:
        found = self.list_cron_jobs().where(F.col("name") == name).head()
        if found is None:
            raise NotFound(f"job {name}")
        return found

    def register_cron_job(self, name: str, schedule: str, as_of: datetime, data: str = "{}") -> None:
        """A new job, or a known one with another schedule or data; it is due at the schedule's next time."""
        self._change("cron_job", self.CRON, "name", name, lambda _: (name, schedule, data, False, cron.next_time(schedule, as_of), None))

    def _known(self, name: str, job: Row | None) -> Row:
        if job is None:
            raise NotFound(f"job {name}")
        return job

    def suspend_cron_job(self, name: str) -> None:
        self._change("cron_job", self.CRON, "name", name, lambda j: (*self._known(name, j)[:3], True, *j[4:]))

    def unsuspend_cron_job(self, name: str, as_of: datetime) -> None:
        """The times that passed meanwhile are left out."""
        self._change("cron_job", self.CRON, "name", name, lambda j: (*self._known(name, j)[:3], False, cron.next_time(j.schedule, as_of), j.last_at))

    def destroy_cron_job(self, name: str) -> None:
        self._change("cron_job", self.CRON, "name", name, lambda j: self._known(name, j) and None)

    REQUEST = "seq long, idempotency_key string, routing_key string, compaction_key string, compaction_rank long, payload string, created_at timestamp_ntz"

    def _request(self, requests: Topic, jobs: list[tuple[Row, datetime, str]], as_of: datetime) -> None:
        rows = [(k, f"{j.name}@{run}", j.name, j.name, 0, json.dumps({"cron_job": j.name, "scheduled_time": at.isoformat(), "data": j.data}), as_of) for k, (j, at, run) in enumerate(jobs)]
        while rows:
            try:
                requests.produce(self.spark.createDataFrame(rows, self.REQUEST))
                return
            except Conflict:
                continue

    def tick(self, requests: Topic, as_of: datetime) -> list[str]:
        """Give each due job one request in ``requests``, for the newest of its times that passed, and then move it on; a job without a further time is suspended. The idempotency key is made of job and time, so a tick that is done again, after a failure between the two, adds nothing and loses nothing."""
        due = self.list_cron_jobs().where((F.col("next_at") <= F.lit(as_of).cast("timestamp_ntz")) & ~F.col("suspended")).orderBy("next_at", "name").collect()
        jobs, moved = [], {}
        for j in due:
            at = j.next_at
            while (later := cron.next_time(j.schedule, at)) is not None and later <= as_of:
                at = later
            jobs.append((j, at, at.isoformat()))
            moved[j.name] = (at, later)
        self._request(requests, jobs, as_of)
        for j in due:
            at, later = moved[j.name]
            self._change("cron_job", self.CRON, "name", j.name, lambda now, j=j, at=at, later=later: (*now[:3], later is None, later, at) if now is not None and now.next_at == j.next_at else now and tuple(now))
        return [j.name for j in due]

    def run_cron_job(self, requests: Topic, name: str, as_of: datetime) -> None:
        """A request at once, beside the schedule; one for a job and moment."""
        self._request(requests, [(self.get_cron_job(name), as_of, f"now-{as_of.isoformat()}")], as_of)

    def list_cron_requests(self, requests: Topic, name: str, limit: int) -> DataFrame:
        """The newest requests of a job."""
        return log_ops.key_history(requests.read("log"), name, limit)

    # read models over topics of measurements and alerts

    def list_measurements(self, topic: Topic) -> DataFrame:
        """The newest message of each series."""
        return topic.heads().join(topic.read("log").select(F.col("id").alias("head_id"), "payload", "created_at"), "head_id").select("compaction_key", "payload", "created_at")

    def list_measurement_messages(self, topic: Topic, series: str, limit: int) -> DataFrame:
        return log_ops.key_history(topic.read("log"), series, limit)

    def list_alerts(self, topic: Topic) -> DataFrame:
        """The newest state of each alert."""
        return self.list_measurements(topic)

    def family_health(self, name: str, cursors: DataFrame, leases: DataFrame, deliveries: DataFrame) -> list[tuple[int, str]]:
        """(version, verdict) of each version of a topic, over its groups' state."""
        out = []
        for r in self.list_topics().where(F.col("name") == name).orderBy("version").collect():
            topic = self.topic(name, r.version)
            verdict = control.retire_verdict(control.snapshot(cursors, leases, deliveries, topic.head()), not topic.heads().isEmpty())
            out.append((r.version, verdict.head().verdict))
        return out

    def declare_bindings(self, name: str, version: int, group_id: int, patterns: list[str], live_instances: bool = False) -> str:
        """Declare a group's bindings, patterns with ``*``: installed where none are known or no instance of another declaration lives, joined if they are the same, else waiting. Gives what became of it."""
        topic, wanted = self.topic(name, version), sorted(set(patterns))

        def change(base: int) -> tuple[dict[str, Any], str]:
            old = topic.read("binding", base)
            known = sorted(r.display for r in old.where(F.col("group_id") == group_id).collect()) if old is not None else []
            if known == wanted:
                return {}, "join"
            if known and live_instances:
                return {}, "wait"
            new = self.spark.createDataFrame([(group_id, routing.wildcard(p), p) for p in wanted], "group_id long, pattern string, display string")
            return {"replace": {"binding": old.where(F.col("group_id") != group_id).unionByName(new) if old is not None else new}}, "install"

        return topic.update(change)

    def read(self, name: str, version: int, group_id: int, low: int, high: int) -> DataFrame:
        """What a group receives of the ids in (low, high]."""
        topic = self.topic(name, version)
        bound = topic.read("binding")
        patterns = [r.pattern for r in bound.where(F.col("group_id") == group_id).collect()] if bound is not None else []
        rows = topic.read_range(low, high)
        rows = rows.where(routing.any_of(F.col("routing_key"), patterns))
        return log_ops.compacted(rows, topic.heads())

    def topic_metrics(self, name: str, version: int, cursors: DataFrame, leases: DataFrame, deliveries: DataFrame) -> DataFrame:
        return control.snapshot(cursors, leases, deliveries, self.topic(name, version).head())
