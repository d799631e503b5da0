"""A topic on disk: an append-only log partitioned by id range, and state tables as versioned snapshots.

Every table version is a directory that is never changed. A pointer file names the current version of every table of the
topic, and renaming a new pointer into place is one transaction over all of them. A writer names the pointer it started
from; if another commit came first, ``Conflict`` is raised and nothing changes. There is no lock: the pointer's number is
part of its name, and on file systems whose rename refuses a name that exists (HDFS and its like), one of two writers
fails. Object stores don't refuse; there, a topic must have one writer at a time.
"""

from __future__ import annotations

import functools
import json
import uuid
from collections.abc import Callable
from datetime import datetime, timedelta
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.errors import BadRecords, Conflict
from loomlog.operators import log as log_ops


class Topic:
    #: Batches whose heads are appended before they are merged.
    MOST_HEADS = 16

    def __init__(self, spark: SparkSession, path: str, partition_size: int = 10_000, key_ttl: timedelta | None = None):
        """``key_ttl``: how long before a batch's first message idempotency keys are known; None: for ever."""
        self.spark, self.path, self.partition_size, self.key_ttl = spark, path.rstrip("/"), partition_size, key_ttl
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.path}/_commits"))

    def version(self) -> int:
        """The number of the last commit; 0 before the first."""
        names = [x.getPath().getName() for x in self._fs.listStatus(self._path(f"{self.path}/_commits"))]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def tables(self, version: int | None = None) -> dict[str, list[str]]:
        """The directories of each table as of a commit (and, under ``#head``, the highest id)."""
        version = self.version() if version is None else version
        if not version:
            return {}
        stream = self._fs.open(self._path(f"{self.path}/_commits/{version:020d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def read(self, table: str, version: int | None = None) -> DataFrame | None:
        paths = self.tables(version).get(table)
        return self.spark.read.option("basePath", f"{self.path}/{table}").parquet(*[f"{self.path}/{p}" for p in paths]).drop("v") if paths else None

    def commit(self, base: int, replace: dict[str, DataFrame] | None = None, append: dict[str, DataFrame] | None = None, drop: dict[str, list[str]] | None = None, head: int | None = None) -> int:
        """Write new versions of tables and publish them all at once on top of commit ``base``. ``drop``: tables that keep these directories only."""
        new = {k: list(v) for k, v in self.tables(base).items()} | {k: list(v) for k, v in (drop or {}).items()}
        for table, df in (replace or {}).items():
            new[table] = [self._write(table, df)]
        for table, df in (append or {}).items():
            new.setdefault(table, []).append(self._write(table, df))
        if head is not None:
            new["#head"] = [str(head)]
        return self._publish(base, new)

    def update(self, change: Callable[[int], tuple[dict[str, Any], Any]], tries: int = 20) -> Any:
        """Commit what ``change`` makes of a version (arguments of ``commit``, and a result); where another writer was faster, from its version anew. Nothing to commit: no arguments."""
        for _ in range(tries):
            base = self.version()
            made, result = change(base)
            if not made:
                return result
            try:
                self.commit(base, **made)
                return result
            except Conflict:
                continue
        raise Conflict(f"{tries} tries")

    def _write(self, table: str, df: DataFrame) -> str:
        name = f"{table}/v={uuid.uuid4().hex}"
        writer = df.write
        if table == "log":
            writer = df.withColumn("part", log_ops.part_of(F.col("id"), self.partition_size)).sortWithinPartitions("part", "id").write.partitionBy("part")
        writer.parquet(f"{self.path}/{name}")
        return name

    def _publish(self, base: int, tables: dict[str, list[str]]) -> int:
        final = self._path(f"{self.path}/_commits/{base + 1:020d}.json")
        draft = self._path(f"{self.path}/_commits/{uuid.uuid4().hex}.draft")
        stream = self._fs.create(draft, False)
        stream.write(bytearray(json.dumps(tables).encode()))
        stream.close()
        try:
            taken = self._fs.exists(final) or not self._fs.rename(draft, final)
        finally:
            if self._fs.exists(draft):
                self._fs.delete(draft, False)
        if taken:
            raise Conflict(f"commit {base + 1} is taken")
        return base + 1

    def head(self, version: int | None = None) -> int:
        """The highest id that a commit's log has had."""
        return int(self.tables(version).get("#head", ["0"])[0])

    def heads(self, version: int | None = None) -> DataFrame:
        """compaction_key, head_id, head_rank. Each commit appends those of its batch alone; reading takes the greatest."""
        found = self.read("heads", version)
        return log_ops.greatest(found) if found is not None else self.spark.createDataFrame([], "compaction_key string, head_id long, head_rank long")

    def bad_records(self, attempts: DataFrame) -> DataFrame:
        """seq and reason of records that can't be appended: without a number, an idempotency key or a time, or with a number that another has, too."""
        twice = attempts.groupBy("seq").agg(F.count("*").alias("n")).where("n > 1 AND seq IS NOT NULL").select("seq", F.lit("seq is not unique").alias("reason"))
        reason = F.when(F.col("seq").isNull(), "no seq").when(F.nullif("idempotency_key", F.lit("")).isNull(), "no idempotency key").when(F.col("created_at").isNull(), "no created_at")
        return attempts.select("seq", reason.alias("reason")).where("reason IS NOT NULL").unionByName(twice)

    def produce_checked(self, attempts: DataFrame, on_bad: str = "fail") -> list[tuple[int | None, str]]:
        """``produce``, all or none: bad records fail the batch (the first one's seq is in the error), or are left out and given back with ``on_bad="evict"``."""
        bad = [tuple(r) for r in self.bad_records(attempts).orderBy("seq").limit(1 if on_bad == "fail" else 100_000).collect()]
        if bad and on_bad == "fail":
            raise BadRecords(*bad[0])
        good = attempts.join(self.bad_records(attempts).where("seq IS NOT NULL").select("seq").distinct(), "seq", "left_anti").where("seq IS NOT NULL") if bad else attempts
        self.produce(good)
        return bad

    def produce_many(self, batches: list[DataFrame]) -> int:
        """Append several producers' batches in one commit, in their order."""
        rows = [b.withColumn("seq", F.col("seq") + F.lit(k << 40)) for k, b in enumerate(batches)]
        return self.produce(functools.reduce(DataFrame.unionByName, rows))

    def produce(self, attempts: DataFrame) -> int:
        """Append messages (seq, idempotency_key, routing_key, compaction_key, compaction_rank, payload, created_at), keep their idempotency keys and heads: one commit. Duplicates are left out; empty keys count as null.

        Only ids that are free are given, so a writer who was overtaken gets ``Conflict``. The fresh messages are
        written once, and log, keys and heads are made from what was written, so they agree whatever ``attempts`` is.
        """
        return self.produce_with(attempts)

    def produce_with(self, attempts: DataFrame, replace: dict[str, DataFrame] | None = None, append: dict[str, DataFrame] | None = None, base: int | None = None) -> int:
        """``produce``, and changes of the caller's own tables in the same commit."""
        base = self.version() if base is None else base
        known = self.read("idempotency", base)
        keys = known if known is not None else self.spark.createDataFrame([], "idempotency_key string, created_at timestamp_ntz")
        if self.key_ttl is not None:  # older keys are forgotten
            since = attempts.agg(F.min("created_at")).head()[0]
            keys = keys.where(F.col("created_at") >= F.lit(since).cast("timestamp_ntz") - F.expr(f"INTERVAL '{int(self.key_ttl.total_seconds())}' SECOND")) if since is not None else keys
        ids = log_ops.assign_ids(attempts.select("seq", "idempotency_key"), keys.select("idempotency_key"), self.head(base))
        fresh = attempts.join(ids, "seq").select("id", F.nullif("routing_key", F.lit("")).alias("routing_key"), F.nullif("compaction_key", F.lit("")).alias("compaction_key"), "compaction_rank", "payload", "created_at", "idempotency_key")
        stage = f"{self.path}/_stage/{uuid.uuid4().hex}"
        try:
            fresh.write.parquet(stage)
            rows = self.spark.read.schema(fresh.schema).parquet(stage)
            last = rows.agg(F.max("id")).head()[0]
            messages = rows.drop("idempotency_key")
            own = log_ops.heads(messages)
            old = self.tables(base).get("heads", [])
            merge = len(old) >= self.MOST_HEADS
            heads = {"heads": log_ops.greatest(self.read("heads", base).unionByName(own)) if merge else own}
            changes = {"log": messages, "idempotency": rows.select("idempotency_key", "created_at")} if last is not None else {}
            heads = heads if last is not None else {}
            return self.commit(base, replace=(replace or {}) | (heads if merge else {}), append=(append or {}) | changes | ({} if merge else heads), head=max(last or 0, self.head(base)))
        finally:
            self._fs.delete(self._path(stage), True)

    def drop_parts(self, parts: list[int], base: int | None = None) -> int:
        """Take partitions out of the log (of which no message is kept), then delete their directories."""
        base, gone = self.version() if base is None else base, {f"part={p}" for p in parts}
        kept, dropped = [], []
        for path in self.tables(base).get("log", []):
            if path.rpartition("/")[2].startswith("part="):
                own = [path]
            else:
                own = [f"{path}/{x.getPath().getName()}" for x in self._fs.listStatus(self._path(f"{self.path}/{path}")) if x.isDirectory()]
            kept += [x for x in own if x.rpartition("/")[2] not in gone]
            dropped += [x for x in own if x.rpartition("/")[2] in gone]
        done = self.commit(base, drop={"log": kept})
        for x in dropped:
            self._fs.delete(self._path(f"{self.path}/{x}"), True)
        return done

    def compact(self, floor: int, referenced: DataFrame | None = None, is_tombstone: Column | None = None) -> int:
        """Rewrite the log without the keyed messages up to ``floor`` that a later one up to it replaces, and without keys whose last one up to it is a tombstone (by default: of null payload). Messages in ``referenced`` (message_id) stay."""

        def change(base: int) -> tuple[dict[str, Any], int]:
            log = self.read("log", base)
            if log is None:
                return {}, base
            gone = log_ops.superseded(log, floor).select("id").unionByName(log_ops.tombstones(log, floor, F.col("payload").isNull() if is_tombstone is None else is_tombstone))
            if referenced is not None:
                gone = gone.join(referenced.select(F.col("message_id").alias("id")), "id", "left_anti")
            return {"replace": {"log": log.drop("part").join(gone, "id", "left_anti")}}, base + 1

        return self.update(change)

    def sweep(self, before: datetime, floor: int | None = None) -> int:
        """Rewrite the log without messages older than ``before`` (up to ``floor``, if given), and the heads without theirs."""

        def change(base: int) -> tuple[dict[str, Any], int]:
            log = self.read("log", base)
            if log is None:
                return {}, base
            old = F.col("created_at") < F.lit(before).cast("timestamp_ntz")
            old = old & (F.col("id") <= floor) if floor is not None else old
            kept = log.drop("part").where(~F.coalesce(old, F.lit(False)))
            heads = self.heads(base).join(kept.select(F.col("id").alias("head_id")), "head_id", "left_semi").select("compaction_key", "head_id", "head_rank")
            return {"replace": {"log": kept, "heads": heads}}, base + 1

        return self.update(change)

    def sweep_keys(self, before: datetime) -> int:
        """Forget idempotency keys older than ``before``."""

        def change(base: int) -> tuple[dict[str, Any], int]:
            known = self.read("idempotency", base)
            return ({"replace": {"idempotency": known.where(F.col("created_at") >= F.lit(before).cast("timestamp_ntz"))}} if known is not None else {}), base + 1

        return self.update(change)

    def vacuum(self) -> int:
        """Delete directories that the last commit doesn't name; readers of earlier commits and writers that haven't committed lose theirs. Gives their number."""
        now, gone = {p.split("/part=")[0] for k, v in self.tables().items() if k != "#head" for p in v}, 0
        for table in self._fs.listStatus(self._path(self.path)):
            name = table.getPath().getName()
            if table.isDirectory() and name not in ("_commits", "_stage"):
                for x in self._fs.listStatus(table.getPath()):
                    if f"{name}/{x.getPath().getName()}" not in now:
                        gone += bool(self._fs.delete(x.getPath(), True))
        return gone

    def destroy(self) -> None:
        """Delete everything below the topic's path."""
        self._fs.delete(self._path(self.path), True)

    def read_range(self, low: int, high: int) -> DataFrame:
        """Messages in (low, high]; only the directories of their partitions are opened."""
        return log_ops.read_range(self.read("log"), low, high, self.partition_size)
