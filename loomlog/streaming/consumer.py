"""The log as a stream: routing and compaction on micro-batches, a handler with outcomes, dedup, and one message in flight per key."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.types import StructType

from loomlog.functions import routing


def source(spark: SparkSession, path: str, schema: StructType, files: int = 16) -> DataFrame:
    """New files below ``path`` as a stream; the checkpoint's offsets are the cursor. created_at becomes a timestamp, which watermarks need."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true").parquet(path)
    return rows.withColumn("created_at", F.col("created_at").cast("timestamp"))


def deduplicated(stream: DataFrame, ttl: str = "1 hour") -> DataFrame:
    """The first message of each idempotency key within ``ttl``, by event time."""
    return stream.withWatermark("created_at", ttl).dropDuplicatesWithinWatermark(["idempotency_key"])


def consume(stream: DataFrame, patterns: list[str], handler: Callable[[pd.DataFrame], pd.Series], sink: str, checkpoint: str, group_id: int) -> StreamingQuery:
    """Give each micro-batch's routed messages to ``handler`` (a frame in, a series of error texts or None out) and write an outcome per message.

    At least once: a batch that is tried again overwrites its own directory, so the outcomes hold each message once.
    """

    def handle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            errors = handler(rows)
            yield pd.DataFrame({"group_id": group_id, "message_id": rows["id"], "status": ["success" if e is None else "failure" for e in errors], "error": list(errors)})

    def each(batch: DataFrame, batch_id: int) -> None:
        mine = batch.where(routing.any_of(F.col("routing_key"), patterns))
        mine.mapInPandas(handle, "group_id long, message_id long, status string, error string").write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class KeyGate(StatefulProcessor):
    """Per key, the message with the greatest (rank, id) so far; emits a message when it becomes its key's head."""

    def init(self, handle: Any) -> None:
        self.best = handle.getValueState("best", "compaction_rank long, id long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        best = tuple(self.best.get()) if self.best.exists() else None
        out = []
        for frame in rows:
            for r in frame.sort_values(["compaction_rank", "id"]).itertuples():
                now = (int(r.compaction_rank), int(r.id))
                if best is None or now > best:
                    best = now
                    out = [(key[0], now[1], now[0])]
        if out:
            self.best.update(best)
        yield pd.DataFrame(out, columns=["compaction_key", "head_id", "head_rank"])

    def close(self) -> None:
        pass


def heads(stream: DataFrame) -> DataFrame:
    """A stream of new heads (update mode; needs the RocksDB state store)."""
    keyed = stream.where("compaction_key IS NOT NULL").select("compaction_key", "compaction_rank", "id")
    return keyed.groupBy("compaction_key").transformWithStateInPandas(statefulProcessor=KeyGate(), outputStructType="compaction_key string, head_id long, head_rank long", outputMode="Update", timeMode="None")


def windowed(stream: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Messages per window and routing key, with a watermark for late ones."""
    return stream.withWatermark("created_at", late).groupBy(F.window("created_at", width), "routing_key").agg(F.count("*").alias("n"))
