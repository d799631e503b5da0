"""Reading the log: pruned ranges, heads, histories, latest per key, claims over ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def part_of(id_: Column, size: int) -> Column:
    """The number of the partition that holds an id: half-open [n * size, (n + 1) * size)."""
    return F.floor(id_ / size).cast("long")


def read_range(log: DataFrame, low: int, high: int, size: int | None = None) -> DataFrame:
    """Messages with ids in (low, high]. A log that is partitioned by ``part`` gets its bounds too, for only those prune directories."""
    out = log.where((F.col("id") > low) & (F.col("id") <= high))
    return out.where(F.col("part").between((low + 1) // size, high // size)) if size and "part" in log.columns else out


def heads(log: DataFrame) -> DataFrame:
    """compaction_key, head_id, head_rank: the message of each key with the greatest (rank, id).

    First the greatest id of each key and rank, then the greatest rank of each key: both are hash aggregations over longs,
    with partial sums before either shuffle; the maximum of a struct would sort the whole log.
    """
    return greatest(log.where("compaction_key IS NOT NULL").select("compaction_key", F.col("id").alias("head_id"), F.col("compaction_rank").alias("head_rank")))


def greatest(rows: DataFrame) -> DataFrame:
    """Of compaction_key, head_id and head_rank the greatest (rank, id) of each key."""
    each = rows.groupBy("compaction_key", "head_rank").agg(F.max("head_id").alias("head_id"))
    return each.groupBy("compaction_key").agg(F.max_by("head_id", "head_rank").alias("head_id"), F.max("head_rank").alias("head_rank"))


def compacted(rows: DataFrame, head_of: DataFrame) -> DataFrame:
    """Rows without a key, and those that are their key's head. Both are found by id, which is unique, so no key is a hot one."""
    kept = rows.where("compaction_key IS NOT NULL").join(head_of.select(F.col("head_id").alias("id")), "id", "left_semi")
    return rows.where("compaction_key IS NULL").unionByName(kept)


def key_history(log: DataFrame, key: str, limit: int) -> DataFrame:
    return log.where(F.col("compaction_key") == key).orderBy(F.desc("id")).limit(limit)


def upsert_heads(old: DataFrame, batch: DataFrame) -> DataFrame:
    """Old heads and the batch's messages, reduced to the greatest (rank, id) of each key."""
    return greatest(old.unionByName(batch.where("compaction_key IS NOT NULL").select("compaction_key", F.col("id").alias("head_id"), F.col("compaction_rank").alias("head_rank"))))


def assign_ids(attempts: DataFrame, known: DataFrame, head: int) -> DataFrame:
    """seq and id of the attempts (seq, idempotency_key) that are appended: the first of each key that isn't known; ids follow ``head`` in the order of seq without gaps.

    Ids come from counts per block of seq and ranks within blocks, so no task ranks the whole batch; the counts, a row
    per block of 4,096, are joined as one small table.
    """
    first = attempts.groupBy("idempotency_key").agg(F.min("seq").alias("seq")).join(known, "idempotency_key", "left_anti").select("seq", F.floor(F.col("seq") / 4096).alias("block"))
    sizes = first.groupBy("block").agg(F.count("*").alias("n"))
    base = sizes.select("block", (F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("base"))
    return first.withColumn("r", F.row_number().over(Window.partitionBy("block").orderBy("seq"))).join(base, "block").select("seq", (F.col("r") + F.col("base") + head).cast("long").alias("id"))


def append(attempts: DataFrame, known: DataFrame, head: int) -> DataFrame:
    """Attempts (seq, idempotency_key, payload) with the id each gets (``assign_ids``); others are duplicates with id 0."""
    ids = assign_ids(attempts, known, head)
    return attempts.join(ids, "seq", "left").select("seq", "idempotency_key", "payload", F.coalesce("id", F.lit(0)).cast("long").alias("id"), F.col("id").isNull().alias("duplicate"))


def tombstones(log: DataFrame, floor: int, is_tombstone: Column) -> DataFrame:
    """id of the messages up to ``floor`` that are their key's last up to it, and tombstones."""
    below = log.where((F.col("id") <= floor) & F.col("compaction_key").isNotNull())
    last = below.groupBy("compaction_key").agg(F.max("id").alias("id")).select("id")
    return below.where(is_tombstone).select("id").join(last, "id", "left_semi")


def superseded(log: DataFrame, floor: int) -> DataFrame:
    """Keyed messages up to ``floor`` that a later one up to it replaces."""
    below = log.where((F.col("id") <= floor) & F.col("compaction_key").isNotNull())
    last = below.groupBy("compaction_key").agg(F.max("id").alias("id")).select("id")
    return below.join(last, "id", "left_anti")


def series_key(name: Column, attributes: Column) -> Column:
    """name|k=v,... with attributes sorted by name; the name alone without any."""
    pairs = F.transform(F.array_sort(F.map_entries(attributes)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.when(F.size(attributes) > 0, F.concat(name, F.lit("|"), F.array_join(pairs, ","))).otherwise(name)
