"""Operator 5: token counts of the documents in flat token files that have no index.

A flat file is nothing but ids, two or four bytes each, little-endian; an end-of-document id closes each document. The
scan looks for that id block by block with vectorised comparisons. A block's first document may have begun in an
earlier block: the tokens that each block leaves open are carried over by a prefix scan, within a file over its
blocks and, where a document may cross files, over the files' summaries.

``write_flat`` makes such files from documents: each task writes its rows' ids to one file and their doc_ids
(a byte that is 0 for null, then eight bytes) to a file of the same number, so no shuffle moves any text. Documents
are handed to the writer in chunks of CHUNK bytes, and a file takes CHUNKS of them, so files are cut by bytes. Only a
document is never cut: a file of very long ones holds CHUNKS of them at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import new_path, partitions_of, settle, small_batches
from .tokens import encoder, slices

#: Ids looked at together.
BLOCK = 1 << 20
#: Bytes of ids in a chunk (or one document), and chunks in a file; a task reads a file as a whole.
CHUNK, CHUNKS = 1 << 20, 128


def scan_block(ids: np.ndarray, end_id: int) -> tuple[np.ndarray, int]:
    """Tokens from each separator's predecessor up to it (the first counted from the block's start), and the tokens left open behind the last."""
    ends = np.flatnonzero(ids == end_id)
    return np.diff(ends, prepend=-1), len(ids) - (int(ends[-1]) + 1 if len(ends) else 0)


def scan(ids: np.ndarray, end_id: int, block: int = BLOCK) -> tuple[np.ndarray, int]:
    """Token counts, end ids included, of the documents that end in ``ids``, and the tokens left open behind the last.

    Blocks are scanned on their own. The carry into block i is the open tokens of the blocks since the last one with
    a separator, itself included: a difference of prefix sums.
    """
    found = [scan_block(ids[lo : lo + block], end_id) for lo in range(0, len(ids), block)]
    if not found:
        return np.zeros(0, np.int64), 0
    open_ = np.array([x for _, x in found], np.int64)
    has = np.array([len(x) > 0 for x, _ in found])
    sums = np.concatenate([[0], np.cumsum(open_)])
    last = np.maximum.accumulate(np.where(has, np.arange(len(found)), 0))  # the last block with a separator, else the first
    carry = sums[1:] - sums[last]  # open tokens behind block i
    for i in np.flatnonzero(has):
        found[i][0][0] += carry[i - 1] if i else 0
    return np.concatenate([x for x, _ in found]).astype(np.int64), int(carry[-1])


def write_flat(docs: DataFrame, path: str, tokenizer: str, end_id: int, width: int = 2, chunk: int = CHUNK, chunks: int = CHUNKS) -> None:
    """Write the ids of ``docs`` (doc_id, text; other columns are left out) to ``path``/kind=ids and, in the same order, the doc_ids to ``path``/kind=docs.

    The separator stands behind each document's ids; Spark's text writer puts the last one of a chunk there. A null or
    empty text is a separator alone, and a separator's string in a text is ordinary text. A null doc_id is kept; an empty table leaves empty folders.
    """
    spark = docs.sparkSession
    small_batches(spark)
    end = int(end_id).to_bytes(width, "little")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, keys, held = [], [], 0

        def rows() -> pa.RecordBatch:
            return pa.record_batch({"kind": ["ids", "docs"], "value": pa.array([end.join(ids), end.join(keys)], pa.binary())})

        for batch, texts in slices(batches, encoding=True):
            for key, own in zip(batch.column(0).to_pylist(), encoder(tokenizer, width, literal=True).encode(texts), strict=True):
                if ids and held + len(own) > chunk:
                    yield rows()
                    ids, keys, held = [], [], 0
                ids.append(own)
                keys.append(bytes(9) if key is None else b"\x01" + key.to_bytes(8, "little", signed=True))
                held += len(own) + width
        if ids:
            yield rows()

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = settle(docs.mapInArrow(encode, "kind string, value binary"), partitions_of(docs))
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    spark.conf.set("spark.sql.maxConcurrentOutputFileWriters", "2")  # both files are open at once: rows keep their order and needn't be sorted
    try:
        rows.select("kind", F.col("value").cast("string").alias("value")).write.partitionBy("kind").option("encoding", "ISO-8859-1").option("lineSep", end.decode("latin-1")).option("maxRecordsPerFile", chunks).text(path)
    finally:
        spark.conf.set("spark.sql.maxConcurrentOutputFileWriters", before)
    for kind in ("ids", "docs"):  # an empty table makes no files
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/kind={kind}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"part-.*", 0).alias("file"), "content")


def count_tokens(spark: SparkSession, path: str, end_id: int, width: int = 2, block: int = BLOCK, across: bool = False) -> DataFrame:
    """file, ordinal (from 0, in the file) and n_tokens (long, with the end id) of every document in the flat files below ``path``.

    ``across``: the files, by name, are parts of one stream, so a document may begin in one and end in another; it
    counts where it ends. Tokens behind the last separator of all are a last document without an end. Without
    ``across`` this holds for each file. No files or empty files give no rows.
    """
    files = _read(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not content.is_valid:
                    continue
                counts, rest = scan(np.frombuffer(content.as_buffer(), f"<u{width}"), end_id, block)
                if rest:
                    counts = np.append(counts, rest)
                n = len(counts)
                yield pa.record_batch({"file": pa.array([file] * n), "ordinal": pa.array(np.arange(n)), "n_tokens": pa.array(counts), "ended": pa.array(np.arange(n) < n - bool(rest))})

    found = files.mapInArrow(run, "file string, ordinal long, n_tokens long, ended boolean")
    if not across:
        return found.drop("ended")
    # one row per file: what it leaves open, and the open tokens since the last file in which a document ended
    each = found.groupBy("file").agg(F.sum(F.when(~F.col("ended"), F.col("n_tokens")).otherwise(0)).alias("open"), F.max(F.col("ended").cast("int")).alias("has"))
    order = Window.orderBy("file")
    each = each.withColumn("group", F.sum("has").over(order))
    each = each.withColumn("carried", F.sum("open").over(Window.partitionBy("group").orderBy("file")))
    each = each.withColumn("carry", F.coalesce(F.lag("carried").over(order), F.lit(0))).withColumn("is_last", F.lead("file").over(order).isNull())
    rows = found.join(each.select("file", "has", "carry", "is_last"), "file")
    added = rows.withColumn("n_tokens", F.col("n_tokens") + F.when(F.col("ordinal") == 0, F.col("carry")).otherwise(0))
    return added.where(F.col("ended") | F.col("is_last")).select("file", "ordinal", "n_tokens")


def doc_ids(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """file, ordinal and doc_id of the documents that ``write_flat`` wrote."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys = np.frombuffer(content, np.dtype([("has", "u1"), ("key", "<i8"), ("end", f"V{width}")]))
                yield pa.record_batch({"file": pa.array([file] * len(keys), pa.string()), "ordinal": pa.array(np.arange(len(keys))), "doc_id": pa.array(keys["key"], mask=keys["has"] == 0)})

    return _read(spark, f"{path}/kind=docs").mapInArrow(run, "file string, ordinal long, doc_id long")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and n_tokens (end id included) of every document, counted in flat two-byte token files of the byte-level vocabulary."""
    path, end_id = new_path(spark, "flat-tokens"), 50256
    write_flat(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, "byte_bpe_50k.json", end_id)
    counts = count_tokens(spark, f"{path}/kind=ids", end_id)
    return settle(counts.join(doc_ids(spark, path), ["file", "ordinal"]).select("doc_id", "n_tokens"))


QUERIES = {"op5_token_counts": op5_token_counts}
ORACLE_SQL: dict[str, str] = {}
