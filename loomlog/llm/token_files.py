"""Operator 1: token-id files with a shared zstandard dictionary and an offset index.

A file holds documents in ascending ``doc_id`` order (nulls first, equal ids in any order):

* one record per document: a zstandard frame over its ids (unsigned, little-endian, two bytes each, four where
  the vocabulary needs them), compressed on its own with the shared dictionary, then a line feed;
* the index: per document ``INDEX`` (doc_id, whether it has one, offset and length of its frame, n_tokens), then a line feed;
* the footer: ``FOOTER`` (magic, SHA-256 of the dictionary, offset of the index, documents, tokens, bytes per id), then a line feed.

Files and dictionary are written by Spark's text writer, whose commit protocol survives lost executors, and read
by Spark's binary-file source, so any file system that Spark knows will do. A manifest has a row per file: its number, lowest
and highest doc_id, documents and tokens. Short-document access goes by manifest, footer, index and frame, each read by seeking.

Files are cut by doc_id and hash, at quantiles of a sample, so that each holds about FILE_BYTES of text and DOCS_PER_FILE documents
at most; a doc_id, or none, that many rows share is spread over files by a hash of the row's place. (One document is never cut, so that it must
fit into a row of Spark's.)
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .storage import new_path, partitions_of, settle, small_batches, tasks
from .tokens import encoder, slices

MAGIC = b"LOOMTOK1"
INDEX = np.dtype([("doc_id", "<i8"), ("has_id", "u1"), ("offset", "<u8"), ("length", "<u8"), ("n_tokens", "<u8")])
FOOTER = np.dtype([("magic", "S8"), ("dictionary", "V32"), ("index", "<u8"), ("docs", "<u8"), ("tokens", "<u8"), ("width", "u1")])
#: Documents and bytes of text per file, about; a task reads a file as a whole.
DOCS_PER_FILE, FILE_BYTES = 8_192, 256_000_000
#: Rows that the files' bounds are worked out from: so many per file, and at most (as many as a range partitioner takes).
SAMPLED_PER_FILE, MOST_SAMPLED = 64, 1_000_000
#: Texts that the shared dictionary is trained on, their bytes at most (for it serves short documents), and its own size; together they bound the driver's memory.
DICTIONARY_ROWS, DICTIONARY_TEXT, DICTIONARY_BYTES = 1_000, 16_384, 64 * 1024
#: Stands for a null doc_id: it comes first.
_NONE = -(1 << 63)


def train_dictionary(docs: DataFrame, n: int, tokenizer: str, end_id: int, width: int) -> bytes:
    """A dictionary from the whole id arrays of up to DICTIONARY_ROWS texts of up to DICTIONARY_TEXT bytes: of twice as many of the n rows (in the mean) that a hash of their place picks, those of the lowest hashes. It affects sizes only, never what is read back. Empty if there is too little text."""
    import zstandard

    size, mixed = F.octet_length("text"), F.xxhash64("hash", F.lit("dictionary"))
    picked = F.pmod(mixed, F.lit(1 << 40)) < min(1 << 40, (2 * DICTIONARY_ROWS << 40) // max(n, 1) + 1)
    rows = docs.where((size > 0) & (size <= DICTIONARY_TEXT) & picked).select("text", mixed.alias("h")).orderBy("h").limit(DICTIONARY_ROWS).collect()
    end = int(end_id).to_bytes(width, "little")
    samples = [x + end for x in encoder(tokenizer, width).encode([r.text for r in rows])]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=3).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few samples
        return b""


def file_bounds(keyed: DataFrame, n: int, n_bytes: int, docs_per_file: int) -> np.ndarray:
    """Rows (doc_id, hash), ascending: where files after the first begin. From a sample by hash of ``keyed`` (doc_id, hash, size)."""
    files = max(-(-n // docs_per_file), -(-n_bytes // FILE_BYTES))
    if files <= 1:
        return np.zeros((0, 2), np.int64)
    wanted = min(SAMPLED_PER_FILE * files, MOST_SAMPLED)
    share = min(1 << 40, (wanted << 40) // n + 1)
    rows = keyed.where(F.pmod(F.xxhash64("hash", F.lit("bounds")), F.lit(1 << 40)) < share).toArrow()  # about ``wanted`` of them
    key, mixed = (np.asarray(rows[c].combine_chunks()).astype(np.int64) for c in ("doc_id", "hash"))
    order = np.lexsort((mixed, key))
    weight = np.asarray(rows["size"].combine_chunks()).astype(np.float64)[order] / max(n_bytes, 1) + 1 / n  # share of bytes and of documents
    at = np.searchsorted(np.cumsum(weight), weight.sum() * np.arange(1, files) / files)
    return np.unique(np.stack([key[order], mixed[order]], 1)[np.minimum(at, len(order) - 1)], axis=0) if len(order) else np.zeros((0, 2), np.int64)


def file_of(bounds: np.ndarray, key: np.ndarray, mixed: np.ndarray) -> np.ndarray:
    """The file of each (doc_id, hash): how many bounds are at or below it."""
    low, high = np.searchsorted(bounds[:, 0], key, "left"), np.searchsorted(bounds[:, 0], key, "right")
    for i in np.flatnonzero(low < high):  # ids at which a file begins: the hash decides
        low[i] += np.searchsorted(bounds[low[i] : high[i], 1], mixed[i], "right")
    return low.astype(np.int32)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, width: int = 2, docs_per_file: int = DOCS_PER_FILE) -> None:
    """Encode the texts of ``docs`` (doc_id, text; other columns are left out) and write them below ``path``.

    A null or empty text is a document of the end id alone. Repeated rows are written as often as they occur; an
    empty table gives one file without documents. Texts are encoded before the shuffle, which moves compressed frames only.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE)).alias("doc_id"), F.col("doc_id").isNotNull().alias("has_id"), "text")
    docs = docs.withColumn("hash", F.xxhash64(F.monotonically_increasing_id()))
    sized = docs.select("doc_id", "hash", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"))
    n, n_bytes = sized.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).head()
    dictionary = train_dictionary(docs, n, tokenizer, end_id, width)
    spark.createDataFrame([(bytearray(dictionary),)], "value binary").coalesce(1).select(F.col("value").cast("string")).write.text(f"{path}/dictionary")
    bounds = file_bounds(sized, n, n_bytes, docs_per_file)
    files, end = len(bounds) + 1, int(end_id).to_bytes(width, "little")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compress = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=False).compress
        for batch, texts in slices(batches, encoding=True):
            ids = [x + end for x in encoder(tokenizer, width).encode(texts)]
            key, has, mixed = batch.column(0), batch.column(1), batch.column(3)
            file = file_of(bounds, np.asarray(key), np.asarray(mixed))
            yield pa.record_batch({"file": pa.array(file), "doc_id": key, "has_id": has, "hash": mixed, "n_tokens": pa.array([len(x) // width for x in ids], pa.int64()), "frame": pa.array([compress(x) for x in ids], pa.binary())})

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, index = 0, []
        for batch in batches:
            frames = batch.column(3)
            length = np.asarray(pc.binary_length(frames)).astype(np.int64)
            own = np.zeros(batch.num_rows, INDEX)
            own["doc_id"], own["has_id"] = np.asarray(batch.column(0)), np.asarray(batch.column(1).cast(pa.uint8()))
            own["offset"], own["length"], own["n_tokens"] = at + np.cumsum(length + 1) - length - 1, length, np.asarray(batch.column(2))
            at += int(length.sum()) + batch.num_rows
            index.append(own)
            yield pa.record_batch({"value": frames})
        index = np.concatenate(index) if index else np.zeros(0, INDEX)
        footer = np.zeros(1, FOOTER)
        footer["magic"], footer["index"], footer["docs"], footer["tokens"], footer["width"] = MAGIC, at, len(index), index["n_tokens"].sum(), width
        footer["dictionary"] = np.void(hashlib.sha256(dictionary).digest())
        yield pa.record_batch({"value": pa.array([index.tobytes(), footer.tobytes()], pa.binary())})

    encoded = docs.mapInArrow(encode, "file int, doc_id long, has_id boolean, hash long, n_tokens long, frame binary")
    placed = encoded.repartitionById(files, F.col("file")).sortWithinPartitions("doc_id", "has_id", "hash").select("doc_id", "has_id", "n_tokens", "frame")
    placed.mapInArrow(lay_out, "value binary").select(F.col("value").cast("string")).write.option("lineSep", "\n").text(f"{path}/data")
    _manifest(spark, path)


def _manifest(spark: SparkSession, path: str) -> None:
    """Write the manifest: a row per file, from the files' indexes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own, footer = _parts(content.as_buffer())
                some = len(own) > 0
                yield pa.record_batch({"file": pa.array([file], pa.int32()), "low": pa.array([int(own["doc_id"][0]) if some else None], pa.int64()), "high": pa.array([int(own["doc_id"][-1]) if some else None], pa.int64()), "docs": pa.array([len(own)], pa.int64()), "tokens": pa.array([int(footer["tokens"])], pa.int64())})

    rows = _files(spark, path).select("file", "content").mapInArrow(run, "file int, low long, high long, docs long, tokens long")
    rows.coalesce(tasks(spark, 1)).write.parquet(f"{path}/manifest")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/manifest")


def _files(spark: SparkSession, path: str) -> DataFrame:
    part = F.regexp_extract("path", r"part-(\d+)", 1).cast("int")
    return spark.read.format("binaryFile").load(f"{path}/data").select(part.alias("file"), "length", "content")


def dictionary(spark: SparkSession, path: str) -> bytes:
    return b"".join(bytes(r.content)[:-1] for r in spark.read.format("binaryFile").load(f"{path}/dictionary").select("content").collect() if r.content)


def _parts(buffer: pa.Buffer) -> tuple[np.ndarray, np.ndarray]:
    footer = np.frombuffer(buffer, FOOTER, 1, buffer.size - 1 - FOOTER.itemsize)[0]
    return np.frombuffer(buffer, INDEX, int(footer["docs"]), int(footer["index"])), footer


def _before(own: np.ndarray) -> np.ndarray:
    n = own["n_tokens"].astype(np.int64)
    return np.cumsum(n) - n


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Decode the files below ``path``: doc_id, start (ids of all documents before), n_tokens, ids_crc32 and, if asked for, ids.

    A file made with another dictionary than the one below ``path`` is refused. The only thing computed over all
    files at once is the running sum of their token counts: one row per file.
    """
    known = dictionary(spark, path)
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        expand = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(known) if known else None).decompress
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                buffer = content.as_buffer()
                own, tail = _parts(buffer)
                _refuse(tail, known)
                view, small, before = memoryview(buffer), f"<u{tail['width']}", _before(own)
                for lo in range(0, len(own), 1024):
                    part = own[lo : lo + 1024]
                    ids = [np.frombuffer(expand(view[o : o + n]), small).astype("<u4") for o, n in zip(part["offset"].tolist(), part["length"].tolist(), strict=True)]
                    out = {"file": pa.array([file] * len(part), pa.int32()), "doc_id": pa.array(part["doc_id"], mask=part["has_id"] == 0), "before": pa.array(before[lo : lo + 1024]), "n_tokens": pa.array([len(x) for x in ids], pa.int64()), "ids_crc32": pa.array([zlib.crc32(x) for x in ids], pa.int64())}
                    yield pa.record_batch(out | ({"ids": pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64()))} if with_ids else {}))

    ends = F.sum("tokens").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    base = manifest(spark, path).select("file", (ends - F.col("tokens")).alias("base"))
    schema = "file int, doc_id long, before long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    files = _files(spark, path)
    rows = settle(files.select("file", "content").mapInArrow(decode, schema), partitions_of(files)).join(base, "file")
    return rows.select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def read_document(spark: SparkSession, path: str, doc_id: int | None) -> list[list[int]]:
    """The ids of the documents with this doc_id (None: with none): of the files whose range holds it, footer, index and their frames alone are read."""
    import zstandard

    known = dictionary(spark, path)
    expand = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(known) if known else None).decompress
    key, out = _NONE if doc_id is None else doc_id, []
    found = sorted(r.file for r in manifest(spark, path).where((F.col("low") <= key) & (F.col("high") >= key)).collect())
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/data")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    by_part = {int(m[1]): x for x in fs.listStatus(root) if (m := re.match(r"part-(\d+)", x.getPath().getName()))} if found else {}
    for file in found:
        stream, size = fs.open(by_part[file].getPath()), by_part[file].getLen()

        def at(offset: int, length: int) -> bytes:
            stream.seek(offset)  # noqa: B023
            return bytes(stream.readNBytes(length))  # noqa: B023

        try:
            footer = np.frombuffer(at(size - 1 - FOOTER.itemsize, FOOTER.itemsize), FOOTER)[0]
            _refuse(footer, known)
            own = np.frombuffer(at(int(footer["index"]), int(footer["docs"]) * INDEX.itemsize), INDEX)
            for r in own[(own["doc_id"] == key) & (own["has_id"] == (doc_id is not None))]:
                out.append(np.frombuffer(expand(at(int(r["offset"]), int(r["length"]))), f"<u{footer['width']}").tolist())
        finally:
            stream.close()
    return out


def _refuse(footer: np.void, known: bytes) -> None:
    if footer["magic"] != MAGIC:
        raise ValueError("not a token file")
    if footer["dictionary"].tobytes() != hashlib.sha256(known).digest():
        raise ValueError("the file was written with another dictionary")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded with the word-level vocabulary, written to token files and read back from them."""
    path = new_path(spark, "token-files")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, "word_bpe_49k.json", end_id=1)
    return read(spark, path)


QUERIES = {"op1_token_files": op1_token_files}
ORACLE_SQL: dict[str, str] = {}
