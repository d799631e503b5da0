"""Operator 7: near-duplicates by SimHash, found with BK-trees.

A fingerprint has 64 bits: bit i is 1 if it is set in more than half of the hashes of a text's word shingles. Two texts
are linked if their fingerprints differ in ``radius`` bits at most.

Fingerprints are dealt to shards, which two that may be linked share; each shard is a BK-tree: a node's children are kept by
their distance to it, and a search follows only the edges within the radius of its own distance. A shard of more than
TREE fingerprints is dealt out as blocks, each a tree that is sent to the shard's blocks of queries. The trees of a task are
built and searched together. A tree gives links that join what all its pairs join, not all pairs; components of the
links then give the groups. Shards are made in one of two ways:

* ``groups`` (links are a matter of bits alone): the bits are cut into bands. Fingerprints within the radius agree in all
  but ``radius`` of them, so each goes to a shard per choice of so many bands; there are more bands, and smaller shards,
  the more fingerprints there are. Every link is found.
* ``similar_groups`` (links are texts with a Jaccard similarity of their shingles): a shard is a pair of least shingle
  hashes, PAIRS of them per text, so two texts at 0.8 share none with a probability of 0.0008. Trees of fingerprints of
  SIMILAR_BITS bits are searched within radii beyond which such texts hardly ever are, the nearest first, and the links that
  they give are compared by shingles. Where one fails it may have hidden others: the texts that it held together are searched
  once more, now comparing shingles within the trees.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .storage import materialize, partitions_of, settle, small_batches
from .tokens import slices

RADIUS, WORDS, SEED = 4, 4, 42
#: Fingerprints in one tree, and in one block of queries, at most (of larger shards in the mean: they are dealt by hash).
TREE = 1_024
#: Fingerprints in a shard, in the mean, from which on there is one band more.
PER_SHARD = 256
#: Near-duplicates by similarity: words of a shingle, Jaccard similarity, pairs of least hashes.
SIMILAR_WORDS, SIMILARITY, PAIRS = 5, 0.8, 7
#: Bits of their fingerprints, and radii of the search, one after the other. At 0.8 fingerprints differ in 39 bits (standard deviation 6), a few more in very short texts.
SIMILAR_BITS, SIMILAR_RADII = 256, (16, 32, 62)
#: Bits of the map of texts whose shingles are asked for; what passes it is joined.
MAP = 1 << 24


def shingles(text: str, words: int) -> np.ndarray:
    """Hashes of the word shingles, repeats included. A-Z lower-cased, words split at ASCII white space; a text of fewer words is one shingle, one of none has none."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    end = np.cumsum(size + 1) - 1
    start = (end - size).tolist()
    n = max(len(parts) - words + 1, 1)
    stop = end[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(start, stop, strict=False)), np.uint64, n)


def fingerprint(text: str, words: int = WORDS) -> int:
    """The SimHash of a text; zero without words."""
    return majority(shingles(text, words))


def majority(hashes: np.ndarray) -> int:
    """Bits set in more than half of the hashes."""
    count = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[lo : lo + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += bits.sum(0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * count > len(hashes)).tolist()))


def long_fingerprint(hashes: np.ndarray) -> bytes:
    """SIMILAR_BITS bits, 64 from each of several mixes of the hashes."""
    mixed = [(hashes ^ (hashes >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15 * (2 * k + 1) & 0xFFFFFFFFFFFFFFFF) for k in range(SIMILAR_BITS // 64)]
    return b"".join(majority(m ^ (m >> np.uint64(29))).to_bytes(8, "little") for m in mixed)


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row of ``docs`` (doc_id, text). Null counts as the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            found = np.array([fingerprint(t, words) for t in texts], dtype=np.uint64).astype(np.int64)
            yield pa.record_batch({"doc_id": batch.column(0), "fp": pa.array(found)})

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


class BKForest:
    """BK-trees over values of one or more 64-bit words, built and searched a level at a time for all trees and queries at once."""

    def __init__(self, values: np.ndarray, root: np.ndarray):
        """``values``: (values, words). ``root``: for each value the index of its tree's root; roots are their own."""
        self.values = np.asarray(values, np.uint64)
        self.steps = 64 * self.values.shape[1] + 1  # distances
        rest = np.flatnonzero(root != np.arange(len(root)))
        where, slots, children = root[rest], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(rest):  # of the values that stand at a node at the same distance the first is its child; the others go on from there
            slot = where * self.steps + self._distance(where, self.values[rest])
            places, first, inverse = np.unique(slot, return_index=True, return_inverse=True)
            slots.append(places)
            children.append(rest[first])
            going = np.ones(len(rest), bool)
            going[first] = False
            where, rest = rest[first][inverse][going], rest[going]
        slots, children = np.concatenate(slots), np.concatenate(children)
        order = np.argsort(slots)
        #: node * steps + distance of every edge, ascending, and the child there.
        self.slots, self.children = slots[order], children[order]

    def _distance(self, nodes: np.ndarray, others: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.values[nodes] ^ others).sum(1, dtype=np.int64)

    def search(self, queries: np.ndarray, root: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query indexes, node indexes) of the pairs within the radius; ``root``: the root of the tree to search for each query."""
        queries, last = np.asarray(queries, np.uint64), self.steps - 1
        for lo in range(0, len(queries), 1024):
            q = np.arange(lo, min(lo + 1024, len(queries)))
            node = root[q]
            while len(q):
                d = self._distance(node, queries[q])
                near = d <= radius
                if near.any():
                    yield q[near], node[near]
                low = np.searchsorted(self.slots, node * self.steps + np.maximum(d - radius, 0), "left")
                n = np.searchsorted(self.slots, node * self.steps + np.minimum(d + radius, last), "right") - low
                q, first = np.repeat(q, n), np.repeat(low - np.cumsum(n) + n, n)
                node = self.children[first + np.arange(len(q))]


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two ascending arrays without repeats; 1 if both are empty."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return float(not len(b))
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    same = int((b[at] == a).sum())
    return same / (len(a) + len(b) - same)


def run_links(run: np.ndarray, fp: np.ndarray, is_node: np.ndarray, radii: tuple[int, ...], sets: list[np.ndarray] | None = None, least: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Links (row indexes) within runs of rows, numbered ascending: between the tree's rows (is_node) and the other ones, or among all if no row of the run is marked. They join what all pairs within the last radius join; nearer pairs are preferred as the radii go. With ``sets``, only pairs of a Jaccard similarity of ``least`` are links."""
    n = len(run)
    first = np.searchsorted(run, run)  # of the run
    marked = np.zeros(n, bool)
    np.logical_or.at(marked, first, is_node)
    marked = marked[first]
    in_tree, asks = is_node | ~marked, ~is_node
    nodes, queries = np.flatnonzero(in_tree), np.flatnonzero(asks & (n > 1))
    _, start = np.unique(run[nodes], return_index=True)  # roots
    at = np.searchsorted(run[nodes][start], run)
    forest = BKForest(fp[nodes], start[at[nodes]]) if len(nodes) else None
    parent = np.arange(n)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return int(i)

    left, right = [], []
    for q, m in (x for radius in radii for x in forest.search(fp[queries], start[at[queries]], radius)) if forest else ():
        a, b = queries[q], nodes[m]
        while True:  # roots of all pairs at once; pairs within a component need no link
            ra, rb = parent[a], parent[b]
            if (parent[ra] == ra).all() and (parent[rb] == rb).all():
                break
            parent[:] = parent[parent]
        for i in np.flatnonzero(ra != rb).tolist():
            x, y = int(a[i]), int(b[i])
            if (p := root(x)) != (o := root(y)) and (sets is None or similarity(sets[x], sets[y]) >= least):
                parent[max(p, o)] = min(p, o)
                left.append(x)
                right.append(y)
    return np.array(left, np.int64), np.array(right, np.int64)


def links(rows: DataFrame, radii: tuple[int, ...] = (RADIUS,), least: float | None = None, shards: DataFrame | None = None) -> DataFrame:
    """u, v: links between nodes of ``rows`` (shard, node, fp: a long, or bytes of 64-bit words; with ``least`` also shingles: their ascending hashes, four bytes each) that join them as all pairs of a shard do that are within the last radius and, with ``least``, as similar.

    ``shards``: the rows' column shard by itself, where that is cheaper to read. Shards of one row are left out. A row of a larger one meets all blocks of its shard, as part of a tree or as a query: blocks meet once.
    """
    sizes = materialize((rows if shards is None else shards).groupBy("shard").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    placed = rows.join(sizes, "shard").withColumn("blocks", F.ceil(F.col("n") / TREE).cast("int")).withColumn("own", F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")).cast("int"))
    asks = F.transform(F.sequence("own", F.col("blocks") - 1), lambda t: F.struct(t.alias("tree"), F.col("own").alias("block"), F.lit(False).alias("is_node")))
    holds = F.transform(F.when(F.col("own") > 0, F.sequence(F.lit(0), F.col("own") - 1)).otherwise(F.array().cast("array<int>")), lambda b: F.struct(F.col("own").alias("tree"), b.alias("block"), F.lit(True).alias("is_node")))
    names = ["node", "fp", *(["shingles"] if least is not None else [])]
    cells = placed.select("shard", *names, F.explode(F.concat(asks, holds)).alias("x")).select("shard", "x.tree", "x.block", "x.is_node", *names)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # rows of the run that may go on

        def found(table: pa.Table) -> pa.RecordBatch:
            key = [np.asarray(table.column(i).combine_chunks()) for i in range(3)]
            change = np.zeros(table.num_rows, bool)
            for k in key:
                change[1:] |= k[1:] != k[:-1]
            node, fp = np.asarray(table.column(4).combine_chunks()).astype(np.int64), table.column(5).combine_chunks()
            fp = np.asarray(fp).astype(np.int64).astype(np.uint64) if pa.types.is_integer(fp.type) else np.frombuffer(b"".join(fp.to_pylist()), "<u8")
            sets = [np.frombuffer(x.as_buffer(), "<u4") for x in table.column(6)] if least is not None else None
            u, v = run_links(np.cumsum(change), fp.reshape(len(node), -1), np.asarray(table.column(3).combine_chunks().cast(pa.uint8())) > 0, radii, sets, least or 0.0)
            return pa.record_batch({"u": pa.array(node[u]), "v": pa.array(node[v])})

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            same = np.ones(table.num_rows, bool)
            for i in range(3):
                k = np.asarray(table.column(i).combine_chunks())
                same &= k == k[-1]
            cut = table.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0  # where the last run begins
            if cut:
                yield found(table.slice(0, cut))
            held = table.slice(cut)
        if held is not None:
            yield found(held)

    dealt = cells.repartition("shard", "tree", "block").sortWithinPartitions("shard", "tree", "block")
    return dealt.mapInArrow(search, "u long, v long")


def bands_for(n: int, radius: int) -> int:
    """Bands for n fingerprints: one more than the radius, or so many that a shard holds PER_SHARD of them at most, if their bits were random."""
    bands = radius + 1
    while n > PER_SHARD * 2 ** (64 * (bands - radius) // bands):
        bands += 1
    return bands


def shard_keys(fp: np.ndarray, radius: int, bands: int) -> np.ndarray:
    """(fingerprints, choices): for each choice of bands - radius bands, its number in the upper bits and those bands' bits."""
    fp, edges = fp.astype(np.uint64), [round(i * 64 / bands) for i in range(bands + 1)]
    choices = list(itertools.combinations(range(bands), bands - radius))
    out = np.empty((len(fp), len(choices)), np.uint64)
    for c, choice in enumerate(choices):
        key = np.full(len(fp), c, np.uint64)
        for b in choice:
            width = edges[b + 1] - edges[b]
            key = (key << np.uint64(width)) | ((fp >> np.uint64(edges[b])) & np.uint64((1 << width) - 1))
        out[:, c] = key
    return out


def bit_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """u, v: links between the distinct fingerprints ``fp`` that join them as all pairs within the radius do."""
    bands = bands_for(fps.count(), radius)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.asarray(batch.column(0)).astype(np.int64)
            k = shard_keys(fp, radius, bands).astype(np.int64)
            yield pa.record_batch({"shard": pa.array(k.ravel()), "node": pa.array(np.repeat(fp, k.shape[1])), "fp": pa.array(np.repeat(fp, k.shape[1]))})

    return links(materialize(fps.mapInArrow(keys, "shard long, node long, fp long"), "shards"), (radius,))


def groups(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id that links reach) of every row of ``docs`` (doc_id, text; other columns are left out).

    Null and empty texts have fingerprint zero and are linked like any other. Repeated rows are answered as often as they
    occur. A row with a null doc_id belongs to its group but doesn't name it; a group of such rows only has a null component_id.
    """
    found = materialize(fingerprints(docs, words), "fingerprints", partitions_of(docs.select("doc_id", "text")))
    nodes = materialize(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    linked = components(bit_links(nodes.select("fp"), radius))
    placed = materialize(nodes.join(linked, nodes["fp"] == linked["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("c")), "placed")
    named = materialize(placed.groupBy("c").agg(F.min("least").alias("component_id")), "named")
    labels = materialize(placed.join(named, "c").select("fp", "component_id"), "labels")
    return settle(found.join(labels, "fp").select("doc_id", "fp", "component_id"))


def least_pairs(hashes: np.ndarray, pairs: int = PAIRS) -> np.ndarray:
    """For each pair of random orders of all hashes, one number for the two that come first; the same for all texts without any."""
    if not len(hashes):
        return np.zeros(1, np.uint64)
    order = np.arange(1, 2 * pairs + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    least = np.empty(2 * pairs, np.uint64)
    for k in range(2 * pairs):
        mixed = (hashes ^ order[k]) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        least[k] = (mixed ^ (mixed >> np.uint64(29))).min()
    both = least.reshape(-1, 2)
    return (both[:, 0] * np.uint64(0xD6E8FEB86659FD93) ^ both[:, 1]) + order[:pairs]


def _sets(own: DataFrame, asked: DataFrame, words: int) -> DataFrame:
    """node and shingles of the texts in ``asked`` (doc_id, digest, node), worked out from one row of ``own`` (doc_id, digest, text) each. A map of fixed size keeps most other rows out before the join."""
    place = F.pmod(F.xxhash64("digest", "doc_id"), F.lit(MAP))
    packed = asked.select(place.alias("p")).groupBy(F.floor(F.col("p") / 64).cast("int").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p % 64 AS int))")).alias("bits"))
    table = np.zeros(MAP // 64, np.int64)
    for at, word in packed.collect():  # MAP / 64 rows at most
        table[at] = word

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.asarray(batch.column(3)).astype(np.int64)
            batch = batch.filter(pa.array((table[at >> 6] >> (at & 63)) & 1 == 1))
            for part, texts in slices(iter([batch])):
                yield pa.record_batch({"doc_id": part.column(0), "digest": part.column(1), "shingles": pa.array([np.unique(shingles(t, words).astype(np.uint32)).tobytes() for t in texts], pa.binary())})

    found = own.select("doc_id", "digest", "text", place.alias("place")).mapInArrow(run, "doc_id long, digest string, shingles binary")
    return found.join(asked, ["doc_id", "digest"]).select("node", "shingles").dropDuplicates(["node"])


def _compared(pairs: DataFrame, least: float) -> DataFrame:
    """u, v and ok of pairs (u, v, and the shingles a and b): whether they are as similar as ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [similarity(np.frombuffer(a.as_buffer(), "<u4"), np.frombuffer(b.as_buffer(), "<u4")) >= least for a, b in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.record_batch({"u": batch.column(0), "v": batch.column(1), "ok": pa.array(ok, pa.bool_())})

    return pairs.select("u", "v", "a", "b").mapInArrow(run, "u long, v long, ok boolean")


def similar_groups(docs: DataFrame, words: int = SIMILAR_WORDS, least: float = SIMILARITY) -> DataFrame:
    """doc_id and component_id (the smallest doc_id that links reach) of the rows of ``docs`` (doc_id, text; other columns are left out) that have a doc_id and share their group with another doc_id.

    Equal texts are one node. Different ones are linked at a Jaccard similarity of ``least`` between their sets of ``words``-word
    shingles (as 32-bit hashes). Null counts as empty; texts without words are alike. Rows of one doc_id may have different texts.
    """
    small_batches(docs.sparkSession)
    own = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.coalesce("text", F.lit(""))).alias("digest"), "text")

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            hashes = [np.unique(shingles(t, words)) for t in texts]
            yield pa.record_batch({"doc_id": batch.column(0), "digest": batch.column(1), "fp": pa.array([long_fingerprint(h) for h in hashes], pa.binary()), "shards": pa.array([least_pairs(h).astype(np.int64) for h in hashes], pa.list_(pa.int64()))})

    found = materialize(own.mapInArrow(prints, "doc_id long, digest string, fp binary, shards array<long>").withColumn("node", F.monotonically_increasing_id()), "prints", partitions_of(own))
    nodes = found.groupBy("digest").agg(F.min("node").alias("node"), F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    nodes = materialize(nodes, "nodes")
    spread = found.select("node", "shards").join(nodes.select("node"), "node", "left_semi").select("node", F.explode("shards").alias("shard"))
    shared = spread.groupBy("shard").agg(F.count("*").alias("n")).where("n > 1").select("shard")
    meeting = materialize(spread.join(shared, "shard").select("shard", "node").distinct(), "meeting")
    near = materialize(links(meeting.join(found.select("node", "fp"), "node"), SIMILAR_RADII, shards=meeting), "near")
    linked = near.select(F.col("u").alias("node")).unionAll(near.select(F.col("v").alias("node"))).distinct()
    asked = materialize(nodes.join(linked, "node", "left_semi").select(F.col("least").alias("doc_id"), "digest", "node"), "asked")
    sets = materialize(_sets(own, asked, words), "sets")
    sides = [sets.select(F.col("node").alias(n), F.col("shingles").alias(c)) for n, c in (("u", "a"), ("v", "b"))]
    checked = materialize(_compared(near.join(sides[0], "u").join(sides[1], "v"), least), "checked")
    good, failed = checked.where("ok").select("u", "v"), checked.where("NOT ok")
    if not failed.isEmpty():
        held = components(near)
        again = held.join(held.join(failed.select(F.col("u").alias("node")), "node", "left_semi").select("component").distinct(), "component", "left_semi").select("node")
        again = materialize(meeting.join(again, "node", "left_semi"), "again")
        rows = again.join(found.select("node", "fp"), "node").join(sets, "node").select("shard", "node", "fp", "shingles")
        good = good.unionAll(links(rows, SIMILAR_RADII, least, again))
    reached = components(good)
    placed = materialize(nodes.join(reached, "node", "left").select("digest", "copies", "least", F.coalesce("component", "node").alias("c"), F.col("component").isNotNull().alias("linked")).where("linked OR copies > 1"), "placed")
    named = materialize(placed.groupBy("c").agg(F.min("least").alias("component_id")), "named")
    labels = materialize(placed.join(named, "c").select("digest", "component_id"), "labels")
    return found.select("doc_id", "digest").join(labels, "digest").select("doc_id", "component_id")


def deduplicate(docs: DataFrame, words: int = SIMILAR_WORDS, least: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose doc_id names their group of similar texts: one document of each. Rows without a doc_id stay, and so do rows that repeat the doc_id that stays."""
    gone = similar_groups(docs, words, least).where("doc_id <> component_id").select(F.col("doc_id").alias("__loomlog_doc")).distinct()
    return docs.join(materialize(gone, "gone"), F.col("doc_id") == F.col("__loomlog_doc"), "left_anti")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint (16 hexadecimal digits) and group of every document."""
    found = groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op7_simhash": op7_simhash}
ORACLE_SQL: dict[str, str] = {}
