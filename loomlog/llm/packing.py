"""Operator 3: packing documents into as few sequences of a fixed length as possible.

Only the number of pieces of each length matters for how full sequences get, so bins are planned on that
histogram: a plan is a set of *patterns* (the lengths of the pieces in one sequence) with how often each is used.
Its size depends on the sequence length, not on the number of documents, and it is all that the driver holds.

1. ``best_fit``: best-fit decreasing on the histogram, a pattern at a time.
2. ``improve``: swap-based local search between underfull patterns. A step moves a piece, exchanges one for one or
   two for one, if that increases the sum of squared fills; sequences that become empty are gone.
3. Each piece finds its place by its rank among the pieces of its length: ranks come from a window over
   (length, salt), so that no task gets all pieces of one length.
"""

from __future__ import annotations

import bisect
import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import materialize, partitions_of, settle, small_batches
from .tokens import encoder, slices

Pattern = tuple[int, ...]

#: Salts within a length, and pieces behind each salt from which on there are more of them.
SALTS, PER_SALT = 64, 100_000


def cut(length: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, but for the first where the length isn't a multiple."""
    if length <= most:
        return [(0, length)]
    first = length % most
    return ([(0, first)] if first else []) + [(at, most) for at in range(first, length, most)]


def best_fit(counts: dict[int, int], most: int) -> Counter[Pattern]:
    """Best-fit decreasing: each piece, longest first, goes where it leaves the least room; equal open sequences are one entry."""
    open_: dict[int, Counter[Pattern]] = {}  # by room left
    rooms: list[int] = []

    def put(pattern: Pattern, n: int, room: int) -> None:
        if room not in open_:
            open_[room] = Counter()
            bisect.insort(rooms, room)
        open_[room][pattern] += n

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            k = bisect.bisect_left(rooms, size)
            if k == len(rooms):
                put((size,), left, most - size)
                break
            room = rooms[k]
            pattern, n = open_[room].popitem()
            if not open_[room]:
                del open_[room]
                rooms.pop(k)
            fits = room // size
            used = min(left, n)
            if used < n:
                put(pattern, n - used, room)
            # further pieces of this size fill the same sequences: the room left afterwards is the least
            times = min(fits, left // used)
            put(pattern + (size,) * times, used, room - size * times)
            left -= used * times
    out: Counter[Pattern] = Counter()
    for found in open_.values():
        out.update(found)
    return out


def _step(a: Pattern, b: Pattern, most: int) -> tuple[Pattern, Pattern] | None:
    """The best move or exchange that makes the fuller ``b`` fuller at the cost of ``a``; None if there is none. The sum of squares then grows, as b's fill is at least a's."""
    slack, best, change = most - sum(b), 0, None
    xs, ys = sorted(set(a)), sorted(set(b))
    for x in xs:  # move x, or exchange it for one or two shorter pieces
        if best < x <= slack:
            best, change = x, ((x,), ())
        if x > best:
            low = x - slack
            k = bisect.bisect_left(ys, low)
            if k < len(ys) and (d := x - ys[k]) > best:
                best, change = d, ((x,), (ys[k],))
        if best == slack:
            break
    if best < slack:
        for i, x in enumerate(a):  # two for one
            for z in a[i + 1 :]:
                k = bisect.bisect_left(ys, x + z - slack)
                if k < len(ys) and (d := x + z - ys[k]) > best:
                    best, change = d, ((x, z), (ys[k],))
    if best < slack:
        for i, y in enumerate(b):  # one for two
            for z in b[i + 1 :]:
                k = bisect.bisect_right(xs, y + z + slack) - 1
                if k >= 0 and (d := xs[k] - y - z) > best:
                    best, change = d, ((xs[k],), (y, z))
    if change is None:
        return None
    gone, come = Counter(change[0]), Counter(change[1])
    left, right = Counter(a), Counter(b)
    left.subtract(gone)
    left.update(come)
    right.subtract(come)
    right.update(gone)
    return tuple(sorted(left.elements(), reverse=True)), tuple(sorted(right.elements(), reverse=True))


def _gives(a: Pattern) -> tuple[int, int]:
    """What ``a`` can give, as bit sets of lengths: its pieces, and the sums of two of them."""
    one = two = 0
    for i, x in enumerate(a):
        one |= 1 << x
        for z in a[i + 1 :]:
            two |= 1 << (x + z)
    return one, two


def _takes(b: Pattern, most: int) -> tuple[int, int]:
    """The lengths of single pieces, and of two pieces, that ``b`` can take in a step: by up to its room more than what it gives in return (nothing, one or two pieces; one)."""
    one, two = _gives(b)
    out = []
    for give in (1 | one | two, one):
        left, reach = most - sum(b), give << 1 if sum(b) < most else 0
        width = 1
        while width < left:  # smeared over 1 to ``left``
            reach |= reach << min(width, left - width)
            width *= 2
        out.append(reach)
    return out[0], out[1]


def improve(plan: Counter[Pattern], most: int) -> Counter[Pattern]:
    """Local search: the emptiest pattern gives pieces to, or exchanges them with, fuller underfull ones, for all its sequences at once, until no step helps or the number of sequences is the least possible. The sum of squared fills grows with each step, so it ends; bit sets tell which pairs have a step."""
    plan = Counter({tuple(sorted(p, reverse=True)): n for p, n in plan.items()})
    total = sum(sum(p) * n for p, n in plan.items())
    least, used = -(-total // most), sum(plan.values())
    under: Counter[Pattern] = Counter({p: n for p, n in plan.items() if sum(p) < most})
    full = plan - under
    order = sorted((sum(p), p) for p in under)
    queue = list(order)  # a heap, as it is sorted
    gives, takes = {p: _gives(p) for p in under}, {p: _takes(p, most) for p in under}
    stuck: dict[Pattern, tuple[int, int, int]] = {}  # with fill and gives

    def helped(a: Pattern) -> Pattern | None:
        """The emptiest pattern, as full as ``a`` at least, that a step makes fuller."""
        one, two = gives[a]
        for k in range(bisect.bisect_left(order, (sum(a),)), len(order)):
            b = order[k][1]
            x, xs = takes[b]
            if (one & x or two & xs) and (b != a or under[b] > 1):
                return b
        return None

    while queue and used > least:
        _, a = heapq.heappop(queue)
        if a not in under or a in stuck:
            continue
        if (b := helped(a)) is None:
            stuck[a] = (sum(a), *gives[a])
            continue
        n = min(under[a], under[b]) if a != b else under[a] // 2
        step = _step(a, b, most)
        for p in (a, b):
            under[p] -= n
        for p in step:
            if not p:
                used -= n
            elif sum(p) == most:
                full[p] += n
            else:
                if p not in under:
                    bisect.insort(order, (sum(p), p))
                    gives[p], takes[p] = _gives(p), _takes(p, most)
                under[p] += n
                stuck.pop(p, None)
                heapq.heappush(queue, (sum(p), p))
                fill, (x, xs) = sum(p), takes[p]
                for s in [s for s, (less, one, two) in stuck.items() if less <= fill and (one & x or two & xs)]:  # the new pattern may help those that nothing helped
                    heapq.heappush(queue, (stuck.pop(s)[0], s))
        for p in {a, b}:
            if under[p] > 0:
                heapq.heappush(queue, (sum(p), p))
            elif p in under:
                del under[p], gives[p], takes[p]
                order.pop(bisect.bisect_left(order, (sum(p), p)))
                stuck.pop(p, None)
    return full + under


def plan(counts: dict[int, int], most: int) -> Counter[Pattern]:
    """Patterns for a histogram of piece lengths (1 to ``most``)."""
    return improve(best_fit(counts, most), most)


def places(patterns: Counter[Pattern]) -> np.ndarray:
    """Rows (length, first rank, end rank, sequence of the first rank, offset), sorted: pieces of a length take their places in the order of their ranks."""
    rows, next_rank, base = [], Counter(), 0
    for pattern, n in sorted(patterns.items()):
        at = 0
        for size in pattern:
            rows.append((size, next_rank[size], next_rank[size] + n, base, at))
            next_rank[size] += n
            at += size
        base += n
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pieces(docs: DataFrame, tokenizer: str, most: int, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids of each document's pieces. Null text counts as empty: a document of the end id alone."""
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, encoding=True):
            rows, ids = [], []
            for key, data in zip(batch.column(0).to_pylist(), encoder(tokenizer, 4).encode(texts), strict=True):
                data += end
                for k, (at, n) in enumerate(cut(len(data) // 4, most)):
                    part = data[4 * at : 4 * (at + n)]
                    rows.append((key, k, at, n, zlib.crc32(part)))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int64))
            key, k, at, n, crc = zip(*rows, strict=True)
            out = {"doc_id": pa.array(key, pa.int64()), "piece": pa.array(k, pa.int32()), "start": pa.array(at, pa.int64()), "length": pa.array(n, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
            yield pa.record_batch(out | ({"ids": pa.array(ids, pa.list_(pa.int64()))} if with_ids else {}))

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", most: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pack whole texts of ``docs`` (doc_id, text; other columns are left out) into sequences of ``most`` tokens.

    Returns a row per piece: doc_id, piece, start, length, ids_crc32 (and ids), sequence_id, offset. Longer documents
    are cut, others never. Repeated rows are packed as often as they occur; null and empty texts hold the end id
    alone; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    found = materialize(pieces(docs, tokenizer, most, end_id, with_ids), "pieces", partitions_of(docs.select("doc_id", "text")))
    counts = {r.length: r.n for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = places(plan(counts, most))
    salts = max(SALTS, sum(counts.values()) // PER_SALT)
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    bases = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", before.alias("base"))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1).join(bases, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("base")).drop("salt", "base")
    span = int(table[:, 2].max()) + 1 if len(table) else 1
    keys = table[:, 0] * span + table[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            rank = np.asarray(batch.column(names.index("rank")))
            row = table[np.searchsorted(keys, np.asarray(batch.column(names.index("length"))) * span + rank, side="right") - 1]
            kept = {n: batch.column(i) for i, n in enumerate(names) if n != "rank"}
            yield pa.record_batch(kept | {"sequence_id": pa.array(row[:, 3] + rank - row[:, 1]), "offset": pa.array(row[:, 4])})

    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    schema = ranked.select(*columns).schema.add("sequence_id", "long").add("offset", "long")
    return settle(ranked.select(*columns, "rank").mapInArrow(place, schema))


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and the ids of each sequence, from ``pack(..., with_ids=True)``; a group holds one sequence's tokens at most."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, byte-level vocabulary, sequences of 2,048 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op3_packing": op3_packing}
ORACLE_SQL: dict[str, str] = {}
