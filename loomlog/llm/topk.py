"""Operator 9: exact top-k inner-product search by norm buckets.

Vectors are grouped by length into buckets, each longer than the last by LADDER at most; a bucket is dealt out as blocks. A sample
from the longest buckets gives each query a score that its k-th answer reaches at least, and with it the length that a
vector must have. Queries stand in groups by that length; a group is sent to the parts of the data and meets there, from
the longest on, the blocks of the buckets that can reach it and no others. The group's queries and their k best so far
are held by the task, the blocks pass by, so each query's k-th score rises over all the blocks of a part. Nothing is
joined: Spark takes exploded rows for as few as there were before, and would broadcast them through the driver.

Within a block vectors stand by length again. A run whose longest vector can't reach a query's k-th score so far is left
out. In the others that score gives a local cosine threshold: where it is high, candidates must lie near the query in
its largest coordinate; where it is low or most of a run lies near, they must be long enough. Products of candidates are
then computed exactly: in floats that hold all integers up to the product of the lengths, or else in integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import materialize, settle, small_batches

#: Vectors of a data block, of queries multiplied at once, of a run within a block. A block stays below the half megabyte from which on the JVM gives an object regions of its own.
DATA_BLOCK, QUERY_BLOCK, BUCKET = 2_048, 1_024, 1_024
#: Queries that a task holds, and their bytes at most (with a copy in floats); bytes of a block as longs, and of the blocks that a task fills.
QUERY_GROUP, GROUP_BYTES, BLOCK_BYTES, FILLED_BYTES = 98_304, 128_000_000, 2_000_000, 32_000_000
#: Blocks are as large as a page should be, but Parquet looks at the sizes of pages and row groups only after 100 rows. Snappy would hold a page outside the heap, and finds nothing in such data.
ROOMY = {"compression": "none", "parquet.block.size": 8_000_000, "parquet.page.size.row.check.min": 1, "parquet.block.size.row.check.min": 1}
#: Ratio of the lengths that a bucket spans: there are some 500 buckets for all lengths that longs can have.
LADDER = 1.1
#: Vectors that queries are first compared with, and their bytes at most.
SEEDS, SEED_BYTES = 2_048, 4_000_000
#: Local cosine threshold from which on a run is pruned by a coordinate, where that leaves one in so many of its vectors.
BY_COORDINATE, SPARSE = 0.3, 64
#: Numbers of pairs of vectors that are multiplied at once where a coordinate has pruned.
PAIRS = 4_000_000
#: Blocks of a part at least, beyond so many parts: each part gives k answers to a query.
PART_BLOCKS, PARTS = 64, 24
#: Stands for no score.
NONE = np.iinfo(np.int64).min


def scaled(embedding: Column) -> Column:
    """Components as floor(1024 * x)."""
    return F.transform(embedding, lambda x: F.floor(F.lit(1024.0) * x.cast("double")).cast("long"))


def usable(embedding: Column) -> Column:
    """Not null, and all components finite."""
    return embedding.isNotNull() & F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))


def _matrix(lists: pa.Array) -> np.ndarray:
    """Vectors as rows; shorter ones are filled up with zeros."""
    sizes = np.asarray(pc.list_value_length(lists)).astype(np.int64)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = np.asarray(lists.flatten()).astype(np.int64)
    return out


def _lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x.astype(np.float64) ** 2).sum(1))


def _packed(x: np.ndarray) -> dict[str, pa.Array]:
    """A matrix as one row: n, width, bytes of a number (the fewest that do), data."""
    most, least = int(x.max(initial=0)), int(x.min(initial=0))
    kind = next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= least and most <= np.iinfo(t).max)
    return {"n": pa.array([len(x)], pa.int32()), "width": pa.array([x.shape[1]], pa.int32()), "size": pa.array([np.dtype(kind).itemsize], pa.int32()), "data": pa.array([x.astype(kind).tobytes()], pa.binary())}


def _longs(batch: pa.RecordBatch, name: str, i: int) -> np.ndarray:
    return np.frombuffer(batch.column(name)[i].as_buffer(), np.int64)


def _unpacked(batch: pa.RecordBatch, i: int) -> np.ndarray:
    n, width, size = (batch.column(c)[i].as_py() for c in ("n", "width", "size"))
    return np.frombuffer(batch.column("data")[i].as_buffer(), f"<i{size}").reshape(n, width)


def _stack(parts: list[np.ndarray]) -> np.ndarray:
    """Matrices on top of each other; narrower ones are filled up with zeros."""
    width = max(x.shape[1] for x in parts)
    return np.concatenate([np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x for x in parts])


def _blocks(rows: DataFrame) -> DataFrame:
    """Rows (id, v) as blocks of up to DATA_BLOCK of one bucket (-1 for length zero), each from one partition: bucket, low (its least id), ids, and the vectors as n, width, size, data."""
    most = DATA_BLOCK

    def cut(bucket: int, held: list[tuple[np.ndarray, np.ndarray]], least: int) -> Iterator[pa.RecordBatch]:
        """Blocks of what is held, as long as it has so many rows."""
        ids, x = np.concatenate([i for i, _ in held]), _stack([x for _, x in held])
        step, lo = max(1, min(most, BLOCK_BYTES // (8 * max(x.shape[1], 1)))), 0
        while len(ids) - lo >= least:
            some = ids[lo : lo + step]
            yield pa.record_batch({"bucket": pa.array([bucket], pa.int32()), "low": pa.array([int(some.min())], pa.int64()), "ids": pa.array([some.tobytes()], pa.binary())} | _packed(x[lo : lo + step]))
            lo += len(some)
        held[:] = [(ids[lo:], x[lo:])] if lo < len(ids) else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            ids, x = np.asarray(batch.column(0)).astype(np.int64), _matrix(batch.column(1))
            length = _lengths(x)
            bucket = np.where(length > 0, np.floor(np.log(np.maximum(length, 1)) / np.log(LADDER)), -1).astype(np.int64)
            for b in np.unique(bucket).tolist():
                to = held.setdefault(b, [])
                to.append((ids[bucket == b], x[bucket == b]))
                if sum(len(i) for i, _ in to) >= most:
                    yield from cut(b, to, most)
            if sum(x.nbytes for to in held.values() for _, x in to) > FILLED_BYTES:
                for b in list(held):
                    yield from cut(b, held[b], 1) if held[b] else ()
        for b in list(held):
            yield from cut(b, held[b], 1) if held[b] else ()

    return rows.select("id", "v").mapInArrow(run, "bucket int, low long, ids binary, n int, width int, size int, data binary")


class Asked:
    """Queries and their k best so far of the blocks they have met, by score and then by the smaller id; vectors with the query's own id don't count, nor do scores below ``floors`` (NONE: no floor)."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, floors: np.ndarray | None = None) -> None:
        self.ids, self.q, self.k = ids, q, k
        self.length = _lengths(q)
        self.longest = float(self.length.max(initial=0))
        self.focus = np.abs(q.astype(np.float64)).argmax(1) if q.shape[1] else np.zeros(len(q), np.int64)
        value = np.take_along_axis(q, self.focus[:, None], 1)[:, 0] if q.shape[1] else np.zeros(len(q))
        self.at = np.abs(value.astype(np.float64)) / np.maximum(self.length, 1e-300)
        self.side = (value < 0).astype(np.int64)
        self.rest = np.sqrt(np.maximum(0.0, 1 - self.at**2))
        self.floors = np.full(len(q), NONE) if floors is None else floors
        self.least = self.floors.copy()
        self.score, self.id = np.full((len(q), k), NONE), np.full((len(q), k), np.iinfo(np.int64).max)
        self._as: dict[type, np.ndarray] = {}
        self._rooms: dict[type, np.ndarray] = {}

    def _queries(self, kind: type) -> np.ndarray:
        if kind not in self._as:
            self._as[kind] = self.q.astype(kind)
        return self._as[kind]

    def meet(self, ids: np.ndarray, x: np.ndarray) -> bool:
        """Search a block; whether any of its vectors could reach a query."""
        if not len(ids) or not len(self.q):
            return False
        norm = _lengths(x)
        order = np.lexsort((ids, -norm))
        ids, norm, width = ids[order], norm[order], self.q.shape[1]
        most = self.longest * float(norm[0]) * (1 + 1e-6)  # no sum of some of a product's terms is larger
        kind = np.float32 if most < 2.0**24 else np.float64 if most < 2.0**53 else np.int64 if most < 2.0**62 else object
        x = x[order, :width].astype(kind)
        if x.shape[1] < width:
            x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
        met = False
        for lo in range(0, len(ids), BUCKET):
            hi = min(lo + BUCKET, len(ids))
            if not self._run(ids[lo:hi], x[lo:hi], norm[lo:hi], kind):
                break  # all later vectors are shorter still
            met = True
        return met

    def _run(self, ids: np.ndarray, x: np.ndarray, norm: np.ndarray, kind: type) -> bool:
        least, reach = self.least.astype(np.float64), self.length * float(norm[0])
        bound = least > 0
        active = ~(bound & (least > reach * (1 + 1e-9)))
        if not active.any():
            return False
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.where(bound & (reach > 0), np.minimum(1.0, least / reach), 0.0)
        near = active & (cosine >= BY_COORDINATE)
        if near.any():
            # beyond the query on the side of its sign nothing is too far: the cap may hold the axis itself
            edge = self.at * cosine - np.sqrt(np.maximum(0.0, 1 - cosine**2)) * self.rest - 1e-9
            unit = (x.astype(np.float64) / np.maximum(norm, 1e-300)[:, None]).T
            order = np.argsort(unit, axis=1)
            unit = np.take_along_axis(unit, order, 1)
            few = len(ids) // SPARSE
            near &= edge > np.stack([unit[:, len(ids) - 1 - few], -unit[:, few]])[self.side, self.focus]
            if near.any():
                self._sparse(np.flatnonzero(near), edge, ids, x, unit, order, kind)
        self._dense(np.flatnonzero(active & ~near), ids, x, norm, kind)
        return True

    def _sparse(self, some: np.ndarray, edge: np.ndarray, ids: np.ndarray, x: np.ndarray, unit: np.ndarray, order: np.ndarray, kind: type) -> None:
        """Pairs of the queries ``some`` and the vectors that lie beyond ``edge`` in the query's largest coordinate; unit and order: coordinates by size."""
        n, q = len(ids), self._queries(kind)
        step = max(1, min(4 * QUERY_BLOCK, PAIRS // max(1, n // SPARSE * len(unit))))
        flat = (unit + 4.0 * np.arange(len(unit))[:, None]).ravel()
        for lo in range(0, len(some), step):
            mine = some[lo : lo + step]
            focus, negative = self.focus[mine], self.side[mine] == 1
            first = np.where(negative, focus * n, np.searchsorted(flat, edge[mine] + 4.0 * focus, side="left"))
            end = np.where(negative, np.searchsorted(flat, 4.0 * focus - edge[mine], side="right"), (focus + 1) * n)
            count = np.maximum(end - first, 0)
            if not count.any():
                continue
            at = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
            rows, asked = order.ravel()[at], np.repeat(mine, count)
            self._take(asked, ids[rows], (x[rows] * q[asked]).sum(1))

    def _dense(self, some: np.ndarray, ids: np.ndarray, x: np.ndarray, norm: np.ndarray, kind: type) -> None:
        """All products of the queries ``some`` with the vectors that are long enough for one of them."""
        q, low = self._queries(kind), ids.min()
        for lo in range(0, len(some), QUERY_BLOCK):
            mine = some[lo : lo + QUERY_BLOCK]
            least = self.least[mine]
            n = len(ids)
            if least.min() > 0:
                shortest = float((least / self.length[mine]).min()) * (1 - 1e-9)
                n = int(np.searchsorted(-norm, -shortest, side="right"))
            # where the k-th has a smaller id than all of these, they must beat it
            from_ = least + ((self.score[mine, -1] == least) & (self.id[mine, -1] < low) & (least > NONE))
            if kind in (np.float32, np.float64):
                from_ = np.where(from_ == NONE, -np.inf, from_).astype(kind)
            mine_q = q[mine[0] : mine[-1] + 1] if mine[-1] - mine[0] + 1 == len(mine) else q[mine]
            score = np.matmul(mine_q, x[:n].T, out=self._room(kind, len(mine), n))
            hit = self._hits(score, from_)
            if len(hit) > 4 * self.k * len(mine):
                # most of them aren't among the k best of this run
                score[ids[None, :n] == self.ids[mine][:, None]] = -np.inf if score.dtype.kind == "f" else NONE
                hit = self._hits(score, np.maximum(from_, np.partition(score, n - min(n, self.k), axis=1)[:, n - min(n, self.k)]))
            if len(hit):
                row, column = np.divmod(hit, n)
                self._take(mine[row], ids[column], score.ravel()[hit])

    def _room(self, kind: type, rows: int, columns: int) -> np.ndarray:
        """Memory for products or for their tests, the same each time."""
        if kind not in self._rooms:
            self._rooms[kind] = np.empty(QUERY_BLOCK * BUCKET, kind)
        return self._rooms[kind][: rows * columns].reshape(rows, columns)

    def _hits(self, score: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Places, in one count over all rows, of what reaches its row's least."""
        test = np.greater_equal(score, least[:, None], out=self._room(bool, *score.shape))
        rows = np.flatnonzero(test.any(1))
        at = np.flatnonzero(test[rows])
        return rows[at // score.shape[1]] * score.shape[1] + at % score.shape[1]

    def _take(self, row: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Put these among the k best of the queries ``row``, which ascend."""
        score, k = score.astype(np.int64), self.k
        last = self.score[row, -1]
        good = (ids != self.ids[row]) & (score >= self.floors[row]) & ((score > last) | ((score == last) & (ids < self.id[row, -1])))
        row, ids, score = row[good], ids[good], score[good]
        if not len(row):
            return

        def numbered() -> np.ndarray:
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            return np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)]))

        nth = numbered()
        if nth.max() >= k:
            best = np.lexsort((ids, -score, row))
            row, ids, score = row[best], ids[best], score[best]
            best = numbered() < k
            row, ids, score = row[best], ids[best], score[best]
            nth = numbered()
        for i in range(int(nth.max()) + 1):
            at = np.flatnonzero(nth == i)
            r, own_i, own_s = row[at], ids[at][:, None], score[at][:, None]
            s, other = self.score[r], self.id[r]
            place = ((s > own_s) | ((s == own_s) & (other < own_i))).sum(1)[:, None]
            column = np.arange(k)[None, :]
            self.score[r] = np.where(column < place, s, np.where(column == place, own_s, np.concatenate([s[:, :1], s[:, :-1]], 1)))
            self.id[r] = np.where(column < place, other, np.where(column == place, own_i, np.concatenate([other[:, :1], other[:, :-1]], 1)))
        row = row[nth == 0]
        self.least[row] = np.maximum(self.floors[row], self.score[row, -1])

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of queries, ids and scores, the best first."""
        there = (self.score > NONE) | (self.id < np.iinfo(np.int64).max)
        return np.repeat(np.arange(len(self.q)), there.sum(1)), self.id[there], self.score[there]


def search(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, floors: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(index of the query, vector id, score): each query's k best of one block, as ``Asked`` has them."""
    asked = Asked(query_ids, q, k, floors)
    asked.meet(ids, x)
    return list(zip(*(a.tolist() for a in asked.found()), strict=True))


def _seeds(blocks: DataFrame, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of about that share of the blocks' rows, evenly spread."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                n = batch.column("n")[i].as_py()
                step = np.floor(np.arange(n + 1) * share + batch.column("start")[i].as_py())
                pick = np.flatnonzero(step[1:] > step[:-1])
                if len(pick):
                    yield pa.record_batch({"ids": pa.array([_longs(batch, "ids", i)[pick].tobytes()], pa.binary())} | _packed(_unpacked(batch, i)[pick]))

    found = blocks.select("n", "width", "size", "ids", "data", F.rand(1).alias("start")).mapInArrow(run, "ids binary, n int, width int, size int, data binary").toArrow().to_batches()
    rows = [(b, i) for b in found for i in range(b.num_rows)]
    if not rows:
        return np.zeros(0, np.int64), np.zeros((0, 0), np.int64)
    return np.concatenate([_longs(b, "ids", i) for b, i in rows]), _stack([_unpacked(b, i) for b, i in rows]).astype(np.int64)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows of ``vectors`` with the highest integer inner product with each row of ``queries``.

    Both have vec_id (long) and v (array of long). Ties go to the smaller vec_id; rows with the query's own id don't
    count, even repeated ones; fewer vectors than k give fewer rows. Each row of ``queries`` is answered, repeated ones
    and those that share an id, too. Rows with null vec_id or v take no part. Vectors of different lengths are compared
    as if filled up with zeros.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    usable_, vec_id = F.col("vec_id").isNotNull() & F.col("v").isNotNull(), F.col("vec_id").cast("long")
    empty = "query_id long, rank int, vec_id long, score long"
    blocks = materialize(_blocks(vectors.where(usable_).select(vec_id.alias("id"), "v")), "blocks", **ROOMY)
    counts = {r.bucket: r for r in blocks.groupBy("bucket").agg(F.sum("n").alias("n"), F.max("width").alias("width"), F.count("*").alias("blocks")).collect()}
    if not counts:
        return spark.createDataFrame([], empty)
    ladder = sorted(counts)
    # from the longest buckets on, as many vectors as seeds are wanted, evenly thinned
    wanted = max(k, min(SEEDS, SEED_BYTES // (8 * max(max(r.width for r in counts.values()), 1))))
    there = np.cumsum([counts[b].n for b in ladder[::-1]])
    last = min(int(np.searchsorted(there, wanted)), len(ladder) - 1)
    seed_ids, seed_data = _seeds(blocks.where(F.col("bucket") >= ladder[::-1][last]), min(1.0, wanted / int(there[last])))

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, data = np.asarray(batch.column(1)).astype(np.int64), _matrix(batch.column(2))
            asked = Asked(ids, data, k)
            asked.meet(seed_ids, seed_data)
            floor = asked.score[:, -1]
            with np.errstate(divide="ignore", invalid="ignore"):
                # vectors of a bucket are shorter than LADDER ** (bucket + 1)
                lowest = np.floor(np.log(floor / asked.length) / np.log(LADDER) - 1 - 1e-6)
            lowest = np.where((floor > 0) & (asked.length > 0), lowest, -1)
            yield pa.record_batch({"row": batch.column(0), "vec_id": batch.column(1), "v": batch.column(2), "floor": pa.array(floor), "lowest": pa.array(np.maximum(lowest, -1).astype(np.int32))})

    asked = queries.where(usable_).select(F.monotonically_increasing_id().alias("row"), vec_id.alias("vec_id"), "v")
    asked = materialize(asked.mapInArrow(reach, "row long, vec_id long, v array<long>, floor long, lowest int"), "queries")
    by_lowest = asked.groupBy("lowest").agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).orderBy("lowest").collect()
    if not by_lowest:
        return spark.createDataFrame([], empty)
    # groups of equal size by the lowest of the buckets that their queries ask for
    size = max(1, min(QUERY_GROUP, GROUP_BYTES // (16 * k + 16 * max(r.width for r in by_lowest) + 64)))
    ends = np.cumsum([r.n for r in by_lowest]).tolist()
    groups = [(g, by_lowest[int(np.searchsorted(ends, g * size, side="right"))].lowest) for g in range(-(-ends[-1] // size))]
    starts = F.create_map(*(F.lit(y) for r, end in zip(by_lowest, ends, strict=True) for y in (r.lowest, F.struct(F.lit(end - r.n).alias("start"), F.lit(r.n).alias("n")))))
    place = F.element_at(starts, F.col("lowest"))
    packs = _packs(asked.withColumn("group", F.floor((place["start"] + F.floor(F.rand(2) * place["n"])) / size).cast("int")))
    # each part of the blocks meets each group
    all_ = sum(r.blocks for r in counts.values())
    parts = max(1, min(all_, max(PARTS, all_ // PART_BLOCKS), -(-8 * spark.sparkContext.defaultParallelism // len(groups))))
    known = F.array(*(F.struct(F.lit(g).alias("group"), F.lit(b).alias("lowest")) for g, b in groups))
    dealt = blocks.withColumn("part", F.pmod(F.monotonically_increasing_id() + F.spark_partition_id(), F.lit(parts)).cast("int"))
    dealt = dealt.select("*", F.explode(F.filter(known, lambda x: x["lowest"] <= F.col("bucket"))).alias("x"))
    none = F.lit(None).cast("binary")
    dealt = dealt.select("x.group", "part", (F.col("bucket") * -1).alias("turn"), "low", "n", "width", "size", "data", "ids", none.alias("rows"), none.alias("floors"))
    sent = packs.select("group", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(None).cast("int").alias("turn"), F.lit(0).cast("long").alias("low"), "n", "width", "size", "data", "ids", "rows", "floors")
    # queries come first, as their turn is null; then the longest vectors
    met = sent.unionByName(dealt).repartition(4 * parts * len(groups), "group", "part").sortWithinPartitions("group", "part", F.asc_nulls_first("turn"), "low")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, packs_, queries_ = None, [], None

        def out() -> Iterator[pa.RecordBatch]:
            if queries_ is not None:
                number, ids, score = queries_.found()
                rows = np.concatenate([p[0] for p in packs_])
                for lo in range(0, len(number), 65_536):
                    some = number[lo : lo + 65_536]
                    yield pa.record_batch({"row": pa.array(rows[some]), "query_id": pa.array(queries_.ids[some]), "vec_id": pa.array(ids[lo : lo + 65_536]), "score": pa.array(score[lo : lo + 65_536])})

        for batch in batches:
            for i in range(batch.num_rows):
                key = batch.column("group")[i].as_py(), batch.column("part")[i].as_py()
                if key != here:
                    yield from out()
                    here, packs_, queries_ = key, [], None
                if batch.column("turn")[i].as_py() is None:
                    packs_.append((_longs(batch, "rows", i).copy(), _longs(batch, "ids", i).copy(), _longs(batch, "floors", i).copy(), _unpacked(batch, i).copy()))
                    continue
                if queries_ is None and packs_:
                    queries_ = Asked(np.concatenate([p[1] for p in packs_]), _stack([p[3] for p in packs_]), k, np.concatenate([p[2] for p in packs_]))
                    packs_ = [(p[0],) for p in packs_]
                if queries_ is not None:
                    queries_.meet(_longs(batch, "ids", i), _unpacked(batch, i))
        yield from out()

    found = met.mapInArrow(run, "row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return settle(found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))


def _packs(rows: DataFrame) -> DataFrame:
    """Query rows (row, vec_id, floor, v, group) as packs of up to QUERY_BLOCK of one group."""
    most = QUERY_BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            group, step = np.asarray(batch.column(0)), max(1, min(most, BLOCK_BYTES // (8 * max(pc.max(pc.list_value_length(batch.column(4))).as_py(), 1))))
            edges = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:], strict=False):
                for lo in range(a, b, step):
                    part = batch.slice(lo, min(step, b - lo))
                    row, ids, floors = (pa.array([np.asarray(part.column(c)).astype(np.int64).tobytes()], pa.binary()) for c in (1, 2, 3))
                    yield pa.record_batch({"group": pa.array([int(group[lo])], pa.int32()), "rows": row, "ids": ids, "floors": floors} | _packed(_matrix(part.column(4))))

    return rows.select("group", "row", "vec_id", "floor", "v").sortWithinPartitions("group").mapInArrow(run, "group int, rows binary, ids binary, floors binary, n int, width int, size int, data binary")


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every hundredth vector among all others."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(usable(F.col("embedding"))).select("vec_id", scaled(F.col("embedding")).alias("v"))
    return top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))


QUERIES = {"op9_top_k": op9_top_k}
ORACLE_SQL = {
    "op9_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024.0::DOUBLE * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT row_number() OVER () AS query, * FROM v WHERE vec_id % 100 = 0),
s AS (SELECT query, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))) AS BIGINT) AS score
      FROM q JOIN v c ON q.vec_id <> c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
}
