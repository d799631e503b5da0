"""Operator 6: benchmark decontamination by winnowing. Native: DataFrame functions only.

Words of both sides are hashed, then K-grams of words. Of each run of W consecutive K-grams the least hash (the last of equal
ones) is a fingerprint; neighbouring runs mostly share theirs, so few positions are kept. A window of K + W - 1 = SPAN
words that stands on both sides has its fingerprint at the same place there: joining fingerprints misses no shared window.
A joined pair is extended word by word to either side; SPAN equal words or more in a row are a hit. Reaching W - 1 words
to either side is enough, as each window of a longer shared passage holds a fingerprint of its own.

A shorter benchmark item is one window. If it has K words, its first K-gram is looked up among all of a text's; if
not, all runs of so many words are.
"""

from __future__ import annotations

import json
import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import materialize, partitions_of, settle

SPAN, K = 10, 5
W = SPAN - K + 1
#: Distinct benchmark fingerprints up to which they are compared exactly within each row, before the join; more pass a bitmap of BITMAP bits there. What passes is joined and compared by words either way.
MOST_INLINE, BITMAP = 20_000, 1 << 24

_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; null has none."""
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lower, _BREAK), "")


def _upto(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def _run(i: Column, n: int) -> Column:
    """The hash of the n words from the i-th on."""
    return F.xxhash64(*(F.get("hw", i + (t - 1)) for t in range(n)))


def _is_fingerprint(i: Column) -> Column:
    """Whether the i-th K-gram is the last least one of a run of W: so many of its neighbours on either side aren't less (to the left) or are greater (to the right)."""
    own = F.get("kg", i - 1)
    left = right = F.lit(0)
    for t in range(W - 1, 0, -1):
        left = F.when(F.get("kg", i - 1 - t) >= own, left + 1).otherwise(0)
        right = F.when(F.get("kg", i - 1 + t) > own, right + 1).otherwise(0)
    return left + right >= W - 1


def _with_grams(df: DataFrame) -> DataFrame:
    """Adds to words w their hashes hw and those of K-grams, kg. Each step is a projection whose columns the next uses more than once, so none is worked out again for each element."""
    df = df.withColumn("hw", F.transform("w", lambda x: F.xxhash64(x)))
    return df.withColumn("kg", F.transform(_upto(F.size("hw") - (K - 1)), lambda i: _run(i, K)))


def _place(i: Column, gram: int, print_: Column, **more: Column) -> Column:
    return F.struct(i.alias("at"), F.lit(gram).alias("gram"), print_.alias("print"), *(v.alias(k) for k, v in more.items()))


def _around(at: Column) -> Column:
    """The words from W - 1 before a place to SPAN - 1 after it; null beyond the text."""
    return F.transform(F.sequence(F.lit(-W), F.lit(SPAN - 2)), lambda t: F.get("w", at + t))


def _known(prints: DataFrame) -> Callable[[Column], Column] | None:
    """A test for a column of fingerprints: exact for few, by a bitmap of fixed size (built as 64-bit words, so BITMAP / 64 rows at most) for many; None if there are none."""
    few = [r[0] for r in prints.limit(MOST_INLINE + 1).collect()]
    if len(few) <= MOST_INLINE:
        return (lambda x: x.isin(few)) if few else None
    bit = F.pmod("print", F.lit(BITMAP))
    rows = prints.groupBy((bit / 64).cast("int").alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(pmod(print, {BITMAP}) % 64 AS int))")).alias("bits")).collect()
    bits = [0] * (BITMAP // 64)
    for r in rows:
        bits[r.at] = r.bits
    table = F.from_json(F.lit(json.dumps(bits)), "array<bigint>")

    def test(x: Column) -> Column:
        at = F.pmod(x, F.lit(BITMAP))
        return F.getbit(F.get(table, (at / 64).cast("int")), (at % 64).cast("int")) == 1

    return test


def _of_benchmark(benchmark: DataFrame) -> DataFrame:
    """Fingerprints of the items: gram, print, size (words of a window), around and item_id; distinct, so that repeated items count once."""
    items = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    items = _with_grams(items)
    n = F.size("w")
    whole = F.coalesce(*(F.when(n == m, F.array(_place(F.lit(1), m, _run(F.lit(1), m)))) for m in range(1, K)))
    first = F.array(_place(F.lit(1), K, F.get("kg", F.lit(0))))
    sparse = F.transform(F.filter(_upto(F.size("kg")), _is_fingerprint), lambda i: _place(i, K, F.get("kg", i - 1)))
    places = F.when(n >= SPAN, sparse).when(n >= K, first).otherwise(whole)
    rows = items.select("item_id", "w", F.least(n, F.lit(SPAN)).alias("size"), F.explode_outer(places).alias("x"))
    rows = rows.select("item_id", "size", "x.gram", "x.print", _around(F.col("x.at")).alias("around"))
    return materialize(rows.distinct(), "benchmark-prints")


def _all_runs(m: int, test: Callable[[Column], Column]) -> Column:
    """Places of all runs of m words that pass."""
    return F.transform(F.filter(_upto(F.size("hw") - (m - 1)), lambda i: test(_run(i, m))), lambda i: _place(i, m, _run(i, m)))


def _candidates(docs: DataFrame, known: DataFrame) -> DataFrame:
    """``docs`` (row, w and others), w replaced by n_words and found: the places whose fingerprint the benchmark has, with the words around them."""
    long = _known(known.where(F.col("size") == SPAN).select("print").distinct())
    first = _known(known.where((F.col("size") < SPAN) & (F.col("gram") == K)).select("print").distinct())
    tests = {m: test for m in range(1, K) if (test := _known(known.where(F.col("gram") == m).select("print").distinct()))}
    rows = _with_grams(docs)

    def passes(i: Column) -> Column:
        own = F.get("kg", i - 1)
        out = long(own) & _is_fingerprint(i) if long else F.lit(False)
        return out | first(own) if first else out

    parts = [F.transform(F.filter(_upto(F.size("kg")), passes), lambda i: _place(i, K, F.get("kg", i - 1)))]
    parts += [_all_runs(m, test) for m, test in tests.items()]
    rows = rows.withColumn("places", F.concat(*parts) if len(parts) > 1 else parts[0]).drop("hw", "kg")
    found = F.transform("places", lambda x: F.struct(x["at"].alias("at"), x["gram"].alias("gram"), x["print"].alias("print"), _around(x["at"]).alias("around")))
    return rows.withColumn("n_words", F.size("w").cast("long")).withColumn("found", found).drop("w", "places")


def _hits(rows: DataFrame, known: DataFrame) -> DataFrame:
    """row, start, end (words, from 1, end exclusive) and item_id of what the benchmark shares with candidates."""
    each = rows.where(F.size("found") > 0).select("row", F.explode("found").alias("x")).select("row", "x.at", "x.gram", "x.print", F.col("x.around").alias("own"))
    pairs = each.join(known, ["gram", "print"])
    same = [F.coalesce(F.get("own", F.lit(t)) == F.get("around", F.lit(t)), F.lit(False)) for t in range(SPAN + W - 1)]
    left = right = F.lit(0)
    for t in range(W - 1):
        left = F.when(same[t], left + 1).otherwise(0)
        right = F.when(same[SPAN + W - 2 - t], right + 1).otherwise(0)
    core, short = F.lit(True), F.lit(True)
    for t in range(W - 1, SPAN + W - 1):
        core = core & same[t] if t < W - 1 + K else core
        short = short & (same[t] | F.get("around", F.lit(t)).isNull())
    is_long = F.col("size") == SPAN
    start = F.when(is_long, F.col("at") - left).otherwise(F.col("at"))
    end = F.when(is_long, F.col("at") + K + right).otherwise(F.col("at") + F.col("size"))
    ok = F.when(is_long, core & (left + right + K >= SPAN)).otherwise(short)
    return pairs.where(ok).select("row", start.alias("start"), end.alias("end"), "item_id")


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are left out), repeated ones too: doc_id, n_words, n_hit (words inside any occurrence of a window), items (sorted item ids, as strings), hits (start and end word of shared passages of SPAN to SPAN + W - 1 words and of whole shorter items, from 1, end exclusive).

    ``benchmark`` has item_id and text. Items without words hit nothing; a null item_id is left out; repeated items
    count once. An empty table on either side gives no hits. Null text has no words.
    """
    known = _of_benchmark(benchmark)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text")).alias("w"))
    rows = materialize(_candidates(rows, known), "candidates", partitions_of(docs.select("doc_id", "text")))
    found = _hits(rows, known).groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("hits"), F.array_sort(F.collect_set("item_id")).alias("items"))
    some = rows.where(F.size("found") > 0).select("row", "doc_id", "n_words").join(found, "row", "left")
    covered = F.expr("aggregate(hits, named_struct('n', 0L, 'upto', 0), (a, x) -> named_struct('n', a.n + greatest(0, x.end - greatest(a.upto, x.start)), 'upto', greatest(a.upto, x.end)), a -> a.n)")
    none = {"items": F.array().cast("array<string>"), "hits": F.array().cast("array<struct<start:int,end:int>>")}
    some = some.select("doc_id", "n_words", F.coalesce(covered, F.lit(0)).cast("long").alias("n_hit"), *(F.coalesce(k, v).alias(k) for k, v in none.items()))
    clean = rows.where(F.size("found") == 0).select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), *(v.alias(k) for k, v in none.items()))
    return clean.unionByName(some)


def drop(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text holds no window of the benchmark, with all their columns. Null texts stay.

    The rows are written once with their candidates; only those that have any meet the benchmark and are shuffled.
    """
    known = _of_benchmark(benchmark)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*docs.columns).alias("doc"), words(F.col("text")).alias("w"))
    rows = materialize(_candidates(rows, known), "candidates", partitions_of(docs))
    hit = _hits(rows, known).select("row").distinct()
    some = rows.where(F.size("found") > 0).select("row", "doc").join(hit, "row", "left_anti")
    return rows.where(F.size("found") == 0).select("doc").unionAll(some.select("doc")).select("doc.*")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document shares with ``benchmark``."""
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


QUERIES = {"op6_decontamination": op6_decontamination}

_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = {
    "op6_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_SQL_WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_SQL_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT item_id, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s, w FROM i WHERE len(w) > 0),
known AS (SELECT DISTINCT item_id, n, array_to_string(w[s : s + n - 1], ' ') AS window FROM iw),
sizes AS (SELECT DISTINCT n FROM known),
dw AS (SELECT rid, n, s, array_to_string(w[s : s + n - 1], ' ') AS window FROM (SELECT rid, n, w, unnest(range(1, len(w) - n + 2)) AS s FROM d CROSS JOIN sizes WHERE len(w) >= n) x),
hit AS (SELECT rid, s, dw.n, item_id FROM dw JOIN known ON dw.n = known.n AND dw.window = known.window),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT rid, s, n FROM hit) y) z GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT rid, item_id FROM hit) y GROUP BY rid)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON d.rid = pos.rid LEFT JOIN its ON d.rid = its.rid""",
}
