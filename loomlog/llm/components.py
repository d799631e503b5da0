"""Connected components of a graph given as edges, by alternating large-star and small-star steps.

Edges stay in tables; each round is written to the shared folder. Only whether they are stars reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize

#: Rounds without an end would be an error of the program: the number of rounds grows with the logarithm of a component's size.
MOST_ROUNDS = 100


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """m: the least of u and its neighbours, for every u of directed edges u -> v. Minima are taken before the shuffle, so a hub costs a row per task; they are
    written, so that the join with them shuffles both sides and a hub's edges can be split between tasks."""
    return materialize(edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m")), "least")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined = both.join(_least_neighbour(both), F.col("u") == F.col("k"))
    return joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v")
    joined = down.join(_least_neighbour(down), F.col("u") == F.col("k"))
    out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(joined.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge down at most and none that leads to it from above has one: then edges lead to their components' least nodes."""
    twice = edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1")
    inner = edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi")
    return twice.isEmpty() and inner.isEmpty()


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """node and component (the least node that can be reached) of every node with an edge to another; nodes are longs. Null ends, loops and repeated edges don't matter."""
    ends = F.col(u).isNotNull() & F.col(v).isNotNull() & (F.col(u) != F.col(v))
    now = materialize(edges.where(ends).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), "edges")
    for _ in range(MOST_ROUNDS):
        if _are_stars(now):
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        now = materialize(_small_star(_large_star(now)), "edges")
    raise RuntimeError("components did not settle")
