"""Registered queries: a DataFrame plan and, side by side, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomlog.sources.fixtures import PROLOGUE, Fixtures


class Registry:
    """Queries over the fixtures of a data directory. SQL is appended to the fixtures' prologue (as a further CTE, if it begins with a comma)."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None, prologue: bool = True) -> Callable:
        def register(plan: Callable[[Fixtures], DataFrame]) -> Callable[[Fixtures], DataFrame]:
            self.queries[name] = lambda spark, sf_dir: plan(Fixtures(spark, sf_dir))
            if sql is not None:
                self.sql[name] = PROLOGUE + sql if prologue else sql
            return plan

        return register


def by_group_patterns(rows: list[tuple[int, str]]) -> dict[int, list[str]]:
    out: dict[int, list[str]] = {}
    for group, pattern in rows:
        out.setdefault(group, []).append(pattern)
    return out
