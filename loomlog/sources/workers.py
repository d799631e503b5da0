"""Workers and their live instances, as tables of a topic (by default the catalog's)."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.errors import InstanceLost, NotFound
from loomlog.sources.store import Topic


class Workers:
    WORKER = "worker_id long, name string, topic_id long, group_id long, target int"
    INSTANCE = "token string, worker_id long, failures int, expires_at timestamp_ntz"

    def __init__(self, store: Topic):
        self.store = store

    def _rows(self, table: str, schema: str, version: int | None = None) -> DataFrame:
        found = self.store.read(table, version)
        return found if found is not None else self.store.spark.createDataFrame([], schema)

    def list_workers(self) -> DataFrame:
        return self._rows("worker", self.WORKER)

    def instances(self) -> DataFrame:
        return self._rows("worker_instance", self.INSTANCE)

    def register(self, name: str, topic_id: int | None = None, group_id: int | None = None, target: int = 1) -> int:
        """The worker's id. Name and owner (nulls count as values) make a worker; registering again changes its target: -1 means without a bound, 0 none."""

        def change(base: int) -> tuple[dict[str, Any], int]:
            rows = self._rows("worker", self.WORKER, base).collect()
            found = next((r for r in rows if (r.name, r.topic_id, r.group_id) == (name, topic_id, group_id)), None)
            key = found.worker_id if found else max((r.worker_id for r in rows), default=0) + 1
            new = [tuple(r) for r in rows if r.worker_id != key] + [(key, name, topic_id, group_id, target)]
            return {"replace": {"worker": self.store.spark.createDataFrame(new, self.WORKER).coalesce(1)}}, key

        return self.store.update(change)

    def claim(self, worker_id: int, as_of: datetime, ttl: timedelta) -> str | None:
        """The token of a new instance; None if as many live as the worker's target."""

        def change(base: int) -> tuple[dict[str, Any], str | None]:
            worker = self._rows("worker", self.WORKER, base).where(F.col("worker_id") == worker_id).head()
            if worker is None:
                raise NotFound(f"worker {worker_id}")
            rows = self._rows("worker_instance", self.INSTANCE, base).collect()
            if worker.target != -1 and sum(r.worker_id == worker_id and r.expires_at > as_of for r in rows) >= worker.target:
                return {}, None
            token = uuid.uuid4().hex
            return self._with([*map(tuple, rows), (token, worker_id, 0, as_of + ttl)]), token

        return self.store.update(change)

    def _with(self, rows: list[tuple]) -> dict[str, Any]:
        return {"replace": {"worker_instance": self.store.spark.createDataFrame(rows, self.INSTANCE).coalesce(1)}}

    def _change(self, token: str, as_of: datetime | None, make: Any) -> None:
        def change(base: int) -> tuple[dict[str, Any], None]:
            rows = self._rows("worker_instance", self.INSTANCE, base).collect()
            own = next((r for r in rows if r.token == token and (as_of is None or r.expires_at > as_of)), None)
            if own is None:
                raise InstanceLost(token)
            new = make(own)
            return self._with([tuple(r) for r in rows if r is not own] + ([new] if new else [])), None

        self.store.update(change)

    def renew(self, token: str, as_of: datetime, ttl: timedelta) -> None:
        """An expired instance can't be renewed: another may have taken its place."""
        self._change(token, as_of, lambda r: (r.token, r.worker_id, r.failures, as_of + ttl))

    def release(self, token: str) -> None:
        self._change(token, None, lambda r: None)

    def record(self, token: str, succeeded: bool) -> None:
        """Count failures in a row; a success ends them."""
        self._change(token, None, lambda r: (r.token, r.worker_id, 0 if succeeded else r.failures + 1, r.expires_at))

    def sweep(self, as_of: datetime) -> None:
        """Drop expired instances."""

        def change(base: int) -> tuple[dict[str, Any], None]:
            return self._with([tuple(r) for r in self._rows("worker_instance", self.INSTANCE, base).collect() if r.expires_at > as_of]), None

        self.store.update(change)
