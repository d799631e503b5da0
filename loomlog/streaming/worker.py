"""A group's worker: handles claimed ranges and retries with a function of one message, in executors.

The handler gets a message as a dictionary (with ``attempt``, from 0). What it returns doesn't matter; ``Terminal`` and ``Deferred``
say what becomes of the message, any other exception is a failure that is tried again. A message that takes longer than ``timeout``
is a failure, too. Outcomes are written before they are committed, so a range is handled once per claim.
"""

from __future__ import annotations

import signal
import threading
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.errors import LeaseLost
from loomlog.sources.group import Group

OUTCOME = "message_id long, kind string, error string"


class Terminal(Exception):
    """The message can never be handled: it goes to the dead letters."""


class Deferred(Exception):
    """The message has to wait, without a failure."""


class TimedOut(Exception):
    pass


def _limited(handler: Callable[[dict], Any], message: dict, timeout: float | None) -> None:
    if timeout is None or threading.current_thread() is not threading.main_thread():
        handler(message)
        return

    def stop(*_: Any) -> None:
        raise TimedOut(f"took longer than {timeout} s")

    before = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, timeout)
    try:
        handler(message)
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def handled(messages: DataFrame, handler: Callable[[dict], Any], timeout: float | None = None) -> DataFrame:
    """message_id, kind and error of each message (message_id, attempt and its columns)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for message in rows.to_dict("records"):
                try:
                    _limited(handler, message, timeout)
                    out.append((message["message_id"], "success", None))
                except Terminal as e:
                    out.append((message["message_id"], "terminal", str(e)))
                except Deferred:
                    out.append((message["message_id"], "deferred", None))
                except Exception as e:  # whatever a handler raises is an outcome
                    out.append((message["message_id"], "failure", f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["message_id", "kind", "error"])

    return messages.mapInPandas(run, OUTCOME)


class Worker:
    """``counters`` counts what this worker did: claimed, success, ready, deferred, dead, superseded, reclaimed, lease_lost."""

    def __init__(self, group: Group, handler: Callable[[dict], Any], batch: int = 10_000, hold: timedelta = timedelta(seconds=30), timeout: float | None = None, wait: timedelta = timedelta(0)):
        self.group, self.handler, self.batch, self.hold, self.timeout, self.wait = group, handler, batch, hold, timeout, wait
        self.counters: Counter[str] = Counter()

    def _kept(self, outcomes: DataFrame) -> DataFrame:
        """Outcomes as written: later readers don't run the handler again."""
        topic = self.group.topic
        path = f"{topic.path}/_stage/{uuid.uuid4().hex}"
        outcomes.write.parquet(path)
        return topic.spark.read.schema(OUTCOME).parquet(path)

    def _count(self, outcomes: DataFrame) -> None:
        names = {"failure": "ready", "terminal": "dead"}
        for r in outcomes.groupBy("kind").count().collect():
            self.counters[names.get(r.kind, r.kind)] += r["count"]
            self.counters["claimed"] += r["count"]

    def step(self, as_of: datetime) -> bool:
        """Handle one range, or else what is due of single deliveries; whether there was anything."""
        lease = self.group.claim(self.batch, as_of, self.hold)
        try:
            if lease is not None:
                self.counters["reclaimed"] += lease.reclaims > 0
                rows = self.group.messages(lease.low, lease.high).withColumnRenamed("id", "message_id").withColumn("attempt", F.lit(0))
                outcomes = self._kept(handled(rows, self.handler, self.timeout))
                self.group.commit(lease.token, outcomes, as_of, self.wait)
            else:
                self.group.kill(as_of)
                token = uuid.uuid4().hex
                rows = self.group.claim_deliveries(self.batch, as_of, self.hold, token).withColumnRenamed("attempts", "attempt")
                if rows.isEmpty():
                    return False
                outcomes = self._kept(handled(rows, self.handler, self.timeout))
                last = rows.where(F.col("attempt") >= self.group.most_attempts).select("message_id", F.lit(True).alias("last"))
                # a failure at the last attempt is the end
                outcomes = outcomes.join(last, "message_id", "left").select("message_id", F.when(F.col("last") & (F.col("kind") == "failure"), "terminal").otherwise(F.col("kind")).alias("kind"), "error")
                self.group.record(token, outcomes, as_of)
            self._count(outcomes)
        except LeaseLost:
            self.counters["lease_lost"] += 1
        return True

    def drain(self, as_of: datetime) -> int:
        """Work until nothing is due, then move the frontier; gives it."""
        while self.step(as_of):
            pass
        return self.group.advance()
