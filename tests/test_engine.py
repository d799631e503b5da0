"""Exact-row scenarios and invariants."""

from __future__ import annotations

import os
import random
import shutil
import subprocess
import sys
from datetime import UTC, datetime, timedelta
from pathlib import Path

import pandas as pd
import pytest

import __spark_entry__
from loomlog.admin import Admin, NotFound
from loomlog.functions import cron, routing
from loomlog.operators import log
from loomlog.sources.store import Conflict, Topic
from loomlog.streaming import consumer

MESSAGE = "seq long, idempotency_key string, routing_key string, compaction_key string, compaction_rank long, payload string, created_at timestamp_ntz"
T = datetime(2024, 1, 1)


def messages(spark, rows):
    return spark.createDataFrame([(i, f"k{i}", r, c, rank, str(i), T + timedelta(seconds=i)) for i, r, c, rank in rows], MESSAGE)


def test_rank_pin_and_backfill(spark):
    ranks = [("user:1", 0), ("user:1", 100), ("user:1", 0), ("user:1", 0), ("user:2", 0), ("user:2", -1), ("user:3", -1), ("user:3", 0)]
    df = spark.createDataFrame([(i + 1, k, r) for i, (k, r) in enumerate(ranks)], "id long, compaction_key string, compaction_rank long")
    assert {(r.compaction_key, r.head_id) for r in log.heads(df).collect()} == {("user:1", 2), ("user:2", 5), ("user:3", 8)}


@pytest.mark.parametrize("cut", [0, 3, 5, 8])
def test_heads_do_not_depend_on_how_batches_are_cut(spark, cut):
    rng = random.Random(cut)
    df = spark.createDataFrame([(i, f"k{rng.randrange(3)}", rng.randrange(-1, 2)) for i in range(9)], "id long, compaction_key string, compaction_rank long")
    whole = {tuple(r) for r in log.heads(df).collect()}
    assert {tuple(r) for r in log.upsert_heads(log.heads(df.where(f"id < {cut}")), df.where(f"id >= {cut}")).collect()} == whole


def test_routing(spark):
    keys = ["orders.us.created", "orders.us.central1.created", "orders.eu.updated", "payments.charge", None]
    df = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "id long, routing_key string")
    got = routing.routed(df, {1: [routing.wildcard("orders.*.created")]}, 1)
    assert sorted(r.id for r in got.collect()) == [0, 1]
    assert routing.routed(df, {}, 2).count() == 5
    assert [r.id for r in df.where(routing.any_of(df.routing_key, [routing.segments("orders.*.created")])).collect()] == [0]
    assert sorted(r.id for r in df.where(routing.any_of(df.routing_key, [routing.segments("orders.>")])).collect()) == [0, 1, 2]
    for bad in ("a..b", ">.a", ""):
        with pytest.raises(ValueError):
            routing.segments(bad)


def test_header_containment(spark):
    rows = ['{"a": {"b": {"c": 1, "d": "x"}, "n": null}, "t": true, "s": "1", "l": ["u", 3]}', '{"a": {"b": {"c": "1"}}, "t": "true", "s": 1}', "not json", "[]", None]
    df = spark.createDataFrame(list(enumerate(rows)), "id long, headers string")
    for wanted, ids in (({"a": {"b": {"c": 1}}}, [0]), ({"a": {"b": {"c": "1"}}}, [1]), ({"a": {}}, [0, 1]), ({"a": {"n": None}}, [0]), ({"t": True}, [0]), ({"t": "true"}, [1]), ({"s": 1}, [1]), ({"l": ["u"]}, [0]), ({"l": [3, "u"]}, [0]), ({"l": ["v"]}, []), ({"q'x": 1}, []), ({"a": {"b": {"c": 1, "d": "x"}}, "s": "1"}, [0])):
        assert sorted(r.id for r in df.where(routing.header_contains(df.headers, wanted)).collect()) == ids, wanted
    with pytest.raises(ValueError):
        routing.header_contains(df.headers, {})


@pytest.mark.parametrize("schedule", ["*/7 * * * *", "0 9 * * mon-fri", "15 10 1,15 * *", "0 0 13 * fri", "@daily", "TZ=Europe/Berlin 30 2 * * *"])
def test_cron_against_a_search_by_minutes(schedule):
    from zoneinfo import ZoneInfo

    at = datetime(2024, 3, 30, 22, 41, 30)
    text = cron.MACROS.get(schedule, schedule)
    zone = ZoneInfo("UTC")
    if text.startswith("TZ="):
        name, text = text.split(" ", 1)
        zone = ZoneInfo(name[3:])
    f = text.split()
    m, h, d, mo, w = (cron._field(x, lo, hi, n) for x, lo, hi, n in zip(f, (0, 0, 1, 1, 0), (59, 23, 31, 12, 6), ({}, {}, {}, cron.MONTHS, cron.DAYS), strict=True))
    t = at.replace(second=0)
    while True:
        t += timedelta(minutes=1)
        x = t.replace(tzinfo=ZoneInfo("UTC")).astimezone(zone)
        day, week = x.day in d[0], x.isoweekday() % 7 in w[0]
        if x.minute in m[0] and x.hour in h[0] and x.month in mo[0] and ((day and week) if d[1] or w[1] else (day or week)):
            break
    assert cron.next_time(schedule, at) == t


def test_cron_limits():
    assert cron.next_time("@every 1m30s", T) == T + timedelta(seconds=90)
    assert cron.next_time("0 0 31 2 *", T) is None
    with pytest.raises(ValueError):
        cron.next_time("60 * * * *", T)


NEW_YORK = [
    ("2012-03-11T00:00:00-05:00", "0 * * * *", "2012-03-11T01:00:00-05:00"),
    ("2012-03-11T01:00:00-05:00", "0 * * * *", "2012-03-11T03:00:00-04:00"),
    ("2012-03-11T00:00:00-05:00", "30 2 11 Mar ?", "2013-03-11T02:30:00-04:00"),
    ("2012-03-11T00:00:00-05:00", "0 2 * * ?", "2012-03-12T02:00:00-04:00"),
    ("2012-11-04T00:00:00-04:00", "30 2 04 Nov ?", "2012-11-04T02:30:00-05:00"),
    ("2012-11-04T01:45:00-04:00", "30 1 04 Nov ?", "2012-11-04T01:30:00-05:00"),
    ("2012-11-04T00:00:00-04:00", "0 * * * ?", "2012-11-04T01:00:00-04:00"),
    ("2012-11-04T01:00:00-04:00", "0 * * * ?", "2012-11-04T01:00:00-05:00"),
    ("2012-11-04T01:00:00-05:00", "0 * * * ?", "2012-11-04T02:00:00-05:00"),
    ("2012-11-04T00:00:00-04:00", "0 1 * * ?", "2012-11-04T01:00:00-04:00"),
    ("2012-11-04T01:00:00-04:00", "0 1 * * ?", "2012-11-04T01:00:00-05:00"),
    ("2012-11-04T01:00:00-05:00", "0 1 * * ?", "2012-11-05T01:00:00-05:00"),
    ("2012-11-04T02:00:00-05:00", "0 2 * * ?", "2012-11-05T02:00:00-05:00"),
    ("2012-11-04T00:00:00-04:00", "0 3 3 * ?", "2012-12-03T03:00:00-05:00"),
]


@pytest.mark.parametrize(("at", "schedule", "want"), NEW_YORK)
def test_cron_where_clocks_change(at, schedule, want):
    plain = [datetime.fromisoformat(x).astimezone(UTC).replace(tzinfo=None) for x in (at, want)]
    assert cron.next_time(f"TZ=America/New_York {schedule}", plain[0]) == plain[1]


@pytest.mark.parametrize(("schedule", "want"), [("0 0 */1 * mon", "2026-11-30"), ("0 0 */2 * mon", "2026-11-25"), ("0 0 * * mon/1", "2026-11-25"), ("0 0 1 * */1", "2026-12-01")])
def test_cron_steps_of_one_keep_their_star(schedule, want):
    assert cron.next_time(schedule, datetime(2026, 11, 24)) == datetime.fromisoformat(want)


@pytest.mark.parametrize("bad", ["@every 1h30x garbage", "@every", "@every 0s", "* * * *", "*/0 * * * *", "5-1 * * * *", "a * * * *"])
def test_cron_refuses_what_it_does_not_understand(bad):
    with pytest.raises(ValueError):
        cron.next_time(bad, T)


def test_queries_without_the_training_data_operators(spark, tmp_path):
    """A copy of the tree without the llm folders still offers, and runs, all other queries."""
    root = Path(__file__).resolve().parent.parent
    for name in ("loomlog", "__spark_entry__.py", "corpus_pipeline.py"):
        source = root / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif source.exists():
            shutil.copy(source, tmp_path / name)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) >= 94 and not any(k == 'pipeline' or k[:2] == 'op' and k[2].isdigit() for k in [*q, *s])"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert __spark_entry__.entry(spark).count() > 0


def test_store_appends_once_and_prunes(spark, tmp_path):
    topic = Topic(spark, str(tmp_path / "t"), partition_size=4)
    topic.produce(messages(spark, [(1, "a.x", "k1", 0), (2, "", "k1", 0), (3, "a.y", None, 0)]))
    topic.produce(messages(spark, [(3, "a.y", None, 0), (4, "b.x", "k1", -1), (5, "a.z", "k2", 0)]))
    rows = topic.read("log").orderBy("id").collect()
    assert [(r.id, r.payload) for r in rows] == [(1, "1"), (2, "2"), (3, "3"), (4, "4"), (5, "5")]
    assert rows[1].routing_key is None and topic.head() == 5
    assert {(r.compaction_key, r.head_id) for r in topic.heads().collect()} == {("k1", 2), ("k2", 5)}
    plan = topic.read_range(4, 7)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan and [r.id for r in topic.read_range(4, 7).collect()] == [5]


def test_stale_commits_change_nothing(spark, tmp_path):
    topic = Topic(spark, str(tmp_path / "t"))
    one = spark.range(1)
    base = topic.version()
    topic.commit(base, replace={"a": one})
    with pytest.raises(Conflict):
        topic.commit(base, replace={"a": spark.range(5)})
    assert topic.read("a").count() == 1 and topic.version() == 1


def test_admin(spark, tmp_path):
    admin = Admin(spark, str(tmp_path))
    topic = admin.register_topic("orders", 1, 4)
    with pytest.raises(ValueError):
        admin.register_topic("orders", 1, 5)
    topic.produce(messages(spark, [(1, "a.x", "k1", 0), (2, "b.x", None, 0), (3, "a.y", "k1", 0)]))
    admin.declare_bindings("orders", 1, 7, ["a.*"])
    assert [r.id for r in admin.read("orders", 1, 7, 0, 10).collect()] == [3]
    assert sorted(r.id for r in admin.read("orders", 1, 8, 0, 10).collect()) == [2, 3]
    admin.destroy_topic("orders", 1)
    with pytest.raises(NotFound):
        admin.topic("orders", 1)


def test_streams_match_batches(spark, tmp_path):
    topic = Topic(spark, str(tmp_path / "t"), 4)
    topic.produce(messages(spark, [(i, f"{'a' if i % 2 else 'b'}.x", f"k{i % 3}", i % 4) for i in range(1, 21)]))
    rows = topic.read("log").drop("part")
    path = str(tmp_path / "flat")
    rows.repartition(3).write.parquet(path)

    def handler(frame: pd.DataFrame) -> pd.Series:
        return pd.Series([None if i % 5 else "bad" for i in frame["id"]], dtype=object)

    q = consumer.consume(consumer.source(spark, path, rows.schema, 1), [routing.wildcard("a.*")], handler, str(tmp_path / "out"), str(tmp_path / "c1"), 9)
    q.awaitTermination(120)
    got = {(r.message_id, r.status) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(i, "success" if i % 5 else "failure") for i in range(1, 21) if i % 2}
    q = consumer.heads(consumer.source(spark, path, rows.schema, 1)).writeStream.format("memory").queryName("heads").outputMode("update").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = {}
    for r in spark.sql("SELECT * FROM heads").collect():
        last[r.compaction_key] = max(last.get(r.compaction_key, (-9, 0)), (r.head_rank, r.head_id))
    assert {k: v[1] for k, v in last.items()} == {r.compaction_key: r.head_id for r in log.heads(rows).collect()}


def test_admin_groups_and_renames(spark, tmp_path):
    admin = Admin(spark, str(tmp_path))
    admin.register_topic("orders").produce(messages(spark, [(1, "a.x", None, 0)]))
    assert [admin.register_group("orders", 1, g) for g in ("x", "y", "x")] == [1, 2, 1]
    admin.declare_bindings("orders", 1, 1, ["b.*"])
    admin.rename_topic("orders", "sales")
    assert admin.topic("sales").head() == 1 and [r.id for r in admin.read("sales", 1, 1, 0, 9).collect()] == []
    with pytest.raises(NotFound):
        admin.topic("orders")
    assert admin.family_health("sales", spark.createDataFrame([(1, 1, 1)], "group_id long, claimed long, committed long"), spark.createDataFrame([], "group_id long, low long"), spark.createDataFrame([], "group_id long, message_id long, status string, created_at timestamp_ntz")) == [(1, "safe")]


def test_admin_cron_jobs(spark, tmp_path):
    admin = Admin(spark, str(tmp_path))
    requests = admin.register_topic("requests")
    admin.register_cron_job("report", "*/10 * * * *", T)
    admin.register_cron_job("idle", "@daily", T)
    admin.suspend_cron_job("idle")
    assert admin.tick(requests, T + timedelta(minutes=35)) == ["report"]
    assert admin.tick(requests, T + timedelta(minutes=35)) == []
    assert admin.get_cron_job("report").next_at == T + timedelta(minutes=40) and admin.get_cron_job("report").last_at == T + timedelta(minutes=30)
    assert [r.compaction_key for r in admin.list_measurements(requests).collect()] == ["report"]
    admin.unsuspend_cron_job("idle", T + timedelta(days=3))
    assert admin.get_cron_job("idle").next_at == T + timedelta(days=4)
    admin.destroy_cron_job("idle")
    assert [r.name for r in admin.list_cron_jobs().collect()] == ["report"]
