"""Consumer groups: claims, leases with tokens, retries, the frontier."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from loomlog.admin import Admin
from loomlog.errors import BadRecords, Conflict, EngineError, InstanceLost, LeaseLost, NotEmpty, NotFound
from loomlog.sources.group import Group
from loomlog.sources.store import Topic
from loomlog.sources.workers import Workers
from loomlog.streaming import worker

T = datetime(2024, 1, 1)
MESSAGE = "seq long, idempotency_key string, routing_key string, compaction_key string, compaction_rank long, payload string, created_at timestamp_ntz"


def at(seconds):
    return T + timedelta(seconds=seconds)


@pytest.fixture
def topic(spark, tmp_path):
    out = Topic(spark, str(tmp_path / "t"), partition_size=8)
    out.produce(spark.createDataFrame([(i, f"k{i}", "a.x", None, 0, str(i), at(i)) for i in range(1, 21)], MESSAGE))
    return out


def outcomes(spark, rows):
    return spark.createDataFrame([(i, k, None if k in ("success", "deferred") else "bad") for i, k in rows], "message_id long, kind string, error string")


def statuses(group):
    return {r.message_id: (r.status, r.attempts) for r in group.read("delivery").collect()}


def logged(group):
    return sorted((r.message_id, r.attempt, r.status) for r in group.read("delivery_log").collect())


def test_a_failure_pins_the_frontier(spark, topic):
    group = Group(topic, 7)
    one, two = group.claim(10, T), group.claim(10, T)
    assert (one.low, one.high, two.low, two.high) == (0, 10, 10, 20) and group.claim(10, T) is None
    assert sorted(r.id for r in group.messages(one.low, one.high).collect()) == list(range(1, 11))
    assert group.advance() == 0
    group.commit(one.token, outcomes(spark, [(3, "failure"), (4, "success"), (99, "failure")]), T)
    group.commit(two.token, outcomes(spark, []), T)
    assert statuses(group) == {3: ("ready", 0)} and group.advance() == 2 and not group.leases()
    taken = group.claim_deliveries(5, at(1), token="w").collect()
    assert [(r.message_id, r.attempts, r.payload) for r in taken] == [(3, 1, "3")]
    group.record("w", outcomes(spark, [(3, "failure")]), at(2))
    assert statuses(group) == {3: ("ready", 1)} and group.claim_deliveries(5, at(3)).isEmpty()  # the backoff
    assert [r.attempts for r in group.claim_deliveries(5, at(5), token="v").collect()] == [2]
    group.record("v", outcomes(spark, [(3, "success")]), at(6))
    assert statuses(group) == {} and group.advance() == 20 and group.cursor() == (20, 20)
    assert logged(group) == [(3, 0, "failure"), (3, 1, "failure")]


def test_a_dead_message_holds_nothing_back(spark, topic):
    group = Group(topic, 1)
    lease = group.claim(100, T)
    group.commit(lease.token, outcomes(spark, [(5, "terminal"), (6, "superseded"), (7, "deferred")]), T)
    assert statuses(group) == {5: ("dead", 0), 7: ("deferred", 0)} and group.advance() == 6
    assert logged(group) == [(5, 0, "failure"), (6, 0, "superseded"), (7, 0, "deferred")]


def test_a_stale_commit_keeps_nothing(spark, topic):
    group = Group(topic, 1)
    first = group.claim(10, T)
    second = group.claim(10, at(31))
    assert (second.low, second.high, second.reclaims) == (0, 10, 1) and second.token != first.token
    group.commit(second.token, outcomes(spark, []), at(32))
    with pytest.raises(LeaseLost):
        group.commit(first.token, outcomes(spark, [(5, "failure")]), at(33))
    with pytest.raises(LeaseLost):
        group.renew(first.token, at(90))
    assert statuses(group) == {} and logged(group) == []


def test_forced_reclaims_do_not_count(spark, topic):
    group = Group(topic, 1)
    lease = group.claim(10, T)
    group.force_reclaim(lease.token, at(1))
    with pytest.raises(LeaseLost):
        group.commit(lease.token, outcomes(spark, []), at(1))
    again = group.claim(10, at(1))
    assert (again.low, again.reclaims) == (0, 0)


def test_partial_commits_keep_the_prefix(spark, topic):
    group = Group(topic, 1, log_success=True)
    lease = group.claim(5, T)
    assert group.partial_commit(lease.token, outcomes(spark, [(1, "success"), (3, "failure"), (4, "success")]), at(1)) == 1
    (rest,) = group.leases()
    assert (rest.low, rest.high, rest.token) == (1, 5, lease.token) and statuses(group) == {} and logged(group) == [(1, 0, "success")]
    assert group.partial_commit(lease.token, outcomes(spark, [(i, "success") for i in range(2, 6)]), at(2)) == 5
    group.commit(lease.token, outcomes(spark, []), at(3))
    assert group.advance() == 5


def test_poisonous_ranges_are_quarantined(spark, topic):
    group = Group(topic, 1, most_reclaims=2)
    lease = group.claim(3, T)
    for k in (1, 2):
        lease = group.claim(3, at(31 * k))
        assert (lease.low, lease.reclaims) == (0, k)
    nxt = group.claim(3, at(31 * 3))
    assert (nxt.low, nxt.high, nxt.reclaims) == (3, 6, 0)
    assert statuses(group) == {i: ("ready", 0) for i in (1, 2, 3)} and logged(group) == [(i, 0, "failure") for i in (1, 2, 3)]
    with pytest.raises(LeaseLost):
        group.commit(lease.token, outcomes(spark, []), at(100))
    assert group.advance() == 0


def test_crashed_handlers_are_taken_over_and_in_the_end_killed(spark, topic):
    group = Group(topic, 1, most_attempts=2)
    group.commit(group.claim(5, T).token, outcomes(spark, [(2, "failure")]), T)
    group.claim_deliveries(5, at(1), token="a")
    group.renew_deliveries("a", at(60))
    assert group.claim_deliveries(5, at(32), token="b").isEmpty()
    assert [r.attempts for r in group.claim_deliveries(5, at(61), token="b").collect()] == [2]
    with pytest.raises(LeaseLost):
        group.record("a", outcomes(spark, [(2, "success")]), at(62))
    group.kill(at(62))
    assert statuses(group) == {2: ("inflight", 2)}
    group.kill(at(100))
    assert statuses(group) == {2: ("dead", 2)} and logged(group) == [(2, 0, "failure"), (2, 1, "expired"), (2, 2, "killed")]
    assert "last attempt" in group.read("delivery").head().last_error and group.advance() == 5


def test_keys(spark, tmp_path):
    topic = Topic(spark, str(tmp_path / "t"))
    topic.produce(spark.createDataFrame([(i, f"i{i}", None, "k", 0, str(i), at(i)) for i in (1, 2)], MESSAGE))
    group = Group(topic, 1)
    assert group.claim_key("k", 1, T, "a") == "superseded"
    assert [group.claim_key("k", 2, T, t) for t in ("a", "b", "a")] == ["acquired", "busy", "acquired"]
    group.release_key("k", "b")
    assert group.claim_key("k", 2, at(1), "b") == "busy" and group.claim_key("k", 2, at(60), "b") == "acquired"
    group.commit(group.claim(5, T).token, outcomes(spark, [(2, "failure")]), T)
    assert group.claim_deliveries(5, at(61), token="c").isEmpty()  # the key is held
    group.sweep_keys(at(200))
    group.claim_key("k", 2, at(201), "c")
    group.release_key("k", "c")
    assert [r.message_id for r in group.claim_deliveries(5, at(202), token="c").collect()] == [2]
    group.claim_key("k", 2, at(203), "c")
    group.record("c", outcomes(spark, [(2, "superseded")]), at(204), release_keys=True)
    assert statuses(group) == {2: ("superseded", 0)} and group.read("key_lease").isEmpty() and logged(group)[-1] == (2, 1, "superseded")


def test_fan_out_and_pop(spark, topic):
    group = Group(topic, 3)
    assert group.fan_out(8, T) == 8 and group.fan_out(50, T) == 20 and group.fan_out(50, T) == 20
    assert sorted(statuses(group)) == list(range(1, 21))
    assert [r.message_id for r in group.pop(3).collect()] == [1, 2, 3] and len(statuses(group)) == 17


def test_two_writers(spark, topic, monkeypatch):
    """A change that was overtaken is worked out anew: no lease is given twice."""
    a, b, held = Group(topic, 1), Group(topic, 1), []
    cursor = Group.cursor

    def overtaken(self, version=None):
        if self is a and not held:
            held.append(b.claim(5, T))
        return cursor(self, version)

    monkeypatch.setattr(Group, "cursor", overtaken)
    got = a.claim(5, T)
    assert [(x.low, x.high) for x in (held[0], got)] == [(0, 5), (5, 10)]
    base = topic.version()
    topic.commit(base, replace={"x": spark.range(1)})
    with pytest.raises(Conflict):
        topic.produce_with(spark.createDataFrame([(1, "n", None, None, 0, "p", T)], MESSAGE), base=base)
    assert topic.head() == 20


def test_messages_and_own_tables_in_one_commit(spark, topic):
    topic.produce_with(spark.createDataFrame([(1, "n", None, None, 0, "p", T)], MESSAGE), replace={"order": spark.range(3)})
    assert topic.head() == 21 and topic.read("order").count() == 3
    topic.produce_with(spark.createDataFrame([(1, "n", None, None, 0, "p", T)], MESSAGE), append={"order": spark.range(2)})  # a duplicate
    assert topic.head() == 21 and topic.read("order").count() == 5


def test_retention(spark, topic):
    topic.produce(spark.createDataFrame([(i, f"r{i}", None, f"k{i % 2}", 0, None if i % 2 else "v", at(100 + i)) for i in range(4)], MESSAGE))
    topic.drop_parts([0, 1])
    assert sorted(r.id for r in topic.read("log").collect()) == list(range(16, 25)) and topic.head() == 24
    referenced = spark.createDataFrame([(21,)], "message_id long")
    topic.compact(24, referenced)
    assert sorted(r.id for r in topic.read("log").collect()) == [16, 17, 18, 19, 20, 21, 23]  # 22: replaced and a tombstone; 24: a tombstone
    topic.sweep(at(20), floor=18)
    assert sorted(r.id for r in topic.read("log").collect()) == [19, 20, 21, 23]
    topic.sweep_keys(at(100))
    assert {r.idempotency_key for r in topic.read("idempotency").collect()} == {f"r{i}" for i in range(4)}
    assert topic.vacuum() > 0 and topic.read("log").count() == 4
    for i in range(20):
        topic.produce(spark.createDataFrame([(1, f"h{i}", None, "h", 0, "v", at(200 + i))], MESSAGE)) if i in (0, 1) else None
    assert topic.heads().where("compaction_key = 'h'").head().head_id == 26


def test_old_keys_are_forgotten(spark, tmp_path):
    topic = Topic(spark, str(tmp_path / "t"), key_ttl=timedelta(seconds=10))
    for seconds in (0, 5, 50):
        topic.produce(spark.createDataFrame([(1, "same", None, "k", 0, "p", at(seconds))], MESSAGE))
    assert topic.head() == 2 and topic.heads().head().head_id == 2


def test_groups_of_the_facade(spark, tmp_path):
    admin = Admin(spark, str(tmp_path))
    admin.register_topic("orders").produce(spark.createDataFrame([(i, f"k{i}", "a.x" if i % 2 else "b.x", None, 0, str(i), at(i)) for i in range(1, 7)], MESSAGE))
    group_id = admin.register_group("orders", 1, "odd")
    assert [admin.declare_bindings("orders", 1, group_id, p, live) for p, live in ((["a.*"], False), (["a.*"], True), (["b.*"], True))] == ["install", "join", "wait"]
    group = admin.group("orders", 1, "odd")
    lease = group.claim(10, T)
    assert sorted(r.id for r in group.messages(lease.low, lease.high).collect()) == [1, 3, 5]
    admin.destroy_group("orders", 1, "odd")
    assert not [k for k in admin.topic("orders").tables() if k.startswith("group-") and admin.topic("orders").tables()[k]]
    assert admin.register_group("orders", 1, "other") == group_id + 1
    path = admin.topic("orders").path
    admin.destroy_topic("orders")
    import os

    assert not os.path.exists(path)


def test_a_worker_tries_again_until_all_is_done_or_dead(spark, topic):
    def handler(message):
        n = message["message_id"]
        if n == 3:
            raise worker.Terminal("never")
        if n == 4 and message["attempt"] < 2:
            raise ValueError("not yet")
        if n == 5:
            raise RuntimeError("always")
        if n == 6 and message["attempt"] == 0:
            raise worker.Deferred
        if n == 7 and message["attempt"] == 0:
            import time

            time.sleep(30)

    group = Group(topic, 1, most_attempts=3)
    work = worker.Worker(group, handler, batch=8, timeout=0.5)
    assert work.drain(T) == 3  # the second attempts of 4 and 5 have failed at once, and wait
    assert work.drain(at(100)) == 4 and work.drain(at(200)) == 20
    assert statuses(group) == {3: ("dead", 0), 5: ("dead", 3)} and "always" in group.read("delivery").where("message_id = 5").head().last_error
    assert [x[1:] for x in logged(group) if x[0] == 5] == [(k, "failure") for k in range(4)]
    assert work.counters["dead"] == 2 and work.counters["success"] == 18 and work.counters["deferred"] == 1 and not work.step(at(300))


def test_bad_records(spark, topic):
    rows = [(1, "n1", None, None, 0, "p", T), (2, "", None, None, 0, "p", T), (3, "n3", None, None, 0, "p", None), (4, "n4", None, None, 0, "p", T), (4, "n5", None, None, 0, "p", T), (None, "n6", None, None, 0, "p", T)]
    bad = spark.createDataFrame(rows, MESSAGE)
    with pytest.raises(BadRecords):
        topic.produce_checked(bad)
    assert topic.head() == 20
    assert topic.produce_checked(bad, on_bad="evict") == [(None, "no seq"), (2, "no idempotency key"), (3, "no created_at"), (4, "seq is not unique")]
    assert topic.head() == 21
    good = spark.createDataFrame(rows[:1], MESSAGE)
    assert topic.produce_checked(good) == [] and topic.head() == 21  # a duplicate
    two = [spark.createDataFrame([(i, f"{n}{i}", None, None, 0, f"{n}{i}", T) for i in (1, 2)], MESSAGE) for n in "ba"]
    topic.produce_many(two)
    assert [r.payload for r in topic.read_range(21, 99).orderBy("id").collect()] == ["b1", "b2", "a1", "a2"]


def test_workers(spark, tmp_path):
    workers, minute = Workers(Topic(spark, str(tmp_path / "c"))), timedelta(minutes=1)
    key = workers.register("cron", target=1)
    assert workers.register("cron", topic_id=3, target=-1) == key + 1 and workers.register("cron", target=1) == key
    token = workers.claim(key, T, minute)
    assert workers.claim(key, T, minute) is None and workers.claim(key + 1, T, minute) and workers.claim(key + 1, T, minute)
    workers.renew(token, at(50), minute)
    workers.record(token, False)
    assert workers.instances().where(f"token = '{token}'").head().failures == 1
    assert workers.claim(key, at(109), minute) is None and workers.claim(key, at(110), minute) is not None
    with pytest.raises(InstanceLost):
        workers.renew(token, at(111), minute)
    with pytest.raises(NotFound):
        workers.claim(99, T, minute)
    workers.sweep(at(115))
    assert workers.instances().count() == 1
    workers.release(workers.instances().head().token)
    assert workers.instances().isEmpty()


def test_errors_have_codes_of_their_own():
    found = EngineError.registry()
    assert len(found) == len({k for k in found}) >= 9 and found["LL001"] is Conflict and Conflict.transient and not LeaseLost.transient
    assert all(k.advice and k.__doc__ for c, k in found.items() if c != "LL000")


def test_a_topic_with_messages_is_kept_unless_forced(spark, tmp_path):
    admin = Admin(spark, str(tmp_path))
    admin.register_topic("t").produce(spark.createDataFrame([(1, "a", None, None, 0, "p", T)], MESSAGE))
    with pytest.raises(NotEmpty):
        admin.destroy_topic("t", force=False)
    assert admin.topic("t").head() == 1
