"""Replicas: restart, re-grouping and repetition give what one batch gives."""

import json
import random

import pytest

from tidewater.config import PiiRule
from tidewater.functions.pii import protect
from tidewater.sources.readers import changes
from tidewater.streaming.replica import Replica, delays, follow, may_pass, retried, supervised

ROW = "struct<id:bigint,name:string,qty:int>"
EVENTS = f"seq bigint, op string, before {ROW}, after {ROW}"


def log(seed=1, n=400):
    r, out, rows = random.Random(seed), [], {}
    for seq in range(n):
        k = r.randrange(40)
        old = rows.get(k)
        op = r.choice(["insert", "update", "replace", "delete", "move", "ddl"])
        new = {"id": k, "name": f"n{seq}", "qty": r.randrange(9)}
        if op == "delete":
            out.append((seq, "delete", old or {"id": k, "name": None, "qty": None}, None))
            rows.pop(k, None)
        elif op == "move" and old:
            new["id"] = 100 + r.randrange(20)
            out.append((seq, "update", old, new))
            rows.pop(k)
            rows[new["id"]] = new
        elif op == "ddl":
            out.append((seq, "ddl", None, new))
        else:
            out.append((seq, "replace" if op == "move" else op, None, new))
            rows[k] = new
    return out, rows


def landed(tmp_path, events, sizes):
    folder = tmp_path / "landing"
    folder.mkdir()
    at = 0
    for i, size in enumerate(sizes):
        lines = [json.dumps({"seq": s, "op": o, "before": b, "after": a}) for s, o, b, a in events[at : at + size]]
        (folder / f"{i:05d}.json").write_text("\n".join(lines))
        at += size
    return str(folder)


def rows_of(replica):
    return {r["id"]: {"id": r["id"], "name": r["name"], "qty": r["qty"]} for r in replica.read().collect()}


@pytest.mark.parametrize("sizes", [[400], [1, 99, 100, 200], [40] * 10])
def test_stream_equals_replay_in_any_grouping(spark, tmp_path, sizes):
    events, want = log()
    path = landed(tmp_path, events, sizes)
    replica = Replica(spark, str(tmp_path / "replica"), ("id",), "id bigint, name string, qty int", 4)
    stream = lambda: changes(spark, path, EVENTS, "json", True, 3)
    follow(stream(), replica, str(tmp_path / "ckpt")).awaitTermination()
    assert rows_of(replica) == want
    # a restart finds nothing new; without its checkpoint all events come again and change nothing
    follow(stream(), replica, str(tmp_path / "ckpt")).awaitTermination()
    other = Replica(spark, str(tmp_path / "replica"), ("id",), "id bigint, name string, qty int", 4)
    other.apply(changes(spark, path, EVENTS), other.last_batch + 1)
    assert rows_of(other) == want
    other.apply(changes(spark, path, EVENTS), 0)
    assert rows_of(other) == want and other.vacuum() > 0 and rows_of(other) == want
    # a new checkpoint numbers from 0 again, and what is new there counts
    late = spark.createDataFrame([(9000, "insert", None, (7, "late", 1))], EVENTS)
    other.apply(late, 0)
    assert rows_of(other) == want | {7: {"id": 7, "name": "late", "qty": 1}}


def test_replica_keeps_what_it_was_made_with(spark, tmp_path):
    where, row = str(tmp_path / "r"), "id bigint, name string, qty int"
    replica = Replica(spark, where, ("id",), row, 8)
    assert replica.empty
    replica.apply(spark.createDataFrame([(i, "delete" if i % 3 == 0 else "insert", None, (i, "n", 0)) for i in range(30)], EVENTS), 0)
    want = rows_of(replica)
    assert not replica.empty and len(want) == 20
    for other in ({"buckets": 3}, {"keys": ("name",)}):
        with pytest.raises(ValueError, match="has (buckets|keys)"):
            Replica(spark, where, other.get("keys", ("id",)), row, other.get("buckets", 8))
    replica.rewrite(buckets=3)
    again = Replica(spark, where, ("id",), row, 3)
    again.apply(spark.createDataFrame([(2, "insert", None, (3, "old", 0))], EVENTS), 1)
    assert rows_of(again) == want  # tombstones came along
    again.rewrite(forget_before=100)
    again.apply(spark.createDataFrame([(2, "insert", None, (3, "old", 0))], EVENTS), 2)
    assert len(rows_of(again)) == 21 and again.vacuum() > 0 and len(rows_of(again)) == 21


def test_late_older_changes_do_not_win(spark, tmp_path):
    replica = Replica(spark, str(tmp_path / "r"), ("id",), "id bigint, name string, qty int", 2)
    make = lambda *e: spark.createDataFrame([(s, o, None, (1, n, 0)) for s, o, n in e], EVENTS)
    replica.apply(make((5, "delete", "x")), 0)
    replica.apply(make((3, "insert", "old")), 1)
    assert rows_of(replica) == {}
    replica.apply(make((9, "insert", "new")), 2)
    replica.apply(make((7, "delete", "x")), 3)
    assert rows_of(replica)[1]["name"] == "new"


def test_protection_on_the_way_and_ignored_deletes(spark, tmp_path):
    events, _ = log(2, 100)
    path = landed(tmp_path, events, [50, 50])
    replica = Replica(spark, str(tmp_path / "replica"), ("id",), "id bigint, name string, qty int", 2)
    hide = lambda df: protect(df, [PiiRule("after.name", "masked")])
    follow(changes(spark, path, EVENTS, "json", True), replica, str(tmp_path / "c"), prepare=hide, ignore_deletes=True).awaitTermination()
    rows = rows_of(replica)
    assert rows and all(set(r["name"]) == {"*"} for r in rows.values())
    assert {e[3]["id"] for e in events if e[1] in ("insert", "replace")} - set(rows) <= {e[2]["id"] for e in events if e[1] == "update" and e[2]}


def test_supervision():
    class Query:
        def __init__(self, error):
            self.error = error

        def awaitTermination(self):
            if self.error:
                raise self.error

    errors, slept = [RuntimeError("Connection reset by peer"), RuntimeError("i/o timeout"), None], []
    assert supervised(lambda: Query(errors.pop(0)), sleep=slept.append) == 2
    assert slept == [5.0, 7.5] and delays()[-1] <= 300 and len(delays()) == 10
    with pytest.raises(RuntimeError, match="syntax"):
        supervised(lambda: Query(RuntimeError("syntax error")), sleep=slept.append)
    calls = []
    assert retried(lambda: calls.append(1) or (1 / 0 if len(calls) < 3 else "ok"), sleep=lambda s: None) == "ok"
    assert may_pass("EOF") and may_pass("read: unexpected EOF") and may_pass("host unreachable") and may_pass("(Interrupted) error code 11600") and may_pass("error code 189: stepped down")
    assert not may_pass("duplicate key") and not may_pass("no cursor of this name in geofence") and not may_pass("error code 1890")


def test_statistics_of_a_stream(spark, tmp_path):
    from tidewater.streaming.statistics import Progress, Statistics

    events, _ = log(3, 120)
    path = landed(tmp_path, events, [60, 60])
    kept, listener = Statistics(spark, 7, str(tmp_path / "stats")), Progress()
    spark.streams.addListener(listener)
    replica = Replica(spark, str(tmp_path / "replica"), ("id",), "id bigint, name string, qty int", 2)
    query = follow(changes(spark, path, EVENTS, "json", True, 1), replica, str(tmp_path / "c"), counters=kept, stream="users")
    query.awaitTermination()
    spark.streams.removeListener(listener)
    known = [e for e in events if e[1] != "ddl"]
    # another object, as after a restart
    ((task, name, received, executed, pending, inserted, updated, deleted),) = Statistics(spark, 7, str(tmp_path / "stats")).rows()
    assert (task, name, received, executed, pending) == (7, "users", 120, len(known), 120 - len(known))
    assert (inserted, updated, deleted) == tuple(sum(e[1] in k for e in known) for k in (("insert",), ("update", "replace"), ("delete",)))
    assert Statistics(spark, 8, str(tmp_path / "stats")).rows() == []


def test_letters_of_a_stream(spark, tmp_path):
    from pyspark.sql import functions as F

    from tidewater.streaming.replica import DeadLetters

    (tmp_path / "landing").mkdir()
    lines = [json.dumps({"seq": i, "op": op, "before": None, "after": a}) for i, (op, a) in enumerate([("insert", {"id": 1, "name": "a", "qty": 1}), ("insert", {"id": None, "name": "no key", "qty": 1}), ("update", None), ("delete", {"id": 9}), ("insert", {"id": 2, "name": "b", "qty": 50}), ("ddl", None), ("delete", {"id": 1, "qty": 60})])]
    (tmp_path / "landing" / "a.json").write_text("\n".join([*lines, "no event at all"]))
    replica = Replica(spark, str(tmp_path / "r"), ("id",), "id bigint, name string, qty int", 2)
    letters = DeadLetters(spark, str(tmp_path / "l"), ROW)
    few = lambda most: lambda df: F.coalesce(F.coalesce("after.qty", "before.qty") < most, F.lit(True))
    for number in range(2):  # the second time as after a loss of the checkpoint
        follow(changes(spark, str(tmp_path / "landing"), EVENTS, "json", True), replica, str(tmp_path / f"c{number}"), letters=letters, valid=few(10), ignore_deletes=number == 1).awaitTermination()
        assert set(rows_of(replica)) == {1}
    ids = sorted((r["id"][:7], r["op_type"]) for r in letters.read().where("op_type is null or op_type <> 'delete'").collect())
    assert ids[0::2] == ids[1::2] == [("1", "insert"), ("2", "update"), ("4", "insert"), ("sha256:", None)]
    assert letters.read().where("op_type = 'delete'").count() == 1
    left = letters.retry(replica, few(55), ignore_deletes=True)
    assert set(rows_of(replica)) == {1, 2} and left == 6  # the delete is settled, as deletes are ignored
    for _ in range(4):
        letters.retry(replica)
    assert {r["retry_count"] for r in letters.read().collect()} == {3} and letters.read().count() == 6


def test_killed_and_restarted_task(spark, tmp_path):
    from pyspark.sql import functions as F

    from tidewater.config import Settings, TableMapping, Task, settings_from_rows, tasks_from_rows
    from tidewater.streaming.task import TaskRun, reloads

    events, _ = log(5, 200)
    path = landed(tmp_path, events, [70, 70, 60])
    rows = spark.createDataFrame([(k, f"s{k}", 1) for k in range(300, 320)] + [(500, "gone", 1)], "id bigint, name string, qty int")
    mapping = TableMapping("users", "people", ("id",), (PiiRule("name", "masked"),), sync_indexes=True)
    task = Task(1, "mysql", secured=True, mappings=(mapping,))

    def run(folder, stop_at=0):
        calls = []

        def valid(_):
            calls.append(1)
            if len(calls) == stop_at:
                raise RuntimeError("stopped at some point")
            return F.lit(True)

        return TaskRun(spark, task, str(tmp_path / folder), lambda _: rows, lambda _: changes(spark, path, EVENTS, "json", True, 1), valid=valid, buckets=4, sleep=lambda s: None)

    run("whole").run()
    stopped = run("killed", 3)
    with pytest.raises(Exception, match="stopped"):
        stopped.run()
    again = run("killed")
    assert not again.load(mapping)  # the snapshot was taken once
    again.run()
    whole = rows_of(run("whole").replica(mapping))
    assert rows_of(again.replica(mapping)) == whole and len(whole) > 21 and all(set(r["name"]) == {"*"} for r in whole.values())
    assert again.statistics.rows()[0][2] == 200
    twice = TaskRun(spark, task, str(tmp_path / "dup"), lambda _: rows.unionAll(rows), lambda _: None, buckets=4)
    with pytest.raises(ValueError, match="not unique"):
        twice.run()

    found, errors = tasks_from_rows([{"id": 2, "enable": 1, "config_json": None}, {"id": 1, "enable": 0, "config_json": '{"type": "redis"}'}, {"id": 3, "enable": 1, "config_json": "{"}])
    assert [(t.id, t.kind, t.enabled) for t in found] == [(1, "redis", False), (2, "", True)] and list(errors) == [3]
    assert settings_from_rows([{"id": 1, "monitor_rows": 1, "log_level": "warn", "monitor_interval": 5, "webhook": None, "channel": None}]) == Settings(True, "warn", 5.0, "", "")
    states = iter([[task], [task], [Task(1, "redis")], []])
    changed = reloads(lambda: next(states), sleep=lambda s: None)
    assert next(changed) == ([task], []) and next(changed) == ([Task(1, "redis")], [task]) and next(changed) == ([], [Task(1, "redis")])


def test_log_table(spark, tmp_path):
    import logging

    from tidewater.streaming.log import LogTable

    handler = LogTable(spark, str(tmp_path / "log"), 2)
    logger = logging.getLogger("tidewater.test")
    logger.setLevel(logging.INFO)
    logger.addHandler(handler)
    logger.info("one", extra={"sync_task_id": "3"})
    logger.warning("two %s", 2)
    logger.error("three", extra={"sync_task_id": "x"})
    logger.removeHandler(handler)
    handler.close()
    got = sorted((r["level"], r["message"], r["sync_task_id"]) for r in spark.read.parquet(str(tmp_path / "log")).collect())
    assert got == [("error", "three", 0), ("info", "one", 3), ("warning", "two 2", 0)]


def test_bounded_batches():
    from tidewater.streaming.batching import bounded_prefix, estimated, rate_options

    assert bounded_prefix([100 << 20] * 10) == 5
    assert bounded_prefix([1 << 20] * 2000) == 256
    assert bounded_prefix([1] * 2000) == 1000
    assert bounded_prefix([1] * 3) == 3 and bounded_prefix([]) == 0
    assert estimated([10, 20], 10) == 150 and estimated([], 3) == 0
    assert rate_options() == {"maxBytesPerTrigger": str(256 << 20)} and rate_options(0, 7) == {"maxFilesPerTrigger": "7"}


def test_comparison_of_a_task(spark):
    from datetime import datetime

    from pyspark.errors import AnalysisException

    from tidewater.config import TableMapping, Task
    from tidewater.operators.schedule import alerts, compare

    def target(name):
        if name == "lost":
            raise AnalysisException("no such table")
        return spark.range(2)

    task = Task(4, "mysql", mappings=(TableMapping("a", "b"), TableMapping("a", "lost")))
    made = compare(spark, task, lambda _: spark.range(3), target, datetime(2024, 1, 1))
    assert sorted((r["tgt_table"], r["difference"]) for r in alerts(made).collect()) == [("b", 1), ("lost", 4)]


def test_alerts_and_their_log(spark, tmp_path):
    from datetime import datetime

    from tidewater.operators import schedule

    rows = [(1, "mysql", t, a, t + "2", b, "daily_check", datetime(2024, 1, 1)) for t, a, b in (("same", 3, 3), ("both", -1, -1), ("one", -1, 4), ("less", 5, 4))]
    made = spark.createDataFrame(rows, schedule.LOG)
    found = schedule.alerts(made)
    assert sorted((r["src_table"], r["uncounted"]) for r in found.collect()) == [("both", True), ("less", False), ("one", True)]
    for _ in range(2):
        schedule.append(made, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 8
    said = []
    assert schedule.notify(found, said.append) == 3 and len(said) == 3 and "differs by 1" in " ".join(said)
    said.clear()
    assert schedule.notify(found, said.append, 1) == 3 and said[1] == "2 more"
    assert schedule.notify(found, lambda text: 1 / 0) == 3
