import os

import pytest

from loomvault.operators import keyed
from loomvault.operators.commits import Log
from loomvault.operators.edits import Conflict
from loomvault.sources import scratch
from loomvault.streaming.sync import KeyedState


def batch(spark, *rows):
    return spark.createDataFrame(rows, "path string, expected string, content string")


def test_two_interleaved_writers(spark, tmp_path, monkeypatch):
    a, b = Log(spark, f"file://{tmp_path}/log"), Log(spark, f"file://{tmp_path}/log")
    assert a.version() == 0 and a.notes().count() == 0
    assert a.commit(batch(spark, ("x", None, "one"), ("y", None, "two"), ("z", "0:0", "no")))[0] == 1
    publish, calls = scratch.publish, []

    def late(spark_, root, n, state):
        calls.append(n)
        if len(calls) == 1:  # the other writer has read the same version and comes first
            b.commit(batch(spark, ("x", "1:3", "from b"), ("w", None, "b too")))
        publish(spark_, root, n, state)

    monkeypatch.setattr(scratch, "publish", late)
    number, out = a.commit(batch(spark, ("x", "1:3", "from a"), ("y", "1:3", None), ("v", None, "v"), ("u", None, "1"), ("u", None, "2")))
    assert number == 3 and calls[0] == 2
    assert {(r["path"], r["outcome"]) for r in out.collect()} == {("x", "conflict"), ("y", "deleted"), ("v", "created"), ("u", "repeated")}
    assert {tuple(r) for r in a.notes().collect()} == {("x", "from b", "2:6"), ("w", "b too", "2:5"), ("v", "v", "3:1")}
    assert {(r["op"], r["path"]) for r in a.changes(2).collect()} == {("deleted", "y"), ("written", "v")}


def test_an_atomic_batch_is_written_whole_or_not_at_all(spark, tmp_path):
    log = Log(spark, f"file://{tmp_path}/log")
    log.commit(batch(spark, ("x", None, "one")))
    with pytest.raises(Conflict, match="x: exists"):
        log.commit(batch(spark, ("new", None, "n"), ("x", None, "two")), atomic=True)
    assert log.version() == 1 and {r["path"] for r in log.notes().collect()} == {"x"}
    assert log.commit(batch(spark, ("none", None, None), ("gone", "9:9", "t")))[0] == 1  # nothing is written
    assert log.commit(batch(spark, ("new", None, "n"), ("x", "1:3", None)), atomic=True)[0] == 2
    assert {tuple(r) for r in log.revisions().collect()} == {("new", "2:1")}
    assert log.commit(batch(spark, ("x", None, "again")))[0] == 3  # a deleted path is free


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names)


def test_what_a_batch_writes_follows_the_batch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed, "FAN", 3)
    root = str(tmp_path / "state")
    make = lambda: KeyedState(spark, f"file://{root}", "id long, v string, ts long", "id", ("ts",))
    make().merge(spark.range(100_000).selectExpr("id", "sha2(cast(id AS string), 256) AS v", "0L AS ts"), 0)
    whole, want = size(root), {}
    for n in range(1, 12):
        rows = [(i * 37 % 100, f"{n}", n) for i in range(n)] + [(i, "late", -1) for i in range(3)]
        make().merge(spark.createDataFrame(rows, "id long, v string, ts long"), n)  # a new object each time, as after a restart
        want |= {i: v for i, v, ts in rows if ts > 0}
        make().merge(spark.createDataFrame([(1, "replayed", 99)], "id long, v string, ts long"), n)
        assert make().parts() <= 8
        if n == 1:
            assert size(root) - whole < 0.02 * whole
    got = {r["id"]: r["v"] for r in make().read().collect()}
    assert len(got) == 100_000 and {i: got[i] for i in want} == want and got[99_999] != "late"


def test_content_moves_only_where_writes_fail(spark, tmp_path):
    log = Log(spark, f"file://{tmp_path}/log")
    text = "".join(chr(97 + i * 7919 % 26) for i in range(50_000))
    log.commit(batch(spark, ("x", None, text), ("y", None, "two")))
    assert size(tmp_path) < 2 * len(text)  # written once
    assert "content" not in log._outcomes(spark.createDataFrame([("x", None, False)], "path string, expected string, deletes boolean")).columns
    plan = log.revisions()._jdf.queryExecution().executedPlan().toString()
    assert all("content" not in line for line in plan.splitlines() if "SortAggregate" in line or "Exchange" in line)
    number, out = log.commit(batch(spark, ("x", "9:9", "no"), ("y", "1:3", "yes"), (None, None, "null path")))
    assert number == 2 and {(r["path"], r["outcome"]) for r in out.collect()} == {("x", "conflict"), ("y", "updated"), (None, "created")}
    assert {r["path"]: r["token"] for r in log.notes().collect()} == {"x": "1:50000", "y": "2:3", None: "2:9"}
