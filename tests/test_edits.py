import os
import time

import pytest

from loomvault.operators import changes, sections
from loomvault.operators.edits import Conflict, NoMatch, Vault
from loomvault.sources import vault as source
from loomvault.sources.vault import AccessError
from loomvault.streaming import sync


@pytest.fixture
def v(tmp_path):
    return Vault(str(tmp_path))


def test_compare_and_swap(v):
    t = v.create("a/x.md", "one")
    with pytest.raises(FileExistsError):
        v.create("a/x.md", "two")
    with pytest.raises(Conflict):
        v.write("a/x.md", "two", "0:0")
    with pytest.raises(FileNotFoundError):
        v.write("a/y.md", "two", t)
    time.sleep(0.01)
    v.write("a/x.md", "three", t)
    assert v.read("a/x.md") == "three"
    with pytest.raises(Conflict):
        v.delete("a/x.md", t)
    v.delete("a/x.md")
    assert not v.exists("a/x.md")


def test_edits(v):
    v.create("n.md", "on 2024-01-15 the cat, the dog")
    v.replace("n.md", "the", "a")
    assert v.read("n.md") == "on 2024-01-15 a cat, the dog"
    v.replace("n.md", r"(\d{4})-(\d{2})-(\d{2})", "$1/$2/$3", "regex")
    v.append("n.md", "end")
    assert v.read("n.md") == "on 2024/01/15 a cat, the dog\nend"
    with pytest.raises(NoMatch):
        v.replace("n.md", "zebra", "x", "all")
    v.patch_frontmatter("n.md", {"tags": ["t"], "k": 1})
    assert v.read_frontmatter("n.md")["tags"] == ["t"] and v.read("n.md").endswith("\nend")
    v.delete_frontmatter("n.md")
    assert v.read_frontmatter("n.md") is None


def test_rename_rewrites_links(v):
    v.create("target.md", "x")
    v.create("a.md", "[[target]] [[x/target#h]] [[target|t]] [[targets]]")
    assert v.rename("target.md", "new.md", backlinks=["a.md"]) == 1
    assert v.read("a.md") == "[[new]] [[new#h]] [[new|t]] [[targets]]"
    assert v.rename("new.md", "sub/new.md", backlinks=["a.md"]) == 0
    v.copy("sub/new.md", "c.md")
    assert v.read("c.md") == "x"


def test_access(v, tmp_path):
    v.create("a.md", "x")
    v.deny_access(["a.md"])
    with pytest.raises(AccessError):
        v.read("a.md")
    v.deny_access([])
    v.read_only_access(["a.md"])
    with pytest.raises(AccessError):
        v.append("a.md", "y")
    os.symlink("/etc", tmp_path / "out")
    with pytest.raises(AccessError):
        v.read("out/hostname")


def test_scan(spark, v, tmp_path):
    v.create("A B+c.md", "# x\r\ny")
    v.create("d/i.png", "data:image/png;base64,aGk=")
    v.create("d/z.txt", "t")
    assert {(r["path"], r["kind"]) for r in source.listing(spark, str(tmp_path)).collect()} == {("A B+c.md", "note"), ("d/i.png", "image"), ("d/z.txt", "other")}
    (r,) = source.notes(spark, str(tmp_path)).collect()
    assert (r["path"], r["content"]) == ("A B+c.md", "# x\r\ny") and r["token"] == v.token("A B+c.md")
    assert source.images(spark, str(tmp_path)).first()["uri"] == v.read("d/i.png")
    assert source.notes(spark, str(tmp_path), deny=["A B+c.md"]).count() == 0


def test_diff_and_events(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, token string")
    was = spark.createDataFrame([("b", "2"), ("c", "0"), ("d", "4")], "path string, token string")
    d = changes.diff(now, was)
    assert {(r["op"], r["path"]) for r in d.collect()} == {("created", "a"), ("updated", "c"), ("deleted", "d")}
    once = changes.apply(was, d)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, now.collect())) == sorted(map(tuple, changes.apply(once, d).collect()))


def test_apply_takes_the_last_event_of_a_key(spark):
    was = spark.createDataFrame([("a", "0"), ("z", "9")], "path string, token string")
    events = spark.createDataFrame([("updated", "a", "1", 1), ("updated", "a", "2", 2), ("created", "b", "1", 1), ("deleted", "b", None, 2), ("created", "c", "5", 3)], "op string, path string, token string, ts int")
    assert sorted(map(tuple, changes.apply(was, events).collect())) == [("a", "2"), ("c", "5"), ("z", "9")]


def test_keyed_state_survives_a_restart(spark, tmp_path):
    state = lambda: sync.KeyedState(spark, f"file://{tmp_path}/state", "id long, v string, ts int", "id", ("ts",))
    batch = lambda *rows: spark.createDataFrame(rows, "id long, v string, ts int")
    assert state().read().count() == 0
    state().merge(batch((1, "a", 1), (2, "b", 1), (2, "c", 2)), 0)
    state().merge(batch((1, "d", 3), (3, "e", 1)), 1)
    state().merge(batch((9, "replayed", 9)), 1)
    state().merge(batch(), 2)
    assert sorted(map(tuple, state().read().collect())) == [(1, "d", 3), (2, "c", 2), (3, "e", 1)]


def test_scan_of_a_uri(spark, v, tmp_path):
    v.create("d/n.md", "x")
    assert source.notes(spark, f"file://{tmp_path}").first()["path"] == "d/n.md" == source.listing(spark, f"file:{tmp_path}/").first()["path"]


def test_rename_finds_the_links(v):
    for path, text in (("target.md", "x"), ("a.md", "[[target]]"), ("b/c.md", "see [[x/target#h|t]]"), ("d.md", "[[targets]]")):
        v.create(path, text)
    assert v.rename("target.md", "new.md") == 2 and v.read("b/c.md") == "see [[new#h|t]]"
    assert v.rename("new.md", "newer.md", update_links=False) == 0 and v.read("a.md") == "[[new]]"


def test_stream_follows_files(spark, v, tmp_path):
    root = tmp_path / "vault"
    root.mkdir()
    w = Vault(str(root))
    w.create("a.md", "one")
    w.create("b.md", "two")
    seen = {}

    def apply(batch, _):
        for r in batch.collect():
            seen[r["path"]] = r["op"]

    def run():
        q = sync.follow(sync.watch(spark, str(root)), apply, str(tmp_path / "checkpoint"))
        q.processAllAvailable()
        q.stop()

    run()
    assert seen == {"a.md": "created", "b.md": "created"}
    w.append("a.md", "more")
    w.delete("b.md")
    w.create("c.md", "x")
    run()
    assert seen == {"a.md": "updated", "b.md": "deleted", "c.md": "created"}


def test_full_yaml_sections(spark):
    s = sections.sections(spark.createDataFrame([("n.md", "---\ntags: [a, 'b c']\n---\ntext #d")], "path string, content string"), yaml=True)
    assert s.first()["tags"] == ["a", "b c", "d"]
