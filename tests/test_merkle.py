import random

from pyspark.sql import functions as F

from loomvault.operators import changes, index, merkle, search


def rows(df):
    return sorted((r["op"], r["path"], r["token"]) for r in df.collect())


def test_differences_are_those_of_the_whole_listings(spark, tmp_path, monkeypatch):
    r = random.Random(1)
    names = [f"{a}{b}{i}.md" for a in ("", "a/", "b/c/", "b/d/e/", "z/") for b in ("", "x/") for i in range(4)]
    trees = merkle.Listings(spark, f"file://{tmp_path}/listings")
    frame = lambda d: spark.createDataFrame(sorted(d.items()) , "path string, token string")
    was = {p: str(r.random()) for p in names}
    states = [was, {p: t for p, t in was.items() if not p.startswith("b/d/")}, was | {"b/c/x/1.md": "new", "root.md": "1", "q/w/e.md": "2"}, {}, dict(was)]
    numbers = [trees.add(frame(s)) for s in states]
    assert numbers == list(range(5))
    for named in (merkle.NAMED, 0):
        monkeypatch.setattr(merkle, "NAMED", named)
        for i, j in ((0, 1), (1, 2), (2, 0), (3, 0), (0, 3), (0, 4), (3, 3)):
            got, seen = trees.diff(i, j)
            assert rows(got) == rows(changes.diff(frame(states[i]), frame(states[j])))
            if (i, j) == (0, 1):  # the root, b/, and b/d/ with two folders below it, which are missing
                assert (seen.folders, seen.differing) == (5, 3)
            if (i, j) == (0, 4):
                assert seen.folders == seen.differing == 0


def test_unchanged_folders_are_not_read(spark, tmp_path):
    trees = merkle.Listings(spark, f"file://{tmp_path}/listings")
    files = spark.range(3000).selectExpr("concat('f', id % 30, '/', id, '.md') AS path", "cast(id AS string) AS token")
    a, b = trees.add(files), trees.add(files.withColumn("token", F.when(F.col("path") == "f7/7.md", "new").otherwise(F.col("token"))))
    got, seen = trees.diff(b, a)
    assert rows(got) == [("updated", "f7/7.md", "new")] and (seen.folders, seen.differing) == (2, 1)
    assert "EqualTo(folder,f7/)" in got._jdf.queryExecution().executedPlan().toString()


def test_tags_and_those_below_are_one_range(spark):
    tags = ["a", "a/b", "a/b/c", "a-b", "a.b", "ab", "a b", "b", "b/a", "é/ü", "é"]
    s = spark.createDataFrame([(f"s{i}", "n", [t]) for i, t in enumerate(tags)], "section_path string, note_path string, tags array<string>")
    posts = index.tagged(s)
    for t in [*tags, "none", "a/"]:
        want = sorted(r["section_path"] for r in search.candidates(s, tags=[t]).collect())
        assert sorted(r["section_path"] for r in search.tag_sections(posts, [t]).collect()) == want
    both = sorted(r["section_path"] for r in search.tag_sections(posts, ["a", "b", "a/b"]).collect())
    assert both == sorted(r["section_path"] for r in search.candidates(s, tags=["a", "b"]).collect())
    order = [r["tag"] for r in posts.orderBy("key").collect()]
    assert order.index("a") + 2 == order.index("a/b/c")
