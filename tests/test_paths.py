import pytest
from pyspark.sql import functions as F

from loomvault.functions import paths
from loomvault.functions.paths import PathError, VaultPath, folder_argument

CASES = {
    "a.md": ("note", "a", None), "x/y/a.md": ("note", "a", "x/y/"), "x/y/": ("folder", "y", "x/"), "n.md#H1/H2": ("section", "n", None), "f/n.md#^id": ("block", "n", "f/"),
    "p/i.png": ("image", "i", "p/"), "A.MD": ("other", "A", None), ".gitignore": ("other", ".gitignore", None), "x/b.txt": ("other", "b", "x/"), "": ("root", "", None),
}


def test_columns_and_single_paths_agree(spark):
    df = spark.createDataFrame([(p,) for p in CASES], "path string")
    c = F.col("path")
    for r in df.select("path", paths.kind(c).alias("k"), paths.stem(c).alias("s"), paths.parent(c).alias("p")).collect():
        assert (r["k"], r["s"], r["p"]) == CASES[r["path"]], r
        one = VaultPath.of(r["path"])
        assert (one.kind, one.stem, one.parent) == CASES[r["path"]]


def test_bad_paths(spark):
    for bad in ("/", "a/../b.md", "x#h", "n.md#a/../b", ".."):
        with pytest.raises(PathError):
            VaultPath.of(bad)
    df = spark.createDataFrame([("a/../b.md",), ("x#h",)], "path string")
    assert all(r["k"] is None for r in df.select(paths.kind(F.col("path")).alias("k")).collect())


def test_normal_forms():
    assert VaultPath.of("/a\\b.md").value == "a/b.md"
    assert folder_argument("/x/y") == "x/y/" and folder_argument(None) == folder_argument("/") == ""


def test_folders_have_borders(spark):
    df = spark.createDataFrame([("proj/a.md",), ("projects/a.md",), ("proj/x/b.md",), ("r.md",)], "p string")
    f = lambda t: sorted(r["p"] for r in df.filter(t).collect())
    assert f(paths.is_under_folder(F.col("p"), "proj/")) == ["proj/a.md", "proj/x/b.md"]
    assert f(paths.is_in_folder(F.col("p"), "proj/")) == ["proj/a.md"]
    assert len(f(paths.is_under_folder(F.col("p"), ""))) == 4
