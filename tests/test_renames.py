import random
import re

from loomvault.operators import renames as R
from loomvault.operators.edits import link_pattern


def serial(notes, table):
    """One rename after the other, as `edits.Vault` does them."""
    stem = lambda p: p.rsplit("/", 1)[-1].removesuffix(".md")
    notes = {p: (p, t) for p, t in notes}
    for _, old, new in sorted(table):
        if old == new:
            continue
        if old in notes:
            notes[new] = notes.pop(old)
        if stem(old) != stem(new):
            pattern = re.compile(link_pattern(stem(old)))
            notes = {p: (o, pattern.sub(lambda m: f"[[{stem(new)}{m.group(1)}", t)) for p, (o, t) in notes.items()}
    return sorted((p, o, t) for p, (o, t) in notes.items())


def check(spark, notes, table):
    df = spark.createDataFrame(notes, "path string, content string")
    got = R.rename_many(df, spark.createDataFrame(table, "step int, old string, new string")).collect()
    assert sorted((r["path"], r["old_path"], r["content"]) for r in got) == serial(notes, table)
    return {r["old_path"]: r["n_links"] for r in got}


def test_chains_swaps_and_cycles(spark):
    notes = [("a.md", "[[b]] [[x/a#h]] [[c|t]] ![[d]] [[abc]] [[]] [[a"), ("b.md", "[[a]][[b]] [[a.b]]"), ("f/c.md", ""), ("d.md", "no links"), ("e.md", "[[new#^x]] [[f/c]]")]
    swap = [(1, "a.md", "tmp.md"), (2, "b.md", "a.md"), (3, "tmp.md", "b.md")]
    assert check(spark, notes, swap)["a.md"] == 2
    check(spark, notes, [(1, "a.md", "n1.md"), (2, "n1.md", "n2.md"), (3, "n2.md", "sub/n3.md"), (4, "f/c.md", "c.md"), (5, "sub/n3.md", "n3.md")])
    check(spark, notes, [(1, "a.md", "t.md"), (2, "b.md", "a.md"), (3, "d.md", "b.md"), (4, "t.md", "d.md"), (5, "a.md", "a.md"), (6, "d.md", "a2.md")])
    check(spark, notes, [(1, "a.md", "z.md"), (2, "b.md", "a.md"), (3, "a.md", "y.md"), (4, "none.md", "new.md")])
    check(spark, notes, [])


def test_a_hundred_renames_with_chains(spark):
    r = random.Random(2)
    names = [f"n{i}" for i in range(30)]
    notes = [(f"{n}.md", " ".join(f"[[{r.choice(['', 'd/'])}{r.choice(names)}{r.choice([']]', '#h]]', '|x]]'])}" for _ in range(8)) + "[[[" + r.choice(["é", "]"])) for n in names]
    at, table = {n: f"{n}.md" for n in names}, []
    for step in range(100):
        n, new = r.choice(names), r.choice([f"m{step}.md", f"n{r.randrange(30)}.md", f"s/m{r.randrange(9)}.md"])
        if new not in at.values() and new.rsplit("/")[-1] not in {p.rsplit("/")[-1] for p in at.values()}:
            table.append((step, at[n], new))
            at[n] = new
    assert len(table) > 60
    check(spark, notes, table)


def test_a_long_chain(spark):
    table = [(i, f"c{i}.md", f"c{i + 1}.md") for i in range(300)]
    check(spark, [("c0.md", "[[c0]] [[c150]] [[c300]]")], table)
