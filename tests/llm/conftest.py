import random

import pytest

COMMON = "the of and to in is that it was for on are".split()


def words(r: random.Random, n: int) -> list[str]:
    """Invented words, most of them rare."""
    return [r.choice(COMMON) if r.random() < 0.4 else "".join(r.choice("aeioustrlné") for _ in range(r.randint(3, 9))) for _ in range(n)]


def corpus(seed: int = 5) -> list[dict]:
    """Documents with every awkward case: nulls, blanks, copies, near copies, shared passages, repeats, long runs, one very long text."""
    r = random.Random(seed)
    passage, line = " ".join(words(r, 60)), " ".join(words(r, 12))
    rows: list[dict] = []

    def add(text, doc_id=None, source="src1", **more):
        rows.append({"doc_id": len(rows) if doc_id is None else doc_id, "text": text, "lang": "en", "source": source, "n_chars": None if text is None else len(text), "key": "x", "m": 1, "th": None} | more)

    for i in range(25):
        add(" ".join(words(r, r.randint(5, 120))), source=r.choice(["src0", "src0", "src1", None]))
    base = words(r, 150)
    for i in range(20):
        near = list(base)
        for _ in range(i % 5):
            near[r.randrange(len(near))] = "".join(r.choice("xyz") for _ in range(6))
        add(" ".join(near), source="src0")
    for i in range(8):
        add("A copied text. " * 3 + " ".join(base[:80]))
    for i in range(6):
        add(" ".join(words(r, 20)) + "\n" + passage + " " + " ".join(words(r, 15)))
    for i in range(6):
        add(line + "\n" + " ".join(words(r, 40)) + "\n" + line + "\n\n" + line)
    add("go " * 90)
    add("go " * 70 + "stop")
    add("a b " * 60)
    add(None)
    add(None)
    add("")
    add(" \n\t ")
    add("one two three")
    add("One TWO three")
    add(" ".join(words(r, 20000)))
    rows.append({**rows[3], "doc_id": None})
    rows.append(dict(rows[3]))
    rows.append(dict(rows[30]))
    rows.append({**rows[31], "doc_id": rows[32]["doc_id"]})
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, m int, th string"


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame([tuple(x[k.split()[0]] for k in SCHEMA.split(", ")) for x in rows], SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty") / "documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)
