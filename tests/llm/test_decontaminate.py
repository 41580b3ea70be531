import random
import time

from loomvault.llm import decontaminate as D

ITEM = "Anna has 12 apples and gives 5 apples to her brother Tom, then she buys 7 more apples at the market for 3 dollars each."


def find(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string, k int, h string")
    b = spark.createDataFrame(items, "item_id long, text string, slots int")
    return {(r["doc_id"], r["item_id"]): r for r in D.find(d, b).collect()}


def test_finds_verbatim_and_reparameterised_questions(spark):
    clean = "Some other text about the weather in the north, which was cold and wet for most of the year, as people said."
    changed = ITEM.replace("12", "40").replace("5 ", "8 ").replace("Tom", "Ben").replace("7", "9").replace("3 dollars", "6 dollars")
    mixed = "Anna has 12 apples and gives 5 apples. " + clean
    docs = [(1, "Intro words. " + ITEM + " " + clean, 1, None), (2, clean, 1, "a"), (3, changed + " " + clean, 2, None), (4, None, None, None), (5, "", 0, ""), (6, mixed, 1, ""), (None, ITEM, 1, "")]
    got = find(spark, docs, [(10, ITEM, 1), (11, None, 2), (12, "", 3)])
    assert set(got) == {(1, 10), (3, 10), (None, 10)}
    assert got[1, 10]["n_changed"] == 0 and got[3, 10]["n_changed"] > 0


def test_slots_must_agree(spark):
    item = "the car drives 30 km to the town and then drives 30 km back to the old house by the river again"
    good, bad = item.replace("30", "55"), item.replace("30", "55", 1).replace("30", "77", 1)
    got = find(spark, [(1, good, 1, ""), (2, bad, 1, "")], [(1, item, 1)])
    assert got[1, 1]["n_conflicts"] == 0
    assert (2, 1) not in got or got[2, 1]["n_conflicts"] > 0


def test_matches_substring_search(spark, docs, rows):
    texts = [x["text"] for x in rows if x["text"] and len(x["text"].split()) > 40]
    items = [(i, " ".join(t.split()[5:30])) for i, t in enumerate(texts[:12])] + [(100, "some words that are nowhere to be found in any of these texts at all today")]
    got = {(r["doc_id"], r["item_id"]) for r in D.find(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    joined = lambda t: " ".join((t or "").split())
    want = {(x["doc_id"], i) for x in rows for i, item in items if f" {item} " in f" {joined(x['text'])} "}
    assert want <= got and all(i != 100 for _, i in got)


def test_empty_tables(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.find(docs, none).count() == 0
    assert D.find(empty, spark.createDataFrame([(1, ITEM)], "item_id long, text string")).count() == 0


def test_finds_verbatim_copies_of_any_case_and_context(spark):
    items = [
        (1, "WHAT IS THE CAPITAL CITY OF THE NEW STATE THAT JOINED THE UNION IN 1790"),
        (2, "Who Wrote The Famous Letter That Anna Read To Her Brother Ben In Old Paris"),
        (3, "12 + 15 = 27 and 30 - 14 = 16 so 27 * 16 = 432 and 432 / 4 = 108 or 9 * 12"),
        (4, "What is the capital of this land?"),
        (5, "Welche Übung für den Anfänger ist nach Ansicht der Ärzte besonders gut geeignet und warum?"),
    ]
    docs = [(i, f"Some words before. {t} And some words after.", 1, "") for i, t in items]
    docs += [(10 + i, f"some words in front, question 5) {t} and more", 1, "") for i, t in items]
    docs += [(20 + i, f"some words in front {t.upper()} and more", 1, "") for i, t in items]
    docs += [(30 + i, f"some words in front \u201c{t.lower()}\u201d \u2014 and more", 1, "") for i, t in items]
    got = find(spark, docs, [(i, t, 0) for i, t in items])
    assert set(got) == {(a + i, i) for a in (0, 10, 20, 30) for i, _ in items}
    assert all(r["n_changed"] == 0 for r in got.values())


def test_first_word_may_follow_a_word_in_a_reparameterised_copy(spark):
    item = "What is the price of 12 red apples here?"
    assert set(find(spark, [(1, "now question 5) " + item.replace("12", "30") + " Tell me.", 1, "")], [(1, item, 0)])) == {(1, 1)}


def test_repeated_words_make_few_rows_and_short_items_are_found(spark):
    docs = [(1, "go " * 3000, 0, ""), (2, "we said hello there friend twice", 0, ""), (3, "nothing of it", 0, "")]
    items = [(1, "go " * 200, 0), (2, "Hello there, friend!", 0), (3, "word", 0), (4, "12 apples", 0)]
    got = find(spark, docs, items)
    assert set(got) == {(1, 1), (2, 2)}
    assert got[1, 1]["covered_words"] == 200
    d = spark.createDataFrame(docs, "doc_id long, text string, k int, h string").selectExpr("doc_id AS id", "xxhash64(text) AS th", "text")
    table = spark.sparkContext.broadcast(b"\xff" * (1 << 17))
    assert d.filter("id = 1").mapInArrow(D._document_windows([8], table), D._ROW).count() == 1


def test_template_search_matches_brute_force(spark):
    """Questions whose numbers change, against a search by regular expressions with one number for each slot."""
    import random
    import re

    r = random.Random(8)
    filler = lambda: " ".join(r.choice("alpha beta gamma delta omega sigma".split()) + r.choice("abcdefgh") for _ in range(9))
    items, docs = [], []
    for i in range(12):
        w = [r.choice("takes gives finds keeps shares sells buys holds moves counts".split()) + r.choice(["", "", f" {r.randint(1, 99)}"]) for _ in range(14)]
        items.append((i, f"everyone {' '.join(w)} of them", 0))
    for j in range(36):
        text = items[j % 12][1]
        if j % 3:
            values = {}
            text = re.sub(r"\d+", lambda m: values.setdefault(m.group(), str(100 + 7 * j + int(m.group()))), text)  # noqa: B023
        docs.append((j, f"{filler()} {text if j % 4 else ' '.join(text.split()[::-1])} {filler()}", 0, ""))
    want = set()
    for j, text, _, _ in docs:
        for i, item, _ in items:
            groups = {}
            pattern = " ".join((rf"(?P<n{groups.setdefault(x, len(groups))}>\d+)" if x not in groups else rf"(?P=n{groups[x]})") if x.isdigit() else re.escape(x) for x in item.split())
            if re.search(rf"\b{pattern}\b", text):
                want.add((j, i))
    assert set(find(spark, docs, items)) == want and len(want) == 27


def test_windows_set_aside_change_nothing(spark):
    r = random.Random(7)
    word = lambda: r.choice("table river house green walk seven letter".split()) + r.choice(["", "s", "ed"])
    lead = "answer the following multiple choice question by picking one of four options"
    items = [(i, f"{lead} {' '.join(word() for _ in range(r.randint(2, 25)))} {r.randint(1, 99)} km") for i in range(40)]
    items += [(100 + i, items[i][1]) for i in range(3)] + [(200, "short one"), (201, lead)]
    docs = [(i, f"{' '.join(word() for _ in range(8))} {r.choice(items)[1]} {' '.join(word() for _ in range(r.randint(0, 8)))}", 1, "") for i in range(60)]
    docs += [(100 + i, f"{lead} {' '.join(word() for _ in range(20))}", 1, "") for i in range(20)] + docs[:5] + [(500, docs[3][1], 1, "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, k int, h string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [sorted(map(str, D.find(frame, bench, common).collect())) for common in (1, 5, 10**9)]
    assert got[0] == got[1] == got[2] and len(got[0]) >= 60
    kinds = {x.item_id for x in D.find(frame, bench).collect()}
    assert {100, 101, 102} & kinds and 201 in kinds


def test_a_line_before_every_item_makes_no_pairs(spark):
    """2,000 documents and 2,000 items that share an instruction of 12 words and nothing else: rows are not their product."""
    lead = "answer the following multiple choice question by picking one of four options"
    name = lambda a, i: " ".join(f"{a}{i}x{j}" for j in range(15))
    docs = spark.createDataFrame([(i, f"{lead} {name('d', i)}") for i in range(2000)], "doc_id long, text string")
    items = [(i, f"{lead} {name('b', i)}") for i in range(2000)]
    began = time.perf_counter()
    assert D.find(docs, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert time.perf_counter() - began < 40


def test_repeated_templates_are_one_row(spark):
    began = time.perf_counter()
    got = find(spark, [(1, "go 5 " * 3000, 1, ""), (2, "go 7 " * 3000, 1, "")], [(1, "go 5 " * 200, 1)])
    assert set(got) == {(1, 1), (2, 1)} and got[1, 1]["n_changed"] == 0 and got[2, 1]["n_changed"] == 1
    assert got[1, 1]["covered_words"] == got[2, 1]["covered_words"] == 400
    assert time.perf_counter() - began < 40


TEMPLATES = [
    "{n} has {a} apples and gives {b} of them to {m} before buying {c} more at the market near the old bridge",
    "a train leaves the station at {a} km per hour and another follows {b} hours later at {c} km per hour on the same track",
    "how many days will {a} workers need to build a wall if {b} workers need {c} days for the same wall",
    "the sum of {a} and twice the number that {n} thinks of is equal to {b} minus that very number so find it",
    "a tank holds {a} liters of water and loses {b} liters every hour through a small hole in its bottom when is it empty",
    "{n} runs {a} miles on each weekday and {b} miles on each day of the weekend so how far does {n} run in {c} weeks",
]


def test_recall_of_reparameterised_items(spark):
    """Every template with 20 other fillings inside other text is found, and no other template."""
    r = random.Random(11)
    fill = lambda t: t.format(n=r.choice(["Anna", "Carla", "Mara", "Nina"]), m=r.choice(["Ben", "Paul", "Otto"]), a=r.randint(2, 400), b=r.randint(2, 90), c=r.randint(2, 60))
    items = [(i, fill(t)) for i, t in enumerate(TEMPLATES)]
    docs = [(100 * i + j, f"we were asked this one: {fill(t)}. then we went home", 1, "") for i, t in enumerate(TEMPLATES) for j in range(20)]
    got = find(spark, docs, [(i, t, 0) for i, t in items])
    assert {(d, i) for d, i in got} <= {(100 * i + j, i) for i in range(6) for j in range(20)}
    assert len(got) >= 0.95 * 120
