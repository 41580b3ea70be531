import re

import pytest

from loomvault.llm import licences as L

BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def brute(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    at = [(i, label) for p, label in BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def test_base_places_match_brute_force(spark, docs, rows, empty):
    texts = ["CC BY CC-BY cc by", "all rights reserved general public license. ALL RIGHTS reserved", "", None, "cc by", "xcc by", "é cc by nc 4.0 ÉA", "This is cc\nby general  public-license", "cc by cc", "ccby"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in L.scan(df).collect():
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(texts[r["doc_id"]])
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert L.scan(docs).count() == len(rows) and L.scan(empty).count() == 0


def test_expressions():
    assert L.postfix("MIT AND (Apache-2.0 OR GPL-3.0 WITH x)") == ["MIT", "Apache-2.0", "GPL-3.0", "x", "with", "or", "and"]
    assert L.evaluate("MIT OR GPL-2.0-only") == (["mit", "gpl-2.0"], 0.1)
    assert L.evaluate("MIT AND GPL-2.0-only")[1] == 0.6
    assert L.evaluate("GPL-2.0-only WITH Classpath-exception-2.0")[1] < 0.6
    for bad in ("", "MIT AND", "(MIT", "AND MIT", "MIT)", "()"):
        with pytest.raises(L.Malformed):
            L.evaluate(bad)


def test_tags_are_parsed_from_the_text():
    r = L.judge("// SPDX-License-Identifier: (MIT OR Apache-2.0) AND CC-BY-4.0\ncode")
    assert set(r["labels"].split(",")) >= {"mit", "apache-2.0", "cc-by-4.0"}


def test_long_expressions_are_read_to_their_end():
    r = L.judge("SPDX-License-Identifier: " + "BSD-3-Clause AND " * 24 + "GPL-3.0-only\ncode AND MIT")
    assert (r["labels"], r["score"]) == ("bsd-3-clause,gpl-3.0", 0.6)


@pytest.mark.parametrize("text", ['SPDX-License-Identifier = "MIT"', "SPDX License Identifier: MIT", "License Expression: MIT.", '{"license-expression": "MIT", "x": 1}', "é **SPDX-License-Identifier:** MIT", "SPDX-License-Identifier MIT"])
def test_every_tag_found_is_parsed(text):
    r = L.judge("Some words.\n" + text + "\nmore words")
    assert (r["labels"], r["score"]) == ("mit", 0.1)


def test_tags_in_prose_and_in_a_row():
    assert L.judge("the SPDX license identifier is a short string")["labels"] == ""
    r = L.judge("SPDX-License-Identifier: MIT SPDX-License-Identifier: GPL-2.0-only SPDX-License-Identifier: (ISC")
    assert (r["labels"], r["score"]) == ("gpl-2.0,isc,mit", 0.6)


def test_words_that_name_no_licence_give_no_label():
    assert L.judge("SPDX-License-Identifier: see the file")["labels"] == ""
    assert L.judge("SPDX-License-Identifier: LicenseRef-Own AND Unheard-1.0")["labels"] == "licenseref-own"
    r = L.judge("SPDX-License-Identifier: " + "MIT AND " * 60 + "GPL-3.0-only")
    assert (r["labels"], r["score"]) == ("gpl-3.0,mit", 0.6)
