"""License scans: Aho-Corasick over normalised words, and a shunting-yard parser for licence expressions.

Texts become words (digits, a-z after lower-casing A-Z, and bytes above 127) joined by single spaces; one automaton finds every
place of every notice phrase and identifier tag. From a tag's place on (past a separator and an opening quote), the original text's expression is
parsed, however long it is, up to its line's end, a closing quote or the next tag, with the precedence
WITH over AND over OR, and evaluated: OR takes the freest side, AND the strictest, WITH an exception lowers a copyleft.
Each document is judged alone: one scan and one map, no shuffle.

Defined results: a null or empty text has no words, no places, empty labels and score 0; a malformed expression yields the known labels of
its identifiers and no value; words of an expression that are neither known identifiers nor LicenseRef- ones give no label; very long texts are read whole; a tag without a separator (: or =) counts only if all that follows in its expression are known licences; ties and repeated rows are judged each for itself; an empty table gives an empty
table; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .shared import documents, lean

#: The base phrases and their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Further notice phrases (normalised) and their labels.
PHRASES = {
    "apache license": "apache-2.0", "apache license version 2 0": "apache-2.0", "licensed under the apache license": "apache-2.0",
    "mit license": "mit", "permission is hereby granted free of charge": "mit", "the software is provided as is without warranty of any kind": "mit",
    "bsd license": "bsd", "redistribution and use in source and binary forms": "bsd", "isc license": "isc",
    "mozilla public license": "mpl-2.0", "eclipse public license": "epl-2.0", "lesser general public license": "lgpl", "affero general public license": "agpl",
    "gnu general public license": "gpl", "gnu general public license version 2": "gpl-2.0", "gnu general public license version 3": "gpl-3.0",
    "cc by sa": "cc-by-sa", "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd", "cc by nc sa": "cc-by-nc-sa", "cc by nc nd": "cc-by-nc-nd",
    "creative commons attribution": "cc-by", "creative commons zero": "cc0-1.0", "cc0 1 0": "cc0-1.0", "public domain": "public-domain", "unlicense": "unlicense",
    "do what the fuck you want to public license": "wtfpl", "proprietary and confidential": "proprietary", "no part of this publication may be reproduced": "reserved",
}

#: Identifier tags: an expression follows in the text.
TAGS = {"spdx license identifier": "spdx", "license expression": "spdx"}

#: How far a label restricts reuse, from 0 (none) to 1 (no licence to reuse).
RESTRICTION = {
    "public-domain": 0.0, "cc0-1.0": 0.0, "unlicense": 0.0, "wtfpl": 0.0, "0bsd": 0.0,
    "mit": 0.1, "mit-0": 0.0, "isc": 0.1, "bsd": 0.1, "bsd-1-clause": 0.1, "bsd-2-clause": 0.1, "bsd-3-clause": 0.1, "bsd-4-clause": 0.15, "zlib": 0.1, "bsl-1.0": 0.1, "ncsa": 0.1, "postgresql": 0.1,
    "python-2.0": 0.1, "psf-2.0": 0.1, "upl-1.0": 0.1, "artistic-2.0": 0.3, "apache-1.1": 0.15, "apache-2.0": 0.15, "cc-by": 0.2, "cc-by-3.0": 0.2, "cc-by-4.0": 0.2,
    "mpl-1.1": 0.4, "mpl-2.0": 0.4, "epl-1.0": 0.4, "epl-2.0": 0.4, "cddl-1.0": 0.4, "lgpl": 0.45, "lgpl-2.0": 0.45, "lgpl-2.1": 0.45, "lgpl-3.0": 0.45, "cc-by-sa": 0.5, "cc-by-sa-3.0": 0.5, "cc-by-sa-4.0": 0.5,
    "gpl": 0.6, "gpl-1.0": 0.6, "gpl-2.0": 0.6, "gpl-3.0": 0.6, "eupl-1.2": 0.6, "agpl": 0.7, "agpl-3.0": 0.7,
    "cc-by-nc": 0.8, "cc-by-nc-4.0": 0.8, "cc-by-nd-4.0": 0.85, "cc-by-nc-sa-4.0": 0.85, "cc-by-nc-nd-4.0": 0.9, "cc-by-nc-sa": 0.85, "cc-by-nd": 0.85, "cc-by-nc-nd": 0.9, "reserved": 1.0, "proprietary": 1.0,
}
UNKNOWN = 0.5
#: Identifiers that an expression may define by itself.
_OWN = ("licenseref-", "documentref-")

_WORD = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else c + 32 if 65 <= c < 91 else 32 for c in range(256))
_AFTER_TAG = re.compile(rb"([\s\"'`*_>)\]]*[:=]+)?[\s\"'`*<]*")
_LINE = re.compile(rb"[^\n\r*#;\"'`<>]*")
_PART = re.compile(r"\(|\)|[A-Za-z0-9.+-]+")


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for phrase, label in {**PHRASES, **TAGS, **BASE_PHRASES}.items():
        a.add_word(f" {phrase} ", (phrase, label))
    a.make_automaton()
    return a


def normal(text: str | None) -> tuple[str, int]:
    """(words joined by, and between, single spaces; number of words)."""
    words = (text or "").encode("utf-8", "replace").translate(_WORD).split()
    return f" {b' '.join(words).decode()} ", len(words)


def _short(identifier: str) -> str:
    s = identifier.lower().rstrip(".")
    for end in ("-or-later", "-only", "+"):
        s = s.removesuffix(end)
    return s


class Malformed(ValueError):
    """An expression that does not follow the grammar."""


#: Binding strength of the operators.
_STRENGTH = {"or": 1, "and": 2, "with": 3}


def postfix(expression: str) -> list[str]:
    """The expression in postfix order, by shunting-yard. Operators are lower-case, identifiers keep their letters."""
    out: list[str] = []
    stack: list[str] = []
    operand = True  # expected next
    for m in _PART.finditer(expression):
        p = m.group()
        low = p.lower()
        if low in _STRENGTH:
            if operand:
                raise Malformed(expression)
            while stack and stack[-1] != "(" and _STRENGTH[stack[-1]] >= _STRENGTH[low]:
                out.append(stack.pop())
            stack.append(low)
            operand = True
        elif p == "(":
            if not operand:
                raise Malformed(expression)
            stack.append(p)
        elif p == ")":
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if operand or not stack:
                raise Malformed(expression)
            stack.pop()
        elif operand:
            out.append(p)
            operand = False
        else:  # prose after the expression
            break
    while stack:
        if stack[-1] == "(" or operand:
            raise Malformed(expression)
        out.append(stack.pop())
    if not out:
        raise Malformed(expression)
    return out


def evaluate(expression: str) -> tuple[list[str], float]:
    """(licences named, restriction) of an expression."""
    stack: list[tuple[float, str | None]] = []
    named = []
    for p in postfix(expression):
        if p not in _STRENGTH:
            named.append(_short(p))
            stack.append((RESTRICTION.get(_short(p), UNKNOWN), _short(p)))
            continue
        if len(stack) < 2:
            raise Malformed(expression)
        (b, exception), (a, _) = stack.pop(), stack.pop()
        if p == "with":
            if exception in named:
                named.remove(exception)
            stack.append((max(0.0, a - 0.2), None))
        else:
            stack.append((min(a, b) if p == "or" else max(a, b), None))
    if len(stack) != 1:
        raise Malformed(expression)
    return named, stack[0][0]


def _identifiers(expression: str) -> list[str]:
    """The identifiers of a malformed expression, up to prose."""
    out: list[str] = []
    operand = False  # just read
    for p in _PART.findall(expression):
        word = p not in "()" and p.lower() not in _STRENGTH
        if word and operand:
            break
        if word:
            out.append(_short(p))
        operand = word or p == ")"
    return out


def expressions(text: str, tags: list[tuple[int, int]]) -> Iterator[tuple[str, bool]]:
    """(expression, is there a separator) behind each tag. tags: numbers of their first and last words, ascending."""
    raw = text.encode("utf-8", "replace")
    gap = np.frombuffer(b" " + raw.translate(_WORD) + b" ", np.uint8) == 32
    starts, ends = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])
    for i, (_, last) in enumerate(tags):
        stop = int(starts[tags[i + 1][0]]) if i + 1 < len(tags) else len(raw)
        after = _AFTER_TAG.match(raw, int(ends[last]), stop)
        yield _LINE.match(raw, after.end(), stop).group().decode("utf-8", "replace"), after.group(1) is not None


def judge(text: str | None) -> dict:
    """What a text says about its licence."""
    words, n = normal(text)
    base: list[int] = []
    base_labels, labels, values, tags = set(), set(), [], []
    done, count = 0, 0  # words counted so far: matches come by their end, so starts are counted from the match's end
    for end, (phrase, label) in automaton().iter(words):
        count += words.count(" ", done, end + 1)
        done = end + 1
        if phrase in TAGS:
            tags.append((count - 1 - len(phrase.split()), count - 2))
            continue
        labels.add(label)
        values.append(RESTRICTION.get(label, UNKNOWN))
        if phrase in BASE_PHRASES:
            base_labels.add(label)
            base.append(count - 2 - phrase.count(" "))
    for expression, separated in expressions(text, tags) if tags and text else ():
        try:
            named, value = evaluate(expression)
        except Malformed:
            if separated:
                labels.update(x for x in _identifiers(expression) if x in RESTRICTION)
            continue
        known = [x for x in named if x in RESTRICTION or x.startswith(_OWN)]
        if not known or not separated and len(known) < len(named):
            continue
        labels.update(known)
        values.append(value)
    return {
        "n_words": n, "n_base": len(base), "first_word": min(base) if base else None, "last_word": max(base) if base else None,
        "base_labels": ",".join(sorted(base_labels)), "labels": ",".join(sorted(labels)), "score": round(float(max(values, default=0.0)), 4),
    }


_SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
    for batch in batches:
        rows = [judge(t) for t in batch.column(1).to_pylist()]
        if rows:
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], kind) for k, kind in zip(rows[0], kinds, strict=True))], names=["doc_id", *rows[0]])


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of docs: words, places and labels of the base phrases, all labels, and the strictest restriction found."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(lean(_scan), _SCHEMA)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
