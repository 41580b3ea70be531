"""Stemming: the published Porter2 algorithm for English and Snowball's for German, on the distinct words of a batch.

Languages without an algorithm here keep their words. A language column decides; without one, stop words do.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Frequent words that tell the languages apart.
STOP_WORDS = {
    "en": "the of and to in is that it was for on are with as his they be at this from".split(),
    "de": "der die das und ist von den mit sich des auf für nicht ein eine dem zu im".split(),
    "fr": "le la les des et est un une du en que dans qui pour pas sur au avec".split(),
    "es": "el la los las de que y en un una por con para del se al es".split(),
}

_V = "aeiouy"
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
# Words outside the English rules.
_SPECIAL = {"skis": "ski", "skies": "sky", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_KEEP = ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")
_STEP2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("entli", "ent"), ("izer", "ize"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"),
    ("alism", "al"), ("aliti", "al"), ("alli", "al"), ("fulness", "ful"), ("ousli", "ous"), ("ousness", "ous"), ("iveness", "ive"), ("iviti", "ive"), ("biliti", "ble"), ("bli", "ble"), ("fulli", "ful"), ("lessli", "less"),
]
_STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize")


def _regions(w: str, vowels: str, prefixes: tuple[str, ...] = ()) -> tuple[int, int]:
    """Where R1 and R2 begin: after the first non-vowel that follows a vowel, and again."""

    def after(at: int) -> int:
        for i in range(at + 1, len(w)):
            if w[i] not in vowels and w[i - 1] in vowels:
                return i + 1
        return len(w)

    r1 = next((len(p) for p in prefixes if w.startswith(p)), None)
    r1 = after(0) if r1 is None else r1
    return r1, after(r1) if r1 < len(w) else len(w)


def _short(w: str) -> bool:
    """The word ends in a short syllable."""
    if len(w) == 2:
        return w[0] in _V and w[1] not in _V
    return len(w) > 2 and w[-1] not in _V + "wxY" and w[-2] in _V and w[-3] not in _V


@lru_cache(maxsize=65536)
def english(word: str) -> str:
    if len(word) < 3:
        return word
    if word in _SPECIAL:
        return _SPECIAL[word]
    if word in _KEEP:
        return word
    w = re.sub(r"(?<=[aeiouy])y", "Y", re.sub(r"^y", "Y", word.lstrip("'")))
    r1, r2 = _regions(w, _V, ("gener", "commun", "arsen"))
    # 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in _V for c in w[:-2]):
        w = w[:-1]
    if w in ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"):
        return w
    # 1b
    for end in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if w.endswith(end):
            stem = w[: -len(end)]
            if end in ("eed", "eedly"):
                w = stem + "ee" if len(stem) >= r1 else w
            elif any(c in _V for c in stem):
                w = stem
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif w.endswith(_DOUBLE):
                    w = w[:-1]
                elif _short(w) and len(w) <= r1:
                    w += "e"
            break
    # 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    # 2
    for end, new in sorted(_STEP2, key=lambda p: -len(p[0])):
        if w.endswith(end):
            if len(w) - len(end) >= r1:
                w = w[: -len(end)] + new
            break
    else:
        if w.endswith("ogi") and len(w) - 3 >= r1 and w[-4:-3] == "l":
            w = w[:-1]
        elif w.endswith("li") and len(w) - 2 >= r1 and w[-3:-2] in tuple("cdeghkmnrt"):
            w = w[:-2]
    # 3
    for end, new in sorted(_STEP3, key=lambda p: -len(p[0])):
        if w.endswith(end):
            if len(w) - len(end) >= r1:
                w = w[: -len(end)] + new
            break
    else:
        if w.endswith("ative") and len(w) - 5 >= r2:
            w = w[:-5]
    # 4
    for end in sorted((*_STEP4, "ion"), key=len, reverse=True):
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r2 and (end != "ion" or w[at - 1 : at] in ("s", "t")):
                w = w[:at]
            break
    # 5
    if w.endswith("e"):
        at = len(w) - 1
        if at >= r2 or (at >= r1 and not _short(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


@lru_cache(maxsize=65536)
def german(word: str) -> str:
    vowels = "aeiouyäöü"
    w = word.replace("ß", "ss")
    w = re.sub(rf"(?<=[{vowels}])([uy])(?=[{vowels}])", lambda m: m.group(1).upper(), w)
    r1, r2 = _regions(w, vowels)
    r1 = max(r1, 3)
    for end in ("ern", "em", "er", "en", "es", "e", "s"):
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r1 and (end != "s" or w[at - 1 : at] in tuple("bdfghklmnrt")):
                w = w[:at]
                if end in ("e", "en", "es") and w.endswith("niss"):
                    w = w[:-1]
            break
    for end in ("est", "en", "er", "st"):
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r1 and (end != "st" or (at >= 4 and w[at - 1] in "bdfghklmnt")):
                w = w[:at]
            break
    for end in ("lich", "heit", "keit", "isch", "end", "ung", "ig", "ik"):
        if w.endswith(end):
            at = len(w) - len(end)
            if at < r2:
                break
            if end in ("end", "ung"):
                w = w[:at]
                if w.endswith("ig") and len(w) - 2 >= r2 and w[-3:-2] != "e":
                    w = w[:-2]
            elif end in ("ig", "ik", "isch"):
                w = w[:at] if w[at - 1 : at] != "e" else w
            elif end in ("lich", "heit"):
                w = w[:at]
                if w.endswith(("er", "en")) and len(w) - 2 >= r1:
                    w = w[:-2]
            else:
                w = w[:at]
                for more in ("lich", "ig"):
                    if w.endswith(more) and len(w) - len(more) >= r2:
                        w = w[: -len(more)]
                        break
            break
    return w.lower().translate(str.maketrans("äöü", "aou"))


STEMMERS = {"en": english, "de": german}


def detect(words: list[str]) -> str:
    """The language whose stop words are most frequent; English without any."""
    score = {k: sum(w in v for w in words) for k, v in _STOPS.items()}
    best = max(score, key=lambda k: score[k])
    return best if score[best] else "en"


_STOPS = {k: frozenset(v) for k, v in STOP_WORDS.items()}


@F.pandas_udf(T.ArrayType(T.StringType()))
def _stem(tokens: pd.Series, langs: pd.Series) -> pd.Series:
    out = []
    for words, lang in zip(tokens, langs, strict=True):
        words = [] if words is None else list(words)
        f = STEMMERS.get(lang or detect(words), lambda w: w)
        out.append([f(w) for w in words])
    return pd.Series(out)


def detected(tokens: Column) -> Column:
    """The same as `detect`, in the JVM."""
    held = lambda words: F.size(F.filter(tokens, lambda w: w.isin(*words)))
    scores = {k: held(v) for k, v in STOP_WORDS.items()}
    best, out = F.greatest(*scores.values()), F.when(F.lit(False), "en")
    for k, score in scores.items():  # the first of equals
        out = out.when((best > 0) & (score == best), k)
    return out.otherwise("en")


@F.pandas_udf(T.StringType())
def stem(words: pd.Series, langs: pd.Series) -> pd.Series:
    """Single words, stemmed in a language that is known."""
    return pd.Series([None if w is None else STEMMERS.get(lang, lambda x: x)(w) for w, lang in zip(words, langs, strict=True)], dtype=object)


def stem_tokens(text: Column, lang: Column | None = None) -> Column:
    """Naive tokens, stemmed in the row's language."""
    from .text import naive_tokens

    return _stem(naive_tokens(text), F.lit(None).cast("string") if lang is None else lang)
