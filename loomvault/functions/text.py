"""Tokenizers as Spark columns, and a factory by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NGRAM = 3
PAD = "$"


def naive_tokens(text: Column) -> Column:
    """Words at white space, letters and digits only, lower-case, without empty ones."""
    clean = F.lower(F.regexp_replace(text, r"(?U)[^\p{IsAlphabetic}\p{N}\s]+", ""))  # once for the text, not for each word
    return F.filter(F.split(clean, r"(?U)\s+"), lambda w: w != "")


def ngrams(text: Column, n: int = NGRAM) -> Column:
    """Windows of n characters over the lower-case text, padded with n - 1 marks on either side."""
    if n < 1:
        raise ValueError("n must be positive")
    padded = F.concat(F.lit(PAD * (n - 1)), F.lower(text), F.lit(PAD * (n - 1)))
    return F.transform(F.sequence(F.lit(1), F.length(padded) - n + 1), lambda i: F.substr(padded, i, F.lit(n)))


def ngrams_of(text: str, n: int = NGRAM) -> list[str]:
    """The same for a query on the driver."""
    if n < 1:
        raise ValueError("n must be positive")
    p = PAD * (n - 1) + text.lower() + PAD * (n - 1)
    return [p[i : i + n] for i in range(len(p) - n + 1)]


def naive_tokens_of(text: str) -> list[str]:
    words = ("".join(c for c in w if c.isalnum()).lower() for w in text.split())
    return [w for w in words if w]


def subword_tokens(path: str) -> Callable[[Column], Column]:
    """A tokenizer from a local file of the tokenizers library: marked tokens dropped, continuation marks removed, lower-case."""
    import pandas as pd

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(texts: pd.Series) -> pd.Series:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        out = []
        for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False):
            out.append([k.removeprefix("##").lower() for k in e.tokens if not (k.startswith("[") and k.endswith("]"))])
        return pd.Series(out)

    return run


def tokenizer(name: str = "naive", *, n: int = NGRAM, path: str | None = None, lang: Column | None = None) -> Callable[[Column], Column]:
    """The tokenizer of that name: naive, ngram, stemming or subword."""
    if name == "naive":
        return naive_tokens
    if name == "ngram":
        return lambda c: ngrams(c, n)
    if name == "stemming":
        from .stemming import stem_tokens

        return lambda c: stem_tokens(c, lang)
    if name == "subword":
        if path is None:
            raise ValueError("the subword tokenizer needs a file")
        return subword_tokens(path)
    raise ValueError(f"no tokenizer is called {name}")
