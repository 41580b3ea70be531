"""Token ids of whole texts by the tokenizers library, at the speed of a dictionary.

The byte-level tokenizer cuts texts into words by a pattern before it merges bytes. Every place where a single space stands
between two characters that are no white space is such a cut, and so are the borders between letters, digits, marks and a
lone line break. Texts are split there, each distinct word is merged once by the library's model and kept for later texts,
so most of a corpus costs a look-up. What is not certain to be one word of the pattern (other white space, apostrophes,
letters beyond Latin-1) goes to the library's tokenizer as it stands between two certain cuts.

That holds for the byte-level pre-tokenizer without a normalizer, which `_byte_level` checks. With any other tokenizer file, and for texts that
hold the string of an added token (which the library cuts out and gives its own id), whole texts go to the library.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from functools import lru_cache

import numpy as np

#: Words and pieces kept by a worker (about 150 bytes each); on reaching it, the worker starts afresh.
KEPT_WORDS = 800_000
#: Longer words are encoded each time.
KEPT_LENGTH = 48
TOKENIZER = "byte_bpe_50k.json"

_MARKS = (".", ",", "!", "?", ":", ";")
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(rf"[\x21-\x26\x28-\x7e{_LETTERS}]+(?:\n[\x21-\x26\x28-\x7e{_LETTERS}]+)*")
_WORDS = re.compile(rf"[{_LETTERS}]+|[0-9]+|\n|[^{_LETTERS}0-9\n]+")


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in a byte-level vocabulary: printable Latin-1 as itself, the rest from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_BYTES = _byte_letters()


def _byte_level(file: dict) -> bool:
    """Does this tokenizer cut texts as `Encoder.cut` and `_WORDS` take it to?"""
    cuts, model = file["pre_tokenizer"] or {}, file["model"]
    plain = cuts.get("type") == "ByteLevel" and cuts.get("use_regex", True) and not cuts.get("add_prefix_space")
    return bool(plain and not file["normalizer"] and model["type"] == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix"))


class Encoder:
    """Encodes texts to little-endian unsigned 16-bit ids (the vocabulary has fewer than 65,536)."""

    def __init__(self, path: str):
        if sys.byteorder != "little":
            raise OSError("ids are kept in little-endian order")
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known = _byte_level(json.loads(self.tokenizer.to_str()))
        if self.tokenizer.get_vocab_size(with_added_tokens=True) > 65536:
            raise ValueError("the vocabulary does not fit 16-bit ids")
        self.merge = self.tokenizer.model.tokenize
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}  # by what follows a single space

    def _word(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            ids = array("H", [t.id for t in self.merge(word.encode().decode("latin-1").translate(_BYTES))]).tobytes()
            if len(word) <= KEPT_LENGTH:
                self.words[word] = ids
        return ids

    def _piece(self, piece: str) -> bytes:
        """Ids of what stands between two certain cuts; all but a text's first piece start with their space."""
        space = piece[:1] == " "
        body = piece[1:] if space else piece
        if body.isalpha():
            return self._word(piece)
        if body[-1:] in _MARKS and body[:-1].isalpha():
            return self._word(piece[:-1]) + self._word(piece[-1])
        if _PLAIN.fullmatch(body):
            words = _WORDS.findall(body)
            if space:
                words[0] = " " + words[0]
            return b"".join([self._word(w) for w in words])
        return self._library(piece)

    def _library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    @staticmethod
    def cut(text: str) -> list[str]:
        """The text cut before single spaces between other characters."""
        parts = text.split(" ")
        out = [parts[0]]
        for p in parts[1:]:
            last = out[-1]
            if p and last and not p[0].isspace() and not last[-1].isspace():
                out.append(" " + p)
            else:
                out[-1] = f"{last} {p}"
        return out

    def _slow(self, text: str) -> bytes:
        return b"".join([self._piece(p) for p in self.cut(text)])

    def encode_one(self, text: str) -> bytes:
        if not self.known or any(t in text for t in self.added):
            return self._library(text)
        parts = text.split(" ")
        if not parts[0] or parts[0][-1].isspace():
            return self._slow(text)
        ids = list(map(self.pieces.get, parts))
        ids[0] = self._piece(parts[0])
        try:
            at = ids.index(None)
        except ValueError:
            return b"".join(ids)
        for i in range(at, len(ids)):
            if ids[i] is None:
                p = parts[i]
                if not p or p[0].isspace() or p[-1].isspace():
                    return self._slow(text)
                ids[i] = made = self._piece(" " + p)
                if len(p) <= KEPT_LENGTH:
                    self.pieces[p] = made
        return b"".join(ids)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; null counts as empty."""
        if len(self.words) + len(self.pieces) > KEPT_WORDS:
            self.words.clear()
            self.pieces.clear()
        return [self.encode_one(t) if t else b"" for t in texts]


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """The worker's encoder, kept between tasks."""
    return Encoder(path)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
