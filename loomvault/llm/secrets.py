"""Secret scans: fixed patterns, and a linear-chain conditional random field over tokens.

Tokens (runs of letters, digits, `-`, `_` and bytes above 127) are tagged as begin, inside or outside of a secret. Features are
a token's shape, the words and marks around it, and figures of the whole file; tags are decoded by Viterbi over the whole
text. Nearly all tokens of prose are outside by so wide a margin that no path through them can be best (see `_certain`),
so the exact best path is searched only in the short stretches between them.

The field is fitted on TRAIN_LINES labelled lines that `training_lines` makes from a fixed seed: no row of any table is read for it,
so it costs the same at any scale, and every run has the same weights (a few kilobytes in the task closure).

Defined results: a null or empty text has no spans; repeated rows are scanned each for itself; very long texts are scanned whole;
an empty table gives an empty table; extra columns are ignored (`scan`) or kept (`redact`).
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import kernels as K
from .shared import documents, lean

TRAIN_LINES = 1000
SEED = 11
KINDS = ("assign", "access", "hex", "crf")

_ASSIGN = re.compile(rb"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{32,}")

O, B, I = 0, 1, 2  # noqa: E741

_IN = np.zeros(256, bool)
_IN[48:58] = _IN[65:91] = _IN[97:123] = _IN[128:] = True
_IN[list(b"-_")] = True
_CLASS = np.zeros(256, np.int64)  # of bytes: 0 other, 1 lower, 2 upper, 3 digit, 4 above 127
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 4

#: Words that announce a secret, and prefixes by which issuers mark theirs.
CUES = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "api-key", "key", "auth", "bearer", "authorization", "credential", "credentials", "access_key", "private_key", "client_secret", "access_token")
PREFIXES = (b"AKIA", b"ASIA", b"ghp_", b"gho_", b"glpat-", b"xox", b"sk-", b"sk_", b"pk_", b"eyJ", b"AIza")
_LENGTHS = np.array([4, 8, 12, 16, 20, 24, 32, 40, 64, 128])


def _cue_hashes() -> np.ndarray:
    raw = " ".join(CUES).encode()
    return np.sort(K.Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])).hashes(lower=True))


_CUES = _cue_hashes()
#: Feature groups and their sizes; each token has one value of each group.
GROUPS = {"length": 11, "classes": 32, "changes": 7, "hexlike": 3, "prefix": 2, "before": 6, "before2": 4, "gap": 8, "next_gap": 6, "next": 3, "length x classes": 352, "cue x gap": 48, "file": 6}
_BASE = dict(zip(GROUPS, np.cumsum([0, *GROUPS.values()])[:-1].tolist(), strict=True))
N_FEATURES = sum(GROUPS.values())


class Tokens:
    """Tokens of a run of texts with their features."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        inside = _IN[buf]
        edge = np.empty(len(buf) + 1, bool)
        edge[0], edge[-1] = (inside[0], inside[-1]) if len(buf) else (False, False)
        np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
        cut = np.flatnonzero(edge)
        start, end = cut[0::2], cut[1::2]
        inner = np.unique(offs[1:-1])
        inner = inner[(inner > 0) & (inner < len(buf))]
        if len(inner):
            inner = inner[inside[inner] & inside[inner - 1]]
            start, end = np.sort(np.concatenate([start, inner])), np.sort(np.concatenate([end, inner]))
        self.buf, self.start, self.end = buf, start, end
        self.first = np.searchsorted(start, offs).astype(np.int64)
        self.row = np.repeat(np.arange(len(offs) - 1), np.diff(self.first))
        self.size = np.diff(offs)

    def features(self) -> np.ndarray:
        """(tokens, groups): the index of each token's value in each group."""
        buf, s, e, row = self.buf, self.start, self.end, self.row
        n = len(s)
        out = np.zeros((n, len(GROUPS)), np.int32)
        if not n:
            return out
        cls = _CLASS[buf]
        sums = {}
        for c in (1, 2, 3, 4):
            t = np.zeros(len(buf) + 1, np.int32)
            np.cumsum(cls == c, out=t[1:])
            sums[c] = t
        number = {c: t[e] - t[s] for c, t in sums.items()}
        size = e - s
        changed = np.zeros(len(buf) + 1, np.int32)
        np.cumsum(cls[1:] != cls[:-1], out=changed[1:-1])
        changed[-1] = changed[-2] if len(buf) > 1 else 0
        changes = changed[e - 1] - changed[s]
        odd = size - number[1] - number[2] - number[3] - number[4]
        length = np.searchsorted(_LENGTHS, size)
        classes = (number[1] > 0) + 2 * (number[2] > 0) + 4 * (number[3] > 0) + 8 * (number[4] > 0) + 16 * (odd > 0)
        title = (number[2] == 1) & (cls[s] == 2) & (number[3] == 0) & (number[4] == 0) & (odd == 0)
        classes = np.where(title, 1, classes)
        letter = (buf >= 103) & (buf <= 122) | (buf >= 71) & (buf <= 90) | (buf >= 128) | (buf == 45) | (buf == 95)
        beyond = np.zeros(len(buf) + 1, np.int32)
        np.cumsum(letter, out=beyond[1:])
        hexlike = np.where(beyond[e] > beyond[s], 0, np.where(number[3] == size, 1, 2))
        prefix = np.zeros(n, np.int64)
        longer = np.flatnonzero(size >= 8)
        for p in PREFIXES:
            at = longer
            for k, byte in enumerate(p):
                at = at[buf[s[at] + k] == byte]
            prefix[at] = 1
        low = size <= 20  # no cue is longer
        cue = np.zeros(n, bool)
        some = np.flatnonzero(low & (size >= 3))
        h = K.span_hashes(buf, s[some], e[some], lower=True)
        cue[some] = _CUES[np.minimum(np.searchsorted(_CUES, h), len(_CUES) - 1)] == h
        same = np.zeros(n, bool)
        same[1:] = row[1:] == row[:-1]
        gap = np.zeros(n, np.int64)  # marks between a token and the one before
        weight = {61: 1, 58: 1, 34: 2, 39: 2}
        for byte, bit in weight.items():
            t = np.zeros(len(buf) + 1, np.int32)
            np.cumsum(buf == byte, out=t[1:])
            gap[1:] |= np.where(t[s[1:]] > t[e[:-1]], bit, 0)
        space = np.zeros(n, np.int64)
        space[1:] = (s[1:] > e[:-1]) & ((buf[np.minimum(e[:-1], len(buf) - 1)] == 43) | (buf[np.minimum(e[:-1], len(buf) - 1)] == 47) | (buf[np.minimum(e[:-1], len(buf) - 1)] == 46)) & (s[1:] == e[:-1] + 1)
        gap = np.where(same, gap + 4 * space, 0)
        before = np.zeros(n, np.int64)
        before[1:] = np.where(same[1:], 1 + cue[:-1] + 2 * (length[:-1] >= 4), 0)
        before2 = np.zeros(n, np.int64)
        before2[2:] = np.where(row[2:] == row[:-2], 1 + cue[:-2], 0)
        after = np.zeros(n, np.int64)
        after[:-1] = np.where(same[1:], 1 + ((gap[1:] & 2) > 0) + 2 * (space[1:] > 0), 0)
        following = np.zeros(n, np.int64)
        following[:-1] = np.where(same[1:], 1 + (length[1:] >= 4), 0)
        per_row = np.maximum(self.size, 1)
        digit_share = np.add.reduceat(np.append(number[3], 0), np.minimum(self.first[:-1], n)) * (np.diff(self.first) > 0) / per_row
        file = np.searchsorted(np.array([0.001, 0.01, 0.05, 0.15, 0.4]), digit_share)[row]
        cols = [length, classes, np.minimum(changes, 6), hexlike, prefix, before, before2, gap, after, following, length * 32 + classes, before * 8 + gap, file]
        for k, (name, col) in enumerate(zip(GROUPS, cols, strict=True)):
            out[:, k] = _BASE[name] + col
        return out


def training_lines(n: int, seed: int) -> list[tuple[str, list[tuple[int, int]]]]:
    """Labelled lines: prose, notes and code, with the spans of the secrets in them."""
    r = random.Random(seed)
    syllables = "the of er on an re he in ed nd ha at en es or nt ti ea st ou tion ing ar le la de que ent ch ei un der lich".split()
    letters, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    alnum = letters + letters.upper() + digits

    def word() -> str:
        w = "".join(r.choice(syllables) for _ in range(r.choice([1, 1, 2, 2, 3, 4, 6])))
        return r.choice([w, w, w, w.capitalize(), w.upper(), w + r.choice([".", ",", "!!", "***"])])

    def prose(k: int) -> str:
        return " ".join(word() for _ in range(k))

    def run(chars: str, k: int) -> str:
        return "".join(r.choice(chars) for _ in range(k))

    def harmless() -> str:
        return r.choice([
            run(digits, r.randint(1, 19)), f"{r.randint(1, 255)}.{r.randint(0, 255)}.{r.randint(0, 255)}.{r.randint(1, 255)}", f"{r.randint(1900, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}",
            f"+1 ({r.randint(200, 999)}) 555-{run(digits, 4)}", f"v{r.randint(0, 9)}.{r.randint(0, 20)}", f"https://example.org/{word().strip('.,!*')}/{run(letters, 6)}", f"user.{r.randint(1, 99)}@mail{r.randint(1, 9)}.example.com",
            f"{run(letters, 6)}_{run(letters, 5)}({run(letters, 4)})", f"{word()}-{word()}", f"x{r.randint(0, 99)} = {r.randint(0, 9999)}", f"{run(letters, 5)}: {word()}", "ISBN " + run(digits, 13), run(letters.upper(), r.randint(2, 9)),
            "".join([run(letters, r.randint(2, 6)), *(run(letters, r.randint(1, 8)).capitalize() for _ in range(r.randint(1, 6))), r.choice(["", "", run(digits, 1)]), r.choice(["", run(letters, 6).capitalize()])]),
            f"https://{run(letters, 5)}.example.{r.choice(['com', 'org'])}/{r.choice(['watch?v=', 'v/', 'p/'])}{run(alnum + '-_', 11)}", f"{run(letters, 5)}_{run(letters, 7)}_{run(digits, 2)}",
        ])

    def secret() -> str:
        return r.choice([
            "AKIA" + run(letters.upper() + digits, 16), run("0123456789abcdef", r.choice([32, 40, 64])), run(alnum, r.randint(16, 48)), run(alnum + "-_", r.randint(20, 44)), "ghp_" + run(alnum, 36), "sk-" + run(alnum, 40),
            "eyJ" + run(alnum, 20) + "." + run(alnum, 30) + "." + run(alnum, 27), run(alnum, 12) + "/" + run(alnum, 14) + "+" + run(alnum, 12), run(alnum, r.randint(8, 14)) + run(digits, 2), word().strip(".,!*") + run(digits, r.randint(1, 3)) + word().strip(".,!*") + run(digits, 1), "MII" + run(alnum + "+/", 61),
        ])

    out = []
    for _ in range(n):
        text = prose(r.randint(0, 12))
        spans = []
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            if r.random() < 0.55:
                s = secret()
                cue = r.choice([*CUES, "", ""])
                sep = r.choice([" = ", "=", ": ", ":", " ", " is ", " is ", '": "', " = '"]) if cue else " "
                plain = not re.search(r"\d", s) and not cue
                text += f" {cue}{sep}" if cue else " "
                if not plain:
                    spans.append((len(text), len(text) + len(s)))
                text += s + r.choice(["", '"', "'", ";", ","])
            else:
                text += " " + harmless()
            text += " " + prose(r.randint(0, 8))
        if r.random() < 0.1:
            text += " " + r.choice(["password", "token", "secret", "key"]) + " " + prose(3)
        out.append((text, spans))
    return out


def _labelled(lines: list[tuple[str, list[tuple[int, int]]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = [t.encode() for t, _ in lines]
    offs = np.cumsum([0, *map(len, raw)])
    tokens = Tokens(np.frombuffer(b"".join(raw), np.uint8), offs)
    tags = np.zeros(len(tokens.start), np.int64)
    for (_, spans), base in zip(lines, offs[:-1].tolist(), strict=True):
        for a, b in spans:
            at = np.flatnonzero((tokens.start >= base + a) & (tokens.start < base + b))
            tags[at] = I
            tags[at[:1]] = B
    return tokens.features(), tags, tokens.first


_FORBIDDEN = -1e4


def fit(lines: list[tuple[str, list[tuple[int, int]]]], steps: int = 50, rate: float = 0.5, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features, 3) and transitions (3, 3) of greatest conditional likelihood, by Adagrad on all lines at once."""
    feats, tags, first = _labelled(lines)
    n, count = int(np.diff(first).max()), len(first) - 1
    at = np.full((count, n), -1)
    for k in range(count):
        at[k, : first[k + 1] - first[k]] = np.arange(first[k], first[k + 1])
    live = at >= 0
    last = np.diff(first) > 0  # lines with a token
    w, t = np.zeros((N_FEATURES, 3)), np.zeros((3, 3))
    t[O, I] = _FORBIDDEN
    gw, gt = np.full_like(w, 1e-6), np.full_like(t, 1e-6)
    gold_w, gold_t = np.zeros_like(w), np.zeros_like(t)
    for k in range(feats.shape[1]):
        np.add.at(gold_w, (feats[:, k], tags), 1.0)
    pair = np.ones(len(tags), bool)
    pair[first[:-1][first[:-1] < len(tags)]] = False
    np.add.at(gold_t, (tags[np.flatnonzero(pair) - 1], tags[pair]), 1.0)
    np.add.at(gold_t, (O, tags[first[:-1][last]]), 1.0)  # a text begins and ends as if outside tokens stood around it
    np.add.at(gold_t, (tags[first[1:][last] - 1], O), 1.0)
    lse = lambda x, axis: (m := x.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis=axis))
    for _ in range(steps):
        u = w[feats].sum(axis=1)
        emit = np.where(live[:, :, None], u[np.maximum(at, 0)], 0.0)
        alpha, beta = np.zeros((count, n, 3)), np.zeros((count, n, 3))
        alpha[:, 0] = emit[:, 0] + t[O]
        beta[:, -1] = t[:, O]
        for j in range(1, n):
            step = lse(alpha[:, j - 1, :, None] + t, 1) + emit[:, j]
            alpha[:, j] = np.where(live[:, j, None], step, alpha[:, j - 1])
        for j in range(n - 2, -1, -1):
            step = lse(t + (emit[:, j + 1] + beta[:, j + 1])[:, None, :], 2)
            beta[:, j] = np.where(live[:, j + 1, None], step, t[:, O])
        z = lse(alpha[:, -1] + t[:, O], 1)
        prob = np.where(live[:, :, None], np.exp(alpha + beta - z[:, None, None]), 0.0)
        flat = np.zeros((len(tags), 3))
        flat[at[live]] = prob[live]
        grad_w = gold_w.copy()
        for k in range(feats.shape[1]):
            for c in range(3):
                grad_w[:, c] -= np.bincount(feats[:, k], weights=flat[:, c], minlength=N_FEATURES)
        grad_t = gold_t.copy()
        for j in range(1, n):
            rows = live[:, j]
            grad_t -= np.exp(alpha[rows, j - 1, :, None] + t + (emit[rows, j] + beta[rows, j])[:, None, :] - z[rows, None, None]).sum(axis=0)
        grad_t[O] -= prob[last, 0].sum(axis=0)
        grad_t[:, O] -= flat[first[1:][last] - 1].sum(axis=0)
        grad_t[O, I] = 0
        grad_w, grad_t = grad_w / count - decay * w, grad_t / count - decay * np.where(t > _FORBIDDEN / 2, t, 0)
        gw += grad_w**2
        gt += grad_t**2
        w += rate * grad_w / np.sqrt(gw)
        t += rate * grad_t / np.sqrt(gt)
    return w, t


@lru_cache(maxsize=1)
def model() -> tuple[np.ndarray, np.ndarray]:
    return fit(training_lines(TRAIN_LINES, SEED))


def viterbi(u: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The best tags of a stretch with outside tokens, or a text's edge (which counts as one), on both sides."""
    n = len(u)
    back = np.zeros((n, 3), np.int64)
    score = u[0] + t[O]
    for j in range(1, n):
        step = score[:, None] + t
        back[j] = step.argmax(axis=0)
        score = step.max(axis=0) + u[j]
    tags = np.zeros(n, np.int64)
    tags[-1] = int((score + t[:, O]).argmax())
    for j in range(n - 1, 0, -1):
        tags[j - 1] = back[j, tags[j]]
    return tags


def _certain(u: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Tokens that are outside on every best path: making them so (and a following inside token a begin) gains more than all transitions can cost."""
    real = t[t > _FORBIDDEN / 2]
    reach = 3 * (real.max() - real.min())
    turn = np.zeros(len(u))
    turn[:-1] = np.maximum(0, u[1:, I] - u[1:, B])
    return u[:, O] - np.maximum(u[:, B], u[:, I]) > reach + turn


def decode(tokens: Tokens, w: np.ndarray, t: np.ndarray) -> list[tuple[int, int, int]]:
    """(row, byte start, byte end) of the secrets on the best path."""
    n = len(tokens.start)
    if not n:
        return []
    feats = tokens.features()
    u = np.zeros((n, 3))
    for k in range(feats.shape[1]):
        u += w[feats[:, k]]
    open_ = np.flatnonzero(~_certain(u, t))
    if not len(open_):
        return []
    breaks = np.flatnonzero((np.diff(open_) > 1) | (tokens.row[open_[1:]] != tokens.row[open_[:-1]])) + 1
    out = []
    for stretch in np.split(open_, breaks):
        tags = viterbi(u[stretch], t)
        for j in np.flatnonzero(tags == B).tolist():
            k = j
            while k + 1 < len(tags) and tags[k + 1] == I:
                k += 1
            out.append((int(tokens.row[stretch[j]]), int(tokens.start[stretch[j]]), int(tokens.end[stretch[k]])))
    return out


def base_spans(raw: bytes) -> list[tuple[int, int, int, int, int]]:
    """(byte start, kind, byte end, secret's start, its end) of the fixed patterns."""
    found = [(m.start(), 0, m.end(), m.start(2), m.end(2)) for m in _ASSIGN.finditer(raw) if m.end(2) - m.start(2) >= 8]
    found += [(m.start(), 1, m.end(), m.start(), m.end()) for m in _ACCESS.finditer(raw) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end(), m.start(), m.end()) for m in _HEX.finditer(raw)]
    return sorted(found)


def spans_of(texts: pa.Array, weights: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[bytes, list[tuple[int, int, int, int, int]]]]:
    """For each text, its bytes and all spans. The field adds the spans that meet none of the fixed patterns."""
    for _, buf, offs in K.text_chunks(texts):
        extra: dict[int, list[tuple[int, int]]] = {}
        for row, a, b in decode(Tokens(buf, offs), *weights):
            extra.setdefault(row, []).append((a - int(offs[row]), b - int(offs[row])))
        for row in range(len(offs) - 1):
            raw = buf[offs[row] : offs[row + 1]].tobytes()
            found = base_spans(raw)
            starts = [f[0] for f in found]
            reach = list(accumulate((f[2] for f in found), max))  # the furthest end among the fixed spans up to each
            more = []
            for a, b in extra.get(row, []):
                before = bisect_left(starts, b)
                if not before or reach[before - 1] <= a:
                    more.append((a, 3, b, a, b))
            yield raw, sorted(found + more)


def _code_points(raw: bytes, spans: list[tuple[int, int, int, int, int]]) -> list[tuple[str, int, int]]:
    if not spans or raw.isascii():
        return [(KINDS[k], a, b) for a, k, b, _, _ in spans]
    lead = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return [(KINDS[k], int(lead[a]), int(lead[b])) for a, k, b, _, _ in spans]


_SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_crf long"


def _scan(weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[], [], [], []]
            digest, spans = [], []
            for raw, found in spans_of(batch.column(1), weights):
                places = _code_points(raw, found)
                for k in range(4):
                    counts[k].append(sum(f[1] == k for f in found))
                digest.append(hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in places if k != "crf").encode()).hexdigest())
                spans.append(",".join(f"{k}:{a}:{b}" for k, a, b in places))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts[:3]), pa.array(digest, pa.string()), pa.array(spans, pa.string()), pa.array(counts[3], pa.int64())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_crf"],
            )

    return run


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of docs: numbers of spans by kind, the digest of the fixed patterns' spans, and all spans in code points."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(lean(_scan(model())), _SCHEMA)


MASK = b"<SECRET>"


def _redact(weights, columns: list[str]):
    at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nulls = batch.column(at).is_null().to_pylist()
            out = []
            for null, (raw, found) in zip(nulls, spans_of(batch.column(at), weights), strict=True):
                parts, done = [], 0
                for a, b in sorted((f[3], f[4]) for f in found):
                    if a >= done:
                        parts += [raw[done:a], MASK]
                    done = max(done, b)
                out.append(None if null else b"".join([*parts, raw[done:]]).decode("utf-8", "replace"))
            arrays = list(batch.columns)
            arrays[at] = pa.array(out, batch.schema.field(at).type)
            if "n_chars" in columns:
                k = columns.index("n_chars")
                arrays[k] = pa.array([None if t is None else len(t) for t in out]).cast(batch.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    return run


def redact(docs: DataFrame) -> DataFrame:
    """docs with every secret in text replaced by MASK; n_chars, if there, follows."""
    return docs.mapInArrow(lean(_redact(model(), docs.columns)), docs.schema)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
