import random
import re

import numpy as np
import pyarrow as pa

from loomvault.llm import kernels as K

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def test_words_are_those_of_the_pattern():
    r = random.Random(1)
    for _ in range(200):
        texts = ["".join(r.choice(" \t\n\x0b\x0c\r\x1cabé漢.") for _ in range(r.randint(0, 30))) for _ in range(r.randint(1, 6))]
        for at, buf, offs in K.text_chunks(pa.array(texts), limit=20):
            w = K.Words(buf, offs)
            for i in range(w.n_rows):
                got = [buf[a:b].tobytes() for a, b in zip(w.start[w.first[i] : w.first[i + 1]], w.end[w.first[i] : w.first[i + 1]], strict=True)]
                assert got == WORD.findall(texts[at + i].encode())


def test_hashes_depend_on_the_bytes_alone():
    long = "x" * 2000
    texts = [f"one Two {long} one", "two one", long]
    (_, buf, offs), = K.text_chunks(pa.array(texts))
    w = K.Words(buf, offs)
    h = w.hashes(lower=True)
    assert h[0] == h[3] == h[5] and h[1] == h[4] and h[2] == h[6] and len({*h.tolist()}) == 3
    assert w.hashes()[1] != w.hashes()[4]


def test_windows_stay_in_their_row():
    h = np.arange(10, dtype=np.uint64)
    for k in (1, 3, 9):
        first = np.array([0, 4, 4, 10])
        start, x = K.windows(h, first, k)
        assert start.tolist() == [s for a, b in ((0, 4), (4, 10)) for s in range(a, b - k + 1)]
        assert len(set(x.tolist())) == len(x)


def test_nulls_and_slices():
    a = pa.array(["a b", None, "", "c"]).slice(1)
    (_, buf, offs), = K.text_chunks(a)
    assert K.Words(buf, offs).counts().tolist() == [0, 0, 1]
    assert list(K.text_chunks(pa.array([], pa.string()))) == []
