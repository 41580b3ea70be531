import json
import random
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from loomvault.llm import arrowfiles, packing
from loomvault.llm.encode import Encoder, tokenizer_path
from loomvault.llm.shared import new_path

PATH = tokenizer_path()


def library(texts):
    """By a tokenizer that nothing has touched."""
    return [np.array(x.ids, "<u2").tobytes() for x in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_added_tokens_in_a_text_are_tokens():
    assert np.frombuffer(Encoder(PATH).encode(["a <|endoftext|> b"])[0], "<u2").tolist() == [64, 220, 50256, 275]


def test_unknown_pretokenizers_go_to_the_library(tmp_path):
    file = json.loads(open(PATH).read())
    file["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "t.json").write_text(json.dumps(file))
    e = Encoder(str(tmp_path / "t.json"))
    assert not e.known and e.encode(["one two"])[0] == np.array(Tokenizer.from_file(str(tmp_path / "t.json")).encode("one two", add_special_tokens=False).ids, "<u2").tobytes()


def test_encoder_matches_the_library():
    r = random.Random(1)
    letters = [" ", " ", "  ", "\n", " \n", "\t", "a", "b", "é", "1", "\xa0", "　", "'s", "'", ".", ",", "!", "<|endoftext|>", "\r\n", "🙂", "ł", "²", "_", "×", "X1", "don't "]
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 30))) for _ in range(3000)] + [None, "", "w" * 5000, "Words, and more words. " * 50]
    assert Encoder(PATH).encode(texts) == library(texts)


def test_files_round_trip(spark, docs, rows, empty):
    folder = new_path(spark, "test")
    manifest = arrowfiles.write(docs, folder, PATH)
    got = sorted(((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in arrowfiles.read(spark, folder, manifest).collect()))
    want = {}
    for x, ids in zip(rows, library([x["text"] for x in rows]), strict=True):
        a = np.append(np.frombuffer(ids, "<u2"), 0).astype("<u4")
        want.setdefault(x["doc_id"], []).append((len(a), zlib.crc32(a.tobytes())))
    at = 0
    for start, doc_id, n, crc in got:
        assert start == at
        at += n
        want[doc_id].remove((n, crc))
    assert not any(want.values())
    order = [d for _, d, _, _ in got]
    assert order == sorted(order, key=lambda d: -1 if d is None else d)
    reader = arrowfiles.Reader.open(f"{folder}/{manifest[0]['name']}")
    stream = []
    for r in manifest:
        reader = arrowfiles.Reader.open(f"{folder}/{r['name']}")
        for k in range(r["n_sequences"]):
            ids, mask = reader.sequence(k)
            assert len(ids) == 8 * len(mask) == arrowfiles.SEQUENCE and not ids.flags.owndata and not mask.flags.owndata
            stream.append(ids[arrowfiles.unpacked(mask)])
    by_place = {start: (n, crc) for start, _, n, crc in got}
    stream = np.concatenate(stream).astype("<u4")
    assert len(stream) == at
    assert all(zlib.crc32(stream[start : start + n].tobytes()) == crc for start, (n, crc) in by_place.items())
    assert arrowfiles.write(empty, new_path(spark, "none"), PATH) == [] and arrowfiles.read(spark, folder, []).count() == 0


def test_writer_handles_documents_longer_than_a_batch(tmp_path):
    path = str(tmp_path / "x.arrow")
    docs = [(1, 5), (2, 70), (3, 1), (4, 64), (5, 0), (6, 129)]
    with pa.OSFile(path, "wb") as sink:
        w = arrowfiles.Writer(sink, sequence=8, batch=4)
        for d, n in docs:
            w.add(d, np.arange(n, dtype="<u2") + d)
        w.close()
    got = [(d, at, ids.tolist()) for d, at, ids in arrowfiles.Reader.open(path).documents()]
    want, at = [], 0
    for d, n in docs:
        want.append((d, at, [d + i for i in range(n)]))
        at += n
    assert sorted(got) == sorted(want)


def test_rounds_cover_every_token_once():
    for trial in range(120):
        r = random.Random(trial)
        totals = [r.choice([r.randint(0, 400), r.randint(0, 3)]) for _ in range(r.randint(1, 6))]
        weights = None if trial % 2 else [r.choice([0, 1, 2, 3.5]) for _ in totals]
        phases = packing.plan(totals, weights)
        seen = np.zeros(sum(totals), int)
        for q, total in enumerate(totals):
            at = 0
            while at < total:
                n = min(r.randint(1, 90), total - at)
                found = packing.spans(phases, q, at, n, 64)
                assert sum(length for _, _, length in found) == n
                for _, place, length in found:
                    seen[place : place + length] += 1
                at += n
        assert (seen == 1).all()


def test_windows_follow_the_targets():
    totals, weights, window = [5000, 3000, 2000], [1.0, 1.0, 2.0], 400
    phases = packing.plan(totals, weights)
    owner = np.zeros(10000, int)
    for q, total in enumerate(totals):
        for _, place, length in packing.spans(phases, q, 0, total, window):
            owner[place : place + length] = q
    for w in range(phases[0].length // window):
        part = np.bincount(owner[w * window : (w + 1) * window], minlength=3)
        assert np.abs(part - np.array([100, 100, 200])).max() <= 1


def test_pack(docs, rows, empty, monkeypatch):
    for queues in (1024, 2):  # with two queues, sources share them
        monkeypatch.setattr(packing, "QUEUES", queues)
        got = packing.pack(docs, PATH, sequence=256, window_sequences=4).collect()
        want = sorted(zlib.crc32(np.append(np.frombuffer(i, "<u2"), 1).astype("<u2").tobytes()) for i in library([x["text"] for x in rows]))
        by_place = sorted(got, key=lambda r: (r["sequence_id"], r["offset"]))
        end = 0
        for r in by_place:
            assert r["sequence_id"] * 256 + r["offset"] == end and r["offset"] + r["length"] <= 256
            assert r["ids_crc32"] == zlib.crc32(np.frombuffer(r["ids"], "<u2").astype("<u4").tobytes()) and len(r["ids"]) == 2 * r["length"]
            end += r["length"]
        docs_of = {}
        for r in got:
            docs_of.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
        assert sum(r["length"] for r in got) == sum(len(i) // 2 + 1 for i in library([x["text"] for x in rows]))
        single = {k: v for k, v in docs_of.items() if sum(r["start"] == 0 for r in v) == 1}
        made = [zlib.crc32(b"".join(r["ids"] for r in sorted(v, key=lambda r: r["start"]))) for v in single.values()]
        assert len(made) > 60 and set(made) <= set(want)
    assert packing.pack(empty, PATH).count() == 0


def test_each_source_keeps_its_queue_at_any_number(docs, monkeypatch):
    def places():
        got = packing.pack(docs, PATH, sequence=256, window_sequences=4).collect()
        return sorted((r["sequence_id"], r["offset"], r["length"], r["ids_crc32"]) for r in got)

    want = places()
    monkeypatch.setattr(packing, "QUEUES", 1)
    assert places() == want


def test_shares_are_exact_for_many_queues_and_long_streams():
    r = random.Random(3)
    served = [r.choice([1, 7, 7, r.randint(1, 50)]) for _ in range(1500)]
    phase = packing.plan(served)[0]
    order = sorted((Fraction(2 * j + 1, 2 * m), k) for k, m in enumerate(served) for j in range(m))
    for x in (0, 1, 500, len(order) // 2, len(order) - 3, len(order)):
        assert phase.upto(x).tolist() == np.bincount([k for _, k in order[:x]], minlength=len(served)).tolist()
    big = packing.plan([r.randint(10**9, 9 * 10**9) for _ in range(40)])[0]
    for x in (big.length // 3, big.length - 12345):
        assert max(abs(d - Fraction(m * x, big.length)) for d, m in zip(big.upto(x).tolist(), big.served, strict=True)) <= 1
        assert sum(big.upto(x).tolist()) == x


def test_windows_are_those_of_a_deficit_round_robin():
    """Window by window, a sequential round-robin: each queue gets its share of the window and what it is owed from those before."""
    for trial in range(30):
        r = random.Random(trial)
        totals = [r.randint(1, 900) for _ in range(r.randint(2, 6))]
        for phase in packing.by_temperature(totals, 0.5) if trial % 2 else packing.plan(totals, [r.choice([1, 2, 5]) for _ in totals]):
            owed = [Fraction(0)] * len(totals)
            for x in range(0, phase.length, 64):
                size = min(64, phase.length - x)
                served = phase.upto(x + size) - phase.upto(x)
                for k, m in enumerate(phase.served):
                    owed[k] += Fraction(m * size, phase.length)
                    assert abs(owed[k] - int(served[k])) < 1 + Fraction(1, 2)  # never serves far ahead of what is owed, nor leaves more
                    owed[k] -= int(served[k])


def test_temperature_lets_classes_run_dry_together():
    totals = [1000, 1001, 9, 8, 0, 70000]
    phases = packing.by_temperature(totals, 0.5)
    assert len(phases) == 3 and [sum(p.served[k] for p in phases) for k in range(6)] == totals
    shares = np.array(phases[0].served) / phases[0].length
    assert shares[2] > 9 / sum(totals) * 2 and phases[1].served[2] == phases[1].served[3] == 0
    assert [p.served for p in packing.by_temperature(totals, 1.0)] == [tuple(totals)]
    assert packing.by_temperature([], 0.5) == [] == packing.by_temperature([0], 0.5)
