import hashlib
import math
import random

import numpy as np

from loomvault.llm import centroids


def brute(rows, k=16, rounds=3, dim=64):
    kept = [(i, [math.floor(64 * x) for x in e]) for i, e in rows if e is not None and len(e) == dim and all(x is not None and math.isfinite(x) for x in e)]
    c = [v for _, _, v in sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), j, v) for j, (i, v) in enumerate(kept))][:k]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def assign():
        return [min((dist(v, m), j) for j, m in enumerate(c)) for _, v in kept]

    for _ in range(rounds):
        of = assign()
        for j in range(len(c)):
            own = [v for (_, v), (_, a) in zip(kept, of, strict=True) if a == j]
            if own:
                c[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    of = assign()
    total = sum(d for d, _ in of)
    inertia = [sum(d for d, a in of if a == j) for j in range(len(c))]
    return [(i, a, d, inertia[a], total, hashlib.sha256(",".join(map(str, c[a])).encode()).hexdigest()) for (i, _), (d, a) in zip(kept, of, strict=True)]


SCHEMA = "vec_id long, embedding array<float>, label int, v int, cluster string, distance string"


def table(spark, path, rows):
    spark.createDataFrame([(i, e, 1, 2, "c", None) for i, e in rows], SCHEMA).repartition(3).write.parquet(f"{path}/embeddings.parquet")
    return str(path)


def vectors(n, seed=1):
    r = random.Random(seed)
    f = lambda x: float(np.float32(x))
    out = [(i, [f(r.gauss(0, 1 + i % 3)) for _ in range(64)]) for i in range(n)]
    out += [(n + i, [f(0.25)] * 64) for i in range(40)]  # a hot vector
    out += [(n + 50 + i, [f((-1) ** (i % 2))] + [0.0] * 63) for i in range(6)]  # ties
    bad = [None, [], [1.0] * 63, [1.0] * 65, [1.0] * 63 + [None], [1.0] * 63 + [float("nan")], [1.0] * 63 + [float("-inf")]]
    return out + [(n + 100 + i, b) for i, b in enumerate(bad)] + [(None, out[3][1]), (None, out[3][1]), (5, out[5][1])]


def test_matches_brute_force(spark, tmp_path):
    for n, rows in enumerate((vectors(150), vectors(150)[:9], [(1, [1e6] * 64), (2, [-1e6] * 64), (3, [0.0] * 64), (3, [0.0] * 64)], [(1, None)], [])):
        got = [tuple(r) for r in centroids.op13_annulus_clusters(spark, table(spark, tmp_path / str(n), rows)).collect()]
        assert sorted(got, key=str) == sorted(brute(rows), key=str)


def test_annulus_is_exact_and_leaves_centroids_out():
    r = np.random.default_rng(2)
    v = r.integers(-40, 40, (500, 3)) * r.integers(1, 30, (500, 1))  # of very different norms
    c = v[:60].copy()
    c[30:] = c[:30]  # ties
    c[40] = -c[10]
    search = centroids.Annulus(c)
    d = ((v[:, None, :] - c[None]) ** 2).sum(2)
    want = d.argmin(1)
    first, least, _ = search.nearest(v, np.full(len(v), -1))
    again, _, taken = search.nearest(v, first)
    assert (first == want).all() and (again == want).all() and (least == d.min(1)).all()
    assert taken < 0.5 * d.size


def test_too_large_components_are_an_error(spark, tmp_path):
    import pytest

    with pytest.raises(Exception, match="beyond"):
        centroids.op13_annulus_clusters(spark, table(spark, tmp_path, [(1, [3e30] * 64)])).collect()
