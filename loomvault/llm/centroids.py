"""Centroid clustering of integer vectors by annulus search.

Lloyd's rounds: every vector goes to its nearest centroid, and every centroid with vectors becomes their componentwise floor of the
mean. Distances are exact integers, so ties are real and go to the smaller number.

A vector's nearest centroid has a norm that differs from the vector's by at most the distance to any centroid (the triangle inequality
with the origin). So the centroids are sorted by norm; the distance to the centroid of the round before (in the first round, to
the one with the nearest norm) is the upper bound; binary search gives the centroids inside the annulus, its border included; only these
are compared, exactly.

At scale: a round is one scan of the vectors with the centroids (as many as asked for) at hand, and partial sums of each batch, so a
shuffle moves a few rows for each task whatever the number of vectors, and no cluster is gathered. Each round's assignment is
written beside the vectors, and so is the next round's bound.

Defined results: a vector that is null, has another number of components, or a null or non-finite one gives no row; repeated rows are vectors
each; a null vec_id stands for an empty string where the first centroids are drawn, ties there go by the components; with fewer vectors
than centroids there are as many centroids as vectors; an empty table gives an empty table; extra columns are ignored. A component beyond
2**26 after scaling is an error, since its distances may leave 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import lean, stash

DIM, SCALE, CENTROIDS, ROUNDS, SEED = 64, 64, 16, 3, 1
#: Largest absolute component; up to EXACT float64 products are exact, beyond it integers are multiplied.
MOST, EXACT = 1 << 26, 1 << 22


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    lists = column.values.slice(column.offset * dim, len(column) * dim) if isinstance(column, pa.FixedSizeListArray) else column.flatten()
    return lists.to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)


class Annulus:
    """Centroids sorted by norm, searched by annulus."""

    def __init__(self, centroids: np.ndarray):
        self.c = centroids
        self.square = (centroids * centroids).sum(1)
        norm = np.sqrt(self.square.astype(np.float64))
        self.order = np.argsort(norm, kind="stable")
        self.norm = norm[self.order]
        self.small = not len(centroids) or int(np.abs(centroids).max()) <= EXACT

    def distances(self, v: np.ndarray, square: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Exact squared distances of each vector to the centroid of the number beside it."""
        return square + self.square[number] - 2 * (v * self.c[number]).sum(1)

    def nearest(self, v: np.ndarray, guess: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number and squared distance of the nearest centroid, and how many distances were taken. guess: a centroid of each, or -1."""
        square = (v * v).sum(1)
        norm = np.sqrt(square.astype(np.float64))
        at = np.clip(np.searchsorted(self.norm, norm), 0, len(self.order) - 1)
        below = np.maximum(at - 1, 0)
        closer = self.order[np.where(np.abs(self.norm[below] - norm) < np.abs(self.norm[at] - norm), below, at)]
        best = np.where(guess >= 0, guess, closer)
        least = self.distances(v, square, best)
        bound = np.sqrt(least.astype(np.float64))
        slack = 1e-9 * (norm + bound + 1)  # rounding of the square roots never leaves a border tie out
        lo, hi = np.searchsorted(self.norm, norm - bound - slack, "left"), np.searchsorted(self.norm, norm + bound + slack, "right")
        taken = len(v)
        exact = self.small and (not len(v) or int(np.abs(v).max()) <= EXACT)
        real = v.astype(np.float64) if exact else v
        for j in range(int(lo.min(initial=0)), int(hi.max(initial=0))):
            number = int(self.order[j])
            rows = np.flatnonzero((lo <= j) & (j < hi) & (best != number))
            if not len(rows):
                continue
            taken += len(rows)
            product = (real[rows] @ self.c[number].astype(np.float64)).astype(np.int64) if exact else v[rows] @ self.c[number]
            d = square[rows] + self.square[number] - 2 * product
            won = (d < least[rows]) | ((d == least[rows]) & (number < best[rows]))
            least[rows[won]], best[rows[won]] = d[won], number
        return best, least, taken


_ASSIGNED = "vec_id long, v array<int>, cluster int, distance long"


def _assign(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Annulus(centroids)
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column(1), centroids.shape[1])
            best, least, _ = search.nearest(v, batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(best.astype(np.int32)), pa.array(least)], names=["vec_id", "v", "cluster", "distance"])

    return run


def _sums(dim: int):
    """Sums of each batch's vectors by cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cluster = batch.column(1).to_numpy().astype(np.int64)
            have, at = np.unique(cluster, return_inverse=True)
            total = np.zeros((len(have), dim), np.int64)
            np.add.at(total, at, _matrix(batch.column(0), dim))
            n = np.bincount(at, minlength=len(have))
            places = np.tile(np.arange(dim, dtype=np.int32), len(have))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(have, dim).astype(np.int32)), pa.array(places), pa.array(total.ravel()), pa.array(np.repeat(n, dim).astype(np.int64))], names=["cluster", "place", "total", "n"])

    return run


def kept(vectors: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """vec_id and v, the integer vector floor(scale * x), of vectors with `dim` components that are all finite."""
    whole = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    fine = (F.size("embedding") == dim) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    small = F.forall("embedding", lambda x: F.abs(x.cast("double")) <= MOST / scale)
    checked = F.when(small, whole.cast("array<int>")).otherwise(F.raise_error(F.lit(f"a component is beyond {MOST // scale}")).cast("array<int>"))
    return vectors.filter(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), checked.alias("v"))


def _first(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the least hashes of their numbers."""
    drawn = vectors.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256).alias("h"), "v")
    return np.array([r["v"] for r in drawn.orderBy("h", "v").limit(k).collect()], np.int64)  # k rows


def _means(assigned: DataFrame, centroids: np.ndarray) -> np.ndarray:
    dim = centroids.shape[1]
    parts = assigned.select("v", "cluster").mapInArrow(lean(_sums(dim)), "cluster int, place int, total long, n long")
    rows = parts.groupBy("cluster", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toArrow()  # a number for each component of each centroid
    out = centroids.copy()
    cluster, place, total, n = (rows.column(c).to_numpy() for c in ("cluster", "place", "total", "n"))
    out[cluster, place] = total // n
    return out


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, dim: int = DIM, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, v, cluster, distance) of every kept vector (vec_id, embedding), and the final centroids."""
    found = stash(kept(vectors, dim, scale), "vectors")
    centroids = _first(found, k, seed)
    if not len(centroids):
        return found.select("vec_id", "v", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), np.zeros((0, dim), np.int64)
    state = found.select("vec_id", "v", F.lit(-1).alias("cluster"))
    for _ in range(rounds):
        state = stash(state.select("vec_id", "v", "cluster").mapInArrow(lean(_assign(centroids)), _ASSIGNED), "assigned")
        centroids = _means(state, centroids)
    return stash(state.select("vec_id", "v", "cluster").mapInArrow(lean(_assign(centroids)), _ASSIGNED), "assigned"), centroids


def op13_annulus_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's cluster with its figures, and the digest of the cluster's final centroid."""
    found, centroids = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    digest = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    sums = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    rows = [(r["cluster"], r["cluster_inertia"]) for r in sums.collect()]  # one for each centroid
    total = sum(x for _, x in rows)
    facts = spark.createDataFrame([(i, dict(rows).get(i), total, h) for i, h in digest], "number int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), F.col("cluster") == F.col("number")).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _round_sql(r: int) -> str:
    return f"""
d{r} AS (SELECT x.rid, c.c, sum((x.v - c.v) * (x.v - c.v))::BIGINT AS d FROM x JOIN c{r} c USING (i) GROUP BY x.rid, c.c),
a{r} AS (SELECT rid, c, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, c) = 1),
m{r} AS (SELECT a.c, x.i, sum(x.v)::BIGINT AS s, count(*)::BIGINT AS n FROM x JOIN a{r} a USING (rid) GROUP BY a.c, x.i),
c{r + 1} AS (SELECT c.c, c.i, CASE WHEN m.n IS NULL THEN c.v ELSE (m.s - ((m.s % m.n) + m.n) % m.n) // m.n END AS v FROM c{r} c LEFT JOIN m{r} m ON m.c = c.c AND m.i = c.i)"""


#: DuckDB's own way to op13: all distances.
ORACLE_SQL = f"""
WITH e AS (SELECT row_number() OVER () AS rid, vec_id, embedding FROM embeddings WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda y: y IS NOT NULL AND isfinite(y))) = {DIM}),
k AS (SELECT rid, vec_id, list_transform(embedding, lambda y: floor({SCALE} * y::DOUBLE)::BIGINT) AS v FROM e),
x AS (SELECT rid, unnest(range(1, {DIM + 1})) AS i, unnest(v) AS v FROM k),
f AS (SELECT rid, row_number() OVER (ORDER BY sha256('{SEED}:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS c FROM k QUALIFY c < {CENTROIDS}),
c0 AS (SELECT f.c, x.i, x.v FROM f JOIN x USING (rid)),{",".join(_round_sql(r) for r in range(ROUNDS))},
d AS (SELECT x.rid, c.c, sum((x.v - c.v) * (x.v - c.v))::BIGINT AS d FROM x JOIN c{ROUNDS} c USING (i) GROUP BY x.rid, c.c),
a AS (SELECT rid, c, d FROM d QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, c) = 1),
g AS (SELECT c, sha256(string_agg(v::BIGINT::VARCHAR, ',' ORDER BY i)) AS h FROM c{ROUNDS} GROUP BY c)
SELECT k.vec_id, a.c::INT AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia, g.h AS centroid_sha256 FROM a JOIN k USING (rid) JOIN g USING (c)
"""
