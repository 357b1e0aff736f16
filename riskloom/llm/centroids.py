"""Centroid clustering: integer k-means with PCA-rotated filtering.

Vectors become integers; k-means runs on them exactly. Beside the integers a table
stores each vector's LEADING coordinates after a rotation to the principal axes, and
the norm of the rest (the residual). The rotation is orthonormal, so that the squared
distance of the leading coordinates plus the squared difference of the residual norms
never exceeds the squared distance. The centroid with the least such bound is measured
in integers; only centroids whose bound does not exceed that distance (and a margin
for rounding) survive and are measured in integers, ties to the smaller number. The
rotation decides how many survive, never the result.

The principal axes come from sums of products over all vectors, added up as integers,
as many numbers as a matrix of the width has. A round is one pass over the table in
Arrow batches and returns sums by centroid and component; nothing else reaches the
driver, and no pass shuffles vectors.

Defined results: rows whose vector is null, of another width, or has null or
non-finite components are dropped; integers are held within 2**27, beyond any
embedding; the first centroids are the vectors with the least hashes of their ids
(a NULL id hashes like the word null; ties by components; rows counted one by one),
fewer if there are fewer rows; repeated rows get equal results; an empty table gives
an empty result; columns other than id and vector are not read. Sums too large for a
long are NULL.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import load, saved
from riskloom.llm.vectors import LIMIT, SLOTS, finite, lists, matrix, slots, summed, whole

WIDTH = 64
CENTROIDS = 16
ROUNDS = 3
SCALE = 64
SEED = 1
LEADING = 12
MARGIN = 1e-7  # of the squared norms: far above the error of the rotated coordinates


def principal_axes(rows: DataFrame, width: int, scale: int) -> np.ndarray:
    """Orthonormal columns, by decreasing variance, of the integer vectors of ``rows`` (one list column)."""
    upper = np.triu_indices(width)

    def run(batches):
        # Spark adds the batches up as decimals
        for batch in batches:
            x = whole(matrix(batch.column(0), width), scale)
            products = np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x)[upper]])
            yield slots(products)

    found = summed(rows.mapInArrow(run, SLOTS))
    flat = [found.get(i, 0) for i in range(1 + width + len(upper[0]))]
    n, mean = max(1, flat[0]), np.array(flat[1 : width + 1], np.float64)
    products = np.zeros((width, width))
    products[upper] = np.array(flat[width + 1 :], np.float64)
    spread = products + np.triu(products, 1).T - np.outer(mean, mean) / n
    return np.linalg.eigh(spread)[1][:, ::-1].copy()


def rotated(vectors: np.ndarray, axes: np.ndarray, leading: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading coordinates and the norm of the others."""
    turned = vectors.astype(np.float64) @ axes
    return turned[:, :leading], np.linalg.norm(turned[:, leading:], axis=1)


def nearest(vectors: np.ndarray, turned: np.ndarray, residual: np.ndarray, centroids: np.ndarray, axes: np.ndarray):
    """Number of the nearest centroid and the squared distance to it, for each vector; exact. Also: centroids measured."""
    places, rests = rotated(centroids, axes, turned.shape[1])
    bound = (residual[:, None] - rests[None, :]) ** 2
    for j in range(turned.shape[1]):
        bound += (turned[:, j, None] - places[None, :, j]) ** 2
    first = bound.argmin(axis=1)
    gap = vectors - centroids[first]
    best = np.einsum("ij,ij->i", gap, gap)
    found = first.copy()
    norms = (turned**2).sum(axis=1) + residual**2
    margin = MARGIN * (norms[:, None] + (centroids.astype(np.float64) ** 2).sum(axis=1)[None, :]) + 1e-6
    survives = bound <= best[:, None] + margin
    survives[np.arange(len(vectors)), first] = False
    measured = len(vectors)
    for c in range(len(centroids)):
        rows = np.flatnonzero(survives[:, c])
        measured += len(rows)
        gap = vectors[rows] - centroids[c]
        square = np.einsum("ij,ij->i", gap, gap)
        closer = (square < best[rows]) | ((square == best[rows]) & (c < found[rows]))
        best[rows[closer]], found[rows[closer]] = square[closer], c
    return found, best, measured


def prepared(table: DataFrame, width: int, scale: int, leading: int, id_column: str, vector_column: str) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, ints, turned, residual of the kept vectors; the axes)."""
    rows = table.select(F.col(id_column).alias("vec_id"), F.col(vector_column).alias("v")).filter(finite("v") & (F.size("v") == width))
    axes = principal_axes(rows.select("v"), width, scale)

    def run(batches):
        for batch in batches:
            ints = whole(matrix(batch.column(1), width), scale)
            turned, residual = rotated(ints, axes, leading)
            columns = [batch.column(0), lists(ints, pa.int32()), lists(turned, pa.float64()), pa.array(residual)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "ints", "turned", "residual"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return saved(rows.mapInArrow(run, f"vec_id {kind}, ints array<int>, turned array<double>, residual double"), "rotated"), axes


def _measured(batch, width: int, leading: int, centroids, axes):
    vectors = matrix(batch.column("ints"), width, np.int64)
    turned, residual = matrix(batch.column("turned"), leading), batch.column("residual").to_numpy(zero_copy_only=False)
    return vectors, *nearest(vectors, turned, residual, centroids, axes)[:2]


def cluster(
    table: DataFrame, width: int = WIDTH, n_centroids: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED,
    leading: int = LEADING, id_column: str = "vec_id", vector_column: str = "embedding",
) -> tuple[DataFrame, np.ndarray]:
    """(one row per kept vector: vec_id, cluster, distance; the final centroids)."""
    points, axes = prepared(table, width, scale, leading, id_column, vector_column)
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    first = points.select("ints", key.alias("key")).orderBy("key", "ints").limit(n_centroids).collect()
    centroids = np.array([r["ints"] for r in first], np.int64).reshape(len(first), width)

    def sums(at: np.ndarray):
        def run(batches):
            total = np.zeros((len(at), width + 1), np.int64)
            for batch in batches:
                vectors, found, _ = _measured(batch, width, leading, at, axes)
                np.add.at(total[:, :width], found, vectors)
                total[:, width] += np.bincount(found, minlength=len(at))
            yield slots(total)

        return run

    if not len(first):
        none = points.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        return none.limit(0), centroids
    for _ in range(rounds):
        found = summed(points.mapInArrow(sums(centroids), SLOTS))
        new = centroids.copy()
        for c in range(len(centroids)):
            if count := found.get(c * (width + 1) + width, 0):
                new[c] = [found.get(c * (width + 1) + j, 0) // count for j in range(width)]
        centroids = new

    def last(batches):
        for batch in batches:
            _, found, best = _measured(batch, width, leading, centroids, axes)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(found.astype(np.int32)), pa.array(best)], ["vec_id", "cluster", "distance"])

    kind = points.schema["vec_id"].dataType.simpleString()
    return saved(points.mapInArrow(last, f"vec_id {kind}, cluster int, distance long"), "clusters"), centroids


def query(spark, sf_dir: str) -> DataFrame:
    out, centroids = cluster(load(spark, sf_dir, "embeddings"))
    sums = {r["cluster"]: r["s"] for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    fits = lambda n: int(n) if abs(n) < 2**63 else None
    rows = [
        (c, fits(sums[c]), fits(sum(sums.values())), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest())
        for c in sorted(sums)
    ]
    per_cluster = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # one row per centroid: bounded by their number
    return out.join(F.broadcast(per_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    steps = [f"""
v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id,
    list_transform(embedding, lambda x: greatest(least(floor({SCALE} * x::DOUBLE), {LIMIT}), -{LIMIT})::BIGINT) AS x
  FROM embeddings
  WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT e, c FROM (
    SELECT x AS c, row_number() OVER (ORDER BY sha256('{SEED}:' || coalesce(vec_id::VARCHAR, 'null')), x) - 1 AS e FROM v)
  WHERE e < {CENTROIDS})"""]  # fmt: skip
    for r in range(ROUNDS + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (
  SELECT rid, min(struct_pack(d := d, e := e)) AS best FROM (
    SELECT rid, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, c{r})
  GROUP BY rid)""")  # fmt: skip
        if r < ROUNDS:
            steps.append(f"""
c{r + 1} AS MATERIALIZED (
  SELECT e, coalesce(m.c, c.c) AS c FROM c{r} AS c LEFT JOIN (
    SELECT e, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS c FROM (
      SELECT best.e AS e, j, sum(x[j]) AS s, count(*) AS n FROM a{r} JOIN v USING (rid), range(1, {WIDTH} + 1) AS t(j) GROUP BY ALL)
    GROUP BY e) AS m USING (e))""")  # fmt: skip
    return "WITH " + ",".join(steps) + f"""
SELECT vec_id, best.e::INT AS cluster, best.d AS distance, sum(best.d) OVER (PARTITION BY best.e)::BIGINT AS cluster_inertia,
  sum(best.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN v USING (rid) JOIN c{ROUNDS} ON e = best.e
"""


ORACLE = _oracle()
