"""Operators on vectors against SQL and brute force, odd rows included."""

import hashlib
import math
from collections import Counter

import duckdb
import numpy as np
import pytest

from riskloom.llm import centroids, embedding_dedup, vector_codes
from riskloom.llm.catalog import ORACLES, QUERIES

NAMES = ["op11_vector_codes", "op12_centroids", "op13_embedding_dedup"]
SCHEMA = "vec_id long, embedding array<float>, label int, unit int, n int, codes string, cluster string"


def rows_of(vectors, start=0, label=lambda i: i % 3):
    plain = lambda v: None if v is None else [None if x is None else float(x) for x in v]
    return [(start + i, plain(v), label(i), 7, 7, "c", "k") for i, v in enumerate(vectors)]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Repeated rows, equal vectors, near copies, NULL ids and labels, broken vectors, other lengths, extra columns."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(90, 64)) * 0.12
    near = base[:1] + rng.normal(size=(40, 64)) * 0.012
    rows = rows_of(np.concatenate([base, near, np.repeat(base[3:4], 30, 0)]))
    rows += [rows[5], rows[5], (None, rows[6][1], None, 7, 7, "c", "k"), (None, rows[6][1], None, 7, 7, "c", "k")]
    broken = [None, [], [None] * 64, [float("nan")] * 64, [float("inf")] + [0.0] * 63, [0.0] * 64, [1.0] * 8, [1.0] * 7, [1e30] * 64, [-1e-30] * 64, [100.0] * 64]
    rows += rows_of(broken, 1000, lambda i: None)
    path = tmp_path_factory.mktemp("vectors")
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{path}/embeddings.parquet")
    return str(path)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("none")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{path}/embeddings.parquet")
    return str(path)


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows_equal_sql(spark, odd, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{odd}/embeddings.parquet/*.parquet')")
    got = QUERIES[name](spark, odd)
    cols = sorted(got.columns)
    expected = con.execute(f"SELECT {', '.join(cols)} FROM ({ORACLES[name]})").fetchall()
    assert Counter(map(tuple, got.select(*cols).collect())) == Counter(expected)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, empty, odd, name):
    got = QUERIES[name](spark, empty)
    assert got.collect() == []
    assert got.columns == QUERIES[name](spark, odd).columns


# --- product codes ---------------------------------------------------------------------


def lloyd(vectors, first, rounds):
    """Plain integer k-means: (codes, squared distances, entries) after ``rounds`` moves."""
    books = first.copy()
    for r in range(rounds + 1):
        square = ((vectors[:, None, :] - books[None]) ** 2).sum(2)
        code = square.argmin(1)
        if r == rounds:
            return code, square[np.arange(len(vectors)), code], books
        for e in range(len(books)):
            if (code == e).any():
                books[e] = vectors[code == e].sum(0) // (code == e).sum()


@pytest.mark.parametrize(("parts", "entries", "rounds", "scale"), [(4, 9, 12, 40), (2, 1, 2, 9), (4, 30, 5, 3)])
def test_codes_equal_plain_k_means(spark, parts, entries, rounds, scale):
    rng = np.random.default_rng(entries)
    vectors = np.float32(rng.normal(size=(700, 8)) + rng.integers(-2, 3, (700, 1)))
    coded, books = vector_codes.compress(spark.createDataFrame(rows_of(vectors), SCHEMA).repartition(7), parts, entries, rounds, scale)
    whole = np.floor(vectors.astype(np.float64) * scale).astype(np.int64).reshape(700, parts, -1)
    per_part = [lloyd(whole[:, p], whole[:entries, p], rounds) for p in range(parts)]
    got = sorted((r["vec_id"], list(r["codes"]), r["error"]) for r in coded.collect())
    assert got == [(i, [int(c[i]) for c, _, _ in per_part], int(sum(d[i] for _, d, _ in per_part))) for i in range(700)]
    assert (books == np.stack([b for _, _, b in per_part])).all()


def test_bounds_settle_most_parts_and_adapt():
    rng = np.random.default_rng(2)
    points = (rng.normal(size=(4000, 8)) * 300 + rng.integers(-3, 4, (4000, 1)) * 900).astype(np.int64)
    books = points[:16].copy()
    part, needs = vector_codes.Part(points, books).start(4), []
    for _ in range(6):
        new = books.copy()
        for e in range(16):
            if (part.code == e).any():
                new[e] = points[part.code == e].sum(0) // (part.code == e).sum()
        way = vector_codes._root_up(((new - books) ** 2).sum(1))
        part = vector_codes.Part(points, new).resume(part.code, part.upper, part.near, part.lower, way)
        part.trim(4)
        exact = ((points[:, None] - new[None]) ** 2).sum(2)
        assert (part.code == exact.argmin(1)).all()
        assert (part.upper**2 >= exact[np.arange(4000), part.code]).all()
        assert (part.lower[:, 0] ** 2 <= np.partition(exact, 1, axis=1)[:, 1]).all()
        needs.append(np.bincount(part.need, minlength=6))
        books = new
    assert needs[-1][0] > needs[0][0] and needs[-1][0] > 2000  # most parts are settled by their bounds
    assert vector_codes.fewest(np.array([900, 80, 19, 1, 0, 0]), 4) == 2
    assert vector_codes.fewest(np.array([0, 0, 0, 0, 0, 50]), 4) == 4


# --- centroids -------------------------------------------------------------------------


def test_clusters_equal_plain_k_means(spark):
    rng = np.random.default_rng(8)
    vectors = np.float32(rng.normal(size=(900, 64)) * 0.2 + rng.integers(0, 4, (900, 1)))
    out, final = centroids.cluster(spark.createDataFrame(rows_of(vectors), SCHEMA).repartition(6), rounds=5)
    whole = np.floor(vectors.astype(np.float64) * 64).astype(np.int64)
    first = sorted(range(900), key=lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest())[:16]
    code, square, books = lloyd(whole, whole[first], 5)
    assert sorted(map(tuple, out.collect())) == [(i, int(code[i]), int(square[i])) for i in range(900)]
    assert (final == books).all()


def test_filter_spares_measurements():
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(2000, 64)) * 400 * 0.8 ** np.arange(64)).astype(np.int64)
    axes = np.eye(64)
    found, best, measured = centroids.nearest(vectors, *centroids.rotated(vectors, axes, 12), vectors[:16], axes)
    square = ((vectors[:, None] - vectors[None, :16]) ** 2).sum(2)
    assert (found == square.argmin(1)).all() and (best == square.min(1)).all()
    assert measured < 2000 * 16 / 3


# --- near-duplicates -------------------------------------------------------------------


def brute(vectors, threshold):
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = units @ units.T >= threshold
    label = np.arange(len(units))
    while True:
        new = np.where(near, label[None, :], len(label)).min(1)
        if (new == label).all():
            return near.sum(1) - 1, label
        label = new


@pytest.mark.parametrize(("spread", "threshold"), [(0.02, 0.9), (0.075, 0.9), (0.1, 0.85)])
def test_links_of_dense_and_loose_groups(spark, spread, threshold):
    """Groups within a ball, groups that reach beyond one (members compared one by one), pairs, strangers."""
    rng = np.random.default_rng(int(spread * 1000))
    heads = rng.normal(size=(3, 24))
    heads /= np.linalg.norm(heads, axis=1, keepdims=True)
    groups = [head + rng.normal(size=(n, 24)) * spread for head, n in zip(heads, (400, 150, 20), strict=True)]
    strangers = rng.normal(size=(300, 24))
    pairs = strangers[:50] + rng.normal(size=(50, 24)) * 0.2
    vectors = np.float32(np.concatenate([*groups, strangers, pairs]))
    found = embedding_dedup.links(spark.createDataFrame(rows_of(vectors), SCHEMA).repartition(5), threshold).orderBy("vec_id").collect()
    n_links, label = brute(vectors.astype(np.float64), threshold)
    got = np.array([r["n_links"] for r in found])
    assert (got <= n_links).all() and got.sum() >= 0.97 * n_links.sum()
    assert (np.array([r["component_id"] for r in found]) == label).mean() > 0.98


def test_large_cells_are_cut_into_blocks(spark, monkeypatch):
    """A loose crowd: cells of several blocks, balls of several blocks, the same links as with one block."""
    rng = np.random.default_rng(4)
    vectors = np.float32(rng.normal(size=(1, 16)) + rng.normal(size=(500, 16)) * 0.3)
    table = spark.createDataFrame(rows_of(vectors), SCHEMA)
    whole = sorted(map(tuple, embedding_dedup.links(table).collect()))
    monkeypatch.setattr(embedding_dedup, "BLOCK", 40)
    monkeypatch.setattr(embedding_dedup, "PAIRS", 500)
    assert sorted(map(tuple, embedding_dedup.links(table).collect())) == whole
    monkeypatch.setattr(embedding_dedup, "CROWD", 10**9)  # without balls: all pairs of a cell one by one
    n_links, _ = brute(vectors.astype(np.float64), 0.9)
    alone = np.array([x[1] for x in sorted(map(tuple, embedding_dedup.links(table).collect()))])
    assert (alone <= n_links).all() and alone.sum() >= 0.97 * n_links.sum()
    assert np.array([x[1] for x in whole]).sum() >= 0.97 * n_links.sum()


def test_estimates_are_unbiased_and_bounds_hold():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = 0.9 * x + math.sqrt(1 - 0.81) * np.roll(x, 1, axis=0)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    true = (x * y).sum(1)
    coded = embedding_dedup.Codes(embedding_dedup.codes(np.concatenate([x, y])))
    at = np.arange(4000)
    bound = coded.most(at, at + 4000)
    assert (bound >= true).mean() > 0.999
    embedding_dedup.SURE, kept = 0.0, embedding_dedup.SURE
    try:
        assert abs((coded.most(at, at + 4000) - true).mean()) < 0.01
    finally:
        embedding_dedup.SURE = kept


def test_recall_of_cells_is_as_planned():
    turns, n_tables = embedding_dedup.tables(64, 50_000, 0.9)
    p = embedding_dedup.meeting(64, 0.9)
    assert turns == 2 and 0.4 < p < 0.55
    assert 1 - (1 - p**turns) ** n_tables >= embedding_dedup.RECALL
