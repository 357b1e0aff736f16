"""Prefix scans, medians by selection, keyed permutations."""

import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import metrics, ranking, stats
from riskloom.operators.permute import Permutation


def skewed(n=20_000, seed=3):
    rng = np.random.default_rng(seed)
    p = np.where(rng.random(n) < 0.9, rng.random(n) * 1e-9, rng.random(n) * 5e-4)
    p[:2] = 1.0, 5e-4
    return p, (rng.random(n) < 0.3).astype(int)


def test_ranges_are_even_whatever_the_scores(spark):
    p, _ = skewed()
    df = spark.createDataFrame([(float(x), 1) for x in set(p.tolist())], "s double, c long")
    cum = ranking.ordered_prefix_sums(df, [], "s", ["c"], splits=64)
    got = [r["c_cum"] for r in cum.orderBy("s").collect()]
    assert got == list(range(1, len(got) + 1))
    plan = cum._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile_approx" in plan
    cuts = sorted(set(p.tolist()))
    share = spark.createDataFrame([(x,) for x in cuts], "s double").agg(F.expr(f"percentile_approx(s, array({', '.join(str(i / 64) for i in range(1, 64))}), 1024)")).first()[0]
    sizes = np.diff(np.searchsorted(cuts, [-1, *share, 2]))
    assert sizes.max() <= 2 * len(cuts) / 64


def test_auc_and_precision_of_skewed_scores(spark):
    p, y = skewed(3000)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y, strict=True)], "p double, y int")
    pos, neg = p[y == 1], p[y == 0]
    auc = ((pos[:, None] > neg[None]).sum() + 0.5 * (pos[:, None] == neg[None]).sum()) / len(pos) / len(neg)
    assert abs(metrics.roc_auc(df, "y", "p").first()[0] - auc) < 1e-12


def test_prefix_sums_with_null_values_and_groups(spark):
    rows = [("a", None, 5), ("a", 1.0, 1), ("a", 2.0, 1), (None, 3.0, 7), (None, None, 2), ("b", float("inf"), 1), ("b", -1.0, 1)]
    df = spark.createDataFrame(rows, "g string, s double, c long")
    got = {(r["g"], r["s"]): r["c_cum"] for r in ranking.ordered_prefix_sums(df, ["g"], "s", ["c"], splits=4).collect()}
    assert got == {("a", None): 5, ("a", 1.0): 6, ("a", 2.0): 7, (None, None): 2, (None, 3.0): 9, ("b", -1.0): 1, ("b", float("inf")): 2}


@pytest.mark.parametrize("n", [1, 2, 7, 1000, 20_001])
def test_medians_by_selection(spark, n):
    rng = np.random.default_rng(n)
    plain, ties, far = rng.normal(size=n), rng.integers(0, 3, n).astype(float), np.exp(rng.normal(size=n) * 30)
    rows = [(float(a), float(b), float(c), None, None if i % 3 else float(a)) for i, (a, b, c) in enumerate(zip(plain, ties, far, strict=True))]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double").repartition(5)
    got = {r["feature"]: r["median"] for r in stats.exact_medians(df, list("abcde")).collect()}
    want = {"a": plain, "b": ties, "c": far, "e": plain[::3]}
    assert got["d"] is None
    assert all(got[f] == statistics.median(v.tolist()) for f, v in want.items())


def test_median_shuffles_few_rows(spark):
    df = spark.range(200_000).select(F.hash("id").cast("double").alias("x"), (F.hash("id") % 7).cast("double").alias("y"))
    near = [0.5 - stats.BRACKET, 0.5 + stats.BRACKET]
    low, high = df.agg(F.percentile_approx("x", near, stats.SKETCH)).first()[0]
    assert df.filter(F.col("x").between(low, high)).count() < 0.02 * 200_000


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 97, 4999, 10_000])
def test_permutation_is_a_bijection(spark, n):
    p = Permutation(n, "7:x")
    image = [p.of_number(i) for i in range(n)]
    assert sorted(image) == list(range(n)) and all(p.of_number(x, inverse=True) == i for i, x in enumerate(image))
    rows = spark.range(n).select("id", p.of(F.col("id")).alias("x"), p.of(p.of(F.col("id")), inverse=True).alias("back")).orderBy("id").collect()
    assert [r["x"] for r in rows] == image and all(r["back"] == r["id"] for r in rows)


def test_permutations_differ_by_key_and_move_rows():
    a, b = ([Permutation(1000, k).of_number(i) for i in range(1000)] for k in ("1", "2"))
    assert sum(x == y for x, y in zip(a, b, strict=True)) < 20
    assert sum(x == i for i, x in enumerate(a)) < 20
    assert abs(np.corrcoef(a, range(1000))[0, 1]) < 0.1
    for n in (10**6 + 3, 10**9 + 7, 10**12 + 39):  # large n: a small surplus to walk on
        x, y = Permutation(n, "").sides
        assert 0 <= x * y - n < 64
