"""Nearest neighbours and hard negatives against plain versions, over vectors that are null, zero, not finite or of other
lengths, over ties, repeated rows and ids, no rows, and columns whose names clash."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from knigovod.llm import fourrussians, permutation, vectors

ROWS = "vec_id bigint, embedding array<float>, label int, v string, q int, r int, c int, asks string, id string, planes int"


def made(n, seed, width=16):
    """Vectors in loose groups, a third of them near one vector, some equal; then rows that take no part."""
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, width))
    points = centres[r.integers(0, 12, n)] + r.normal(size=(n, width))
    points[::3] = centres[0] + 0.01 * r.normal(size=(len(points[::3]), width))
    points[5:45:4] = points[5]
    points = np.float32(points)
    rows = [(k * 5, x.tolist(), int(r.integers(0, 4))) for k, x in enumerate(points)]
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0] * width, [1.0] * (width - 1), [nan] + [1.0] * (width - 1), [inf] + [1.0] * (width - 1), [None] + [1.0] * (width - 1)]
    rows += [(10 * n + 20 * k, x, 1) for k, x in enumerate(odd)]
    rows += [(None, rows[3][1], 2), rows[7], rows[7], rows[20], (rows[40][0], rows[41][1], 3), (rows[60][0], rows[60][1], None)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*x, "a", 1, 2, 3, "b", "c", 4) for x in rows], ROWS)


def taking_part(rows, width=16, zero=False, labels=False):
    return [(i, x, y) for i, x, y in rows if i is not None and x is not None and len(x) == width and all(v is not None and np.isfinite(v) for v in x)
            and (zero or any(x)) and not (labels and y is None)]


def plain_nearest(rows, k):
    """The distances of the k nearest for each query (id, vector), and all pairs of id and distance that reach them."""
    rows = taking_part(rows)
    points = np.array([x for _, x, _ in rows])
    ids = np.array([i for i, _, _ in rows])
    out = []
    for i, x in {(i, tuple(x)) for i, x, _ in rows if i % 20 == 0}:
        apart = np.sqrt(((points - np.array(x)) ** 2).sum(1))
        found = sorted((float(d), int(j)) for d, j in zip(apart, ids) if j != i)[:k]
        out += [(i, n, j, d) for n, (d, j) in enumerate(found, 1)]
    return out


def test_small_groups_are_reranked_whole(spark):
    rows = made(60, 1)
    got = permutation.nearest(frame(spark, rows), F.col("vec_id") % 20 == 0).collect()
    wanted = plain_nearest(rows, 10)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(wanted)
    assert permutation.nearest(frame(spark, []), F.col("vec_id") % 20 == 0).count() == 0
    assert permutation.nearest(frame(spark, rows[:1]), F.lit(True)).count() == 0
    few = permutation.nearest(frame(spark, rows[:4]), F.col("vec_id") == 0).collect()
    assert [r["rank"] for r in sorted(few, key=lambda r: r["rank"])] == [1, 2, 3]
    assert permutation.nearest(frame(spark, rows), F.lit(None).cast("boolean")).count() == 0


@pytest.mark.parametrize("n_rows, n_queries", [(4096, 4096), (150, 7)])
def test_recall(spark, monkeypatch, n_rows, n_queries):
    """In one tile and in many; a third of the rows are near copies of one vector."""
    monkeypatch.setattr(vectors, "LEAST_ROWS", n_rows)
    monkeypatch.setattr(vectors, "GROUP_QUERIES", n_queries)
    rows = made(1500, 2)
    got = permutation.nearest(frame(spark, rows).repartition(5), F.col("vec_id") % 20 == 0).collect()
    wanted = plain_nearest(rows, 10)
    assert len(got) == len(wanted)
    assert len({(r.query_id, r.vec_id) for r in got} & {(i, j) for i, _, j, _ in wanted}) >= 0.95 * len({(i, j) for i, _, j, _ in wanted})
    points = {}
    for i, x, _ in taking_part(rows):
        points.setdefault(i, []).append(np.array(x))
    for r in got:
        assert any(r.score == np.sqrt(((a - b) ** 2).sum()) for a in points[r.query_id] for b in points[r.vec_id])


def test_agreement_is_footrule():
    """What the inverted files add up to orders rows as the footrule distance of the prefixes does."""
    r = np.random.default_rng(3)
    points, pivots, depth = r.normal(size=(50, 8)), r.normal(size=(20, 8)), 6
    near = permutation.places(points, pivots, depth)
    at = np.full((50, 20), depth)
    np.put_along_axis(at, near, np.arange(depth)[None].repeat(50, 0), 1)
    footrule = np.abs(at - at[0]).sum(1)
    agreed = [sum(2 * (depth - max(at[0, p], at[k, p])) for p in range(20) if at[0, p] < depth and at[k, p] < depth) for k in range(50)]
    assert (footrule + np.array(agreed) == depth * (depth + 1)).all()


@pytest.mark.parametrize("width, low, high", [(1, -3, 3), (8, 0, 1), (13, -200, 200), (64, -(1 << 31), 1 << 31), (3, 0, 1)])
def test_scores_are_inner_products(width, low, high):
    r = np.random.default_rng(width)
    rows, anchors = (r.integers(low, high, (n, width)) for n in (2100, 40))
    got = fourrussians.scores(fourrussians.bit_planes(rows), anchors)
    assert (got == anchors @ rows.T).all()
    assert (fourrussians.scores(fourrussians.bit_planes(rows * 0 - 1), anchors) == anchors @ (rows * 0 - 1).T).all()


def plain_negatives(rows):
    rows = [(i, [int(np.floor(256 * np.float64(v))) for v in x], y) for i, x, y in taking_part(rows, zero=True, labels=True)]
    out = []
    for i, x, y in {(i, tuple(x), y) for i, x, y in rows if i % 20 == 0}:
        scored = [(-sum(a * b for a, b in zip(x, z)), j, w) for j, z, w in rows]
        positives = sorted((s, j) for s, j, w in scored if w == y and j != i)[:5]
        for s, j in positives:
            inside = sorted((t, k) for t, k, w in scored if w != y and Fraction(30 * -s, 100) <= -t <= Fraction(90 * -s, 100))[:10]
            out += [(i, j, n, k, -s, -t) for n, (t, k) in enumerate(inside, 1)]
    return out


@pytest.mark.parametrize("n_rows, n_queries", [(4096, 4096), (40, 7)])
def test_hard_negatives(spark, monkeypatch, n_rows, n_queries):
    monkeypatch.setattr(vectors, "LEAST_ROWS", n_rows)
    monkeypatch.setattr(vectors, "GROUP_QUERIES", n_queries)
    rows = made(300, 4)
    got = fourrussians.hard_negatives(frame(spark, rows).repartition(5), F.col("vec_id") % 20 == 0).collect()
    columns = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    assert sorted(tuple(r[c] for c in columns) for r in got) == sorted(plain_negatives(rows))
    assert len(got) > 1000


def test_hard_negatives_of_few_rows(spark):
    rows = made(70, 5)[:20]
    for some in ([], rows[:1], rows[:2], [r for r in rows if r[2] == 1]):
        got = fourrussians.hard_negatives(frame(spark, some), F.col("vec_id") % 20 == 0).count()
        assert got == len(plain_negatives(some))
    large = [(k * 10, [3e38] * 4, k % 2) for k in range(6)]
    got = fourrussians.hard_negatives(frame(spark, large), F.lit(True)).collect()
    assert got == []  # all scores are equal: none is below 90 percent of another
