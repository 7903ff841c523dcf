"""Hard negatives against brute force; test_tables compares the query with its SQL."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandcall.llm import anchor_lists


def plain(rows, is_anchor, most=5, few=3, low=50, high=95):
    """Of (id, label, vector) rows, straight from the definition."""
    last = lambda i: (i is None, i or 0)
    x = [(i, label, [math.floor(256 * c) for c in v]) for i, label, v in rows]
    dot = lambda a, b: sum(p * q for p, q in zip(a, b))
    out = []
    for i, label, v in sorted({(i, label, tuple(v)) for i, label, v in x if i is not None and is_anchor(i)}):
        scored = sorted(((dot(v, w), j, m) for j, m, w in x), key=lambda s: (-s[0], last(s[1])))
        for ps, p, _ in [s for s in scored if s[2] == label and s[1] != i][:most]:
            fitting = [s for s in scored if s[2] != label and low * ps <= 100 * s[0] <= high * ps][:few]
            out += [(i, p, k + 1, j, ps, ns) for k, (ns, j, _) in enumerate(fitting)]
    return sorted(out, key=repr)


def found(df, **how):
    rows = anchor_lists.hard_negatives(df, F.col("vec_id") % 10 == 0, **how)
    return sorted(map(tuple, rows.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=repr)


def table(spark, rows):
    return spark.createDataFrame([(i, label, [float(c) for c in v]) for i, label, v in rows], "vec_id long, label int, embedding array<double>")


def clumps(n, spread, seed=3):
    """Rows around five directions: lists end early if they are tight."""
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(5, 8))
    return [(k, int(rng.integers(3)), (middle[k % 5] + spread * rng.normal(size=8)) * rng.choice([0.3, 1, 2])) for k in range(n)]


@pytest.mark.parametrize("spread, clusters", [(0.1, 5), (1.0, 3), (0.05, 1)])
def test_every_range_is_filled_exactly(spark, monkeypatch, spread, clusters):
    for name, value in (("SHARD", 100), ("MEMBERS", 7), ("BLOCK", 16)):
        monkeypatch.setattr(anchor_lists, name, value)
    rows = clumps(400, spread)
    assert found(table(spark, rows), clusters=clusters) == plain(rows, lambda i: i % 10 == 0)


def test_ties_copies_and_zero_vectors(spark, monkeypatch):
    monkeypatch.setattr(anchor_lists, "SHARD", 10)
    same = [0.25, 0.5]
    rows = [(k, k % 2, same) for k in range(30)] + [(0, 0, same), (1, 1, same), (None, 0, same), (None, 1, [0.2, 0.4]), (40, 1, [0, 0]), (50, 0, [-1, -1])]
    assert found(table(spark, rows)) == plain(rows, lambda i: i % 10 == 0)


def test_lists_end_early():
    """With tight clusters a member meets few candidates of a long list, and loses none."""
    rows = clumps(3000, 0.05)
    x = np.array([[math.floor(256 * c) for c in v] for _, _, v in rows])
    labels, ids = np.array([r[1] for r in rows]), np.arange(3000)
    centre = x[0] / np.linalg.norm(x[0])
    members = np.flatnonzero((ids % 10 == 0) & (x @ centre > 0.99 * np.linalg.norm(x, axis=1)))
    clusters = anchor_lists.Clusters(centre[None])
    clusters.radius = clusters.angles(x[members]).max(axis=0)
    bounds = clusters.bounds(x)[:, 0]
    assert (x[members] @ x.T <= np.linalg.norm(x[members], axis=1)[:, None] * bounds).all()
    order = np.argsort(-bounds)
    walk, met = anchor_lists.Walk(ids[members], labels[members], x[members], None, 5, (0, 0)), 0
    for start in range(0, 3000, 50):
        walk.certify(bounds[order[start]])
        met += int(walk.open.sum()) * 50
        some = order[start : start + 50]
        walk.meet(ids[some], labels[some], x[some])
    assert met < 0.5 * len(members) * 3000
    for k, m in enumerate(members):
        fit = [j for j in range(3000) if labels[j] == labels[m] and j != m]
        assert walk.other[k].tolist() == sorted(fit, key=lambda j: (-int(x[m] @ x[j]), j))[:5]


def test_products_are_exact():
    big = np.array([[1 << 31, (1 << 31) - 1], [3, -5]])
    want = [[int(a) * int(c) + int(b) * int(d) for c, d in big.tolist()] for a, b in big.tolist()]
    with pytest.raises(ArithmeticError):
        anchor_lists.products(big << 10, big << 10)
    small = np.array([[1 << 27, 1], [-(1 << 27), 7]])
    assert anchor_lists.products(small, small).tolist() == [[(1 << 54) + 1, -(1 << 54) + 7], [-(1 << 54) + 7, (1 << 54) + 49]]
    assert want[1] == [3 * (1 << 31) - 5 * ((1 << 31) - 1), 34]
