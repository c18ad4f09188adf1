"""Exact search against all pairs, with integers of any size."""

import math
import random

import numpy as np
import pytest

from touchline.llm import pivot_search
from touchline.llm.pivot_search import Settings

SCHEMA = "vec_id long, embedding array<double>, label int, score string, v int"


def literal(rows, k=5, every=50):
    fine = [(r, i, [math.floor(256 * x) for x in e]) for r, (i, e) in enumerate(rows) if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for r, q, x in fine:
        if q % every == 0:
            s = sorted((-sum(a * b for a, b in zip(x, y, strict=False)), i) for o, i, y in fine if o != r)[:k]
            out += [(q, n + 1, i, -v) for n, (v, i) in enumerate(s)]
    return sorted(out)


def clustered(n, d, seed, noise=0.1):
    r = np.random.default_rng(seed)
    c = r.standard_normal((12, d))
    x = c[r.integers(0, 12, n)] + noise * r.standard_normal((n, d))
    return [(i, [float(v) for v in row]) for i, row in enumerate(x * r.uniform(0.1, 2, (n, 1)))]


def of(spark, rows, **settings):
    df = spark.createDataFrame([(i, e, 1, "x", 2) for i, e in rows], SCHEMA)
    got = pivot_search.top_k(df, Settings(**settings))
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("settings", [{}, {"block": 16, "sample": 64, "lane": 3}, {"block": 8, "sample": 4000, "home": 1}])
def test_equals_all_pairs(spark, settings):
    rows = clustered(1500, 8, 1)
    rows += [(2000 + i, rows[7][1]) for i in range(300)]  # copies
    rows += [(10_000 + i, [0.0] * 8) for i in range(60)]  # zero queries and candidates
    rows += [(100, [0.5] * 8), (100, [0.5] * 8), (150, rows[3][1])]  # repeated ids
    random.Random(1).shuffle(rows)
    assert of(spark, rows, **settings) == literal(rows)


def test_odd_rows(spark):
    rows = [(0, [1.0, float("nan")]), (50, None), (None, [1.0, 2.0]), (100, [1.0, None]), (150, [float("inf")]), (-50, [1.0, 0.5, 0.25]), (200, []), (250, [-0.001]), (3, [2.0]), (4, [0.0, 1.0])]
    want = literal(rows)
    assert len(want) == 12 and of(spark, rows) == want
    assert of(spark, []) == []
    assert of(spark, [(0, [1.0])]) == []
    assert of(spark, [(0, []), (1, [])]) == [(0, 1, 1, 0)]


def test_numbers_beyond_floats(spark):
    rows = [(i, [float((-1) ** i * (3 + i) * 1e5), 1.0 / (i + 1)]) for i in range(120)]
    assert of(spark, rows, block=8) == literal(rows)
    q, x = np.array([[2.0**52, 3.0]]), np.array([[2.0**52, 1.0], [-(2.0**52), 1.0], [1.0, 1.0]])
    assert pivot_search.scores(q, x).tolist() == [[pivot_search.MOST, pivot_search.LEAST, 2**52 + 3]]


def test_most_blocks_are_not_read_in_clusters(spark, monkeypatch):
    seen, meet = [], pivot_search._meet

    def counted(wanted, *rest):
        seen.append(wanted.count())
        return meet(wanted, *rest)

    monkeypatch.setattr(pivot_search, "_meet", counted)
    x = np.array([e for _, e in clustered(4000, 16, 2, 0.05)])
    rows = [(i, [float(c) for c in e]) for i, e in enumerate(x / np.linalg.norm(x, axis=1, keepdims=True))]
    assert of(spark, rows, block=32) == literal(rows)
    blocks = 4000 / 32 * 80
    assert sum(seen) < 0.5 * blocks
