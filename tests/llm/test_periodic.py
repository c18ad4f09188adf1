"""Periodic runs against their definition, read word by word."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from touchline.llm import periodic


def literal(w, least=12):
    """Every stretch, every period, no shortcut: maximal stretches by their smallest period."""
    n, out = len(w), set()
    for p in range(1, n // 2 + 1):
        i = 0
        while i < n - p:
            j = i
            while j < n - p and w[j] == w[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, 2 * p):
                s = w[i : j + p]
                if not any(all(s[k] == s[k + q] for k in range(len(s) - q)) for q in range(1, p)):
                    out.add((i, j + p - i, p))
            i = max(j, i + 1)
    return sorted(out)


def sequences():
    r = random.Random(5)
    for _ in range(300):
        k, n = r.choice([1, 2, 3, 5, 40]), r.randrange(0, 140)
        x = [r.randrange(k) for _ in range(n)]
        for _ in range(r.randrange(4)):
            if n > 4:
                a, p = r.randrange(n), r.randrange(1, 1 + n // 3)
                for i in range(a, min(n, a + r.randrange(3 * p, 8 * p))):
                    x[i] = x[a + (i - a) % p]
        yield x
    yield [0, 1, 0, 1, 0, 1, 2] * 20  # runs inside runs
    yield [0] * 200
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 150:
        fib.append(fib[-1] + fib[-2])
    yield fib[-1]


@pytest.mark.parametrize("probes", [2, 8])
def test_runs_equal_their_definition(probes):
    for x in sequences():
        assert periodic.find(np.array(x, np.int64), periodic.Settings(probes=probes)) == literal(x), x


def test_lag_counts_by_both_ways():
    r = np.random.default_rng(2)
    for n, k in ((0, 1), (1, 1), (5, 2), (3000, 2), (3000, 40), (3000, 2000), (60_000, 900)):
        x = r.zipf(1.3, n) % k
        for pairs in (100, 1 << 20) if n < 10_000 else (1 << 20,):
            got = periodic.lag_counts(x, periodic.Settings(pairs=pairs))
            want = [0] + [int((x[:-p] == x[p:]).sum()) for p in range(1, n // 2 + 1)] if n < 10_000 else None
            if want is not None:
                assert got.tolist() == want
            else:
                for p in (1, 2, 77, 12_345, 30_000):
                    assert got[p] == (x[:-p] == x[p:]).sum()


def test_long_texts_take_seconds_not_squares():
    r = np.random.default_rng(3)
    same = np.zeros(400_000, np.int64)
    assert periodic.find(same) == [(0, 400_000, 1)]
    long = r.zipf(1.2, 400_000) % 50_000
    long[100_000:300_000] = np.tile(long[100_000:150_000], 4)
    assert (100_000, 50_000) in {(s, p) for s, n, p in periodic.find(long)}


def test_query_against_the_definition(spark):
    r = random.Random(9)
    words = [f"w{i}" for i in range(60)] + ["É", "a b", "\x1c", "\x00x"]
    texts = [None, "", " \t\n ", "one", "a " * 40, "a\x0bb\x0c" * 30]
    texts += [r.choice([" ", "\n", "  ", "\t"]).join(r.choice(words) for _ in range(r.randrange(1, 120))) for _ in range(150)]
    texts += [texts[20]] * 3
    ids = [*range(len(texts) - 1), 3]  # a repeated id
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, runs string, n_words int")
    want = []
    for i, t in zip(ids, texts, strict=True):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        h, n = zlib.crc32(str(i).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (k - a) % p] for k in range(a, n)]
        runs = literal(w)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None,) * 3
        kept = [x for k, x in enumerate(w) if not any(s + q <= k < s + m for s, m, q in runs)]
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        milli = 1000 * best[1] // best[2] if runs else None
        want.append((i, len(runs), *best, milli, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(kept))))
    got = periodic.digests(df)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert sum(x[1] for x in want) > 10


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert periodic.digests(empty).collect() == []
    nulls = spark.createDataFrame([(None, "a b " * 10), (None, None), (7, None)], "doc_id long, text string")
    rows = periodic.runs(nulls).collect()
    assert sorted((r.n_words, len(r.runs), r.collapsed) for r in rows) == [(0, 0, ""), (0, 0, ""), (20, 1, "a b")]
    assert periodic.digests(nulls).count() == 3
