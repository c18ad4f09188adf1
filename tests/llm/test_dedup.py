"""Near-duplicates of texts and vectors against brute force over all pairs."""

import random

import numpy as np
import pytest

from touchline.llm import embed_dedup, minhash

random.seed(3)
WORDS = [f"w{i}" for i in range(300)]


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def grouped(ids, linked):
    label = {i: i for i in ids}
    while True:
        new = {i: min([label[i], *(label[j] for j in linked[i])]) for i in ids}
        if new == label:
            return label
        label = new


def texts():
    base = [random.choices(WORDS, k=n) for n in (60, 120, 40, 4, 3)]
    out = [None, "", "  \n\t ", "one", "One", "a b c", "A B C", "a b c d", "x " * 30000]
    for w in base:
        for _ in range(45):
            v = list(w)
            for _ in range(random.choice([0, 0, 1, 2, 3])):
                v[random.randrange(len(v))] = random.choice(WORDS)
            out.append(" ".join(v))
    return out + ["same text here for all of us"] * 60


@pytest.mark.parametrize(("k", "block"), [(4, 1024), (5, 16)])
def test_minhash(spark, k, block):
    docs = list(enumerate(texts()))
    random.shuffle(docs)
    df = spark.createDataFrame([(i, t, "x", 7) for i, t in docs], "doc_id long, text string, node string, shingles int")
    got = {r.doc_id: r for r in minhash.clusters(df, minhash.Settings(words=k, block=block)).collect()}
    sets = {i: shingles(t, k) for i, t in docs}
    linked = {
        i: [j for j in sets if j != i and a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j])] for i, a in sets.items()
    }
    label = grouped(sets, linked)
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert {i: r.component_id for i, r in got.items()} == label
    assert all(r.kept == (i == label[i]) for i, r in got.items())
    kept = minhash.deduplicate(df, minhash.Settings(words=k, block=block))
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i in label if label[i] == i}


def test_minhash_edges(spark):
    schema = "doc_id long, text string"
    empty = spark.createDataFrame([], schema)
    assert minhash.clusters(empty).count() == 0 and minhash.deduplicate(empty).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (1, "other words altogether in this one"), (2, None)], schema)
    rows = minhash.clusters(df).collect()
    assert len(rows) == 5 and sum(r.doc_id is None and r.component_id is None and r.kept for r in rows) == 1
    left = [(r.doc_id, r.text) for r in minhash.deduplicate(df).collect()]
    assert sorted(left, key=str) == sorted([(None, "a b c d e f"), (1, "a b c d e f"), (1, "other words altogether in this one"), (2, None)], key=str)


def vectors(n, dim=16):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((12, dim))
    near = np.concatenate([c + 0.06 * rng.standard_normal((m, dim)) for c, m in zip(centres, [1, 2, 3, 5, 40, 90, 1, 2, 3, 4, 5, 6], strict=True)])
    return np.concatenate([near, rng.standard_normal((n, dim)), near[:20]]).astype(np.float32)


@pytest.mark.parametrize("block", [512, 32])
def test_embeddings(spark, block):
    x = vectors(200)
    special = [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, []]
    rows = [(i, v.tolist(), "extra") for i, v in enumerate(x)] + [(1000 + i, v, "extra") for i, v in enumerate(special)] + [(None, x[0].tolist(), "e")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, node string")
    got = {r.vec_id: r for r in embed_dedup.clusters(df, embed_dedup.Settings(block=block, window=16)).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = u @ u.T >= 0.95
    linked = {i: [j for j in np.flatnonzero(s[i]).tolist() if j != i] for i in range(len(x))}
    label = grouped(range(len(x)), linked)
    assert {i: got[i].n_links for i in linked} == {i: len(v) for i, v in linked.items()}
    assert {i: got[i].component_id for i in linked} == label
    assert all(got[1000 + i].n_links == 0 and got[1000 + i].component_id == 1000 + i and got[1000 + i].kept for i in range(len(special)))
    assert got[None].component_id is None and got[None].kept and len(got) == len(rows)


def test_recall_with_a_hot_cone(spark):
    """A third of the vectors in one cone of mutual cosine 0.8, pairs just above the threshold inside and outside of it."""
    rng = np.random.default_rng(5)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    spread, axis = unit(rng.standard_normal((8000, 64))), unit(rng.standard_normal(64))
    noise = unit(rng.standard_normal((4000, 64)))
    cone = unit(0.894 * axis + 0.447 * unit(noise - (noise @ axis)[:, None] * axis))
    old = np.concatenate([spread[:300], cone[:300]])
    away = rng.standard_normal(old.shape)
    away = unit(away - (away * old).sum(1, keepdims=True) * old)
    c = 0.953
    x = np.concatenate([spread, cone, c * old + np.sqrt(1 - c * c) * away])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embed_dedup.clusters(df).collect()}
    u = unit(x)
    links = u @ u.T >= 0.95
    np.fill_diagonal(links, False)
    a, b = np.nonzero(np.triu(links, 1))
    found = [got[i].component_id == got[j].component_id for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    assert len(found) >= 590 and np.mean(found) >= 0.995
    assert all(got[i].n_links <= int(links[i].sum()) for i in got)


def test_embeddings_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embed_dedup.clusters(df).count() == 0
    only = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in embed_dedup.clusters(only).collect()] == [(1, 0, 1, True)]


def test_unrelated_long_texts_share_no_band():
    signer, r = minhash.Signer(minhash.Settings()), np.random.default_rng(8)
    sets = [r.integers(0, 1 << 63, 200_000).astype(np.uint64) for _ in range(24)]
    coordinates = [signer.coordinates(s) for s in sets]
    bands = np.array([signer.bands(c) for c in coordinates])
    assert all(not (bands[i] == bands[j]).any() for i in range(24) for j in range(i))
    assert max((coordinates[i] == coordinates[j]).mean() for i in range(24) for j in range(i)) < 0.02


def test_estimates_are_those_of_independent_coordinates():
    signer, r, off = minhash.Signer(minhash.Settings()), np.random.default_rng(9), []
    for n in (20, 300, 60_000):
        for _ in range(100 if n < 1000 else 8):
            x = r.integers(0, 1 << 63, n).astype(np.uint64)
            y = x.copy()
            y[: n // 9] = r.integers(0, 1 << 63, n // 9).astype(np.uint64)
            jaccard = (n - n // 9) / (n + n // 9)
            off.append(((signer.coordinates(x) == signer.coordinates(y)).mean() - jaccard) / (jaccard * (1 - jaccard) / 256) ** 0.5)
    assert abs(np.mean(off)) < 0.2 and 0.8 < np.std(off) < 1.2


def test_long_near_copies_and_a_template(spark):
    """Texts of 55,000 words, near copies among them, and pages of one template that share bands without being near, in small squares."""
    r = random.Random(12)
    long = [[f"q{r.randrange(10**9)}" for _ in range(55_000)] for _ in range(3)]
    long.append(long[0][:54_000] + [f"z{i}" for i in range(1000)])
    frame = [f"t{i}" for i in range(75)]
    pages = [frame + [f"p{i}x{j}" for j in range(25)] for i in range(160)]
    pages += [pages[5][:-1] + ["other"], pages[150][:-2] + ["an", "other"]]
    docs = list(enumerate(" ".join(w) for w in long + pages))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in minhash.clusters(df, minhash.Settings(block=16, shared=2)).collect()}
    sets = {i: shingles(t, 5) for i, t in docs}
    linked = {i: [j for j in sets if j != i and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])] for i in sets}
    assert got == grouped(sets, linked) and got[3] == 0 and got[164] == 9 and got[165] == 154


def test_embeddings_in_portions_write_no_row_for_each_pass(spark, monkeypatch):
    """Some passes, found sets and pairs of blocks at a time: no table grows with the number of passes or with a component's blocks."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((40, 32))
    near = np.concatenate([c + 0.08 * rng.standard_normal((m, 32)) for c, m in zip(centres, [100, 30, *[3] * 38], strict=True)])
    x = np.concatenate([near, rng.standard_normal((400, 32)), near[:9]]).astype(np.float32)
    written, shuffled = [], []
    whole = embed_dedup.settle
    monkeypatch.setattr(embed_dedup, "settle", lambda df, *a: [out := whole(df, *a), written.append((out.count(), out.columns))][0])
    settings = embed_dedup.Settings(window=128, block=64)
    for name, value in {"side": 8, "together": 3, "few": 32}.items():  # set one by one: what these bound is tested, not their names
        object.__setattr__(settings, name, value)
    passes = embed_dedup.Settings.passes
    monkeypatch.setattr(embed_dedup.Settings, "passes", lambda *a: [shuffled.append(passes(*a)), shuffled[-1]][1])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in embed_dedup.clusters(df, settings).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = u @ u.T >= 0.95
    linked = {i: [j for j in np.flatnonzero(s[i]).tolist() if j != i] for i in range(len(x))}
    assert sum(map(len, linked.values())) > 2000
    assert {i: r.n_links for i, r in got.items()} == {i: len(v) for i, v in linked.items()}
    assert {i: r.component_id for i, r in got.items()} == grouped(range(len(x)), linked)
    assert shuffled[0] > 6 and max(written)[0] <= 2 * len(x), (shuffled, max(written))


def test_what_is_discarded_is_gone_and_settings_return(spark):
    from touchline.llm import common

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    kept, gone = common.settle(spark.range(5)), common.settle(spark.range(7))
    with common.lean(spark):
        common.discard(gone)
    assert kept.count() == 5 and not spark.read.schema("id long").option("ignoreMissingFiles", "true").parquet(*kept.inputFiles()).isEmpty()
    with pytest.raises(Exception, match="exist|FILE_NOT|PATH_NOT"):
        spark.read.parquet(*gone.inputFiles()).count()
    assert spark.conf.get(key, None) == before
