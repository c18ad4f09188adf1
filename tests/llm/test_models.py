"""Classifiers by held-out accuracy, decontamination and quotations on fixtures, the pipeline end to end."""

import random

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from touchline.llm import decontam, minhash, quality, quotes, toxicity
from touchline.llm.queries import ORACLES, QUERIES

SF, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"


def table(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet")


@pytest.mark.parametrize(("op", "label", "least"), [(quality.quality, "quality", 0.95), (toxicity.toxicity, "toxic", 0.85)])
def test_held_out(spark, op, label, least):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    got = op(docs, labels)
    rows = got.toPandas()
    assert len(rows) == docs.count() and rows.score.between(0, 1).all()
    held = rows[rows.held_out].merge(labels.toPandas(), on="doc_id")
    assert len(held) > 40 and (held.predicted == held[label]).mean() >= least


@pytest.mark.parametrize("op", [quality.quality, toxicity.toxicity])
def test_classifier_edges(spark, op):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.1), (2, "", 0.1), (None, "Some text.", 0.2), (3, "bad " * 50_000, 0.3)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = op(docs, none).collect()
    assert len(rows) == 5 and all(r.score == pytest.approx(0.5) for r in rows)
    lone = spark.createDataFrame([(2, 1, 1), (2, 0, 0), (9, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert all(0 <= r.score <= 1 for r in op(docs, lone).collect())
    assert op(docs.limit(0), none).count() == 0


def test_offending_sentence():
    m = toxicity.Model(toxicity.np.zeros(1 << 18, "float32"), -6.0)
    settings = toxicity.Settings()
    m.weights[toxicity.features("idiot", settings)[0]] = 12.0
    text = "All is well here.\nYou are an IDIOT, sir! Good day."
    (score, n, bad, a, b), = toxicity.scores(m, settings)([text])
    assert score > 0.9 and n == 4 and bad == 1 and text[a:b] == "You are an IDIOT, sir!"


BENCH = "The quick brown fox jumps over the lazy dog while seven wise owls watch silently. The answer is forty two."


def test_leaks(spark):
    filler = [f"word{i} thing{i * 7 % 50} stuff{i * 3 % 40}" for i in range(200)]
    noise = lambda k: " ".join(filler[k * 5 % 150 : k * 5 % 150 + 40])
    near = BENCH.replace("quick", "fast").replace("lazy", "idle").replace("silently", "calmly").replace("wise", "old")
    texts = [noise(1) + " " + BENCH + " " + noise(2), BENCH.upper(), noise(3) + " " + near, noise(4), None, "", " ".join(BENCH.split()[:5]), noise(5) * 300 + " " + BENCH]
    texts += [noise(k) for k in range(6, 60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as item_id")
    bench = spark.createDataFrame([(7, BENCH), (7, BENCH), (8, None), (9, "..."), (None, "x y z"), (10, "Entirely different item about rivers, mountains and the sea.")], "item_id long, text string")
    got = decontam.leaks(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(0, 7), (1, 7), (2, 7), (7, 7)}
    left = decontam.reject_leaks(docs, bench)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == set(range(len(texts))) - {0, 1, 2, 7}
    assert decontam.leaks(docs.limit(0), bench).count() == 0 and decontam.leaks(docs, bench.limit(0)).count() == 0
    blocks = decontam.leaks(docs, bench, decontam.Settings(items=2))
    assert {(r.doc_id, r.item_id) for r in blocks.collect()} == {(0, 7), (1, 7), (2, 7), (7, 7)}


def test_leaks_of_any_length(spark):
    rng = random.Random(8)
    usual = [f"usual{i}" for i in range(300)]
    rare = lambda n: " ".join(f"r{rng.getrandbits(40):x}" for _ in range(n))
    said = lambda n: " ".join(rng.choices(usual, k=n))
    items = [(i, f"{said(n)}.") for i, n in enumerate([8, 12, 20, 50, 100, 160, 200, 300, 500, 1000] * 3)]
    texts = [f"{rare(150)} {x} {rare(150)}" for _, x in items] + [f"{said(100)} {x} {said(100)}" for _, x in items] + [x for _, x in items]
    true = {(k, k % len(items)) for k in range(len(texts))}
    texts += [said(200) for _ in range(60)] + [rare(200) for _ in range(10)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(docs, bench).collect()}
    assert true <= got
    assert {d for d, _ in got} == {d for d, _ in true}


def test_leaks_of_all_planted(spark):
    docs, bench = table(spark, "documents").toPandas(), table(spark, "benchmark").toPandas()
    true = {(d.doc_id, b.item_id) for b in bench.itertuples() for d in docs.itertuples() if b.text in d.text}
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(table(spark, "documents"), table(spark, "benchmark")).collect()}
    assert true and true <= got and len(got - true) <= 2


TALK = [
    (1, 0, "user", "How do I boil an egg?\nI have no pot."),
    (1, 1, "assistant", "Use a kettle."),
    (1, 2, "user", "On Monday someone wrote:\n> how do I  BOIL an egg?\n\nSame question."),
    (1, 3, "assistant", "> Same question.\n>> How do I boil an egg?\nSee above."),
    (1, 4, "user", "> never said\nWhat?"),
    (1, 5, None, None),
    (2, 0, "user", "> How do I boil an egg?\nFrom another conversation."),
    (None, 0, "user", "> Use a kettle."),
    (1, 5, "user", "> See above.\nThanks"),
]


def test_quotes(spark):
    df = spark.createDataFrame([(*r, 1) for r in TALK], "conv_id long, turn long, role string, text string, thread int")
    got = {(r.conv_id, r.turn, r.role): r for r in quotes.conversations(df).collect()}
    assert len(got) == len(TALK)
    assert (got[1, 2, "user"].reply_to, got[1, 2, "user"].thread, got[1, 2, "user"].chat) == (0, 0, "<|user|>\nSame question.")
    assert (got[1, 3, "assistant"].reply_to, got[1, 3, "assistant"].thread, got[1, 3, "assistant"].depth) == (2, 0, 2)
    assert (got[1, 4, "user"].reply_to, got[1, 4, "user"].thread) == (None, 4) and got[2, 0, "user"].reply_to is None
    assert (got[1, 5, "user"].reply_to, got[1, 5, "user"].depth, got[1, 5, "unknown"].reply_to) == (3, 3, 3)
    conversations = pd.DataFrame(TALK, columns=["conv_id", "turn", "role", "text"])
    con = duckdb.connect()
    con.register("c", conversations)
    con.execute("CREATE VIEW conversations AS SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, role, text FROM c")
    cursor = con.execute(quotes.ORACLE)
    names = [d[0] for d in cursor.description]
    want = sorted((dict(zip(names, r, strict=True)) for r in cursor.fetchall()), key=str)
    have = sorted(({n: r[n] for n in names} for r in got.values()), key=str)
    assert have == want
    assert quotes.conversations(df.limit(0)).count() == 0


def test_quoted_passages(spark):
    long = "The parcel left the depot on Friday morning and should reach you by the end of next week."
    rows = [
        (1, 0, "user", "Thanks\nWhere is it?"),
        (1, 1, "assistant", f"{long} Sorry.\n\nSee\nyou soon\n\nThanks"),
        (1, 2, "user", "> The parcel left\n> the depot on Friday morning and should reach you by\n> the end of next week.\nGood."),
        (1, 3, "user", "> should reach you by the end\nWhich end?"),
        (1, 4, "user", "> See you\n> soon\nBye"),
        (1, 5, "user", "> Sorry.\nNo need"),
        (1, 6, "user", "> The parcel left the harbour on Friday morning\nNo"),
        (1, 7, "user", "> Good.\n>> reach you by the\n>> end of next week. Sorry.\nIndeed"),
        (2, 0, "user", "> should reach you by the end\nOf another conversation"),
        (2, 1, "user", None),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): r.reply_to for r in quotes.conversations(df).collect()}
    assert got == {(1, 0): None, (1, 1): None, (1, 2): 1, (1, 3): 1, (1, 4): 1, (1, 5): 1, (1, 6): None, (1, 7): 2, (2, 0): None, (2, 1): None}


def test_names_and_oracles():
    assert [f.__name__.split("_")[0] for f in QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert set(ORACLES) <= {f.__name__ for f in QUERIES}


def test_pipeline(spark):
    docs = table(spark, "documents", SMALL)
    out = corpus_pipeline.run(spark, SMALL)
    assert 100 < out.count() <= docs.count()
    rejected = {r.doc_id for r in toxicity.toxicity(docs, table(spark, "labels", SMALL)).where("predicted = 1").collect()}
    left = docs.where(~docs.doc_id.isin(list(rejected))) if rejected else docs
    one = {r.doc_id for r in minhash.clusters(left).where("kept").collect()}
    leaked = {r.doc_id for r in decontam.leaks(left.where(left.doc_id.isin(list(one))), table(spark, "benchmark", SMALL)).collect()}
    assert {r.doc_id for r in out.select("doc_id").collect()} == one - leaked
    step = docs.withColumn("score", docs.n_chars).withColumn("node", docs.source)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, step, SMALL)
        assert after.columns == step.columns
        step = after
    assert {r.doc_id for r in step.select("doc_id").collect()} == one - leaked
