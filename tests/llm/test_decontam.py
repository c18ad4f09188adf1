"""Decontamination against its declared rule, worked out for every pair of document and item."""

import random

from touchline.llm import decontam

RULE = decontam.Settings()


def holds(item, answer, words, width):
    """Whether some run of so many words holds the item by the declared rule."""
    for a in range(0, max(1, len(words) - width + 4), 4):
        near = words[a : a + width]
        share = decontam.common_subsequence(item, near) / len(item)
        if share >= RULE.sure or share >= RULE.likely and decontam.common_subsequence(answer, near) / len(answer) >= RULE.answer:
            return True
    return False


def changed(rng, words, kind, other):
    """A paraphrase: words replaced, dropped, added, swapped, or the body rewritten and the last sentence kept."""
    w = list(words)
    n = max(1, len(w) // 7)
    if kind == "replaced":
        for i in rng.sample(range(len(w)), n):
            w[i] = rng.choice(other)
    elif kind == "dropped":
        for i in sorted(rng.sample(range(len(w)), n), reverse=True):
            del w[i]
    elif kind == "added":
        for _ in range(n):
            w.insert(rng.randrange(len(w)), rng.choice(other))
    elif kind == "swapped":
        for i in rng.sample(range(len(w) - 1), n):
            w[i], w[i + 1] = w[i + 1], w[i]
    else:
        for i in rng.sample(range(len(w) - 6), (len(w) - 6) // 3):
            w[i] = rng.choice(other)
    return w


def test_declared_rule_and_paraphrase_recall(spark):
    rng = random.Random(31)
    usual = [f"usual{i}" for i in range(2000)]
    weights = [1 / (i + 2) for i in range(2000)]
    said = lambda n: rng.choices(usual, weights, k=n)
    items = []
    for i in range(60):
        body, end = said(rng.randint(12, 55)), said(6)
        items.append((i, " ".join(body) + ". " + " ".join(end) + "."))
    kinds = ("replaced", "dropped", "added", "swapped", "answer kept")
    texts, planted = [], []
    for k in range(300):
        i = k % 60
        words = changed(rng, decontam.plain(items[i][1]), kinds[k // 60], usual)
        texts.append(" ".join([*said(rng.randint(20, 120)), *words, *said(rng.randint(20, 120))]))
        planted.append((k, i))
    texts += [" ".join(said(150)) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    words = [decontam.plain(t) for t in texts]
    split = [(decontam.plain(t), decontam.answer_of(t)) for _, t in items]
    true = {(d, i) for d, i in planted if holds(*split[i], words[d], 2 * len(split[i][0]) + 16)}
    assert len(true) > 250
    by_kind = {k: [(p in got) for p in sorted(true) if kinds[p[0] // 60] == k] for k in kinds}
    recall = {k: sum(v) / max(len(v), 1) for k, v in by_kind.items()}
    assert sum(p in got for p in true) >= 0.95 * len(true) and min(recall.values()) >= 0.9, recall
    for d, i in got - true:  # what is found beside the plants obeys the rule in the longer region that was compared
        assert holds(*split[i], words[d], 6 * (len(split[i][0]) + 8)), (d, i)


def test_scripts_without_spaces(spark):
    item = "秋の空は高く澄みわたり山々は赤や黄色に染まって人々は静かに収穫の季節を迎える。答えは四十二です。"
    thai = "แมวสีดำนั่งอยู่บนหลังคาบ้านไม้เก่าและมองดูพระจันทร์เต็มดวงในคืนที่เงียบสงบ คำตอบคือสี่สิบสอง"
    filler = "明日は雨が降るかもしれないので傘を持って出かけましょう。"
    texts = [filler * 3 + item + filler * 2, filler * 5, "สวัสดีครับวันนี้อากาศดีมาก" + thai + "ขอบคุณครับ", "plain words only", item[:10] + filler]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, thai)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(docs, bench).collect()} == {(0, 1), (2, 2)}


def test_blocks_of_one_pass(spark):
    rng = random.Random(33)
    items = [(i, " ".join(f"v{rng.randrange(400)}" for _ in range(25))) for i in range(90)]
    texts = [f"start of it {t} end of it" for _, t in items] + ["nothing here to see"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {(i, i) for i in range(90)}
    for settings in (decontam.Settings(items=20), decontam.Settings(items=20, terms=300)):
        got = decontam.leaks(docs, bench, settings)
        assert {(r.doc_id, r.item_id) for r in got.collect()} == want
        assert {r.doc_id for r in decontam.reject_leaks(docs, bench, settings).collect()} == {90, 91, 92}
