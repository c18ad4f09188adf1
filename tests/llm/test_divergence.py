"""The source audit against its definition, term by term."""

import random
import re
from collections import Counter, defaultdict

from touchline.llm import divergence
from touchline.llm.divergence import Settings


def literal(rows, s):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(x or "", y or "", re.findall(divergence.TERM, (t or "").translate(low))) for x, y, t in rows]
    held, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, _, terms in docs:
        held[lang].update(set(terms))
    kept = {lang: sorted(t for t, n in c.items() if n >= s.documents) for lang, c in held.items()}
    for lang, source, terms in docs:
        counts[lang, source].update(t for t in terms if held[lang][t] >= s.documents)
    groups = {(lang, source) for lang, source, _ in docs}
    whole = defaultdict(Counter)
    for (lang, _), c in counts.items():
        whole[lang].update(c)

    def p(c, lang, t):
        return 1 + s.scale * (c[t] + s.prior) // (sum(c.values()) + s.prior * len(kept[lang]))

    out = []
    for lang, source in groups:
        mine = counts[lang, source]
        pair = [(-sum(abs(p(mine, lang, t) - p(counts[lang, o], lang, t)) for t in kept.get(lang, ())), o) for x, o in groups if x == lang and o != source]
        term = [(p(whole[lang], lang, t) - p(mine, lang, t), t) for t in kept.get(lang, ()) if mine[t] and p(mine, lang, t) > p(whole[lang], lang, t)]
        for part, found, most in (("pair", pair, None), ("term", term, s.top)):
            out += [(lang, source, part, item, -v, i + 1) for i, (v, item) in enumerate(sorted(found, key=lambda x: (x[0], x[1].encode()))[:most])]
    return sorted(out)


def rows():
    r = random.Random(4)
    words = ["Ab", "ab", "É", "é", "straße", "x1y", "don't", "漢字", "\x00q", "z\x7fz", "\U0001f600", *(f"w{c}" for c in "abcdefghij")]
    out = [("en", "a", None), (None, None, "Ab ab"), ("", "", ""), ("fr", "solo", "w"), ("fr", "two", ""), (None, "x", "ab " * 40)]
    for _ in range(300):
        source = r.choice(["a", "a", "a", "b", "c", "É", "\U0001f600"])
        out.append((r.choice(["en", "en", "de"]), source, r.choice([" ", "\n", "-", "0"]).join(r.choices(words, k=r.randrange(30)))))
    return out + [("en", "hot", "same words in all of these")] * 50 + [("en", "long", "wa wb " * 3000)]


def test_audit_equals_its_definition(spark):
    data = rows()
    df = spark.createDataFrame([(x, y, t, 1, "p") for x, y, t in data], "lang string, source string, text string, n long, part string")
    for s in (Settings(documents=30), Settings(documents=3, top=4, piece=7, portion=300)):
        got = divergence.audit(df, s)
        assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
        assert sorted(map(tuple, got.collect())) == literal(data, s)


def test_empty_and_without_kept_terms(spark):
    schema = "lang string, source string, text string"
    assert divergence.audit(spark.createDataFrame([], schema)).collect() == []
    got = divergence.audit(spark.createDataFrame([("en", "a", "x"), ("en", "b", None)], schema)).collect()
    assert sorted(map(tuple, got)) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_pieces_lose_no_term():
    text = "alpha beta" + "x" * 50 + " gamma  delta-é"
    for size in range(1, 40):
        got = [t for p in divergence.pieces(text, size) for t in re.findall(divergence.TERM, p)]
        assert got == re.findall(divergence.TERM, text)


def test_shares_of_large_counts_are_exact(spark):
    df = spark.createDataFrame([(9 * 10**15, 9 * 10**18 // 7, 12345), (0, 0, 0)], "n long, total long, v long")
    got = [r[0] for r in df.select(divergence.shares(Settings(), "n", "total", "v")).collect()]
    assert got == [1 + 10**9 * (9 * 10**15 + 5) // (9 * 10**18 // 7 + 5 * 12345), None]
