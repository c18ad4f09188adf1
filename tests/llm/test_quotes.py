"""Quotation links, threads and positions against a plain reading of the definition, and against the SQL."""

import random
import re
from bisect import bisect_left

import duckdb
import pandas as pd

from touchline.llm import quotes


def normal(text):
    return re.sub(r"[\x01-\x20]+", " ", text).strip(" ").lower()


def runs(text):
    w = text.split(" ")
    return {" ".join(w[i : i + quotes.RUN]) for i in range(len(w) - quotes.RUN + 1)}


def parts(text):
    """(quoted passages as (level, text), own text)."""
    passages, own, last = [], [], 0
    for line in text.split("\n"):
        marks = re.match(r"[ \t]*(>[ \t]*)+", line)
        said = normal(line[marks.end() :]) if marks else ""
        level = marks[0].count(">") if said else 0
        if level and level == last:
            passages[-1] = (level, f"{passages[-1][1]} {said}")
        elif level:
            passages.append((level, said))
        last = level
        if not marks and not re.fullmatch(r"On .*wrote:[ \t\r]*", line):
            own.append(line)
    return passages, "\n".join(own)


def brute(rows):
    """conv_id -> turn -> (reply_to, thread, depth, position) of messages of distinct turns."""
    out, by = {}, {}
    for conv, turn, _, text in rows:
        by.setdefault(conv, []).append((turn, text or ""))
    for conv, messages in by.items():
        units, words, links = {}, {}, {}
        for turn, text in sorted(messages):
            passages, own = parts(text)
            found = {}
            for level, said in passages:
                if units.get(said):
                    origin = units[said][-1]
                else:
                    last = [words[r][-1] if r in words else None for r in runs(said)]
                    origin = min(last) if last and None not in last else None
                if origin is not None:
                    found[level] = max(found.get(level, origin), origin)
            if found:
                links[turn] = found[min(found)]
            whole = normal(own)
            pieces = [whole, *re.split(r"\n[ \t\r]*\n", own), *own.split("\n"), *re.sub(r"([.!?]) ", "\\1\x01", whole).split("\x01")]
            for u in {normal(p) for p in pieces} - {""}:
                units.setdefault(u, []).append(turn)
            for r in runs(whole):
                words.setdefault(r, []).append(turn)
        thread, depth = {}, {}
        for turn in sorted(links):
            up = links[turn]
            thread[turn], depth[turn] = thread.get(up, up), depth.get(up, 0) + 1
        members = {}
        for turn in sorted(links):
            members.setdefault(thread[turn], []).append(turn)
        out[conv] = {
            turn: (links.get(turn), thread.get(turn, turn), depth.get(turn, 0), bisect_left(members[thread[turn]], turn) + 1 if turn in thread else 0)
            for turn, _ in messages
        }
    return out


def talk(rng, conv, n, said):
    """n messages that quote earlier ones, whole or in part, wrapped anew, nested, or nothing that was said."""
    rows, texts = [], []
    for turn in range(n):
        lines = []
        if texts and rng.random() < 0.6:
            old = rng.choice(texts[-50:])
            w = old.split()
            kind = rng.random()
            if kind < 0.3 and len(w) > 6:
                a = rng.randrange(len(w) - 5)
                w = w[a : a + rng.randint(5, 12)]
            elif kind < 0.4:
                w = [rng.choice(said) for _ in range(rng.randint(1, 8))]
            elif kind < 0.6:
                w = rng.choice(re.split(r"(?<=[.!?]) |\n", old)).split() or w
            mark = rng.choice(["> ", ">", ">> ", "> > ", " >"])
            width = rng.randint(2, 9)
            lines += [mark + " ".join(w[i : i + width]) for i in range(0, len(w), width)]
            if rng.random() < 0.2:
                lines.append(">")
            if rng.random() < 0.2:
                lines += ["On Monday they wrote:", "> " + rng.choice(texts).split("\n")[0]]
        own = []
        for _ in range(rng.randint(0, 3)):
            own.append(" ".join(rng.choice(said) for _ in range(rng.randint(1, 9))) + rng.choice([".", "!", "", "?"]))
        text = rng.choice([" ", "\n", "\n\n"]).join(own) or rng.choice(["ok", "", "Thanks"])
        texts.append(text)
        rows.append((conv, turn, "user", "\n".join([*lines, text])))
    return rows


def columns(rows):
    return {(r.conv_id, r.turn): (r.reply_to, r.thread, r.depth, r.position) for r in rows}


def test_against_brute_force(spark):
    rng = random.Random(21)
    said = [f"Word{i}" for i in range(40)]
    rows = [r for conv in range(2000) for r in talk(rng, conv, rng.randint(1, 12), said)]
    rows += talk(rng, -1, 3000, [f"w{i}" for i in range(300)])
    hot = lambda k: f"> Root line here.\nreply {k}." if k % 3 else f"> reply {k - rng.randint(1, 2)}.\nreply {k}."
    rows += [(-2, k, "user", hot(k) if k else "Root line here.") for k in range(100_000)]
    rows += [(-3, k, "user", f"> step {k - 1} of many\nstep {k} of many") for k in range(700)]
    want = brute(rows)
    got = columns(quotes.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect())
    assert got == {(c, t): v for c, turns in want.items() for t, v in turns.items()}
    assert max(v[3] for v in got.values()) == 99_999 and max(v[2] for v in got.values()) == 699


def test_against_sql(spark):
    rng = random.Random(22)
    rows = [r for conv in range(150) for r in talk(rng, conv, rng.randint(1, 10), [f"Word{i}" for i in range(25)])]
    got = quotes.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]))
    cursor = con.execute(quotes.ORACLE)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(got[0].asDict())
    assert sorted((tuple(r[n] for n in names) for r in got), key=str) == sorted(cursor.fetchall(), key=str)


def test_latest_origin(spark):
    rows = [(1, 0, "u", "ok"), (1, 1, "a", "ok"), (1, 2, "u", "Fine."), (1, 3, "a", "> ok\nYes")]
    got = columns(quotes.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect())
    assert got[1, 3] == (1, 1, 1, 1) and got[1, 1] == (None, 1, 0, 0)


def test_very_long_message(spark):
    body = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, 0, "u", body), (1, 1, "a", "> " + body[200_000:300_000].replace(" ", "\n> ", 500) + "\nRight")]
    got = columns(quotes.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect())
    assert got[1, 1][0] is None or got[1, 1][0] == 0
    cut = " ".join(body.split()[500:9000])
    rows[1] = (1, 1, "a", f"> {cut}\nRight")
    assert columns(quotes.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect())[1, 1][0] == 0
