"""Forms of layers with their exact spans, layers behind bombs, and the plain finds against a literal reading."""

import base64
import bz2
import gzip
import lzma
import random
import time
import zlib

from touchline.llm import secret_scan

SECRET = "api_key=Zx9y8w7v6u5t"


def b64(x):
    return base64.b64encode(x if isinstance(x, bytes) else x.encode()).decode()


def spans(text):
    return sorted({(a, b) for a, b, _ in secret_scan.scan(text).spans})


def test_escapes_of_every_kind():
    forms = [
        "".join(f"%u{ord(c):04X}" for c in SECRET), "".join(f"\\U{ord(c):08x}" for c in SECRET), "".join(f"&#{ord(c)};" for c in SECRET), "".join(f"&#x{ord(c):x};" for c in SECRET),
        "".join(f"\\u{{{ord(c):x}}}" for c in SECRET), SECRET.replace("=", "&equals;"), "password&quot;:&quot;hunter2222".replace("hunter2222", "&#104;unter2222"),
        "".join(f"&#{ord(c)};" if i % 2 else c for i, c in enumerate(SECRET)),
    ]
    for run in forms:
        text = f"see {run} there"
        assert spans(text) == [(4, 4 + len(run))], run
        assert secret_scan.redacted(text) == "see [SECRET] there"
        assert secret_scan.scan(f"see {b64(text)} there").spans


def test_base64_behind_prefixes():
    """Whatever characters of base64's own stand before a run, the span is that of its groups."""
    r = random.Random(5)
    for inner in (SECRET, f"some text {SECRET} and more", gzip.compress(f"x {SECRET}".encode(), mtime=0)):
        run = b64(inner).rstrip("=")
        for before in ("https://h.io/", "id-", "a/b/c/", "key_", "sha256-", "x", "xy", "xyz", *("".join(r.choices("abcXYZ019-_/", k=n)) for n in range(1, 9))):
            for after in ("", "-tail", "/more"):
                text = f"see {before}{run}{after} there"
                a = len(f"see {before}")
                got = [(i, j) for i, j in spans(text) if i >= a - 3 and j <= a + len(run) + 3]
                assert got and secret_scan.scan(secret_scan.redacted(text)).spans == set(), (before, after, spans(text))
                if not isinstance(inner, bytes) and inner == SECRET:
                    assert got[0][0] == a and got[0][1] >= a + len(run) - 3


def test_utf16_and_raw_deflate():
    raw = zlib.compressobj(9, zlib.DEFLATED, -15)
    deflated = raw.compress(f"text {SECRET} text".encode()) + raw.flush()
    for name in ("utf-16-le", "utf-16-be", "utf-16"):
        run = b64(f"é {SECRET} é".encode(name))
        (a, b), = spans(f"see {run} there")
        assert 4 <= a < b <= 4 + len(run)
        run = b64(gzip.compress(SECRET.encode(name), mtime=0))
        assert spans(f"see {run} there") == [(4, 4 + len(run))]
    run = b64(deflated)
    assert spans(f"see {run} there") == [(4, 4 + len(run))]


def test_a_secret_behind_bombs_and_closed_layers():
    zeros, small = b"\0" * (40 << 20), b64(gzip.compress(SECRET.encode(), mtime=0))
    for pack in (bz2.compress, gzip.compress, lzma.compress):
        bomb = b64(pack(zeros))
        text = f"{bomb} then {bomb[:-8]} {small} end"
        f = secret_scan.scan(text)
        a = text.index(small)
        assert (a, a + len(small)) in {s[:2] for s in f.spans} and f.unopened >= 1 and (0, len(bomb)) in f.closed
        left = secret_scan.redacted(text)
        assert small not in left and bomb not in left and left.startswith("[SECRET] then ") and left.endswith(" end")
    hidden = b64(gzip.compress(zeros + SECRET.encode()))  # beyond the bound: not seen, so not kept
    assert secret_scan.redacted(f"a {hidden} b") == "a [SECRET] b"
    many = " ".join(b64(gzip.compress(bytes([i]) * (9 << 20), mtime=i)) for i in range(3)) + f" {small}"
    assert secret_scan.scan(many).spans and secret_scan.redacted(many) == "[SECRET] [SECRET] [SECRET] [SECRET]"


def test_bombs_take_no_time():
    text = b64(gzip.compress(b"\0" * (40 << 20))) + " " + "word " * 200
    began = time.process_time()
    secret_scan.scan(text)
    assert time.process_time() - began < 1.0


def literal(text):
    """The plain finds, read character by character."""
    low = text  # letters in either case, ASCII only
    same = lambda at, word: len(low[at : at + len(word)]) == len(word) and all(c == w or c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" and c.lower() == w for c, w in zip(low[at : at + len(word)], word, strict=True))
    value = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")

    def assign(at):
        for word in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if not same(at, word):
                continue
            for quoted in (1, 0):  # greedy first
                i = at + len(word)
                if quoted:
                    if text[i : i + 1] not in ('"', "'"):
                        continue
                    i += 1
                while text[i : i + 1] == " ":
                    i += 1
                if text[i : i + 1] not in (":", "="):
                    continue
                i += 1
                while text[i : i + 1] == " ":
                    i += 1
                if text[i : i + 1] in ('"', "'"):
                    i += 1
                j = i
                while j < len(text) and text[j] in value:
                    j += 1
                if j > i:
                    return j, j - i >= 6
        return None

    def run(at, letters, head):
        if text[at : at + len(head)] != head:
            return None
        j = at + len(head)
        while j < len(text) and text[j] in letters:
            j += 1
        return j

    out = []
    at = 0
    while at < len(text):
        m = assign(at)
        if m:
            out += [(at, m[0], "assign")] * m[1]
            at = m[0]
        else:
            at += 1
    for kind, letters, head, least in (("access", set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), "AKIA", 20), ("hex", set("0123456789abcdef"), "", 24)):
        at = 0
        while at < len(text):
            j = run(at, letters, head)
            if j is not None and j > at + len(head):
                out += [(at, j, kind)] * (j - at >= least)
                at = j
            else:
                at += 1
    return secret_scan.order(out)


def test_plain_finds_equal_a_literal_reading():
    r = random.Random(21)
    parts = ["password", "PassWd", "secret", "TOKEN", "api_key", "apiKey", "paſſwd", '"', "'", " ", ":", "=", "==", "AKIA", "AKIA" * 2, "ABCDEFGHIJKLMNOP", "0123456789abcdef", "deadbeef", "abc", "x", "é", "\n", "-", ".", "K", "\t", "Z9"]
    for _ in range(10_000):
        text = "".join(r.choices(parts, k=r.randrange(1, 18)))
        assert secret_scan.base_spans(text) == literal(text), text
