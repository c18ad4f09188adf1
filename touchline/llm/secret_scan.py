"""Secret scans with a recursive decoding worklist.

A text is scanned for three kinds of secrets. Runs that look URL-, Unicode- or base64-encoded are unwrapped. Unicode escapes are those of
programs (\\u0061, \\U00000061, \\x61), of URLs (%u0061) and of pages (&#97; &#x61; and a few names). Base64 is read over lines of one
width, and from each of the four places that a group may begin at, so that it is found behind a path or a prefix whose characters
are base64's own. Bytes that runs hold are layers too: compressed members anywhere in them are inflated, again and again, all
members of a row as one content, and bytes that are one raw deflate stream; the rest is read as UTF-8, or else as Latin-1, and as
UTF-16 where zeros tell so. Of a member that is cut off, what comes out is read. Every layer is scanned and searched for further layers until nothing new appears; equal contents in one text
are opened once. Finds in a layer are mapped back to every run that holds it, and so on up to the original text, until no span is
new, so repeated layers count at each of their places and cycles end; where one place leads to the same content in two ways, the
narrower span stands. The mapping is exact for percent and Unicode escapes, to the enclosing groups of four for base64, to the
whole member for compressed data. `layers` counts the distinct texts that are readable or hold a find.

A layer made to fill the memory cannot end the job: a member is unpacked to at most `MOST` bytes, and once a text's members have
taken MOST and `RATE` bytes for each character, to `SMALL` each. What comes before the bound is scanned, other members stay open to the
scan, `unopened` counts the members that held more, and `redact` takes the runs that hold them out as if they were secrets. A layer of one
repeated character is scanned but not unwrapped: it encodes nothing.

Kinds, in the order that breaks ties: assign (a named value, the span covers name and value), access (AKIA...), hex.

Defined results: null text counts as empty; empty text has no spans and the hash of the empty string; rows repeat as they come, an
empty table gives none; texts of any length are scanned whole; other columns are not read, in `redact` they stay as they are,
whatever their names, but for n_chars.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import codecs
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import by_text

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_PERCENT = re.compile(r"(?<![A-Za-z0-9._~+/:=&?-])(?:[A-Za-z0-9._~+/:=&?-]*%[0-9A-Fa-f]{2})+[A-Za-z0-9._~+/:=&?-]*")
_UNICODE = re.compile(r"[!-~]+")
_ESCAPE = re.compile(
    r"\\u\{([0-9A-Fa-f]{1,6})\}|(?:\\u|%u)([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|\\U([0-9A-Fa-f]{8})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});|&(quot|apos|amp|colon|equals);"
)
_NAMED = {"quot": '"', "apos": "'", "amp": "&", "colon": ":", "equals": "="}
_ESCAPE_SIGNS = ("\\u", "\\x", "\\U", "%u", "&#", "&quot;", "&apos;", "&amp;", "&colon;", "&equals;")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}")
_LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
_LINES = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:[\x20\t]*\r?\n[\x20\t>]*[A-Za-z0-9+/_-]++)+={0,2}")
_PERCENT_BYTES = re.compile(r"(?:[!#$&-;=?-~]|%[0-9A-Fa-f]{2})++")
_PERCENT_BYTE = re.compile(r"%[0-9A-Fa-f]{2}|.", re.DOTALL)
_LITERAL = re.compile(r"(?:[\x20-\[\]-~]|\\(?:x[0-9A-Fa-f]{2}|u00[0-9A-Fa-f]{2}|[0-7]{1,3}|[\\/'\"abfnrtv]))++")
_LITERAL_BYTE = re.compile(r"\\x(..)|\\u00(..)|\\([0-7]{1,3})|\\(.)|.", re.DOTALL)
_CONTROL = {"a": 7, "b": 8, "f": 12, "n": 10, "r": 13, "t": 9, "v": 11}
_MAGIC = re.compile(
    rb"\x1f\x8b\x08|x[\x01\x5e\x9c\xda]|BZh[1-9](?:1AY&SY|\x17rE8P\x90)|\xfd7zXZ\x00|\x28\xb5\x2f\xfd|\x5d\x00\x00..(?:\xff{8}|.{5}\x00{3})", re.DOTALL
)
#: Bytes that a compressed member is unpacked to at most; bytes for each character of a text that its members may take beyond, all
#: together; bytes that a member is unpacked to in any case.
MOST, RATE, SMALL = 8 << 20, 32, 64 << 10
#: What bytes need to hold for a secret or a further layer to be in them.
_TELLING = re.compile(rb"[\x20-\x7e]{12}|(?:[\x20-\x7e]\x00){12}|(?:\x00[\x20-\x7e]){12}|" + _MAGIC.pattern, re.DOTALL)
_LONG = re.compile(r"[A-Za-z0-9+/_-]{16}")


@dataclass
class Layer:
    """A text or bytes and the way back: `back` maps a span of it to a span of the content that it was found in."""

    content: str | bytes
    back: Callable[[int, int], tuple[int, int]]
    cut: bool = False  #: a compressed member that held more


@dataclass
class Found:
    base: list[tuple[int, int, str]] = field(default_factory=list)
    spans: set[tuple[int, int, str]] = field(default_factory=set)
    layers: int = 0
    depth: int = 0
    unopened: int = 0
    closed: list[tuple[int, int]] = field(default_factory=list)  #: spans that hold members which were not unpacked to their end


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the plain finds, by start, then kind."""
    out = []
    if ":" in text or "=" in text:
        out += [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in _ACCESS.finditer(text)]
    out += [(*m.span(), "hex") for m in _HEX.finditer(text)]
    return order(out)


def order(spans) -> list[tuple[int, int, str]]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _readable(text: str) -> bool:
    strange = sum(text.count(c) for c in set(text) if not (c.isprintable() or c in "\n\r\t"))
    return strange * 20 <= len(text)


class Room:
    """Bytes that the compressed members of one text may still take, and how many of them held more or asked for too much memory."""

    def __init__(self, size: int):
        self.left, self.unopened = MOST + RATE * size, 0

    def allowed(self) -> int:
        return min(MOST, max(self.left, SMALL))


def _decompressor(head: bytes):
    if head[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if head[:2] == b"\xfd7" or head[:1] == b"\x5d":
        return lzma.LZMADecompressor(memlimit=96 << 20)
    if head == b"\x28\xb5\x2f\xfd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj()
    return zlib.decompressobj()


def _member(raw: bytes, at: int, room: Room) -> tuple[bytes, int, bool, bool]:
    """What the compressed member at a place unpacks to, where it ends, whether it is whole, and whether it was cut for holding too much."""
    d, out, fed, pos = _decompressor(raw[at : at + 4]), [], memoryview(raw)[at:], at
    keeps = isinstance(d, bz2.BZ2Decompressor | lzma.LZMADecompressor)  # the input that it has not used yet
    bounded = raw[at : at + 4] != b"\x28\xb5\x2f\xfd"
    allowed, got, cut = room.allowed(), 0, False
    try:
        while True:
            if bounded:
                piece = d.decompress(fed, max(1, min(1 << 20, allowed - got)))
                fed = b"" if keeps else d.unconsumed_tail
                over = d.needs_input if keeps else not fed and not piece
            else:  # a few bytes at a time bound what comes out
                piece, over = d.decompress(raw[pos : pos + 64]), pos >= len(raw)
                pos += len(raw[pos : pos + 64])
            out.append(piece)
            got += len(piece)
            if d.eof:
                room.left -= got
                return b"".join(out), (len(raw) if bounded else pos) - len(d.unused_data), True, False
            if got >= allowed:
                cut = True
                break
            if over:
                break
    except (zlib.error, OSError, EOFError, ValueError):
        pass
    except lzma.LZMAError as e:
        cut = "limit" in str(e)
    except Exception as e:  # zstandard has an error class of its own
        if type(e).__name__ != "ZstdError":
            raise
    room.left -= got
    room.unopened += cut
    return b"".join(out), len(raw), False, cut


def _members(raw: bytes, room: Room) -> Iterator[tuple[int, int, bytes, bool, bool]]:
    """(start, end, unpacked, whole, cut) of the compressed data in bytes; members that follow each other are one content."""
    at = 0
    while at < len(raw):
        if at == 0 and len(raw) > 2 and raw[0] & 15 == 8 and raw[0] < 128 and int.from_bytes(raw[:2], "big") % 31 == 0:
            start = 0
        elif m := _MAGIC.search(raw, at):
            start = m.start()
        else:
            return
        unpacked, end, whole, cut = _member(raw, start, room)
        if whole:
            parts, head = [unpacked], raw[start : start + 2]
            while raw[end : end + 2] == head and (more := _member(raw, end, room))[0]:
                parts.append(more[0])
                end, whole, cut = more[1:]
                if not whole:
                    break
            yield start, end, b"".join(parts), whole, cut
        elif cut or unpacked and (start == 0 or raw[start] not in b"x\x5d"):  # a few bytes in the middle do not make a header
            yield start, end, unpacked, False, cut
        at = end if whole else start + 1


def _deflated(raw: bytes, room: Room) -> tuple[bytes, bool] | None:
    """What bytes hold if they are one raw deflate stream, which has no header to be known by, and whether it held more."""
    d, allowed = zlib.decompressobj(-15), room.allowed()
    try:
        out = d.decompress(raw, allowed)
    except zlib.error:
        return None
    cut = not d.eof and len(out) >= allowed
    if not (d.eof or cut) or len(out) < 12 or not _TELLING.search(out):
        return None
    room.left -= len(out)
    room.unopened += cut
    return out, cut


def _wide(raw: bytes, place: Callable[[int, int], tuple[int, int]]) -> Layer | None:
    """The bytes as UTF-16, in the order that the places of zeros tell."""
    if len(raw) < 16 or raw.count(0) * 4 < len(raw):
        return None
    name = "utf-16-le" if raw[1::2].count(0) >= raw[::2].count(0) else "utf-16-be"
    text = raw.decode(name, "replace")
    ends: list[int] = []

    def back(a: int, b: int) -> tuple[int, int]:
        if not ends:
            ends.append(0)
            for c in text:
                ends.append(ends[-1] + (4 if ord(c) > 0xFFFF else 2))
        return place(ends[a], min(ends[b], len(raw)))

    return Layer(text, back)


def _views(raw: bytes, place: Callable[[int, int], tuple[int, int]], room: Room) -> Iterator[Layer]:
    """The layers that bytes hold; `place` maps a span of the bytes."""
    covered = 0
    for start, end, unpacked, whole, cut in _members(raw, room):
        covered += end - start if whole else 0
        if unpacked or cut:
            yield Layer(unpacked, lambda a, b, i=start, j=end: place(i, j), cut)
    if covered == len(raw):
        return
    if not covered and (more := _deflated(raw, room)):
        yield Layer(more[0], lambda a, b: place(0, len(raw)), more[1])
    if wide := _wide(raw, place):
        yield wide
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        text = raw.decode("latin-1")
    if len(text) == len(raw):
        yield Layer(text, place)
        return
    widths: list[int] = []

    def back(a: int, b: int) -> tuple[int, int]:
        if not widths:
            widths.append(0)
            for c in text:
                widths.append(widths[-1] + len(c.encode("utf-8")))
        return place(widths[a], widths[b])

    yield Layer(text, back)


def _pieces(at: int, parts: list[tuple[str, int, int]]) -> Layer:
    """A layer put together from parts, each with its span in the run that begins at `at`; a span maps to the parts it touches."""
    starts, n = [], 0
    for text, _, _ in parts:
        starts.append(n)
        n += len(text)

    def back(a: int, b: int) -> tuple[int, int]:
        i, j = bisect_right(starts, a) - 1, bisect_right(starts, max(b - 1, a)) - 1
        one = lambda k: len(parts[k][0]) == parts[k][2] - parts[k][1]  # noqa: E731  copied as it stands
        left = parts[i][1] + (a - starts[i] if one(i) else 0)
        right = parts[j][1] + b - starts[j] if one(j) else parts[j][2]
        return at + left, at + right

    return Layer("".join(p[0] for p in parts), back)


_BAD: list[tuple[int, int]] = []


def _noted(e: UnicodeError) -> tuple[str, int]:
    _BAD.append((e.start, e.end))
    return "\ufffd", e.end


codecs.register_error("touchline.noted", _noted)


def _characters(raw: bytes) -> list[tuple[str, int]]:
    """UTF-8 characters with the bytes that each takes; bytes that make none count as U+FFFD."""
    _BAD.clear()
    text, bad = codecs.decode(raw, "utf-8", "touchline.noted"), dict(_BAD)
    out, at = [], 0
    for c in text:
        end = bad.get(at) or at + len(c.encode("utf-8"))
        out.append((c, end - at))
        at = end
    return out


_ESCAPES = re.compile(r"((?:%[0-9A-Fa-f]{2})+)")


def _url(m: re.Match) -> Layer | None:
    parts, at = [], 0
    for k, piece in enumerate(_ESCAPES.split(m[0])):
        for c, n in _characters(bytes.fromhex(piece.replace("%", ""))) if k % 2 else [(piece, 0)] * bool(piece):
            end = at + (3 * n or len(piece))
            parts.append((c, at, end))
            at = end
    return _pieces(m.start(), parts)


def _unicode(m: re.Match) -> Layer | None:
    run, parts, i = m[0], [], 0
    if _ESCAPE.search(run) is None:
        return None
    for e in _ESCAPE.finditer(run):
        if e.start() > i:
            parts.append((run[i : e.start()], i, e.start()))
        code = ord(_NAMED[e[7]]) if e[7] else int(e[6]) if e[6] else int(e[1] or e[2] or e[3] or e[4] or e[5], 16)
        parts.append((chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd", e.start(), e.end()))
        i = e.end()
    if i < len(run):
        parts.append((run[i:], i, len(run)))
    return _pieces(m.start(), parts)


def _packed(raw: bytes, run: re.Match, byte: re.Pattern, room: Room) -> Iterator[Layer]:
    """The compressed data in the bytes that an escaped run stands for; `byte` matches what stands for one of them."""
    if not _MAGIC.search(raw):
        return
    starts = [run.start() + m.start() for m in byte.finditer(run[0])] + [run.end()]
    for i, j, unpacked, _, cut in _members(raw, room):
        if unpacked or cut:
            yield Layer(unpacked, lambda a, b, i=starts[i], j=starts[j]: (i, j), cut)


def _url_bytes(m: re.Match, room: Room) -> Iterator[Layer]:
    if "%" in m[0]:
        yield from _packed(unquote_to_bytes(m[0]), m, _PERCENT_BYTE, room)
        if "+" in m[0]:  # stands for a blank in forms
            yield from _packed(unquote_to_bytes(m[0].replace("+", " ")), m, _PERCENT_BYTE, room)


def _literal_byte(m: re.Match) -> str:
    if m[4]:
        return chr(_CONTROL.get(m[4], ord(m[4])))
    return chr(int(m[1] or m[2], 16)) if m[1] or m[2] else chr(int(m[3], 8) & 255) if m[3] else m[0]


def _literal_bytes(m: re.Match, room: Room) -> Iterator[Layer]:
    if "\\" in m[0]:
        yield from _packed(_LITERAL_BYTE.sub(_literal_byte, m[0]).encode("latin-1"), m, _LITERAL_BYTE, room)


def _base64(text: str, lines: list[tuple[int, int]], room: Room, sure: bool = True) -> Iterator[Layer]:
    """The layers in base64 that stands in the spans of one or more lines; if it is not sure that a group begins there, only bytes that
    may hold something count."""
    run = "".join(text[a:b] for a, b in lines).rstrip("=")
    if len(run) % 4 == 1:
        run = run[:-1]
    plain = run.replace("-", "+").replace("_", "/")
    try:
        raw = base64.b64decode(plain + "=" * (-len(plain) % 4))
    except (binascii.Error, ValueError):
        return
    if not sure and _TELLING.search(raw) is None:
        return
    befores, n = [], 0
    for a, b in lines:
        befores.append(n)
        n += b - a

    def at(k: int) -> int:
        i = bisect_right(befores, k) - 1
        return lines[i][0] + k - befores[i]

    def place(a: int, b: int) -> tuple[int, int]:
        last = n if b >= len(raw) else min(n, -(-b // 3) * 4)
        return at(a // 3 * 4), at(max(last, 1) - 1) + 1

    yield from _views(raw, place, room)


def _wrapped(lines: list[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
    """Of lines in a row: those of one width with a shorter last one, and the same with a shorter first line, which began in the middle."""
    width, i = [b - a for a, b in lines], 0
    while i < len(lines):
        j = i + 1
        while j < len(lines) and width[j] == width[i]:
            j += 1
        last = j + (j < len(lines) and width[j] < width[i])
        if width[i] >= 16 and last - i > 1:
            yield lines[i:last]
        if i == 1 and width[0] < width[1]:
            yield lines[:last]
        i = j


def unwrap(content: str | bytes, room: Room) -> Iterator[Layer]:
    """The layers directly inside a text or bytes."""
    if isinstance(content, bytes):
        yield from _views(content, lambda a, b: (a, b), room)
        return
    text = content
    if "%" in text and _PERCENT.search(text):
        yield from filter(None, (_url(m) for m in _PERCENT.finditer(text)))
        for m in _PERCENT_BYTES.finditer(text):
            yield from _url_bytes(m, room)
    if any(sign in text for sign in _ESCAPE_SIGNS):
        yield from filter(None, (_unicode(m) for m in _UNICODE.finditer(text)))
    if "\\u" in text or "\\x" in text:
        for m in _LITERAL.finditer(text):
            yield from _literal_bytes(m, room)
    if len(text) >= 16 and _LONG.search(text):
        for m in _BASE64.finditer(text):
            a, b = m.span()
            for k in range(4):  # where the first group begins
                yield from _base64(text, [(a + k, b)], room, not k)
        for m in _LINES.finditer(text):
            for lines in _wrapped([x.span() for x in _LINE.finditer(text, *m.span())]):
                yield from _base64(text, lines, room)


def _narrow(spans: set[tuple[int, int, str, int]]) -> Iterator[tuple[int, int, str]]:
    """The spans, without those that hold another one of the same kind and content."""
    last: dict[tuple[str, int], int] = {}
    for a, b, kind, content in sorted(spans, key=lambda s: (s[1], -s[0])):
        if a > last.get((kind, content), -1):
            last[kind, content] = a
            yield a, b, kind


def scan(text: str | None) -> Found:
    """All finds of one text, decoded layers included."""
    text = text or ""
    out = Found(base_spans(text))
    known, depths, holders = {text: 0}, [0], [[]]
    spans: list[set] = [{(*s, 0) for s in out.base}]  # of each content: its finds and those of the layers inside, with the content that they are of
    work, room = deque([text]), Room(len(text))
    while work:
        content = work.popleft()
        at = known[content]
        if len(content) > 1024 and content == content[:1] * len(content) and (isinstance(content, str) or content[0] not in b"0123456789abcdef"):
            continue
        for layer in unwrap(content, room):
            k = known.setdefault(layer.content, len(depths))
            if k == len(depths):
                told = isinstance(layer.content, str)
                depths.append(depths[at] + (not told or isinstance(content, str)))
                spans.append({(*s, k) for s in base_spans(layer.content)} if told else set())
                holders.append([])
                work.append(layer.content)
            holders[k].append((at, layer.back))
            if layer.cut:
                spans[at].add((*layer.back(0, len(layer.content)), "closed", k))
    fresh = [(k, some) for k, some in enumerate(spans) if some]
    while fresh:
        k, some = fresh.pop()
        for at, back in holders[k]:
            more = {(*back(a, b), kind, of) for a, b, kind, of in some} - spans[at]
            if more:
                spans[at] |= more
                fresh.append((at, more))
    finds = [{f for f in some if f[2] != "closed"} for some in spans]
    out.spans, out.closed = {*out.base, *_narrow(finds[0])}, sorted({f[:2] for f in spans[0] - finds[0]})
    texts = [k for x, k in known.items() if k and isinstance(x, str) and (finds[k] or _readable(x))]
    out.layers, out.depth = len(texts), max((depths[k] for k in texts), default=0)
    out.unopened = room.unopened
    return out


def said(spans) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


DIGESTS = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, layers long, depth long, unopened long"


def findings(docs: DataFrame) -> DataFrame:
    """One row per document: DIGESTS. Counts and base_sha256 are of the plain finds, spans of all."""

    def of(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for t in b.column("text").to_pylist():
            f = scan(t)
            counts = [sum(k == kind for *_, k in f.base) for kind in KINDS]
            digest = hashlib.sha256(said(f.base).encode()).hexdigest()
            rows.append((*counts, digest, said(order(f.spans)), f.layers, f.depth, f.unopened))
        columns = list(zip(*rows, strict=True)) or [[]] * 8
        kinds = (*[pa.int64()] * 3, *[pa.string()] * 2, *[pa.int64()] * 3)
        return pa.RecordBatch.from_arrays(
            [b.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "layers", "depth", "unopened"],
        )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(by_text(lambda: of), DIGESTS)


def redacted(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with every span, merged where they touch or overlap, replaced by the mark, and so every run with a layer that was not opened
    to its end."""
    f = scan(text)
    spans = sorted([*((a, b) for a, b, _ in f.spans), *f.closed])
    if not spans:
        return text
    out, end = [], 0
    for a, b in spans:
        if a > end or not out:
            out += [text[end:a], mark]
        end = max(end, b)
    return "".join(out) + text[end:]


def redact(docs: DataFrame) -> DataFrame:
    """The documents with their secrets replaced; n_chars, where it is a column, follows the new text."""
    schema, names = docs.schema, docs.columns

    def of(b: pa.RecordBatch) -> pa.RecordBatch:
        old = b.column("text").to_pylist()
        new = [redacted(t) for t in old]
        columns = {n: b.column(i) for i, n in enumerate(names)}
        columns["text"] = pa.array(new, columns["text"].type)
        if "n_chars" in columns:
            was = columns["n_chars"]
            now = [w if x == y or x is None else len(x) for w, x, y in zip(was.to_pylist(), new, old, strict=True)]
            columns["n_chars"] = pa.array(now, was.type)
        return pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    return docs.mapInArrow(by_text(lambda: of), schema)
