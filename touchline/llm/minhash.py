"""Near-duplicates by circulant MinHash.

Words are maximal runs without ASCII white space, A-Z lower-cased; a document's set holds its distinct word shingles. One
permutation (of hash positions) scatters the shingles, a second one, circularly shifted by 0, 1, 2, ..., gives all coordinates of
the signature: the coordinates of one shingle are a slice of the second permutation. Coordinates are cut into bands; documents
that share a band are candidates, and exact Jaccard on full sets confirms each link.

Documents with equal sets are one node. Inside a band's bucket no pairs are spelled out. First every member is held against the
member that is most similar to all and against a few others; a bucket of more than `Settings.block` members is split into parts
for this, which share some members drawn by hash, so that near copies hang together whatever their number. Then, in buckets that
still hold several components, the members outside the bucket's largest component are held, set against set, against every
promising member of other components (by the whole signature) until a link to that component is found, so that every promising pair
between components is confirmed or refuted; only links leave the bucket. Members of the largest component are never held against
each other: a bucket of m members, r of them outside, takes r * m comparisons. They are dealt out as squares of `block` members by
`block`, so a task holds two blocks and their sets, whatever r and m; a member outside is copied to m / block squares, any member
to r / block. A bucket whose m members all share a band without being near, as pages of one template, takes m * m.

Defined results: null, empty and blank texts have no shingles, link with nothing and are kept; repeated rows are copies of each
other; rows without an id get no component and are kept; an empty table gives no rows. Texts of any length enter with all of their
shingles, in memory in proportion to one text. Of equally similar members the smallest node comes first. Other columns are not
read, and stay as they are where documents are kept, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import Members, WordCache, by_text, components, runs, settle

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]


@dataclass(frozen=True)
class Settings:
    words: int = 5  #: words in a shingle
    percent: int = 80  #: linked if 100 * intersection >= percent * union
    bands: int = 40
    rows: int = 5  #: coordinates in a band; a pair at 0.8 is missed by all bands with probability 1.2e-7
    coordinates: int = 256
    slack: float = 0.14  #: pairs whose estimate falls short of the threshold by more (5.6 deviations: probability 2e-8) are not confirmed
    first: int = 4  #: partners of a document in the first round
    block: int = 512  #: members of a bucket that meet in one step, on either side
    shared: int = 16  #: members, about, of a larger bucket that meet in all of its parts


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _ODD[2]
    x = (x ^ (x >> np.uint64(33))) * _ODD[3]
    return x ^ (x >> np.uint64(33))


class Shingler:
    """Text -> sorted 64-bit hashes of its distinct shingles."""

    def __init__(self, words: int):
        self.words = words
        self.cache = WordCache(xxhash.xxh3_64_intdigest)

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        h = np.fromiter(map(self.cache.__getitem__, words), np.uint64, len(words))
        n = min(self.words, len(h))
        g = np.full(len(h) - n + 1, n, np.uint64)
        for i in range(n):
            g = _mix(g * _ODD[0] + h[i : len(h) - n + 1 + i])
        g.sort()
        return g[np.concatenate(([True], g[1:] != g[:-1]))]


class Signer:
    """Shingle hashes -> signature coordinates and band keys.

    The first permutation puts a shingle at one of 2^32 places, the second one is a keyed bijection of places; shifted by k it gives
    coordinate k. Two unrelated sets of n shingles have n / 2^32 of their places in common: a band in common is improbable however
    long the texts (1e-13 at 20 million shingles each).
    """

    step = 512  #: shingles taken at once

    def __init__(self, settings: Settings):
        self.settings = settings
        self.shifts = np.arange(settings.coordinates, dtype=np.uint32)
        self.at, self.high = (np.empty((self.step, settings.coordinates), np.uint32) for _ in range(2))

    def coordinates(self, shingles: np.ndarray) -> np.ndarray:
        places = (_mix(shingles + _ODD[1]) >> np.uint64(32)).astype(np.uint32)
        out = np.full(len(self.shifts), 0xFFFFFFFF, np.uint32)
        for i in range(0, len(places), self.step):
            n = len(places[i : i + self.step])
            x, high = self.at[:n], self.high[:n]
            np.add(places[i : i + n, None], self.shifts, out=x)
            x *= np.uint32(0x85EBCA6B)
            np.right_shift(x, np.uint32(15), out=high)
            x ^= high
            x *= np.uint32(0xC2B2AE35)
            np.minimum(out, x.min(axis=0), out=out)
        return out

    def bands(self, coordinates: np.ndarray) -> np.ndarray:
        s = self.settings
        c = coordinates[: s.bands * s.rows].reshape(s.bands, s.rows).astype(np.uint64)
        key = np.arange(1, s.bands + 1, dtype=np.uint64)
        for i in range(s.rows):
            key = _mix(key * _ODD[0] + c[:, i])
        return key.view(np.int64)


def _node(shingles: np.ndarray) -> int:
    """64 bits that stand for a whole set."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def sketch(docs: DataFrame, settings: Settings) -> DataFrame:
    """doc_id, n_shingles, node (null without shingles), bands, sig (low bytes of the coordinates)."""

    def step():
        shingler, signer = Shingler(settings.words), Signer(settings)

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            counts, nodes, bands, sigs = [], [], [], []
            for t in b.column("text").to_pylist():
                s = shingler(t)
                c = signer.coordinates(s) if len(s) else None
                counts.append(len(s))
                nodes.append(_node(s) if len(s) else None)
                bands.append(None if c is None else signer.bands(c))
                sigs.append(None if c is None else c.astype(np.uint8).tobytes())
            return pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(nodes, pa.int64()),
                    pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary()),
                ],
                names=["doc_id", "n_shingles", "node", "bands", "sig"],
            )

        return run

    schema = "doc_id long, n_shingles long, node long, bands array<long>, sig binary"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(by_text(step), schema)


def _sets(docs: DataFrame, wanted: DataFrame, settings: Settings) -> DataFrame:
    """node, shingles (binary) of the wanted (node, doc_id). Texts are not shuffled: a bitmap picks the rows that may be wanted."""
    members = Members(wanted, "doc_id")
    test = members.test()

    def step():
        shingler = Shingler(settings.words)

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            b = b.filter(pa.array(test(b.column("slot").to_numpy())))
            sets = [shingler(t) for t in b.column("text").to_pylist()]
            nodes = [_node(s) if len(s) else None for s in sets]
            return pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(nodes, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                names=["id", "node", "shingles"],
            )

        return run

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), "text")
    found = rows.select("id", "text", members.slot("id").alias("slot")).mapInArrow(by_text(step), "id long, node long, shingles binary")
    return found.join(wanted, "node").where("id = doc_id").dropDuplicates(["node"]).select("node", "shingles")


@dataclass
class Block:
    """Members of a part of a bucket; `left` ones are held against `right` ones."""

    nodes: np.ndarray
    labels: np.ndarray
    left: np.ndarray
    right: np.ndarray
    alike: np.ndarray  #: left x right, estimates
    fits: np.ndarray  #: left x right, promising pairs between components, each once


def _block(t: pa.Table, settings: Settings, ordered: bool) -> Block:
    """ordered: of two members outside the largest component the pair counts on the side of the smaller node only."""
    nodes, labels, n = (t.column(c).to_numpy() for c in ("node", "label", "n"))
    left, right = (np.flatnonzero(t.column(c).to_numpy(zero_copy_only=False)) for c in ("left", "right"))
    sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(len(nodes), -1)
    alike, others = np.empty((len(left), len(right)), np.float32), sig[right]
    for i, k in enumerate(left):
        alike[i] = (sig[k] == others).mean(axis=1)
    fits = alike >= settings.percent / 100 - settings.slack
    a, b = n[left][:, None], n[right]
    fits &= 100 * np.minimum(a, b) >= settings.percent * np.maximum(a, b)
    fits &= labels[left][:, None] != labels[right]
    if ordered:
        too = t.column("outside").to_numpy(zero_copy_only=False)[right]
        fits &= ~too | (nodes[left][:, None] < nodes[right])
    return Block(nodes, labels, left, right, alike, fits)


def _first_pairs(settings: Settings):
    """Blocks -> (a, b): every member with the medoid, if promising, and with its most similar others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, "block"):
            k = _block(t, settings, False)
            centre = int(k.alike.sum(axis=1).argmax())
            out = {(int(i), centre) for i in np.flatnonzero(k.fits[centre])}
            for i in np.flatnonzero(k.fits.any(axis=1)):
                js = np.flatnonzero(k.fits[i])
                out |= {(int(i), int(j)) for j in js[np.argsort(-k.alike[i, js], kind="stable")][: settings.first]}
            a, b = ([int(f(k.nodes[i], k.nodes[j])) for i, j in out] for f in (min, max))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _involved(settings: Settings):
    """Blocks -> (block, bucket, node, left, right, outside) of the members of promising pairs between components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, "block"):
            k = _block(t, settings, True)
            some = np.zeros(len(k.nodes), bool)
            some[k.left[k.fits.any(axis=1)]] = True
            some[k.right[k.fits.any(axis=0)]] = True
            yield from t.select(["block", "bucket", "node", "left", "right", "outside"]).filter(pa.array(some)).to_batches()

    return run


def _links(settings: Settings):
    """Blocks with sets -> (u, v): a link from each left member to each other component, if there is one.

    A pair that shares several bands is held together in the first of them only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, "block"):
            k, bucket = _block(t, settings, True), t.column("bucket")[0].as_py()
            bands = np.array(t.column("bands").to_pylist(), np.int64)
            sets = [np.frombuffer(x, np.uint64) for x in t.column("shingles").to_pylist()]
            u, v = [], []
            for x in np.flatnonzero(k.fits.any(axis=1)):
                i, columns = k.left[x], np.flatnonzero(k.fits[x])
                first = (bands[k.right[columns]] == bands[i]).argmax(axis=1)
                columns = columns[bands[i][first] == bucket]
                done = set()
                for j in k.right[columns[np.argsort(-k.alike[x, columns], kind="stable")]]:
                    if k.labels[j] not in done and linked(sets[i], sets[j], settings.percent):
                        done.add(k.labels[j])
                        u.append(int(k.nodes[i])), v.append(int(k.nodes[j]))
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True):
                ok.append(linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent))
            yield pa.RecordBatch.from_arrays(
                [b.column("a"), b.column("b"), pa.array(ok, pa.bool_())], names=["a", "b", "linked"]
            )

    return run


def _parts(settings: Settings):
    """The parts of a bucket and the part that a member belongs to."""
    parts = F.ceil(F.col("m") / settings.block)
    return parts, F.pmod(F.xxhash64("node"), parts)


def _first_blocks(members: DataFrame, nodes: DataFrame, settings: Settings) -> DataFrame:
    """All members of the buckets, by part; a few of a large bucket stand in all of its parts."""
    parts, own = _parts(settings)
    shared = (parts > 1) & (F.pmod(F.xxhash64("node", "bucket"), F.col("m")) < settings.shared)
    part = F.explode(F.when(shared, F.sequence(F.lit(0).cast("long"), parts - 1)).otherwise(F.array(own)))
    rows = members.select("bucket", "node", part.alias("part")).join(nodes.select("node", "n", "sig"), "node")
    yes = F.lit(True)
    return rows.select(F.xxhash64("bucket", "part").alias("block"), "bucket", "node", F.col("node").alias("label"), "n", "sig", yes.alias("left"), yes.alias("right"))


def _late_blocks(members: DataFrame, labels: DataFrame, nodes: DataFrame, settings: Settings) -> DataFrame:
    """Members of the buckets that hold several components, by squares: block, bucket, node, label, n, sig, left, right, outside.

    Those outside the bucket's largest component are `left` in the squares of their own row, everyone is `right` in those of the own column.
    """
    known = members.join(labels, "node")
    sizes = known.groupBy("bucket", "label").agg(F.count("*").alias("c")).groupBy("bucket")
    mixed = sizes.agg(F.max_by("label", F.struct("c", "label")).alias("big"), (F.sum("c") - F.max("c")).alias("r"), F.count("*").alias("k"))
    active = known.join(mixed.where("k > 1").select("bucket", "big", "r"), "bucket")
    columns, column = _parts(settings)
    rows = F.ceil(F.col("r") / settings.block)
    row = F.pmod(F.xxhash64("node", F.lit(1)), rows)
    active = active.withColumns({"column": column, "row": row, "outside": F.col("label") != F.col("big")})
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    as_right = F.transform(upto(rows), lambda i: F.struct(i.alias("i"), F.col("column").alias("j")))
    as_left = F.transform(upto(columns), lambda j: F.struct(F.col("row").alias("i"), j.alias("j")))
    squares = F.explode(F.when(F.col("outside"), F.array_union(as_left, as_right)).otherwise(as_right)).alias("s")
    active = active.select("bucket", "node", "label", "row", "column", "outside", squares).join(nodes.select("node", "n", "sig"), "node")
    left, right = F.col("outside") & (F.col("s.i") == F.col("row")), F.col("s.j") == F.col("column")
    return active.select(F.xxhash64("bucket", "s.i", "s.j").alias("block"), "bucket", "node", "label", "n", "sig", left.alias("left"), right.alias("right"), "outside")


def _together(blocks: DataFrame) -> DataFrame:
    return blocks.repartition("block").sortWithinPartitions("block", "node")


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after the components of links(u, v) between labels have become one."""
    merged = components(links).withColumnRenamed("label", "to")
    joined = labels.join(merged, labels.label == merged.node, "left")
    return settle(joined.select(labels.node, F.coalesce("to", "label").alias("label")))


def clusters(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    rows = settle(sketch(docs, settings))
    nodes = settle(
        rows.where("node is not null and doc_id is not null")
        .groupBy("node")
        .agg(F.min(F.struct("doc_id", "n_shingles", "bands", "sig")).alias("r"))
        .select("node", "r.doc_id", F.col("r.n_shingles").alias("n"), "r.bands", "r.sig")
    )
    members = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1")
    members = settle(members.join(shared, "bucket"))
    wanted = settle(members.select("node").distinct().join(nodes.select("node", "doc_id"), "node"))
    sets = settle(_sets(docs, wanted, settings))
    labels = sets.select("node", F.col("node").alias("label"))
    found = _together(_first_blocks(members, nodes, settings)).mapInArrow(_first_pairs(settings), "a long, b long").distinct()
    pairs = (
        found.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
        .join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
        .select("a", "b", "x", "y")
    )
    confirmed = pairs.mapInArrow(_confirmed(settings.percent), "a long, b long, linked boolean").where("linked")
    labels = _relabelled(labels, confirmed.select(F.col("a").alias("u"), F.col("b").alias("v")))
    late = _together(_late_blocks(members, labels, nodes, settings))
    involved = late.mapInArrow(_involved(settings), "block long, bucket long, node long, left boolean, right boolean, outside boolean")
    whole = involved.join(labels, "node").join(sets, "node").join(nodes.select("node", "n", "bands", "sig"), "node")
    late = _together(whole).mapInArrow(_links(settings), "u long, v long")
    labels = _relabelled(labels, late.join(labels.select(F.col("node").alias("u"), F.col("label").alias("p")), "u").join(
        labels.select(F.col("node").alias("v"), F.col("label").alias("q")), "v").select(F.col("p").alias("u"), F.col("q").alias("v")))
    ids = nodes.join(labels, "node", "left").select("node", "doc_id", F.coalesce("label", "node").alias("label"))
    least = ids.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    ids = ids.join(least, "label").select("node", "component_id")
    out = rows.select("doc_id", "n_shingles", "node").join(ids, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept")
    )


def deduplicate(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One document of each group stays (the smallest id; of rows with one id and text, one), with its own columns."""
    found = settle(clusters(docs, settings).where("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("n")))
    gone, twice = found.where("not kept").select("doc_id"), found.where("n > 1").select("doc_id")
    suspect = Members(gone, "doc_id").has("doc_id")  # texts that surely stay are not shuffled
    stay = docs.where(~suspect).unionByName(docs.where(suspect).join(gone, "doc_id", "left_anti"))
    if twice.limit(1).count():
        again = Members(twice, "doc_id").has("doc_id")
        stay = stay.where(~again).unionByName(stay.where(again).dropDuplicates(["doc_id", "text"]))
    return stay.select(*docs.columns)
