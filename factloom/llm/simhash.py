"""SimHash near-duplicates through vantage-point trees.

Each whole text becomes a 64-bit fingerprint; documents link when their
fingerprints differ in at most ``radius`` bits, and a linked component is a
group of near copies.

Equal fingerprints are merged first, so a group of exact copies is one point
whatever its size. A vantage-point tree, fitted on a bounded sample of the
distinct fingerprints, splits the Hamming space into shards: a point lives in
one shard (home), and the triangle inequality decides which further shards it
must visit (guest), namely those whose side of a ball's surface lies within
``radius`` of it. Every shard joins its home points with each other and with its
guests, independently of the rest, splitting further by local vantage points,
so each pair within the radius is met exactly where its one end is at home.
A shard that many near copies make large is cut into blocks, joined pair by pair.
Shards return spanning edges, not pairs, and components come from a distributed
star algorithm.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import in_blocks
from .common import Scratch, small_batches
from .components import connected_components

SEED = 42
SHINGLE = 3
RADIUS = 2
#: Distinct fingerprints that the shared tree is fitted on, at most.
TREE_SAMPLE = 1 << 17
#: Home points that a shard should have, and those below which a shard is compared block by block.
SHARD_POINTS = 2048
LEAF_POINTS = 512
#: Points of a shard that one task joins; a shard of more is cut into blocks of about so many.
BLOCK_POINTS = 16_384
#: Shingles whose bits are unpacked at once.
BLOCK = 1 << 14


def shingle_hashes(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """XXH64 of every shingle of a whole text, repeats included; a shorter text is one shingle, null and blank texts have none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: lowers A-Z and splits at the six separators only
    m = max(1, len(words) - n + 1) if words else 0
    return np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + n]), SEED) for i in range(m)), np.uint64, m)


def majority(hashes: np.ndarray) -> int:
    """The unsigned fingerprint of hashes: the bits that over half of them have; of none it is 0."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        counts += np.unpackbits(hashes[at : at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, n: int = SHINGLE) -> int:
    """The unsigned fingerprint of a whole text; null and blank texts have 0."""
    return majority(shingle_hashes(text, n))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE) -> DataFrame:
    """(id, fingerprint as a signed long) of every row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = np.fromiter((fingerprint(t.as_py(), n) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(values.view(np.int64))], names=["id", "fp"])

    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(each, f"id {kind}, fp long")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


class VantageTree:
    """Inner nodes are (vantage point, ball radius); points inside go left.

    ``fit`` works on a sample; ``route`` sends points through the tree, home
    points to one leaf and guests to all leaves that may hold something within
    ``radius`` of them.
    """

    def __init__(self, radius: int = RADIUS):
        self.radius, self.nodes, self.leaves = radius, [], 0

    def fit(self, points: np.ndarray, leaf_points: float) -> VantageTree:
        self._grow(points, leaf_points, np.random.default_rng(SEED))
        return self

    def _grow(self, points: np.ndarray, leaf_points: float, rng) -> int:
        at = len(self.nodes)
        self.nodes.append(None)
        split = best_split(points, self.radius, rng) if len(points) > leaf_points else None
        if split is None:
            self.nodes[at] = (np.uint64(0), -1, self.leaves, 0)
            self.leaves += 1
            return at
        vp, mu = split
        inside = np.bitwise_count(points ^ vp) <= mu
        left = self._grow(points[inside], leaf_points, rng)
        right = self._grow(points[~inside], leaf_points, rng)
        self.nodes[at] = (vp, mu, left, right)
        return at

    def route(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the point, leaf, is home) for every visit."""
        out, stack = [], [(0, np.arange(len(points)), np.ones(len(points), bool))]
        while stack:
            node, rows, home = stack.pop()
            if not len(rows):
                continue
            vp, mu, left, right = self.nodes[node]
            if mu < 0:
                out.append((rows, np.full(len(rows), left), home))
                continue
            to_left, as_home, to_right = visits(points[rows], home, vp, mu, self.radius)
            stack.append((left, rows[to_left], as_home[to_left]))
            stack.append((right, rows[to_right], home[to_right]))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def visits(points: np.ndarray, home: np.ndarray, vp: np.uint64, mu: int, radius: int):
    """Who enters the inner side, whether at home there, and who the outer side.

    Outer home points also visit the inner side as guests when they are within
    the radius of it; inner home points needn't visit the outer side, as the
    pair is met from the other end. Guests visit each side within the radius.
    """
    d = np.bitwise_count(points ^ vp).astype(np.int16)
    inside = d <= mu
    return d <= mu + radius, home & inside, np.where(home, ~inside, d > mu - radius)


def best_split(points: np.ndarray, radius: int, rng, tries: int = 8):
    """Of a few vantage points drawn from ``points``, the one with the least
    work left; None if every split sends nearly all points both ways."""
    best, least = None, 0.9 * float(len(points)) ** 2
    some = points if len(points) <= 4096 else rng.choice(points, 4096, replace=False)
    for vp in rng.choice(some, min(tries, len(some)), replace=False):
        d = np.bitwise_count(some ^ vp).astype(np.int64)
        counts = np.bincount(d, minlength=65)
        upto = np.cumsum(counts)
        mid = int(np.searchsorted(upto, len(some) / 2))
        for mu in {max(0, mid - 1), mid}:
            inner = upto[mu]
            if not 0 < inner < len(some):
                continue
            band = upto[min(64, mu + radius)] - inner
            scale = (len(points) / len(some)) ** 2
            work = scale * (inner * (inner + band) + (len(some) - inner) ** 2)
            if work < least:
                best, least = (np.uint64(vp), mu), work
    return best


def unite(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merges the classes of a[i] and b[i]; a class is named by its least member."""
    while True:
        x, y = labels[a], labels[b]
        if (x == y).all():
            return
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while (labels != labels[labels]).any():
            labels[:] = labels[labels]


def join_shard(points: np.ndarray, home: np.ndarray, radius: int = RADIUS, whole: bool = True) -> np.ndarray:
    """Class labels (index of the least member) over one shard's points, linked
    when at least one end is at home and they differ in ``radius`` bits or less.
    Those at home are compared with all, or, of two blocks (not ``whole``), with those not at home."""
    labels = np.arange(len(points))
    rng = np.random.default_rng(SEED)
    stack = [(np.flatnonzero(home), np.flatnonzero(~home))]
    while stack:
        h, g = stack.pop()
        if not len(h) or len(h) + len(g) < 2:
            continue
        split = best_split(points[h], radius, rng) if len(h) > LEAF_POINTS else None
        if split is None:
            every = np.concatenate([h, g]) if whole else g
            rows = max(1, (1 << 19) // max(1, len(every)))
            for at in range(0, len(h), rows):
                part = h[at : at + rows]
                i, j = np.nonzero(np.bitwise_count(points[part][:, None] ^ points[every][None, :]) <= radius)
                if len(i) > len(part) * whole:
                    unite(labels, part[i], every[j])
            continue
        both = np.concatenate([h, g])
        at_home = np.arange(len(both)) < len(h)
        to_left, as_home, to_right = visits(points[both], at_home, *split, radius)
        if not whole:  # others of the pair meet all at home, whichever side these are on
            d = np.bitwise_count(points[both] ^ split[0]).astype(np.int16)
            to_left, as_home = np.where(at_home, d <= split[1], to_left), at_home
            to_right = np.where(at_home, d > split[1], d > split[1] - radius)
        stack.append((both[to_left & as_home], both[to_left & ~as_home]))
        stack.append((both[to_right & at_home], both[to_right & ~at_home]))
    return labels


def links(reps: DataFrame, scratch: Scratch, radius: int = RADIUS, block: int = BLOCK_POINTS, shard_points: int = SHARD_POINTS) -> DataFrame:
    """Spanning links (u, v) of the distinct fingerprints ``reps`` (fp): within a shard, u was linked to v, the
    least of its class, by a chain of fingerprints that differ in ``radius`` bits or less."""
    spark = reps.sparkSession
    n = reps.count()
    sample = [r[0] for r in reps.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(TREE_SAMPLE).collect()]
    points = np.array(sample, np.int64).view(np.uint64)
    tree = VantageTree(radius).fit(points, max(32.0, shard_points * len(points) / max(1, n)))
    shared = spark.sparkContext.broadcast(tree)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy()
            rows, leaf, home = shared.value.route(fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int64()), pa.array(fp[rows]), pa.array(home)], names=["leaf", "fp", "home"])

    def join(t: pa.Table) -> pa.Table:
        fp = t.column("fp").to_numpy()
        labels = join_shard(fp.view(np.uint64), t.column("home").to_numpy(), radius, t.column("i")[0] == t.column("j")[0])
        moved = np.flatnonzero(labels != np.arange(len(labels)))
        return pa.table({"u": fp[moved], "v": fp[labels[moved]]})

    dealt = reps.select("fp").mapInArrow(deal, "leaf long, fp long, home boolean")
    return in_blocks(dealt, ["leaf"], "fp", block, scratch).groupBy("leaf", "i", "j").applyInArrow(join, "u long, v long")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, block: int = BLOCK_POINTS, shard_points: int = SHARD_POINTS) -> DataFrame:
    """(id, fp, component): every row with its fingerprint and the smallest id
    of its component.

    Nulls: a null text has fingerprint 0, like an empty one; a null id is never
    the smallest unless all of the component are null. Repeated ids are
    separate rows. Other columns of ``docs`` are not read. ``block`` and ``shard_points``
    set how the work is cut up, which changes no result.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.write(fingerprints(docs, id_col, text_col, shingle), "prints")
    reps = scratch.write(prints.groupBy("fp").agg(F.min("id").alias("rep")), "reps")
    classes = connected_components(links(reps, scratch, radius, block, shard_points), scratch)
    rooted = scratch.write(reps.join(classes, reps["fp"] == classes["node"], "left").select("fp", "rep", F.coalesce("root", "fp").alias("root")), "rooted")
    least = scratch.write(rooted.groupBy("root").agg(F.min("rep").alias("component")), "least")
    named = scratch.write(rooted.join(least, "root").select("fp", "component"), "named")
    return prints.join(named, "fp").select("id", "fp", "component")


def keep_one(docs: DataFrame, classes: Callable[[DataFrame], DataFrame] = near_classes) -> DataFrame:
    """``docs`` with one row of each group of near copies, which ``classes`` names
    for (doc_id, text) in columns id and component.

    The row with the group's smallest doc_id stays, null ids last, then the one
    with the smallest hash of its text; rows that repeat an id with the same
    text are one row.
    """
    key = F.struct(
        F.col("doc_id").isNull().alias("none"),
        F.coalesce("doc_id", F.lit(0).cast(docs.schema["doc_id"].dataType)).alias("id"),
        F.coalesce(F.xxhash64("text"), F.lit(0)).alias("hash"),
    )
    scratch = Scratch(docs.sparkSession, "simhash-keep")
    named = classes(docs.select(key.alias("doc_id"), "text"))
    first = scratch.write(named.where("id = component").select("id.*").distinct(), "first")
    keyed = docs.select("*", key.alias("__key"))
    on = [F.col(f"__key.{c}") == first[c] for c in ("none", "id", "hash")]
    return keyed.join(first, on, "left_semi").dropDuplicates(["__key"]).drop("__key")
