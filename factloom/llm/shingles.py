"""SimHash near-duplicates of a stated similarity, checked exactly.

Texts link when their sets of ``SHINGLE`` consecutive words have a Jaccard
similarity of ``PERCENT`` or more; a linked component is a group of near copies.
Texts of one set are merged first, so a group of exact copies is one node.

Links come from three searches, each checked on the whole sets. First the SimHash
operator: fingerprints of the shingles, vantage-point shards and their spanning links.
Similar sets may lie further apart than its radius, so a prefix filter finds the rest.

Two sets that are so similar share an element among the first (100 - PERCENT) % of
each, whatever the order, if it is the same for all (prefix filter). The
order puts the rarest elements first, by counts of all texts' elements in cells that several
elements share; the counts decide the cost, never the result. Candidates are nodes that share such an element: first
each with the smallest of them, then, where the links found so far leave
different components, all pairs across components. These meet in blocks, inside tasks, where digests of the sets
rule out nearly all pairs that aren't similar, so only the rest become rows, whose whole sets are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .blocks import in_blocks
from .common import Scratch, small_batches
from .components import connected_components

SEED = 42
SHINGLE = 5
#: Least similarity, in hundredths.
PERCENT = 80
#: Elements that share a cell of the counts, about, cells at least and at most, and cells that are summed together.
CELL_ELEMENTS, MIN_CELLS, MAX_CELLS, PART_CELLS = 4, 1 << 12, 1 << 26, 1 << 18
#: Characters of a text for each of its elements, about.
ELEMENT_CHARS = 4
#: Rows of an element that are joined pair by pair, at most; more go to tasks that compare them, in blocks of about so many. Pairs that are compared at once.
FEW_ROWS, BLOCK_ROWS, PAIRS = 16, 8192, 1 << 16
#: Bits of a set's digest: the parity of its elements' numbers by their last bits, in words of 64.
DIGEST_BITS = 1024
#: Names of sets whose prefixes a task has sent on that it remembers, so that it needn't send those of copies.
SENT = 1 << 18


def elements(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a whole text's shingles; null and blank texts have none, shorter ones one."""
    return np.unique(simhash.shingle_hashes(text, n))


def node_of(found: np.ndarray) -> int:
    """A signed long that stands for a set."""
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), SEED)).astype(np.int64))


def digest(found: np.ndarray) -> np.ndarray:
    """Two sets differ in at least as many elements as their digests differ in bits."""
    odd = np.bincount((found & np.uint64(DIGEST_BITS - 1)).astype(np.int64), minlength=DIGEST_BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def cells(found: np.ndarray, n: int) -> np.ndarray:
    """The cell, of n (a power of two), that counts each element: its first bits, since digests take the last ones."""
    return (found >> np.uint64(64 - (n.bit_length() - 1))).astype(np.int64)


def prefix(found: np.ndarray, counts: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The elements of a set, rare ones first by ``counts`` of cells, of which similar sets share one."""
    m = len(found)
    if not m:
        return found
    return found[np.lexsort((found, counts[cells(found, len(counts))]))[: m - -(-percent * m // 100) + 1]]


def element_counts(texts: DataFrame, shingle: int = SHINGLE) -> np.ndarray:
    """For each cell in how many texts its elements are, as a byte that grows with the logarithm. Tasks count
    all of their texts' elements; their counts are summed by parts of the cells."""
    chars = texts.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    n = min(MAX_CELLS, max(MIN_CELLS, 1 << (chars // (ELEMENT_CHARS * CELL_ELEMENTS)).bit_length()))
    part = min(n, PART_CELLS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(n, np.uint16)
        for b in batches:
            for t in b.column(0):
                np.add.at(held, cells(elements(t.as_py(), shingle), n), np.uint16(1))
            np.minimum(held, 1 << 15, out=held)  # a batch has fewer rows than that
        for at in range(0, n, part):
            some = np.minimum(held[at : at + part], 255).astype(np.uint8)
            if some.any():
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([pa.compress(some.tobytes(), "zstd", asbytes=True)], pa.binary())], names=["at", "counts"])

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(part, np.int64)
        for x in t.column("counts"):
            total += np.frombuffer(pa.decompress(x.as_py(), part, "zstd", asbytes=True), np.uint8)
        code = np.minimum(255, 12 * np.log2(1 + total)).astype(np.uint8)
        return pa.table({"at": t.column("at")[:1], "counts": pa.array([code.tobytes()], pa.binary())})

    counts = np.zeros(n, np.uint8)
    for at, some in texts.select("text").mapInArrow(count, "at long, counts binary").groupBy("at").applyInArrow(add, "at long, counts binary").collect():
        counts[at : at + part] = np.frombuffer(some, np.uint8)
    return counts


def may_be_near(t: pa.Table, percent: int = PERCENT, spanning: bool = False) -> pa.Table:
    """(u, v) of the rows (node, size, pos, root, digest, home, i, j) of one element or two of its blocks: pairs of different components whose
    sizes, places and digests allow that their sets are similar, or some that span the components that such pairs join.
    Of two blocks those at home are compared with the others."""
    node, size, pos, root = (t.column(c).to_numpy().astype(np.int64) for c in ("node", "size", "pos", "root"))
    marks = t.column("digest").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(node), -1)
    home = t.column("home").to_numpy(zero_copy_only=False)
    alone = t.column("i")[0] == t.column("j")[0]
    own, other = np.flatnonzero(home), np.arange(len(node)) if alone else np.flatnonzero(~home)
    names, label = np.unique(root, return_inverse=True)
    joined = np.arange(len(names))
    us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    rows = max(1, PAIRS // max(1, len(other)))
    for at in range(0, len(own), rows):
        a, b = (x.ravel() for x in np.meshgrid(own[at : at + rows], other, indexing="ij"))
        # a pair is met from both ends, within one block or in two tasks
        ok = (node[a] > node[b]) & (joined[label[a]] != joined[label[b]]) & fits(size[a], pos[a], size[b], pos[b], percent)
        a, b = a[ok], b[ok]
        apart = np.bitwise_count(marks[a] ^ marks[b]).sum(axis=1, dtype=np.int64)
        ok = apart * (100 + percent) <= (size[a] + size[b]) * (100 - percent)
        a, b = a[ok], b[ok]
        while spanning and len(a):
            _, some = np.unique(joined[label[a]], return_index=True)
            us.append(node[a[some]])
            vs.append(node[b[some]])
            simhash.unite(joined, label[a[some]], label[b[some]])
            left = joined[label[a]] != joined[label[b]]
            a, b = a[left], b[left]
        us.append(node[a])
        vs.append(node[b])
    u, v = np.concatenate(us), np.concatenate(vs)
    return pa.table({"u": np.maximum(u, v), "v": np.minimum(u, v)})


def fits(m, at, n, place, percent: int = PERCENT):
    """Whether two sets of m and n elements may be similar that share the elements at these places and none before: sizes are
    near, and what is left of each suffices. A pair that shares earlier elements meets there too."""
    enough = lambda x: x * (100 + percent) >= (m + n) * percent
    return (m * 100 >= n * percent) & (n * 100 >= m * percent) & enough(m - at) & enough(n - place)


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, few_rows: int = FEW_ROWS, block: int = BLOCK_ROWS) -> DataFrame:
    """(id, node, component): every row with its set's name and the smallest id of its component.

    Nulls: null and blank texts have the empty set and link with each other alone; a null id is
    never the smallest unless all of the component are null. Repeated ids are separate
    rows. Other columns of ``docs`` are not read. ``few_rows`` and ``block`` set how
    the work is cut up, which changes no result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "shingles")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        sent: set[int] = set()
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                nodes, sizes, prints, digests, firsts = [], [], [], [], []
                for t in part.column(1):
                    hashes = simhash.shingle_hashes(t.as_py(), shingle)
                    found = np.unique(hashes)
                    node = node_of(found)
                    nodes.append(node)
                    sizes.append(len(found))
                    prints.append(simhash.majority(hashes))
                    digests.append(digest(found))
                    firsts.append(None if node in sent else prefix(found, counts, percent).view(np.int64))
                    sent.add(node)
                if len(sent) > SENT:
                    sent.clear()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(digests, pa.list_(pa.int64())), pa.array(firsts, pa.list_(pa.int64()))],
                    names=["id", "node", "size", "fp", "digest", "firsts"],
                )

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                found = [elements(t.as_py(), shingle) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(node_of, found), pa.int64()), pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))], names=["wanted", "node", "found"])

    shared = spark.sparkContext.broadcast(element_counts(texts, shingle))

    prints = scratch.write(texts.mapInArrow(name, f"id {kind}, node long, size int, fp long, digest array<long>, firsts array<long>"), "prints")
    reps = scratch.write(prints.groupBy("node").agg(F.min("id").alias("rep"), F.min("size").alias("size"), F.min("fp").alias("fp"), F.min("digest").alias("digest")), "reps")
    firsts = prints.where("firsts is not null").select("node", "size", F.posexplode("firsts").alias("pos", "token"))
    met = firsts.groupBy("token").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("token", "low")
    buckets = scratch.write(firsts.join(met, "token").distinct(), "buckets")

    by_print = scratch.write(reps.groupBy("fp").agg(F.min("node").alias("first")), "by_print")
    linked = simhash.links(by_print.select("fp"), scratch)
    ends = [by_print.select(F.col("fp").alias(k), F.col("first").alias(f"{k}_node")) for k in ("u", "v")]
    alike = linked.join(ends[0], "u").join(ends[1], "v").select(F.col("u_node").alias("u"), F.col("v_node").alias("v"))
    alike = alike.union(reps.join(by_print, "fp").where("node != first").select("node", "first"))

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """Those of the pairs (u, v) that are similar. Digests, far smaller than the sets, first rule out pairs that differ too much."""
        ends = [reps.select(F.col("node").alias(k), F.col("size").alias(f"{k}_size"), F.col("digest").alias(f"{k}_digest")) for k in ("u", "v")]
        apart = F.aggregate(F.zip_with("u_digest", "v_digest", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
        # |x & y| >= p |x | y| leaves (1 - p) / (1 + p) of |x| + |y| elements that are in one set alone
        may = apart * (100 + percent) <= (F.col("u_size") + F.col("v_size")) * (100 - percent)
        pairs = scratch.write(pairs.join(ends[0], "u").join(ends[1], "v").where(may).select("u", "v"), "pairs")
        nodes = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct()
        wanted = scratch.write(reps.join(nodes, "node").select(F.col("rep").alias("id"), F.col("node").alias("wanted")), "wanted")
        of_ids = texts.join(wanted, texts["id"].eqNullSafe(wanted["id"])).select("wanted", "text")
        # rows that repeat an id with another text are not the node's; those with the same text are one
        held = of_ids.mapInArrow(sets, "wanted long, node long, found array<long>").where("wanted = node").groupBy("node").agg(F.first("found").alias("found"))
        held = scratch.write(held, "sets")
        a, b = held.select(F.col("node").alias("u"), F.col("found").alias("x")), held.select(F.col("node").alias("v"), F.col("found").alias("y"))
        both = F.size(F.array_intersect("x", "y"))
        near = both * 100 >= (F.size("x") + F.size("y") - both) * percent
        out = scratch.write(pairs.join(a, "u").join(b, "v").where(near).select("u", "v"), name)
        scratch.drop(held, pairs, wanted)
        return out

    lows = buckets.where("node = low").select("token", F.col("size").alias("low_size"), F.col("pos").alias("low_pos"))
    stars = buckets.where("node != low").join(lows, "token").where(fits(F.col("size"), F.col("pos"), F.col("low_size"), F.col("low_pos"), percent))
    edges = verified(stars.select(F.col("node").alias("u"), F.col("low").alias("v")).union(alike).distinct(), "edges")
    classes = connected_components(edges, scratch)
    rooted = scratch.write(buckets.join(classes, "node", "left").select("token", "node", "size", "pos", F.coalesce("root", "node").alias("root")), "rooted")
    scratch.drop(buckets)

    def mixed(rooted: DataFrame) -> DataFrame:
        """The rows of elements that different components still share."""
        shared = rooted.groupBy("token").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count(F.lit(1)).alias("rows")).where("a < b").select("token", "rows")
        return scratch.write(rooted.join(shared, "token").select("token", "node", "size", "pos", "root", "rows"), "mixed")

    def compared(rows: DataFrame, spanning: bool) -> DataFrame:
        found = rows.join(reps.select("node", "digest"), "node").select("token", "node", "size", "pos", "root", "digest", F.lit(True).alias("home"))
        dealt = in_blocks(scratch.write(found, "many"), ["token"], "node", block, scratch)
        return dealt.groupBy("token", "i", "j").applyInArrow(lambda t: may_be_near(t, percent, spanning), "u long, v long")

    left = mixed(rooted)
    few, many = left.where(F.col("rows") <= few_rows), left.where(F.col("rows") > few_rows)
    a, b = few.alias("a"), few.alias("b")
    near = fits(F.col("a.size"), F.col("a.pos"), F.col("b.size"), F.col("b.pos"), percent)
    across = a.join(b, F.col("a.token") == F.col("b.token")).where((F.col("a.node") > F.col("b.node")) & (F.col("a.root") != F.col("b.root")) & near)
    across = across.select(F.col("a.node").alias("u"), F.col("b.node").alias("v"))
    # many rows: first pairs that span what may be joined, then, where some of them weren't similar, all that are left
    edges = edges.union(verified(across.union(compared(many, True)).distinct(), "more"))
    classes = connected_components(edges, scratch)
    again = many.drop("root", "rows").join(classes, "node", "left").withColumn("root", F.coalesce("root", "node"))
    last = mixed(scratch.write(again, "rooted"))
    if not last.isEmpty():
        edges = edges.union(verified(compared(last, False).distinct(), "last"))
        classes = connected_components(edges, scratch)
    whole = scratch.write(reps.join(classes, "node", "left").select("node", "rep", F.coalesce("root", "node").alias("root")), "whole")
    least = scratch.write(whole.groupBy("root").agg(F.min("rep").alias("component")), "least")
    by_node = scratch.write(whole.join(least, "root").select("node", "component"), "by_node")
    return prints.select("id", "node").join(by_node, "node").select("id", "node", "component")
