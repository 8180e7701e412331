"""Near duplicates by BagMinHash (operator 2).

A text's five-word shingles and their counts are a weighted set.  Weights are
discretised at 1, 2, 3, ...; each step of each shingle (a layer) has a Poisson process
of its own whose points fall on the signature's components at random.  A component
keeps its earliest point, so two signatures agree there with the weighted Jaccard
similarity as probability.  Points are made in order of time, and only up to the time
at which all components of the text have one.

Texts with equal multisets are one node.  Bands of the signature are buckets.  Within
a bucket, first each node's most promising bucket-mate is verified by exact multiset
overlap; nodes joined so need no further check.  Then the members outside a bucket's
largest component are compared with all its members, by exact overlap, in blocks that
send a link for each two components they join: no pair of nodes that shares a bucket
stays unverified unless its nodes are in one component already.  Buckets of the same
members are compared once.
Components come from label propagation with pointer jumping.  With 40 bands of 5
a pair at 0.8 is missed with a probability of about 1e-7.

Nulls: a null text has no words.  A text without words is a class of its own; a text of
fewer than five words has one shingle.  A null ``doc_id`` is kept and never names a
class unless all of the class are null; a text that only rows without one have is
linked to its equals alone.  Repeated rows are copies.  Very long texts
are read whole.  An empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import bounded_batches, materialise, release, slices, texts_of
from .shingles import _GOLD, layers, mix

BANDS, ROWS = 40, 5
#: A text of up to so many layers reaches 0.8 with an equal one only; 4 and 5 layers can share 4.
FEWEST = 3
LEAST = 0.8
#: Members of a bucket, and their elements, that are compared in one group.
BLOCK, BLOCK_LAYERS = 2048, 1_000_000
_PLACE = np.uint64(0x5851F42D4C957F2D)


def signatures(found: np.ndarray, counts: np.ndarray, size: int = BANDS * ROWS, spare: float = 4.0) -> np.ndarray:
    """The earliest point of every component, per text (rows), as the point's hash.

    Points up to ``size * (ln(size) + spare) / layers`` are made; a text that then has
    a component without a point (one in e**spare) is done again with a later limit.
    """
    n = len(counts)
    best = np.full(n * size, np.inf)
    sig = np.zeros(n * size, np.uint64)
    limit = size * (np.log(size) + spare) / np.maximum(counts, 1)
    own = np.repeat(np.arange(n), counts)
    state, time, every = found, np.zeros(len(found)), own
    while len(state):
        state = mix(state + _GOLD)
        time = time - np.log(((state >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
        ok = time <= limit[own]
        state, time, own = state[ok], time[ok], own[ok]
        key = own * size + (mix(state ^ _PLACE) % np.uint64(size)).astype(np.int64)
        np.minimum.at(best, key, time)
        won = best[key] == time
        sig[key[won]] = state[won]
    sig = sig.reshape(n, size)
    again = np.isinf(best).reshape(n, size).any(1) & (counts > 0)
    if again.any():
        sig[again] = signatures(found[again[every]], counts[again], size, spare * 2)
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A key for each band of each signature."""
    parts = sig.reshape(len(sig), BANDS, ROWS)
    out = np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLD + np.zeros((len(sig), 1), np.uint64)
    for k in range(ROWS):
        out = mix(out ^ parts[:, :, k]) * _GOLD
    return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _nodes(found: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A hash of each text's whole multiset."""
    ends = np.cumsum(counts)
    total = np.concatenate([[np.uint64(0)], np.cumsum(found, dtype=np.uint64)])
    return mix(total[ends] - total[ends - counts] + counts.astype(np.uint64) * _GOLD)


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, node (a hash of the whole multiset; null without words), layers, bands."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2_000_000):
            found, counts = layers(texts_of(batch, "text"))
            node = _nodes(found, counts)
            many = counts > FEWEST
            bands = band_keys(signatures(found[np.repeat(many, counts)], counts[many]))
            sizes = np.where(many, BANDS, 0)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0).cast(pa.int64()),
                "node": pa.array(node.view(np.int64), pa.int64(), mask=counts == 0),
                "layers": pa.array(counts, pa.int64()),
                "bands": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), _signed(bands.ravel())),
            })

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, node long, layers long, bands array<long>")


def _layers_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, set: the elements of the wanted nodes (columns node, doc_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2_000_000):
            found, counts = layers(texts_of(batch, "text"))
            sets = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), _signed(found))
            # rows of the same doc_id with another text aren't meant
            own = pa.array(_nodes(found, counts).view(np.int64) == batch.column(0).to_numpy())
            yield pa.RecordBatch.from_pydict({"node": batch.column(0), "set": sets}).filter(own)

    rows = docs.select("doc_id", "text").join(wanted, "doc_id").select("node", "text")
    return rows.mapInArrow(run, "node long, set array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose multisets overlap enough."""
    one = sets.select(F.col("node").alias("a"), F.col("set").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("set").alias("y"))
    both = pairs.join(one, "a").join(two, "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(common >= least * (F.size("x") + F.size("y") - common) - 1e-9).select("a", "b")


def components(edges: DataFrame, what: str = "labels") -> DataFrame:
    """node, label: the least node of its component.  ``edges`` (a, b) is read often: materialise it."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), what)
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("m"))
        low = labels.join(near, labels.node == near.a).select("node", F.least("label", "m").alias("label"), (F.col("m") < F.col("label")).alias("fell"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        moved = materialise(low.join(jump, "label").select("node", F.least("label", "next").alias("label"), (F.col("fell") | (F.col("next") < F.col("label"))).alias("fell")), what)
        release(labels)
        labels, still = moved.select("node", "label"), moved.where("fell").isEmpty()
        if still:
            return labels
        labels._written = moved._written


def _links_in_blocks(members: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links (a, b) that join a bucket's components wherever two of their members are similar enough.

    ``members`` has bucket, node, layers, label and top (one of the bucket's components).
    Those outside the top component are compared with all.  A bucket is cut into blocks
    of about ``BLOCK`` members and ``BLOCK_LAYERS`` elements; a group has a block of
    outsiders and a block of all.  It compares whole elements, joins components as it goes
    and sends a link from each joined label to the least one joined with it: fewer links
    than components, however many pairs are close.
    """
    parts = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("layers") / BLOCK_LAYERS)).cast("int")
    rest = F.when(F.col("label") != F.col("top"), F.col("layers"))
    left = F.greatest(F.ceil(F.count(rest) / BLOCK), F.ceil(F.coalesce(F.sum(rest), F.lit(0)) / BLOCK_LAYERS)).cast("int")
    sizes = materialise(members.groupBy("bucket").agg(parts.alias("m"), left.alias("r")), "sizes")
    rows = members.join(sizes, "bucket")
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    outside = F.col("label") != F.col("top")
    # a bucket of one block needs its members once: outsiders are marked in place
    single = rows.where("m = 1").select("bucket", "node", "label", outside.alias("out"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(True).alias("both"))
    # a member is in the block of all of its own for each block of outsiders, and the other way round
    large = rows.where("m > 1")
    everyone = large.select("bucket", "node", "label", F.lit(False).alias("out"), spread("r").alias("i"), own("m").alias("j"), F.lit(False).alias("both"))
    outsiders = large.where(outside).select("bucket", "node", "label", F.lit(True).alias("out"), own("r").alias("i"), spread("m").alias("j"), F.lit(False).alias("both"))
    placed = materialise(single.unionByName(everyone).unionByName(outsiders), "blocks")
    grouped = placed.join(sets, "node").groupBy("bucket", "i", "j")

    def compare(table: pa.Table) -> pa.Table:
        label, out, both = (table.column(c).to_numpy() for c in ("label", "out", "both"))
        lists = table.column("set").combine_chunks()
        flat, ends = lists.flatten().to_numpy(), np.cumsum(np.diff(lists.offsets.to_numpy()))
        size = np.diff(np.concatenate([[0], ends]))
        owner = np.repeat(np.arange(len(label)), size)
        left, right = np.flatnonzero(out), (~out) | both
        pick = right[owner]
        order = np.argsort(flat[pick], kind="stable")
        values, holders = flat[pick][order], owner[pick][order]
        names, at_first, part = np.unique(label, return_index=True, return_inverse=True)  # the component of each member, as they are joined
        apart = len(names)
        for r in left.tolist():
            if apart == 1:
                break
            mine = flat[ends[r] - size[r] : ends[r]]
            lo, hi = np.searchsorted(values, mine, "left"), np.searchsorted(values, mine, "right")
            n = hi - lo
            at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            common = np.bincount(holders[at], minlength=len(label))
            near = np.flatnonzero((common > 0) & (part != part[r]) & (common >= least * (size[r] + size - common) - 1e-9))
            for k in near[np.unique(part[near], return_index=True)[1]].tolist():
                part[part == part[k]] = part[r]
                apart -= 1
        joined, least_of = part[at_first], np.full(len(names), len(names))
        np.minimum.at(least_of, joined, np.arange(len(names)))
        head = names[least_of[joined]]
        return pa.table({"a": pa.array(names, pa.int64()), "b": pa.array(head, pa.int64())}).filter(pa.array(names != head))

    return grouped.applyInArrow(compare, "a long, b long")


def _fewer(links: DataFrame) -> DataFrame:
    """Links (a, b), b below a, with the same components: one for each a, to its least b, and its other b with that one."""
    least = F.min("b").over(Window.partitionBy("a"))
    own = F.col("b") == F.col("least")
    kept = links.distinct().withColumn("least", least).select(F.when(own, F.col("a")).otherwise(F.col("b")).alias("a"), F.col("least").alias("b"))
    return kept.distinct()


def near_duplicates(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class), n_layers, n_copies (of equal multisets) per document."""
    all_docs = materialise(describe(docs), "bags")
    nodes = materialise(all_docs.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("layers").alias("layers"), F.first("bands").alias("bands")), "nodes")
    members = materialise(nodes.select("node", "layers", F.explode("bands").alias("bucket")), "members")
    pivots = members.groupBy("bucket").agg(F.min(F.struct("node", "layers")).alias("pivot"), F.count("*").alias("n")).where("n > 1").select("bucket", "pivot")
    pivots = materialise(pivots, "pivots")
    similar = lambda x, y: F.least(x, y) >= least * F.greatest(x, y) - F.lit(1e-9)
    shared = members.join(pivots, "bucket")
    votes = shared.where((F.col("node") != F.col("pivot.node")) & similar(F.col("layers"), F.col("pivot.layers"))).groupBy("node", F.col("pivot.node").alias("other")).count()
    first = materialise(votes.groupBy("node").agg(F.max(F.struct("count", "other")).alias("m")).select(F.col("node").alias("a"), F.col("m.other").alias("b")), "first")
    names = nodes.select("node", "doc_id").where("doc_id is not null")

    def sets_of(wanted: DataFrame) -> DataFrame:
        return materialise(_layers_of(docs, names.join(wanted, "node")).dropDuplicates(["node"]), "sets")

    met = first.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = sets_of(met)
    edges = materialise(_verified(first, sets, least), "edges")
    release(sets, first)
    # two steps from a node to a pivot it is joined with: enough to leave most members of a bucket out
    onward = edges.select(F.col("a").alias("b"), F.col("b").alias("c"))
    labels = materialise(edges.join(onward, "b", "left").select(F.col("a").alias("node"), F.coalesce("c", "b").alias("label")), "labels")
    # what shares a bucket and is in two components: everyone outside the largest of them against all
    label = F.coalesce("label", "node")
    placed = members.join(pivots.select("bucket"), "bucket", "left_semi").join(labels, "node", "left").select("bucket", "node", "layers", label.alias("label"))
    placed = materialise(placed, "placed")  # the groupings below don't stand on the join, so a hot bucket can be split there
    parts = placed.groupBy("bucket", "label").agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(node))").alias("x"), F.expr("bit_xor(xxhash64(1, node))").alias("y"))
    tops = parts.groupBy("bucket").agg(F.max(F.struct("n", "label")).alias("most"), F.count("*").alias("parts"), F.sum("n").alias("n"), F.expr("bit_xor(x)").alias("x"), F.expr("bit_xor(y)").alias("y"))
    # buckets of the same members are compared once
    tops = tops.where("parts > 1").groupBy("n", "x", "y").agg(F.min(F.struct("bucket", "most.label")).alias("one")).select("one.bucket", F.col("one.label").alias("top"))
    open_buckets = materialise(placed.join(materialise(tops, "tops"), "bucket"), "open")
    if not open_buckets.isEmpty():
        sets = sets_of(open_buckets.select("node").distinct())
        found = materialise(_links_in_blocks(open_buckets, sets, least), "more")
        edges = materialise(edges.union(_fewer(found)), "edges")
        release(sets, found)
    release(placed, open_buckets, members)
    labels = components(edges)
    classes = nodes.select("node", "doc_id", "copies").join(labels, "node", "left").select("node", "doc_id", "copies", label.alias("label"))
    heads = classes.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    of_node = classes.join(heads, "label").select("node", "class_id", "copies")
    out = all_docs.select("doc_id", "node", "layers").join(of_node, "node", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.col("layers").alias("n_layers"), F.coalesce("copies", F.lit(1)).alias("n_copies"))
