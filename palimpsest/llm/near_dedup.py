"""Near-duplicates by bottom-k sketches from one hash function.

Every text is the set of its word shingles, each hashed once to 64 bits; sets are compared as sets of these
hashes, and sets of equal 128-bit digest are one node.  A node keeps its lowest hashes, sorted: the sketch.
Inverted lists of the lowest ``INDEXED`` of them bring nodes with common values together and count their
overlaps; the estimate from the union of two sketches drops pairs that are far below the threshold; exact
Jaccard on the full sets confirms the rest.

A value in at most ``LONG_LIST`` sketches gives all pairs of its list, so a node has a bounded number of
them.  A value in more sketches gives no pairs.  A node with enough other values needs none from there: any
partner above the threshold shares several of the others.  The rest, nodes whose sketches are nearly all
common values, are looked for in the long lists, by full sets in blocks of bounded size:

1. Within each block of the list of a node's lowest common value, exact links are found; then components of
   different blocks are joined by comparing one node of each, in a few rounds.
2. In each of its first ``LONG_VALUES`` long lists, whatever is not in the list's largest component is compared
   with all of the list: any two blocks meet once, but for two of that component, whose nodes need no link of their own.

So a group of a million near copies costs about as many comparisons as it has blocks, not their square, and
no link is lost to a cap.  What can be lost is a pair of sets above ``INDEXED`` elements whose samples mislead:
all but ``LACK`` of its short values differ, none of its ``LONG_VALUES`` lowest common values agree, or its
estimate is ``MARGIN`` standard deviations off.  At a threshold of 0.8 each has a chance below 1e-8 for a pair just
at the threshold, and less above it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import Tables, materialize, table

SKETCH = 64
INDEXED = 24
LONG_LIST = 32
#: Of the indexed values of a set, how many a partner may lack and still be a candidate.
LACK = 18
#: Values of long lists by which a node is looked for there, and set elements and nodes of a block: two full blocks
#: are compared in arrays of all nodes by all nodes.
LONG_VALUES = 12
BLOCK_ELEMENTS = 1 << 18
BLOCK_NODES = 500
#: Rounds in which components of a long list are joined by one node of each.
JOINS = 2
#: Standard deviations that an estimate may lie below the threshold.
MARGIN = 6.0
REMEMBERED = 200_000

_word_hash: dict[bytes, int] = {}


def _hash_word(word: bytes) -> int:
    h = xxhash.xxh3_64_intdigest(word)
    if len(_word_hash) >= REMEMBERED:
        _word_hash.clear()
    _word_hash[word] = h
    return h


def shingle_set(text: str, width: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the shingles of ``text``, as signed integers.

    A-Z are lower-cased and words are runs of anything but ASCII white space; a text of fewer words is one
    shingle, a text without words has none.
    """
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.int64)
    known = _word_hash.get
    h = np.array([known(w) or _hash_word(w) for w in words], np.uint64)
    width = min(width, len(h))
    mixed = np.full(len(h) - width + 1, 0x9E3779B97F4A7C15 ^ width, np.uint64)
    for i in range(width):
        mixed = (mixed ^ h[i : len(h) - width + 1 + i]) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xC2B2AE3D27D4EB4F)
    mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed.view(np.int64))


def _sets(width: int, rows_out: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, n, kept, size = [], [], [], 0
            first = 0

            def out(last: int) -> pa.RecordBatch:
                offsets = np.zeros(len(kept) + 1, np.int32)
                np.cumsum([len(x) for x in kept], out=offsets[1:])
                values = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(kept)))
                return pa.RecordBatch.from_arrays([b.column("doc_id").slice(first, last - first), pa.array(keys, pa.binary()), pa.array(n, pa.int64()), values], ["doc_id", "set_key", "n", "values"])  # noqa: B023

            for k, t in enumerate(b.column("text")):
                s = shingle_set(t.as_py() or "", width)
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                n.append(len(s))
                kept.append(s if rows_out else s[:SKETCH].copy())  # a view would hold the whole set
                size += len(kept[-1])
                if size > 1 << 20:
                    yield out(k + 1)
                    keys, n, kept, size, first = [], [], [], 0, k + 1
            if kept:
                yield out(b.num_rows)

    return run


def _forest(threshold: int):
    """Two blocks of one list: each node with the smallest that it reaches by links at the threshold, within and across."""

    def run(df: pa.Table) -> pa.Table:
        nodes, first = np.unique(df.column("node").to_numpy(), return_index=True)
        sets = df.column("values").combine_chunks()
        offsets, flat = sets.offsets.to_numpy(), sets.values.to_numpy()
        spans = [flat[offsets[i] : offsets[i + 1]] for i in first]
        n = np.array([len(s) for s in spans])
        values, at = np.unique(np.concatenate(spans), return_inverse=True)
        owner = np.repeat(np.arange(len(nodes)), n)
        common = np.bincount(at)[at] > 1  # the others are in no overlap
        _, column = np.unique(at[common], return_inverse=True)
        owner = owner[common]
        wide = int(column.max()) + 1 if len(column) else 0
        overlap = np.zeros((len(nodes), len(nodes)), np.float32)
        for c in range(0, wide, 1024):  # a strip of columns at a time
            here = (column >= c) & (column < c + 1024)
            strip = np.zeros((len(nodes), min(1024, wide - c)), np.float32)
            strip[owner[here], column[here] - c] = 1
            overlap += strip @ strip.T
        linked = np.zeros((len(nodes), len(nodes)), bool)
        parts = [slice(i, i + 256) for i in range(0, len(nodes), 256)]
        for p in parts:
            shared = overlap[p].astype(np.int64)
            linked[p] = 100 * shared >= threshold * (n[p, None] + n[None, :] - shared)
        del overlap
        np.fill_diagonal(linked, True)
        root = np.arange(len(nodes))
        while True:  # each node takes the smallest root among its neighbours', then that one's own
            new = np.concatenate([np.where(linked[p], root, len(nodes)).min(1) for p in parts])
            new = np.minimum(new, new[new])
            if (new == root).all():
                break
            root = new
        moved = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.table({"a": pa.array(nodes[root[moved]], pa.int64()), "b": pa.array(nodes[moved], pa.int64())})

    return run


def connected(links: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) for each node of the links (a, b), by labels and jumps.

    In each round a node takes the smallest label among its neighbours' and its own, then the label of
    that label; rounds end when no label changes.
    """
    with Tables(links.sparkSession) as held:
        both = held.cut(links.union(links.select("b", "a")).toDF("node", "near").distinct(), "both")
        label = held.cut(both.groupBy("node").agg(F.least(F.col("node"), F.min("near")).alias("root")), "label")
        while True:
            met = both.join(label.select(F.col("node").alias("near"), "root"), "near").groupBy("node").agg(F.min("root").alias("seen"))
            new = label.join(met, "node").select("node", F.col("root").alias("old"), F.least("root", "seen").alias("root"))
            jump = label.select(F.col("node").alias("root"), F.col("root").alias("next"))
            new = held.cut(new.join(jump, "root").select("node", "old", F.least("root", "next").alias("root")), "label")
            held.drop(label)
            label = new
            if not new.where("root != old").limit(1).count():
                return materialize(new.select("node", "root"), "components")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs``; linked at ``threshold`` % Jaccard.

    Null texts count as empty; a text without words has no shingles, is linked with nothing and stays.
    Rows with equal sets are in one component.  component_id is the smallest id in the component (null
    only if all its ids are null); kept is whether a row has that id, so repeated rows of it all stay and
    null ids go, unless the row has no words.  A text of any length is one set, in the memory of one task.
    An empty table gives no rows; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {kind}, set_key binary, n long, values array<long>"
    with Tables(docs.sparkSession) as held:
        rows = materialize(source.mapInArrow(_sets(width, False), schema), "rows")
        worded = rows.where("n > 0")
        nodes = worded.groupBy("set_key").agg(F.min("doc_id").alias("least_id"), F.first("n").alias("n"), F.first("values").alias("sketch"))
        nodes = held.cut(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
        label = _labels(held, source, nodes, schema, width, threshold)

        # What a component's smallest id is: nodes without links are components of their own.
        with_root = nodes.select("node", "set_key", "least_id").join(label, "node", "left")
        with_root = with_root.withColumn("root", F.coalesce("root", "node"))
        smallest = with_root.groupBy("root").agg(F.min("least_id").alias("component_id"))
        named = materialize(with_root.join(smallest, "root").select("set_key", "component_id"), "components")
    out = rows.select("doc_id", "n", "set_key").join(named, "set_key", "left")
    of = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    kept = F.when(F.col("n") > 0, F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))).otherwise(F.lit(True))
    return out.select("doc_id", F.col("n").alias("n_shingles"), of.alias("component_id"), kept.alias("kept"))


def _labels(held: Tables, source: DataFrame, nodes: DataFrame, schema: str, width: int, threshold: int) -> DataFrame:
    """node, root of nodes with links: exact ones found by short lists, and those in long lists."""
    t = threshold / 100
    entries = nodes.select("node", "n", F.explode(F.slice("sketch", 1, INDEXED)).alias("v"))
    often = held.cut(entries.groupBy("v").agg(F.count("*").alias("df")).where("df > 1"), "often")
    met = held.cut(entries.join(often, "v"), "met")

    # Values of a node that are in long lists, and whether too few others are left to find its partners by.
    indexed = F.least(F.col("n"), F.lit(INDEXED))
    away = lambda most: F.when(F.col("n") <= INDEXED, F.floor(F.col("n") * (1 - t) / t)).otherwise(F.lit(most))
    long_values = met.where(F.col("df") > LONG_LIST).groupBy("node").agg(F.sort_array(F.collect_list("v")).alias("long_values"), F.first("n").alias("n"))
    common = held.cut(long_values.withColumn("short", indexed - F.size("long_values")).withColumn("mostly", F.col("short") <= away(INDEXED // 2)), "common")

    short = met.where(F.col("df") <= LONG_LIST).join(common.select("node", "short"), "node", "left").select("v", "node", "n", F.coalesce("short", indexed).alias("short"))
    near = (F.col("a.node") < F.col("b.node")) & (100 * F.least("a.n", "b.n") >= threshold * F.greatest("a.n", "b.n"))
    pairs = short.alias("a").join(short.alias("b"), (F.col("a.v") == F.col("b.v")) & near)
    pairs = pairs.select(F.col("a.node").alias("a"), F.col("b.node").alias("b"), F.least("a.short", "b.short").alias("short"), F.least("a.n", "b.n").alias("n"))
    pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("overlap"), F.first("short").alias("short"), F.first("n").alias("n"))
    pairs = pairs.where(F.col("overlap") >= F.col("short") - away(LACK)).select("a", "b")

    sketch = nodes.select("node", "sketch")
    pairs = pairs.join(sketch.toDF("a", "sa"), "a").join(sketch.toDF("b", "sb"), "b")
    pairs = pairs.withColumn("low", F.slice(F.sort_array(F.array_union("sa", "sb")), 1, SKETCH))
    share = F.size(F.array_intersect(F.array_intersect("sa", "sb"), "low")) / F.size("low")
    slack = F.lit(MARGIN * math.sqrt(t * (1 - t))) / F.sqrt(F.size("low"))
    pairs = held.cut(pairs.where(share >= t - slack).select("a", "b"), "candidates")

    # Full sets of the nodes that are in question, and of no others.
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).union(common.where("mostly").select("node")).distinct()
    asked = held.cut(nodes.select("node", "set_key", "least_id").join(asked, "node"), "asked")
    ids = asked.select(F.col("least_id").alias("doc_id")).distinct()
    of_ids = source.join(ids, source["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi")
    full = of_ids.mapInArrow(_sets(width, True), schema).join(asked.select("node", "set_key"), "set_key")
    full = held.cut(full.select("node", "n", "values").dropDuplicates(["node"]), "full")

    both = pairs.join(full.select(F.col("node").alias("a"), F.col("values").alias("va")), "a").join(full.select(F.col("node").alias("b"), F.col("values").alias("vb")), "b")
    shared = F.size(F.array_intersect("va", "vb"))
    exact = both.where(100 * shared >= threshold * (F.size("va") + F.size("vb") - shared)).select("a", "b")
    return _long_labels(held, common.where("mostly"), full, held.cut(exact, "exact"), threshold)


def _blocks(elements: Column, members: Column) -> Column:
    return F.greatest(F.ceil(elements / BLOCK_ELEMENTS), F.ceil(members / BLOCK_NODES), F.lit(1)).cast("int")


def _long_labels(held: Tables, common: DataFrame, full: DataFrame, known: DataFrame, threshold: int) -> DataFrame:
    """node, root by ``known`` links and those that long lists add, so that components are whole."""
    seen = common.select("node", F.posexplode(F.slice("long_values", 1, LONG_VALUES)).alias("place", "v"))
    seen = held.cut(seen.join(full.select("node", "n"), "node"), "seen")
    place = lambda of: F.pmod(F.xxhash64("node"), F.col(of)).cast("int")
    found = lambda member: member.join(full.select("node", "values"), "node").groupBy("v", "s_block", "block").applyInArrow(_forest(threshold), "a long, b long")

    if not seen.limit(1).count():
        return connected(known)

    def rooted(member: DataFrame, label: DataFrame) -> DataFrame:
        return member.join(label, "node", "left").withColumn("root", F.coalesce("root", "node"))

    def blocked(member: DataFrame) -> DataFrame:
        return member.groupBy("v").agg(_blocks(F.sum("n"), F.count("*")).alias("blocks"), F.count("*").alias("members")).where("members > 1")

    def within(member: DataFrame, lists: DataFrame) -> DataFrame:
        return held.cut(found(member.select("v", "node").join(lists, "v").select("v", "node", F.lit(0).alias("s_block"), place("blocks").alias("block"))), "within")

    first = seen.where("place = 0")
    lists = held.cut(blocked(first), "lists")
    known = known.union(within(first, lists))
    label = connected(known)
    wide = lists.where("blocks > 1").select("v")
    for _ in range(JOINS if wide.limit(1).count() else 0):
        one = rooted(first.join(wide, "v", "left_semi"), label).groupBy("v", "root").agg(F.min("node").alias("node"), F.min_by("n", "node").alias("n"))
        one = held.cut(one, "one")
        new = within(one, blocked(one))
        if not new.limit(1).count():
            break
        known = known.union(new)
        label = connected(known)

    at = held.cut(rooted(seen, label), "rooted")
    parts = at.groupBy("v", "root").agg(F.count("*").alias("members"), F.sum("n").alias("elements"))
    largest = F.max(F.struct("members", "elements", "root"))
    lists = parts.groupBy("v").agg(largest.alias("most"), F.sum("members").alias("members"), F.sum("elements").alias("elements")).where("members > most.members")
    rests = _blocks(F.col("elements") - F.col("most.elements"), F.col("members") - F.col("most.members"))
    lists = lists.select("v", F.col("most.root").alias("most"), rests.alias("rests"), _blocks(F.col("most.elements"), F.col("most.members")).alias("mosts"))
    at = at.join(lists, "v")
    # Blocks of the rest are 0 to rests - 1, those of the largest component follow; two blocks meet once.
    each = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    pair = lambda i, j: F.struct(i.alias("s_block"), j.alias("block"))
    mine = place("rests")
    with_rest = F.transform(F.filter(each("rests"), lambda j: j != mine), lambda j: pair(F.least(j, mine), F.greatest(j, mine)))
    with_most = F.transform(each("mosts"), lambda k: pair(mine, F.col("rests") + k))
    of_most = F.transform(each("rests"), lambda j: pair(j, F.col("rests") + place("mosts")))
    meets = F.explode(F.when(F.col("root") != F.col("most"), F.concat(with_rest, with_most)).otherwise(of_most)).alias("meet")
    every = at.select("v", "node", meets).select("v", "node", "meet.s_block", "meet.block")
    new = held.cut(found(every), "others")
    return connected(known.union(new)) if new.limit(1).count() else label


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), width=3, threshold=85)
