"""The trie of conversation prefixes, with totals of its subtrees by centroid decomposition.

A node stands for one distinct sequence of first turns. It is found by a digest of the sequence: the exclusive or of digests of
each turn with its place, a running aggregate that long conversations compute in parts. Its id is (smallest member, depth).

Totals of subtrees come from a centroid decomposition of the edges from node to parent. Each round takes the large components
at once: the centroid is the deepest node below which more than half of the component's weight lies, the component falls apart into
the part above it and one part for each of its children, and the total of what hung below the centroid is added to all nodes on its
path to the component's top. A node's weight is the number of turns of its members from there on, which members tell
without the tree, so a component loses half its weight a round and rounds grow with the logarithm of the corpus. Paths are no
walks: they are the places of any member's own sequence. Components of at most ``LOCAL`` nodes are decomposed inside a task, many
to a task, in one pass over rows sorted by component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatloom.llm import turns
from chatloom.scratch import written

WORD = r"[^\x20\x09-\x0D]+"
#: Conversations share the openings of the one whose id is divisible by ``SHARED``; ``MOST`` turns of it at most, less one.
SHARED, MOST = 20, 4
#: Components of so many nodes at most are decomposed inside a task.
LOCAL = 10_000
#: Turns of a conversation that one window takes, and ids that one text of ids holds.
BLOCK, IDS = 4096, 4096
VALUES = ("leaves", "tokens")


def taken_over(conv: Column) -> Column:
    """How many first turns a conversation takes over."""
    return F.pmod(F.crc32(conv.cast("string")), F.lit(MOST))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """``conv_id, depth, digest, words, length``: every conversation with the shared opening, depths from 1, and at depth 0 the root.

    Conversation ``c`` begins with the first ``taken_over(c)`` turns of ``c - c % SHARED``, as far as there are any, and goes on with its own
    turns from the one after as many. Rows without ``conv_id`` belong to no conversation.
    """
    own = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", turns.digest().alias("digest"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("bigint").alias("words"))
    own = written(turns.placed(own, "turns"), "placed-turns")
    openings = own.where((F.col("conv_id") % SHARED == 0) & (F.col("place") < MOST)).groupBy(F.col("conv_id").alias("base"))
    openings = openings.agg(F.array_sort(F.collect_list(F.struct("place", "digest", "words"))).alias("opening"))  # fewer than MOST rows each
    takes = taken_over(F.col("conv_id"))
    convs = own.groupBy("conv_id").agg(F.max("place").alias("n")).withColumn("base", F.col("conv_id") - F.col("conv_id") % SHARED).join(openings, "base", "left")
    opening = F.slice(F.coalesce("opening", F.array()), F.lit(1), takes.cast("int"))
    convs = convs.select("conv_id", opening.alias("opening"), F.greatest(F.col("n") - takes, F.lit(0)).alias("rest"))
    convs = convs.withColumn("length", (F.size("opening") + F.col("rest")).cast("bigint"))
    root = convs.select("conv_id", F.lit(0).cast("bigint").alias("depth"), F.lit(None).cast("string").alias("digest"), F.lit(0).cast("bigint").alias("words"), "length")
    first = convs.select("conv_id", "length", F.inline("opening")).select("conv_id", F.col("place").alias("depth"), "digest", "words", "length")
    rest = own.where(F.col("place") > takes).join(convs.select("conv_id", F.size("opening").alias("before"), "length"), "conv_id")
    rest = rest.select("conv_id", (F.col("before") + F.col("place") - takes).alias("depth"), "digest", "words", "length")
    return root.union(first).union(rest)


def memberships(rows: DataFrame) -> DataFrame:
    """``rows`` with the digests ``k1, k2`` of the sequence up to each depth and ``p1, p2`` of the one before."""
    own = [F.when(F.col("depth") == 0, F.lit(0).cast("bigint")).otherwise(F.xxhash64(F.lit(seed), "depth", "digest")) for seed in (1, 2)]
    rows = rows.withColumns({"x1": own[0], "x2": own[1], "block": F.floor(F.col("depth") / BLOCK)})
    w = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.where(F.col("length") >= BLOCK).groupBy("conv_id", "block").agg(F.bit_xor("x1").alias("t1"), F.bit_xor("x2").alias("t2"))
    blocks = blocks.select("conv_id", "block", *(F.bit_xor(f"t{i}").over(before).alias(f"c{i}") for i in (1, 2))).where("block > 0")
    rows = rows.withColumns({f"k{i}": F.bit_xor(f"x{i}").over(w) for i in (1, 2)}).join(blocks, ["conv_id", "block"], "left")
    rows = rows.withColumns({f"k{i}": F.col(f"k{i}").bitwiseXOR(F.coalesce(f"c{i}", F.lit(0).cast("bigint"))) for i in (1, 2)})
    return rows.select("conv_id", "depth", "words", "length", "k1", "k2", *(F.col(f"k{i}").bitwiseXOR(F.col(f"x{i}")).alias(f"p{i}") for i in (1, 2)))


def _decomposed(parent: list[int], own: list[list[int]]) -> list[list[int]]:
    """Totals below each node of a forest, itself included; parents come before their children, roots have -1."""
    n = len(parent)
    below: list[list[int]] = [[] for _ in range(n)]
    for v, p in enumerate(parent):
        if p >= 0:
            below[p].append(v)
    gone, total = [False] * n, [[0] * n for _ in own]
    waiting = [v for v in range(n) if parent[v] < 0]
    size = [0] * n
    while waiting:
        top = waiting.pop()
        part = [top]
        for v in part:
            part += [c for c in below[v] if not gone[c]]
        for v in reversed(part):
            size[v] = 1 + sum(size[c] for c in below[v] if not gone[c])
        centre = top
        while heavy := [c for c in below[centre] if not gone[c] and 2 * size[c] > len(part)]:
            centre = heavy[0]
        under = [centre]
        for v in under:
            under += [c for c in below[v] if not gone[c]]
        sums = [sum(values[v] for v in under) for values in own]
        v = centre
        while True:
            for t, s in zip(total, sums, strict=True):
                t[v] += s
            if v == top:
                break
            v = parent[v]
        waiting += [c for c in below[centre] if not gone[c]]
        gone[centre] = True
        if centre != top:
            waiting.append(top)
    return total


def _local(names: list[str]) -> Callable:
    """Decompose the components of a partition that is sorted by component and depth; a component may lie in several batches."""
    def finish(rows: pa.Table) -> pa.RecordBatch:
        cols = {c: rows[c].to_pylist() for c in rows.column_names}
        at = {key: i for i, key in enumerate(zip(cols["conv"], cols["depth"], strict=True))}
        tops = zip(cols["top_conv"], cols["top_depth"], strict=True)
        parent = [-1 if key == top else at[p, key[1] - 1] for key, top, p in zip(at, tops, cols["parent"], strict=True)]
        sums = _decomposed(parent, [cols[f"own_{x}"] for x in names])
        out = [[a + b for a, b in zip(s, cols[f"acc_{x}"], strict=True)] for x, s in zip(names, sums, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (cols["conv"], cols["depth"], *out)], names=["conv", "depth", *names])

    def decompose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            conv, depth = b.column("top_conv"), b.column("top_depth")
            last, cut = (conv[-1], depth[-1]), b.num_rows
            while cut and (conv[cut - 1], depth[cut - 1]) == last:
                cut -= 1
            if held and cut == 0 and (held[-1].column("top_conv")[-1], held[-1].column("top_depth")[-1]) != last:
                yield finish(pa.Table.from_batches(held))
                held = []
            elif cut:
                yield finish(pa.Table.from_batches([*held, b.slice(0, cut)]))
                held = []
            held.append(b.slice(cut))
        if held:
            yield finish(pa.Table.from_batches(held))

    return decompose


def rolled_up(nodes: DataFrame, paths: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """``conv, depth`` and for each name the total over the node's subtree.

    ``nodes``: conv, depth, parent (the conv of the parent), weight and the values ``names``. ``paths``: conv, depth, node, parent: the node that
    a conversation passes at a depth and that node's parent.
    """
    top = ["top_conv", "top_depth"]
    state = ["conv", "depth", "parent", "weight", *top, *(f"own_{x}" for x in names), *(f"acc_{x}" for x in names)]
    zero = F.lit(0).cast("bigint")
    root = nodes.where("depth = 0").select(F.col("conv").alias("top_conv"), F.col("depth").alias("top_depth"))
    first = root.first()
    if first is None:
        return nodes.select("conv", "depth", *names)
    live = nodes.select("conv", "depth", "parent", "weight", *(F.lit(first[t]).cast("bigint").alias(t) for t in top), *(F.col(x).alias(f"own_{x}") for x in names), *(zero.alias(f"acc_{x}") for x in names))
    small, done = [], []
    while True:
        live = written(live.select(*state), "components")
        sizes = live.groupBy(*top).agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("total"))
        large = written(sizes.where(F.col("n") > LOCAL), "large-components")
        small.append(live.join(large.select(*top), top, "left_anti"))
        if large.isEmpty():
            break
        big = live.join(large, top)
        centres = big.where("2 * weight > total").groupBy(*top).agg(F.max_by(F.struct("conv", "depth", "weight"), "depth").alias("c"))
        centres = written(centres.select(*top, F.col("c.conv").alias("c_conv"), F.col("c.depth").alias("c_depth"), F.col("c.weight").alias("c_weight")), "centroids")
        step = live.join(centres, top)
        way = paths.select(F.col("conv").alias("w_conv"), F.col("depth").alias("w_depth"), F.col("node").alias("w_node"), F.col("parent").alias("w_parent"))
        deeper = (F.col("conv") == F.col("w_conv")) & (F.col("c_depth") + 1 == F.col("w_depth")) & (F.col("depth") > F.col("c_depth"))
        step = step.join(way, deeper, "left").withColumn("under", F.coalesce(F.col("w_parent") == F.col("c_conv"), F.lit(False)))
        step = step.withColumn("centre", (F.col("conv") == F.col("c_conv")) & (F.col("depth") == F.col("c_depth")))
        step = written(step.drop("w_conv", "w_depth", "w_parent"), "split-components")
        sums = step.where("under OR centre").groupBy(*top).agg(*(F.sum(f"own_{x}").alias(f"sum_{x}") for x in names))
        added = centres.join(sums, top).join(way, (F.col("c_conv") == F.col("w_conv")) & (F.col("w_depth") >= F.col("top_depth")) & (F.col("w_depth") <= F.col("c_depth")))
        added = added.select(F.col("w_node").alias("conv"), F.col("w_depth").alias("depth"), F.col("c_weight").alias("less"), *(f"sum_{x}" for x in names))
        after = step.join(added, ["conv", "depth"], "left")
        plus = lambda x: F.col(f"acc_{x}") + F.coalesce(f"sum_{x}", zero)
        done.append(after.where("centre").select("conv", "depth", *(plus(x).alias(x) for x in names)))
        live = after.where("NOT centre").select(
            "conv", "depth", "parent", (F.col("weight") - F.coalesce("less", zero)).alias("weight"), F.when(F.col("under"), F.col("w_node")).otherwise(F.col("top_conv")).alias("top_conv"),
            F.when(F.col("under"), F.col("c_depth") + 1).otherwise(F.col("top_depth")).alias("top_depth"), *(f"own_{x}" for x in names), *(plus(x).alias(f"acc_{x}") for x in names),
        )
    rest = small[0]
    for s in small[1:]:
        rest = rest.union(s)
    kept = ["conv", "depth", "parent", *top, *(f"own_{x}" for x in names), *(f"acc_{x}" for x in names)]
    out = rest.select(*kept).repartition(*top).sortWithinPartitions(*top, "depth").mapInArrow(_local(list(names)), "conv bigint, depth bigint, " + ", ".join(f"{x} bigint" for x in names))
    for d in done:
        out = out.union(d)
    return out


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash for each node over its texts of ids in order: a running state, so no node's ids are ever held together."""
    node, state = None, None
    for b in batches:
        out = []
        for conv, depth, ids in zip(*(b.column(c).to_pylist() for c in ("conv", "depth", "ids")), strict=True):
            if (conv, depth) != node:
                if node:
                    out.append((*node, state.hexdigest()))
                node, state = (conv, depth), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield _hash_rows(out)
    if node:
        yield _hash_rows([(*node, state.hexdigest())])


def _hash_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["conv", "depth", "ends_sha256"])


def ends(paths: DataFrame) -> DataFrame:
    """For each node at which conversations end, the hash of their ids in ascending order, joined by commas."""
    bins = paths.where("depth = length").groupBy(F.col("node").alias("conv"), "depth", F.floor(F.col("conv") / IDS).alias("bin"))
    bins = bins.agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda x: x.cast("string")), ",").alias("ids"))  # IDS ids each at most
    return bins.repartition("conv", "depth").sortWithinPartitions("conv", "depth", "bin").select("conv", "depth", "ids").mapInArrow(_hashed, "conv bigint, depth bigint, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations (``rebuilt``), the root included.

    ``conv_id`` smallest member; ``depth``; ``parent_conv_id``, null at the root; ``n_convs``; ``n_children``; ``n_leaves``, nodes without children below
    it, itself included; ``saved_tokens``, over its subtree the words of each node's last text times its members less one; ``ends_sha256``.
    Null roles and texts count as empty; turns are ordered by ``turn``, null first, then by a digest of role and text, so repeated rows are
    turns of their own; a conversation without turns left ends at the root; rows without ``conv_id`` are ignored; other columns are
    ignored; without conversations there is no node.
    """
    members = written(memberships(rebuilt(conversations)), "members")
    key = ["depth", "k1", "k2"]
    nodes = members.groupBy(*key).agg(
        F.min("conv_id").alias("conv"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"), F.sum(F.col("length") - F.col("depth") + 1).alias("weight"), F.first("p1").alias("p1"), F.first("p2").alias("p2"),
    )
    nodes = written(nodes, "nodes")
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv").alias("parent"))
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(above, ["depth", "p1", "p2"], "left").join(children, key, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("bigint")))
    nodes = written(nodes.withColumns({"leaves": (F.col("n_children") == 0).cast("bigint"), "tokens": (F.col("n_convs") - 1) * F.col("words")}).drop("p1", "p2"), "trie")
    paths = members.join(nodes.select(*key, F.col("conv").alias("node"), "parent"), key).select(F.col("conv_id").alias("conv"), "depth", "length", "node", "parent")
    paths = written(paths, "paths")
    totals = rolled_up(nodes, paths, VALUES)
    out = nodes.join(totals.withColumnsRenamed({x: f"sum_{x}" for x in VALUES}), ["conv", "depth"]).join(ends(paths), ["conv", "depth"], "left")
    return out.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", F.col("sum_leaves").alias("n_leaves"), F.col("sum_tokens").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
