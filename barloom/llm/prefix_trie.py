"""Prefix trie of conversations, built from sorted neighbours.

A node is a distinct sequence of first turns. Distinct sequences are sorted (one
range exchange of digests; texts never move), so a node is a run of neighbours. A
block of neighbours is folded by union-find over the edges between them, in
descending length of the common prefix: each merge makes a branching node, chains
of single children hang between.

Only prefixes of a block's first and last sequence can go on in another block. These
two chains are what a block's forest is contracted to; a key of the prefix merges
them across boundaries, all other nodes are finished in their block. What merged
nodes add to the nodes above them is summed along one chain each, so work and memory
grow with blocks x depth, never with its square.

Equal conversations are one sequence. Their ids, in order, are packed by ranges of
ID_BLOCK ids before they meet, and digested as a stream.

Rows with a null conv_id belong to no conversation and are left out; null roles and
texts are empty. Turns are in order of turn, null first, ties in order of a digest
of role and text; repeated rows are turns of their own. A conversation is held as
24 bytes a turn by one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.sources.scratch import cut

#: Ids of equal conversations that travel as one row at most; a power of two.
ID_BLOCK = 4096
#: Turns of a block of sorted sequences.
BLOCK_TURNS = 200_000
DIGEST = 16
NO_ENDS = hashlib.sha256(b"").hexdigest()

_NODE = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, "
         "block long, chain int, key binary, parent_key binary, bytes long, kids long")
_KINDS = [pa.int64()] * 7 + [pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
_NAMES = [part.split()[0] for part in _NODE.split(", ")]


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns: array of (digest, bytes)) in order."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)), 1, DIGEST)
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
                                                                 digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes")).alias("t"))
    return rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(t["digest"], t["bytes"])).alias("turns"))


def rebuilt(convs: DataFrame, every: int = 5, longest: int = 9) -> DataFrame:
    """Each conversation c with the first h turns of conversation c - c % every in place of its own, h = crc32(c) % longest."""
    own = convs.select("conv_id", "turns", (F.col("conv_id") - F.col("conv_id") % every).alias("base"),
                       (F.crc32(F.col("conv_id").cast("string").cast("binary")) % longest).cast("int").alias("h"))
    base = convs.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.col("turns").alias("first"))
    rest = F.when(F.size("turns") > F.col("h"), F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))).otherwise(F.slice("turns", 1, 0))
    head = F.coalesce(F.slice("first", 1, F.col("h")), F.slice("turns", 1, 0))
    return own.join(base, "base", "left").select("conv_id", F.concat(head, rest).alias("turns"))


def sequences(convs: DataFrame) -> DataFrame:
    """(path, id_block, ids, n, first, bytes): equal conversations by ranges of their ids; path is the row of digests."""
    path = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), ""))
    rows = convs.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["bytes"]).alias("bytes"), F.shiftright("conv_id", ID_BLOCK.bit_length() - 1).alias("id_block"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda i: i.cast("string")), ",")
    return rows.groupBy("path", "id_block").agg(ids.alias("ids"), F.count("*").alias("n"), F.min("conv_id").alias("first"), F.any_value("bytes").alias("bytes"))


def _common(a: bytes, b: bytes) -> int:
    """Turns that two paths begin with."""
    lo, hi = 0, min(len(a), len(b)) // DIGEST
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[:mid * DIGEST] == b[:mid * DIGEST]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def _keys(path: bytes) -> list[bytes]:
    """Key of every prefix of a path, the empty one included."""
    state, keys = hashlib.blake2b(digest_size=DIGEST), []
    for d in range(len(path) // DIGEST + 1):
        state.update(path[(d - 1) * DIGEST:d * DIGEST] if d else b"")
        keys.append(state.digest())
    return keys


class _Tree:
    """A component: its top node's depth and the sums of its subtree."""

    __slots__ = ("depth", "seq", "n", "first", "leaves", "saved", "kids", "ends")

    def __init__(self, depth, seq, n, first, ends, kids=0):
        self.depth, self.seq, self.n, self.first, self.ends = depth, seq, n, first, ends
        self.leaves, self.saved, self.kids = 0, 0, kids


def fold(block: int, paths: list[bytes], counts: list[int], firsts: list[int], ends: list[str], sizes: list[list[int]]) -> Iterator[tuple]:
    """Rows of all nodes of sorted, distinct sequences; a key marks prefixes of the first and the last one."""
    last = len(paths) - 1
    lcp = [_common(a, b) for a, b in zip(paths, paths[1:])]
    to_first, to_last = [len(paths[0]) // DIGEST], [len(paths[last]) // DIGEST]
    for x in lcp:
        to_first.append(min(to_first[-1], x))
    for x in reversed(lcp):
        to_last.append(min(to_last[-1], x))
    to_last.reverse()
    keys = {0: _keys(paths[0]), last: _keys(paths[last])}
    shared = to_first[last]

    parent = list(range(len(paths)))
    tree = [_Tree(len(p) // DIGEST, i, n, f, e) for i, (p, n, f, e) in enumerate(zip(paths, counts, firsts, ends))]
    rows: list[tuple] = []

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def open_at(t: _Tree, depth: int) -> bool:
        return depth <= max(to_first[t.seq], to_last[t.seq])

    def row(t: _Tree, depth: int, above: int | None) -> tuple:
        """Node of t's chain at this depth; sums of t hold all that lies below."""
        if open_at(t, depth):
            chain = 0 if depth <= to_first[t.seq] else 1
            own = keys[0 if chain == 0 else last]
            return (t.first, depth, None, t.n, None, t.leaves, t.saved, t.ends, block, chain, own[depth], own[depth - 1] if depth else None, sizes[t.seq][depth - 1] if depth else 0, t.kids)
        leaf = t.kids == 0
        t.leaves += leaf
        t.saved += (t.n - 1) * sizes[t.seq][depth - 1]
        up = open_at(t, depth - 1)
        chain = 0 if up and depth - 1 <= to_first[t.seq] else 1
        return (t.first, depth, None if up else above, t.n, t.kids, t.leaves, t.saved, t.ends, block if up else None, None, None,
                keys[0 if chain == 0 else last][depth - 1] if up else None, None, None)

    def climb(t: _Tree, depth: int, first_above: int) -> None:
        """Finish the nodes of t's chain from its top down to just below `depth`; first_above is the smallest member there."""
        for d in range(t.depth, depth, -1):
            was_open = open_at(t, d)
            rows.append(row(t, d, t.first if d - 1 > depth else first_above))
            t.kids, t.ends = (0 if was_open else 1), NO_ENDS
        t.depth = depth

    edges = sorted(range(last), key=lambda i: -lcp[i])
    at = 0
    while at < len(edges):
        depth, group = lcp[edges[at]], []
        while at < len(edges) and lcp[edges[at]] == depth:
            group.append(edges[at])
            at += 1
        # All edges of one depth at once: components that meet become children of one node.
        before: dict[int, list[int]] = {}
        for i in sorted(group):
            a, b = find(i), find(i + 1)
            mine = before.pop(a, [a])
            parent[b] = a
            before[a] = mine + before.pop(b, [b])
        for root, members in before.items():
            parts = [tree[m] for m in members]
            first = min(t.first for t in parts)
            node = _Tree(depth, parts[0].seq, sum(t.n for t in parts), first, NO_ENDS)
            for t in parts:
                if t.depth == depth:
                    node.ends, node.kids = t.ends, node.kids + t.kids
                else:
                    climb(t, depth, first)
                    node.kids += t.kids
                node.leaves += t.leaves
                node.saved += t.saved
            tree[root] = node
    for root in {find(i) for i in range(len(paths))}:
        t = tree[root]
        climb(t, -1, t.first)
    yield from rows
    # The last sequence's chain again where it is shared with the first one's: no sums, only its place.
    if last:
        for d in range(shared + 1):
            yield (firsts[last], d, None, 0, None, 0, 0, NO_ENDS, block, 1, keys[last][d], keys[last][d - 1] if d else None, sizes[last][d - 1] if d else 0, 0)


def _forests(seqs: DataFrame, block_turns: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, turns, held = None, 0, ([], [], [], [], [])
        path, digest, n, first, sizes, size_of = None, None, 0, None, None, 0

        def out():
            found = list(fold(block, *held))
            for i in range(0, len(found), 10000):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found[i:i + 10000]), _KINDS)], names=_NAMES)

        def close():
            for column, value in zip(held, (path, n, first, digest.hexdigest(), sizes)):
                column.append(value)

        for batch in batches:
            for p, ids, m, low, lengths in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if p == path:
                    digest.update(b"," + ids.encode())
                    n, first = n + m, min(first, low)
                    continue
                if path is not None:
                    close()
                    turns += len(sizes) + 1
                    if turns >= block_turns:
                        yield from out()
                        block, turns, held = None, 0, ([], [], [], [], [])
                path, digest, n, first, sizes = p, hashlib.sha256(ids.encode()), m, low, lengths
                if block is None:
                    block = int.from_bytes(hashlib.blake2b(p, digest_size=8).digest(), "big", signed=True)
        if path is not None:
            close()
            yield from out()

    ordered = seqs.repartitionByRange("path").sortWithinPartitions("path", "id_block")
    return ordered.select("path", "ids", "n", "first", "bytes").mapInArrow(run, _NODE)


def trie(turns: DataFrame, rebuild=rebuilt, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """All nodes; columns conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    convs = conversations(turns)
    seqs = cut(sequences(rebuild(convs) if rebuild else convs), "sequences")
    nodes = cut(_forests(seqs, block_turns), "forests")
    chains = nodes.where("chain IS NOT NULL")

    place = F.struct("block", "chain")
    merged = chains.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent_key").alias("parent_key"), F.max("bytes").alias("bytes"), F.sum("n_convs").alias("n_convs"),
        F.sum("kids").alias("kids"), F.max(F.when(F.col("ends_sha256") != NO_ENDS, F.col("ends_sha256"))).alias("ends"), F.min(place).alias("home"))
    open_kids = merged.where("parent_key IS NOT NULL").groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("open_kids"))
    merged = cut(merged.join(open_kids, "key", "left").withColumn("n_children", F.col("kids") + F.coalesce("open_kids", F.lit(0))).drop("kids", "open_kids"), "merged")

    # Own sums of a merged node count once, on its home chain, for all nodes above it there.
    own = merged.select("key", "home", (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("own"))
    placed = chains.select("key", "block", "chain", "depth", "n_leaves", "saved_tokens").join(own, "key")
    at_home = lambda c: F.when(F.col("home") == place, F.col(c)).otherwise(0)
    down = Window.partitionBy("block", "chain").orderBy(F.desc("depth"))
    placed = placed.withColumn("leaves", F.col("n_leaves") + F.sum(at_home("leaf")).over(down)).withColumn("saved", F.col("saved_tokens") + F.sum(at_home("own")).over(down))
    sums = placed.groupBy("key").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    tops = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    above = merged.join(sums, "key").join(tops, "parent_key", "left").withColumn("ends_sha256", F.coalesce("ends", F.lit(NO_ENDS)))

    # Finished nodes below a merged one look it up through their own block.
    asked = chains.select("block", F.col("key").alias("parent_key")).distinct().join(tops, "parent_key")
    finished = nodes.where("chain IS NULL")
    below = finished.where("parent_key IS NOT NULL").drop("parent_conv_id").join(asked, ["block", "parent_key"])
    columns = _NAMES[:8]
    return finished.where("parent_key IS NULL").select(*columns).unionByName(below.select(*columns)).unionByName(above.select(*columns))
