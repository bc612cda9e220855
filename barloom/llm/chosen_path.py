"""Near-duplicate join on word shingles by chosen paths.

Documents with equal shingle sets are one set with a number of copies. Sets are
embedded by min-hashing. A run starts at a root node that holds all sets; a node
samples `CHILDREN` coordinates and each set moves to the child for its token
(min-hash value) at such a coordinate, so two sets move together with the
probability of their similarity at each coordinate. Nodes of at most `LIMIT`
sets are compared by brute force; larger ones are split again. With two
coordinates per node a pair of similarity s survives any number of levels with
probability q, the positive solution of q = 1 - (1 - s q)^2, and runs are
repeated until 1 - (1 - q)^runs reaches the target recall.

A large node whose sets agree at most of a sample of coordinates is (nearly) one
cluster of near copies; splitting it would only multiply its rows. It is not
split but compared whole, as are nodes still large after `MAX_LEVELS` levels.
Dense nodes that share core members are one cluster. A cluster is cut into
blocks, each pair of blocks is one group, and a group returns one row per set:
how many documents it is linked to and a spanning edge, never pairs.

Pairs from small nodes are checked in two steps: agreement of the embeddings far
under the threshold rejects, then the exact Jaccard similarity of the shingle
sets decides. Links join into classes by minimum labels with pointer jumping.

Defined cases: null texts and texts without words have no shingles, no links, and
are each a class of their own. Texts of fewer than five words have one shingle.
Repeated rows are copies. Rows with a null id take part; the class id is the
smallest id that is not null. Rows that share an id but not the text are judged
together: the class of an id is the smallest one. Other columns are not read.
"""

from __future__ import annotations

import math
import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import append_columns
from barloom.sources.scratch import cut

WORD = re.compile(r"\w+")
SHINGLE = 5
#: Jaccard similarity as a fraction, so that the threshold is exact.
NUM, DEN = 4, 5
COORDINATES = 64
#: Coordinates kept whole: those that the roots of the runs sample, different ones for each run.
ROOT_TOKENS = 16
CHILDREN = 2
LIMIT = 16
MAX_LEVELS = 8
#: Share of agreeing tokens in a sample of coordinates from which a large node counts as one cluster.
DENSE = 0.5
DENSE_SAMPLE = 4
#: Sets of a cluster per block; a group compares two blocks.
BLOCK = 512
TARGET_RECALL = 0.9999
#: Coordinates (of 64, four bits each) that must agree: a pair at the threshold agrees at 52 on average, standard deviation 3.1;
#: it has fewer than this with a probability of 1e-6, a hundredth of the misses that TARGET_RECALL allows.
LEAST_AGREEMENT = 36
#: Eight bytes hold the low four bits of 16 tokens.
WORDS_OF_BITS = ["b0", "b1", "b2", "b3"]
KEPT_WORDS = 200_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def runs_for(target: float, similarity: float = NUM / DEN) -> int:
    """Runs until the target recall for pairs at the threshold."""
    survive = (2 * similarity - 1) / similarity**2
    return max(1, math.ceil(math.log(1 - target) / math.log(1 - survive)))


def _coordinates() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240101)
    draw = rng.integers(0, 2**64, (2, COORDINATES, 1), dtype=np.uint64)
    return draw[0], draw[1] | np.uint64(1)


XOR, ODD = _coordinates()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_WORD_HASHES: dict[str, int] = {}


def _word_hash(word: str) -> int:
    if len(_WORD_HASHES) >= KEPT_WORDS:
        _WORD_HASHES.clear()
    h = _WORD_HASHES[word] = xxhash.xxh3_64_intdigest(word)
    return h


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of five words; of fewer words, of all of them."""
    words = WORD.findall((text or "").lower())
    if not words:
        return np.zeros(0, np.uint64)
    get = _WORD_HASHES.get
    h = np.fromiter(((get(w) or _word_hash(w)) for w in words), np.uint64, len(words))
    size = min(SHINGLE, len(h))
    n = len(h) - size + 1
    total = np.full(n, size, np.uint64)
    for k in range(size):
        total = _mixed(total * MULTIPLIER + h[k:k + n])
    return np.unique(total)


def embedding(s: np.ndarray) -> np.ndarray:
    """Upper halves of the smallest hashes per coordinate."""
    low = np.full(COORDINATES, 2**64 - 1, np.uint64)
    for start in range(0, len(s), 4096):
        low = np.minimum(low, ((s[start:start + 4096][None, :] ^ XOR) * ODD).min(axis=1))
    return (low >> np.uint64(32)).astype(np.uint32).view(np.int32)


def packed(tokens: np.ndarray) -> list[int]:
    """The low four bits of all tokens in four 64-bit numbers."""
    low = (tokens.view(np.uint32) & 15).astype(np.uint64).reshape(4, 16)
    return (low << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=1, dtype=np.uint64).view(np.int64).tolist()


def _described(texts: list) -> list[list]:
    rows = []
    for t in texts:
        s = shingles(t)
        if not len(s):
            rows.append((None, 0, None, None, None, None, None))
            continue
        tokens = embedding(s)
        rows.append((xxhash.xxh3_128_digest(s.tobytes()), len(s), tokens[:ROOT_TOKENS], *packed(tokens)))
    return [list(c) for c in zip(*rows)]


def described(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, key (of the shingle set; null without shingles), n, tokens, b0..b3."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text_"))
    fields = [T.StructField("key", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("tokens", T.ArrayType(T.IntegerType()))]
    fields += [T.StructField(b, T.LongType()) for b in WORDS_OF_BITS]
    return append_columns(slim, _described, "text_", fields).drop("text_")


def token_bits(at):
    """Four bits of the token at a coordinate given as a column."""
    word = F.element_at(F.array(*WORDS_OF_BITS), (F.floor(at / 16) + 1).cast("int"))
    return F.call_function("shiftrightunsigned", word, (at % 16 * 4).cast("int")).bitwiseAND(F.lit(15).cast("long"))


def met(one: DataFrame, two: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """Join of two tables that both grow with the documents: sorted and merged, as a copy of one for every
    executor would first be gathered and hashed in the driver, and a copy for each such join stays there for a while."""
    return one.join(two.hint("merge"), on, how)


def _coordinate(node, salt: int):
    return F.pmod(F.xxhash64(node, F.lit(salt)), F.lit(COORDINATES))


def nodes(sets: DataFrame, target: float) -> tuple[DataFrame, DataFrame]:
    """(rows of small nodes, rows of dense or finally large nodes): node, key, n, b0..b3; of the second also core.

    The tokens at the roots of all runs are whole; further down four bits of a token split a node.
    """
    bits = ["key", "n", *WORDS_OF_BITS]
    starts = runs_for(target) * CHILDREN
    if starts > ROOT_TOKENS:
        raise ValueError("more runs than whole tokens")
    roots = [F.xxhash64(F.lit(i), F.get("tokens", F.lit(i))) for i in range(starts)]
    level = sets.select(*bits, F.explode(F.array(*roots)).alias("node"))
    small, dense, depth = None, None, 1
    while True:
        level = cut(level, f"paths-{depth}")
        counts = level.groupBy("node").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > 1)
        sized = cut(met(level, counts, "node"), f"nodes-{depth}")
        few = sized.where(F.col("c") <= LIMIT).drop("c")
        small = few if small is None else small.unionByName(few)
        large = sized.where(F.col("c") > LIMIT)
        if large.isEmpty():
            return small, dense
        rated = cut(_rated(large), f"rated-{depth}")
        last = depth == MAX_LEVELS
        whole = rated if last else rated.where(F.col("density") >= DENSE)
        whole = whole.select("node", *bits, (F.col("own") >= DENSE).alias("core"))
        dense = whole if dense is None else dense.unionByName(whole)
        if last:
            return small, dense
        at = [_coordinate(F.col("node"), salt) for salt in range(CHILDREN)]
        down = F.array_distinct(F.array(*[F.xxhash64("node", a, token_bits(a)) for a in at]))
        level = rated.where(F.col("density") < DENSE).select(*bits, F.explode(down).alias("node"))
        depth += 1


def _rated(large: DataFrame) -> DataFrame:
    """Rows with own (share of the node that has the set's token, mean over sampled coordinates) and density (its mean over the node).

    A token has four bits here, so the counts of a node are a short histogram: partial
    sums, no row per token. They come back to the rows by a join.
    """
    picked = [f"t{k}" for k in range(DENSE_SAMPLE)]
    rows = large.withColumns({t: token_bits(_coordinate(F.col("node"), 100 + k)) for k, t in enumerate(picked)})
    cells = [F.count_if(F.col(t) == v) for t in picked for v in range(16)]
    shares = rows.groupBy("node").agg(F.transform(F.array(*cells), lambda m: m / F.count(F.lit(1))).alias("shares"))
    square = F.aggregate("shares", F.lit(0.0), lambda s, x: s + x * x) / DENSE_SAMPLE
    rows = met(rows, shares.select("node", "shares", square.alias("density")), "node")
    own = F.lit(0.0)
    for k, t in enumerate(picked):
        own = own + F.get("shares", (F.lit(16 * k) + F.col(t)).cast("int"))
    return rows.withColumn("own", own / DENSE_SAMPLE).drop(*picked, "shares", "c")


def clusters(dense: DataFrame) -> DataFrame:
    """cluster, key: dense nodes that share core members are one cluster; all their sets belong to it."""
    spine = dense.where("core").groupBy("key").agg(F.min("node").alias("first"))
    links = met(dense.where("core"), spine, "key").where(F.col("node") != F.col("first")).select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    roots = components(links).withColumnsRenamed({"key": "node", "root": "cluster"})
    return cut(met(dense, roots, "node", "left").select(F.coalesce("cluster", "node").alias("cluster"), "key").distinct(), "clusters")


def candidates(small: DataFrame) -> DataFrame:
    """Distinct pairs a < b of keys in small nodes whose sizes and embeddings allow the similarity."""
    one = small.select("node", F.col("key").alias("a"), F.col("n").alias("na"), *[F.col(b).alias(f"{b}_a") for b in WORDS_OF_BITS])
    two = small.select("node", F.col("key").alias("b"), F.col("n").alias("nb"), *[F.col(b).alias(f"{b}_b") for b in WORDS_OF_BITS])
    fits = (F.col("a") < F.col("b")) & (DEN * F.least("na", "nb") >= NUM * F.greatest("na", "nb"))
    pairs = met(one, two, "node").where(fits & (agreement() >= LEAST_AGREEMENT)).select("a", "b")
    return cut(pairs.distinct(), "candidates")


def agreement():
    """Coordinates whose four bits are equal, from b*_a and b*_b: a group of four bits of the XOR is zero."""
    total = F.lit(COORDINATES)
    ones = F.lit(0x1111111111111111).cast("long")
    for b in WORDS_OF_BITS:
        x = F.col(f"{b}_a").bitwiseXOR(F.col(f"{b}_b"))
        x = x.bitwiseOR(F.shiftright(x, 1))
        x = x.bitwiseOR(F.shiftright(x, 2))
        total = total - F.bit_count(x.bitwiseAND(ones))
    return total


def shingle_sets(docs: DataFrame, keys: DataFrame, sets: DataFrame, doc_id: str, text: str) -> DataFrame:
    """key, s (sorted hashes) of the keys asked for, from the text of one document each."""
    ids = cut(met(sets, keys, "key", "left_semi").select(F.col("low").alias("id_")).distinct(), "needed-ids")
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text_"))
    texts = texts.join(ids, texts["doc_id"].eqNullSafe(ids["id_"]), "left_semi").select("text_")
    whole = append_columns(texts, _sets, "text_", [T.StructField("key", T.BinaryType()), T.StructField("s", T.ArrayType(T.LongType()))])
    return cut(whole.select("key", "s").where(F.col("key").isNotNull()), "needed-sets")


def _sets(texts: list) -> list[list]:
    found = [shingles(t) for t in texts]
    return [[xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in found], [s.view(np.int64) for s in found]]


def checked(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """The pairs whose sets have a Jaccard similarity of the threshold or more."""
    both = met(pairs, whole.select(F.col("key").alias("a"), F.col("s").alias("sa")), "a")
    both = met(both, whole.select(F.col("key").alias("b"), F.col("s").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    both = both.select("a", "b", common.alias("common"), (F.size("sa") + F.size("sb")).alias("total"))
    return both.where(DEN * F.col("common") >= NUM * (F.col("total") - F.col("common"))).select("a", "b").distinct()


def block_links(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Matrix of links between sets (rows) and sets (columns); right None: of the left sets among themselves.

    Only shingles that occur twice count in an intersection; they are multiplied in slices of columns.
    """
    every = left + (right or [])
    owner = np.repeat(np.arange(len(every)), [len(s) for s in every])
    _, ids, counts = np.unique(np.concatenate(every), return_inverse=True, return_counts=True)
    shared = counts[ids] > 1
    owner, ids = owner[shared], np.unique(ids[shared], return_inverse=True)[1]
    order = np.argsort(ids, kind="stable")
    owner, ids = owner[order], ids[order]
    n, k = len(left), 0 if right is None else len(left)
    common = np.zeros((n, len(every) - k), np.float32)
    width = 4096
    for start in range(0, int(ids[-1]) + 1 if len(ids) else 0, width):
        lo, hi = np.searchsorted(ids, [start, start + width])
        part = np.zeros((len(every), width), np.float32)
        part[owner[lo:hi], ids[lo:hi] - start] = 1
        common += part[:n] @ part[k:].T
    sizes = np.array([len(s) for s in every], np.float64)
    found = DEN * common >= NUM * (sizes[:n, None] + sizes[None, k:] - common)
    if right is None:
        np.fill_diagonal(found, False)
    return found


def _compare(frame):
    """One group: two blocks of a cluster (or one with itself). A row per set: documents linked, a set of its component."""
    import pandas as pd

    frame = frame.sort_values("key", kind="stable").reset_index(drop=True)
    mine = frame["cluster"].iloc[0]
    own = frame["own"].to_numpy()
    low, high = frame["low"].iloc[0], frame["high"].iloc[0]
    at = np.flatnonzero(own == low), np.flatnonzero(own == high)
    sets = [np.asarray(s, np.int64) for s in frame["s"]]
    copies = frame["copies"].to_numpy(np.int64)
    found = np.zeros((len(frame), len(frame)), bool)
    if low == high:
        found[:] = block_links(sets, None)
    elif len(at[0]) and len(at[1]):
        links = block_links([sets[i] for i in at[0]], [sets[i] for i in at[1]])
        found[np.ix_(at[0], at[1])] = links
        found |= found.T
    # A pair that shares several clusters counts in the first one.
    several = [i for i, c in enumerate(frame["all_clusters"]) if len(c) > 1]
    for i in several:
        for j in several:
            if found[i, j] and min(set(frame["all_clusters"][i]) & set(frame["all_clusters"][j])) != mine:
                found[i, j] = False
    label = np.arange(len(frame))
    while True:
        near = np.where(found, label[None, :], len(frame)).min(axis=1, initial=len(frame))
        moved = np.minimum(label, near)
        moved = moved[moved]
        if (moved == label).all():
            break
        label = moved
    return pd.DataFrame({"key": frame["key"], "others": (found * copies[None, :]).sum(axis=1), "to": frame["key"].to_numpy()[label]})


def cluster_links(members: DataFrame, whole: DataFrame, sets: DataFrame) -> DataFrame:
    """key, others (documents linked, from one group), to (a set of the same component). members: cluster, key."""
    lists = members.groupBy("key").agg(F.collect_set("cluster").alias("all_clusters"))
    blocks = members.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    rows = met(members, blocks, "cluster").withColumn("own", F.pmod(F.xxhash64("key", "cluster"), F.col("blocks")).cast("int"))
    rows = rows.select("cluster", "key", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("cluster", "key", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    rows = met(met(rows, lists, "key"), sets.select("key", "copies"), "key")
    rows = met(rows, met(whole, lists.select("key"), "key", "left_semi").dropDuplicates(["key"]), "key")
    return rows.groupBy("cluster", "low", "high").applyInPandas(_compare, "key binary, others long, to binary")


def components(edges: DataFrame) -> DataFrame:
    """key, root: the smallest key of the component of every key that has an edge.

    Labels go to the smallest label around and then to the label of their label,
    until none changes; each round is written, so a lost executor repeats one round.
    """
    both = cut(edges.select(F.col("a").alias("key"), F.col("b").alias("to")).unionByName(edges.select(F.col("b").alias("key"), F.col("a").alias("to"))), "edges")
    labels = cut(both.groupBy("key").agg(F.least(F.col("key"), F.min("to")).alias("root")), "labels-0")
    step = 0
    while True:
        step += 1
        around = met(both, labels.select(F.col("key").alias("to"), F.col("root").alias("near")), "to").groupBy("key").agg(F.min("near").alias("near"))
        moved = met(labels, around, "key").select("key", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = labels.select(F.col("key").alias("root"), F.col("root").alias("far"))
        moved = cut(met(moved, jump, "root", "left").select("key", "old", F.coalesce(F.least("far", "root"), "root").alias("root")), f"labels-{step}")
        labels = moved.select("key", "root")
        if moved.where(F.col("old") != F.col("root")).isEmpty():
            return labels


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", target: float = TARGET_RECALL) -> DataFrame:
    """Per row of docs: doc_id, class_id (smallest id of the class), n_links (documents at the threshold or above).

    Links of copies are counted from the number of copies, not written out.
    """
    found = cut(described(docs, doc_id, text), "sets")
    sets = found.where(F.col("key").isNotNull()).groupBy("key").agg(
        F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("low"), F.first("n").alias("n"), F.first("tokens").alias("tokens"), *[F.first(b).alias(b) for b in WORDS_OF_BITS])
    sets = cut(sets, "distinct-sets")
    small, dense = nodes(sets, target)
    pairs = candidates(small)
    keys = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key")))
    if dense is not None:
        members = clusters(dense)
        keys = keys.unionByName(members.select("key"))
        lists = members.groupBy("key").agg(F.collect_set("cluster").alias("cs"))
        # Pairs of one cluster are counted there.
        pairs = met(pairs, lists.select(F.col("key").alias("a"), F.col("cs").alias("ca")), "a", "left")
        pairs = met(pairs, lists.select(F.col("key").alias("b"), F.col("cs").alias("cb")), "b", "left") \
            .where(~F.coalesce(F.arrays_overlap("ca", "cb"), F.lit(False))).select("a", "b")
    whole = shingle_sets(docs, keys.distinct(), sets, doc_id, text)
    edges = cut(checked(pairs, whole), "links")
    copies = sets.select("key", "copies", "low")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counted = met(both, copies.select(F.col("key").alias("b"), "copies"), "b").select(F.col("a").alias("key"), F.col("copies").alias("others"))
    if dense is not None:
        grouped = cut(cluster_links(members, whole, sets), "cluster-links")
        counted = counted.unionByName(grouped.select("key", "others"))
        edges = edges.unionByName(grouped.where(F.col("key") != F.col("to")).select(F.col("key").alias("a"), F.col("to").alias("b")).distinct())
    roots = components(edges)
    linked = counted.groupBy("key").agg(F.sum("others").alias("others"))
    classes = met(roots, copies, "key").groupBy("root").agg(F.min("low").alias("class_low"))
    per_set = met(met(met(copies, roots, "key", "left"), classes, "root", "left"), linked, "key", "left") \
        .select("key", F.coalesce("class_low", "low").alias("class_id"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    per_set = cut(per_set, "classes")
    out = met(found.select("doc_id", "key"), per_set, "key", "left")
    return out.select("doc_id", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                      F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", target: float = TARGET_RECALL) -> DataFrame:
    """docs with one document of each class: the one with the smallest id. Rows without id stay.

    Of repeated rows one stays.
    """
    found = cut(near_duplicates(docs, doc_id, text, target), "near-duplicates")
    gone = cut(found.where(F.col("doc_id") != F.col("class_id")).select(F.col("doc_id").alias("gone_id_")).distinct(), "gone")
    kept = docs.join(gone, docs[doc_id] == gone["gone_id_"], "left_anti")
    repeated = cut(found.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where(F.col("count") > 1).select(F.col("doc_id").alias("rep_id_")), "repeated-ids")
    if repeated.isEmpty():
        return kept
    single = kept.join(repeated, kept[doc_id] == repeated["rep_id_"], "left_anti")
    return single.unionByName(kept.join(repeated, kept[doc_id] == repeated["rep_id_"], "left_semi").dropDuplicates([doc_id, text]))
