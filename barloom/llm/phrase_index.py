"""Phrases of several words, counted with one FM-index per shard, and the collocations among them.

A shard is a run of texts of one task, at most SHARD_WORDS words and one text more,
as numbers of its own words with a 0 behind every piece; it is written once. Its
bidirectional index has the Burrows-Wheeler transforms of these numbers and of their
reverse, sorted to the depth of the longest phrase. An interval in each stands for a
phrase; one step extends all intervals of a depth by every word that follows, and
gives counts and the number of occurrences with a word to the left and to the right.

Every phrase is summed whole in one bucket, a task whose share of the words is bounded:

1. a shard deals its phrases of 1 to max_words words to buckets, by a hash of the word or
   of the first two words; longer phrases go along, so a shard sends each bucket tries
   whose words stand once per branch. What is sent follows the words of the corpus, not
   how many phrases are frequent;
2. branches that are a large part of the corpus are dealt one word further down. Which
   ones they are is told by every SAMPLED-th place of all shards and changes where a phrase
   is summed only. There the words above are sent along with no occurrences;
3. a bucket adds up the shards, level by level below frequent phrases, and names what is
   frequent.

Lower case: A-Z. Pieces end at `[.,;:!?\\x0A-\\x0D]`, words are `[^\\x20\\x09]+`. Null text: no
words. Null group: `und`. Repeated rows count each time. Other columns are not read.
A tie of cuts goes to the shortest first part, a tie of phrases to the first in byte order.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import SLICE_ROWS
from barloom.sources.scratch import cut

#: Words of a shard; its index takes about 60 bytes a word while it is built.
SHARD_WORDS = 1_000_000
#: Every so many places of a shard tell which branches are large; words of the longest of these.
SAMPLED, SPLIT_WORDS = 8, 3
#: Large branches are at most about so many of each number of words.
SPLIT = 40_000
#: Rows of intervals that are extended at a time.
EXTEND_ROWS = 500_000
#: Words a shard puts into messages at a time.
DEAL_WORDS = 500_000
#: Bytes of words a bucket reads at a time.
READ_LETTERS = 4_000_000
#: Words of the corpus per bucket; each is there as the first of one phrase of every length at most.
BUCKET_WORDS = 2_000_000
NO_GROUP = "und"

_SHARD = "shard long, groups array<string>, n_words array<long>, letters long, words binary, distinct long, owners binary, size long, ids binary, large array<long>, seen array<int>"


def tokens(texts: pa.Array) -> pa.Array:
    """Words of all texts in a row, "." between pieces and behind each text (no word holds it)."""
    lower = pc.ascii_lower(pc.fill_null(texts, ""))
    ended = pc.binary_join_element_wise(pc.replace_substring_regex(lower, r"[.,;:!?\x0A-\x0D]+", " . "), ".", " ")
    flat = pc.ascii_split_whitespace(ended).flatten()
    return flat.filter(pc.not_equal(flat, ""))


def _pack(numbers: np.ndarray) -> bytes:
    return pa.compress(numbers.astype(np.int32).view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, size: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * size, codec="zstd"), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view(np.int32).ravel()


def _hashes(words: list[str], groups: list[str], owners: np.ndarray) -> np.ndarray:
    """A hash of each word and its group, 0 for number 0."""
    hashes = pd.util.hash_array(np.array(words, object), categorize=False)
    of_group = pd.util.hash_array(np.array(groups, object), categorize=False)
    return np.concatenate([np.zeros(1, np.uint64), hashes ^ (of_group[owners] * np.uint64(0x9E3779B97F4A7C15))])


def _longer(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of phrases with a word more, whose own hashes are given."""
    x = (hashes + words) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(29))


def _bucket(hashes: np.ndarray, n_buckets: int) -> np.ndarray:
    x = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    return ((x >> np.uint64(32)) % np.uint64(n_buckets)).astype(np.int64)


def _large(ids: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of phrases that are a large part of the places looked at, and how often they were seen."""
    at = np.arange(0, len(ids), SAMPLED)
    found, x, live = [], np.zeros(len(at), np.uint64), np.ones(len(at), bool)
    for d in range(SPLIT_WORDS):
        word = ids[(at + d) % len(ids)]
        live &= word > 0
        x = _longer(x, hashes[word])
        if d:
            phrase, seen = np.unique(x[live], return_counts=True)
            many = (seen > 1) & (seen * SPLIT >= len(at))
            found.append((phrase[many], seen[many]))
    phrase, seen = (np.concatenate(x) for x in zip(*found))
    return phrase.view(np.int64), seen.astype(np.int32)


class _Shard:
    """Numbers of the words seen so far; 0 ends a piece."""

    def __init__(self):
        self.known: dict[str, dict[str, int]] = {}
        self.words: list[str] = []
        self.owners: list[int] = []
        self.ids: list[np.ndarray] = []
        self.size = 0

    def add(self, group: str, texts: pa.Array) -> None:
        coded = tokens(texts).dictionary_encode()
        known = self.known.setdefault(group, {".": 0})
        owner, number = list(self.known).index(group), np.empty(len(coded.dictionary), np.int32)
        for i, word in enumerate(coded.dictionary.to_pylist()):
            n = known.get(word)
            if n is None:
                n = known[word] = len(self.words) + 1
                self.words.append(word)
                self.owners.append(owner)
            number[i] = n
        self.ids.append(number[coded.indices.to_numpy()])
        self.size += len(coded)

    def row(self, shard: int) -> pa.RecordBatch:
        ids = np.concatenate([np.zeros(1, np.int32), *self.ids])
        owners = np.array(self.owners, np.int32)
        counts = np.bincount(ids, minlength=len(self.words) + 1)[1:]
        n_words = np.bincount(owners, counts, minlength=len(self.known)).astype(np.int64)
        # Numbers in order of frequency, byte by byte: the high bytes are nearly all zero.
        order = np.argsort(-counts, kind="stable")
        rank = np.zeros(len(self.words) + 1, np.int32)
        rank[order + 1] = np.arange(1, len(order) + 1)
        ids, ordered = rank[ids], [self.words[i] for i in order]
        packed = _pack(ids)
        large, seen = _large(ids, _hashes(ordered, list(self.known), owners[order]))
        words = "\n".join(ordered).encode()
        cols = [[shard], [list(self.known)], [n_words.tolist()], [len(words)], [pa.compress(words, codec="zstd", asbytes=True)], [len(order)], [_pack(owners[order])],
                [len(ids)], [packed], [large], [seen]]
        kinds = [pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())]
        names = ["shard", "groups", "n_words", "letters", "words", "distinct", "owners", "size", "ids", "large", "seen"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)


def shards(docs: DataFrame, text: str, group: str, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The texts as written shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = TaskContext.get().partitionId() << 32, _Shard()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                groups = np.array(part.column(1).to_pylist(), object)
                for g in dict.fromkeys(groups):
                    shard.add(g, part.column(0).take(pa.array(np.flatnonzero(groups == g))))
                if shard.size >= shard_words:
                    yield shard.row(number)
                    number, shard = number + 1, _Shard()
        if shard.size:
            yield shard.row(number)

    rows = docs.select(F.col(text).alias("text"), F.coalesce(F.col(group).cast("string"), F.lit(NO_GROUP)).alias("group"))
    return cut(rows.mapInArrow(run, _SHARD), "phrase-shards")


class _Transform:
    """Burrows-Wheeler transform of circular numbers whose rotations are sorted by their first `depth` numbers."""

    def __init__(self, t: np.ndarray, depth: int):
        rank, sorted_to = t.astype(np.int64), 1
        while sorted_to < depth:
            rank = rank * (int(rank.max()) + 1) + np.roll(rank, -sorted_to)
            sorted_to *= 2
            if sorted_to < depth:
                order = np.argsort(rank, kind="stable")
                new = np.concatenate([[0], np.cumsum(np.diff(rank[order]) != 0)])
                rank[order] = new
                del new
        order = np.argsort(rank, kind="stable")
        del rank
        self.before = t[order - 1]
        del order
        self.step = np.empty(len(t), np.int32)
        self.step[np.argsort(self.before, kind="stable")] = np.arange(len(t), dtype=np.int32)
        self.extendable = np.concatenate([np.zeros(1, np.int32), np.cumsum(self.before != 0, dtype=np.int32)])


class BidirectionalIndex:
    """Intervals of phrases in the transforms of a text and of its reverse."""

    def __init__(self, ids: np.ndarray, depth: int):
        self.ids, self.depth = ids, depth
        self.right = _Transform(ids[::-1], depth)
        self.counts = np.bincount(ids)
        self.begin = np.cumsum(self.counts) - self.counts

    @functools.cached_property
    def left(self) -> _Transform:
        return _Transform(self.ids, self.depth)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Phrases of one word: words, interval begins left and right, counts."""
        found = np.flatnonzero(self.counts)
        found = found[found > 0]
        return found.astype(np.int32), self.begin[found], self.begin[found], self.counts[found]

    def extend(self, lo_left, lo_right, size):
        """All phrases with one word more at the right: numbers of the phrases given, words, interval begins left and right, counts.

        EXTEND_ROWS rows and one interval more at a time.
        """
        part = (np.cumsum(size) - size) // EXTEND_ROWS
        ends = np.append(np.flatnonzero(np.diff(part)) + 1, len(part))
        found = [self._extend(a, *(x[a:b] for x in (lo_left, lo_right, size))) for a, b in zip(np.append(0, ends[:-1]), ends)]
        return tuple(np.concatenate(x) for x in zip(*found))

    def _extend(self, begin, lo_left, lo_right, size):
        owner = np.repeat(np.arange(len(size)), size)
        base = np.cumsum(size) - size
        rows = np.arange(len(owner)) + np.repeat(lo_right - base, size)
        word = self.right.before[rows]
        key = owner * (len(self.counts) + 1) + word
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(key)))
        at = order[first]
        live = word[at] > 0
        at, first, count = at[live], first[live], count[live]
        who = owner[at]
        return who + begin, word[at], lo_left[who] + first - base[who], self.right.step[rows[at]].astype(np.int64), count

    def extendable(self, lo_left, lo_right, size) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences with a word to the left, and to the right, in their piece."""
        a, b = self.left.extendable, self.right.extendable
        return a[lo_left + size] - a[lo_left], b[lo_right + size] - b[lo_right]


class _Level(NamedTuple):
    """Phrases of a number of words in order: the phrase without the last word, the last word, counts, a hash."""

    parent: np.ndarray
    word: np.ndarray
    n: np.ndarray
    left: np.ndarray
    right: np.ndarray
    hash: np.ndarray


class _Opened:
    def __init__(self, row: dict):
        self.ids = _unpack(row["ids"], row["size"])
        self.owners, self.groups = _unpack(row["owners"], row["distinct"]), row["groups"]
        self.words = pa.decompress(row["words"], row["letters"], codec="zstd", asbytes=True).decode().split("\n") if row["distinct"] else []

    def levels(self, depth: int) -> list[_Level]:
        """All phrases of 1 to depth words."""
        index, hashes = BidirectionalIndex(self.ids, depth), _hashes(self.words, self.groups, self.owners)
        out, (word, *interval) = [], index.words()
        parent, above = np.zeros(len(word), np.int64), np.zeros(1, np.uint64)
        for d in range(depth):
            if d:
                parent, word, *interval = index.extend(*interval)
            left, right = index.extendable(*interval)
            above = _longer(above[parent], hashes[word])
            out.append(_Level(parent.astype(np.int32), word, interval[2].astype(np.int32), left, right, above))
        return out


class _Dealt(NamedTuple):
    """Phrases of a level in order of their buckets: bucket, number in the level, whether only longer ones are summed there, longer ones."""

    bucket: np.ndarray
    at: np.ndarray
    carried: np.ndarray
    kids: np.ndarray


def _deal(levels: list[_Level], n_buckets: int, large: np.ndarray) -> list[_Dealt]:
    buckets = [_bucket(level.hash, n_buckets) for level in levels[:2]]
    for above, level in zip(levels[1:], levels[2:]):
        buckets.append(np.where(np.isin(above.hash, large)[level.parent], _bucket(level.hash, n_buckets), buckets[-1][level.parent]))
    out, below, parent = [], None, None
    for level, bucket in zip(levels[:0:-1], buckets[:0:-1]):
        size = len(bucket)
        keys, longer = bucket * size + np.arange(size), np.zeros(0, np.int64)
        if below is not None:
            longer = below.bucket * size + parent
            keys = np.concatenate([keys, np.unique(longer[below.bucket != bucket[parent]])])
        keys = np.sort(keys, kind="stable")
        kids = np.bincount(np.searchsorted(keys, longer), minlength=len(keys))
        found, at = np.divmod(keys, max(1, size))
        below = _Dealt(found, at, found != bucket[at], kids)
        parent = level.parent[at]
        out.append(below)
    order = np.argsort(buckets[0], kind="stable")
    none = np.zeros(len(order), np.int64)
    return [_Dealt(buckets[0][order], order, none > 0, none), *out[::-1]]


_MESSAGE = "bucket int, groups array<string>, sizes array<int>, letters long, words binary, size long, numbers binary"


def _messages(shard: _Opened, depth: int, n_buckets: int, large: np.ndarray) -> Iterator[pa.RecordBatch]:
    """What a shard sends to each bucket.

    words: the single words, then the first words of pairs and the last words of every level. numbers: groups of words
    and pairs, then how many longer phrases follow each phrase of a level, then counts, left and right of every level.
    """
    levels = shard.levels(depth)
    dealt = _deal(levels, n_buckets, large)
    bounds = np.array([np.searchsorted(x.bucket, np.arange(n_buckets + 1)) for x in dealt])
    words = [level.word[x.at] for level, x in zip(levels, dealt)]
    if depth > 1:
        words.insert(1, levels[0].word[levels[1].parent[dealt[1].at]])
    owners = [shard.owners[x - 1] for x in words[:2]]
    numbers = [x.kids.astype(np.int32) for x in dealt[1:-1]]
    numbers += [np.where(x.carried, 0, y[x.at]).astype(np.int32) for name in ("n", "left", "right") for y, x in ((getattr(level, name), x) for level, x in zip(levels, dealt))]
    of_word, of_owner, of_number = _places(depth)
    del levels, dealt
    names = pa.array([None, *shard.words], pa.large_string())
    rows, ids, size = [], [], 0
    for bucket in range(n_buckets):
        lo, hi = bounds[:, bucket], bounds[:, bucket + 1]
        if (lo == hi).all():
            continue
        used, owner = np.unique(np.concatenate([x[lo[i]:hi[i]] for x, i in zip(owners, of_owner)]), return_inverse=True)
        packed = np.concatenate([owner, *(x[lo[i]:hi[i]] for x, i in zip(numbers, of_number))])
        ids.append(np.concatenate([x[lo[i]:hi[i]] for x, i in zip(words, of_word)]))
        rows.append((bucket, [shard.groups[i] for i in used], (hi - lo).tolist(), len(packed), _pack(packed)))
        size += len(ids[-1])
        if size >= DEAL_WORDS:
            yield _batch(rows, ids, names)
            rows, ids, size = [], [], 0
    if rows:
        yield _batch(rows, ids, names)


def _places(depth: int) -> tuple[list[int], list[int], list[int]]:
    """Levels, from 0, of the words, groups and other numbers of a message."""
    each = list(range(depth))
    return [*each[:1], *each[1:2], *each[1:]], each[:2], [*each[1:-1], *each * 3]


def _batch(rows: list[tuple], ids: list[np.ndarray], names: pa.Array) -> pa.RecordBatch:
    offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), names.take(pa.array(np.concatenate(ids)))), pa.scalar("\n", pa.large_string()))
    raw = [x.as_buffer() for x in texts]
    bucket, groups, sizes, size, numbers = zip(*rows)
    kinds = {"bucket": pa.int32(), "groups": pa.list_(pa.string()), "sizes": pa.list_(pa.int32()), "letters": pa.int64(), "words": pa.binary(), "size": pa.int64(), "numbers": pa.binary()}
    cols = [bucket, groups, sizes, [x.size for x in raw], [pa.compress(x, codec="zstd", asbytes=True) for x in raw], size, numbers]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds.values())], names=list(kinds))


def _alike(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """First place of every key in order, the number of each place's key, sums per key."""
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    new = np.concatenate([np.ones(min(1, len(keys)), bool), sorted_keys[1:] != sorted_keys[:-1]])
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    return order[first], number, [np.add.reduceat(x[order], first, dtype=np.int64) if len(first) else x.astype(np.int64) for x in counts]


_COUNTED = "group string, phrase string, words int, n long, left long, right long"


def _sizes(table: pa.Table) -> np.ndarray:
    return np.array(table["sizes"].to_pylist(), np.int64)


def _sections(table: pa.Table, levels: Sequence[int], values: Iterable[np.ndarray]) -> list[np.ndarray]:
    """The sections of all messages one behind the other; values: those of all messages in one or in several arrays, one each."""
    sizes = _sizes(table)[:, list(levels)]
    ends = np.cumsum(sizes, axis=0)
    out = [np.empty(n, np.int32) for n in ends[-1]]
    values, at, numbers = iter(values), 0, np.zeros(0, np.int32)
    for size, end in zip(sizes.tolist(), ends.tolist()):
        if at == len(numbers):
            numbers, at = next(values), 0
        for x, n, to in zip(out, size, end):
            x[to - n:to] = numbers[at:at + n]
            at += n
    return out


def _summed(min_count: int, depth: int):
    """The frequent phrases of a bucket, by name."""
    of_word, of_owner, of_number = _places(depth)

    def texts(table: pa.Table) -> tuple[pa.Array, list[np.ndarray]]:
        coded, raw, size = [], [], 0
        for i, (x, n) in enumerate(zip(table["words"], table["letters"].to_pylist()), 1):
            raw.append(pa.decompress(x.as_buffer(), n, codec="zstd", asbytes=True))
            size += n
            if size >= READ_LETTERS or i == table.num_rows:
                text = pa.array([b"\n".join(raw)], pa.large_binary()).cast(pa.large_string())
                coded.append(pc.split_pattern(text, "\n").flatten().dictionary_encode())
                raw, size = [], 0
        coded = pa.chunked_array(coded).unify_dictionaries().chunks
        return coded[0].dictionary, _sections(table, of_word, (x.indices.to_numpy() for x in coded))

    def received(table: pa.Table) -> tuple[list[str], list[np.ndarray]]:
        groups: dict[str, int] = {}
        own = [np.array([groups.setdefault(g, len(groups)) for g in row], np.int64) for row in table["groups"].to_pylist()]
        packed = (_unpack(x.as_buffer(), n.as_py()) for x, n in zip(table["numbers"], table["size"]))
        found = _sections(table, (*of_owner, *of_number), packed)
        base = np.cumsum([0, *map(len, own)])[:-1]
        sizes = _sizes(table)
        for i, level in enumerate(of_owner):
            found[i] = np.concatenate(own)[found[i] + np.repeat(base, sizes[:, level])]
        return list(groups), found

    def summed(table: pa.Table) -> pa.Table:
        names, words = texts(table)
        groups, numbers = received(table)
        owners, kids = numbers[:len(of_owner)], numbers[len(of_owner):-3 * depth]
        counts = [numbers[len(numbers) - 3 * depth + d::depth] for d in range(depth)]
        size, out = len(names), []

        def tell(columns: list[np.ndarray], owner: np.ndarray, sums: list[np.ndarray]) -> None:
            frequent = sums[0] >= min_count
            texts = [names.take(pa.array(x[frequent])) for x in columns]
            phrase = (pc.binary_join_element_wise(*texts, pa.scalar(" ", pa.large_string())) if len(texts) > 1 else texts[0]).cast(pa.string())
            out.append(pa.table({"group": pa.array(groups, pa.string()).take(pa.array(owner[frequent])), "phrase": phrase,
                                 "words": pa.array(np.full(len(phrase), len(columns), np.int32)),
                                 **{name: pa.array(x[frequent]) for name, x in zip(("n", "left", "right"), sums)}}))

        first, _, sums = _alike(owners[0] * size + words[0], *counts[0])
        tell([words[0][first]], owners[0][first], sums)
        if depth == 1:
            return out[0]
        # live: phrases of a level that are still looked at; columns: their words; above: alike ones share all words but the last.
        live, above, columns, owner = np.arange(len(words[1])), _alike(owners[1] * size + words[1])[1], [words[1]], owners[1]
        for d in range(1, depth):
            columns, level = [*columns, words[d + 1][live]], [x[live] for x in counts[d]]
            first, number, (*sums, carried) = _alike(above * size + columns[-1], *level, level[0] == 0)
            tell([x[first] for x in columns], owner[first], sums)
            if d + 1 < depth:
                grows = ((sums[0] >= min_count) | (carried > 0))[number]
                place = np.full(len(kids[d - 1]), -1, np.int64)
                place[live[grows]] = np.flatnonzero(grows)
                parent = np.repeat(place, kids[d - 1])
                live = np.flatnonzero(parent >= 0)
                parent = parent[live]
                above, columns, owner = number[parent], [x[parent] for x in columns], owner[parent]
        return pa.concat_tables(out)

    return summed


def phrase_counts(index: DataFrame, min_count: int = 30, max_words: int = 4) -> DataFrame:
    """(group, phrase, words, n, left, right): phrases of 1 to max_words words with at least min_count occurrences.

    left and right: occurrences with another word before and behind, in the same piece.
    """
    total, places = index.select(F.sum(F.aggregate("n_words", F.lit(0).cast("long"), lambda a, n: a + n)), F.sum("size")).head()
    n_buckets = max(1, -(-(total or 0) // BUCKET_WORDS))
    seen = index.select(F.inline(F.arrays_zip("large", "seen"))).groupBy("large").agg(F.sum("seen").alias("seen"))
    large = seen.where(F.col("seen") * min(SPLIT, 16 * n_buckets) * SAMPLED >= (places or 0)).select("large")
    split = np.array([r[0] for r in large.collect()], np.int64).view(np.uint64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from _messages(_Opened(batch.slice(i, 1).to_pylist()[0]), max_words, n_buckets, split)

    sent = index.select("groups", "letters", "words", "distinct", "owners", "size", "ids").mapInArrow(deal, _MESSAGE)
    return sent.groupBy("bucket").applyInArrow(_summed(min_count, max_words), _COUNTED)


def group_sizes(index: DataFrame) -> DataFrame:
    """(group, total): all words of a group."""
    pairs = index.select(F.inline(F.arrays_zip(F.col("groups").alias("group"), F.col("n_words").alias("n"))))
    return pairs.groupBy("group").agg(F.sum("n").alias("total"))


def collocations(docs: DataFrame, text: str = "text", group: str = "lang", min_count: int = 30, max_words: int = 4, top: int = 2000,
                 inside_percent: int = 80, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The first `top` phrases of every group: group, rank, phrase, a, l, r, n, score, left, right.

    The score of a phrase cut in two is floor(2000000 a / (l + r)); its lowest cut counts.
    A phrase goes if a longer one that holds it has inside_percent of its count.
    """
    index = shards(docs, text, group, shard_words)
    counts = cut(phrase_counts(index, min_count, max_words), "phrases")
    whole = counts.where("words > 1")
    exact = lambda c, by: F.col(c).cast("decimal(20,0)") * F.lit(by).cast("decimal(7,0)")

    cuts = whole.select("group", "phrase", "n", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("at"))
    cuts = cuts.withColumn("first", F.expr("substring_index(phrase, ' ', at)")).withColumn("rest", F.expr("substr(phrase, length(first) + 2)"))
    part = lambda name, n: counts.select(F.col("group"), F.col("phrase").alias(name), F.col("n").alias(n))
    cuts = cuts.join(part("first", "l"), ["group", "first"]).join(part("rest", "r"), ["group", "rest"])
    cuts = cuts.withColumn("times", exact("n", 2_000_000)).withColumn("both", F.expr("cast(l AS decimal(20,0)) + r"))
    lowest = cuts.withColumn("score", F.expr("times div both")).groupBy("group", "phrase").agg(F.min(F.struct("score", "at", "l", "r")).alias("low"))

    longer = counts.where("words > 2").select("group", "words", "n", F.split("phrase", " ").alias("w"))
    longer = longer.select("group", "w", "n", "words", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    longer = longer.select("group", "w", "n", "size", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("at"))
    longer = longer.select("group", F.array_join(F.slice("w", F.col("at"), F.col("size")), " ").alias("phrase"), "n")
    longest = longer.groupBy("group", "phrase").agg(F.max("n").alias("inside"))

    left = whole.join(longest, ["group", "phrase"], "left").where(F.col("inside").isNull() | (exact("inside", 100) < exact("n", inside_percent)))
    scored = left.join(lowest, ["group", "phrase"]).join(group_sizes(index), "group")
    order = Window.partitionBy("group").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return scored.select("group", "phrase", F.col("n").alias("a"), "low.l", "low.r", F.col("total").alias("n"), "low.score", "left", "right") \
        .withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
