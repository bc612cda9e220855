"""Repeated passages, found by windows that double in length.

A window is a run of words of one text. A long window can only repeat where its
parts repeat, so the search starts at half the wanted length and doubles:

1. Level one takes the windows of half the length. Of those inside a full window
   only the one with the smallest hash stands for it (equal full windows choose
   equal parts), so about one word in thirteen sends a row. Parts that occur in
   one text alone go.
2. Level two takes the full windows whose part survived, and keeps those that occur
   in several texts. `longest_repeats` goes on doubling until no candidates survive.

Equal texts go through the levels once. What is removed is decided on the input: a
word goes if a window that covers it also starts in a row with a smaller key.

Hot windows: counts are partial aggregates; a part that occurs in more than HOT_TEXTS
texts has its windows summed and joined (AQE splits skewed keys), all other parts
are laid together by one exchange of packed rows. Both ways give the same answer.
A window is known by two 64-bit hashes, of its part and of itself.

Words are `[^\\x20\\x09-\\x0D]+`. Null text: no words. Null key: such a row neither
removes nor loses words. Rows with the same key do not remove from each other.
Repeated rows get equal results. Columns of any name pass through unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import SLICE_ROWS, free_names
from barloom.sources.scratch import cut

#: Texts of one half window beyond which its windows are aggregated instead of laid together.
HOT_TEXTS = 2000
#: Text hashes that a task remembers in order to skip copies.
SEEN = 1 << 18

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_HALF = np.uint64(0xC2B2AE3D27D4EB4F)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in a row, and the offsets at which the texts begin and the last one ends."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = lists.flatten()
    keep = pc.not_equal(flat, "")
    before = np.concatenate([[0], np.cumsum(keep.to_numpy(zero_copy_only=False))])
    at = lists.offsets.to_numpy()
    return flat.filter(keep), before[at - at[0]]


def hashes_of(words: pa.Array) -> np.ndarray:
    coded = words.dictionary_encode()
    if not len(coded.dictionary):
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False), categorize=False)[coded.indices.to_numpy()]


def window_hashes(h: np.ndarray, length: int, base: np.uint64) -> np.ndarray:
    """Hashes of all runs of `length` values, by differences of one running sum (arithmetic modulo 2**64)."""
    n = len(h) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * np.multiply.accumulate(np.full(len(h), base)))])
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    x = (run[length:] - run[:-length]) * np.multiply.accumulate(np.full(n, inverse))
    x = (x ^ (x >> np.uint64(33))) * _MIX
    return x ^ (x >> np.uint64(29))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    m, size = x, 1
    while 2 * size <= width:
        m, size = np.minimum(m[:-size], m[size:]), 2 * size
    n = len(x) - width + 1
    return np.minimum(m[:n], m[width - size:][:n])


def full_windows(texts: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, start within the text, hash and chosen half of every window of the texts."""
    words, at = words_of(texts)
    h, half = hashes_of(words), -(-length // 2)
    if len(h) < length:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    starts = np.flatnonzero(at[text + 1] - np.arange(len(h)) >= length)
    part = sliding_min(window_hashes(h, half, _BASE_HALF), length - half + 1)[starts]
    return text[starts], starts - at[text[starts]], window_hashes(h, length, _BASE)[starts], part


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(start, SLICE_ROWS)


def _halves(docs: DataFrame, text: str, length: int) -> DataFrame:
    """(part, txt): the chosen half windows of every text, once a text of a task."""

    def run(batches):
        seen: set[int] = set()
        for batch in _slices(batches):
            ids = batch.column(0).to_pylist()
            fresh = []
            for i, t in enumerate(ids):
                if t not in seen:
                    seen.add(t)
                    fresh.append(i)
            if len(seen) > SEEN:
                seen.clear()
            which, _, _, part = full_windows(batch.column(1).take(pa.array(fresh, pa.int64())), length)
            change = np.ones(len(part), bool)
            change[1:] = (part[1:] != part[:-1]) | (which[1:] != which[:-1])
            part, which = part[change], which[change]
            order = np.lexsort((part, which))
            part, which = part[order], which[order]
            change = np.ones(len(part), bool)
            change[1:] = (part[1:] != part[:-1]) | (which[1:] != which[:-1])
            txt = np.asarray(ids, np.int64)[np.asarray(fresh, np.int64)[which[change]]] if len(part) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(part[change].view(np.int64)), pa.array(txt)], names=["part", "txt"])

    return docs.select(F.xxhash64(text).alias("txt"), F.col(text)).mapInArrow(run, "part long, txt long")


def _runs(candidates: DataFrame, length: int) -> DataFrame:
    """Packed windows: one row per run of windows of a text with the same surviving half.

    candidates: key, txt, text, parts (array of struct part, texts).
    """
    kind = candidates.schema["key"].dataType
    schema = T.StructType([T.StructField("key", kind)]).add("txt", "long").add("part", "long").add("texts", "long") \
        .add("start", "long").add("hashes", T.ArrayType(T.LongType()))

    def run(batches):
        for batch in _slices(batches):
            which, start, full, part = full_windows(batch.column(2), length)
            texts = np.zeros(len(part), np.int64)
            bounds = np.searchsorted(which, np.arange(batch.num_rows + 1))
            parts = batch.column(3)
            for i in range(batch.num_rows):
                lo, hi = bounds[i], bounds[i + 1]
                found = parts[i].values
                if lo == hi or not len(found):
                    continue
                known, n = found.field(0).to_numpy().view(np.uint64), found.field(1).to_numpy()
                order = np.argsort(known)
                at = np.minimum(np.searchsorted(known, part[lo:hi], sorter=order), len(known) - 1)
                texts[lo:hi] = np.where(known[order[at]] == part[lo:hi], n[order[at]], 0)
            live = texts > 0
            which, start, full, part, texts = which[live], start[live], full[live], part[live], texts[live]
            new = np.ones(len(part), bool)
            new[1:] = (part[1:] != part[:-1]) | (which[1:] != which[:-1]) | (start[1:] != start[:-1] + 1)
            at = np.flatnonzero(new)
            rows = pa.array(which[at])
            offsets = pa.array(np.append(at, len(part)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(part[at].view(np.int64)), pa.array(texts[at]),
                 pa.array(start[at].astype(np.int64)), pa.ListArray.from_arrays(offsets, pa.array(full.view(np.int64)))],
                names=schema.names)

    return candidates.select("key", "txt", "text", "parts").mapInArrow(run, schema)


def _starts(runs: DataFrame, hot_texts: int) -> DataFrame:
    """(key, txt, starts): the windows of a row that also start in a row with a smaller key."""
    cold, hot = runs.where(F.col("texts") <= hot_texts), runs.where(F.col("texts") > hot_texts)
    flat = lambda df: df.select("key", "txt", "part", "start", F.posexplode("hashes").alias("i", "full"))
    together = flat(cold.repartition("part")).withColumn("first", F.min("key").over(Window.partitionBy("part", "full")))
    together = together.where(F.col("first") < F.col("key")).groupBy("part", "key", "txt", "start").agg(F.collect_list("i").alias("at"))
    firsts = flat(hot).groupBy("part", "full").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first < last")
    joined = flat(hot).join(firsts, ["part", "full"]).where(F.col("first") < F.col("key")) \
        .groupBy("part", "key", "txt", "start").agg(F.collect_list("i").alias("at"))
    found = together.unionByName(joined).select("key", "txt", F.transform("at", lambda i: i + F.col("start")).alias("at"))
    return found.groupBy("key", "txt").agg(F.array_sort(F.flatten(F.collect_list("at"))).alias("starts"))


def _kept(found: DataFrame, text: str, starts: str, out: tuple[str, str], length: int) -> DataFrame:
    spans, kept = out
    span = T.ArrayType(T.StructType().add("start", "long").add("stop", "long"))
    columns = found.columns
    names, text_at, starts_at = [c for c in columns if c != starts], columns.index(text), columns.index(starts)
    schema = T.StructType([found.schema[c] for c in names]).add(spans, span).add(kept, "string")
    pair = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches):
        for batch in _slices(batches):
            words, at = words_of(batch.column(text_at))
            gone, texts = [], []
            for i, s in enumerate(batch.column(starts_at).to_pylist()):
                mine, merged = words[at[i]:at[i + 1]].to_pylist(), []
                for x in s:
                    if merged and x <= merged[-1][1]:
                        merged[-1][1] = x + length
                    else:
                        merged.append([x, x + length])
                left, last = [], 0
                for a, b in merged:
                    left += mine[last:a]
                    last = b
                gone.append([{"start": a, "stop": b} for a, b in merged])
                texts.append(" ".join(left + mine[last:]))
            yield pa.RecordBatch.from_arrays([*[x for i, x in enumerate(batch.columns) if i != starts_at], pa.array(gone, pair), pa.array(texts, pa.string())], names=schema.names)

    return found.mapInArrow(run, schema)


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 50, hot_texts: int = HOT_TEXTS,
                    out: tuple[str, str, str] = ("n_words", "removed", "kept")) -> DataFrame:
    """docs with the number of words, the removed word spans [start, stop) and the words kept, joined by one space.

    A name of `out` that docs has already gets underscores appended.
    """
    n_words, removed, kept = free_names(docs, *out)
    txt, two, first, parts, starts = free_names(docs, "txt", "txt2", "first", "parts", "starts")
    k, t = F.col(f"`{key}`"), F.col(f"`{text}`")
    plain = docs.select(k.alias("key"), t.alias("text"))

    halves = cut(_halves(plain.where("key IS NOT NULL AND text IS NOT NULL"), "text", length), "half-windows")
    several = halves.groupBy("part").agg(F.min("txt").alias("a"), F.max("txt").alias("b"), F.count("*").alias("texts")).where("a < b")
    by_text = halves.join(several, "part").groupBy("txt").agg(F.collect_list(F.struct("part", "texts")).alias("parts"))
    hashes = [F.xxhash64("text").alias("txt"), F.xxhash64(F.lit(1), "text").alias("txt2")]
    firsts = plain.where("text IS NOT NULL").select("key", *hashes).groupBy("txt", "txt2").agg(F.min("key").alias("first"))
    info = firsts.join(by_text, "txt", "left").select(F.col("txt").alias(txt), F.col("txt2").alias(two), F.col("first").alias(first), F.col("parts").alias(parts))

    # One exchange of the texts; later ones move only texts with candidates.
    all_docs = docs.withColumns({txt: F.xxhash64(t), two: F.xxhash64(F.lit(1), t)}).join(info, [txt, two], "left")
    all_docs = cut(all_docs.select(*[F.col(f"`{c}`") for c in docs.columns], txt, first, parts), "texts-with-halves")

    own = k.isNotNull() & (k == F.col(first)) & F.col(parts).isNotNull()
    candidates = all_docs.where(own).select(k.alias("key"), F.col(txt).alias("txt"), t.alias("text"), F.col(parts).alias("parts"))
    found = _starts(cut(_runs(candidates, length), "window-runs"), hot_texts)
    found = cut(found, "window-starts").select(F.col("key").alias(two), F.col("txt").alias(txt), F.col("starts").alias(starts))

    columns = [F.col(f"`{c}`") for c in docs.columns]
    joined = all_docs.where(own).join(found, (k == F.col(two)) & (all_docs[txt] == found[txt]), "left").select(*columns, starts)
    joined = joined.withColumn(starts, F.coalesce(starts, F.array().cast("array<long>")))
    norm = F.trim(F.regexp_replace(F.coalesce(t, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    with_own = _kept(joined, text, starts, (removed, kept), length).withColumn(n_words, _count(norm)).select(*columns, n_words, removed, kept)

    copy = k.isNotNull() & (k > F.col(first)) & (_count(norm) >= length)
    rest = all_docs.where(~F.coalesce(own, F.lit(False))).withColumns({
        n_words: _count(norm),
        removed: F.when(copy, F.array(F.struct(F.lit(0).cast("long").alias("start"), _count(norm).alias("stop"))))
        .otherwise(F.array().cast("array<struct<start:long,stop:long>>")),
        kept: F.when(copy, "").otherwise(norm)})
    return with_own.unionByName(rest.select(*columns, n_words, removed, kept))


def _count(norm):
    """Words of a text whose white space is single spaces."""
    return F.when(norm == "", F.lit(0).cast("long")).otherwise((F.length(norm) - F.length(F.replace(norm, F.lit(" "), F.lit(""))) + 1).cast("long"))


def longest_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 50) -> DataFrame:
    """(key, txt, words): for texts that share a window with another text, the longest doubled length that still does.

    Windows of `length` words that occur in several texts are extended to twice the
    length where the window behind them does so too, until no candidates survive.
    txt is the hash of the text; equal texts are one text with its smallest key.
    """
    plain = docs.where(F.col(f"`{text}`").isNotNull()).select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    texts = cut(plain.groupBy("text").agg(F.min("key").alias("key")).select("key", F.xxhash64("text").alias("txt"), "text"), "distinct-texts")
    live, out = texts.withColumn("starts", F.lit(None).cast("array<long>")), None
    while True:
        rows = cut(_windows_at(live, length), "windows")
        several = rows.groupBy("full", "other").agg(F.min("txt").alias("a"), F.max("txt").alias("b")).where("a < b")
        found = cut(rows.join(several, ["full", "other"]).groupBy("txt").agg(F.array_sort(F.collect_list("start")).alias("starts")), "repeated")
        level = found.select("txt").withColumn("words", F.lit(length).cast("long"))
        out = level if out is None else out.unionByName(level)
        both = F.array_intersect("starts", F.transform("starts", lambda i: i - length))
        found = found.withColumn("starts", both).where(F.size("starts") > 0)
        if found.isEmpty():
            return texts.join(out.groupBy("txt").agg(F.max("words").alias("words")), "txt").select("key", "txt", "words")
        live, length = texts.join(found, "txt").select("key", "txt", "text", "starts"), 2 * length


def _windows_at(live: DataFrame, length: int) -> DataFrame:
    """(full, other, txt, start): two hashes of the windows at the given starts, of all windows where starts is null."""

    def run(batches):
        for batch in _slices(batches):
            which, start, full, part = full_windows(batch.column(2), length)
            keep = np.ones(len(which), bool)
            for i, s in enumerate(batch.column(3).to_pylist()):
                if s is not None:
                    lo, hi = np.searchsorted(which, [i, i + 1])
                    keep[lo:hi] = np.isin(start[lo:hi], s)
            which, start, full, part = which[keep], start[keep], full[keep], part[keep]
            yield pa.RecordBatch.from_arrays([pa.array(full.view(np.int64)), pa.array(part.view(np.int64)), batch.column(1).take(pa.array(which)),
                                              pa.array(start.astype(np.int64))], names=["full", "other", "txt", "start"])

    return live.select("key", "txt", "text", "starts").mapInArrow(run, "full long, other long, txt long, start long")
