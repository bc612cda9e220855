"""Benchmark decontamination by winnowing.

The fingerprints of a text are the smallest k-gram hashes of its sliding windows
of w = window - k + 1 hashes. Two texts that share `window` words share a whole
window of hashes, so they share a fingerprint at the same place of the shared
span: no sufficiently long span is missed. Fingerprints of documents and items
are joined; each hit gives an alignment of document and item, along which words
are compared to find every shared window.

Items of fewer words than `window` are one window of their own; their
fingerprint is the hash of all their words.

Everything is DataFrame functions. Only fingerprints (about 2 / (w + 1) per
word) meet the join; texts are read again for documents with a hit only.

Defined cases: null and empty texts have no words, no hits. Items without words
are never found. Rows that share an id (repeated rows, null ids) get the union of
their hits. Repeated benchmark rows
count once per item id. Null item ids count as the item ''. Other columns are
not read. Empty tables give rows without hits, or no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.sources.scratch import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, K = 10, 5


def words(text: Column) -> Column:
    """Lower-case A-Z words; any array, never null.

    Letters are replaced one by one: lower() would change letters beyond A-Z too.
    """
    parts = F.split(F.translate(text, UPPER, LOWER), SEPARATORS)
    return F.coalesce(F.filter(parts, lambda x: x != ""), F.array().cast("array<string>"))


def gram_hashes(ws: Column, k: int) -> Column:
    """Hashes of all runs of k words."""
    n = F.size(ws) - k + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.xxhash64(F.slice(ws, i, k)))) \
        .otherwise(F.array().cast("array<bigint>"))


def winnowed(hashes: Column, w: int) -> Column:
    """Distinct smallest hashes of all windows of w hashes; of fewer hashes, none."""
    n = F.size(hashes) - w + 1
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_min(F.slice(hashes, i, w))))) \
        .otherwise(F.array().cast("array<bigint>"))


def items_of(bench: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """item (text of the id), item_words, item_size: the words in one window of the item."""
    out = bench.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), words(F.col(text)).alias("item_words"))
    return out.where(F.size("item_words") > 0).distinct().withColumn("item_size", F.least(F.size("item_words"), F.lit(window)))


def _exploded(df: DataFrame, ids: list[str], array: str) -> DataFrame:
    """ids and h. The outer form keeps the optimizer from working the array out twice for a filter on its size."""
    return df.select(*ids, F.explode_outer(array).alias("h")).where(F.col("h").isNotNull())


def fingerprints(ids: list[str], df: DataFrame, ws: str, size: int, k: int) -> DataFrame:
    """ids and h: the fingerprints for windows of `size` words.

    One select per step: each step refers to the last one's array inside a loop.
    """
    hashed = df.select(*ids, gram_hashes(F.col(ws), k).alias("hashes_"))
    return _exploded(hashed.select(*ids, winnowed(F.col("hashes_"), size - k + 1).alias("prints_")), ids, "prints_")


def _places(ids: list[str], df: DataFrame, ws: str, k: int, at: str) -> DataFrame:
    """ids, place and hash of every k-gram."""
    hashed = df.select(*ids, gram_hashes(F.col(ws), k).alias("hashes_"))
    return hashed.select(*ids, F.posexplode_outer("hashes_").alias(at, "h")).where(F.col("h").isNotNull())


def alignments(texts: DataFrame, items: DataFrame, size: int, k: int) -> DataFrame:
    """doc_id, item, shift: item word j may stand at document word j + shift.

    First documents with a common fingerprint, by hash alone; places are worked
    out for those only. The item side of each join is a written table, so Spark
    knows its size and broadcasts it only if it is small.
    """
    k = min(k, size)
    prints = cut(fingerprints(["item"], items, "item_words", size, k).select("h").distinct(), f"benchmark-prints-{size}")
    docs = texts.select("doc_id", words(F.col("text_")).alias("doc_words"))
    hits = cut(fingerprints(["doc_id"], docs, "doc_words", size, k).join(prints, "h", "left_semi").distinct(), f"print-hits-{size}")
    wanted = cut(hits.select("h").distinct(), f"hit-prints-{size}")
    in_items = cut(_places(["item"], items, "item_words", k, "q").join(wanted, "h", "left_semi"), f"item-places-{size}")
    in_docs = _places(["doc_id"], split_near(texts, hits), "doc_words", k, "p")
    return in_docs.join(in_items, "h").select("doc_id", "item", (F.col("p") - F.col("q")).alias("shift")).distinct()


def extend(aligned: DataFrame, docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item, item_size, start: document places (from 0) at which a window of the item occurs, by comparing words."""
    items = items.withColumnsRenamed({"item": "item_"})
    docs = docs.withColumnRenamed("doc_id", "doc_id_")
    both = aligned.join(items, aligned["item"] == items["item_"]).join(docs, aligned["doc_id"].eqNullSafe(F.col("doc_id_")))
    n = F.size("item_words")
    lead = F.greatest(F.col("shift"), F.lit(0))
    # Words of the document next to those of the item; beside its ends null.
    both = both.select("doc_id", "item", "shift", "item_size", "item_words", (lead - F.col("shift")).alias("offset"),
                       F.slice(F.col("doc_words"), lead + 1, n).alias("beside"))
    same = F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.coalesce(
        F.element_at("item_words", j + 1) == F.get(F.col("beside"), j - F.col("offset")), F.lit(False)))
    both = both.select("doc_id", "item", "shift", "item_size", same.alias("same"))
    starts = F.filter(F.sequence(F.lit(0), F.size("same") - F.col("item_size")),
                      lambda s: F.forall(F.slice("same", s + 1, F.col("item_size")), lambda x: x))
    both = both.select("doc_id", "item", "item_size", "shift", starts.alias("starts"))
    return both.select("doc_id", "item", "item_size", "shift", F.explode_outer("starts").alias("s")).where(F.col("s").isNotNull()) \
        .select("doc_id", "item", "item_size", (F.col("s") + F.col("shift")).alias("start"))


def shared_windows(docs: DataFrame, bench: DataFrame, doc_id: str = "doc_id", text: str = "text",
                   item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, k: int = K) -> DataFrame:
    """doc_id, item, item_size, start of every occurrence of a window of a benchmark item in a document."""
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text_"))
    items = cut(items_of(bench, item_id, item_text, window), "benchmark-words")
    # At most `window` numbers: which lengths of windows there are.
    sizes = sorted(r[0] for r in items.select("item_size").distinct().collect())
    spans = None
    for size in sizes:
        own = items.where(F.col("item_size") == size)
        aligned = cut(alignments(texts, own, size, k), f"alignments-{size}")
        part = extend(aligned, split_near(texts, aligned), own)
        spans = part if spans is None else spans.unionByName(part)
    if spans is None:
        return docs.where(F.lit(False)).select(F.col(doc_id).alias("doc_id"), F.lit("").alias("item"), F.lit(0).alias("item_size"), F.lit(0).alias("start"))
    return spans


def split_near(texts: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id and doc_words of the documents that found names."""
    ids = cut(found.select(F.col("doc_id").alias("id_")).distinct(), "near-ids")
    near = texts.join(ids, texts["doc_id"].eqNullSafe(ids["id_"]), "left_semi")
    return near.select("doc_id", words(F.col("text_")).alias("doc_words"))


def hit_table(spans: DataFrame) -> DataFrame:
    """Per document with a hit: n_hit (distinct places), n_items, items (sorted as strings)."""
    places = spans.select("doc_id", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("item_size") - 1)).alias("p"))
    hit = places.distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_hit"))
    items = spans.select("doc_id", "item").distinct().groupBy("doc_id") \
        .agg(F.array_sort(F.collect_list("item")).alias("items"))
    items = items.withColumnRenamed("doc_id", "id_")
    return hit.join(items, hit["doc_id"].eqNullSafe(items["id_"])).drop("id_")


def decontaminated(docs: DataFrame, bench: DataFrame, doc_id: str = "doc_id", text: str = "text",
                   item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, k: int = K) -> DataFrame:
    """docs without the documents that share a window with an item; all columns kept."""
    spans = shared_windows(docs, bench, doc_id, text, item_id, item_text, window, k)
    hit = cut(spans.select(F.col("doc_id").alias("_hit_id")).distinct(), "contaminated")
    return docs.join(hit, docs[doc_id].eqNullSafe(hit["_hit_id"]), "left_anti")


def report(docs: DataFrame, bench: DataFrame, doc_id: str = "doc_id", text: str = "text",
           item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, k: int = K) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, items."""
    hits = cut(hit_table(shared_windows(docs, bench, doc_id, text, item_id, item_text, window, k)), "hits")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.size(words(F.col(text))).cast("long").alias("n_words"))
    hits = hits.withColumnRenamed("doc_id", "id_")
    out = rows.join(hits, rows["doc_id"].eqNullSafe(hits["id_"]), "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                      F.coalesce("items", F.array().cast("array<string>")).alias("items"))
