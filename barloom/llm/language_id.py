"""Language identification, word first.

A known word scores its log frequency in every language. An unseen word backs
off to its character n-grams: at every place the longest known n-gram counts,
and progressively shorter ones where longer ones are unknown. The word scores their
mean, so it weighs as much as a known one. The language with the largest sum wins.

The model is fitted on a bounded sample (`LidParams`: documents, words and
n-grams per language); every text is scored whole.

Defined cases: a text that is null or has no letter is 'und' with score 0. Rows
without language are not learned from. Without a single learned language all
texts are 'und'. Ties go to the first language by name. Repeated rows are
predicted each. Columns of the input pass through under any name but the two
new ones.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import append_columns, hash_sample
from barloom.sources.scratch import cut

#: Letters, and numerals such as ½ that are no digits; `tokens` splits at those.
WORD = re.compile(r"[^\W\d_]+")
UNKNOWN_KEPT = 100_000


@dataclass(frozen=True)
class LidParams:
    docs_per_language: int = 2500
    words_per_language: int = 40_000
    grams_per_language: int = 40_000
    max_gram: int = 4
    min_word_count: int = 2
    #: Added to every count.
    smoothing: float = 0.5


def tokens(text: str | None) -> list[str]:
    """Runs of letters, in lower case."""
    out = []
    for word in WORD.findall((text or "").lower()):
        if word.isalpha():
            out.append(word)
        else:
            out += "".join(c if c.isalpha() else " " for c in word).split()
    return out


def grams(word: str, n: int) -> list[str]:
    marked = f"<{word}>"
    return [marked[i:i + n] for i in range(len(marked) - n + 1)]


def _counted(texts: list) -> list[list]:
    return [[[w for w in Counter(tokens(t))] for t in texts], [[n for n in Counter(tokens(t)).values()] for t in texts]]


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", p: LidParams = LidParams()) -> dict | None:
    """Counts words and n-grams of the sample in Spark and collects the most frequent ones per language."""
    known = labelled.where(F.col(lang).isNotNull()).select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    sample = hash_sample(known, "lang", "key", "text", p.docs_per_language).select("lang", "text")
    counted = append_columns(sample, _counted, "text", [T.StructField("w", T.ArrayType(T.StringType())),
                                                        T.StructField("n", T.ArrayType(T.LongType()))])
    words = cut(counted.select("lang", F.explode(F.arrays_zip("w", "n")).alias("e")).groupBy("lang", F.col("e.w").alias("gram"))
                .agg(F.sum("e.n").alias("n")), "lid-words")
    levels = [_top(words.where(F.col("n") >= p.min_word_count), p.words_per_language)]
    marked = F.concat(F.lit("<"), "gram", F.lit(">"))
    for size in range(1, p.max_gram + 1):
        parts = F.transform(F.sequence(F.lit(1), F.length(marked) - size + 1), lambda i: F.substr(marked, i, F.lit(size)))
        pieces = words.where(F.length(marked) >= size).select("lang", F.explode(parts).alias("gram"), "n").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        levels.append(_top(pieces, p.grams_per_language))
    totals = {r["lang"]: r["n"] for r in words.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(totals)
    if not langs:
        return None
    return {"langs": langs, "max_gram": p.max_gram, "tables": [_table(level, langs, p.smoothing) for level in levels]}


def _top(counts: DataFrame, most: int) -> list:
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= most).select("lang", "gram", "n").collect()


def _table(rows: list, langs: list[str], smoothing: float) -> tuple[dict[str, int], np.ndarray]:
    """Row number by word, and log frequencies (words x languages)."""
    at = {g: i for i, g in enumerate(sorted({r["gram"] for r in rows}))}
    counts = np.full((len(at), len(langs)), smoothing)
    col = {x: i for i, x in enumerate(langs)}
    for r in rows:
        counts[at[r["gram"]], col[r["lang"]]] += r["n"]
    return at, np.log(counts / counts.sum(axis=0)).astype(np.float32) if len(at) else np.zeros((0, len(langs)), np.float32)


class Scorer:
    """Scores texts in one task; the scores of unseen words are kept up to a bound."""

    def __init__(self, model: dict):
        self.model = model
        self.words, self.table = model["tables"][0]
        self.unseen: dict[str, np.ndarray] = {}

    def backed_off(self, word: str) -> np.ndarray:
        """Mean over the places of a word of the longest known n-gram's scores; zeros if it has none."""
        if word in self.unseen:
            return self.unseen[word]
        marked = f"<{word}>"
        total, hits, i = np.zeros(len(self.model["langs"])), 0, 0
        while i < len(marked):
            for n in range(min(self.model["max_gram"], len(marked) - i), 0, -1):
                at, table = self.model["tables"][n]
                row = at.get(marked[i:i + n])
                if row is not None:
                    total += table[row]
                    hits += 1
                    break
            i += 1
        if len(self.unseen) >= UNKNOWN_KEPT:
            self.unseen.clear()
        self.unseen[word] = mean = total / max(hits, 1)
        return mean

    def __call__(self, text: str | None) -> tuple[str, float]:
        found = Counter(tokens(text))
        if not found:
            return "und", 0.0
        get = self.words.get
        rows, times, total = [], [], np.zeros(len(self.model["langs"]))
        for word, n in found.items():
            row = get(word)
            if row is None:
                total += n * self.backed_off(word)
            else:
                rows.append(row)
                times.append(n)
        if rows:
            total += np.asarray(times, np.float64) @ self.table[rows]
        best = int(total.argmax())
        return self.model["langs"][best], 1.0 / float(np.exp(np.maximum(total - total[best], -700.0)).sum())


def predicted(docs: DataFrame, model: dict | None, text: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the predicted language and its share of the likelihood."""
    fields = [T.StructField(lang_pred, T.StringType()), T.StructField(score, T.DoubleType())]
    if model is None:
        return docs.withColumn(lang_pred, F.lit("und")).withColumn(score, F.lit(0.0))
    # Bounded by LidParams: words and n-grams per language.
    shared = docs.sparkSession.sparkContext.broadcast(model)
    held: list[Scorer] = []

    def run(texts: list) -> list[list]:
        if not held:
            held.append(Scorer(shared.value))
        found = [held[0](t) for t in texts]
        return [[x for x, _ in found], [s for _, s in found]]

    return append_columns(docs, run, text, fields)
