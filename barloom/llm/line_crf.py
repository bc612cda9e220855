"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Each line has a state, good or bad. Its potentials come from features of the
line and of both neighbours, its transition from the state before. Forward and
backward sums give the probability of every line being good; the mean of these,
weighted by the length of the lines, is the document's score.

Lines inherit the label of their document for training. The model is fitted by
gradient steps on the likelihood of a bounded sample of labelled documents
(`CrfParams.max_docs`, `max_lines`); scoring covers every line of every text.

Defined cases: a null text is an empty one; an empty text is one empty line.
Without labelled documents of both kinds every score is 1 (nothing is known
against a document). Null labels are not learned from. Repeated rows are scored
each; a document with several labels is learned once per label. Columns of the
input other than text pass through `scored` under any name but `score`.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import append_columns, hash_sample

FEATURES = ["bias", "chars", "words", "word_len", "upper", "digits", "symbols", "shouts", "stops", "other_bytes", "distinct_words",
            "distinct_runs", "same_next", "repeated_line", "same_as_last", "ends_sentence", "starts_upper", "pipes", "address", "blank"]
UPPER = bytes(range(65, 91))
DIGITS = b"0123456789"
SYMBOLS = b"#*$%&|<>~^=+_\\@{}[]"
HIGH = bytes(range(128, 256))


@dataclass(frozen=True)
class CrfParams:
    max_docs: int = 6000
    max_lines: int = 120_000
    #: A sampled document has no more lines than this.
    max_lines_of_doc: int = 400
    steps: int = 120
    rate: float = 0.08
    l2: float = 1e-3


def _share(line: bytes, of: bytes, n: int) -> float:
    return (n - len(line.translate(None, of))) / n


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Features (lines x len(FEATURES)) and lengths of the lines of a text."""
    lines = (text or "").encode().split(b"\n")
    out = np.zeros((len(lines), len(FEATURES)), np.float32)
    seen: set[bytes] = set()
    last = None
    for i, line in enumerate(lines):
        row = out[i]
        row[0] = 1.0
        words = line.split()
        n, m = len(line), len(words)
        if not m:
            row[19] = 1.0
            last = line
            continue
        ends = line.rstrip()
        row[1] = min(np.log1p(n) / 8, 1.5)
        row[2] = min(np.log1p(m) / 6, 1.5)
        row[3] = min((n - m + 1) / m / 12, 3.0)
        row[4] = _share(line, UPPER, n)
        row[5] = _share(line, DIGITS, n)
        row[6] = min(5 * _share(line, SYMBOLS, n), 3.0)
        row[7] = min(5 * _share(line, b"!?", n), 3.0)
        row[8] = min(10 * _share(line, b".,;:", n), 3.0)
        row[9] = _share(line, HIGH, n)
        row[10] = len(set(words)) / m
        row[11] = len(set(zip(words, words[1:], words[2:]))) / (m - 2) if m > 2 else 1.0
        row[12] = sum(map(bytes.__eq__, words, words[1:])) / m
        row[13] = line in seen
        row[14] = line == last
        row[15] = ends[-1:] in b".!?:"
        row[16] = line[:1] in UPPER
        row[17] = min(line.count(b"|") / m, 1.0)
        row[18] = b"@" in line or b"http" in line
        seen.add(line)
        last = line
    return out, np.array([max(len(x), 1) for x in lines], np.float64)


def with_neighbours(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """x beside the rows before and after it in the same document; zeros beyond its ends."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(int)
    before[starts] = 0
    after[starts + sizes - 1] = 0
    return np.hstack([x, before, after])


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def marginals(unary: np.ndarray, trans: np.ndarray, sizes: np.ndarray, pairs: bool = False):
    """P(state) of every line, and the expected counts of transitions if asked for.

    All documents step together, longest first, so that the ones still running
    are a prefix.
    """
    order = np.argsort(-sizes, kind="stable")
    starts = (np.cumsum(sizes) - sizes)[order]
    long = sizes[order]
    steps = int(long[0]) if len(long) else 0
    alive = np.array([np.searchsorted(-long, -t, side="left") for t in range(steps)])  # documents with more than t lines
    forward, backward = np.array(unary, np.float64), np.zeros(unary.shape)
    for t in range(1, steps):
        at = starts[: alive[t]] + t
        forward[at] += _log_sum(forward[at - 1][:, :, None] + trans[None], 1)
    for t in range(steps - 2, -1, -1):
        at = starts[: alive[t + 1]] + t
        backward[at] = _log_sum(trans[None] + (unary[at + 1] + backward[at + 1])[:, None, :], 2)
    both = forward + backward
    log_z = _log_sum(both, 1)
    probs = np.exp(both - log_z[:, None])
    if not pairs:
        return probs
    inner = np.ones(len(unary), bool)
    inner[np.cumsum(sizes) - sizes] = False
    at = np.flatnonzero(inner)
    joint = forward[at - 1][:, :, None] + trans[None] + (unary[at] + backward[at])[:, None, :] - log_z[at][:, None, None]
    return probs, np.exp(joint).sum(axis=0)


def fit(x: np.ndarray, sizes: np.ndarray, y: np.ndarray, p: CrfParams) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features x 2) and transitions (2 x 2); x has neighbours, y is the state of each line."""
    w, trans = np.zeros((x.shape[1], 2)), np.zeros((2, 2))
    gold = np.eye(2)[y]
    inner = np.ones(len(y), bool)
    inner[np.cumsum(sizes) - sizes] = False
    at = np.flatnonzero(inner)
    gold_pairs = np.zeros((2, 2))
    np.add.at(gold_pairs, (y[at - 1], y[at]), 1)
    # Each document counts alike, whatever its number of lines.
    weight = np.repeat(1.0 / sizes, sizes)[:, None]
    n, n_pairs = len(sizes), max(len(at), 1)
    moment = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(trans), np.zeros_like(trans)]
    for step in range(1, p.steps + 1):
        probs, pairs = marginals(x @ w, trans, sizes, pairs=True)
        grads = (x.T @ ((gold - probs) * weight) / n - p.l2 * w, (gold_pairs - pairs) / n_pairs - p.l2 * trans)
        for k, (value, g) in enumerate(zip((w, trans), grads)):
            m, v = moment[2 * k], moment[2 * k + 1]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            value += p.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w, trans


def train(labelled: DataFrame, text: str = "text", label: str = "quality", key: str = "doc_id", p: CrfParams = CrfParams()):
    """Fit on a bounded sample of rows with label 0 or 1; None if one of them is missing.

    About half of the sample is taken from either label, by a hash. Features are
    made in Spark tasks; about max_docs documents reach the driver and at most
    max_lines lines are learned from.
    """
    size = F.size(F.split(F.coalesce(text, F.lit("")), "\n"))
    known = labelled.where(F.col(label).isin(0, 1)).where(size <= p.max_lines_of_doc) \
        .select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"), F.col(text).alias("text"))
    sample = hash_sample(known, "label", "key", "text", p.max_docs // 2)
    rows = append_columns(sample, _packed, "text", [T.StructField("x", T.BinaryType())]).select("label", "x").collect()
    rows.sort(key=lambda r: zlib.crc32(r["x"]))
    xs, ys, left = [], [], p.max_lines
    for r in rows:
        x = np.frombuffer(r["x"], np.float32).reshape(-1, len(FEATURES))
        left -= len(x)
        if left < 0:
            break
        xs.append(x)
        ys.append(r["label"])
    if len(set(ys)) < 2:
        return None
    sizes = np.array([len(x) for x in xs])
    return fit(with_neighbours(np.vstack(xs).astype(np.float64), sizes), sizes, np.repeat(ys, sizes), p)


def _packed(texts: list) -> list[list]:
    return [[line_features(t)[0].tobytes() for t in texts]]


def score_texts(texts: list, model) -> list[float]:
    if model is None:
        return [1.0] * len(texts)
    if not texts:
        return []
    w, trans = model
    parts = [line_features(t) for t in texts]
    sizes = np.array([len(n) for _, n in parts])
    x = with_neighbours(np.vstack([x for x, _ in parts]), sizes)
    good = marginals(x @ w, trans, sizes)[:, 1]
    length = np.concatenate([n for _, n in parts])
    starts = np.cumsum(sizes) - sizes
    total = np.add.reduceat(good * length, starts) / np.add.reduceat(length, starts)
    return np.clip(total, 0.0, 1.0).tolist()


def scored(docs: DataFrame, model, text: str = "text", score: str = "score") -> DataFrame:
    """docs with the score of every text; the model is a few hundred numbers and travels with the task."""
    return append_columns(docs, lambda texts: [score_texts(texts, model)], text, [T.StructField(score, T.DoubleType())])
