"""Host-level quality rules.

Every document is measured against simple rules. Failures are added up per host
(partial aggregates, so a host with a third of all rows costs no more than any
other), host rates are shrunk with a beta prior estimated from the hosts
themselves, and the host's verdict is joined back to its documents.

Defined cases: a null text is an empty text, with no words, and fails the base
rule. A null host counts as the host ''. Repeated rows count each time and are
each judged. An empty table gives an empty table. Only the named columns are
read; other columns pass through `filter_documents` untouched whatever they are
called, unless they start with `_q_`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import append_columns
from barloom.sources.scratch import cut

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_same_next"]


@dataclass(frozen=True)
class RuleParams:
    min_words: int = 20
    max_repeat_pct: int = 30
    max_symbols_per_100_words: int = 10
    max_dup_line_pct: int = 30
    max_same_next_pct: int = 20
    min_word_chars: int = 2
    max_word_chars: int = 15
    #: A host goes when its failure rate surely exceeds this multiple of the rate of all other hosts,
    max_host_excess: float = 2.0
    #: a multiple that counts as at least the first and at most the second of these,
    host_bounds: tuple[float, float] = (0.3, 0.9)
    #: by so many standard deviations of its posterior (1.645: about 95 %).
    host_deviations: float = 1.645
    #: Weight of the prior, in documents, where hosts do not differ or there is one host only.
    flat_strength: float = 1e6


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of 8 words found at least twice in the text."""
    n = len(words)
    if n <= WINDOW:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    if len(seen) == n:
        return 0
    step = 1
    # Identifiers of windows of 2, 4 and 8 words from those of half the length: exact, no hashing.
    while step < WINDOW:
        pair = ids[:-step] * (int(ids.max()) + 1) + ids[step:]
        distinct, ids, counts = np.unique(pair, return_inverse=True, return_counts=True)
        if len(distinct) == len(pair):
            return 0
        step *= 2
    starts = np.flatnonzero(counts[ids] > 1)
    edge = np.zeros(n + 1, np.int64)
    edge[starts] += 1
    edge[starts + WINDOW] -= 1
    return int(np.count_nonzero(np.cumsum(edge)[:n]))


def measure(text: str | None) -> tuple[int, ...]:
    raw = (text or "").encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return (
        len(words),
        len(b"".join(words).decode()),
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
        sum(map(bytes.__eq__, words, words[1:])),
    )


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the measures as columns _q_<name>."""
    fields = [T.StructField(f"_q_{m}", T.LongType()) for m in MEASURES]
    return append_columns(docs, lambda texts: [list(x) for x in zip(*map(measure, texts))], text, fields)


def base_failed(p: RuleParams) -> Column:
    n = F.col("_q_n_words")
    return (n < p.min_words) | (100 * F.col("_q_n_repeat_words") > p.max_repeat_pct * n)


def own_rules(p: RuleParams) -> dict[str, Column]:
    """Rules beside the base rule; true: the document fails."""
    q = lambda m: F.col(f"_q_{m}")
    return {
        "symbols": 100 * q("n_symbols") > p.max_symbols_per_100_words * q("n_words"),
        "dup_lines": 100 * q("n_dup_lines") > p.max_dup_line_pct * q("n_lines"),
        "same_next": 100 * q("n_same_next") > p.max_same_next_pct * q("n_words"),
        "word_chars": (q("word_chars") < p.min_word_chars * q("n_words")) | (q("word_chars") > p.max_word_chars * q("n_words")),
    }


def _failures(p: RuleParams) -> dict[str, Column]:
    return {"base": base_failed(p), **own_rules(p)}


def _host(host: str | None) -> Column:
    return F.coalesce(F.col(host).cast("string"), F.lit("")) if host else F.lit("")


def host_rates(found: DataFrame, p: RuleParams, host: str = "_q_host") -> DataFrame:
    """Per host: documents, failures of each rule and of any rule, the shrunk rate, the verdict.

    The prior is a beta distribution with the overall rate as mean. Its strength
    comes from the spread of host rates by the moment estimator for
    beta-binomial counts (weights: documents per host). A host is rejected where its
    posterior, taken as normal, lies with the stated certainty above `max_host_excess` times
    the rate of all other hosts, between `host_bounds`. The others, as one host may hold most
    failures of a table; a table's only host has to exceed the upper bound.
    """
    fails = _failures(p)
    any_rule = F.lit(False)
    for c in fails.values():
        any_rule = any_rule | c
    hosts = found.groupBy(F.col(host).alias("host")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(any_rule).alias("n_failed"),
        *[F.count_if(c).alias(f"n_{k}") for k, c in fails.items()],
    )
    hosts = cut(hosts, "host-failures")
    # Three sums over hosts: one row.
    t = hosts.agg(F.count(F.lit(1)).alias("h"), F.sum("n").alias("n"), F.sum("n_failed").alias("f"),
                  F.sum(F.col("n").cast("double") * F.col("n")).alias("n2"),
                  F.sum(F.col("n_failed").cast("double") * F.col("n_failed") / F.col("n")).alias("f2n")).first()
    alpha, beta = beta_prior(t["h"], t["n"] or 0, t["f"] or 0, t["n2"] or 0.0, t["f2n"] or 0.0, p.flat_strength)
    shrunk = (F.col("n_failed") + F.lit(alpha)) / (F.col("n") + F.lit(alpha + beta))
    spread = F.sqrt(F.col("host_rate") * (1 - F.col("host_rate")) / (F.col("n") + F.lit(alpha + beta + 1)))
    others = F.coalesce((F.lit(t["f"] or 0) - F.col("n_failed")) / F.nullif(F.lit(t["n"] or 0) - F.col("n"), F.lit(0)), F.lit(1.0))
    bound = F.least(F.lit(p.host_bounds[1]), F.greatest(F.lit(p.host_bounds[0]), p.max_host_excess * others))
    return hosts.withColumn("host_rate", shrunk).withColumn("host_rejected", F.col("host_rate") - p.host_deviations * spread > bound)


def beta_prior(h: int, n: int, f: int, n2: float, f2n: float, flat: float) -> tuple[float, float]:
    """alpha and beta from: hosts, documents, failures, sum n^2, sum f^2/n."""
    if n == 0:
        return 0.5, 0.5
    m = f / n
    if m in (0.0, 1.0):
        return flat * m, flat * (1 - m)
    spread = (f2n - n * m * m) / (m * (1 - m))
    room = n - n2 / n - (h - 1)
    rho = (spread - (h - 1)) / room if room > 0 else 0.0
    strength = flat if rho <= 1 / (1 + flat) else 1 / min(rho, 1.0) - 1
    return strength * m, strength * (1 - m)


def judge(docs: DataFrame, text: str = "text", host: str | None = "source", p: RuleParams = RuleParams()) -> DataFrame:
    """docs with the measures, base_failed, own failures, host_rate and kept, all named _q_*.

    A document is kept if it passes the base rule and its own rules and its host is
    not rejected. Measuring happens twice, once for the host counts on slim columns
    and once on the rows that flow on: cheaper than moving or storing the texts.
    """
    slim = docs.select(F.col(text).alias("_q_text"), _host(host).alias("_q_host"))
    hosts = host_rates(measured(slim, "_q_text").drop("_q_text"), p)
    return verdicts(measured(docs, text).withColumn("_q_host", _host(host)), hosts, p)


def verdicts(found: DataFrame, hosts: DataFrame, p: RuleParams) -> DataFrame:
    """Joins the verdict of the host to measured documents."""
    hosts = cut(hosts.select(F.col("host").alias("_q_host"), F.col("host_rate").alias("_q_host_rate"),
                             F.col("host_rejected").alias("_q_host_rejected")), "host-verdicts")
    own = own_rules(p)
    failed = F.lit(False)
    for c in own.values():
        failed = failed | c
    out = found.join(hosts, "_q_host", "left")
    out = out.withColumn("_q_base_failed", base_failed(p))
    out = out.withColumn("_q_failed_rules", F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in own.items()])))
    return out.withColumn("_q_kept", ~F.col("_q_base_failed") & ~failed & ~F.coalesce(F.col("_q_host_rejected"), F.lit(False)))


def filter_documents(docs: DataFrame, text: str = "text", host: str | None = "source", p: RuleParams = RuleParams()) -> DataFrame:
    """The rows of docs that the rules keep, with the columns of docs."""
    return judge(docs, text, host, p).where("_q_kept").select(*[F.col(f"`{c}`") for c in docs.columns])


def rule_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str | None = "source",
               p: RuleParams = RuleParams()) -> DataFrame:
    """One slim row per document with all measures and verdicts.

    Measures are written once: the host counts and the join back both read them.
    """
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_q_text"), _host(host).alias("_q_host"))
    found = cut(measured(slim, "_q_text").drop("_q_text"), "measures")
    return verdicts(found, host_rates(found, p), p)
