"""Repeated windows, phrases and prefix tries against plain versions, and on odd tables."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from barloom.llm import phrase_index, prefix_trie, repeated_windows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_repeats(rows, length):
    first, out, words = {}, [], [(k, WORD.findall(t or "")) for k, t in rows]
    for k, w in words:
        for i in range(len(w) - length + 1 if k is not None else 0):
            g = tuple(w[i:i + length])
            first[g] = min(k, first.get(g, k))
    for k, w in words:
        gone = set()
        for i in range(len(w) - length + 1 if k is not None else 0):
            if first[tuple(w[i:i + length])] < k:
                gone.update(range(i, i + length))
        out.append((k, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return collections.Counter(out)


def texts_with_passages(seed, n=60, words=9):
    """Few words, so that parts of windows repeat everywhere, and passages of several lengths."""
    rng = random.Random(seed)
    prose = lambda m: [f"w{rng.randrange(words)}" for _ in range(m)]
    passages = [prose(m) for m in (7, 8, 9, 15, 16, 40)]
    rows = []
    for k in range(n):
        w = prose(rng.randrange(30))
        for _ in range(rng.randrange(3)):
            w += rng.choice(passages) + prose(rng.randrange(12))
        rows.append((rng.choice([k, k, k, 7, None]), rng.choice([" ", "\n", " \t "]).join(w)))
    return rows + rows[:8] + [(100, rows[3][1]), (-5, rows[4][1]), (101, None), (102, ""), (103, " \n"), (104, "été  x " * 9)]


@pytest.mark.parametrize("hot", [2000, 1])
@pytest.mark.parametrize("length", [8, 5])
def test_repeated_windows(spark, length, hot):
    rows = texts_with_passages(length)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: F.lit(n) for n in ("n_words", "Kept", "txt", "parts", "key", "first")})
    out = repeated_windows.without_repeats(docs, length=length, hot_texts=hot)
    assert out.columns == [*docs.columns, "n_words_", "removed", "kept_"]
    got = out.collect()
    assert all(r.Kept == "Kept" and r.key == "key" for r in got)
    assert collections.Counter((r.doc_id, r.n_words_, sum(s.stop - s.start for s in r.removed), r.kept_) for r in got) == plain_repeats(rows, length)


def test_repeated_windows_of_no_rows_and_long_text(spark):
    assert repeated_windows.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    long = " ".join(f"a{i}" for i in range(300_000))
    docs = spark.createDataFrame([(1, long), (2, "x " + long + " y")], "doc_id long, text string")
    got = {r.doc_id: r for r in repeated_windows.without_repeats(docs).collect()}
    assert got[1].removed == [] and got[2].kept == "x y" and [tuple(s) for s in got[2].removed] == [(1, 300_001)]


def test_longest_repeats_doubles_until_none_survive(spark):
    rows = texts_with_passages(3, words=200)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts, want = {}, {}
    for k, t in rows:
        if t is not None:
            texts[t] = min((x for x in (k, texts.get(t)) if x is not None), default=None)
    length = 5
    while True:
        seen = collections.defaultdict(set)
        for t in texts:
            w = WORD.findall(t)
            for i in range(len(w) - length + 1):
                seen[tuple(w[i:i + length])].add(t)
        found = {t for s in seen.values() if len(s) > 1 for t in s}
        want |= {t: length for t in found}
        if not found:
            break
        length *= 2
    got = repeated_windows.longest_repeats(docs, length=5).collect()
    assert collections.Counter((r.key, r.words) for r in got) == collections.Counter((texts[t], n) for t, n in want.items())
    assert max(want.values()) == 40


def plain_phrases(rows, low, top):
    f, total = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang or "und", tuple(w[i:i + k])] += 1
    out = collections.defaultdict(list)
    for (lang, w), a in f.items():
        if len(w) < 2 or a < low:
            continue
        inside = any(g == lang and len(v) > len(w) and any(v[i:i + len(w)] == w for i in range(len(v))) and 100 * b >= 80 * a for (g, v), b in f.items() if b >= low)
        if not inside:
            score, k = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
            out[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return {(lang, rank, p.decode(), -a, left, right, total[lang], -s) for lang, rows in out.items() for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)}


@pytest.mark.parametrize("shard_words", [300, 10_000_000])
def test_collocations(spark, shard_words):
    rng = random.Random(11)
    words = ["New", "york", "the", "of", "city", "É", "é", "a b", "日本", "x-y"]
    rows = []
    for i in range(240):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", "\n", ".", " new york city "]) for _ in range(rng.randrange(40)))
        rows.append((rng.choice(["en", "en", None, "und", "de"]), text))
    rows += [("en", None), ("en", ""), ("fr", "..."), ("en", "big bang theory show " * 3000)] + rows[:40]
    docs = spark.createDataFrame([(g, t, "x", "y") for g, t in rows], "lang string, text string, phrase string, n string").repartition(3)
    got = phrase_index.collocations(docs, min_count=6, top=25, shard_words=shard_words)
    assert {(r.group, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got.collect()} == plain_phrases(rows, 6, 25)
    both = {r.phrase: (r.left, r.right) for r in got.where("group = 'en'").collect()}
    assert all(0 <= x <= r.a for r in got.collect() for x in (r.left, r.right)) and both
    assert phrase_index.collocations(docs.limit(0)).count() == 0


def test_phrase_extensions(spark):
    docs = spark.createDataFrame([("en", "a b c. a b, x a b")] * 5, "lang string, text string")
    found = {r.phrase: (r.n, r.left, r.right) for r in phrase_index.phrase_counts(phrase_index.shards(docs, "text", "lang", 4), 5, 3).collect()}
    assert found == {"a": (15, 5, 15), "b": (15, 15, 5), "c": (5, 5, 0), "x": (5, 0, 5), "a b": (15, 5, 5), "b c": (5, 5, 0), "x a": (5, 0, 5),
                     "a b c": (5, 0, 0), "x a b": (5, 0, 0)}


@pytest.mark.parametrize("bucket_words", [7, 400, 3000])
def test_phrases_are_summed_once(spark, monkeypatch, bucket_words):
    """Each phrase is summed in one bucket, also below branches that are split; the shards and the frequent phrases of a shard stay where they are."""
    monkeypatch.setattr(phrase_index, "BUCKET_WORDS", bucket_words)
    rng = random.Random(5)
    rows = [(rng.choice(["en", "de", None]), " ".join(rng.choice(["of", "of", "the", "a", "New", "york", "x.", "é", "city"]) for _ in range(rng.randrange(60)))) for _ in range(250)]
    rows += [("en", "of the new york city of the new york"), ("fr", "of the, of the. of")] * 20 + [("fr", f"of the new {w} {w}") for w in "abcdefghij" * 8]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = phrase_index.collocations(docs, min_count=5, top=60, shard_words=200)
    assert {(r.group, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got.collect()} == plain_phrases(rows, 5, 60)
    index = phrase_index.shards(docs, "text", "lang", 200)
    counts = phrase_index.phrase_counts(index, 5)
    assert counts.groupBy("group", "phrase").count().where("count > 1").isEmpty()
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    for depth in (1, 2, 3, 5):
        want, n, left, right = plain_counts(rows, depth)
        assert {(r.group, r.phrase): (r.n, r.left, r.right) for r in phrase_index.phrase_counts(index, 5, depth).collect()} == \
            {k: (n[k], left[k], right[k]) for k in want if n[k] >= 5}


def plain_counts(rows, depth):
    n, left, right = collections.Counter(), collections.Counter(), collections.Counter()
    for lang, text in rows:
        for piece in text.lower().split("."):
            w = piece.replace(",", " , ").split()
            for part in " ".join(w).split(" , "):
                v = part.replace(",", "").split()
                for k in range(1, depth + 1):
                    for i in range(len(v) - k + 1):
                        key = (lang or "und", " ".join(v[i:i + k]))
                        n[key] += 1
                        left[key] += i > 0
                        right[key] += i + k < len(v)
    return set(n), n, left, right


def plain_trie(turns):
    convs = collections.defaultdict(list)
    for c, turn, role, text in turns:
        if c is not None:
            d = hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest()[:16]
            convs[c].append(((turn is not None, turn or 0, d), (role or "", text or "")))
    convs = {c: [x for _, x in sorted(rows, key=lambda r: r[0])] for c, rows in convs.items()}
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c in sorted(convs):
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        path = tuple(convs.get(base, [])[:h] + convs[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    return collections.Counter((m[0], len(p), members[p[:-1]][0] if p else None, len(m), kids[p], leaves[p], saved[p],
                                hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()) for p, m in members.items())


@pytest.mark.parametrize("block_turns", [1, 12, 60, 1 << 20])
def test_prefix_trie(spark, block_turns):
    rng = random.Random(5)
    turns = []
    for c in [*range(-12, 150), 4095, 4096, 9000]:
        n = rng.randrange(12)
        turns += [(c, rng.choice([i, i, i, None, 3]), rng.choice(["user", None, "bot"]) if rng.random() < 0.2 else "user", rng.choice(["é", "hello", None, ""]) if rng.random() < 0.5 else "same") for i in range(n)]
    turns += [(c, i, "user", "copy") for c in range(10_000, 10_060) for i in range(7)] + [(None, 0, "user", "nobody"), (7, 1, "user", "same"), (7, 1, "user", "same")]
    df = spark.createDataFrame([(*t, "x", "y") for t in turns], "conv_id long, turn long, role string, text string, depth string, key string").repartition(3)
    rows = prefix_trie.trie(df, block_turns=block_turns).collect()
    assert collections.Counter(tuple(r) for r in rows) == plain_trie(turns)


def test_prefix_trie_of_no_rows_and_long_conversation(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.trie(none).count() == 0
    long = spark.range(30_000).selectExpr("15 AS conv_id", "id AS turn", "'user' AS role", "cast(id AS string) AS text")
    got = prefix_trie.trie(long).agg(F.count("*"), F.max("depth"), F.sum("n_convs"), F.max("n_leaves"), F.sum("saved_tokens")).head()
    assert tuple(got) == (30_001, 30_000, 30_001, 1, 0)
