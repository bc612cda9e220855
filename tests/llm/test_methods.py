"""The methods against brute force, round trips and held-out accuracy."""

import collections
import itertools
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from barloom.llm import catalog, chosen_path, decontaminate, html_text, language_id, license_scan, line_crf, quality_rules, sentencepiece_codec
from tools.check import TABLES, norm

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    cur = duck.execute(catalog.ORACLES[name])
    have = [c[0] for c in cur.description]
    assert sorted(have) == cols
    order = [have.index(c) for c in cols]
    want = collections.Counter(tuple(norm(r[i]) for i in order) for r in cur.fetchall())
    assert collections.Counter(tuple(norm(v) for v in r) for r in df.select(*cols).collect()) == want


def test_queries_and_pipeline_are_registered():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names
    assert [n for n in catalog.QUERIES if n not in catalog.ORACLES] == ["op2_quality_classifier", "op6_language_id", "op8_html_extraction", "op10_sentencepiece"]


def test_crf_marginals_are_those_of_all_paths():
    rng = np.random.default_rng(1)
    sizes = np.array([3, 1, 5, 2])
    unary, trans = rng.normal(size=(11, 2)), rng.normal(size=(2, 2))
    probs, pairs = line_crf.marginals(unary, trans, sizes, pairs=True)
    want_pairs, at = np.zeros((2, 2)), 0
    for n in sizes:
        total, single, double = 0.0, np.zeros((n, 2)), np.zeros((2, 2))
        for path in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(unary[at + i, s] for i, s in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:])))
            total += w
            for i, s in enumerate(path):
                single[i, s] += w
            for a, b in zip(path, path[1:]):
                double[a, b] += w
        assert np.allclose(probs[at:at + n], single / total)
        want_pairs += double / total
        at += n
    assert np.allclose(pairs, want_pairs)


def test_crf_neighbours_stay_in_their_document():
    x = line_crf.with_neighbours(np.array([[1.0], [2.0], [3.0]]), np.array([2, 1]))
    assert x.tolist() == [[1, 0, 2], [2, 1, 0], [3, 0, 0]]


def test_classifier_held_out(spark):
    rows = catalog.QUERIES["op2_quality_classifier"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(rows) > 50 and all(r.predicted == (r.score >= 0.3) for r in rows)
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.97
    assert all(r.predicted == 1 for r in rows if r.quality == 1)


def test_language_held_out(spark):
    rows = catalog.QUERIES["op6_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.98


def plain_viterbi(v, text):
    """Best total score by trying all pieces at all places; bytes for characters without a piece."""
    known = {p: s for p, s, ok in zip(v.pieces, v.scores, v.normal) if ok and p}
    best = [0.0] + [None] * len(text)
    for e in range(1, len(text) + 1):
        for s in range(max(0, e - 20), e):
            if text[s:e] in known and best[s] is not None and (best[e] is None or best[s] + known[text[s:e]] > best[e]):
                best[e] = best[s] + known[text[s:e]]
        if best[e] is None:
            best[e] = best[e - 1]
    return best[-1]


def test_pieces_have_the_best_score(spark):
    v = sentencepiece_codec.Vocabulary.load()
    codec = sentencepiece_codec.Codec(v)
    texts = [r[0][:600] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(60).collect()] + ["日本語 text\nwith  spaces 🙂 and ñ", " x"]
    special = set(v.byte_ids.values())
    for t in texts:
        ids = codec.encode(t)
        assert sentencepiece_codec.Decoder(v)(ids) == t
        assert abs(sum(v.scores[i] for i in ids if i not in special) - plain_viterbi(v, "▁" + t.replace(" ", "▁"))) < 1e-6


def test_piece_cache_does_not_change_ids():
    v = sentencepiece_codec.Vocabulary.load()
    a, b = sentencepiece_codec.Codec(v), sentencepiece_codec.Codec(v)
    words = ["".join(random.Random(i).choices("abcdeé ", k=9)) for i in range(300)]
    old, sentencepiece_codec.KEPT_WORDS = sentencepiece_codec.KEPT_WORDS, 7
    try:
        assert [a.encode(w) for w in words * 2] == [[i for part in sentencepiece_codec.CHUNK.findall("▁" + w.replace(" ", "▁")) for i in b.viterbi(part)] for w in words * 2]
    finally:
        sentencepiece_codec.KEPT_WORDS = old


def test_winnowing_finds_every_shared_span(spark):
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(12)]
    docs = [(i, " ".join(rnd.choices(vocabulary, k=rnd.randrange(0, 80)))) for i in range(60)]
    items = [(i, " ".join(docs[i][1].split()[3:3 + rnd.randrange(1, 25)])) for i in range(40)] + [(99, "w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1")]
    docs.append((60, " ".join(["w1"] * 40)))
    got = {r.doc_id: (r.n_hit, r["items"]) for r in decontaminate.report(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for i, text in docs:
        ws, hit, found = text.split(), set(), set()
        for k, item in items:
            it = item.split()
            m = min(10, len(it))
            for s in range(len(it) - m + 1) if m else ():
                for p in range(len(ws) - m + 1):
                    if ws[p:p + m] == it[s:s + m]:
                        hit.update(range(p, p + m))
                        found.add(str(k))
        assert got[i] == (len(hit), sorted(found)), i


def test_chosen_path_finds_planted_pairs(spark, monkeypatch):
    """Small limits force several levels, dense nodes, and blocks."""
    monkeypatch.setattr(chosen_path, "LIMIT", 4)
    monkeypatch.setattr(chosen_path, "MAX_LEVELS", 3)
    monkeypatch.setattr(chosen_path, "BLOCK", 5)
    rnd = random.Random(3)
    shared = [f"passage{i}" for i in range(30)]
    docs = []
    for g in range(12):
        base = [f"t{g}x{rnd.randrange(400)}" for _ in range(120)]
        for _ in range(rnd.choice([1, 2, 30])):
            ws = list(base)
            for _ in range(rnd.randrange(0, 5)):
                ws[rnd.randrange(len(ws))] = f"n{rnd.randrange(10**6)}"
            docs.append(" ".join(ws + shared))
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    sets = [set(chosen_path.shingles(t).tolist()) for t in docs]
    n = len(docs)
    near = [[5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) for j in range(n)] for i in range(n)]
    root = list(range(n))
    for _ in range(n):
        root = [min(root[j] for j in range(n) if near[i][j]) for i in range(n)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in chosen_path.near_duplicates(df).collect()}
    assert got == {i: (root[i], sum(near[i]) - 1) for i in range(n)}


def test_runs_reach_the_target():
    assert chosen_path.runs_for(0.9) < chosen_path.runs_for(0.9999) <= 6


def test_sketch_loses_few_pairs_at_the_threshold():
    n, p = chosen_path.COORDINATES, 0.8 + 0.2 / 16
    lost = sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(chosen_path.LEAST_AGREEMENT))
    assert lost < (1 - chosen_path.TARGET_RECALL) / 20


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(bytes([i]), bytes([i + 1])) for i in range(40)] + [(bytes([100]), bytes([101]))], "a binary, b binary")
    got = {r.key[0]: r.root[0] for r in chosen_path.components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_repeated_words_by_brute_force():
    rnd = random.Random(2)
    for _ in range(300):
        ws = [rnd.choice([b"a", b"b"]) if rnd.random() < 0.9 else b"c%d" % rnd.randrange(5) for _ in range(rnd.randrange(0, 60))]
        grams = collections.Counter(tuple(ws[i:i + 8]) for i in range(len(ws) - 7))
        want = {p for i in range(len(ws) - 7) if grams[tuple(ws[i:i + 8])] > 1 for p in range(i, i + 8)}
        assert quality_rules.repeated_words(ws) == len(want)


@pytest.mark.parametrize(("failing", "goes"), [(10, False), (25, False), (50, True), (70, True), (90, True)])
def test_host_verdict_follows_the_prior(spark, failing, goes):
    """Twelve hosts of 200 documents, ten of a hundred failing, beside one with other shares."""
    good = "a short but sound text of some twenty words and more that says what it has to say about rain wind and sun today"
    shares = {f"h{i}": 10 for i in range(12)} | {"other": failing}
    rows = [(200 * k + i, "junk" if i < 2 * share else good, host) for k, (host, share) in enumerate(shares.items()) for i in range(200)]
    kept = {r.doc_id for r in quality_rules.filter_documents(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert kept == {d for d, text, host in rows if text == good and not (goes and host == "other")}


def test_few_documents_reject_no_host(spark):
    good = "a short but sound text of some twenty words and more that says what it has to say about rain wind and sun today"
    rows = [(i, good if i % 10 else "junk", f"h{i % 7}") for i in range(1400)] + [(9000, "junk", "new"), (9001, good, "new")]
    kept = {r.doc_id for r in quality_rules.filter_documents(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert 9001 in kept and len(kept) == 1261


def plain_language(model, text):
    """The dealt rule with dictionaries only: no arrays, no caches."""
    langs, known = model["langs"], [{g: table[i].tolist() for g, i in at.items()} for at, table in model["tables"]]
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    if not words:
        return "und", 0.0
    total = [0.0] * len(langs)
    for word in words:
        if word in known[0]:
            scores = [known[0][word]]
        else:
            marked, scores = f"<{word}>", []
            for i in range(len(marked)):
                hit = next((known[n][marked[i:i + n]] for n in range(model["max_gram"], 0, -1) if len(marked[i:i + n]) == n and marked[i:i + n] in known[n]), None)
                scores += [hit] if hit else []
        for k in range(len(langs)):
            total[k] += sum(s[k] for s in scores) / max(len(scores), 1)
    best = max(range(len(langs)), key=lambda k: (total[k], -k))
    return langs[best], 1 / sum(math.exp(max(t - total[best], -700)) for t in total)


def test_language_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model = language_id.train(docs.where("doc_id % 3 = 0"))
    rows = language_id.predicted(docs, model).collect()
    assert len(rows) == docs.count()
    for r in rows:
        lang, score = plain_language(model, r.text)
        assert r.lang_pred == lang and abs(r.score - score) < 1e-6
    scorer = language_id.Scorer(model)
    assert {scorer(t) for t in ("\u00bd \u00b2 \u2460", "12 _ 3", "", None, "\u2167!")} == {("und", 0.0)}
    assert language_id.tokens("a\u00bdb \u00c9t\u00e9") == ["a", "b", "\u00e9t\u00e9"]


def test_bad_host_takes_its_documents(spark):
    good = "a short but sound text of some twenty words and more that says what it has to say about rain wind and sun today"
    rows = [(i, "junk", "bad") for i in range(400)] + [(1000, good, "bad")] + [(2000 + i, good, f"h{i % 9}") for i in range(400)]
    kept = {r.doc_id for r in quality_rules.filter_documents(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert kept == {2000 + i for i in range(400)}


def test_prefix_terms_lose_no_line():
    idf, other, units = license_scan.weights()
    some, together = license_scan.needed_terms(units, 0.8)
    for unit in units:
        rest = {t: x for t, x in unit.items() if t not in some}
        if sum(x * x for x in rest.values()) >= 0.8**2:
            must = [ts for ts in together if set(ts) <= set(rest)]
            assert must and all(sum(x * x for t, x in rest.items() if t != one) < 0.8**2 for one in must[0])


@pytest.mark.parametrize(("page", "want"), [
    ("<body><div class='top-nav'>x</div><div id=c><p>a<p>b<ul><li>c<li>d</ul></div><div class=sidebar><p>s</div></body>", "a\n\nb\n\nc\n\nd"),
    ("<article><header>by me</header><p>a &lt;b&gt; &#233;\n\n c<script>if (x<y) '</p>'</script>!</p><div class='ad'>buy</div><section id=comments><p>no</p></section></article>", "a <b> é c!"),
    ("<div class='has-sidebar main'><p>one<br>two</p><form><p>mail</p></form></div><aside>z</aside>", "one two"),
    ("<table><tr><td>cell one<td>cell two</table>", "cell one\n\ncell two"),
    ("<p>open <b>bold <i>both</b> rest</i> end", "open bold both rest end"),
    ("<style>p{}</style><!-- <p>no</p> --><p title='a>b'>yes</p>", "yes"),
])
def test_html_cases(page, want):
    assert html_text.main_text(page, None) == want


def test_host_path_wins_over_own_best(spark):
    page = lambda body, extra: f"<html><body><div class='post-{len(body)}'><p>{body}</p></div><div class='box'><p>{extra}</p></div></body></html>"
    rows = [(i, "http://h.org/a", page("article text number " + "x " * 50, "box")) for i in range(5)] + [(9, "http://h.org/b", page("short article", "long box " * 60))]
    got = {r.page_id: r.text_ for r in html_text.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9] == "short article"


def test_pipeline_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = [{r.doc_id for r in df.select("doc_id").collect()} for df in stages(spark, docs)]
    rules = {r.doc_id for r in catalog.QUERIES["op5_quality_rules"](spark, SF).where("kept").collect()}
    assert got[0] == rules
    score = {r.doc_id: r.score for r in catalog.QUERIES["op2_quality_classifier"](spark, SF).collect()}
    assert got[1] == {i for i in got[0] if score[i] >= 0.3}
    sets = {i: set(chosen_path.shingles(texts[i]).tolist()) for i in got[1]}
    at = collections.defaultdict(set)
    for i, s in sets.items():
        for g in s:
            at[g].add(i)
    root = {i: i for i in sets}
    near = {i: [j for j in set().union(*(at[g] for g in s)) if 5 * len(s & sets[j]) >= 4 * len(s | sets[j])] if s else [i] for i, s in sets.items()}
    for _ in range(20):
        root = {i: min(root[j] for j in near[i]) for i in sets}
    assert got[2] == {i for i in sets if root[i] == i}
    items = [decontaminate_words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {tuple(w[k:k + min(10, len(w))]) for w in items for k in range(max(len(w) - 9, 1)) if w}
    clean = {i for i in got[2] if not any(tuple(w[k:k + 10]) in windows for w in [decontaminate_words(texts[i])] for k in range(len(w)))}
    assert got[3] == clean == got[4]


def stages(spark, docs):
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut(stage(spark, docs, SF), "stage")
        yield docs


def decontaminate_words(text):
    lower = (text or "").translate(str.maketrans(decontaminate.UPPER, decontaminate.LOWER))
    import re

    return [w for w in re.split(decontaminate.SEPARATORS, lower) if w]


WRAPPED = "# This work is licensed under the GNU\n# General Public License, version 3.\nimport x\n"
APACHE = '/*\n * Copyright 2020 A\n *\n * Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with\n * the License. You may obtain a copy at x.\n */\nint a;\n'
MIT_NARROW = "Permission is hereby\ngranted, free of charge,\nto any person obtaining\na copy of this software\nand associated documentation\nfiles (the \"Software\"), to\ndeal in the Software without\nrestriction, including\n" \
    "without limitation the\nrights to use, copy, modify,\nmerge, publish, distribute,\nsublicense, and/or sell\ncopies of the Software, and\nto permit persons to whom\nthe Software is furnished\nto do so, subject to the\nfollowing conditions:\n"


def test_wrapped_headers_and_full_licence_texts(spark):
    files = [("/w/a.py", WRAPPED), ("/h/a.c", APACHE), ("/m/LICENSE", MIT_NARROW), ("/m/sub/x.py", "x = 1"), ("/p/LICENSE", "the permission of the night " * 50)]
    files += [(f"/full/{name}/COPYING", text) for name, text in license_scan.FULL_TEXTS]
    files += [(f"/folded/{name}/COPYING", "\n".join(text.split()[10:])) for name, text in license_scan.FULL_TEXTS]
    files += [(f"/notice/{k}/{name}/a.c", "\n".join(f" * {w}" for w in text.split()) + "\n\nint b;") for k, (name, text) in enumerate(license_scan.NOTICES)]
    got = {r.path: r.in_force for r in license_scan.scan(spark.createDataFrame(files, "path string, text string")).collect()}
    assert (got["/w/a.py"], got["/h/a.c"], got["/m/LICENSE"], got["/m/sub/x.py"], got["/p/LICENSE"]) == ("GPL-3.0", "Apache-2.0", "MIT", "MIT", None)
    assert {p: v for p, v in got.items() if p.count("/") > 2 and p[1] in "fn" and v != p.split("/")[-2]} == {}


BODY = "<h1>Head</h1><p>An article of some length that has to stay.</p>"


@pytest.mark.parametrize("page", [
    f"<body><div class='layout-with-sidebar'>{BODY}<div class=sidebar>s</div></div></body>",
    f"<body><div class='content-header-visible'>{BODY}<div class='comments'>c</div></div></body>",
    f"<body><form id='aspnetForm'>{BODY}<form class=search>find</form></form></body>",
    f"<body><svg viewBox='0 0'/>{BODY}<svg><text>t</text></svg></body>",
    f"<body><math/><iframe src='x' /><object>{BODY}</body>",
    f"<body><svg><svg><text>a</text></svg><text>b</text></svg>{BODY}<noscript></body>",
    f"<head><title>t</title><body>{BODY}<div class=comments>{'<p>long comments of others</p>' * 4}</div>",
])
def test_noise_around_the_article_does_not_reject_it(page):
    assert html_text.main_text(page, None) == "Head\n\nAn article of some length that has to stay."


@pytest.mark.parametrize("noise", ["comments", "sidebar", "cookie-notice", "newsletter", "related-posts", "ad"])
@pytest.mark.parametrize("outer", ["<article>{0}</article>{1}", "<article>{0}{1}</article>", "<div class=post>{0}</div>{1}", "{1}<main>{0}</main>", "<form id=aspnetForm>{0}{1}</form>"])
def test_noise_goes_however_long_it_is(noise, outer):
    much = f"<div class='{noise}'>" + "<p>words of somebody else that are not part of it</p>" * 60 + "</div>"
    page = "<body>" + outer.format("<h1>Head</h1><p>A short article.</p>", much) + "</body>"
    assert html_text.main_text(page, None) == "Head\n\nA short article."


def test_menu_of_links_beside_loose_text():
    page = "<body><ul><li><a href=/>Home</a><li><a href=/about>About</a></ul><h1>Head</h1><p>Text of its own.</p></body>"
    assert html_text.main_text(page, None) == "Head\n\nText of its own."


def test_pages_are_extracted_by_winning_paths(spark):
    """A page whose own pick is too wide is corrected by the host's path; names of columns do not matter."""
    long = ("word " * 80).strip()
    page = "<body><div class=wrap><div class=post{2}><h1>{0}</h1><p>%s</p></div>{1}</div></body>" % long
    rows = [(i, "http://h.org/", page.format(i, "", i)) for i in range(6)] + [(6, "http://h.org/", page.format(6, "<p>Imprint text</p>", 6))]
    rows += [(7, "http://other.org/", page.format(7, "<p>Imprint text</p>", 7)), (8, None, None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(c) for c in ("host", "key", "page", "path", "text", "args", "winners", "host_", "pair_")})
    out = html_text.extracted(frame, path="path_")
    assert out.columns == [*frame.columns, "text_", "path_"]
    got = {r.page_id: r for r in out.collect()}
    assert {i: got[i].text_ for i in range(7)} == {i: f"{i}\n\n{long}" for i in range(7)}
    assert {got[i].path_ for i in range(7)} == {"/body/div.wrap/div.post0"}
    assert got[7].text_.endswith("Imprint text") and got[8].text_ == "" and got[7].pair_ == "pair_"


@pytest.mark.parametrize("inner", [
    "<h1>H</h1><p>lead</p><section><p>{0}</p></section><section><p>{0}</p></section><p>end</p>",
    "<h1>H</h1><div class=intro><p>lead</p></div><div class=body><p>{0}</p><p>{0}</p></div><div class=last>end</div>",
    "<h1>H</h1><p>lead</p><table><tr><td>{0}</td><td>{0}</td></tr></table><p>end</p>",
])
@pytest.mark.parametrize("outer", ["<article>{0}</article>", "<div class=post>{0}</div>"])
def test_article_around_sections_and_tables_is_whole(inner, outer):
    long = ("word " * 80).strip()
    page = "<body><nav>n</nav>" + outer.format(inner.format(long)) + "<footer>f</footer></body>"
    assert html_text.main_text(page, None) == "\n\n".join(["H", "lead", long, long, "end"])


def test_host_with_two_layouts(spark):
    long = ("word " * 80).strip()
    a = f"<body><div class=a><h1>A</h1><p>{long}</p></div></body>"
    b = f"<body><div class=a><p>teaser</p></div><div class=b><h1>B</h1><p>{long}</p></div></body>"
    one = f"<body><div class=a><p>teaser</p></div><div class=c><p>{long}</p></div></body>"
    rows = [(i, "http://h.org/", page) for i, page in enumerate([a] * 7 + [b] * 3 + [one])]
    got = {r.page_id: r.text_ for r in html_text.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"A\n\n{long}" if i < 7 else f"B\n\n{long}" if i < 10 else long for i in range(11)}
