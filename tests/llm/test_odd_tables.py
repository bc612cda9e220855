"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names."""

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barloom.llm import (chosen_path, decontaminate, html_text, language_id, license_scan, line_crf, quality_rules,
                         sentencepiece_codec, tool_calls, warc)

GOOD = "The quick brown fox jumps over a lazy dog near the river bank while seven small birds sing of rain and of wind today"
LONG = "\n".join(f"line {i} holds word{i % 997} and word{i % 991} of text number{i}" for i in range(4000))
ROWS = [
    (1, GOOD, "en", "s0", 1), (2, None, "en", "s0", None), (3, "", None, None, 0), (4, LONG, "en", "s0", 5), (5, GOOD, "en", "s1", 1),
    (5, GOOD, "en", "s1", 1), (None, GOOD, "de", None, 1), (6, "   \n \t", "de", "s1", 3), (7, "#### $$$$ ***", None, "s1", 4),
    (8, "été où naïve façade 日本語 ▁ \U0001f642", "fr", "s2", 2), (9, GOOD + " " + GOOD, "en", "s2", 2), (10, "a", "de", "s2", 2),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    """With further columns under names that the operators use themselves."""
    docs = spark.createDataFrame(ROWS, SCHEMA)
    for name in ("key", "host", "word", "h", "n", "score_", "item", "node", "path", "level", "value"):
        docs = docs.withColumn(name, F.lit(name))
    return docs


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "brown fox jumps over a LAZY dog near the river bank"), (2, None), (3, ""), (4, "word5 and word5"), (4, "word5 and word5"), (None, "small birds sing")],
                                 "item_id long, text string")


def test_quality_rules(odd, none):
    rows = quality_rules.rule_table(odd).collect()
    assert len(rows) == len(ROWS)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert by[1][0]._q_kept and len(by[5]) == 2 and all(r._q_kept for r in by[5]) and by[None][0]._q_kept
    assert by[2][0]._q_n_words == 0 and by[2][0]._q_base_failed and not by[3][0]._q_kept
    assert by[4][0]._q_n_words == 4000 * 9 and by[9][0]._q_n_repeat_words == 48
    kept = quality_rules.filter_documents(odd)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "4", "5", "5", "None"]
    assert quality_rules.rule_table(none).count() == 0 and quality_rules.filter_documents(none).count() == 0


def test_line_crf(odd, none):
    labelled = odd.withColumn("quality", F.when(F.col("doc_id").isin(1, 5, 4), 1).when(F.col("doc_id").isin(7, 9), 0))
    model = line_crf.train(labelled)
    rows = line_crf.scored(odd, model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.text == GOOD}) == 1
    assert line_crf.train(labelled.where("quality = 1")) is None
    assert {r.score for r in line_crf.scored(odd, None).collect()} == {1.0}
    assert line_crf.train(none.withColumn("quality", F.lit(1))) is None and line_crf.scored(none, model).count() == 0


def test_language_id(odd, none):
    model = language_id.train(odd)
    rows = language_id.predicted(odd.drop("score_"), model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    pred = {r.doc_id: (r.lang_pred, r.score) for r in rows}
    assert pred[2] == pred[3] == pred[6] == pred[7] == ("und", 0.0)
    assert pred[4][0] == "en" and pred[8][0] == "fr"
    assert language_id.train(none) is None
    assert {r.lang_pred for r in language_id.predicted(odd, None).collect()} == {"und"}
    assert language_id.predicted(none, model).count() == 0


def test_decontaminate(odd, none, bench):
    rows = decontaminate.report(odd, bench).collect()
    assert len(rows) == len(ROWS)
    got = {r.doc_id: (r.n_words, r.n_hit, r.items) for r in rows}
    assert got[1] == (24, 11 + 3, ["", "1"]) and got[5] == got[1] and got[None] == got[1]
    assert got[2] == got[3] == (0, 0, []) and got[9] == (48, 28, ["", "1"])
    assert got[4][2] == ["4"]  # places where both counters agree
    kept = decontaminate.decontaminated(odd, bench)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 6, 7, 8, 10]
    assert decontaminate.decontaminated(odd, bench.where("false")).count() == len(ROWS)
    assert decontaminate.report(none, bench).count() == 0


def test_chosen_path(odd, none):
    rows = chosen_path.near_duplicates(odd).collect()
    assert len(rows) == len(ROWS)
    got = {r.doc_id: (r.class_id, r.n_links) for r in rows}
    # The doubled text has 20 of 24 shingles in common.
    assert got[1] == got[5] == got[None] == got[9] == (1, 4)
    assert got[2] == (2, 0) and got[3] == (3, 0) and got[4] == (4, 0) and got[10] == (10, 0)
    kept = chosen_path.deduplicated(odd)
    assert kept.columns == odd.columns
    # Rows without an id stay.
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "2", "3", "4", "6", "7", "8", "10", "None"])
    assert chosen_path.near_duplicates(none).count() == 0 and chosen_path.deduplicated(none).count() == 0


def test_sentencepiece(odd, none):
    v = sentencepiece_codec.Vocabulary.load()
    rows = sentencepiece_codec.checked(odd, v).collect()
    assert len(rows) == len(ROWS) and all(r.round_trip for r in rows)
    assert {len(r.ids) for r in rows if not r.text} == {0}
    assert sentencepiece_codec.checked(none, v).count() == 0


def test_license_scan(odd, none, spark):
    assert license_scan.scan(license_scan.corpus_files(odd)).count() == len(ROWS)
    assert license_scan.scan(license_scan.corpus_files(none)).count() == 0
    files = spark.createDataFrame([
        ("/a/LICENSE", "Licensed under the Apache License, Version 2.0."), ("/LICENSE", "x\nreleased under the MIT license"), ("/a/b/c.txt", GOOD), ("/a/b/c.txt", GOOD),
        ("/z/q.py", None), (None, "Released under the MIT License"), ("/a/own.txt", GOOD + "\nLicensed under CC BY-NC 4.0"), ("/a/COPYING.md", "Licensed under the Apache License, Version 2.0"),
        ("/k/LICENSE", ""), ("/k/f", LONG)], "path string, text string")
    got = {r.path: (r.stated, r.inherited, r.from_dir, r.in_force) for r in license_scan.scan(files).collect()}
    assert got["/a/b/c.txt"] == (None, "Apache-2.0", "/a", "Apache-2.0")
    assert got["/z/q.py"] == (None, "MIT", "", "MIT") == got["/k/f"]
    assert got["/a/own.txt"] == ("CC-BY-NC-4.0", None, None, "CC-BY-NC-4.0")
    assert got[None] == (None, None, None, None)


def test_html(spark):
    page = "<html><body><nav>menu</nav><article><h1>T</h1><p>one&amp;two <b>x</b><p>y</article><footer>f</footer></body></html>"
    pages = spark.createDataFrame([(1, "http://a.com/x", page), (2, None, None), (3, "", ""), (1, "http://a.com/x", page), (4, "http://a.com/long", "<p>" + "w " * 100000),
                                   (5, "bad url", "no tags <3")], "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("path", F.lit(2))
    out = html_text.extracted(pages)
    rows = out.collect()
    assert out.columns == [*pages.columns, "text_"] and len(rows) == 6
    got = {r.page_id: r.text_ for r in rows}
    assert got[1] == "T\n\none&two x\n\ny" and got[2] == got[3] == "" and len(got[4]) == 199999 and got[5] == "no tags <3"
    assert html_text.extracted(pages.where("false")).count() == 0


def test_warc(spark):
    pages = spark.createDataFrame([(3, "u", "abc"), (1, None, "abc"), (2, "a\r\nb", "é" * 50000), (4, "u", None), (5, "u", ""), (None, "u", "abc"), (None, "u", "only"), (7, "u", "x"), (7, "u", "x")],
                                  "page_id long, url string, html string").withColumn("payload", F.lit(0)).withColumn("record_id", F.lit(0))
    rows = warc.round_trip(pages).collect()
    assert len(rows) == 9 and all(r.verified for r in rows)
    got = collections.Counter((r.record_id, r.record_type, r.refers_to, r.payload_bytes) for r in rows)
    assert got == {("1", "response", None, 3): 1, ("3", "revisit", "1", 3): 1, ("2", "response", None, 100000): 1, ("4", "response", None, 0): 1, ("5", "revisit", "4", 0): 1,
                   ("null", "revisit", "1", 3): 1, ("null", "response", None, 4): 1, ("7", "response", None, 1): 2}
    for r in rows:
        assert bytes(r.record).startswith(b"WARC/1.1\r\n") and bytes(r.record).endswith((b"" if r.record_type == "revisit" else bytes(r.payload)) + b"\r\n\r\n")
    assert warc.round_trip(pages.where("false")).count() == 0
    few = warc.round_trip(pages, min_bytes=4).where("payload_bytes = 3").collect()
    assert {r.record_type for r in few} == {"response"}


def test_tool_calls(spark):
    calls = spark.createDataFrame([
        ("c", 0, "a", "ask", '{"words": 1, "query": "q", "first": true}', None), ("c", 1, "b", "ask", '{"query":"x","words":"2"}', ["a"]),
        ("c", 2, "d", "ask", '{"query":"x"', ["b", "a", None]), ("c", 3, "e", "none", "{}", ["zz"]), ("c", 4, "f", "ask", "[1]", ["g"]), ("c", 5, "g", "ask", None, ["f"]),
        ("c", 6, "w", "ask", '{"query":"z","words":3}', ["g"]), (None, 0, "a", "ask", '{"query":"z","words":3}', None), ("c", 7, None, None, None, None),
        ("c", 8, "t", "ask", '{"query":null,"words":1,"more":2}', []), ("c", 8, "t", "ask", '{"query":null,"words":1,"more":2}', []),
        ("k", 1, "long", "ask", '{"words":5,"query":"' + "y" * 200000 + '"}', []),
    ], "conv_id string, turn int, call_id string, tool string, arguments string, depends_on array<string>").withColumn("level", F.lit(9)).withColumn("row_", F.lit(9))
    results = spark.createDataFrame([("c", "a", 9, "late"), ("c", "a", 1, 'r"1'), ("c", "b", 2, None), (None, "a", 1, "x"), ("c", None, 1, "x"), ("k", "long", 2, "ok")],
                                    "conv_id string, call_id string, turn int, content string")
    schemas = spark.createDataFrame(tool_calls.SCHEMAS, "tool string, field string, type string, required boolean")
    out = tool_calls.formatted(calls, results, schemas)
    rows = out.collect()
    assert len(rows) == 12
    got = {(r.conv_id, r.call_id): r for r in rows}
    a = got["c", "a"]
    assert a.valid and a.level == 0 and a.n_results == 2 and a.result_turn == 1
    assert a.message == '{"arguments":{"first":true,"query":"q","words":1},"id":"a","name":"ask","result":"r\\"1"}'
    assert got["c", "b"].errors == ["type:words"] and got["c", "b"].level == 1 and got["c", "d"].level == 2
    assert got["c", "d"].errors == ["arguments", "no_result"] and got["c", "e"].errors == ["dependency", "no_result", "tool"]
    assert "cycle" in got["c", "f"].errors and "cycle" in got["c", "w"].errors and got["c", "w"].level is None
    assert got["c", "t"].errors == ["duplicate", "missing:query", "no_result", "unknown:more"]
    assert got[None, "a"].errors == ["id", "no_result"] and got["k", "long"].valid
    assert tool_calls.formatted(calls.where("false"), results.where("false"), schemas).count() == 0


def test_pipeline_on_odd_rows(spark, odd, none, tmp_path):
    docs = odd.select(*SCHEMA.replace(" long", "").replace(" string", "").split(", "))
    for name, df in (("documents", docs), ("labels", spark.createDataFrame([(1, 1, 0), (7, 0, 0), (9, None, 0)], "doc_id long, quality int, toxic int")),
                     ("benchmark", spark.createDataFrame([(1, None)], "item_id long, text string"))):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    for _, stage in corpus_pipeline.STAGES:
        before, docs = docs.columns, stage(spark, docs, str(tmp_path))
        assert docs.columns[: len(before)] == before
    # Of the copies one stays beside the row without id.
    assert sorted(str(r.doc_id) for r in docs.collect()) == ["1", "4", "None"]
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, str(tmp_path))
    assert none.count() == 0
