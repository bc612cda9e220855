"""Licence scans: every unit against every template in plain Python, and files that are long in one way or another."""

import math
import re
from collections import Counter

from barloom.llm import license_scan as L

SENTENCE = "This work is licensed under the GNU\n{0} General Public License, version 3."
PIECES = [text for _, text in L.TEMPLATES] + [text for _, text in L.NOTICES[:9]] + [
    SENTENCE.format(""), "Copyright 2020 A. Author; all rights reserved", "the public source of software is under version 4.0 terms",
    "by cc nc and licensed", "CC BY SA", "x = 1", "sa nc", "Licensed under: CC BY-NC 4.0! Ok.", "# Released under the\n# MIT\n# License", ""]
MARKS = ["", "# ", "// ", " * ", "-- ", "dnl ", "rem "]


def vector(text, idf, other, sublinear):
    return {t: (1 + math.log(n) if sublinear else n) * idf.get(t, other) for t, n in L.template_terms(text).items()}


def best(units, templates, sublinear):
    """(score, licence) of units that reach the threshold."""
    idf, other, known = L.weights(templates, sublinear)
    for kind, no, text in units:
        v = vector(text, idf, other, sublinear)
        norm = math.sqrt(sum(x * x for x in v.values()))
        for (name, _), unit in zip(templates, known):
            dot = sum(x * unit.get(t, 0) for t, x in v.items())
            if norm and round(dot / norm, 9) >= L.THRESHOLD:
                yield kind, no, name, round(dot / norm, 9)


def plain(text, file_name):
    """licence and score of a file by its definition: all units, no filter."""
    if text is None:
        return None
    low = text.lower()
    small = [("line", i, x) for i, x in enumerate(low.split("\n"))]
    bare = re.sub(L.COMMENT, "", text)
    paragraphs = re.split(r"[ \t]*\r?\n[ \t]*\r?\n[ \t\r\n]*", bare)
    for p in paragraphs:
        rows = re.split(r"\r?\n", p)
        joined = re.split(L.CLAUSE_END, re.sub(r"\s+", " ", p)) + [" ".join(rows[i:i + n]) for n in (2, 3) for i in range(len(rows) - n + 1)]
        small += [("joined", -1, u.lower()) for u in joined]
    large = []
    if any(s in low for s in L.STEMS) or re.match(L.LICENCE_NAME, file_name):
        ps = [p for p in paragraphs if p.strip(" ")]
        large = [("block", -1, " ".join(ps[i:i + n]).lower()) for n in (1, 2, 3, 4) for i in range(len(ps) - n + 1)] + [("file", -1, low), ("block", -1, plain_head(text).lower())]
    found = [*best(small, L.TEMPLATES, False), *best([u for u in large if u[0] == "file" or any(s in u[2] for s in L.STEMS)], [*L.NOTICES, *L.FULL_TEXTS], True)]
    first = min(found, key=lambda f: (f[0] != "file", -f[3], f[2]), default=None)
    return first and (first[2], first[3])


def plain_head(text):
    body = text.lstrip()
    if body.startswith("#!"):
        body = body.partition("\n")[2].lstrip()
    for begin, end in L.AROUND:
        if body.startswith(begin):
            return body[:body.index(end, len(begin))] if end in body[len(begin):] else ""
    out = []
    for line in body.split("\n"):
        if not re.match(L.LINE_COMMENT, line):
            break
        out.append(line)
    return "\n".join(out)


def test_every_unit_against_every_template(spark):
    import random

    rng, files = random.Random(2), []
    for k in range(150):
        mark = rng.choice(MARKS)
        parts = [rng.choice(PIECES) for _ in range(rng.randrange(1, 6))]
        lines = [mark + x for p in parts for x in [*rng.choice([str.splitlines, lambda t: re.findall(r"\S+(?: \S+){0,6}", t)])(p), *[""] * rng.randrange(2)]]
        text = rng.choice(["", "#!/bin/sh\n", "/*\n", "<!-- "]) + rng.choice(["\n", "\r\n"]).join(lines) + rng.choice(["", "\n*/\nint a;", " -->"])
        files.append((f"/{k}/{rng.choice(['LICENSE', 'a.py'])}", text))
    files += [("/x/a", None), ("/y/a", ""), ("/z/COPYING", "\n\n\n"), *[(f"/t/{n}/COPYING", text) for n, text in L.FULL_TEXTS[:2]]]
    got = {r.path: (r.licence, r.score) for r in L.stated(spark.createDataFrame(files, "path string, text string").repartition(4)).collect()}
    want = {p: found for p, t in files if (found := plain(t, p.split("/")[-1]))}
    assert {p: (a, round(s, 6)) for p, (a, s) in got.items()} == {p: (a, round(s, 6)) for p, (a, s) in want.items()}
    assert len(want) > 60


def test_long_files(spark):
    n = 20_000
    texts = [*["\n".join(f"{mark} this line {i} states no license at all" for i in range(n)) for mark in ("#", "//", "--", ";", "%", "dnl", " *")],
             "/*\n" + "\n".join(f" * line {i} of a license" for i in range(n)) + "\n*/", "<!--" + "\n license" * n, '"""' + "\n license" * n + '"""',
             "license " * 1_300_000, "license" * 1_500_000, "\n" * 100_000 + "the license", " \r\n" * 100_000 + "the license", "a license\n" * 100_000, "a license. B; " * n]
    files = [(f"/{k}/x", text) for k, text in enumerate(texts)] + [(f"/{k}/LICENSE", "Released under the MIT License") for k in range(len(texts))]
    got = {r.path: r.in_force for r in L.scan(spark.createDataFrame(files, "path string, text string").repartition(8)).collect()}
    assert got == {path: "MIT" for path, _ in files}
