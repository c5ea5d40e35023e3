import random
import re

import numpy as np

from fluxtone.llm import license_scan as scan

SCHEMA = "doc_id long, text string, license string, spans int"


def lcs_coverage(template, text):
    """Brute force: longest common subsequence of the template with any window of the text, as a share."""
    cut = lambda s: re.findall("[a-z0-9\u0080-\U0010ffff]+", s.lower())
    t, d = cut(template), cut(text)
    best = 0
    for s in range(max(1, len(d) - len(t) + 1)):
        w, row = d[s : s + len(t) + 2], [0] * (len(t) + 3)
        for x in t:
            new = [0]
            for j, y in enumerate(w):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        best = max(best, row[-1])
    return best / len(t)


def test_lines_in_documents_are_all_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {(r.doc_id, r.license) for r in scan.license_scan(docs.repartition(4)).collect()}
    rows = docs.select("doc_id", "text").collect()
    for name in ("Apache-2.0 line", "MIT line", "GPL-3.0 line", "CC-BY-NC-4.0 line", "rights reserved"):
        want = {(r.doc_id, name) for r in rows if scan.TEMPLATES[name] in r.text}
        assert want and want <= got
        assert {x for x in got if x[1] == name} == want


def test_edited_long_texts(spark):
    rng = random.Random(8)
    noise = lambda n: " ".join(rng.choice(["lorem", "ipsum", "dolor", "été"]) for _ in range(n))
    rows, want = [], {}
    for i, (name, text) in enumerate(list(scan.TEMPLATES.items()) * 3):
        words = text.split()
        for _ in range(len(words) // 12):
            p = rng.randrange(len(words))
            words[p : p + 1] = rng.choice([[], ["changed"], [words[p], "more"]])
        body = " ".join(words)
        rows.append((i, f"{noise(30)}\n{body.upper() if i % 2 else body}\n{noise(40)}", "", 0))
        want[i] = (name, lcs_coverage(text, rows[-1][1]))
    got = {}
    for r in scan.license_scan(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect():
        got.setdefault(r.doc_id, {})[r.license] = r
    for i, (name, coverage) in want.items():
        if coverage >= 0.85 and name in scan.TEMPLATES and len(scan.TEMPLATES[name].split()) > 4:
            r = got[i][name]
            assert abs(r.coverage - coverage) <= 0.08
            span = rows[i][1][r.spans[0].start : r.spans[0].stop]
            assert "lorem" not in span and "ipsum" not in span


def test_defined_cases(spark):
    line = scan.TEMPLATES["MIT line"]
    rows = [(1, None, "", 0), (2, "", "", 0), (3, "no license here", "", 0), (4, f"{line} x\n{line}", "", 0), (4, f"{line} x\n{line}", "", 0), (5, "a b " * 40000 + line, "", 0), (6, "Released under", "", 0), (7, "the MIT License", "", 0), (None, line, "", 0)]
    got = scan.license_scan(spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect()
    assert sorted((r.doc_id or 0, r.license, r.n_spans, r.coverage) for r in got) == [(0, "MIT line", 1, 1.0), (4, "MIT line", 2, 1.0), (4, "MIT line", 2, 1.0), (5, "MIT line", 1, 1.0)]
    assert scan.license_scan(spark.createDataFrame([], SCHEMA)).collect() == []


def test_band_of_an_alignment():
    t = np.arange(10, dtype=np.uint64)
    assert scan.align(t, np.array([99, 0, 1, 2, 50, 3, 4, 5, 6, 7, 8, 9], np.uint64), 1, 3) == (10, 1, 11)
