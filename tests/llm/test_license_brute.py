"""Whole results of license scans against plain alignment of every template with every text; time for many matches."""

import random
import re
import time

import numpy as np

from fluxtone.llm import license_scan as scan

NAMES = ("MIT line", "CC-BY-4.0 line", "ISC text", "BSD-3-Clause text", "GPL header")


def aligned(template, doc):
    """The best local alignment (match +2, other word -1, gap -1): matched words, first and last matched word."""
    n, m = len(template), len(doc)
    h = np.zeros((n + 1, m + 1), int)
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if template[i - 1] == doc[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    i, j = np.unravel_index(h.argmax(), h.shape)
    hit = []
    while h[i, j] > 0:
        if h[i, j] == h[i - 1, j - 1] + (2 if template[i - 1] == doc[j - 1] else -1):
            if template[i - 1] == doc[j - 1]:
                hit.append(j - 1)
            i, j = i - 1, j - 1
        elif h[i, j] == h[i - 1, j] - 1:
            i -= 1
        else:
            j -= 1
    return len(hit), hit[-1] if hit else 0, hit[0] if hit else 0


def words_of(text):
    return [(m.start(), m.end(), re.sub("[A-Z]", lambda x: x[0].lower(), m[0])) for m in re.finditer("[0-9A-Za-z\x80-\U0010ffff]+", text)]


def brute(rows, templates):
    out = []
    for doc_id, text in rows:
        found = words_of(text or "")
        for name, template in templates.items():
            t, spans, todo = [w for *_, w in words_of(template)], [], [(0, len(found))]
            while todo:
                a, b = todo.pop()
                matched, first, last = aligned(t, [w for *_, w in found[a:b]]) if b - a >= scan.LEAST * len(t) else (0, 0, 0)
                if matched >= scan.LEAST * len(t):
                    spans.append((found[a + first][0], found[a + last][1], round(matched / len(t), 9)))
                    todo += [(a, a + first), (a + last + 1, b)]
            if spans:
                out.append((doc_id, name, round(max(s[2] for s in spans), 9), len(spans), sorted(spans)))
    return sorted(out)


def made():
    rng = random.Random(11)
    filler = lambda n: " ".join(f"é{rng.randrange(10**6)}" for _ in range(n))
    rows = [(0, None), (1, ""), (2, filler(40))]
    for i in range(3, 16):
        text = filler(rng.randrange(1, 12))
        for _ in range(rng.randint(1, 2)):
            own = scan.TEMPLATES[rng.choice(NAMES)].split()
            for _ in range(len(own) // 12):  # words lost, changed or put in, away from the ends
                at = rng.randrange(3, len(own) - 3)
                own[at : at + 1] = rng.choice(([], [f"x{rng.random()}".replace(".", "")], [own[at], f"y{rng.randrange(999)}"]))
            text += " " + " ".join(own) + " " + filler(rng.randrange(8, 20))
        rows.append((i, text))
    return rows


def test_whole_result_is_that_of_plain_alignment(spark):
    rows, templates = made(), {n: scan.TEMPLATES[n] for n in NAMES}
    got = scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), templates).collect()
    found = sorted((r.doc_id, r.license, round(r.coverage, 9), r.n_spans, sorted((s.start, s.stop, round(s.coverage, 9)) for s in r.spans)) for r in got)
    want = brute(rows, templates)
    assert len(want) > 10 and found == want


def test_many_matches_take_time_in_proportion(spark):
    index = scan.Index({"MIT line": scan.TEMPLATES["MIT line"]})
    took = {}
    for n in (2_000, 8_000):
        text = " ".join(f"{scan.TEMPLATES['MIT line']} é{i}" for i in range(n))
        h = scan.words(text.encode().translate(scan._BLANK))[2]
        began = time.monotonic()
        assert len(scan.scan_text(index, h, index.hits(scan.grams(h)))) == n
        took[n] = time.monotonic() - began
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        row = scan.license_scan(df, {"MIT line": scan.TEMPLATES["MIT line"]}).first()
        assert row.n_spans == n and all(text[s.start : s.stop] == "Released under the MIT License" for s in row.spans)
    assert took[8_000] < 8 * took[2_000] + 0.2
