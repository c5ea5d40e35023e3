"""A long text full of one license's words: many shifting diagonals, in bounded time."""

import random
import time

import numpy as np

from fluxtone.llm import license_scan as scan
from fluxtone.llm.textops import words


def test_repeated_fragments_take_time_in_proportion():
    rng = random.Random(1)
    template = scan.TEMPLATES["ISC text"].split()
    text = []
    while len(text) < 120_000:
        at = rng.randrange(len(template) - 12)
        text += template[at : at + rng.randint(4, 12)]
    index = scan.Index({"ISC text": scan.TEMPLATES["ISC text"]})
    began = time.monotonic()
    for n in (100, 60_000, 119_000):
        whole = [*text[:n], *template, *text[n:]]
        h = words(" ".join(whole).encode().translate(scan._BLANK))[2]
        found = scan.scan_text(index, h, index.hits(scan.grams(h)))
        assert any(c == 1.0 and last - first + 1 == len(index.words[0]) for _, c, first, last in found)
        assert all(a[3] < b[2] for a, b in zip(found, found[1:], strict=False))
    assert time.monotonic() - began < 120


def test_alignments_together_are_those_alone():
    rng = np.random.default_rng(5)
    template, doc = rng.integers(0, 6, 25).astype(np.uint64), rng.integers(0, 6, 200).astype(np.uint64)
    diagonals = np.arange(-10, 190, 3)
    together = list(zip(*map(list, scan.align_all(template, doc, diagonals, 5)), strict=True))
    assert together == [scan.align(template, doc, int(d), 5) for d in diagonals]
