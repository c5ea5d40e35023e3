"""Which bytes of a text have a say in its language, and that windows give what one recurrence over the whole text gives."""

import random

import numpy as np

from fluxtone.llm import language_id


def test_letters_of_any_script_and_nothing_else():
    for text in ("aé1 中”…😀Б٣ǅ_-", "", "\n\t", "ʰª²", "𐐀x"):
        want = [c.isalpha() for c in text for _ in c.encode()]
        assert language_id.letters(text.encode()).tolist() == want
    broken = b"ab\xff\xc3 \xe4\xb8z\xc3\xa9"
    assert language_id.letters(broken).tolist() == [True, True, False, False, False, False, False, True, True, True]


def test_windows_give_what_the_whole_text_gives(monkeypatch):
    rng = random.Random(8)
    kinds = {"aa": "abcde é", "bb": "fghij ü", "cc": "abfgk ñ"}
    make = lambda k, n: "".join(rng.choice(kinds[k]) for _ in range(n)).encode()
    labels = [k for k in kinds for _ in range(40)]
    net = language_id.train([make(k, 150) for k in labels], labels)
    texts = [make(k, n) for k in kinds for n in (30, 95, 96, 97, 700, 3000)] + [b"", None, "“12” — 3…".encode()]
    cut = language_id.score_texts(net, texts)
    monkeypatch.setattr(language_id, "WINDOW", 4000)
    monkeypatch.setattr(language_id, "LEAD", 0)
    whole = language_id.score_texts(net, texts)
    assert np.abs(cut - whole).max() < 0.05 and (cut.argmax(axis=1) == whole.argmax(axis=1)).all()
    assert (cut[:-3].argmax(axis=1) == np.repeat(np.arange(3), 6)).all() and not cut[-3:].any()
