import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from fluxtone.llm.packing import encode, pack, pieces, windows

SCHEMA = "doc_id long, text string, n int, ids string"
ROWS = [(3, "Hello  world, l'été été 123\n\n x <|endoftext|>", 1, ""), (1, None, 1, ""), (2, "", 1, ""), (5, "long words and more " * 900, 1, ""), (3, "Hello", 1, ""), (None, "no id \U0001f600", 1, "")]


def reference(text):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return [*t.encode(text or "", add_special_tokens=False).ids, 1]


def test_ids_are_those_of_the_file(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(80).collect()
    path = public_tokenizers.path("byte_bpe_50k.json")
    for text in [r.text for r in rows] + [r[1] for r in ROWS if r[1]]:
        assert [*encode(text, path), 1] == reference(text)


def test_round_trip_and_full_windows(spark):
    got = pack(spark.createDataFrame(ROWS, SCHEMA).repartition(3), length=64).collect()
    docs, sequences = {}, {}
    for r in got:
        assert len(r.ids) == 4 * r.length and r.length > 0
        docs.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.ids))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    want = sorted(((i, reference(t)) for i, t, *_ in ROWS), key=str)
    assert sorted(((i, np.frombuffer(b"".join(x for _, x in sorted(p)), "<u4").tolist()) for (i, _), p in docs.items()), key=str) == want
    sizes = []
    for _, p in sorted(sequences.items()):
        at = 0
        for offset, n in sorted(p):
            assert offset == at
            at += n
        sizes.append(at)
    total = sum(len(x) for _, x in want)
    assert sorted(sequences) == list(range(len(sequences))) and sizes[: total // 64] == [64] * (total // 64)
    assert all(s & (s - 1) == 0 for s in sizes) and sum(sizes) == total


def test_digest_and_empty(spark):
    (row,) = pieces(spark.createDataFrame(ROWS[:1], SCHEMA)).where("start = 0 and length = doc_tokens").collect() or [None]
    assert row is None or row.ids_crc32 == zlib.crc32(np.array(reference(ROWS[0][1]), "<u4").tobytes())
    (row,) = pieces(spark.createDataFrame(ROWS[1:2], SCHEMA)).collect()
    assert (row.ids_crc32, row.doc_tokens, row.length) == (zlib.crc32(b"\1\0\0\0"), 1, 1)
    assert pieces(spark.createDataFrame([], SCHEMA)).collect() == []


def test_windows_by_hand():
    assert windows(6, 5, 11, 4) == [(0, 2, 1, 2), (2, 2, 2, 0), (4, 1, 3, 0)]
