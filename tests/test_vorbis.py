"""Third Vorbis headers with parts that the writer doesn't make, put together bit by bit."""

import time

import pyarrow as pa
from pyspark.sql import functions as F

from fluxtone.functions import tables, vorbis
from fluxtone.operators import containers
from fluxtone.operators.containers import wav_layout
from fluxtone.plans.containers import vorbis_setup


def packed(fields):
    digits = "".join(f"{v:0{w}b}"[::-1] if w else "" for v, w in fields)
    digits += "0" * (-len(digits) % 8)
    return vorbis.MARK + bytes(int(digits[i : i + 8][::-1], 2) for i in range(0, len(digits), 8))


BOOKS = [
    (1, 8),  # two codebooks
    (0x564342, 24), (2, 16), (9, 24), (1, 1), (1, 5), (1, 4), (8, 4), (1, 4),  # in order: one of length 2, eight of 3; values as a lattice
    (0, 32), (0, 32), (3, 4), (0, 1), (5, 4), (6, 4), (7, 4),  # 3 ** 2 <= 9 values of 4 bits
    (0x564342, 24), (1, 16), (2, 24), (0, 1), (0, 1), (4, 5), (9, 5), (2, 4),  # all entries used; a value for each
    (0, 32), (0, 32), (0, 4), (0, 1), (1, 1), (0, 1),
]
REST = [
    (0, 6), (0, 16),
    (0, 6), (0, 16), (30, 8), (44100, 16), (64, 16), (10, 6), (100, 8), (1, 4), (0, 8), (1, 8),  # a floor of kind 0 with two books
    (0, 6), (2, 16), (0, 24), (500, 24), (31, 24), (1, 6), (0, 8), (3, 3), (1, 1), (1, 5), (0, 3), (0, 1), (0, 8), (0, 8), (1, 8),  # three books
    (0, 6), (0, 16), (1, 1), (1, 4), (1, 1), (0, 8), (0, 1), (1, 1), (0, 2), (0, 4), (1, 4), (0, 8), (0, 8), (0, 8), (0, 8), (0, 8), (0, 8),  # two submaps, a coupled pair
    (1, 6), (0, 1), (0, 16), (0, 16), (0, 8), (1, 1), (0, 16), (0, 16), (0, 8), (1, 1),
]


def test_foreign_parts_are_read():
    got = list(vorbis.setup_rows(packed(BOOKS + REST), 2))
    assert got == [
        ("codebook", 0, 1, 9, 2, 2 + 8 * 3), ("codebook", 1, 2, 2, 1, 5 + 10), ("floor", 0, 0, 30, 2, 0), ("residue", 0, 2, 2, 32, 500),
        ("mapping", 0, 0, 2, 1, 0), ("mode", 0, 0, 0, 0, 0), ("mode", 1, 1, 0, 0, 0),
    ]


def test_cut_and_wrong_headers_give_nothing():
    whole = packed(BOOKS + REST)
    assert not any(list(vorbis.setup_rows(whole[:n], 2)) for n in range(len(whole)))
    assert list(vorbis.setup_rows(None, 2)) == [] and list(vorbis.setup_rows(b"\x03vorbis" + whole[7:], 2)) == []
    assert list(vorbis.setup_rows(packed(BOOKS + [*REST[:-1], (0, 1)]), 2)) == []  # no last mark
    assert list(vorbis.setup_rows(packed([(0, 8), (0x564343, 24), (0, 500)]), 2)) == []


def test_wav_layout_walks_chunks():
    form = b"fmt \x10\0\0\0\x01\0\x02\0\x40\x1f\0\0\0\x7d\0\0\x04\0\x10\0"
    head = b"RIFF\0\0\0\0WAVE"
    assert wav_layout(head + form + b"LIST\x03\0\0\0abc\0data\x04\0\0\0wxyz!") == (2, 8000, 16, 56, 4)
    assert wav_layout(head + b"junk\0\0\0\0" + form + b"data\xff\0\0\0wx") == (2, 8000, 16, 52, 2)
    assert wav_layout(head + b"data\x01\0\0\0a") is None and wav_layout(head + form) is None and wav_layout(None) is None and wav_layout(b"RIFF") is None


def _parts(books, floors, residues, modes):
    return {
        "books": [{"dimensions": d, "lengths": n} for d, n in books], "floors": [{"posts": p, "bits": b} for p, b in floors],
        "residues": [{"kind": k, "size": s, "classes": c} for k, s, c in residues], "modes": modes,
    }


def _fields(books, floors, residues, modes):
    yield len(books) - 1, 8
    for dimensions, lengths in books:
        yield from [(0x564342, 24), (dimensions, 16), (len(lengths), 24), (0, 1), (1, 1)]
        for n in lengths:
            yield from [(1, 1), (n - 1, 5)] if n else [(0, 1)]
        yield 0, 4
    yield from [(0, 6), (0, 16), (len(floors) - 1, 6)]
    for posts, bits in floors:
        yield from [(1, 16), (1, 5), (0, 4), (len(posts) - 1, 3), (0, 2), (0, 8), (1, 2), (bits, 4), *((x, bits) for x in posts)]
    yield len(residues) - 1, 6
    for kind, size, classes in residues:
        yield from [(kind, 16), (0, 24), (1024, 24), (size - 1, 24), (classes - 1, 6), (0, 8), *[(0, 4)] * classes]
    yield from [(0, 6), (0, 16), (0, 2), (0, 2), (0, 24), (len(modes) - 1, 6)]
    for long in modes:
        yield from [(int(long), 1), (0, 16), (0, 16), (0, 8)]
    yield 1, 1


SETUP = "struct<books:array<struct<dimensions:int,lengths:array<int>>>,floors:array<struct<posts:array<int>,bits:int>>,residues:array<struct<kind:int,size:int,classes:int>>,modes:array<boolean>>"
HEADERS = [
    ([(k + 1, [(i * 7 + k) % 33 for i in range(i % 9 + k)]) for k in range(i % 5 + 1)], [([(j * 31 + i) % 2**b for j in range(i % 8 + 1)], b) for b in range(1, i % 15 + 2)],
     [(k, i * 1000 + 1, i % 64 + 1) for k in range(i % 3 + 1)], [(i + k) % 3 == 0 for k in range(i % 64 + 1)])
    for i in range(130)
]


def test_headers_are_written_field_by_field(spark):
    rows = [(i, _parts(*h), i % 2) for i, h in enumerate(HEADERS)]
    found = containers.setup_headers(spark.createDataFrame(rows, f"id long, setup {SETUP}, more int").repartition(3))
    assert found.columns == ["id", "b", "more"]
    got = {r.id: (bytes(r.b), r.more) for r in found.collect()}
    assert got == {i: (packed(list(_fields(*h))), i % 2) for i, h in enumerate(HEADERS)}


def test_headers_with_a_missing_number_are_null(spark):
    book, floor, residue = (1, [1, 2]), ([3], 8), (0, 16, 2)
    holes = [
        ([(None, [1])], [floor], [residue], [True]), ([(1, None)], [floor], [residue], [True]), ([book], [([3, None], 8)], [residue], [True]), ([book], [([3], None)], [residue], [True]),
        ([book], [floor], [(0, None, 2)], [True]), ([book], [floor, floor], [residue, (None, 1, 1)], [False]),
    ]
    whole = [([book], [floor], [residue], [True]), ([book, (2, [])], [floor], [residue], [False, True])]
    parts = [None, *[_parts(*h) for h in [whole[0], *holes, whole[1]]], _parts(*whole[0]) | {"books": None}, _parts(*whole[0]) | {"modes": None}, _parts(*whole[0]) | {"floors": [None]}]
    rows = spark.createDataFrame(list(enumerate(parts)), f"id long, setup {SETUP}")
    got = {r.id: r.b and bytes(r.b) for r in containers.setup_headers(rows.coalesce(1)).collect()}
    assert got == {i: None for i in range(len(parts))} | {1: packed(list(_fields(*whole[0]))), 2 + len(holes): packed(list(_fields(*whole[1])))}
    assert vorbis.setup_bytes(pa.array([], rows.toArrow().schema.field("setup").type)).to_pylist() == []


def test_functions_in_sql(spark):
    tables.register(spark)
    tables.register(spark)  # once more does no harm
    whole, plain = packed(BOOKS + REST), packed(list(_fields(*HEADERS[1])))
    headers = [(1, whole, 2), (2, None, 2), (3, whole[:-1], 2), (4, plain, 1), (5, b"", 1), (6, whole, 2), (7, plain, 1), (8, b"\x03vorbis" + whole[7:], 2)]
    h = spark.createDataFrame([(i, None if b is None else bytearray(b), c) for i, b, c in headers], "id long, b binary, channels int").coalesce(1)
    want = sorted((i, *row) for i, b, c in headers for row in vorbis.setup_rows(b, c))
    assert {i for i, *_ in want} == {1, 4, 6, 7}
    assert sorted(map(tuple, spark.sql("select h.id, t.* from {h} h, lateral vorbis_setup(h.b, h.channels) t", h=h).collect())) == want
    assert sorted(map(tuple, spark.sql("select h.id, inline(vorbis_parts(h.b, h.channels)) from {h} h", h=h).collect())) == want
    assert {r.id for r in spark.sql("select h.id from {h} h where size(vorbis_parts(h.b, h.channels)) = 0", h=h).collect()} == {2, 3, 5, 8}
    cut = spark.sql("select h.id, t.part, t.total from {h} h, lateral vorbis_setup(substring(h.b, 1, octet_length(h.b) - if(h.id = 6, 1, 0)), 2) t where t.part = 'codebook'", h=h).collect()
    assert sorted(map(tuple, cut)) == sorted((i, part, total) for i, part, _, _, _, _, total in want if part == "codebook" and i != 6)
    assert sorted(map(tuple, spark.sql(f"select * from vorbis_setup(x'{whole.hex()}', 2) where part = 'mode'").collect())) == sorted(row for row in vorbis.setup_rows(whole, 2) if row[0] == "mode")


def test_headers_of_100_000_events_in_one_file(spark, tmp_path):
    events = spark.range(0, 100_000, 1, 1).select(F.col("id").alias("event_id"), (F.col("id") * 7919 % 1500).alias("user_id"))
    events.write.parquet(str(tmp_path / "events.parquet"))
    began = time.monotonic()
    got = vorbis_setup(spark, str(tmp_path)).groupBy("part").agg(F.count("*").alias("rows"), F.countDistinct("id").alias("ids"), F.min("id").alias("least")).collect()
    assert time.monotonic() - began < 45
    assert {r.part: (r.rows, r.ids, r.least) for r in got} == {p: (300_000 if p in ("codebook", "mode") else 100_000, 100_000, 0) for p in ("codebook", "floor", "residue", "mapping", "mode")}
