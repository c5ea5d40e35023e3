import gzip
import hashlib
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fluxtone.llm import warc

BIG = "<p>" + "same page " * 30
ROWS = [(i, f"http://www.site{i % 7}.example.org/p/{i % 50}?q={i}#frag", BIG if i % 3 == 0 else f"<p>{i} é " * (i % 40), "x") for i in range(1, 400)]
ROWS += [(500, None, None, "x"), (501, "no url at all", "", "x"), (502, "HTTP://User@EXAMPLE.com:80", "short", "x"), (503, "http://example.com/a b\n", "short", "x"), (None, "http://a.b/", BIG, "x"), (504, "http://a.b/", "é" * 2_000_000, "x"), (9, "http://again.org/", BIG, "x"), (3, "http://again.org/", BIG, "x"), (-7, "http://x.y/", "<p>12 é " * 12, "x")]
SCHEMA = "page_id long, url string, html string, digest string"


def brute(rows):
    firsts = {}
    for i, _, html, _ in rows:
        data = (html or "").encode()
        if len(data) >= 100:
            firsts.setdefault(data, []).append(i)
    out = []
    for i, url, html, _ in rows:
        data = (html or "").encode()
        first = min((x for x in firsts.get(data, [i]) if x is not None), default=None)
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "response" if i == first else "revisit", None if i == first else first, warc.url_key(warc.plain(url or ""))))
    return out


@pytest.mark.parametrize(("block", "wave", "most"), [(32, 16384, 64 << 20), (3, 10, 2000)])
def test_round_trip_and_order_match_brute_force(spark, tmp_path, monkeypatch, block, wave, most):
    monkeypatch.setattr(warc, "BLOCK", block)
    monkeypatch.setattr(warc, "WAVE", wave)
    folder = f"file://{tmp_path}/w"
    warc.write_warc(spark.createDataFrame(ROWS, SCHEMA).repartition(5), folder, archive_bytes=most)
    names = [p.name for p in Path(tmp_path, "w").iterdir()]
    assert all(n.endswith(".warc.gz") for n in names) and (len(names) >= 5 if most > 2000 else len(names) > 20)
    rows = warc.histories(warc.read_warc(spark, folder, payload=False), per_range=20).collect()
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.url_key) for r in rows]
    assert sorted(got, key=str) == sorted(brute(ROWS), key=str)
    assert sorted(r.place for r in rows) == list(range(len(ROWS)))
    ordered = [(r.url_key.encode(), r.stamp, r.page_id is None, r.page_id or 0, r.archive, r.offset) for r in sorted(rows, key=lambda r: r.place)]
    assert ordered == sorted(ordered)
    r = next(r for r in rows if r.page_id == 504)  # the index leads to the record
    with open(Path(tmp_path, "w", r.archive), "rb") as f:
        f.seek(r.offset)
        head, _, rest = gzip.decompress(f.read(r.length)).partition(b"\r\n\r\n")
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response") and hashlib.sha256(rest.partition(b"\r\n\r\n")[2].removesuffix(b"\r\n\r\n")).hexdigest() == r.payload_digest


def test_payloads_come_back_and_revisits_have_none(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    warc.write_warc(spark.createDataFrame(ROWS[:50], SCHEMA), folder, when=F.lit("2020-02-29 12:34:56").cast("timestamp"))
    back = warc.read_warc(spark, folder).collect()
    want = {i: (html or "").encode() for i, _, html, _ in ROWS[:50]}
    assert len(back) == 50 and all(r.stamp == 1582979696 for r in back)
    assert all((bytes(r.payload) == want[r.page_id]) if r.record_type == "response" else r.payload is None for r in back)


def test_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    assert warc.round_trip(empty, f"file://{tmp_path}/w").collect() == []


def test_damage_is_found():
    data = warc.record(1, "http://a/", 0, b"payload " * 20, hashlib.sha256(b"payload " * 20).hexdigest(), None, True)
    assert warc.capture(data)["payload_bytes"] == 160
    with pytest.raises(ValueError, match="digest"):
        warc.capture(data.replace(b"payload payload", b"payload Payload"))
    with pytest.raises(ValueError, match="cut off"):
        warc.capture(data[:-60])
    import io

    packed = gzip.compress(data) + gzip.compress(data)
    assert [x[2] for x in warc.members(io.BytesIO(packed))] == [data, data]
    with pytest.raises(ValueError, match="cut off"):
        list(warc.members(io.BytesIO(packed[:-3])))
    assert warc.capture(b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 0\r\n\r\n\r\n\r\n") is None


def test_loser_tree():
    rng = random.Random(5)
    for k in (0, 1, 2, 3, 7, 8, 33):
        lists = [sorted(rng.sample(range(10_000), rng.randrange(20))) for _ in range(k)]
        keys = [[b"%05d.%02d" % (x, i) for x in own] for i, own in enumerate(lists)]
        assert [keys[i][j] for i, j in warc.LoserTree(keys)] == sorted(x for own in keys for x in own)


def test_url_keys():
    assert warc.url_key("http://www.B.com/x?y#z") == "com,b)/x?y"
    assert warc.url_key("https://u:p@a.b.com:443") == "com,b,a)/"
    assert warc.url_key("http://a.com?q") == "com,a)/?q" and warc.url_key("mailto:x#y") == "mailto:x"
