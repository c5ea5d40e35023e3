"""Ogg files give the same packets at any split size."""

import random
import zlib
from pathlib import Path

import pytest

from fluxtone.sources import ogg


def page(stream, number, sizes, body, flags=0, granule=0):
    head = b"OggS\0" + bytes([flags]) + granule.to_bytes(8, "little", signed=True) + stream.to_bytes(4, "little") + number.to_bytes(4, "little")
    tail = bytes([len(sizes)]) + bytes(sizes) + body
    return head + zlib.crc32(head + bytes(4) + tail).to_bytes(4, "little") + tail


def lacing(n):
    return [255] * (n // 255) + [n % 255]


def stream_pages(stream, packets, room=255):
    """Packets one after another over pages of at most ``room`` segments."""
    sizes, body = [s for p in packets for s in lacing(len(p))], b"".join(packets)
    out, at, number, open_ = [], 0, 0, False
    for i in range(0, len(sizes), room):
        own = sizes[i : i + room]
        out.append(page(stream, number, own, body[at : at + sum(own)], flags=int(open_), granule=number))
        at, number, open_ = at + sum(own), number + 1, own[-1] == 255
    return out


def made(tmp_path):
    rng = random.Random(6)
    want, folder = {}, Path(tmp_path, "in")
    folder.mkdir()
    for f in range(3):
        streams = {}
        for s in range(1 + f):
            packets = [rng.randbytes(rng.choice([0, 1, 254, 255, 256, 510, 3000, 70_000])) for _ in range(12)]
            packets[3] = b"OggS\0" + packets[3] + b"OggSOggS"  # marks that begin no page
            streams[s] = packets
            for k, p in enumerate(packets):
                want[f"{f}.ogg", s, k] = p
        queues = [stream_pages(s, p, rng.choice([3, 200, 255])) for s, p in streams.items()]
        data = b"junk OggS before" if f == 1 else b""
        while any(queues):  # streams take turns
            queue = rng.choice([q for q in queues if q])
            data += queue.pop(0)
        Path(folder, f"{f}.ogg").write_bytes(data)
    Path(folder, "_empty").write_bytes(b"")
    return folder, want


@pytest.mark.parametrize("split", [1000, 65_537, 1 << 26])
def test_packets_are_the_same_at_any_split(spark, tmp_path, split):
    folder, want = made(tmp_path)
    rows = ogg.packets(ogg.read_pieces(spark, f"file://{folder}", split)).collect()
    assert all(r.whole for r in rows)
    assert {(Path(r.file).name, r.stream, r.k): bytes(r.payload) for r in rows} == want


def test_damaged_pages_are_passed_over(spark, tmp_path):
    packets = [bytes([i]) * 300 for i in range(9)]
    pages = stream_pages(7, packets, 3)
    pages[1] = pages[1][:-1] + b"?"
    Path(tmp_path, "x.ogg").write_bytes(b"".join(pages))
    for split in (97, 1 << 20):
        got = {r.k: (r.whole, bytes(r.payload)) for r in ogg.packets(ogg.read_pieces(spark, f"file://{tmp_path}/x.ogg", split)).collect()}
        assert sorted(p for w, p in got.values() if w) == [p for i, p in enumerate(packets) if i not in (1, 2)]  # parts of these were in it


def test_no_files(spark, tmp_path):
    Path(tmp_path, "none").mkdir()
    assert ogg.packets(ogg.read_pieces(spark, f"file://{tmp_path}/none")).collect() == []
