"""Lossless frames against plain readings of the format."""

import random

import pytest
from pyspark.sql import functions as F

from fluxtone.functions import flac
from fluxtone.operators import lossless


def blocks():
    rng = random.Random(3)
    walk, kinds = 0, {}
    kinds["noise"] = [rng.randrange(-32768, 32768) for _ in range(64)]
    kinds["constant"] = [-7] * 50
    kinds["zeros"] = [0] * 16
    kinds["one"] = [12345]
    kinds["wasted"] = [rng.randrange(-100, 100) * 64 for _ in range(40)]
    kinds["ramp"] = [3 * i - 500 for i in range(300)]
    kinds["edges"] = [-32768, 32767] * 20
    smooth = []
    for i in range(192):
        walk += rng.randrange(-20, 21)
        smooth.append(walk + (8 * (i % 16)))
    kinds["smooth"] = smooth
    a, b, tones = 0.0, 0.0, []
    for i in range(256):  # a decaying resonance: long predictors pay
        a, b = 1.9 * a - 0.98 * b + rng.uniform(-50, 50), a
        tones.append(max(-32768, min(32767, round(a))))
    kinds["resonance"] = tones
    kinds["late"] = [rng.randrange(-3, 4) for _ in range(64)] + [rng.randrange(-5000, 5000) for _ in range(64)]
    return kinds


BLOCKS = blocks()
NUMBERS = [0, 127, 128, 2047, 2048, 65535, 65536, 2097151, 2097152, 67108863, 67108864, 2147483648]


def read(b):
    """A frame by the format's text, bit by bit."""
    bits, at = "".join(f"{x:08b}" for x in b), 0

    def take(n, sign=False):
        nonlocal at
        v = int(bits[at : at + n], 2) if n else 0
        if sign and n and bits[at] == "1":
            v -= 1 << n
        at += n
        return v

    assert take(15) == 0b111111111111100
    take(1)
    size, rate, layout, width = take(4), take(4), take(4), {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}[take(3)]
    take(1)
    lead = take(8)
    number, extra = lead, 0
    if lead >= 0x80:
        extra = f"{lead:08b}".index("0") - 1 if lead < 0xFF else None
        number = lead & ((1 << (6 - extra)) - 1) if extra < 6 else 0
        for _ in range(extra):
            number = number << 6 | take(8) & 63
    n = {6: lambda: take(8) + 1, 7: lambda: take(16) + 1}[size]()
    crc = 0
    for x in b[: at // 8 + 1]:
        crc ^= x
        for _ in range(8):
            crc = (crc << 1) ^ 0x107 if crc & 0x80 else crc << 1
    assert crc == 0
    take(8)
    channels = []
    for c in range(layout + 1 if layout < 8 else 2):
        own = width + ((c == 0 and layout == 9) or (c == 1 and layout in (8, 10)))
        assert take(1) == 0
        kind, low = take(6), 0
        if take(1):
            low = 1
            while not take(1):
                low += 1
        own -= low
        if kind == 0:
            v = [take(own, True)] * n
        elif kind == 1:
            v = [take(own, True) for _ in range(n)]
        else:
            order = kind - 8 if kind < 16 else kind - 31
            v = [take(own, True) for _ in range(order)]
            q, shift = list(flac.FIXED.get(order, ())), 0
            if kind >= 32:
                precision, shift = take(4) + 1, take(5, True)
                q = [take(precision, True) for _ in range(order)]
            wide, parts = {0: 4, 1: 5}[take(2)], take(4)
            for p in range(1 << parts):
                k = take(wide)
                raw = take(5) if k == (1 << wide) - 1 else None
                for _ in range((n >> parts) - (order if p == 0 else 0)):
                    if raw is not None:
                        e = take(raw, True)
                    else:
                        quotient = 0
                        while not take(1):
                            quotient += 1
                        z = quotient << k | take(k)
                        e = z >> 1 if z % 2 == 0 else -(z + 1) // 2
                    v.append(e + (sum(w * v[-1 - j] for j, w in enumerate(q)) >> shift))
        channels.append([x << low for x in v])
    if layout == 8:
        channels = [channels[0], [x - y for x, y in zip(*channels, strict=True)]]
    elif layout == 9:
        channels = [[x + y for x, y in zip(*channels, strict=True)], channels[1]]
    elif layout == 10:
        whole = [2 * m + s % 2 for m, s in zip(*channels, strict=True)]
        channels = [[(m + s) >> 1 for m, s in zip(whole, channels[1], strict=True)], [(m - s) >> 1 for m, s in zip(whole, channels[1], strict=True)]]
    return number, channels


def made(spark, stereo):
    names = list(BLOCKS)
    rows = [(i, NUMBERS[i % len(NUMBERS)], [BLOCKS[name]] if not stereo else [BLOCKS[name], [max(-32768, x - x % 5) for x in BLOCKS[name]]]) for i, name in enumerate(names)]
    rows += [(99, 5, [[]]), (98, 5, [[1], [2, 3]] if stereo else [])]
    return names, rows, spark.createDataFrame(rows, "id long, number long, v array<array<long>>")


@pytest.mark.parametrize("stereo", [False, True])
def test_frames_read_right_by_the_format_and_come_back(spark, stereo):
    names, rows, df = made(spark, stereo)
    coded = lossless.frames(df).cache()
    found = {r.id: bytes(r.b) for r in coded.collect()}
    assert sorted(found) == list(range(len(names)))  # empty and unlike channels have no frame
    for i, number, v in rows[: len(names)]:
        assert read(found[i]) == (number, v)
    back = {r.id: (r.number, r.v) for r in lossless.read_frames(coded.select("id", F.lit(0).alias("k"), "b")).collect()}
    assert back == {i: (number, v) for i, number, v in rows[: len(names)]}


def test_every_kind_of_subframe_is_chosen(spark):
    df = spark.createDataFrame([(i, v, 16) for i, v in enumerate(BLOCKS.values())], "id long, v array<long>, width int")
    found = {name: r for name, r in zip(BLOCKS, sorted(lossless.subframes(df, ["id"]).collect()), strict=True)}
    assert found["constant"].kind == 0 and found["noise"].kind in (1, 8) and found["ramp"].kind == 10
    assert found["wasted"].low >= 6 and found["resonance"].kind >= 33 and found["late"].halvings >= 1
    assert len(found["constant"].digits) == 8 + 16


def test_orders_up_to_32_restore(spark):
    v = BLOCKS["resonance"]
    df = spark.createDataFrame([(1, v, 16)], "id long, v array<long>, width int")
    rows = lossless.options(df, ["id"], tuple(range(1, 33))).where("kind > 31")
    back = rows.select("kind", F.size("q").alias("order"), flac.restore(F.slice("s", F.lit(1), F.size("q")), flac.residual(F.col("s"), F.col("q"), F.col("shift")), F.col("q"), F.col("shift")).alias("v")).collect()
    assert sorted(r.order for r in back) == list(range(1, 33)) and all(r.v == v for r in back)


def by_hand():
    """Foreign frames: escaped and five-digit parameters, a negative start, a fixed block size, a sample rate spelled out."""

    def crc(b, poly, width):
        c = 0
        for x in b:
            c ^= x << (width - 8)
            for _ in range(8):
                c = ((c << 1) ^ poly) & ((1 << width) - 1) if c >> (width - 1) & 1 else (c << 1) & ((1 << width) - 1)
        return c

    signed = lambda v, n: f"{v & ((1 << n) - 1):0{n}b}"
    out = []
    for body, want in (
        # fixed order 1, one partition, escaped: numbers of 3 bits
        ("0" + "001001" + "0" + signed(-5, 16) + "00" + "0000" + "1111" + "00011" + "".join(signed(x, 3) for x in (1, -4, 3) * 5), None),
        # order 0, two partitions of five-digit parameters, the second escaped with width 0
        ("0" + "001000" + "0" + "01" + "0001" + "00000" + "".join({0: "1", 1: "001", -1: "01", 2: "00001"}[x] for x in (0, 1, -1, 2) * 2) + "11111" + "00000", [0, 1, -1, 2] * 2 + [0] * 8),
    ):
        if want is None:
            want = [-5]
            for e in (1, -4, 3) * 5:
                want.append(want[-1] + e)
        head = bytes([0xFF, 0xF8, 0b01101101, 0b00001000, 0, 15, 0x1F, 0x40])  # a block of 16 samples, 8000 Hz in two bytes
        head += bytes([crc(head, 0x07, 8)])
        bits = body + "0" * (-len(body) % 8)
        frame = head + int(bits, 2).to_bytes(len(bits) // 8, "big")
        out.append((frame + crc(frame, 0x8005, 16).to_bytes(2, "big"), want))
    return out


def test_streams_written_by_hand_read_right(spark):
    cases = by_hand()
    df = spark.createDataFrame([(i, 0, bytearray(b)) for i, (b, _) in enumerate(cases)], "id long, k int, b binary")
    got = {r.id: r.v for r in lossless.read_frames(df).collect()}
    assert got == {i: [want] for i, (_, want) in enumerate(cases)}
    assert df.select(flac.frame_head(F.col("b")).alias("h")).select("h.*").first().asDict() == {"number": 0, "samples": 16, "rate": 8000, "layout": 0, "width": 16, "size": 9}


def test_damage_gives_no_samples(spark):
    (frame, _), _ = by_hand()
    wrong = [frame[:-1], frame[:20] + bytes([frame[20] ^ 1]) + frame[21:], b"", frame[:8], b"\xff\xf8" * 8]
    df = spark.createDataFrame([(i, 0, bytearray(b)) for i, b in enumerate(wrong)], "id long, k int, b binary")
    assert lossless.read_frames(df).collect() == []


def test_false_marks_are_passed_over(spark):
    (one, _), (two, _) = by_hand()
    head = one[:9]  # a header whose checksum holds, without a frame
    files = [(1, one + two + one, [one, two, one]), (2, b"fLaC\xff\xf8 text \xff\xf9" + one + b"", [one]), (3, head + b"\xff\xf8xx" + two, [two]), (4, b"nothing at all", []), (5, b"", [])]
    inside = b"\xff\xf8" + b"\xff" * 3
    files.append((6, inside + one + two, [one, two]))
    df = spark.createDataFrame([(i, bytearray(b)) for i, b, _ in files], "id long, b binary")
    got = {}
    for r in lossless.frame_spans(df).orderBy("id", "k").collect():
        got.setdefault(r.id, []).append((r.k, bytes(r.b)))
    assert got == {i: list(enumerate(want)) for i, _, want in files if want}
