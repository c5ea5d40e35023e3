"""Functions that SQL text can call."""

from pyspark.sql import functions as F

from fluxtone.functions import adaptive, tables


def test_codecs_and_table_functions_in_sql(spark):
    tables.register(spark)
    data = bytes(range(0, 256, 3))
    df = spark.createDataFrame([(1, bytearray(data), 3), (2, None, 3), (3, bytearray(), 5)], "id long, b binary, bits int")
    want = df.where("id = 1").select(adaptive.ima_decode(adaptive.unpack_codes(F.col("b"), 4)).alias("x"), adaptive.g726_decode(adaptive.unpack_codes(F.col("b"), 3), 3).alias("y")).first()
    got = {r.id: (r.x, r.y) for r in spark.sql("select id, ima_samples(b) as x, g726_samples(b, bits) as y from {d}", d=df).collect()}
    assert got == {1: (want.x, want.y), 2: (None, None), 3: ([], [])}
    page = bytes.fromhex("4f67675300020000000000000000070000000000000000000000")  # a page cut short is none
    files = spark.createDataFrame([(1, bytearray(page)), (2, bytearray(b"fLaC\x81\x00\x00\x02ab")), (3, None)], "id long, b binary")
    assert spark.sql("select t.* from {f} f, lateral ogg_parts(f.b) t", f=files).collect() == []
    assert [tuple(r) for r in spark.sql("select f.id, t.* from {f} f, lateral flac_blocks(f.b) t", f=files).collect()] == [(2, 0, 1, True, 8, 2)]
    assert [r.path for r in spark.sql("select t.path from {f} f, lateral mp4_boxes(f.b) t", f=spark.createDataFrame([(1, bytearray(b"\0\0\0\x08free"))], "id long, b binary")).collect()] == ["/free"]
