"""Cases of the life cycles that the catalogue's tables do not reach."""

from pyspark.sql import functions as F

from tessera.functions import scalars
from tessera.operators import lifecycle as L


def test_crc32c(spark):
    d = spark.createDataFrame([(bytearray(b"123456789"),), (bytearray(b""),), (None,), (bytearray(b"a" * 1000),), (bytearray(32),)], "b binary")
    got = [r.c for r in d.select(scalars.crc32c(F.col("b")).alias("c")).collect()]
    assert got[:3] == [0xE3069283, 0, None] and got[4] == 0x8A9136AA


def test_trims_and_deletes(spark):
    e = spark.createDataFrame([(1, 1, 5, "intent"), (1, 2, 6, "intent"), (1, 3, 6, "done"), (1, 4, 5, "done"), (1, 5, 6, "intent")], "id long, pos long, node long, kind string")
    assert [r.accepted for r in L.trim_events(e).orderBy("pos").collect()] == [True, False, False, True, True]
    g = spark.createDataFrame([(1, 5, 1, "mark"), (1, 5, 2, "intent"), (1, 5, 3, "unmark"), (1, 5, 4, "intent"), (1, 5, 5, "intent"), (2, 5, 6, "intent"), (2, 5, 7, "done")], "id long, node long, pos long, kind string")
    assert [tuple(r) for r in L.gc_pending(g).collect()] == [(1, 5, 4)]


def test_floor(spark):
    s = spark.createDataFrame([(1, 1, 3, 0), (1, 2, 1, 1), (1, 3, 0, 0), (2, 1, 1, 0)], "id long, t long, have long, lost long")
    assert sorted(tuple(r) for r in L.floor_breaches(s, 3, 2).collect()) == [(1, 3, 0, 1), (2, 1, 1, 2)]


def test_peer_list_and_rows(spark):
    d = spark.createDataFrame([("1=a:7,bad,2=b.c:80,=x:1",)], "t string")
    assert [tuple(x) for x in d.select(scalars.peer_list(F.col("t")).alias("p")).first().p] == [("1", "a", 7), ("2", "b.c", 80)]
    assert d.select(scalars.markdown_row(F.lit("a|b"), F.lit(None)).alias("m")).first().m == "| a\\|b |  |"
