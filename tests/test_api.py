import pytest

from tessera.plans.api import NotFound, Refused, Store


def test_store(spark):
    s = Store.empty(spark, chunk_size=4, quotas=(("n", 40),))
    s = s.put("/n/a", b"abcdefghij", expected=0)
    s = s.put("/n/b", b"abcdxxxx")
    assert s.chunks.count() == 4
    assert s.get("/n/a") == b"abcdefghij" and [r.idx for r in s.manifest("/n/a").collect()] == [0, 1, 2]
    with pytest.raises(Refused, match="conflict"):
        s.put("/n/a", b"new", expected=0)
    s = s.put("/n/a", b"new", expected=1)
    assert s.get("/n/a") == b"new" and s.get("/n/a", 1) == b"abcdefghij"
    assert [(r.path, r.v) for r in s.list("/n/").collect()] == [("/n/a", 2), ("/n/b", 1)]
    s = s.delete("/n/b")
    with pytest.raises(NotFound):
        s.get("/n/b")
    assert [r.path for r in s.deleted().collect()] == ["/n/b"]
    assert [r.v for r in s.log("/n/a").collect()] == [1, 2]
    with pytest.raises(Refused, match="quota"):
        s.put("/n/c", b"x" * 99)


def test_uploads_and_administration(spark):
    s = Store.empty(spark, chunk_size=4)
    s, up = s.begin("/n/r", 10, request="q")
    assert s.begin("/n/r", 10, request="q")[1] == up
    s = s.append(up, 0, b"abcdefgh")
    assert s.offset(up) == 8
    with pytest.raises(Refused, match="offset"):
        s.append(up, 4, b"xx")
    with pytest.raises(Refused, match="invalid"):
        s.append(up, 8, b"toolong")
    with pytest.raises(Refused, match="unclaimed"):
        s.commit(up)
    s = s.append(up, 8, b"ij").commit(up)
    assert s.get("/n/r") == b"abcdefghij"
    s = s.delete("/n/r").undelete("/n/r")
    assert s.get("/n/r") == b"abcdefghij" and [(r.v, r.size) for r in s.list("/n/").collect()] == [(3, 10)]
    assert [r.idx for r in s.stat("/n/r").collect()] == [0, 1, 2]
    s, other = s.begin("/n/x", 4)
    with pytest.raises(Refused, match="not found"):
        s.abort(other).commit(other)


def test_node_admin(spark):
    s = Store.empty(spark)
    s = Store(spark, s.ops, s.chunks, s.locations, spark.createDataFrame([(1, 1, 0, True, False, "active")], s.nodes.schema))
    with pytest.raises(Refused):
        s.node_admin(1, "decommissioned")
    s = s.node_admin(1, "draining").node_admin(1, "decommissioned")
    with pytest.raises(Refused):
        s.node_admin(1, "draining")
    assert [r.admin for r in s.node_admin(1, "active").nodes.collect()] == ["active"]
