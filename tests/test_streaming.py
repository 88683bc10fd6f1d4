"""Streams give what the batch forms give."""

from tessera.operators import cluster
from tessera.streaming import stateful


def drain(spark, df, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_beats_once(spark, tmp_path):
    schema = "node long, incarnation string, seq long, t long"
    data = [(1, "a", 1, 0), (1, "a", 3, 1), (1, "a", 2, 2), (1, "b", 1, 3), (2, "a", 5, 0), (2, "a", 5, 1)]
    spark.createDataFrame(data, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    got = drain(spark, stateful.beats_once(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), tmp_path, "beats_once")
    batch = cluster.deduplicate_beats(spark.createDataFrame(data, schema))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.select("node", "incarnation", "seq", "t").collect()))


def test_detect_and_reconcile(spark, tmp_path):
    schema = "node long, t long, seq long, restarted boolean, kind string"
    data = [(1, 0, 1, False, "beat")] + [(1, t, 0, False, "tick") for t in range(500, 12001, 500)]
    spark.createDataFrame(data, schema).coalesce(1).write.parquet(str(tmp_path / "ev"))
    got = drain(spark, stateful.detect(spark.readStream.schema(schema).parquet(str(tmp_path / "ev"))), tmp_path, "detect")
    assert [(r.t, r.state) for r in got.orderBy("t").collect()] == [(0, "alive"), (3500, "suspect"), (10500, "dead")]

    schema = "node long, incarnation string, seq long, is_full boolean, added array<long>, deleted array<long>, t long"
    data = [(1, "a", 1, True, [1, 2], [], 1), (1, "a", 3, False, [3], [1], 2), (1, "a", 2, True, [1, 2], [], 3)]
    spark.createDataFrame(data, schema).coalesce(1).write.parquet(str(tmp_path / "rep"))
    got = drain(spark, stateful.reconcile(spark.readStream.schema(schema).parquet(str(tmp_path / "rep"))), tmp_path, "reconcile")
    assert sorted(map(tuple, got.collect())) == [(1, 1, 1, "added"), (1, 1, 2, "added"), (1, 3, 1, "removed"), (1, 3, 3, "added")]
