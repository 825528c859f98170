"""Snapshots of the cache: whole, once for each batch, safe from failed and rival writers."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pageflow.operators.cache_store import CacheStore, Overtaken

T0 = datetime(2024, 6, 1)


def rows(spark, *items):
    return spark.createDataFrame([("fr", s, t, T0 + timedelta(hours=h)) for s, t, h in items], "target_lang string, source string, translated string, ts timestamp")


def held(store):
    return sorted((r["source"], r["translated"]) for r in store.read().collect())


def test_commits_replays_and_eviction(spark, tmp_path):
    store = CacheStore(spark, str(tmp_path / "c"), days=30, entries=3)
    assert store.version() == 0 and store.read().collect() == []
    assert store.commit(rows(spark, ("a", "A", 0), ("b", "B", 1)), "w", 0) == 1
    assert store.commit(rows(spark, ("a", "A2", 2)), "w", 1) == 2
    assert held(store) == [("a", "A2"), ("b", "B")]
    # the same batch again, and an older one: nothing changes
    assert store.commit(rows(spark, ("a", "again", 9)), "w", 1) == 2 and store.commit(rows(spark, ("z", "Z", 9)), "w", 0) == 2
    assert held(store) == [("a", "A2"), ("b", "B")] and held(CacheStore(spark, store.path)) == held(store)
    # another writer counts for itself; the oldest go beyond the entries, and what is too old
    assert store.commit(rows(spark, ("c", "C", 3), ("d", "D", 4)), "v", 0) == 3
    assert held(store) == [("a", "A2"), ("c", "C"), ("d", "D")]
    assert store.commit(rows(spark, ("e", "E", 24 * 30 + 3)), "v", 1) == 4
    assert held(store) == [("d", "D"), ("e", "E")]
    assert sorted(r["source"] for r in store.read(1).collect()) == ["a", "b"]
    assert store.forget(keep=2) == 2 and held(store) == [("d", "D"), ("e", "E")] and store.version() == 4


def test_a_failed_writer_leaves_the_old_snapshot(spark, tmp_path, monkeypatch):
    store = CacheStore(spark, str(tmp_path / "c"))
    store.commit(rows(spark, ("a", "A", 0)), "w", 0)

    def fail(number, entry):
        raise OSError("lost")

    monkeypatch.setattr(store, "_publish", fail)
    with pytest.raises(OSError):
        store.commit(rows(spark, ("b", "B", 1)), "w", 1)
    monkeypatch.undo()
    assert store.version() == 1 and held(store) == [("a", "A")]
    assert store.commit(rows(spark, ("b", "B", 1)), "w", 1) == 2 and held(store) == [("a", "A"), ("b", "B")]
    assert store.forget() == 1


def test_rival_writers_lose_nothing(spark, tmp_path, monkeypatch):
    store, rival = (CacheStore(spark, str(tmp_path / "c")) for _ in range(2))
    store.commit(rows(spark, ("a", "A", 0)), "w", 0)
    publish, met = store._publish, []

    def late(number, entry):
        if not met:
            met.append(rival.commit(rows(spark, ("r", "R", 1)), "rival", 0))
        publish(number, entry)

    monkeypatch.setattr(store, "_publish", late)
    assert store.commit(rows(spark, ("b", "B", 2)), "w", 1) == 3 and met == [2]
    assert held(store) == [("a", "A"), ("b", "B"), ("r", "R")]
    with pytest.raises(Overtaken):
        publish(3, {"data": "", "writers": {}})


def test_a_stream_writes_the_cache(spark, tmp_path):
    store = CacheStore(spark, str(tmp_path / "c"))
    source = rows(spark, *((f"s{i % 7}", f"t{i}", i) for i in range(30)), ("none", None, 40))
    source.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def run():
        q = stream().writeStream.foreachBatch(store.sink("stream")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None

    run()
    assert held(store) == sorted((f"s{k}", f"t{max(i for i in range(30) if i % 7 == k)}") for k in range(7))
    n = store.version()
    run()
    assert store.version() == n
    # a batch that was published but not noted by the stream is run again and changes nothing
    store.sink("stream")(source.limit(3).withColumn("translated", F.lit("twice")), n - 1)
    assert store.version() == n
