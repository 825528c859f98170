"""Batches of large keys, put together from ranges, against the fold in order."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pageflow.operators import batching, spread


def fold(costs, size, chars):
    out, held, total, batch = [], 0, 0, 0
    for c in costs:
        if held and (chars is not None and total + c > chars or size is not None and held >= size):
            batch, held, total = batch + 1, 0, 0
        out.append(batch)
        held, total = held + 1, total + c
    return out, (batch, held, total)


@pytest.mark.parametrize("size,chars", [(5, 100), (None, 100), (1, 100), (7, None), (None, 0), (3, 1), (None, 10**9), (None, None)])
def test_ranges_put_together(size, chars):
    rng = random.Random(3)
    for _ in range(150):
        costs = [rng.choice([0, 0, 1, 7, 30, 99, 100, 101, 500]) for _ in range(rng.randrange(1, 60))]
        cuts = sorted({0, len(costs), *(rng.randrange(len(costs) + 1) for _ in range(rng.randrange(8)))})
        want, end = fold(costs, size, chars)
        state = None
        for a, b in zip(cuts, cuts[1:]):
            state = spread.through(state, spread.summary(np.array(costs[a:b]), size, chars), size, chars)
            assert state == fold(costs[:b], size, chars)[1]
        assert state == end


def test_chains_by_doubling():
    starts = spread.next_starts(np.array([60, 50, 10, 200, 1, 1]), None, 100)
    assert starts.tolist() == [1, 3, 3, 4, 6, 6]
    count, last = spread.chains(starts)
    assert count.tolist() == [3, 2, 2, 1, 0, 0] and last.tolist() == [4, 4, 4, 4, 4, 5]


@pytest.mark.parametrize("key", [[], ["k"], ["k", "j"]])
def test_one_key_over_many_ranges(spark, key):
    rows = spark.range(4000).selectExpr("id", "case when id % 3 = 0 then null else id % 3 end as k", "'x' as j", "cast(case when id % 17 = 0 then null else pmod(xxhash64(id), 300) end as int) as c").repartition(5)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "9")
        got = {r["id"]: r["batch_id"] for r in spread.spread_batches(rows, key, ["id"], 6, 900, F.col("c")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    keyed = rows.withColumn("all", F.lit(1))
    want = {r["id"]: r["batch_id"] for r in batching.greedy_batches(keyed, key or ["all"], ["id"], 6, 900, F.col("c")).collect()}
    assert got == want and len(got) == 4000


def test_empty_and_clashing(spark):
    none = spark.createDataFrame([], "id long, c int")
    assert spread.spread_batches(none, [], ["id"], 3, 10, F.col("c")).collect() == []
    with pytest.raises(ValueError, match="_cost"):
        spread.spread_batches(none.withColumn("_cost", F.lit(1)), [], ["id"], 3, 10, F.col("c"))
