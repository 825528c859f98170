"""Greedy batches of keys that are larger than a task.

A fold over a key's rows in order needs the state before each row. Rows are dealt to ranges of key and order; a range that
begins in the middle of a batch needs two numbers of it, how many rows and which cost it holds. Whatever they are, that
batch ends at one of the range's first rows, and from there on everything is known. So each range tells, in parallel, for
each of those rows how many batches follow in it and what is left open at its end: where each row's batch would end is found
by binary search in the running costs, the chain of batches by pointer doubling. These summaries, a row for each range and
key, are folded in order; then all ranges number their rows from the state they are given, in parallel again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageflow.operators.batching import fold_in_order
from pageflow.session import materialise, ship

#: No limit.
NONE = 1 << 62


def next_starts(costs: np.ndarray, size: int | None, chars: int | None) -> np.ndarray:
    """For each row, the row before which a batch that begins with it ends, or their number: it is still open then."""
    n, at = len(costs), np.arange(len(costs))
    total = np.concatenate([[0], np.cumsum(costs)])
    out = np.searchsorted(total, total[:-1] + (NONE if chars is None else chars), side="right") - 1
    return np.minimum(np.maximum(at + 1, np.minimum(out, at + (size or n + 1))), n)


def chains(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row as the first of a batch: how many batches begin after it in the range, and with which row the last one does."""
    n = len(starts)
    # pointer doubling; a batch that is open at the end points to itself
    to = np.where(starts < n, starts, np.arange(n))
    count = (starts < n).astype(np.int64)
    while (count[to] > 0).any():
        count, to = count + count[to], to[to]
    return count, to


def summary(costs: np.ndarray, size: int | None, chars: int | None) -> dict:
    """What a range does to an open batch: its first rows' running costs, and for each of them as a batch's first row what comes of it."""
    n, total = len(costs), np.cumsum(costs)
    # an open batch holds a row at least: it has ended at the latest before this row
    latest = min(n, int(np.searchsorted(total, NONE if chars is None else chars, side="right")), (size or n + 1) - 1)
    m = min(n, latest + 1)
    count, last = chains(next_starts(costs, size, chars))
    return {"n": n, "total": int(total[-1]), "head": total[:m], "batches": count[:m], "held": n - last[:m], "open": total[-1] - total[last[:m]] + costs[last[:m]]}


def through(state: tuple[int, int, int] | None, s: dict, size: int | None, chars: int | None) -> tuple[int, int, int]:
    """(batch, rows held, cost held) after a range, from those before it (None: the key's first range)."""
    batch, held, total = state or (0, 0, 0)
    at = 0
    if held:
        fits = np.searchsorted(np.asarray(s["head"]), (NONE if chars is None else chars) - total, side="right")
        at = max(0, min(int(fits), (size - held) if size is not None else s["n"]))
        if at >= s["n"]:
            return batch, held + s["n"], total + s["total"]
        batch += 1
    return batch + int(s["batches"][at]), int(s["held"][at]), int(s["open"][at])


def _runs(parts: Iterator[pd.DataFrame], key: list[str]) -> Iterator[tuple[bool, tuple, pd.DataFrame]]:
    """Stretches of rows of one range and key, and whether each begins one."""
    last = None
    for pdf in parts:
        keys = list(zip(pdf["_range"].tolist(), *(pdf[k].astype(object).where(pdf[k].notna(), None).tolist() for k in key)))
        cuts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
        for a, b in zip(cuts, [*cuts[1:], len(keys)]):
            yield keys[a] != last, keys[a], pdf.iloc[a:b]
            last = keys[a]


def spread_batches(rows: DataFrame, key: list[str], order: list[str], size: int | None, chars: int | None, cost: Column) -> DataFrame:
    """greedy_batches for keys of any size: rows with batch_id, no task holding more than its range. key may be empty: one for all rows.

    The order must be a total one; ties would be cut in any way. Columns _range, _cost, _batch, _held and _total are its own.
    A null cost counts as 0. An empty table gives an empty one.
    """
    if taken := {"_range", "_cost", "_batch", "_held", "_total", "batch_id"} & set(rows.columns):
        raise ValueError(f"columns with names of their own: {sorted(taken)}")
    ship(rows.sparkSession)
    costed = rows.withColumn("_cost", F.coalesce(cost, F.lit(0)).cast("long"))
    ranged = materialise(costed.repartitionByRange(*key, *order).withColumn("_range", F.spark_partition_id()), "spread")
    ordered = ranged.repartition("_range").sortWithinPartitions("_range", *key, *order)
    kinds = [rows.schema[k] for k in key]
    numbers = lambda *names: [T.StructField(n, T.LongType()) for n in names]
    lists = [T.StructField(n, T.ArrayType(T.LongType())) for n in ("head", "batches", "held", "open")]
    told = T.StructType([T.StructField("_range", T.IntegerType()), *kinds, *numbers("n", "total"), *lists])

    def summarise(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, costs = None, []

        def leave():
            s = summary(np.concatenate(costs), size, chars)
            return pd.DataFrame([dict(zip([f.name for f in told.fields], [*at, s["n"], s["total"], *(s[f.name].tolist() for f in lists)]))]).astype({k: object for k in key})

        for begins, k, pdf in _runs(parts, key):
            if begins and costs:
                yield leave()
                costs = []
            at = k
            costs.append(pdf["_cost"].to_numpy(np.int64))
        if costs:
            yield leave()

    narrow = ordered.select("_range", *key, *[o for o in order if o not in key], "_cost")
    summaries = materialise(narrow.mapInPandas(summarise, told), "spread-told")
    entered = T.StructType([T.StructField("_range", T.IntegerType()), *kinds, *numbers("_batch", "_held", "_total")])

    def enter(state, pdf: pd.DataFrame):
        out = []
        for s in pdf.to_dict("records"):
            out.append(state or (0, 0, 0))
            state = through(state, s, size, chars)
        return state, pdf[["_range", *key]].assign(**{c: [o[i] for o in out] for i, c in enumerate(("_batch", "_held", "_total"))})

    # one small row for each range of a key
    one = summaries.withColumn("_all", F.lit(0))
    states = fold_in_order(one, key or ["_all"], ["_range"], entered, enter)
    states = materialise(states, "spread-states")
    on = F.col("_range") == F.col("_r")
    for i, k in enumerate(key):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    known = states.select(F.col("_range").alias("_r"), *(F.col(k).alias(f"_k{i}") for i, k in enumerate(key)), "_batch", "_held", "_total")
    given = ranged.join(known, on).select(*ranged.columns, "_batch", "_held", "_total").repartition("_range").sortWithinPartitions("_range", *key, *order)
    out, own = T.StructType([*rows.schema.fields, T.StructField("batch_id", T.IntegerType())]), rows.columns

    def number(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        batch = held = total = 0
        for begins, _, pdf in _runs(parts, key):
            if begins:
                batch, held, total = (int(pdf[c].iloc[0]) for c in ("_batch", "_held", "_total"))
            ids = []
            for c in pdf["_cost"].tolist():
                if held and (chars is not None and total + c > chars or size is not None and held >= size):
                    batch, held, total = batch + 1, 0, 0
                ids.append(batch)
                held, total = held + 1, total + c
            yield pdf[own].assign(batch_id=np.array(ids, np.int32))

    return given.mapInPandas(number, out)
