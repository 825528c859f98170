"""Ordered folds: greedy batches, packed groups and long texts cut at sentences.

A fold with resets is no plain window. Rows of a key are sorted and folded in order as they stream through one task, with
a small state carried on; a finer key (a page, a conversation) keeps batches independent of others and spreads the work.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pageflow.config import REQUEST_CHARS
from pageflow.functions.text import sentences, utf16_length
from pageflow.session import materialise, portions, ship


def fixed_batches(rows: DataFrame, key: list[str], order: list[str], size: int) -> DataFrame:
    """rows with batch_id: every ``size`` rows of a key, in order.

    Rows are dealt to ranges of key and order, numbered there, and shifted by the counts of the ranges before: a key of
    many rows lies in many ranges. Null keys are a key; ties in the order are numbered in any order.
    """
    ranged = materialise(rows.repartitionByRange(*key, *order).withColumn("_range", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("_range", *key).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(F.col("_range").alias("_r"), *(F.col(k).alias(f"_k{i}") for i, k in enumerate(key)), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    here = F.row_number().over(Window.partitionBy("_range", *key).orderBy(*order))
    on = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key)), F.col("_range") == F.col("_r"))
    return ranged.withColumn("_here", here).join(before, on).select(*rows.columns, F.floor((F.col("_before") + F.col("_here") - 1) / size).cast("int").alias("batch_id"))


def fold_in_order(rows: DataFrame, key: list[str], order: list[str], schema: str | T.StructType, step: Callable[[object, pd.DataFrame], tuple[object, pd.DataFrame]]) -> DataFrame:
    """An ordered fold over each key: rows are dealt by key, sorted by key and order, and streamed batch by batch.

    step takes the state after the key's rows so far (None at first) and its next rows; it gives the new state and rows.
    Nothing but one batch and one state is held, so a key of many rows takes time but no memory; sorting spills.
    """
    ship(rows.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        for pdf in parts:
            keys = pd.MultiIndex.from_frame(pdf[key].astype(object).where(pdf[key].notna(), None))
            changed = np.flatnonzero([x != y for x, y in zip(keys, [last, *keys[:-1]])])
            starts = sorted({0, *changed.tolist()}) if len(pdf) else []
            for a, b in zip(starts, [*starts[1:], len(pdf)]):
                if keys[a] != last:
                    last, state = keys[a], None
                state, out = step(state, pdf.iloc[a:b])
                yield out

    return rows.repartition(*key).sortWithinPartitions(*key, *order).mapInPandas(run, schema)


def greedy_batches(rows: DataFrame, key: list[str], order: list[str], size: int | None, chars: int | None, cost: Column) -> DataFrame:
    """rows with batch_id: a batch closes before a row that would exceed ``chars`` and after its ``size``-th row.

    A row dearer than ``chars`` travels alone; a sum equal to it fits. A null cost counts as 0.
    """
    costed = rows.withColumn("_cost", F.coalesce(cost, F.lit(0)).cast("long"))
    schema = T.StructType([*rows.schema.fields, T.StructField("batch_id", T.IntegerType())])

    def fold(state, pdf: pd.DataFrame):
        batch, held, total = state or (0, 0, 0)
        ids = []
        for c in pdf["_cost"].tolist():
            if held and (chars is not None and total + c > chars or size is not None and held >= size):
                batch, held, total = batch + 1, 0, 0
            ids.append(batch)
            held, total = held + 1, total + c
        return (batch, held, total), pdf.drop(columns="_cost").assign(batch_id=np.array(ids, np.int32))

    return fold_in_order(costed, key, order, schema, fold)


def packed_groups(rows: DataFrame, key: list[str], order: list[str], text: str, limit: int = REQUEST_CHARS) -> DataFrame:
    """rows with batch_id: texts joined by line ends in requests of ``limit`` characters, the line end counted."""
    return greedy_batches(rows, key, order, None, limit, utf16_length(F.col(text)) + 1)


#: Bytes of texts whose sentences a task holds as Python's strings at once, about.
PORTION = 2_000_000


def long_parts(rows: DataFrame, text: str, limit: int = REQUEST_CHARS) -> DataFrame:
    """rows exploded to part and part_text: whole sentences up to ``limit`` characters; a longer sentence is cut hard.

    Memory: an Arrow batch of rows, and the sentences and parts of about PORTION bytes of texts, one text at least.
    """
    ship(rows.sparkSession)

    def cut(pieces: list[str]) -> list[str]:
        parts, now, units = [], "", 0
        for p in pieces:
            u = p.encode("utf-16-le", "surrogatepass")
            while len(u) > 2 * limit:
                if now:
                    parts.append(now)
                    now, units = "", 0
                head = u[: 2 * limit]
                if 0xD8 <= head[-1] <= 0xDB:  # never half a character
                    head = head[:-2]
                parts.append(head.decode("utf-16-le"))
                u = u[len(head) :]
            n = len(u) // 2
            if units + n > limit:
                parts.append(now)
                now, units = "", 0
            now, units = now + u.decode("utf-16-le"), units + n
        return [*parts, now] if now else parts

    kept = len(rows.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in portions(batch, batch.schema.names[kept + 1], PORTION):
                parts = [cut(p) if p else [] for p in some.column(kept).to_pylist()]
                row = pa.array([i for i, x in enumerate(parts) for _ in x], pa.int64())
                place = pa.array([n for x in parts for n in range(len(x))], pa.int32())
                texts = pa.array([t for x in parts for t in x], pa.string())
                yield pa.RecordBatch.from_arrays([*(some.column(c).take(row) for c in range(kept)), place, texts], [*batch.schema.names[:kept], "part", "part_text"])

    schema = T.StructType([*rows.schema.fields, T.StructField("part", T.IntegerType(), False), T.StructField("part_text", T.StringType())])
    return rows.select("*", sentences(F.col(text)).alias("_pieces"), F.octet_length(text).alias("_bytes")).mapInArrow(run, schema)
