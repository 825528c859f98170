"""Arrow plumbing shared by the operators that run Python inside tasks."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts are taken from an Arrow batch in portions of about this many characters, which bounds a task's Python objects.
PORTION_CHARS = 2_000_000


_HELD: dict[tuple, object] = {}


def held(key: tuple, make: Callable[[], object]) -> object:
    """What a worker process keeps from one task to the next: one thing at a time, so that stages don't add up."""
    if key not in _HELD:
        _HELD.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # freed memory goes back, so that a worker's stages don't add up
            trim(0)
        _HELD[key] = make()
    return _HELD[key]


def portions(batch: pa.RecordBatch, text: str = "text", chars: int = PORTION_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut a batch in slices of about ``chars`` bytes of text, one row at least."""
    if batch.num_rows == 0:
        return
    lengths = pc.binary_length(batch.column(text)).to_pylist()
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if total and total + (n or 0) > chars:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n or 0
    yield batch.slice(start)


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns that are needed, so that other columns cannot clash with the operator's own."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names that no column has, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def map_portions(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, text: str = "text", setup: Callable[[], object] | None = None) -> DataFrame:
    """mapInArrow over portions of batches. setup() runs once a task and its result is passed to f."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup() if setup else None
        for batch in batches:
            for part in portions(batch, text):
                yield f(part, state) if setup else f(part)

    return df.mapInArrow(run, schema)


def hex_or_null(col: Column) -> Column:
    return F.lower(F.hex(col))


ARROW = {"string": pa.string(), "binary": pa.binary(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
#: Rows of a batch that in_order gives.
ROWS = 5000


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def batches_of(rows: Iterator[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    fields = [x.split() for x in schema.split(", ")]

    def cut(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, ARROW[t]) for v, (_, t) in zip(zip(*out), fields)], [n for n, _ in fields])

    out: list[tuple] = []
    for row in rows:
        out.append(row)
        if len(out) >= ROWS:
            yield cut(out)
            out = []
    if out:
        yield cut(out)


def in_order(df: DataFrame, keys: int, f: Callable[[tuple, Iterator[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """f over the rows of each run of equal first ``keys`` columns, as they stream in the order of the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches_of((row for key, some in groupby(rows_of(batches), itemgetter(*range(keys))) for row in f(key, some)), schema)

    return df.mapInArrow(run, schema)
