"""Operator 9: token counts by heap-and-linked-list byte-pair merging.

Symbols are a doubly linked list and the adjacent pairs that may merge stand in a heap by rank. The lowest-rank pair
is popped again and again; the count is the initial symbols minus the merges, so no identifier is ever built. A symbol
that stays outside the vocabulary counts as its UTF-8 bytes (byte fallback) or as one unknown token.

Null and empty texts have 0 tokens and 0 bytes. Repeated rows give repeated results, an empty table an empty one.
Rows whose id is null are kept with a null id. Only the id and text columns are read, so other columns cannot clash.
Memory: one portion of a batch and a bounded cache of word counts per worker.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from pageflow.llm.batches import held, id_and_text, map_portions
from pageflow.llm.pieces import Chunks, PieceModel, merge_pairs
from pageflow.session import ship

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def merge_count(symbols: str, rank: dict[str, float], fallback: bool = True) -> int:
    """Tokens of one atom. rank: lower merges first; ties go to the leftmost pair."""
    n = len(symbols)
    if n == 1:
        return 1 if symbols in rank or not fallback else len(symbols.encode())
    left, merges = merge_pairs(symbols, rank)
    count = n - merges
    return count + sum(len(p.encode()) - 1 for p in left if p not in rank) if fallback else count


def counter(path: str) -> Chunks:
    """One per worker process; its caches are bounded."""
    return held(("counts", path), lambda: _counter(path))


def _counter(path: str) -> Chunks:
    model = PieceModel(path)
    rank = {p: -s for p, s in model.score.items()}
    fallback = bool(model.byte_id)
    return Chunks(model, lambda atom: merge_count(atom, rank, fallback), sum)


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs."""
    ship(docs.sparkSession)

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        value = counter(model_path).value
        texts = batch.column("text").to_pylist()
        tokens = [value(t) for t in texts]
        bytes_ = [len(t.encode()) if t else 0 for t in texts]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(bytes_, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return map_portions(id_and_text(docs, id_col, text_col), count, SCHEMA)
