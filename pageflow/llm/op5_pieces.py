"""Operator 5: SentencePiece encoding and decoding for merge-type vocabularies.

Encoding keeps an agenda of adjacent symbol pairs ordered by score, then position, and takes the best until none is
left. Every text of an Arrow batch is checked whole against the sentencepiece library, however long it is; a difference
raises. ``checked`` is the share of the texts, by a hash of the text, that are checked so (all by default); with less, the
sequences that are new to a worker and texts with runs of spaces or line ends among them are still all checked.
Decoding is the library's decode(ids).

Null and empty texts give the begin and end ids alone and decode to an empty string. Repeated rows give repeated
results, an empty table an empty one; null ids are kept. Only the id and text columns are read.
Memory: one portion of a batch and bounded caches per worker.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pageflow.llm.batches import held, id_and_text, map_portions
from pageflow.llm.pieces import SPACE, Chunks, PieceModel, merge_pairs
from pageflow.session import ship


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, without begin and end."""

    def __init__(self, path: str, checked: float = 1.0):
        self.checked = checked
        self.model = PieceModel(path)
        self.rank = {p: -s for p, s in self.model.score.items()}
        self.fresh: list[tuple[str, bytes]] = []
        self.chunks = Chunks(self.model, self._atom, b"".join)

    def _atom(self, atom: str) -> bytes:
        m, ids = self.model, []
        for piece in merge_pairs(atom, self.rank)[0]:
            if piece in m.id:
                ids.append(m.id[piece])
            elif m.byte_id:
                ids.extend(m.byte_id[b] for b in piece.encode())
            else:
                ids.append(m.unk_id)
        value = np.array(ids, "<u4").tobytes()
        if m.by_word:
            self.fresh.append((atom, value))
        return value

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out = [self.chunks.value(t) for t in texts]
        self._check(texts, out)
        return out

    def _check(self, texts: list[str | None], out: list[bytes]) -> None:
        import xxhash

        sp = self.model.processor
        if self.fresh and self.checked < 1:
            # after a line end, an atom stands alone as it does in a text
            skip = len(sp.encode("\n", num_threads=1))
            theirs = sp.encode(["\n" + a.replace(SPACE, " ") for a, _ in self.fresh], num_threads=1)
            for (atom, ours), ids in zip(self.fresh, theirs):
                if np.array(ids[skip:], "<u4").tobytes() != ours:
                    raise AssertionError(f"the library encodes {atom!r} as {ids[skip:]}")
        self.fresh.clear()
        for text, ours in zip(texts, out):
            if text and (self.checked >= 1 or not self.model.by_word or SPACE in text or "  " in text or "\n" in text or xxhash.xxh32_intdigest(text.encode()) < self.checked * 2**32):
                if np.array(sp.encode(text, num_threads=1), "<u4").tobytes() != ours:
                    raise AssertionError("the library encodes a text otherwise")


def encoder(path: str, checked: float = 1.0) -> Encoder:
    """One per worker process."""
    return held(("pieces", path, checked), lambda: Encoder(path, checked))


def encode_texts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", checked: float = 1.0) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit, with begin and end ids) and the text decoded from them."""
    ship(docs.sparkSession)

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = encoder(model_path, checked)
        sp = own.model.processor
        begin, end = (np.array([i], "<u4").tobytes() for i in (sp.bos_id(), sp.eos_id()))
        ids = [begin + x + end for x in own.encode(batch.column("text").to_pylist())]
        decoded = [sp.decode(np.frombuffer(x, "<u4").tolist()) for x in ids]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    return map_portions(id_and_text(docs, id_col, text_col), encode, "doc_id long, ids binary, decoded string")


def encode_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", checked: float = 1.0) -> DataFrame:
    """The same, reduced to digests inside the task: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    ship(docs.sparkSession)

    def digest(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = encoder(model_path, checked)
        sp = own.model.processor
        begin, end = (np.array([i], "<u4").tobytes() for i in (sp.bos_id(), sp.eos_id()))
        n, ids_sha, text_sha = [], [], []
        for x in own.encode(batch.column("text").to_pylist()):
            x = begin + x + end
            n.append(len(x) // 4)
            ids_sha.append(hashlib.sha256(x).hexdigest())
            text_sha.append(hashlib.sha256(sp.decode(np.frombuffer(x, "<u4").tolist()).encode()).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_portions(id_and_text(docs, id_col, text_col), digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
