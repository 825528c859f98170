"""Splitting of texts for merge-type (BPE) sentencepiece models, shared by counting and encoding.

A merge can only join characters that stand next to each other inside some vocabulary piece. Between two
characters that never do (a "gap"), no merge can happen, so the parts on either side are independent and can be
looked up on their own. Words repeat, so nearly all lookups hit a bounded per-worker cache.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterable
from operator import add

SPACE = "▁"


class PieceModel:
    """Vocabulary of a BPE sentencepiece model: scores by piece, ids by piece, ids of the byte pieces."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        with open(path, "rb") as f:
            proto = pb.ModelProto.FromString(f.read())
        kind = {v: k for k, v in pb.ModelProto.SentencePiece.Type.items()}
        kinds = [kind[p.type] for p in proto.pieces]
        if proto.trainer_spec.model_type != pb.TrainerSpec.BPE or {"UNUSED", "USER_DEFINED"} & set(kinds):
            raise ValueError("only merge-type models without unused or user-defined pieces are supported")
        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        self.score = {p.piece: p.score for p, k in zip(proto.pieces, kinds) if k == "NORMAL"}
        self.id = {p.piece: i for i, (p, k) in enumerate(zip(proto.pieces, kinds)) if k == "NORMAL"}
        self.byte_id = {int(p.piece[3:5], 16): i for i, (p, k) in enumerate(zip(proto.pieces, kinds)) if k == "BYTE"}
        self.unk_id = next(i for i, k in enumerate(kinds) if k == "UNKNOWN")
        self.inner = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        n = proto.normalizer_spec
        self.plain = n.name == "identity" and not n.precompiled_charsmap and n.add_dummy_prefix and n.escape_whitespaces and not n.remove_extra_whitespaces and not proto.trainer_spec.treat_whitespace_as_suffix
        # words can be cut at spaces and lines if no piece runs across either
        self.by_word = self.plain and not any(b[1] == SPACE and b[0] != SPACE or "\n" in b for b in self.inner)

    def normal(self, text: str) -> str:
        if not text:
            return ""
        return SPACE + text.replace(" ", SPACE) if self.plain else self.processor.normalize(text)

    def atoms(self, chunk: str) -> list[str]:
        """Cut a normalised string at its gaps."""
        inner, out, start = self.inner, [], 0
        for i in range(1, len(chunk)):
            if chunk[i - 1 : i + 1] not in inner:
                out.append(chunk[start:i])
                start = i
        out.append(chunk[start:])
        return out


def merge_pairs(symbols: str, rank: dict[str, float]) -> tuple[list[str], int]:
    """Merge adjacent pairs, the lowest rank first and the leftmost of equals; what is left, and the number of merges.

    The symbols are a doubly linked list, the pairs that may merge a heap. A popped pair of which one side has merged
    with another neighbour meanwhile no longer has its size and is passed over.
    """
    n, get, push, pop = len(symbols), rank.get, heapq.heappush, heapq.heappop
    heap = [(r, i, 2) for i, r in enumerate(map(get, map(add, symbols, symbols[1:]))) if r is not None]
    if not heap:
        return list(symbols), 0
    heapq.heapify(heap)
    end, before, merges = list(range(1, n + 1)), list(range(-1, n - 1)), 0  # a symbol is symbols[i:end[i]]; end is 0 once merged away
    while heap:
        _, i, size = pop(heap)
        j = end[i]
        if not j or j >= n or (k := end[j]) - i != size:
            continue
        end[i], end[j] = k, 0
        merges += 1
        if k < n:
            before[k] = i
            if (r := get(symbols[i : end[k]])) is not None:
                push(heap, (r, i, end[k] - i))
        if (h := before[i]) >= 0 and (r := get(symbols[h:k])) is not None:
            push(heap, (r, h, k - h))
    out, i = [], 0
    while i < n:
        out.append(symbols[i : end[i]])
        i = end[i]
    return out, merges


class ChunkCache(dict):
    """Values by chunk, computed on first use and forgotten all at once when too many."""

    def __init__(self, make: Callable[[str], object], limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key: str):
        value = self.make(key)
        if len(self) >= self.limit:
            self.clear()
        self[key] = value
        return value


class Chunks:
    """Turn a text into values of its chunks, in order; ``atom(str)`` gives an atom's value and ``join`` adds them up."""

    #: Distinct words and atoms that a worker remembers.
    WORDS, ATOMS = 400_000, 1_000_000

    def __init__(self, model: PieceModel, atom: Callable[[str], object], join: Callable[[Iterable], object]):
        self.model, self.join = model, join
        self.atom = ChunkCache(atom, self.ATOMS)
        self.full = ChunkCache(lambda s: join([self.atom[a] for a in model.atoms(s)]), self.WORDS)
        self.spaced = ChunkCache(lambda w: join([self.atom[a] for a in model.atoms(SPACE + w)]), self.WORDS)
        self.bare = ChunkCache(lambda w: join([self.atom[a] for a in model.atoms(w)] if w else []), self.WORDS)
        self.runs = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def value(self, text: str | None):
        if not text:
            return self.join([])
        if not self.model.by_word:
            return self.full[self.model.normal(text)] if len(text) < 64 else self.join([self.atom[a] for a in self.model.atoms(self.model.normal(text))])
        out, line_end = [], self.atom["\n"]
        spaced, bare = self.spaced.__getitem__, self.bare.__getitem__
        for i, line in enumerate(text.split("\n")):
            if i:
                out.append(line_end)
            words = line.split(" ")
            if SPACE in line or len(words) > 1 and "" in words:  # runs of spaces merge with each other first
                whole = line.replace(" ", SPACE) if i else SPACE + line.replace(" ", SPACE)
                out.extend(map(self.full.__getitem__, self.runs.findall(whole)))
            elif i:
                out.append(bare(words[0]))
                out.extend(map(spaced, words[1:]))
            else:
                out.extend(map(spaced, words))
        return self.join(out)
