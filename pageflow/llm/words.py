"""Token ids by the tokenizers library, looked up by word.

If a tokenizer drops white space and treats each word alone (its file says so), the pieces that its own pattern cuts from
words are independent too. Words of ASCII and the letters up to ÿ are cut to pieces by classes of bytes, a stretch of texts at a time;
any other word is looked up whole. Each distinct piece or word of a stretch is looked up once, is given to the library once per worker
and is remembered. Any other tokenizer gets whole texts.
"""

from __future__ import annotations

import gc
import json
import os
import re

import numpy as np
import pyarrow as pa

from pageflow.llm.batches import held


#: Pieces of words in one call of the library.
TOGETHER = 64
#: Bytes of texts that are cut together.
STRETCH = 4_000_000
#: The pattern whose pieces the classes of bytes give.
BY_CLASS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Classes of bytes; a word with a byte of the last one is not cut.
SPACE, LETTER, DIGIT, SIGN, WHOLE = range(5)
#: The first of the two bytes of the letters from À to ÿ, and their last bytes in lower case (0: × and ÷, no letters).
LEAD = 0xC3
MARKED = np.arange(256, dtype=np.uint8)
MARKED[0x80:0x9F] += 0x20
MARKED[[0x97, 0xB7]] = 0
BLANK = re.compile(rb"[\t-\r ]")
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)


def byte_classes(pattern: str, special: list[str]) -> np.ndarray:
    """The class of each byte. Contractions and special strings are parts of whole words. Of letters with marks, those of LEAD
    are cut too; another first byte than that makes its word whole, so later bytes may be letters always."""
    out = np.full(256, WHOLE, np.uint8)
    if pattern == BY_CLASS:
        out[0x80:0xC0] = out[LEAD] = LETTER
        out[0x21:0x7F] = SIGN
        out[[*b"0123456789"]] = DIGIT
        out[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
        out[[*b"'", *(t.encode()[0] for t in special)]] = WHOLE
    out[[*b"\t\n\x0b\x0c\r "]] = SPACE
    return out


def split(values: pa.BinaryArray) -> list[bytes]:
    """The values as Python's bytes."""
    _, offsets, data = values.buffers()
    cut, data = np.frombuffer(offsets, np.int32)[: len(values) + 1].tolist(), (data or pa.py_buffer(b"")).to_pybytes()
    return [data[x:y] for x, y in zip(cut, cut[1:])]


class WordIds:
    #: Distinct pieces and whole words that a worker remembers, and their bytes: words without spaces between are long.
    KNOWN, KNOWN_BYTES = 1_200_000, 64_000_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 65_536 else "<u4"
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.marks = os.path.commonprefix(self.special)  # what all special strings begin with
        self.pattern = self._word_pattern(spec)
        suffix = spec["model"].get("end_of_word_suffix")
        vocab = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.ends_word[[i for t, i in vocab.items() if suffix and t.endswith(suffix)]] = True
        self.known: dict[bytes, bytes] = {}
        self.known_bytes = 0
        self.classes = byte_classes(self.pattern.pattern if self.pattern else "", self.special)
        # letters without combining marks and with context-free lower case
        self.simple = re.compile("[\x21-\x7eÀ-įı-ɏ]+")

    @staticmethod
    def _word_pattern(spec: dict):
        """The pattern that cuts words in pieces, or None if words aren't independent."""
        import regex

        normal = [(n["type"], n.get("content")) for n in (spec["normalizer"] or {}).get("normalizers", [])]
        cut = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        if normal != [("NFC", None), ("Replace", " "), ("Lowercase", None)] or spec["truncation"] or spec["padding"]:
            return None
        if [c["type"] for c in cut] != ["Split", "ByteLevel"] or cut[0]["behavior"] != "Removed" or not cut[0]["invert"] or cut[1]["add_prefix_space"] or cut[1]["use_regex"]:
            return None
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["content"].split() != [t["content"]] for t in spec["added_tokens"]):
            return None
        return regex.compile(cut[0]["pattern"]["Regex"])

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _library_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Pieces of words, many to a call: each ends with the only id that ends a word."""
        out: list[bytes] = []
        groups = [pieces[i : i + TOGETHER] for i in range(0, len(pieces), TOGETHER)]
        for group, ids in zip(groups, self._library([b" ".join(g).decode() for g in groups])):
            got = np.frombuffer(ids, self.dtype)
            ends = np.flatnonzero(self.ends_word[got]) + 1
            if len(ends) == len(group) and ends[-1] == len(got):
                size = got.itemsize
                cut = [0, *(ends * size).tolist()]
                out += [ids[x:y] for x, y in zip(cut, cut[1:])]
            else:
                out += self._library([p.decode() for p in group])
        return out

    def _learn(self, words: set[bytes]) -> None:
        """Give new words, or their pieces, to the library."""
        simple, known = self.simple.fullmatch, self.known
        self.known_bytes += sum(map(len, words))
        letters = self.classes[0x61] == LETTER  # a run of letters is a piece
        keys = list(words)
        text = b"\n".join(keys).decode()  # words hold no line end
        special = any(t in text for t in self.special)
        new, cut, whole = set(), [], []
        for word, s in zip(keys, text.split("\n")):
            if not simple(s) or special and self.marks in s and any(t in s for t in self.special):
                whole.append(word)
            elif letters and s.isalpha() and s.islower():
                new.add(word)
            else:
                cut.append((word, [p.encode() for p in self.pattern.findall(s.lower())]))
        new.update(p for _, ps in cut for p in ps)
        fresh = list(new.difference(known))
        known.update(zip(fresh, self._library_pieces(fresh)))
        for word, ps in cut:
            known[word] = known[ps[0]] if len(ps) == 1 else b"".join([known[p] for p in ps])
        known.update(zip(whole, self._library([w.decode() for w in whole])))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as bytes of ``dtype``."""
        ids, starts = self.coded(pa.array(texts, pa.large_string()))
        return [ids[x:y].tobytes() for x, y in zip(starts.tolist(), starts[1:].tolist())]

    def coded(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts after one another, each with the end id if one is given; where each text's begin, and the end of all."""
        if self.pattern is None:
            parts = [np.frombuffer(x, self.dtype) for x in self._library([t or "" for t in texts.to_pylist()])]
            ids, starts = np.concatenate([*parts, np.zeros(0, self.dtype)]), np.cumsum([0, *map(len, parts)])
        else:
            # a portion's many small objects hold no cycles, so the collector would only walk them again and again
            collects = gc.isenabled()
            gc.disable()
            try:
                ids, starts = self._by_word(texts.fill_null("").cast(pa.large_string()))
            finally:
                if collects:
                    gc.enable()
        if end_id is not None:
            ids, starts = np.insert(ids, starts[1:], end_id), starts + np.arange(len(starts))
        return ids, starts

    def _by_word(self, texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        n, (_, offsets, data) = len(texts), texts.buffers()
        first = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
        chars = np.frombuffer(data or b"", np.uint8)[first[0] : first[-1]]
        first = first - first[0]
        starts, parts, total, low = np.zeros(n + 1, np.int64), [np.zeros(0, self.dtype)], 0, 0
        while low < len(chars):
            high = len(chars)
            if high - low > STRETCH and (blank := BLANK.search(chars, low + STRETCH)):
                high = blank.start()
            here = slice(*np.searchsorted(first, (low, high)))  # the texts that begin in the stretch
            ids, at, before = self._stretch(chars[low:high], first[here] - low)
            starts[here] = total + before[np.searchsorted(at, first[here] - low)]
            parts.append(ids)
            total, low = total + len(ids), high
        starts[np.searchsorted(first, len(chars)) :] = total
        return np.concatenate(parts), starts

    def _stretch(self, chars: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a stretch of texts, where its pieces begin, and the ids before each piece (and before the end)."""
        kind = self.classes[chars]
        solid = kind != SPACE
        new = np.ones(len(kind), bool)
        np.not_equal(kind[1:], kind[:-1], out=new[1:])
        new |= kind == DIGIT
        new[begins] = True
        new &= solid
        keys = LOWER[chars]
        if (marked := np.flatnonzero(chars == LEAD) + 1).size:
            keys[marked] = MARKED[chars[marked]]
            kind[marked[keys[marked] == 0]] = WHOLE
        if (odd := np.flatnonzero(kind == WHOLE)).size:
            word_begins = solid.copy()
            word_begins[1:] &= ~solid[:-1]
            word_begins[begins] = solid[begins]
            word = np.cumsum(word_begins, dtype=np.int32)
            uncut = np.zeros(int(word[-1]) + 1, bool)
            uncut[word[odd]] = True
            inside = uncut[word] & solid
            new = np.where(inside, word_begins, new)
            keys = np.where(inside, chars, keys)
        at, keys = np.flatnonzero(new), keys[solid]
        ends = np.append(np.cumsum(solid, dtype=np.int32)[at] - 1, len(keys)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(keys)]).dictionary_encode()
        if len(self.known) > self.KNOWN or self.known_bytes > self.KNOWN_BYTES:
            self.known.clear()
            self.known_bytes = 0
        different = split(pieces.dictionary)
        found = list(map(self.known.get, different))
        if lacking := [k for k, ids in enumerate(found) if ids is None]:
            self._learn({different[k] for k in lacking})
            for k in lacking:
                found[k] = self.known[different[k]]
        ids = pa.array(found, pa.binary()).cast(pa.large_binary()).take(pieces.indices)
        _, offsets, data = ids.buffers()
        before = np.frombuffer(offsets, np.int64)[: len(at) + 1]
        return np.frombuffer(data or b"", np.uint8)[: before[-1]].view(self.dtype), at, before // np.dtype(self.dtype).itemsize


def word_ids(path: str) -> WordIds:
    """One per worker process."""
    return held(("words", path), lambda: WordIds(path))
