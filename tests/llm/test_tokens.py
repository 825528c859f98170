import random
import zlib

import numpy as np
import pytest
import public_tokenizers as P
import sentencepiece
from conftest import *  # noqa: F403
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pageflow.llm import op2_packing, op5_pieces, op7_huffman, op9_counts
from pageflow.llm.words import word_ids

PIECES, WORDS = P.path("piece_bpe_32k.model"), P.path("word_bpe_49k.json")
SIGNS = list("abCÉ é̂İß ñ '\"0 1.,!\t\n\x1c　你好🙂ŉǅ×|:▁") + ["<|endoftext|>", "<s>", "'re", "the ", "Ing"]


def noise(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 40))) for _ in range(n)] + ["", " ", "\n", " \n ", "a  b", "a\n\n b "]


def library_ids(texts):
    t = Tokenizer.from_file(WORDS)
    return [np.array(e.ids, "<u4") for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_word_ids_equal_the_library():
    texts = noise(2000, 1)
    own = word_ids(WORDS)
    assert [np.frombuffer(x, own.dtype).tolist() for x in own.encode(texts)] == [x.tolist() for x in library_ids(texts)]


def test_other_tokenizers_get_whole_texts():
    path = P.path("byte_bpe_50k.json")
    own, texts = word_ids(path), noise(200, 2)
    t = Tokenizer.from_file(path)
    assert own.pattern is None
    assert [np.frombuffer(x, own.dtype).tolist() for x in own.encode(texts)] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_pieces_equal_the_library():
    texts = noise(2000, 3)
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = sp.encode(texts, num_threads=1)
    assert [np.frombuffer(x, "<u4").tolist() for x in op5_pieces.encoder(PIECES).encode(texts)] == want
    assert [op9_counts.counter(PIECES).value(t) for t in texts] == [len(x) for x in want]


def test_counts(docs, none):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = op9_counts.count_tokens(docs, PIECES).collect()
    want = [(i, len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 4096) for i, t in TEXTS]  # noqa: F405
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert op9_counts.count_tokens(none, PIECES).count() == 0


def test_encoding(docs, none):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = {(r["doc_id"], bytes(r["ids"])): r["decoded"] for r in op5_pieces.encode_texts(docs, PIECES).collect()}
    want = {(i, np.array([1, *sp.encode(t or ""), 2], "<u4").tobytes()): sp.decode([1, *sp.encode(t or ""), 2]) for i, t in TEXTS}  # noqa: F405
    assert got == want
    import hashlib

    sha = lambda x: hashlib.sha256(x).hexdigest()
    digests = {tuple(r) for r in op5_pieces.encode_digests(docs, PIECES).collect()}
    assert digests == {(i, len(x) // 4, sha(x), sha(t.encode())) for (i, x), t in want.items()}
    assert {tuple(r) for r in op5_pieces.encode_digests(docs, PIECES, checked=0.0).collect()} == digests
    assert op5_pieces.encode_digests(none, PIECES).count() == 0


def test_a_wrong_encoding_raises():
    """Every text is checked whole, however long; with a lower share, new sequences still are."""
    text = "the quick brown fox " * 5000
    for checked in (1.0, 0.0):
        own = op5_pieces.Encoder(PIECES, checked)
        own.model.id["▁the"] = own.model.unk_id
        with pytest.raises(AssertionError):
            own.encode([text])


def test_packing(docs, none):
    pieces = op2_packing.pack_documents(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), WORDS).toPandas()
    texts = {i: t for i, t in TEXTS if i is not None}  # noqa: F405
    want = {i: np.append(x, 2).astype("<u4").tobytes() for i, x in zip(texts, library_ids(texts.values()))}
    for i, g in pieces.sort_values("start").groupby("doc_id"):
        assert b"".join(map(bytes, g["ids"])) == want[i]
        assert g["start"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]]
        assert (g["doc_tokens"] == len(want[i]) // 4).all()
    assert set(pieces["doc_id"]) == set(want)
    for _, g in pieces.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]]
        n = int(g["length"].sum())
        assert n <= 4096 and n & (n - 1) == 0
    assert op2_packing.pack_documents(none, WORDS).count() == 0
    # repeated rows and rows without an id are documents of their own
    rows = op2_packing.pack_documents(docs, WORDS).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("of")).collect()
    assert {r["doc_id"]: r["n"] // r["of"] for r in rows} == {i: [j for j, _ in TEXTS].count(i) for i, _ in TEXTS}  # noqa: F405


def test_sum_of_squares_choice():
    """Every placement is the one that makes the sum of the squared level counts smallest, by brute force over windows."""
    p = op2_packing.SumOfSquares(100, levels=10)
    rng = np.random.default_rng(0)
    for size in rng.integers(1, 40, 400).tolist():
        before = [fill for level in p.open for fill, _ in level]
        squares = lambda fills: sum(n * n for n in np.bincount([f // 10 for f in fills if f < 100], minlength=10).tolist())
        cost = {-1: squares([*before, size])}
        for k, level in enumerate(p.open):
            if level and level[-1][0] + size <= 100:
                others = before.copy()
                others.remove(level[-1][0])
                cost[k] = squares([*others, level[-1][0] + size])
        assert cost[p.choose(size)] == min(cost.values())
        list(p._place((0, 0, np.zeros(size, "<u2"), size)))


def test_packing_keeps_its_placements():
    """What moves at the end is bounded by the windows that are open then; the rest stays where sum of squares put it."""
    rng = np.random.default_rng(1)
    p, out, seen = op2_packing.SumOfSquares(4096), [], {}
    lengths = np.minimum(rng.lognormal(6, 1.2, 4000).astype(int) + 1, 60_000)
    for i, n in enumerate(lengths.tolist()):
        out += p.add(i, np.arange(n, dtype="<u4"))
    before, still_open = len(out), [(fill, pieces) for level in p.open for fill, pieces in level]
    assert len(still_open) < 2 * op2_packing.LEVELS
    stay = sorted(still_open, key=lambda x: -x[0])[: sum(f for f, _ in still_open) // 4096]
    out += p.close()
    assert p.placed == lengths.sum() and p.moved < 0.03 * p.placed
    size = {}
    for (i, start, ids, n), sequence, at in out:
        assert n == lengths[i] and ids.tolist() == list(range(start, start + len(ids)))
        assert at == size.get(sequence, 0)
        size[sequence] = at + len(ids)
        seen[i] = seen.get(i, 0) + len(ids)
    assert seen == dict(enumerate(lengths.tolist()))
    assert all(n <= 4096 and n & (n - 1) == 0 for n in size.values()) and sum(n < 4096 for n in size.values()) <= 12
    where = {(piece[0], piece[1]): sequence for piece, sequence, _ in out[before:]}
    for _, pieces in stay:
        assert len({where[x[0], x[1]] for x in pieces}) == 1


def test_code_lengths():
    rng = np.random.default_rng(1)
    for n, limit in ((1, 5), (2, 5), (30, 5), (32, 5), (300, 12)):
        counts = rng.integers(1, 10_000, n) ** 2
        bits = op7_huffman.code_lengths(counts, limit)
        assert bits.max() <= limit and sum(2.0 ** -int(b) for b in bits) <= 1
    # without an effective limit: as good as Huffman's own
    import heapq

    heap = sorted(counts.tolist())
    total = 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        total += a + b
        heapq.heappush(heap, a + b)
    assert int((op7_huffman.code_lengths(counts, 40) * counts).sum()) == total


def test_huffman_files(docs, none, sample):
    for table in (docs, sample):
        rows = sorted(((r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
        ids = [np.append(x, 2).astype("<u4") for x in library_ids([t for _, t in rows])]
        got = sorted(map(tuple, op7_huffman.read_ids(op7_huffman.write_ids(table, WORDS, file_ids=20_000)).collect()), key=lambda r: r[1])
        assert [r[0] for r in got] == [i for i, _ in rows]
        assert [r[1] for r in got] == [0, *np.cumsum([len(x) for x in ids]).tolist()[:-1]]
        assert [r[2:] for r in got] == [(len(x), zlib.crc32(x.tobytes())) for x in ids]
    assert op7_huffman.read_ids(op7_huffman.write_ids(none, WORDS)).count() == 0


def test_word_ids_learn_without_the_collector(none):
    import gc

    import public_tokenizers
    from tokenizers import Tokenizer

    from pageflow.llm.words import WordIds

    path = public_tokenizers.path("word_bpe_49k.json")
    own, library = WordIds(path), Tokenizer.from_file(path)
    texts = ["Plain words, signs; and&&& $$$ mixed9 x.", "Ä$$$ größe, İstanbul ﬁn été <s> a<|endoftext|>b |", None, "", " \n\t ", "word " * 3 + "ΑΣ Σ. 你好, 😀;"]
    ran, before = [], gc.callbacks[:]
    gc.callbacks.append(lambda phase, info: ran.append(phase))
    old = gc.get_threshold()
    gc.set_threshold(1)
    try:
        ran.clear()
        own._learn({f"w{i}x".encode() for i in range(10)})
        assert ran  # alone it is collected
        learn, seen = own._learn, []
        own._learn = lambda words: (ran.clear(), learn(words), seen.append(list(ran)))
        got = own.encode(texts)
    finally:
        gc.set_threshold(*old)
        gc.callbacks[:] = before
    assert seen == [[]] and gc.isenabled()
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, own.dtype).tolist() for x in got] == want


def test_words_are_cut_by_class_of_bytes(monkeypatch):
    """Plain words are known by their pieces, whatever signs, digits and capitals they come with; ids stay the library's."""
    import pyarrow as pa

    from pageflow.llm import words

    letters = ["plain", "größe", "été", "ärger", "þorn"]
    texts = [f"{w}{a}{b}" for w in letters for w in (w, w.title(), w.upper()) for a in ("", ".", "***", "9") for b in ("", "&&", "77", "-" + w)]
    own, seen = words.WordIds(WORDS), []
    learn = own._learn
    own._learn = lambda new: (seen.extend(new), learn(new))
    want = [x.tolist() for x in library_ids([" ".join(texts)])]
    assert [np.frombuffer(x, own.dtype).tolist() for x in own.encode([" ".join(texts)])] == want
    assert len(seen) == len(set(seen)) < 20  # words, digits and runs of signs
    # contractions, special strings, signs among marked letters, other scripts, controls; stretches end within texts, slices begin within
    rng = random.Random(4)
    signs = list("abZ ÀÞß×÷ÿñĀİŉǅ'\"<|.9\t\n\r\x0b\x0c\x1c\x7f\x85　你Σς🙂") + ["é", "'S", "'ll", "<|endoftext|>", "<|EndOfText|>", "  "]
    texts = [None if rng.random() < 0.05 else "".join(rng.choices(signs, k=rng.randint(0, 60))) for _ in range(1500)]
    want = [[*x.tolist(), 2] for x in library_ids(texts)]
    for stretch in (1, 100, 4_000_000):
        monkeypatch.setattr(words, "STRETCH", stretch)
        column = pa.array(["first", *texts, "last"]).slice(1, len(texts))
        ids, starts = words.WordIds(WORDS).coded(column, 2)
        assert [ids[x:y].tolist() for x, y in zip(starts, starts[1:])] == want
    ids, starts = own.coded(column.slice(0, 0), 2)
    assert len(ids) == 0 and starts.tolist() == [0]
    # what is remembered is bounded, and forgetting changes nothing
    own.KNOWN = 10
    monkeypatch.setattr(words, "STRETCH", 100)
    ids, starts = own.coded(column, 2)
    assert [ids[x:y].tolist() for x, y in zip(starts, starts[1:])] == want and len(own.known) < 150


def test_packing_keeps_texts_in_their_column():
    """No text becomes an object of Python's; what stays open holds its own documents' ids only."""
    import pyarrow as pa

    from pageflow.llm.words import WordIds

    own, texts = WordIds(WORDS), [None, "", *noise(300, 5), "word " * 9000]
    own.encode = None
    packer = op2_packing.SumOfSquares(4096)
    batch = pa.record_batch({"doc_id": pa.array(range(len(texts))), "text": pa.array(texts)})
    made = op2_packing.pack_batches(iter([batch.slice(0, 100), batch.slice(100)]), own, 2, packer)
    first = next(made)
    assert all(len(x if x.base is None else x.base) == n for level in packer.open for _, pieces in level for _, _, x, n in pieces)
    rows = sorted((r["doc_id"], r["start"], r["ids"]) for b in [first, *made] for r in b.to_pylist())
    got = {}
    for i, _, ids in rows:
        got[i] = got.get(i, b"") + ids
    assert [got[i] for i in range(len(texts))] == [np.append(x, 2).astype("<u4").tobytes() for x in library_ids(texts)]


def test_long_words_are_forgotten_by_their_bytes():
    from pageflow.llm.words import WordIds

    own = WordIds(WORDS)
    own.KNOWN_BYTES = 50_000
    texts = [f"{i}{'你好世界' * 50} don't{i}" for i in range(400)]
    for k in range(0, len(texts), 20):
        assert [np.frombuffer(x, own.dtype).tolist() for x in own.encode(texts[k : k + 20])] == [x.tolist() for x in library_ids(texts[k : k + 20])]
    assert sum(map(len, own.known)) < 80_000
