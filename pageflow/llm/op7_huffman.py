"""Operator 7: token ids in binary files, by a canonical length-limited Huffman code of the ids' global counts.

The ids of every text are counted over the whole table; code lengths come from the package-merge method under a limit,
codes are canonical. Documents go to files by ranges of their id, ascending within and between files; rows of a repeated
or null id, which may be many, are ranged by a hash of their ids and by their place in the table. A file is

    magic | code bits | documents (int64 id, uint64 ids) | null ids (uint8) | checkpoints (uint64) | code (uint32 id, uint8 bits) | footer

A checkpoint is the bit at which a block of BLOCK ids begins. Blocks decode independently, many at a time, by a table
of all values of the next bits. The footer holds the counts of the other parts and the magic again.

Null and empty texts are one end id. Null ids come first; repeated ids keep one row each. An empty table gives an empty
result. Extra columns are not read. Memory: the documents' numbers of one file and one group of blocks. Tasks write files
under another name and move them; a name holds the attempt, so that lost executors and repeated tasks leave whole files.
There are at most FILES files and the tasks' number of them at least, so files grow with the table, not the list of them.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageflow.llm.batches import id_and_text, portions
from pageflow.llm.files import file_size, read_range, write_whole
from pageflow.llm.words import word_ids
from pageflow.session import materialise, shared_dir, ship

MAGIC = b"IDHUFF01"
#: Ids in a block; blocks decoded together; ids encoded together; documents read back together.
BLOCK, GROUP, SEGMENT, READ_AT_ONCE = 4096, 256, 1 << 20, 10_000
#: Documents, null ids are counted with them, blocks, codes, limit in bits, bits.
FOOTER = struct.Struct("<QQQIIQ8s")
#: Ids to a file, about, until there are so many files; then files grow.
FILE_IDS, FILES = 8_000_000, 20_000


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Bits of each symbol's code, the least in sum under the limit (package-merge). counts: all positive."""
    n = len(counts)
    if n == 1:
        return np.ones(1, np.int64)
    if n > 1 << limit:
        raise ValueError("too many symbols for the limit")
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.int64)
    weights, levels = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        m = len(weights) // 2 * 2
        merged = np.concatenate([leaves, weights[0:m:2] + weights[1:m:2]])
        by = np.argsort(merged, kind="stable")
        weights = merged[by]
        levels.append(by < n)
    bits, take = np.zeros(n, np.int64), 2 * n - 2
    for is_leaf in reversed(levels):
        used = int(is_leaf[:take].sum())
        bits[:used] += 1
        take = 2 * (take - used)
    out = np.empty(n, np.int64)
    out[order] = bits
    return out


class Code:
    """Canonical code of ids (ascending) with their bits."""

    def __init__(self, ids: np.ndarray, bits: np.ndarray):
        self.ids, self.bits = ids.astype(np.int64), bits.astype(np.int64)
        self.limit = int(self.bits.max()) if len(bits) else 1
        order = np.lexsort((self.ids, self.bits))
        width = 1 << (self.limit - self.bits[order])  # share of the table
        first = np.cumsum(width) - width
        codes = np.empty(len(ids), np.int64)
        codes[order] = first >> (self.limit - self.bits[order])
        self.codes = codes
        self._fill = (order, width)

    def encode_tables(self) -> tuple[np.ndarray, np.ndarray]:
        size = int(self.ids.max()) + 1 if len(self.ids) else 0
        code, bits = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        code[self.ids], bits[self.ids] = self.codes, self.bits
        return code, bits

    def decode_table(self) -> np.ndarray:
        """By the next ``limit`` bits: the id times 32 plus the code's bits."""
        order, width = self._fill
        table = np.zeros(1 << self.limit, np.int64)
        filled = np.repeat(self.ids[order] << 5 | self.bits[order], width)
        table[: len(filled)] = filled
        return table


def pack_bits(ids: np.ndarray, code: np.ndarray, bits: np.ndarray, carry: int, carry_bits: int) -> tuple[bytes, np.ndarray, int, int]:
    """Whole 32-bit words of the ids' codes after carried bits, the bit of each id, and what is carried on."""
    n = bits[ids]
    at = np.cumsum(n) - n + carry_bits
    total = int(at[-1] + n[-1]) if len(n) else carry_bits
    aligned = code[ids] << (64 - (at & 31) - n).astype(np.uint64)
    word = at >> 5
    size = (total >> 5) + 2
    # codes don't overlap, so that sums are unions; below 2^53 they are exact
    words = np.bincount(word, weights=(aligned >> np.uint64(32)).astype(np.float64), minlength=size)
    words += np.bincount(word + 1, weights=(aligned & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=size)[: len(words)]
    words[0] += carry
    words = words.astype(np.uint32)
    whole = total >> 5
    return words[:whole].astype(">u4").tobytes(), at, int(words[whole]), total & 31


def file_parts(docs: Iterator[tuple[int | None, np.ndarray]], code: Code, stats: dict) -> Iterator[bytes]:
    """The parts of one file; stats gets its counts."""
    yield MAGIC
    table, bits = code.encode_tables()
    doc_ids, lengths, nulls, marks = [], [], [], []
    carry = carry_bits = written_bits = n_ids = 0
    held, held_n = [], 0

    def flush(last: bool) -> bytes:
        nonlocal carry, carry_bits, written_bits, held, held_n, n_ids
        ids = np.concatenate(held).astype(np.int64) if held else np.zeros(0, np.int64)
        take = len(ids) if last else len(ids) // BLOCK * BLOCK
        now, held = ids[:take], [ids[take:]]
        held_n = len(held[0])
        if not take:
            return b""
        out, at, carry, carry_next = pack_bits(now, table, bits, carry, carry_bits)
        marks.append(at[::BLOCK] + written_bits)
        written_bits += len(out) * 8
        carry_bits = carry_next
        n_ids += take
        return out

    for doc_id, ids in docs:
        doc_ids.append(doc_id or 0)
        nulls.append(doc_id is None)
        lengths.append(len(ids))
        held.append(ids)
        held_n += len(ids)
        if held_n >= SEGMENT:
            yield flush(False)
    yield flush(True)
    yield struct.pack(">I", carry)
    marks_all = np.concatenate(marks) if marks else np.zeros(0, np.int64)
    yield np.array(doc_ids, "<i8").tobytes() + np.array(lengths, "<u8").tobytes() + np.array(nulls, "u1").tobytes()
    yield marks_all.astype("<u8").tobytes()
    yield code.ids.astype("<u4").tobytes() + code.bits.astype("u1").tobytes()
    yield FOOTER.pack(len(doc_ids), n_ids, len(marks_all), len(code.ids), code.limit, written_bits + 32, MAGIC)
    stats |= {"docs": len(doc_ids), "ids": n_ids}


def decode_blocks(data: bytes, marks: np.ndarray, length: int, table: np.ndarray, limit: int) -> np.ndarray:
    """Ids of the blocks that begin at the given bits of data, all of the same length, decoded side by side."""
    b = np.frombuffer(data + bytes(8), np.uint8).astype(np.int64)
    four = b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]
    at, out = marks.astype(np.int64), np.empty((length, len(marks)), np.uint32)
    shift, mask = 32 - limit, (1 << limit) - 1
    for k in range(length):
        got = table[four[at >> 3] >> (shift - (at & 7)) & mask] if shift >= 7 else table[(four[at >> 3] << (at & 7) & 0xFFFFFFFF) >> shift]
        out[k] = got >> 5
        at += got & 31
    return out.T.ravel()


class IdFile:
    """A file read back: its tables at once, its coded ids some blocks at a time."""

    def __init__(self, uri: str):
        self.uri = uri
        total = file_size(uri)
        n_docs, self.n_ids, n_blocks, n_codes, self.limit, n_bits, magic = FOOTER.unpack(read_range(uri, total - FOOTER.size, FOOTER.size))
        if magic != MAGIC or read_range(uri, 0, len(MAGIC)) != MAGIC:
            raise ValueError("not a file of coded ids")
        self.n_bits, start = n_bits, len(MAGIC) + n_bits // 8
        data, at = read_range(uri, start, total - FOOTER.size - start), 0

        def part(dtype: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, dtype, n, at)
            at += out.nbytes
            return out

        self.doc_ids, self.lengths, self.nulls = part("<i8", n_docs), part("<u8", n_docs).astype(np.int64), part("u1", n_docs)
        self.marks = part("<u8", n_blocks).astype(np.int64)
        self.code = Code(part("<u4", n_codes), part("u1", n_codes))
        self.table: np.ndarray | None = None

    def blocks(self, first: int, end: int) -> np.ndarray:
        """Ids of some blocks, by their checkpoints; the last one of a file may be shorter and is asked for alone."""
        if self.table is None:
            self.table = self.code.decode_table()
        length = min(BLOCK, self.n_ids - first * BLOCK)
        low = int(self.marks[first]) >> 3
        high = min(self.n_bits, int(self.marks[end - 1]) + length * self.code.limit + 64) >> 3
        return decode_blocks(read_range(self.uri, len(MAGIC) + low, high - low), self.marks[first:end] - 8 * low, length, self.table, self.code.limit)

    def groups(self) -> Iterator[np.ndarray]:
        """All ids, some blocks at a time."""
        whole = self.n_ids // BLOCK
        for start in range(0, whole, GROUP):
            yield self.blocks(start, min(start + GROUP, whole))
        if whole < len(self.marks):
            yield self.blocks(whole, whole + 1)

    def documents(self) -> Iterator[tuple[int | None, int, int, int]]:
        """(id, start in the file, ids, crc32 of the ids as little-endian unsigned 32-bit integers)."""
        groups, have, start = self.groups(), np.zeros(0, np.uint32), 0
        for doc_id, n, null in zip(self.doc_ids.tolist(), self.lengths.tolist(), self.nulls.tolist()):
            crc, need = 0, n
            while need:
                if not len(have):
                    have = next(groups)
                take = have[:need]
                crc = zlib.crc32(take.astype("<u4").tobytes(), crc)
                have, need = have[len(take) :], need - len(take)
            yield (None if null else doc_id), start, n, crc
            start += n


def tokenise(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """doc_id, ids (compact) and, in one more row of each task, the counts of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = word_ids(tokenizer_path)
        counts, size = np.zeros(0, np.int64), np.dtype(own.dtype).itemsize
        for batch in batches:
            for part in portions(batch):
                ids, starts = own.coded(part.column("text"), end_id)
                seen = np.bincount(ids)
                if len(seen) > len(counts):
                    counts, seen = seen, counts
                counts[: len(seen)] += seen
                cut = pa.Array.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer(starts * size), pa.py_buffer(ids)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), cut, pa.nulls(len(part), pa.list_(pa.int64()))], ["doc_id", "ids", "counts"])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([counts.tolist()], pa.list_(pa.int64()))], ["doc_id", "ids", "counts"])

    return docs.mapInArrow(run, "doc_id long, ids binary, counts array<long>")


def write_ids(docs: DataFrame, tokenizer_path: str, end_id: int = 2, file_ids: int = FILE_IDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files; one row each: path, docs, ids, start (ids in the files before it)."""
    spark = docs.sparkSession
    ship(spark)
    tokens = materialise(tokenise(id_and_text(docs, id_col, text_col), tokenizer_path, end_id), "op7-ids")
    # one row per id of the vocabulary: bounded by the tokenizer
    counts = tokens.where("counts is not null").select(F.posexplode("counts").alias("id", "n")).groupBy("id").agg(F.sum("n").alias("n")).where("n > 0").orderBy("id").toPandas()
    ids, n = counts["id"].to_numpy(np.int64), counts["n"].to_numpy(np.int64)
    limit = min(20, max(12, int(len(ids) or 1).bit_length() + 4))
    bits = code_lengths(n, limit) if len(ids) else np.zeros(0, np.int64)
    dtype = word_ids(tokenizer_path).dtype
    folder = f"{shared_dir(spark)}/op7-{uuid.uuid4().hex}"
    files = max(spark.sparkContext.defaultParallelism, min(FILES, -(-int(n.sum()) // file_ids)))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, attempt, stats = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId(), {}
        rows = ((i, np.frombuffer(x, dtype)) for b in batches for i, x in zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist()))
        path = f"{folder}/{part:08d}-{attempt}.ids"
        write_whole(path, file_parts(rows, Code(ids, bits), stats))
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([path]), pa.array([stats["docs"]], pa.int64()), pa.array([stats["ids"]], pa.int64())], ["part", "path", "docs", "ids"])

    # the place is that of a written table, the same in every attempt
    keyed = tokens.where("counts is null").select("doc_id", "ids", F.xxhash64("ids").alias("h"), F.monotonically_increasing_id().alias("place"))
    ranged = keyed.repartitionByRange(files, "doc_id", "h", "place").sortWithinPartitions("doc_id", "h", "place").select("doc_id", "ids")
    # one small row per file, FILES or the tasks' number at most
    made = sorted(ranged.mapInArrow(write, "part long, path string, docs long, ids long").collect())
    rows, start = [], 0
    for r in made:
        rows.append((r.path, r.docs, r.ids, start))
        start += r.ids
    return _spread(spark, rows, "path string, docs long, ids long, start long")


def _spread(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small list as a table of one partition per row."""
    return spark.createDataFrame(spark.sparkContext.parallelize(rows, max(1, len(rows))), schema)


def read_ids(files: DataFrame) -> DataFrame:
    """Every document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                found = IdFile(path).documents()
                while some := list(islice(found, READ_AT_ONCE)):
                    longs = [pa.array(list(x), pa.int64()) for x in zip(*some)]
                    longs[1] = pa.array([base + f[1] for f in some], pa.int64())
                    yield pa.RecordBatch.from_arrays(longs, ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
