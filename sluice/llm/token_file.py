"""Token-ID output in patched frame-of-reference blocks.

A token file is a sequence of segments, each a self-contained byte string of whole documents (about ``SEGMENT`` ids, or
one longer document): a header, blocks of ``BLOCK`` ids, the starts of all blocks, and each document's id and length.
A block stores its minimum, a width that covers all but the largest few of its differences (the ``PERCENTILE`` one),
the differences' low bits at that width, and an exception list (place, high bits) for the rest. Little-endian.

    header     b"PFR1", documents u32, ids u64, blocks u32
    block      minimum u32, width u8, exceptions u16, packed low bits, places u16 each, high bits u32 each
    starts     u64 for each block, from the first block's first byte
    documents  doc_id i64, a flag u8 for a null id, n_ids u32 each

Documents are dealt by ranges of doc_id (and, within one, of a row number, so that rows without id, or of one id, are split
over shards) and sorted, so shards (partitions) and the segments in them are in ascending
doc_id order; segments are rows of a Parquet table in the shared folder, written once. The position of a shard's first
id comes from the sums of the shards before it, a row for each shard. Nothing but those sums meets in one place.

Null and empty texts are the end id alone; a null doc_id sorts first; rows of one doc_id stay next to each other, by
text (an id that is split over shards, by its rows' places in the table first); a text of any length is encoded whole and is a segment of its own where it is long; an empty table
gives an empty file; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import gc
import itertools
import os
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.llm.grid import sliced
from sluice.llm.store import fresh_path

BLOCK, PERCENTILE, SEGMENT, PIECES, STEMS = 512, 92, 1 << 19, 700_000, 700_000
HEAD = struct.Struct("<4sIQI")
MAGIC = b"PFR1"


def pack(low: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK values as rows of BLOCK * width / 8 bytes: each 64 values fill width 64-bit words in turn."""
    values = low.reshape(-1, 64).T.astype(np.uint64)
    words = np.zeros((width, values.shape[1]), np.uint64)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        words[word] |= values[i] << np.uint64(shift)
        if shift + width > 64:
            words[word + 1] |= values[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T).astype("<u8").view(np.uint8).reshape(len(low), -1)


def unpack(rows: np.ndarray, width: int) -> np.ndarray:
    words = np.ascontiguousarray(np.ascontiguousarray(rows).view("<u8").reshape(-1, width).T)
    values = np.empty((64, words.shape[1]), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        v = words[word] >> np.uint64(shift)
        if shift + width > 64:
            v |= words[word + 1] << np.uint64(64 - shift)
        values[i] = v & mask
    return np.ascontiguousarray(values.T).reshape(len(rows), BLOCK)


def bit_length(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, np.floor(np.log2(np.maximum(x, 1).astype(np.float64))).astype(np.int64) + 1, 0)


def encode_segment(ids: np.ndarray, docs: list[tuple[int | None, int]]) -> bytes:
    """ids (uint32) of whole documents and each document's (id, number of ids)."""
    n_blocks = -(-len(ids) // BLOCK)
    grid = np.full(n_blocks * BLOCK, ids[-1] if len(ids) else 0, np.uint32)
    grid[: len(ids)] = ids
    grid = grid.reshape(n_blocks, BLOCK)
    least = grid.min(1) if n_blocks else np.zeros(0, np.uint32)
    diff = grid - least[:, None]
    width = bit_length(np.partition(diff, BLOCK * PERCENTILE // 100 - 1, axis=1)[:, BLOCK * PERCENTILE // 100 - 1]) if n_blocks else np.zeros(0, np.int64)
    high = np.where(width[:, None] < 32, diff >> np.minimum(width, 31)[:, None].astype(np.uint32), 0).astype(np.uint32)
    block, place = np.nonzero(high)
    exceptions = np.bincount(block, minlength=n_blocks)
    size = 7 + BLOCK // 8 * width + 6 * exceptions
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)

    def put(at: np.ndarray, values: np.ndarray) -> None:
        out[at[:, None] + np.arange(values.dtype.itemsize)] = values.astype(values.dtype.newbyteorder("<")).view(np.uint8).reshape(-1, values.dtype.itemsize)

    put(start, least)
    out[start + 4] = width
    put(start + 5, exceptions.astype(np.uint16))
    for w in np.unique(width[width > 0]):
        own = np.flatnonzero(width == w)
        mask = np.uint32((1 << int(w)) - 1)
        out[(start[own] + 7)[:, None] + np.arange(BLOCK // 8 * w)] = pack(diff[own] & mask, int(w))
    rank = np.arange(len(block)) - np.searchsorted(block, block)
    tail = start[block] + 7 + BLOCK // 8 * width[block]
    put(tail + 2 * rank, place.astype(np.uint16))
    put(tail + 2 * exceptions[block] + 4 * rank, high[block, place])
    table = b"".join(struct.pack("<qBI", d or 0, d is None, n) for d, n in docs)
    return b"".join([HEAD.pack(MAGIC, len(docs), len(ids), n_blocks), out.tobytes(), start.astype("<u8").tobytes(), table])


class Segment:
    """Reads a segment's documents, or any range of its ids by way of the block starts."""

    def __init__(self, data: bytes) -> None:
        magic, n_docs, self.n_ids, n_blocks = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        foot = len(data) - 13 * n_docs - 8 * n_blocks
        self.raw = np.frombuffer(data, np.uint8)
        self.start = np.frombuffer(data, "<u8", n_blocks, foot).astype(np.int64) + HEAD.size
        self.docs = [(None if null else d, n) for d, null, n in struct.iter_unpack("<qBI", data[len(data) - 13 * n_docs :])]

    def values(self, at: np.ndarray, kind: str) -> np.ndarray:
        n = np.dtype(kind).itemsize
        return np.ascontiguousarray(self.raw[at[:, None] + np.arange(n)]).view(kind).ravel()

    def read(self, begin: int, end: int) -> np.ndarray:
        """Ids begin to end."""
        first, last = begin // BLOCK, -(-end // BLOCK)
        start = self.start[first:last]
        width = self.raw[start + 4].astype(np.int64)
        grid = np.zeros((len(start), BLOCK), np.uint32)
        for w in np.unique(width[width > 0]):
            own = np.flatnonzero(width == w)
            grid[own] = unpack(self.raw[(start[own] + 7)[:, None] + np.arange(BLOCK // 8 * w)], int(w))
        exceptions = self.values(start + 5, "<u2").astype(np.int64)
        block = np.repeat(np.arange(len(start)), exceptions)
        rank = np.arange(len(block)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
        tail = start[block] + 7 + BLOCK // 8 * width[block]
        place = self.values(tail + 2 * rank, "<u2")
        grid[block, place] |= self.values(tail + 2 * exceptions[block] + 4 * rank, "<u4") << width[block].astype(np.uint32)
        grid += self.values(start, "<u4")[:, None]
        return grid.ravel()[begin - first * BLOCK : end - first * BLOCK]


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it is printable in Latin-1, else
    the next of the characters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


BYTE_CHARACTERS = byte_characters()


class WordEncoder:
    """The tokenizer's ids of whole texts, by way of a bounded cache of the ids of pieces between spaces and line feeds.

    The tokenizer's pattern never joins across white space, its normaliser never composes across it and its added tokens
    hold none, so the ids of a text are those of its pieces in order. New pieces are encoded many at a time with a mark between them, and the ids
    cut at the mark's. The cache has two generations: when the younger is full it becomes the older, so pieces in use
    stay."""

    MARK = "\x01"
    #: ASCII signs that are neither letters, digits nor apostrophes; letters that each lower to a single letter.
    SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
    LETTERS = "".join([c for c in map(chr, range(0x130)) if c.isalpha()])

    def __init__(self, tokenizer_json: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.model = self.tokenizer.model
        #: A piece that may hold an added token (in any case, as a normaliser lowers) goes to the library whole.
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added) or "(?!)", re.I)
        (self.mark,) = self.tokenizer.encode(self.MARK, add_special_tokens=False).ids
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.stems: dict[str, bytes] = {"": b""}
        #: A line: letters and their tail, or anything else.
        self.shape = re.compile(f"([{self.LETTERS}]+)([{re.escape(self.SIGNS)}]*)\n|(.*)\n")

    def ids_of(self, parts: list[str]) -> list[bytes]:
        """Ids of parts without MARK, from one call of the tokenizer."""
        (found,) = self.tokenizer.encode_batch_fast([f" {self.MARK} ".join(parts)], add_special_tokens=False)
        ids = np.array(found.ids, "<u4")
        cut = (np.flatnonzero(ids == self.mark) * 4).tolist()
        raw = ids.tobytes()
        return [raw[a + 4 : b] for a, b in zip([-4, *cut], [*cut, len(raw)], strict=True)]

    def words(self, stems: list[str]) -> Iterator[bytes]:
        """Ids of words of small Latin letters: normaliser and pattern leave such a word as it is, so the library's model
        can have it at once, in its characters for bytes."""
        tokens = list(map(self.model.tokenize, [s if s.isascii() else "".join([BYTE_CHARACTERS[b] for b in s.encode()]) for s in stems]))
        raw = np.array([t.id for own in tokens for t in own], "<u4").tobytes()
        ends = [4 * n for n in itertools.accumulate(map(len, tokens), initial=0)]
        return map(raw.__getitem__, map(slice, ends, ends[1:]))

    def library(self, piece: str) -> bytes:
        return np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()

    def add(self, pieces: list[str]) -> None:
        """Make pieces known. A piece of Latin letters and a tail of signs is two tokens' worth to the pattern, and the
        normaliser lowers the letters, so its ids are those of the lowered letters and those of the tail. All pieces are
        cut in one go, as lines of one text: no piece holds a line feed."""
        young, stems = self.young, self.stems
        known = list(map(self.old.pop, pieces, itertools.repeat(None)))
        young.update((p, ids) for p, ids in zip(pieces, known, strict=True) if ids is not None)
        new = [p for p, ids in zip(pieces, known, strict=True) if ids is None]
        lines = "\n".join(new)
        if self.MARK in lines or self.added.search(lines):
            alone = {p for p in new if self.MARK in p or self.added.search(p)}
            young.update((p, self.library(p)) for p in alone)
            new = [p for p in new if p not in alone]
            lines = "\n".join(new)
        if not new:
            return
        letters, tails, others = zip(*self.shape.findall(lines + "\n"), strict=True)
        lowered = "\n".join(letters).lower().split("\n")
        self.learn({s for s in lowered if s not in stems}, self.words)
        self.learn({s for s in {*tails, *others} if s not in stems}, self.ids_of)
        of = stems.__getitem__
        young.update(zip(new, map(b"".join, zip(map(of, lowered), map(of, tails), map(of, others), strict=True)), strict=True))
        if len(stems) > STEMS:
            stems.clear()
            stems[""] = b""

    def learn(self, fresh: set[str], ids: Callable) -> None:
        new = list(fresh)
        for at in range(0, len(new), 400):
            self.stems.update(zip(new[at : at + 400], ids(new[at : at + 400]), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian u32. What is made here holds no cycles, so the collector rests meanwhile."""
        collecting = gc.isenabled()
        gc.disable()
        try:
            return self.joined(texts)
        finally:
            if collecting:
                gc.enable()

    def joined(self, texts: list[str]) -> list[bytes]:
        pieces, ends = [], [0]
        for t in texts:
            pieces += t.replace("\n", " ").split(" ")
            ends.append(len(pieces))
        if len(self.young) > PIECES:
            self.young, self.old = {}, self.young
        found = list(map(self.young.get, pieces))
        if None in found:
            missing = [i for i, ids in enumerate(found) if ids is None]
            self.add(list({pieces[i] for i in missing}))
            for i in missing:
                found[i] = self.young[pieces[i]]
        return [b"".join(found[a:b]) for a, b in itertools.pairwise(ends)]


_encoders: dict[int, WordEncoder] = {}


def encoder(tokenizer_json: str) -> WordEncoder:
    key = hash(tokenizer_json)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = WordEncoder(tokenizer_json)
    return _encoders[key]


def packs(batches: Iterator[pa.RecordBatch], size: int = 1 << 20) -> Iterator[tuple[list, list[str]]]:
    for batch in sliced(batches, "text"):
        keys, texts = batch.column("doc_id").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]
        begin = held = 0
        for i, t in enumerate(texts):
            held += len(t)
            if held >= size or i + 1 == len(texts):
                yield keys[begin : i + 1], texts[begin : i + 1]
                begin, held = i + 1, 0


def write_token_file(docs: DataFrame, path: str, tokenizer_json: str, end_id: int = 2) -> None:
    """Encode every text of docs, append end_id to each, and write the segments to path in ascending doc_id order."""
    held = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    end = struct.pack("<I", end_id)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        encode: Callable = encoder(held.value).encode
        rows, parts, docs_in, ids_in, before = 0, [], [], 0, 0

        def closed() -> pa.RecordBatch:
            data = encode_segment(np.frombuffer(b"".join(parts), "<u4").astype(np.uint32), docs_in)
            columns = [pa.array([x], pa.int64()) for x in (shard, rows, before, ids_in)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([data], pa.binary())], names=["shard", "segment", "before", "n_ids", "data"])

        for keys, texts in packs(batches):
            for key, ids in zip(keys, encode(texts), strict=True):
                parts += (ids, end)
                docs_in.append((key, len(ids) // 4 + 1))
                ids_in += len(ids) // 4 + 1
                if ids_in >= SEGMENT:
                    yield closed()
                    rows, before, parts, docs_in, ids_in = rows + 1, before + ids_in, [], [], 0
        if docs_in:
            yield closed()

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = slim.withColumn("row", F.monotonically_increasing_id()).repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "text", "row")
    ordered.select("doc_id", "text").mapInArrow(segments, "shard long, segment long, before long, n_ids long, data binary").write.parquet(path)


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the file: doc_id, start (of its first id in the whole file), n_tokens and ids (binary, u32). The
    shards' offsets are broadcast: a row for each task that wrote, however long the file."""
    table = spark.read.schema("shard long, segment long, before long, n_ids long, data binary").parquet(path)
    sums = table.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    offsets = sums.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("offset"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, before, data in zip(batch.column("shard").to_pylist(), batch.column("before").to_pylist(), batch.column("data"), strict=True):
                segment = Segment(data.as_py())
                raw = segment.read(0, segment.n_ids).astype("<u4").tobytes()
                ends = np.cumsum([n for _, n in segment.docs])
                starts = ends - [n for _, n in segment.docs]
                ids = [raw[4 * a : 4 * b] for a, b in zip(starts, ends, strict=True)]
                columns = [pa.array([shard] * len(ids), pa.int64()), pa.array([d for d, _ in segment.docs], pa.int64()), pa.array(starts + before, pa.int64()), pa.array([n for _, n in segment.docs], pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "doc_id", "at", "n_tokens", "ids"])

    found = table.select("shard", "before", "data").mapInArrow(documents, "shard long, doc_id long, at long, n_tokens long, ids binary")
    return found.join(F.broadcast(offsets), "shard").select("doc_id", (F.col("at") + F.col("offset")).alias("start"), "n_tokens", "ids")


def report(docs: DataFrame, tokenizer_json: str, end_id: int = 2) -> DataFrame:
    """Write docs as a token file in the shared folder, read it back, and digest each document's ids."""
    spark = docs.sparkSession
    path = fresh_path(spark, "tokens")
    write_token_file(docs, path, tokenizer_json, end_id)
    return read_token_file(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


