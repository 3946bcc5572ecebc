"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over training token windows.

Words are runs of ASCII letters, digits and non-ASCII characters, after lower-casing A-Z. A benchmark item gives every
window of ``n`` consecutive words; an item of fewer words is one window of its own length; an item without words (or a
null text) gives none. Every document is scanned in its map task, with no shuffle: window hashes go through a bit
table, then a sorted array, and each remaining hit is verified word by word, so a hash collision cannot report a hit.

What is broadcast is bounded: items are dealt by hash into blocks of at most about ``block_bytes`` of text; an item of
more than that is a block of its own. The documents pass one block after the other; between two blocks they are written
to the shared folder and the block's broadcast is dropped, so tasks and driver hold one block (the driver also the next
one's texts), whatever the number of blocks. A benchmark of any size is thus scanned whole.

Items with a null item_id are scanned like the others: their hits count in n_hit and make a document contaminated. They
are one null entry, last in a document's items, which n_items counts once and the digest of the ids leaves out.

Null or empty document texts have no words and no hits; repeated rows and repeated ids are scanned row by row; an empty
benchmark reports no hits; texts of any length are scanned whole; further columns are kept or ignored, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.grid import ALNUM, LOWER, Grid, grids, sliced
from sluice.functions.names import free_names
from sluice.llm.store import released, written

BITS = 22
SPANS = "array<struct<start:int,end:int>>"
RESULTS = ["n_words", "spans", "items"]


class WindowSet:
    """The windows of some benchmark items, by length: bit table, sorted hashes, and item ids by verified word text."""

    def __init__(self, items: list[tuple[int | None, bytes]], n: int) -> None:
        self.owners: dict[bytes, set[int | None]] = {}
        by_length: dict[int, set[int]] = {}
        for keys, grid in grids([([i for i, _ in items], [t for _, t in items])], ALNUM, LOWER):
            for d, key in enumerate(keys):
                a, b = int(grid.first[d]), int(grid.first[d + 1])
                size = min(n, b - a)
                for s in range(a, b - size + 1) if size else ():
                    self.owners.setdefault(grid.words(s, s + size), set()).add(key)
        for size in {text.count(b" ") + 1 for text in self.owners}:
            texts = [t for t in self.owners if t.count(b" ") + 1 == size]
            for _, grid in grids([(texts, texts)], ALNUM, LOWER):
                by_length.setdefault(size, set()).update(grid.windows(size)[1].tolist())
        self.tables = []
        for size, hashes in sorted(by_length.items()):
            ordered = np.array(sorted(hashes), np.uint64)
            bits = np.zeros(1 << BITS, bool)
            bits[(ordered >> np.uint64(64 - BITS)).astype(np.int64)] = True
            self.tables.append((size, ordered, bits))

    def hits(self, grid: Grid) -> Iterator[tuple[int, int, set[int | None]]]:
        """(first word, length, items) of every verified occurrence in the grid."""
        for size, ordered, bits in self.tables:
            at, hashes = grid.windows(size)
            maybe = np.flatnonzero(bits[(hashes >> np.uint64(64 - BITS)).astype(np.int64)])
            place = np.minimum(np.searchsorted(ordered, hashes[maybe]), len(ordered) - 1)
            for s in at[maybe[ordered[place] == hashes[maybe]]].tolist():
                owners = self.owners.get(grid.words(s, s + size))
                if owners:
                    yield s, size, owners


def item_blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int | None, bytes]]]:
    """The items with text, a block of about block_bytes at a time; a larger item is a block of its own."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).where("length(text) > 0")
    size, dealt = F.length("text"), F.xxhash64("item_id", "text")
    own = [r.h for r in items.where(size >= block_bytes).select(dealt.alias("h")).distinct().orderBy("h").collect()]
    rest = items.where(size < block_bytes)
    total = rest.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    blocks = max(-(-int(total) // block_bytes), 0 if own else 1)
    parts = [rest.where(F.pmod(dealt, F.lit(blocks)) == k) for k in range(blocks)]
    parts += [items.where((size >= block_bytes) & (dealt == h)).distinct() for h in own]
    for part in parts:
        rows = part.toArrow()
        yield list(zip(rows.column("item_id").to_pylist(), rows.column("text").to_pylist(), strict=True))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def scanned(docs: DataFrame, benchmark: DataFrame, n: int, block_bytes: int) -> tuple[DataFrame, list[str]]:
    """All columns of docs (text as binary) and, per row, the number of words, the spans (word positions, end exclusive,
    merged) and the sorted ids of the items whose windows occur (a null for those without id), and the names of these
    three columns, which no column of docs has. No shuffle, whatever the benchmark's size."""
    spark = docs.sparkSession
    names = free_names(docs.columns, *RESULTS)
    own = [F.col("text").cast("binary").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    empty = (F.lit(0), F.array().cast(SPANS), F.array().cast("array<bigint>"))
    out = docs.select(*own, *[value.alias(name) for value, name in zip(empty, names, strict=True)])
    schema = out.schema
    blocks = item_blocks(benchmark, block_bytes)
    items, earlier = next(blocks), None
    while items is not None:
        held = spark.sparkContext.broadcast(WindowSet(items, n))

        def scan(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches, "text"):
                texts = batch.column("text").to_pylist()
                spans, found = batch.column(names[1]).to_pylist(), batch.column(names[2]).to_pylist()
                counts: list[int] = []
                for _, grid in grids([(texts, texts)], ALNUM, LOWER):
                    base = len(counts)
                    counts += np.diff(grid.first).tolist()
                    new: dict[int, tuple[list, set]] = {}
                    for s, size, owners in held.value.hits(grid):
                        d = int(grid.doc[s])
                        where, who = new.setdefault(d, ([], set()))
                        where.append((s - int(grid.first[d]), s - int(grid.first[d]) + size))
                        who |= owners
                    for d, (where, who) in new.items():
                        old = [(x["start"], x["end"]) for x in spans[base + d]]
                        spans[base + d] = [{"start": a, "end": b} for a, b in merged(old + where)]
                        found[base + d] = sorted(who.union(found[base + d]), key=lambda i: (i is None, i or 0))
                kept = [batch.column(k) for k in range(batch.num_columns - 3)]
                fresh = [pa.array(counts, pa.int32()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(found, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(kept + fresh, names=batch.schema.names)

        out = out.mapInArrow(scan, schema)
        items = next(blocks, None)
        if items is not None:
            out = written(out, "scanned")
            held.destroy()
            if earlier is not None:
                released(spark, earlier)
            earlier = out
    return out, names


def find_contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, block_bytes: int = 8 << 20) -> DataFrame:
    """Per row of docs: doc_id, n_words, spans and items, as in scanned()."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found, names = scanned(slim, benchmark, n, block_bytes)
    return found.select("doc_id", *names)


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, mode: str = "documents", block_bytes: int = 8 << 20) -> DataFrame:
    """docs without the documents that hold a benchmark window (mode "documents"), or with the hit words cut out of
    their texts (mode "spans": whatever stands between the hit words of a span goes with them). Columns as given."""
    if mode not in ("documents", "spans"):
        raise ValueError(f"mode {mode!r}")
    found, (_, spans_in, items_in) = scanned(docs, benchmark, n, block_bytes)
    own = [F.col("text").cast("string").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    if mode == "documents":
        return found.where(F.size(items_in) == 0).select(*own)
    place = docs.columns.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            texts = batch.column("text").to_pylist()
            for i, spans in enumerate(batch.column(spans_in).to_pylist()):
                if spans:
                    grid = Grid([texts[i]], ALNUM, LOWER)
                    keep, at = [], 0
                    for s in spans:
                        keep.append(texts[i][at : grid.starts[s["start"]]])
                        at = int(grid.ends[s["end"] - 1])
                    texts[i] = b"".join(keep) + texts[i][at:]
            columns = [batch.column(k) for k in range(batch.num_columns)]
            columns[place] = pa.array(texts, pa.binary())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return found.mapInArrow(cut, found.schema).select(*own)


def report(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """The digest of find_contamination: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_contamination(docs, benchmark, n)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + (s["end"] - s["start"]).cast("long"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))

