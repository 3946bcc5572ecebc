"""Substring dedup: windows of ``SPAN`` words that also start in a document with a smaller doc_id are removed.

Documents of one word sequence form a class. Of a class of SPAN words or more, all documents but the ones of least
doc_id lose every word, and only one text stands for the rest. Every window of a standing text is anchored at the least
hash among its 5-word shingles (the rightmost of equal ones), so equal windows have equal anchors. Anchors found in one
text only cannot belong to a repeated window and are dropped by a grouped count. The windows that remain are cut out as
segments (consecutive windows of one anchor); equal segments are merged with their least doc_id before they are dealt,
by anchor, to shards. Each shard numbers its words (by the words themselves), builds an FM-index of its segments (ranks
in a wavelet matrix of packed bits), streams the segments through backward search, and reports from the matching
statistics every interval whose matching length reaches SPAN, with the least document of its row range. Those intervals
return to the documents by a join on segments.

All occurrences of a window meet in one shard and are compared there word by word, so the result is exact: hashes only
bring candidates together, and a segment is known by its shard key and 128 bits of its SHA-256. A shard holds about
``SHARD`` words, however many there are. An anchor of more than ``HOT`` segments has its windows dealt one by one by
their own hash, so that no anchor outgrows a shard. Windows are judged on the input, not on what is left. The standing
texts are written once, bucketed by doc_id, so that the later joins on doc_id move no text.

Null texts have no words; a null doc_id neither removes nor loses words; rows of one doc_id don't remove each other's
words; texts of any length are read whole, one at a time where they are long; an empty table gives an empty result;
further columns are kept, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.fm_index import FmIndex, intervals, matching
from sluice.llm.grid import NOT_SPACE, Grid, grids, sliced
from sluice.functions.names import free_names
from sluice.llm.store import bucketed, joined_by_key, released, written

SPAN, SHINGLE, SHARD, HOT = 13, 5, 1_500_000, 20_000
FOUND = "array<struct<start:int,end:int,least:bigint>>"
TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def anchors(grid: Grid) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word of each window, its anchor's hash (as signed 64 bits) and the anchor's place."""
    at, hashes = grid.windows(SHINGLE)
    n, reach = len(grid.starts), SPAN - SHINGLE
    padded = np.full(n + reach, TOP, np.uint64)
    padded[at] = hashes
    least, place = padded[:n].copy(), np.arange(n)
    for k in range(1, reach + 1):
        h = padded[k : n + k]
        better = h <= least
        np.copyto(least, h, where=better)
        place[better] = np.flatnonzero(better) + k
    first = np.flatnonzero(grid.left >= SPAN)
    return first, least[first].view(np.int64), place[first]


def slim(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("version"))


def facts(docs: DataFrame) -> DataFrame:
    """Per row of slim(): doc_id, version, n_words and digest (of its words, joined by a space)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            sizes, digests = [], []
            for text in batch.column("text"):
                words = text.as_py().split()  # of one text at a time
                sizes.append(len(words))
                digests.append(hashlib.sha256(b" ".join(words)).digest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("version"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary())], names=["doc_id", "version", "n_words", "digest"])

    return docs.select("doc_id", "version", "text").mapInArrow(counted, "doc_id long, version long, n_words long, digest binary")


def anchor_rows(docs: DataFrame) -> DataFrame:
    """Distinct (anchor, doc_id), and how many segments the anchor has there."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            for keys, grid in grids([(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())], NOT_SPACE):
                first, anchor, place = anchors(grid)
                if not len(first):
                    continue
                new = np.concatenate([[True], place[1:] != place[:-1]])
                doc, anchor = grid.doc[first][new], anchor[new]
                order = np.lexsort((anchor, doc))
                doc, anchor = doc[order], anchor[order]
                new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1])]))
                pieces = np.diff(np.append(new, len(doc))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(anchor[new]), pa.array(np.array(keys, np.int64)[doc[new]]), pa.array(pieces)], names=["anchor", "doc_id", "pieces"])

    return docs.select("doc_id", "text").mapInArrow(rows, "anchor long, doc_id long, pieces int")


def segments(docs: DataFrame, shared: DataFrame) -> DataFrame:
    """(cell, segment, doc_id, version, at): the words of consecutive windows of one shared anchor, where they start."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            ids, versions, texts = (batch.column(c).to_pylist() for c in ("doc_id", "version", "text"))
            lists, hots = batch.column("anchors"), batch.column("hot")
            for rows, grid in grids([(list(range(len(texts))), texts)], NOT_SPACE):
                first, anchor, place = anchors(grid)
                doc = grid.doc[first]
                edge = np.searchsorted(doc, np.arange(len(rows) + 1))
                cells, cut_from, cut_to = [], [], []
                for d, r in enumerate(rows):
                    a, b = edge[d], edge[d + 1]
                    known = np.isin(anchor[a:b], lists[r].values.to_numpy())
                    hot = np.isin(anchor[a:b], hots[r].values.to_numpy()) if len(hots[r]) else np.zeros(b - a, bool)
                    at = a + np.flatnonzero(known)
                    if not len(at):
                        continue
                    alone = hot[at - a]
                    new = np.concatenate([[True], (np.diff(at) > 1) | (place[at[1:]] != place[at[:-1]])]) | alone
                    begin = at[new]
                    last = at[np.append(np.flatnonzero(new)[1:], len(at)) - 1]
                    cells.append(np.where(alone[new], -1, anchor[begin]))
                    cut_from.append(first[begin])
                    cut_to.append(first[last] + SPAN)
                if not cells:
                    continue
                cell, begin, end = np.concatenate(cells), np.concatenate(cut_from), np.concatenate(cut_to)
                single = np.flatnonzero(cell == -1)
                if len(single):
                    window = np.zeros(len(grid.starts) + 1, np.int64)
                    at, hashes = grid.windows(SPAN)
                    window[at] = hashes.view(np.int64)
                    cell[single] = window[begin[single]]
                owner = grid.doc[begin]
                raw = grid.buf.tobytes()
                text = [b" ".join(raw[x:y].split()) for x, y in zip(grid.starts[begin].tolist(), grid.ends[end - 1].tolist(), strict=True)]
                row = np.array(rows)[owner]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell), pa.array(text, pa.binary()), pa.array([ids[k] for k in row], pa.int64()), pa.array([versions[k] for k in row], pa.int64()), pa.array((begin - grid.first[owner]).astype(np.int32))],
                    names=["cell", "segment", "doc_id", "version", "at"],
                )

    with_anchors = docs.join(shared, "doc_id")
    return with_anchors.select("doc_id", "version", "text", "anchors", "hot").mapInArrow(cut, "cell long, segment binary, doc_id long, version long, at int")


def numbered(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts as numbers from 1, equal for equal words only, with a 0 after each text; words in each."""
    seen: dict[bytes, int] = {}
    parts, size = [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = text.split(b" ")
        size[i] = len(words)
        parts.append(np.array([seen.setdefault(w, len(seen) + 1) for w in words] + [0], np.int32))
    return np.concatenate(parts).astype(np.int64), size


def searched(pieces: DataFrame, shards: int) -> DataFrame:
    """(cell, key, found) of each distinct segment (cell, segment, owner, several: whether more than one document has it):
    found are its intervals (first word, end and least document) of matching length SPAN or more within the shard, which
    for a segment of several documents is all of it; key is a digest of the segment."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: list[np.ndarray] = []
        keys: list[bytes] = []
        texts: list[bytes] = []
        owners: list[np.ndarray] = []
        copied: list[np.ndarray] = []
        for batch in batches:
            cells.append(batch.column("cell").to_numpy())
            keys += batch.column("key").to_pylist()
            texts += batch.column("segment").to_pylist()
            owners.append(batch.column("owner").to_numpy())
            copied.append(batch.column("several").to_numpy(zero_copy_only=False))
        if not texts:
            return
        cell, owner = np.concatenate(cells), np.concatenate(owners)
        text, size = numbered(texts)
        begin = np.cumsum(size + 1) - (size + 1)
        index = FmIndex(text, np.repeat(owner, size + 1), SPAN)
        count = size - SPAN + 1
        which = np.repeat(np.arange(len(size)), count)
        place = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        length, least = np.zeros(len(which), np.int64), owner[which]
        copies = np.concatenate(copied)
        for at in range(0, len(which), 1 << 18):
            part = slice(at, at + (1 << 18))
            length[part], row = matching(index, text, begin[which[part]] + SPAN - 1 + place[part], SPAN)
            hit = np.flatnonzero(row >= 0)
            least[at + hit] = index.least(row[hit])
        length[copies[which]] = SPAN
        piece, start, end, who = intervals(length, least, which, place, SPAN)
        edges = np.searchsorted(piece, np.arange(len(size) + 1)).astype(np.int32)
        for at in range(0, len(texts), 20_000):
            stop = min(at + 20_000, len(texts))
            part = slice(edges[at], edges[stop])
            rows = pa.StructArray.from_arrays([pa.array(start[part].astype(np.int32)), pa.array(end[part].astype(np.int32)), pa.array(who[part])], names=["start", "end", "least"])
            found = pa.ListArray.from_arrays(pa.array(edges[at : stop + 1] - edges[at]), rows)
            yield pa.RecordBatch.from_arrays([pa.array(cell[at:stop]), pa.array(keys[at:stop], pa.binary()), found], names=["cell", "key", "found"])

    keyed = pieces.select("cell", digest_of("segment").alias("key"), "segment", "owner", "several")
    return keyed.repartition(shards, "cell").mapInArrow(search, f"cell long, key binary, found {FOUND}")


def digest_of(segment: str) -> F.Column:
    """128 bits of a binary column's SHA-256."""
    return F.unhex(F.substring(F.sha2(segment, 256), 1, 32))


def without(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """doc_id, version, n_removed and left (the words that are left, joined by a space) of the rows with hits: (doc_id,
    version, found), the intervals of words to remove."""

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            gone, left = [], []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("found"), strict=True):
                words = text.split()
                cover = np.zeros(len(words) + 1, np.int32)
                np.add.at(cover, found.values.field("start").to_numpy(), 1)
                np.add.at(cover, found.values.field("end").to_numpy(), -1)
                keep = np.cumsum(cover)[:-1] == 0
                gone.append(int(len(words) - keep.sum()))
                left.append(b" ".join([w for w, k in zip(words, keep.tolist(), strict=True) if k]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("version"), pa.array(gone, pa.int64()), pa.array(left, pa.binary())], names=["doc_id", "version", "n_removed", "left"])

    both = docs.join(hits, ["doc_id", "version"])
    return both.select("doc_id", "version", "text", "found").mapInArrow(removed, "doc_id long, version long, n_removed long, left binary")


def repeats(docs: DataFrame, result: list[F.Column]) -> tuple[DataFrame, DataFrame]:
    """Facts of every row of slim(docs) with copy (whether all its words go), and the given columns of without()'s rows,
    once for each doc_id and version."""
    spark = docs.sparkSession
    base = slim(docs)
    about = written(facts(base), "facts")
    long = about.where(f"doc_id IS NOT NULL AND n_words >= {SPAN}")
    firsts = written(long.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("k")).where("k > 1"), "firsts")
    standing = written(long.groupBy("digest").agg(F.min(F.struct("doc_id", "version")).alias("s")).select("s.*"), "standing")
    same = F.col("version").bitwiseXOR(F.col("_version")) == 0  # not a join key: doc_id alone deals the texts, as the buckets need
    texts = written(bucketed(base, "doc_id").join(standing.withColumnRenamed("version", "_version"), "doc_id").where(same).drop("_version"), "texts", bucketed_by="doc_id")
    rows = written(anchor_rows(texts), "anchors")
    seen = rows.groupBy("anchor").agg(F.count("*").alias("n"), F.sum("pieces").alias("pieces")).where("n > 1")
    found = rows.select("anchor", "doc_id").join(seen.select("anchor", (F.col("pieces") > HOT).alias("is_hot")), "anchor")
    shared = written(found.groupBy("doc_id").agg(F.collect_list("anchor").alias("anchors"), F.array_compact(F.collect_list(F.when(F.col("is_hot"), F.col("anchor")))).alias("hot")), "shared")
    released(spark, rows, standing)
    cuts = written(segments(texts, shared), "segments")
    released(spark, shared)
    pieces = cuts.groupBy("cell", "segment").agg(F.min("doc_id").alias("owner"), (F.min("doc_id") < F.max("doc_id")).alias("several"))
    size = cuts.agg(F.sum(F.length("segment"))).first()[0] or 0
    known = written(searched(pieces, max(1, -(-int(size) // (6 * SHARD)))).where("size(found) > 0"), "found")
    earlier = F.filter("found", lambda i: i["least"] < F.col("doc_id"))
    placed = F.transform(earlier, lambda i: F.struct((i["start"] + F.col("at")).alias("start"), (i["end"] + F.col("at")).alias("end")))
    reports = cuts.select("cell", digest_of("segment").alias("key"), "doc_id", "version", "at").join(known, ["cell", "key"]).select("doc_id", "version", placed.alias("found")).where("size(found) > 0")
    hits = written(reports.groupBy("doc_id", "version").agg(F.flatten(F.collect_list("found")).alias("found")), "hits")
    released(spark, cuts, known)
    gone = written(without(texts, hits).select("doc_id", "version", *result).dropDuplicates(["doc_id", "version"]), "gone")
    released(spark, texts, hits)
    copies = joined_by_key(about, firsts, "digest", "k", about.count()).withColumn("copy", F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False)))
    return copies.select("doc_id", "version", "n_words", "digest", "copy"), gone


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row of docs."""
    about, cut = repeats(docs, [F.col("n_removed"), F.sha2("left", 256).alias("kept")])
    known = about.where("doc_id IS NOT NULL").join(cut, ["doc_id", "version"], "left")
    both = known.unionByName(about.where("doc_id IS NULL"), allowMissingColumns=True)
    gone = F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0)))
    kept = F.when(F.col("copy"), F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("kept", F.lower(F.hex("digest"))))
    return both.select("doc_id", "n_words", gone.alias("n_removed"), kept.alias("kept_sha256"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs without the repeated windows: a text that loses words becomes its remaining words, joined by a space."""
    version, copy, left = free_names(docs.columns, "version", "copy", "left")
    about, cut = repeats(docs, [F.col("left")])
    one = about.select("doc_id", F.col("version").alias(version), F.col("copy").alias(copy)).distinct()
    new = cut.select("doc_id", F.col("version").alias(version), F.col("left").cast("string").alias(left))
    own = [F.when(F.col(copy), F.lit("")).otherwise(F.coalesce(left, "text")).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.withColumn(version, F.xxhash64(F.coalesce(F.col("text").cast("binary"), F.lit(b""))))
    return keyed.join(one, ["doc_id", version], "left").join(new, ["doc_id", version], "left").select(*own)
