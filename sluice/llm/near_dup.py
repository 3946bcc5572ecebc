"""Near-duplicate documents by min-max hashing.

A document's set is its distinct 5-word shingles (64-bit hashes; with fewer words, the whole sequence as one). Documents
with equal sets form a class and its least doc_id stands for it. Of a class's set, each of 192 hash functions keeps both
its minimum and its maximum: 384 signature values for half the evaluations. Bands of 6 values make 64 buckets a
document, so that a pair of similarity 0.75 shares none of them with a probability of 4e-6. Then

1. each bucket of two or more proposes pairs of its members with its least and its greatest id; a one-bit sketch of the
   signature discards pairs that cannot reach the threshold (5.5 standard deviations off), and the full sets of the
   rest are compared;
2. confirmed pairs are joined to components; in buckets that still hold members of several components, every pair
   across components is compared in the same way, in blocks of bounded size, and the new pairs joined in.

Copies are thus linked through their class, a large bucket costs two proposals a member, and only members that no
proposal has linked meet all others. Hot buckets are dealt over tasks by block, and the full sets that one task holds at
once by their size (``HELD``). Facts of hot classes, buckets and components are broadcast (see store.joined_by_key).

Shingles are compared by 64-bit hashes of words hashed modulo two primes. Documents without words or text are linked
with nothing and stand alone. A null doc_id is never a component id: its row gets its class's component; deduplicated()
treats rows without id as documents of their own, by text, that any document with an id precedes. Rows that share a
doc_id are one node. Long texts are read in pieces of one text at least. Repeated rows, ties and an empty table need no
special case; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.components import components
from sluice.llm.grid import LOWER, NOT_SPACE, Grid, grids, mix, range_hashes, sliced
from sluice.functions.names import free_names
from sluice.llm.store import joined_by_key, released, written

SHINGLE, NUM, DEN = 5, 75, 100
FUNCTIONS, BAND = 192, 6
BITS_OFF = 83  # of 384 one-bit values; 48 are expected at the threshold, the standard deviation is 6.5
BLOCK = 4096
#: Shingles in the sets that a task compares at once (8 bytes each).
HELD = 4_000_000
#: Stand-in ids of rows without one, above all others.
NO_ID = 1 << 62
_rng = np.random.default_rng(20)
MUL = _rng.integers(1, 1 << 63, FUNCTIONS, dtype=np.uint64) | np.uint64(1)
ADD = _rng.integers(0, 1 << 63, FUNCTIONS, dtype=np.uint64)


def shingle_sets(grid: Grid) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each document."""
    at, hashes = grid.windows(SHINGLE)
    first = np.searchsorted(at, grid.first)
    n = np.diff(grid.first)
    for d in range(len(n)):
        if 0 < n[d] < SHINGLE:
            a, b = grid.first[d], grid.first[d + 1]
            own = grid.hashes[a:b]
            yield range_hashes(own, np.array([0]), np.array([b - a]), 0x9E3779B97F4A7C15)
        else:
            yield np.unique(hashes[first[d] : first[d + 1]])


def signature(own: np.ndarray) -> np.ndarray:
    """Minimum, then maximum, of the set under each function (32 bits each)."""
    spread = mix(own)
    least, most = None, None
    for at in range(0, len(spread), 1024):
        h = (spread[at : at + 1024, None] * MUL + ADD) >> np.uint64(32)
        a, b = h.min(0), h.max(0)
        least, most = (a, b) if least is None else (np.minimum(least, a), np.maximum(most, b))
    return np.concatenate([least, most])


def bands(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(-1, BAND)
    h = np.arange(1, len(rows) + 1, dtype=np.uint64)
    for k in range(BAND):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return h.view(np.int64)


def sketch(sig: np.ndarray) -> np.ndarray:
    return np.packbits((sig & np.uint64(1)).astype(np.uint8)).view(np.int64)


def describe(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n (set size), class (a digest of the set, null without words), bands and sketch (null where the
    set is too small to be similar to another)."""
    schema = "doc_id long, n long, class binary, bands array<long>, sketch array<long>"

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            texts = batch.column("text").to_pylist()
            n, key, band, bits = [], [], [], []
            for _, grid in grids([(texts, texts)], NOT_SPACE, LOWER):
                for own in shingle_sets(grid):
                    n.append(len(own))
                    key.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                    sig = signature(own) if len(own) >= 3 else None
                    band.append(None if sig is None else bands(sig))
                    bits.append(None if sig is None else sketch(sig))
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(band, kind), pa.array(bits, kind)], names=["doc_id", "n", "class", "bands", "sketch"])

    return slim(docs).mapInArrow(described, schema)


def slim(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id and its set (binary) for the ids of a one-column table."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            texts = batch.column("text").to_pylist()
            own = [s.tobytes() for _, grid in grids([(texts, texts)], NOT_SPACE, LOWER) for s in shingle_sets(grid)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(own, pa.binary())], names=["id", "shingles"])

    return slim(docs).join(ids.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").mapInArrow(made, "id long, shingles binary")


def hashes(sets: pa.Array) -> list[np.ndarray]:
    """Sets of a binary column, without copies."""
    return [np.frombuffer(s.as_buffer(), np.uint64) for s in sets]


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets reach the threshold."""
    if DEN * min(len(a), len(b)) < NUM * max(len(a), len(b)):
        return False
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return DEN * both >= NUM * (len(a) + len(b) - both)


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs a, b whose full sets reach the threshold."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "x"):
            keep = [similar(x, y) for x, y in zip(hashes(batch.column("x")), hashes(batch.column("y")), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    full = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    return full.select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def off(x: str, y: str) -> F.Column:
    """Sketch bits in which two rows differ."""
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda acc, v: acc + v)


def proposals(members: DataFrame, about: DataFrame) -> DataFrame:
    """Pairs of each bucket's members with its least and greatest id that the sketch does not rule out."""
    ends = written(members.groupBy("bucket").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("k")), "ends")
    met = joined_by_key(members, ends, "bucket", "k", members.count())
    pairs = met.select(F.explode(F.array(F.struct(F.col("low").alias("a"), F.col("id").alias("b")), F.struct(F.col("id").alias("a"), F.col("high").alias("b")))).alias("p")).select("p.*").where("a <> b").distinct()
    x = about.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    y = about.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    sized = F.least("na", "nb") * DEN >= F.greatest("na", "nb") * NUM
    return pairs.join(x, "a").join(y, "b").where(sized & (off("sa", "sb") <= BITS_OFF)).select("a", "b").distinct()


NOBODY = np.zeros(0, np.int64)


def lists(parts: list[np.ndarray]) -> pa.Array:
    """Arrays of numbers as a list column."""
    edges = np.cumsum([0] + [len(p) for p in parts]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate([NOBODY, *parts])))


def cells_of(found: list[tuple[int, int, np.ndarray]], size: dict[int, int], name: str) -> Iterator[tuple[str, list[int], list[np.ndarray]]]:
    """Deals (id, set size, partners) to cells whose sets have about HELD shingles at most, or are those of two ids; a
    cell has its ids and, for each of them, the partners it is compared with."""
    held: dict[int, list[np.ndarray]] = {}
    total = part = 0

    def closed() -> tuple[str, list[int], list[np.ndarray]]:
        ids = sorted(held)
        return f"{name}/{part}", ids, [np.concatenate([NOBODY, *held[i]]) for i in ids]

    for i, n, partners in found:
        sizes = np.cumsum([size[p] for p in partners.tolist()])
        at = 0
        while at < len(partners):
            room = HELD - total - (n if i not in held else 0)
            stop = int(np.searchsorted(sizes, room + (sizes[at - 1] if at else 0), side="right"))
            if stop <= at and held:
                yield closed()
                held, total, part = {}, 0, part + 1
                continue
            stop = max(stop, at + 1)
            total += n if i not in held else 0
            held.setdefault(i, []).append(partners[at:stop])
            for p in partners[at:stop].tolist():
                if p not in held:
                    held[p] = []
                    total += size[p]
            at = stop
    if held:
        yield closed()


def leftovers(members: DataFrame, about: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows (cell, id, partners) of the buckets that hold several components: partners are the members of other
    components that the sketch leaves possible. A block of the bucket's outsiders (those not in the component of its
    least id) meets a block of all its members; every pair across components has at least one outsider. What a pair of
    blocks leaves is dealt to cells of bounded size."""
    placed = members.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    low = placed.groupBy("bucket").agg(F.min_by("root", "id").alias("home"), F.count("*").alias("k"), F.min("root").alias("r0"), F.max("root").alias("r1"))
    low = written(low.where("r0 <> r1 AND k > 2").select("bucket", "home", "k", F.col("k").alias("n_rows")), "mixed")
    mixed = joined_by_key(placed, low, "bucket", "n_rows", members.count()).where("home IS NOT NULL").join(about, "id")
    outsider = F.col("root") != F.col("home")
    parts = F.ceil(F.col("k") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("id"), parts).cast("int")
    every = F.sequence(F.lit(0), parts - 1)
    as_member = mixed.select("bucket", "id", "root", "n", "sketch", F.lit(False).alias("outside"), F.explode(every).alias("i"), own.alias("j"))
    as_outsider = mixed.where(outsider).select("bucket", "id", "root", "n", "sketch", F.lit(True).alias("outside"), own.alias("i"), F.explode(every).alias("j"))

    def partners(key: tuple, rows: pa.Table) -> pa.Table:
        outside = rows.column("outside").to_numpy()
        ids, root, n = (rows.column(c).to_numpy() for c in ("id", "root", "n"))
        bits = np.array(rows.column("sketch").to_pylist(), np.int64).reshape(len(ids), -1).view(np.uint64)
        o, m = np.flatnonzero(outside), np.flatnonzero(~outside)
        found: list[tuple[int, int, np.ndarray]] = []
        for x in o.tolist():
            near = (root[m] != root[x]) & (DEN * np.minimum(n[m], n[x]) >= NUM * np.maximum(n[m], n[x]))
            near[near] = np.bitwise_count(bits[m[near]] ^ bits[x]).sum(1) <= BITS_OFF
            if near.any():
                found.append((int(ids[x]), int(n[x]), ids[m[near]]))
        name = "/".join(str(k.as_py()) for k in key)
        cells = list(cells_of(found, dict(zip(ids.tolist(), n.tolist(), strict=True)), name))
        who = [i for _, ids, _ in cells for i in ids]
        return pa.table({"cell": pa.array([c for c, ids, _ in cells for _ in ids], pa.string()), "id": pa.array(who, pa.int64()), "partners": lists([p for _, _, ps in cells for p in ps])})

    return as_member.unionByName(as_outsider).groupBy("bucket", "i", "j").applyInArrow(partners, "cell string, id long, partners array<long>")


def confirmed_cells(cells: DataFrame, sets: DataFrame) -> DataFrame:
    """Confirmed pairs a, b of leftovers' cells."""

    def check(key: tuple, rows: pa.Table) -> pa.Table:
        ids = rows.column("id").to_pylist()
        own = dict(zip(ids, hashes(rows.column("shingles")), strict=True))
        good = [(i, p) for i, ps in zip(ids, rows.column("partners"), strict=True) for p in ps.values.to_numpy().tolist() if p in own and similar(own[i], own[p])]
        return pa.table({"a": pa.array([min(g) for g in good], pa.int64()), "b": pa.array([max(g) for g in good], pa.int64())})

    return cells.join(sets, "id").groupBy("cell").applyInArrow(check, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (the least doc_id reachable over links) and kept."""
    spark = docs.sparkSession
    about = written(describe(docs), "minmax")
    classes = about.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("rep"), F.count("*").alias("k"))
    standing = about.where("bands IS NOT NULL AND doc_id IS NOT NULL").groupBy("class").agg(F.min_by(F.struct(F.col("doc_id").alias("id"), "n", "bands", "sketch"), "doc_id").alias("s")).select("s.*")
    standing = written(standing, "standing")
    banded = standing.select("id", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("k")).where("k > 1").select("bucket")
    members = written(banded.join(shared.hint("shuffle_hash"), "bucket"), "members")
    short = standing.select("id", "n", "sketch")
    sets = written(sets_of(docs, members.select("id").distinct()).dropDuplicates(["id", "shingles"]), "sets")
    first = components(confirmed(proposals(members, short), sets))
    more = written(confirmed_cells(leftovers(members, short, first), sets), "links")
    released(spark, standing, members, sets)
    roots = first
    if not more.isEmpty():  # first has the components of the earlier links
        roots = components(first.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(more))
        released(spark, first)
    placed = written(classes.join(roots, F.col("rep") == F.col("id"), "left").select("class", F.coalesce("root", "rep").alias("component_id"), "k"), "placed")
    out = joined_by_key(about.select("doc_id", F.col("n").alias("n_shingles"), "class"), placed, "class", "k", about.count())
    released(spark, more, roots)
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs without the documents that are not kept; columns as given. Of rows without id and of one text with words one
    stays, if no document with an id (or other such text) is kept for it."""
    (stand_in,) = free_names(docs.columns, "node")
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    node = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID) + F.pmod(F.xxhash64(text), F.lit(1 << 61)))
    nodes = docs.select("*", node.alias(stand_in))
    gone = near_duplicates(nodes.select(F.col(stand_in).alias("doc_id"), "text")).where("NOT kept").select(F.col("doc_id").alias(stand_in))
    gone = written(gone.distinct(), "gone")  # two parts of the result read it: its plan is made once
    kept = nodes.join(gone, stand_in, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    anonymous = F.col("doc_id").isNull() & F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return kept.where(~anonymous).unionByName(kept.where(anonymous).dropDuplicates(["text"]))
