"""Byte-level BPE encoding and decoding in Spark expressions.

Texts are cut into words by the tokenizer's pattern (Java's regular expressions with Unicode classes). A higher-order
fold merges a word's byte array: it starts from the bytes' ids, keeps the rank of every adjacent pair, and merges the
leftmost pair of least rank until no pair has one. A vocabulary has up to 2**19 - 1 ids, a word up to 2**25 bytes. Ranks
come from a literal map, dealt into small buckets so that a look-up doesn't scan 50,000 entries; it reaches the tasks as
the value of a scalar subquery.

All words of the corpus are counted and the commonest distinct words are folded once, on the executors; their ids join
the literal in two forms: ``FREQUENT`` words in maps, which give a word's ids without a copy, and the next up to
``LISTED`` words as text, half the size. Both are fixed numbers, so what the driver holds is bounded. Of the rest each
occurrence is folded where it stands: a join would move every text and its rare words through a shuffle of more than
the folding costs. Decoding looks up each id's bytes and concatenates them; it reads the ids alone.

The fold takes time in proportion to the square of a word's length. Words of more than ``LONG`` bytes are first cut at
every place that no token of the vocabulary can span (its two bytes are no token and the three bytes around it stand in
no token), which no merge can ever cross; so unspaced text takes linear time, and only a long run in which tokens may
overlap everywhere (one letter, repeated) remains quadratic.

Null and empty texts have no ids. The result of a row depends on its text alone; repeated rows are encoded row by row;
an empty table gives an empty result; further columns are ignored, whatever their names but ids and decoded, which are
replaced.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.store import released, written

FREQUENT, LISTED, PAIR_BUCKETS, WORD_BUCKETS, INNER_BITS, LONG = 1 << 17, 1 << 19, 1 << 16, 1 << 16, 20, 48
TABLES = ["bytes", "merges", "inner"]
#: Signs that open a word and its ids in a bucket's list; words that hold one of them are not listed.
WORD_SIGN, IDS_SIGN = "\x01", "\x02"
NONE = (1 << 31) - 1
MUL = 40503
#: Widths of a token's id and place in the fold's state, masks of both, and the least state of a token without a pair.
ID_BITS, PLACE_BITS = 19, 25
IDS = (1 << ID_BITS) - 1
PLACES = ((1 << PLACE_BITS) - 1) << ID_BITS
UNRANKED = IDS << (ID_BITS + PLACE_BITS)


def bucketed_map(bucket: np.ndarray, keys: pa.Array, items: pa.Array, buckets: int) -> pa.Array:
    """One row: an array of maps, one for each bucket."""
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1)).astype(np.int32)
    maps = pa.MapArray.from_arrays(pa.array(edges), keys.take(pa.array(order)), items.take(pa.array(order)))
    return pa.ListArray.from_arrays(pa.array([0, buckets], pa.int32()), maps)


class Vocabulary:
    """Ranks of byte strings from the lines of a rank file, as one-row tables: bytes (ids of the 256 bytes), merges (for
    each pair of ids, by bucket, the id they merge to), inner (a bit for the hash of every two-byte token and of every
    three bytes within a token) and pieces (hex digits of each id's bytes)."""

    def __init__(self, lines: list[bytes]) -> None:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        get = ranks.get
        merges = array("q")
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = get(token[:k]), get(token[k:])
                if a is not None and b is not None:
                    merges.extend((a, b, rank))
        left, right, merged = np.frombuffer(merges, np.int64).reshape(-1, 3).T
        within = {t for t in ranks if len(t) == 2} | {t[i : i + 3] for t in ranks for i in range(len(t) - 2)}
        inner = np.zeros(1 << INNER_BITS, np.uint8)
        inner[[int.from_bytes(b"\1" + t) * MUL % (1 << INNER_BITS) for t in within]] = 1
        pieces: list[str | None] = [None] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            pieces[rank] = token.hex()
        self.tables = {
            "bytes": pa.array([[ranks[bytes([v])] for v in range(256)]], pa.list_(pa.int32())),
            "merges": bucketed_map((left * MUL + right) % PAIR_BUCKETS, pa.array(left << 20 | right), pa.array(merged.astype(np.int32)), PAIR_BUCKETS),
            "inner": pa.array([np.packbits(inner, bitorder="little").view(np.int64)], pa.list_(pa.int64())),
        }
        self.pieces = {"pieces": pa.array([pieces], pa.list_(pa.string()))}

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls(f.read().splitlines())


def literal(spark: SparkSession, columns: dict[str, pa.Array]) -> Column:
    """One row of tables as a struct-valued scalar subquery. A select of its own must name it before a higher-order
    function reads it; the optimiser joins the two selects, so that rows never carry it."""
    value = spark.createDataFrame(pa.table(columns)).select(F.struct(*columns).alias("t")).scalar()
    pa.default_memory_pool().release_unused()  # the driver keeps no copy of the words it has handed over
    return value


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def fields_bound(t: Column, names: list[str], body: Callable[..., Column]) -> Column:
    """body of the named fields of a struct, each taken out once."""
    if not names:
        return body()
    return bound(t[names[0]], lambda first: fields_bound(t, names[1:], lambda *rest: body(first, *rest)))


def words(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?U){pattern}"), F.lit(0))


def folded(word: Column, single: Column, merges: Column, inner: Column) -> Column:
    """Ids of one word by ranked merges (with a vocabulary's tables). The fold's state has one number for each token: the rank of its pair with the
    next one, the place of its first byte, its id; so the least number is the leftmost pair of least rank."""

    def part(x: Column, mask: int) -> Column:
        return x.bitwiseAND(F.lit(mask))

    def ranked(token: Column, after: Column) -> Column:
        """token (place and id) with the rank of its pair with the id after it; none if there is no such id."""
        a = part(token, IDS)
        merged = F.get(merges, (a * MUL + after).bitwiseAND(F.lit(PAIR_BUCKETS - 1)).cast("int"))[F.shiftleft(a, 20) + after]
        return F.shiftleft(F.coalesce(merged.cast("long"), F.lit(IDS)), ID_BITS + PLACE_BITS).bitwiseOR(token)

    def merge(s: Column, m: Column, p: Column) -> Column:
        """m takes in the token after it, p: index of the token before m."""
        merged = F.shiftright(m, ID_BITS + PLACE_BITS)
        grown = ranked(part(m, PLACES).bitwiseOR(merged), part(F.get(s, p + 3), IDS))
        return F.transform(F.array_remove(s, F.get(s, p + 2)), lambda x, i: F.when(i == p + 1, grown).when(i == p, ranked(part(x, PLACES | IDS), merged)).otherwise(x))

    def step(s: Column, _: Column) -> Column:
        return bound(F.array_min(s), lambda m: F.when(m >= UNRANKED, s).otherwise(bound((F.array_position(s, m) - 2).cast("int"), lambda p: merge(s, m, p))))

    def merged_all(tokens: Column) -> Column:
        start = F.transform(tokens, lambda x, i: ranked(x, part(F.get(tokens, i + 1), IDS)))
        return F.transform(F.aggregate(F.slice(tokens, 2, F.size(tokens)), start, step), lambda x: part(x, IDS).cast("int"))

    def at(raw: Column, i: Column) -> Column:
        return F.conv(F.hex(F.substring(raw, i + 1, F.lit(1))), 16, 10).cast("int")

    def of_bytes(raw: Column) -> Column:
        return bound(F.transform(F.sequence(F.lit(0), F.length(raw) - 1), lambda i: F.shiftleft(i.cast("long"), ID_BITS).bitwiseOR(F.get(single, at(raw, i)))), merged_all)

    def pieces(raw: Column, values: Column) -> Column:
        """raw, cut where no token can span."""

        def spanned(i: Column, size: int) -> Column:
            """Whether the size bytes from byte i on stand in a token; false if they pass the word's ends."""
            key = F.lit(1).cast("long")
            for k in range(size):
                key = F.shiftleft(key, 8) + F.when(i + k >= 0, F.get(values, i + k))
            bit = F.pmod(key * MUL, F.lit(1 << INNER_BITS)).cast("int")
            return F.coalesce(F.getbit(F.get(inner, F.shiftright(bit, 6)), bit.bitwiseAND(F.lit(63))) == 1, F.lit(False))

        places = F.filter(F.sequence(F.lit(1), F.length(raw) - 1), lambda i: ~(spanned(i - 1, 2) | spanned(i - 2, 3) | spanned(i - 1, 3)))
        return bound(places, lambda p: F.zip_with(F.concat(F.array(F.lit(0)), p), F.concat(p, F.array(F.length(raw))), lambda a, b: F.substring(raw, a + 1, b - a)))

    def of_long(raw: Column) -> Column:
        values = F.transform(F.sequence(F.lit(0), F.length(raw) - 1), lambda i: at(raw, i))
        return F.flatten(F.transform(bound(values, lambda v: pieces(raw, v)), of_bytes))

    return bound(word.cast("binary"), lambda raw: F.when(F.length(raw) > LONG, of_long(raw)).otherwise(of_bytes(raw)))


def thresholds(counts: DataFrame, sizes: list[int]) -> list[int]:
    """For each size (rising) the least count such that no more than size words have that count or a greater one. The
    driver sees how many words have each count, from the top until the greatest size is passed."""
    found, total, least = [], 0, NONE
    for n, size in counts.groupBy("n").agg(F.count("*").alias("size")).orderBy(F.desc("n")).limit(sizes[-1] + 1).toLocalIterator():
        total += size
        while len(found) < len(sizes) and total > sizes[len(found)]:
            found.append(least)
        if len(found) == len(sizes):
            break
        least = n
    return found + [least] * (len(sizes) - len(found))


def word_bucket(word: Column) -> Column:
    return F.hash(word).bitwiseAND(F.lit(WORD_BUCKETS - 1))


def common_words(docs: DataFrame, vocabulary: Vocabulary, pattern: str, frequent: int, listed: int) -> dict[str, pa.Array]:
    """The commonest words and their ids, by bucket of their hash: words (maps, of at most frequent words) and lists
    (texts, of the next ones up to listed words)."""
    spark = docs.sparkSession
    counts = written(docs.select(F.explode(words(F.col("text"), pattern)).alias("word")).groupBy("word").agg(F.count("*").alias("n")), "words")
    least, low = thresholds(counts, [frequent, listed])
    top = counts.where(F.col("n") >= min(least, low)).select("word", "n", literal(spark, vocabulary.tables).alias("_t"))
    known = top.select("word", "n", bound(F.col("_t"), lambda t: fields_bound(t, TABLES, lambda *tables: folded(F.col("word"), *tables))).alias("ids"), word_bucket(F.col("word")).alias("b"))
    known = written(known, "word-ids")
    word, ids, b = columns_of(known.where(F.col("n") >= least).select("word", "ids", "b"))
    entry = F.concat(F.lit(WORD_SIGN), "word", F.lit(IDS_SIGN), F.array_join(F.col("ids").cast("array<string>"), ","))
    plain = ~(F.contains("word", F.lit(WORD_SIGN)) | F.contains("word", F.lit(IDS_SIGN)))
    rest, at = columns_of(known.where((F.col("n") < least) & plain).groupBy("b").agg(F.array_join(F.collect_list(entry), "").alias("list")).select("list", "b"))
    released(spark, counts, known)
    place = np.full(WORD_BUCKETS, -1)
    place[at.to_numpy()] = np.arange(len(at))
    lists = rest.take(pa.array(place, mask=place < 0)).fill_null("")
    return {"words": bucketed_map(b.to_numpy(), word, ids, WORD_BUCKETS), "lists": pa.ListArray.from_arrays(pa.array([0, WORD_BUCKETS], pa.int32()), lists)}


def columns_of(df: DataFrame) -> list[pa.Array]:
    rows = df.toArrow().combine_chunks()
    return [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in rows.columns]


def encode(docs: DataFrame, vocabulary: Vocabulary, pattern: str, frequent: int = FREQUENT, listed: int = LISTED) -> DataFrame:
    """All columns of docs and ids (array of int), the text's token ids; an ids of docs is replaced."""
    spark = docs.sparkSession
    t = literal(spark, vocabulary.tables | common_words(docs, vocabulary, pattern, frequent, max(frequent, listed)))

    def in_list(w: Column, list_: Column) -> Column:
        """The word's ids from its bucket's list: what follows the word there, up to the next word."""
        tail = F.call_function("substring_index", list_, F.concat(F.lit(WORD_SIGN), w, F.lit(IDS_SIGN)), F.lit(-1))
        found = lambda tail: F.when(F.octet_length(tail) < F.octet_length(list_), F.split(F.substring_index(tail, WORD_SIGN, 1), ",").cast("array<int>"))
        return bound(tail, found)

    def ids_of(text: Column, known: Column, lists: Column, *tables: Column) -> Column:
        def of_word(w: Column) -> Column:
            return F.coalesce(F.get(known, word_bucket(w))[w], bound(F.get(lists, word_bucket(w)), lambda list_: in_list(w, list_)), folded(w, *tables))

        return F.flatten(F.transform(words(text, pattern), of_word))

    return with_literal(docs, t, "ids", lambda row, t: fields_bound(t, ["words", "lists", *TABLES], lambda *fields: ids_of(row["text"], *fields)))


def with_literal(df: DataFrame, t: Column, name: str, value: Callable[[Column, Column], Column]) -> DataFrame:
    """All columns of df but ``name``, and that one with a value computed from a struct of df's columns and the literal;
    the struct lets any names stand in df."""
    named = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), t.alias("t"))
    row = named["row"]
    return named.select(*[row[c].alias(c) for c in df.columns if c.lower() != name], bound(named["t"], lambda t: value(row, t)).alias(name))


def decode(tokens: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """All columns of tokens and decoded (binary), the bytes of its ids; a decoded of tokens is replaced."""

    def joined(row: Column, t: Column) -> Column:
        return fields_bound(t, ["pieces"], lambda pieces: F.unhex(F.array_join(F.transform(row["ids"], lambda i: F.get(pieces, i)), "")))

    return with_literal(tokens, literal(tokens.sparkSession, vocabulary.pieces), "decoded", joined)


def report(docs: DataFrame, vocabulary: Vocabulary, pattern: str, frequent: int = FREQUENT, listed: int = LISTED) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tokens = encode(slim, vocabulary, pattern, frequent, listed).select("doc_id", "ids")
    return decode(tokens, vocabulary).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
