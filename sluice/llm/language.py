"""Language identification with labelled spans.

A word is a run of ASCII letters and non-ASCII characters. Its first character's Unicode script narrows the candidate
languages to those that use the script in training; a hashed byte n-gram model (2 to 4 bytes, word ends included) scores
the word under each candidate; Viterbi over a document's words with a penalty for each switch labels spans of mixed
text. A document's language is the one it opens in, if the spans of that one hold at least a quarter of its bytes (a
quoted passage may be longer than what surrounds it), else the one whose spans hold most; its score is their share.

The model is fitted on at most ``per_language`` whole documents of each language, the ones of least hash among those
that are not held out (of several texts of one doc_id the least); everything else sees every row and whole texts. They
are cut by a bound on the hash that follows from the language's count, and only what passes it is ranked. Prediction is
a map with no shuffle: only the model (a few MB, independent of the corpus) is sent to the tasks. A word's n-grams end
with it and scores are whole numbers, so a prediction depends on the text and the model alone, whatever rows stand
beside it. ``OPENING`` was chosen on training rows only.

Null texts and texts without a letter are ``und`` with score 0 and no spans; without any training row every text is
``und``. Words of a script that no language uses carry no evidence. Repeated rows are predicted row by row; an empty
table gives an empty result; further columns are ignored. Ties go to the language with more training words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.grid import LOWER, Grid, grids, sliced

ORDERS, BITS = (2, 3, 4), 16
#: Log scores are whole multiples of 2**-POINT.
POINT = 20
SWITCH, OPENING = 12.0, 0.25
LETTER = np.zeros(256, bool)
for _a, _b in ((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    LETTER[_a : _b + 1] = True
#: First code points of Unicode ranges and the script each begins.
SCRIPTS = (
    (0x0, "latin"), (0x250, "other"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x780, "other"), (0x900, "devanagari"), (0x980, "bengali"), (0xA00, "other"),
    (0xE00, "thai"), (0xE80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"),
    (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"),
)
NAMES = sorted({s for _, s in SCRIPTS})
EDGES = np.array([a for a, _ in SCRIPTS])
CODES = np.array([NAMES.index(s) for _, s in SCRIPTS])


def folded(grid: Grid) -> np.ndarray:
    """The grid's bytes with A-Z and the Latin-1 capitals in lower case (byte lengths stay) and all else but letters as
    spaces, with a space at either end."""
    raw = np.full(len(grid.buf) + 2, 0x20, np.uint8)
    b = LOWER[grid.buf]
    capital = np.zeros(len(b), bool)
    capital[1:] = (b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E) & (b[1:] != 0x97)
    raw[1:-1] = np.where(LETTER[b], b + np.where(capital, 0x20, 0).astype(np.uint8), 0x20)
    return raw


def buckets(raw: np.ndarray, n: int) -> np.ndarray:
    """Bucket of the n bytes that begin at each place; places near the end are padded with spaces."""
    padded = np.concatenate([raw, np.full(n, 0x20, np.uint8)])
    h = np.zeros(len(raw), np.uint32)
    for k in range(n):
        h = h * np.uint32(0x01000193) + padded[k : k + len(raw)]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(32 - BITS)).astype(np.int32)


def scripts(grid: Grid) -> np.ndarray:
    """Script number of every word's first character."""
    b = np.concatenate([grid.buf, np.zeros(4, np.uint8)]).astype(np.int32)
    s = grid.starts
    lead, b1, b2 = b[s], b[s + 1] & 0x3F, b[s + 2] & 0x3F
    point = np.where(lead < 0x80, lead, np.where(lead < 0xE0, (lead & 0x1F) << 6 | b1, np.where(lead < 0xF0, (lead & 0xF) << 12 | b1 << 6 | b2, 0x1F000)))
    return CODES[np.searchsorted(EDGES, point, side="right") - 1]


class Model:
    """languages, by falling number of training words; log[n][bucket, language]; allowed[script, language]."""

    def __init__(self, texts: list[bytes], langs: list[str]) -> None:
        names = sorted(set(langs))
        counts = {n: np.zeros((1 << BITS, len(names))) for n in ORDERS}
        seen, words = np.zeros((len(NAMES), len(names))), np.zeros(len(names))
        for keys, grid in grids([(langs, texts)], LETTER):
            raw = folded(grid)
            own = np.array([names.index(k) for k in keys])
            lang = own[grid.doc]
            for n in ORDERS:
                bucket = buckets(raw, n)
                places, size = word_places(grid, n)
                cell = bucket[places] * len(names) + np.repeat(lang, size)
                counts[n] += np.bincount(cell, minlength=counts[n].size).reshape(counts[n].shape)
            seen += np.bincount(scripts(grid) * len(names) + lang, minlength=seen.size).reshape(seen.shape)
            words += np.bincount(lang, minlength=len(names))
        order = sorted(range(len(names)), key=lambda i: (-words[i], names[i]))
        self.languages = [names[i] for i in order]
        smooth = {n: np.log((c[:, order] + 0.1) / (c[:, order].sum(0) + 0.1 * (1 << BITS))) for n, c in counts.items()}
        whole = {n: np.rint(x * (1 << POINT)).astype(np.int32) for n, x in smooth.items()}
        self.log = {n: np.vstack([x, np.zeros(len(names), np.int32)]) for n, x in whole.items()}  # and a row of no evidence
        self.allowed = (seen[:, order] >= 0.005 * np.maximum(words[order], 1)) & (seen[:, order] > 0)

    def word_scores(self, grid: Grid) -> np.ndarray:
        """Log score of every word under every language, averaged over the n-gram orders."""
        raw = folded(grid)
        each = np.zeros((len(raw), len(self.languages)), np.int32)
        for n in ORDERS:
            bucket = buckets(raw, n)
            for k in range(n - 2):  # n-grams that would pass the space after the word count nothing
                at = grid.ends - k
                bucket[at[at >= grid.starts]] = 1 << BITS
            each += self.log[n][bucket]
        total = np.zeros((len(raw) + 1, len(self.languages)), np.int64)
        np.cumsum(each, axis=0, dtype=np.int64, out=total[1:])
        scores = (total[grid.ends + 1] - total[grid.starts]) / float(len(ORDERS) << POINT)
        fits = self.allowed[scripts(grid)]
        known = fits.any(1)
        scores[~known] = 0
        scores[known] += np.where(fits[known], 0, -50.0)
        return scores


def word_places(grid: Grid, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all n-grams of the words in the folded bytes (a word's own space before and after it included), and the
    number of each word."""
    size = np.maximum(grid.ends - grid.starts + 3 - n, 0)
    offset = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return np.repeat(grid.starts, size) + offset, size


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of every word; document d has words first[d] to first[d + 1]. All documents go a word at a time."""
    count = np.diff(first)
    order = np.argsort(-count, kind="stable")
    begin, count = first[:-1][order], count[order]
    back, own = np.zeros(scores.shape, np.uint8), np.arange(scores.shape[1], dtype=np.uint8)
    labels = np.zeros(len(scores), np.uint8)
    steps = int(count[0]) if len(count) else 0
    active = np.searchsorted(-count, -np.arange(steps), side="left")  # documents with more than t words
    value = np.zeros((len(count), scores.shape[1]))
    for t in range(steps):
        k = active[t]
        at = begin[:k] + t
        if t:
            v = value[:k]
            best = v.argmax(1)
            jump = v[np.arange(k), best][:, None] - penalty
            stay = v >= jump
            back[at] = np.where(stay, own, best[:, None])
            value[:k] = np.where(stay, v, jump) + scores[at]
        else:
            value[:k] = scores[at]
    label = value.argmax(1)
    for t in range(steps - 1, -1, -1):
        k = active[t]
        at = begin[:k] + t
        labels[at] = label[:k]
        label[:k] = back[at, label[:k]] if t else label[:k]
    return labels


def held_out() -> F.Column:
    """Whether a document's crc32(doc_id as text) mod 4 is 2; a null id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, per_language: int = 400) -> Model | None:
    """A model from at most per_language documents of each language among the rows of docs with text and lang."""
    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    size = rows.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n"))
    share = (3.5 * per_language + 100) / F.greatest("n", F.lit(1))  # fewer than per_language pass with a probability of less than 1e-20
    near = rows.join(F.broadcast(size), "lang").where((share >= 1) | (F.col("h") / float(1 << 64) + 0.5 < share)).select("doc_id", "lang", "h").distinct()
    first = Window.partitionBy("lang").orderBy("h", "doc_id")
    chosen = near.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= per_language).select("doc_id", "lang")
    texts = docs.where("text IS NOT NULL").select("doc_id", "lang", F.col("text").cast("binary").alias("text"))
    own = [F.col(f"d.{c}").eqNullSafe(F.col(f"c.{c}")) for c in ("doc_id", "lang")]
    sample = texts.alias("d").join(F.broadcast(chosen).alias("c"), own, "left_semi").groupBy("doc_id", "lang").agg(F.min("text").alias("text")).toArrow()
    if not sample.num_rows:
        return None
    return Model(sample.column("text").to_pylist(), sample.column("lang").to_pylist())


RESULTS = ("_lang", "_score", "_spans")


def label_languages(docs: DataFrame, model: Model | None, penalty: float = SWITCH, names: tuple[str, str, str] = RESULTS) -> DataFrame:
    """All columns of docs but ``names`` and, per row under these, the language, its score and the spans (code points, end
    exclusive, and language of each run of words with one label)."""
    kind = "array<struct<start:int,end:int,lang:string>>"
    docs = docs.drop(*[c for c in docs.columns if c.lower() in names])
    fresh = zip(("", 0.0, F.array().cast(kind)), names, strict=True)
    schema = docs.select("*", *[(v if isinstance(v, F.Column) else F.lit(v)).alias(n) for v, n in fresh]).schema
    held = docs.sparkSession.sparkContext.broadcast(model)

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = docs_columns.index("text")
        for batch in sliced(batches, "text"):
            texts = batch.column(place).to_pylist()
            raw = [(t or "").encode() for t in texts]
            langs, scores, spans = [], [], []
            for keys, grid in grids([(texts, raw)], LETTER):
                for lang, score, found in predictions(held.value, keys, grid, penalty):
                    langs.append(lang)
                    scores.append(score)
                    spans.append(found)
            arrow = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
            columns = [batch.column(k) for k in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, arrow)], names=[*batch.schema.names, *names])

    docs_columns = docs.columns
    return docs.mapInArrow(labelled, schema)


def predictions(model: Model | None, texts: list[str | None], grid: Grid, penalty: float) -> Iterator[tuple[str, float, list[dict]]]:
    if model is None or not len(grid.starts):
        yield from (("und", 0.0, []) for _ in texts)
        return
    labels = viterbi(model.word_scores(grid), grid.first, penalty)
    n = len(model.languages)
    weight = np.bincount(grid.doc * n + labels, weights=grid.ends - grid.starts, minlength=len(texts) * n).reshape(-1, n)
    point = np.cumsum((grid.buf & 0xC0) != 0x80)
    for d, text in enumerate(texts):
        a, b = grid.first[d], grid.first[d + 1]
        if a == b or not any(map(str.isalpha, text)):
            yield "und", 0.0, []
            continue
        share = weight[d] / weight[d].sum()
        best = int(labels[a]) if share[labels[a]] >= OPENING else int(share.argmax())
        turn = a + np.concatenate([[0], np.flatnonzero(np.diff(labels[a:b].astype(np.int16))) + 1])
        stop = np.append(turn[1:], b) - 1
        base = point[grid.at[d] - 1] if d else 0
        starts, ends = point[grid.starts[turn]] - 1 - base, point[grid.ends[stop] - 1] - base
        spans = [{"start": int(s), "end": int(e), "lang": model.languages[labels[w]]} for s, e, w in zip(starts, ends, turn, strict=True)]
        yield model.languages[best], float(share[best]), spans


def identify(docs: DataFrame, per_language: int = 400) -> DataFrame:
    """Fit on the rows of docs that are not held out, and return doc_id, held_out, lang_pred and score of every row."""
    model = fit(docs.where(~held_out()), per_language)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = label_languages(slim, model)
    return found.select("doc_id", held_out().alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))
