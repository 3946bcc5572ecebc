"""The registered queries of the operators in this subpackage, and their SQL where DuckDB can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sluice.llm import byte_bpe, contamination, gif, language, main_text, near_dup, quality, secret_scan, substring_dedup, token_file

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def op1_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.report(table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.main_text(table(spark, sf_dir, "pages"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


def op4_minmax_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file.report(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = byte_bpe.Vocabulary.read(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return byte_bpe.report(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(table(spark, sf_dir, "documents"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=10)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Query]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: A run of anything but white space, and of digits, small letters and non-ASCII characters.
SOLID, ALNUM = r"[^\x20\x09-\x0D]+", r"[0-9a-z\x{80}-\x{10FFFF}]+"

MINMAX_NEAR_DUP = f"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, '{SOLID}') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
    link AS (SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 75 * (p.n + q.n - k)),
    reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) AS component_id, d.doc_id <= coalesce(m.b, d.doc_id) AS kept
    FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT a, min(b) AS b FROM reach GROUP BY a) m ON m.a = d.doc_id"""

SUBSTRING_DEDUP = f"""
    WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{SOLID}') AS w FROM documents),
    t AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w WHERE len(w) >= 13),
    g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM t),
    f AS (SELECT g, min(doc_id) AS first FROM g GROUP BY g),
    gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM g JOIN f USING (g) WHERE first < doc_id),
    p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
    k AS (SELECT p.doc_id, count(gone.i) AS n_removed, string_agg(word, ' ' ORDER BY p.i) FILTER (gone.i IS NULL) AS kept FROM p LEFT JOIN gone ON gone.doc_id = p.doc_id AND gone.i = p.i GROUP BY p.doc_id)
    SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON k.doc_id = w.doc_id"""

DECONTAMINATION = f"""
    WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, '{ALNUM}') AS w FROM documents),
    b AS (SELECT item_id, regexp_extract_all({LOWER}, '{ALNUM}') AS w FROM benchmark),
    bi AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
    q AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM bi),
    di AS (SELECT doc_id, w, z.n, unnest(range(1, len(w) - z.n + 2)) AS i FROM d, (SELECT DISTINCT n FROM q) z WHERE len(w) >= z.n),
    h AS (SELECT doc_id, i, q.n, item_id FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM di) x JOIN q ON q.n = x.n AND q.g = x.g),
    c AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS i FROM h) GROUP BY doc_id),
    m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id"""


def oracle_sql() -> dict[str, str]:
    """The other operators decode files, learn, or run a tokenizer, which SQL cannot express; tests hold those against
    brute-force versions, exact round trips or held-out accuracy."""
    return {"op4_minmax_near_dup": MINMAX_NEAR_DUP, "op8_substring_dedup": SUBSTRING_DEDUP, "op9_benchmark_decontamination": DECONTAMINATION}
