import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sluice.llm import token_file as T

JSON = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
WHOLE = Tokenizer.from_str(JSON)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000])
def test_segment_round_trip_and_random_access(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 49408, n), rng.integers(0, 1 << 32, n), np.full(n, 7), np.where(rng.random(n) < 0.05, 1 << 31, rng.integers(0, 9, n))):
        ids = ids.astype(np.uint32)
        docs = [(None, n // 2), (-5, n - n // 2)]
        s = T.Segment(T.encode_segment(ids, docs))
        assert s.docs == docs and (s.read(0, n) == ids).all()
        for a, b in ((0, n // 3), (n // 3, n), (n // 2, n // 2 + 1)):
            assert (s.read(a, min(b, n)) == ids[a:b]).all()
    few = np.where(np.arange(5120) % 40 == 0, 40000, np.arange(5120) % 200).astype(np.uint32)
    assert len(T.encode_segment(few, [])) < 5120 * 1.25  # a few large ids don't widen a block


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab'st <|endoftext|>\n\t\r\x1c\x85\xa0 ́éÉİß12,.!中"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_pieces_give_the_ids_of_the_whole_text(text):
    assert np.frombuffer(T.encoder(JSON).encode([text])[0], "<u4").tolist() == WHOLE.encode(text, add_special_tokens=False).ids


def test_words_of_every_simple_letter():
    letters = [chr(c) for c in range(0x130) if chr(c).isalpha()]
    words = [*letters, "".join(letters), *(a + "ab" + b for a, b in zip(letters, letters[7:], strict=False)), "ÉCOLE!!", "straße,", "x" * 500]
    for w, ids in zip(words, T.encoder(JSON).encode(words), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == WHOLE.encode(w, add_special_tokens=False).ids


def test_query_matches_a_plain_loop(spark):
    texts = ["It's the END.\nof  12 things", None, "", "naïve café " * 9000, "<|endoftext|> x", "word"]
    rows = [(i * 3 % 7, t, 9) for i, t in enumerate(texts)] + [(3, "word", 9), (None, "first", 9)] + [(100 + i, f"text {i} " * (i % 50), 9) for i in range(300)]
    got = T.report(spark.createDataFrame(rows, "doc_id long, text string, start long"), JSON).collect()
    want, start = [], 0
    for d, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*WHOLE.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((d, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert T.report(spark.createDataFrame([], "doc_id long, text string"), JSON).count() == 0


def test_rows_without_id_are_split_over_shards(spark):
    rows = [(None, f"text {i % 7}") for i in range(4000)] + [(i, "word") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    path = T.fresh_path(spark, "tokens")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        T.write_token_file(df, path, JSON)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r.n for r in spark.read.parquet(path).groupBy("shard").agg({"n_ids": "sum"}).toDF("shard", "n").collect()]
    assert len(sizes) == 4 and max(sizes) < 0.5 * sum(sizes)
    got = T.read_token_file(spark, path).orderBy("start").collect()
    assert len(got) == len(rows) and [r.doc_id for r in got[4000:]] == list(range(40))
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:], strict=False))
