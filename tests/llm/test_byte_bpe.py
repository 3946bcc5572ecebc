import base64
import hashlib
import random

import public_tokenizers
import tiktoken

from sluice.llm import byte_bpe as B

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
TRUE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def sha(x):
    return hashlib.sha256(x).hexdigest()


def test_ids_and_bytes_match_the_library(spark):
    rng = random.Random(1)
    letters = "etaoin shrdlu  \n\t.,!'s12éßñ中文字😀 \u0085​İ٣" + "'re'll"
    texts = [None, "", " ", "Hello world! It's 2024...  ok\n\n", "naïve café x  y", "<|endoftext|>", "a" * 300, "word " * 8000, "ciónrauedo épation 中文 😀😀 \t\t end  "]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 80))) for _ in range(150)]
    df = spark.createDataFrame([(i, t, [7]) for i, t in enumerate(texts)] + [(3, texts[3], [7]), (None, "x", None)], "doc_id long, text string, ids array<int>")
    vocabulary = B.Vocabulary.read(PATH)
    for frequent, listed in ((0, 0), (40, 40), (20, 200)):
        got = B.report(df, vocabulary, public_tokenizers.PATTERN, frequent, listed).collect()
        assert len(got) == len(texts) + 2
        by_id = {r.doc_id: r for r in got}
        for i, t in enumerate(texts):
            ids = TRUE.encode_ordinary(t or "")
            r = by_id[i]
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())), (frequent, t)
    assert B.report(df.limit(0), vocabulary, public_tokenizers.PATTERN).count() == 0


def test_long_words(spark):
    """Words of thousands of letters, unspaced text, and signs that word lists are made of."""
    rng = random.Random(3)
    chinese = "人工智能是计算机科学的一个分支它企图了解智能的实质并生产出一种新的能以人类智能相似的方式做出反应的智能机器"
    thai = "ภาษาไทยเป็นภาษาที่มีระดับเสียงของคำแน่นอนหรือวรรณยุกต์"
    texts = ["".join(rng.choice("etaoinshrdlucmfwypvbgkjqxz") for _ in range(n)) for n in (47, 48, 49, 50, 5000)]
    texts += ["".join(rng.choice(chinese) for _ in range(4000)), chinese * 20, thai * 30, "lauer" * 400, "中a" * 700, "!?" * 900, "\x01\x02 a\x01b \x02 c\x02"]
    df = spark.createDataFrame(list(enumerate(texts * 2)), "doc_id long, text string")
    vocabulary = B.Vocabulary.read(PATH)
    for frequent, listed in ((0, 0), (5, 50)):
        got = {r.doc_id: r for r in B.report(df, vocabulary, public_tokenizers.PATTERN, frequent, listed).collect()}
        for i, t in enumerate(texts * 2):
            ids = TRUE.encode_ordinary(t)
            assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(",".join(map(str, ids)).encode()), sha(t.encode())), t[:60]


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "one two", 5, "x", "y", 7, 8)], "doc_id long, text string, ids int, _t string, t string, row int, decoded int")
    vocabulary = B.Vocabulary.read(PATH)
    got = B.decode(B.encode(df, vocabulary, public_tokenizers.PATTERN), vocabulary)
    assert got.columns == ["doc_id", "text", "_t", "t", "row", "ids", "decoded"]
    (r,) = got.collect()
    assert (r.ids, bytes(r.decoded), r._t, r.row) == (TRUE.encode_ordinary("one two"), b"one two", "x", 7)
