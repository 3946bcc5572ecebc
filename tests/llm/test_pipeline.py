import base64
import re

import public_tokenizers
import tiktoken

import corpus_pipeline
from sluice.llm import secret_scan
from tests.llm.test_contamination import brute as brute_hits
from tests.llm.test_near_dup import brute as brute_groups

EN = "the house of the old man was on the hill and it is that which they had seen before with this other one from there".split()


def sentence(i, n=30):
    return " ".join(EN[(i * 7 + k * (i % 5 + 1) + k * k % 11) % len(EN)] + (str(i) if k % 6 == 0 else "") for k in range(n))


def test_stages_match_a_plain_version(spark, tmp_path):
    leak = " ".join(f"quiz{i}" for i in range(12))
    texts = {i: sentence(i) for i in range(40)}
    texts |= {40: texts[3], 41: texts[4] + " more", 42: f"{sentence(90)} {leak} end", 43: f"{sentence(91)} token = \"{'ab12' * 10}\" end", 44: None, 45: "12 34 !!", 46: texts[3].upper(), 47: ""}
    docs = [(i, t, None if i % 9 == 0 else "en", "s", None if t is None else len(t)) for i, t in texts.items()]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    left = {i: t for i, t in texts.items() if t and re.search(r"[^\W\d_]", t)}
    left = {i: left[i] for i, _, _, kept in brute_groups(list(left.items())) if kept}
    left = {r[0]: left[r[0]] for r in brute_hits(list(left.items()), [(1, leak)]) if not r[5]}
    left = {i: secret_scan.redacted(t, "[SECRET]") for i, t in left.items()}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {i: plain.encode_ordinary(t) for i, t in left.items()}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.ids for r in got} == want and all(r.round_trip and r.n_tokens == len(r.ids) for r in got)
    assert {40, 42, 44, 45, 46, 47}.isdisjoint(want) and "[SECRET]" in left[43]


def test_stages_keep_the_columns_of_documents(spark):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "decontamination", "secret_scan", "byte_bpe"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.dtypes == docs.dtypes and 0 < out.count() <= docs.count()
        assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0
