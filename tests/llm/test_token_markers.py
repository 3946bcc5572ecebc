"""Literal added tokens in texts, against the library as it comes."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sluice.llm import token_file as T

PATH = public_tokenizers.path("word_bpe_49k.json")
JSON = open(PATH, encoding="utf-8").read()
PLAIN = Tokenizer.from_file(PATH)
TEXTS = ["end <|endoftext|> next", "<|endoftext|>", "a<|startoftext|>b,<|endoftext|><|endoftext|>.", "END\t<|ENDOFTEXT|>\n<|endoftext|>\x01x \x01", "it's<|endoftext|>'s", "<|endoftext|", "<|endoftext|>\u0338 e\u0301<|startoftext|>\u0301"]


@pytest.mark.parametrize("text", TEXTS)
def test_literal_markers_are_single_ids(text):
    assert np.frombuffer(T.encoder(JSON).encode([text])[0], "<u4").tolist() == PLAIN.encode(text, add_special_tokens=False).ids


def test_starts_after_a_marker(spark):
    texts = ["one", *TEXTS, "two words"]
    got = T.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), JSON).orderBy("doc_id").collect()
    start = 0
    for r, text in zip(got, texts, strict=True):
        ids = [*PLAIN.encode(text, add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
