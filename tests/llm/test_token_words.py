"""New pieces of texts, cut and encoded in one go, against the library as it comes."""

import gc
import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from sluice.llm import token_file as T

PATH = public_tokenizers.path("word_bpe_49k.json")
JSON = open(PATH, encoding="utf-8").read()
PLAIN = Tokenizer.from_file(PATH)


def mixed(seed, n):
    rng = random.Random(seed)
    letters, others = "abzéÀßŁłªµºÿĮį", ["'s", "1", "\x01", "\r", "\x85", "中", "İ", "\u0301", "<|endoftext|>", "", "x\x1cy"]
    piece = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(0, 9))) + rng.choice(["", ".", "--", "?!", *others]) + rng.choice(["", ",", "b"])
    return [rng.choice([" ", "\n", "  "]).join(piece() for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_ids_do_not_depend_on_what_is_known(monkeypatch):
    monkeypatch.setattr(T, "PIECES", 150)
    monkeypatch.setattr(T, "STEMS", 200)
    encoder, texts = T.WordEncoder(JSON), mixed(1, 120)
    for part in (texts[:1], texts[1:60], texts[60:], texts[::-1]):
        for text, ids in zip(part, encoder.encode(part), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == PLAIN.encode(text, add_special_tokens=False).ids


def test_the_collector_rests_while_texts_are_encoded():
    encoder, runs = T.WordEncoder(JSON), []
    watch = lambda phase, info: runs.append(phase)
    texts = [" ".join(f"w{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvwxyzabcd'[k // 100 % 10]}{k}." for k in range(6000))]
    gc.callbacks.append(watch)
    try:
        encoder.encode(texts)
    finally:
        gc.callbacks.remove(watch)
    assert not runs and gc.isenabled()
