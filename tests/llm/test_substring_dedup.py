import hashlib
import random
import re

import numpy as np
import pytest

from sluice.llm import fm_index, substring_dedup as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, span=13):
    first = {}
    for d, t in docs:
        w = WORD.findall(t or "")
        for i in range(len(w) - span + 1) if d is not None else ():
            key = tuple(w[i : i + span])
            first[key] = min(first.get(key, d), d)
    out = []
    for d, t in docs:
        w = WORD.findall(t or "")
        gone = set()
        for i in range(len(w) - span + 1) if d is not None else ():
            if first[tuple(w[i : i + span])] < d:
                gone |= set(range(i, i + span))
        left = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(left.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcé.") for _ in range(rng.randint(1, 4)))
    passages = [[word() for _ in range(rng.choice([12, 13, 14, 30, 70]))] for _ in range(8)] + [["la"] * 20, ["a", "b"] * 12]
    docs = []
    for i in range(n):
        words = []
        for _ in range(rng.randint(0, 4)):
            words += [word() for _ in range(rng.randint(0, 20))]
            p = rng.choice(passages)
            a = rng.choice([0, 0, 1, 3])
            words += p[a : len(p) - rng.choice([0, 0, 2])]
        docs.append(((i * 37) % 997, rng.choice([" ", "\n", " \t"]).join(words)))
    return docs


@pytest.mark.parametrize(("seed", "hot"), [(1, 20_000), (2, 3)])
def test_matches_brute_force(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(S, "HOT", hot)
    monkeypatch.setattr(S, "SHARD", 300)
    docs = corpus(seed, 120)
    docs += [docs[0], docs[1], (None, docs[2][1]), (None, docs[2][1]), (5000, None), (5001, ""), (5002, docs[3][1]), (5003, "x " * 20000), (5004, "x " * 13), (docs[4][0], "other " * 14), (5005, "other " * 13)]
    df = spark.createDataFrame([(d, t, b"clash") for d, t in docs], "doc_id long, text string, key binary")
    assert sorted((tuple(r) for r in S.report(df).collect()), key=str) == brute(docs)


def test_texts_without_repeats(spark):
    a, b = " ".join(f"a{i}" for i in range(14)), " ".join(f"b{i}" for i in range(5))
    rows = [(1, f"x\n{a}", "k"), (2, f"{b} {a} tail", "k"), (3, f"x {a}", "k"), (4, None, None), (None, a, "n"), (5, " same  as before ", "k")]
    got = S.deduplicate(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted([(1, f"x\n{a}", "k"), (2, f"{b} tail", "k"), (3, "", "k"), (4, None, None), (None, a, "n"), (5, " same  as before ", "k")], key=str)


def test_empty_table(spark):
    assert S.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_backward_search_counts_every_pattern():
    rng = np.random.default_rng(2)
    text = np.append(rng.integers(1, 5, 400), 0)
    index = fm_index.FmIndex(text, np.arange(401), 13)
    plain = text.tolist()
    for m in (1, 2, 3, 7, 13, 16):
        for i in rng.integers(0, 380, 20).tolist():
            pattern = plain[i : i + m]
            low, high = np.array([0]), np.array([index.n])
            for c in pattern[::-1]:
                low, high = index.extend(np.array([c]), low, high)
            assert high[0] - low[0] == sum(plain[k : k + m] == pattern for k in range(len(plain) - m + 1))
    length, _ = fm_index.matching(index, text, np.arange(20, 400), 13)
    for e, n in zip(range(20, 400), length.tolist(), strict=True):
        seen = lambda m, e=e: sum(plain[k : k + m] == plain[e - m + 1 : e + 1] for k in range(len(plain) - m + 1)) > 1
        assert (n == 0 or seen(n)) and (n == 13 or not seen(n + 1))


def test_words_that_collide_modulo_powers_of_two(spark):
    """A Thue-Morse word and its complement have one hash modulo 2**64 in every base; their windows differ."""
    word = "a"
    for _ in range(12):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rest = [f"w{i}" for i in range(12)]
    docs = [(1, " ".join([word, *rest])), (2, " ".join([other, *rest])), (3, " ".join([*rest, other])), (4, " ".join([*rest, other]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(tuple(r) for r in S.report(df).collect()) == brute(docs) and brute(docs)[1][2] == 0
    from sluice.llm import near_dup

    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark.createDataFrame([(1, word), (2, other), (3, word)], "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_intervals_are_runs_of_windows_of_one_owner():
    length = np.array([13, 13, 12, 13, 13, 13, 13, 13])
    least = np.array([4, 4, 4, 4, 5, 5, 5, 5])
    piece = np.array([0, 0, 0, 0, 0, 0, 1, 1])
    place = np.array([0, 1, 2, 3, 4, 5, 0, 1])
    got = [x.tolist() for x in fm_index.intervals(length, least, piece, place, 13)]
    assert list(zip(*got, strict=True)) == [(0, 0, 14, 4), (0, 3, 16, 4), (0, 4, 18, 5), (1, 0, 14, 5)]


def test_least_owner_of_every_repeated_window():
    rng = np.random.default_rng(5)
    text = np.append(np.concatenate([np.append(rng.integers(1, 3, 60), 0) for _ in range(8)]), 0)
    owner = np.repeat(np.arange(len(text)) // 61, 1)
    index = fm_index.FmIndex(text, owner, 13)
    plain = text.tolist()
    ends = np.array([e for e in range(12, len(text)) if 0 not in plain[e - 12 : e + 1]])
    length, row = fm_index.matching(index, text, ends, 13)
    for e, n, r in zip(ends.tolist(), length.tolist(), row.tolist(), strict=True):
        starts = [k for k in range(len(plain) - 12) if plain[k : k + 13] == plain[e - 12 : e + 1]]
        assert (len(starts) > 1) == (n == 13) and (n < 13 or index.least(np.array([r]))[0] == min(owner[k] for k in starts))


def test_clashing_columns(spark):
    a = " ".join(f"a{i}" for i in range(14))
    df = spark.createDataFrame([(1, a, 1, 2, 3, 4), (2, f"x {a}", 5, 6, 7, 8)], "doc_id long, text string, version int, copy int, left int, found int")
    assert sorted(tuple(r) for r in S.deduplicate(df).collect()) == [(1, a, 1, 2, 3, 4), (2, "x", 5, 6, 7, 8)]
