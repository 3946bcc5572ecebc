import random
import re

import pytest

from sluice.llm import near_dup as N
from sluice.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(docs):
    sets = [(d, shingles(t)) for d, t in docs]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= 75 * len(s | t) and find(a) != find(b):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return sorted((d, len(s), find(d), find(d) == d) for d, s in sets)


def corpus(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 6)))
    bases = [[word() for _ in range(rng.choice([12, 40, 90]))] for _ in range(6)]
    docs = []
    for i in range(n):
        base = list(rng.choice(bases[:2] if i % 2 else bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            k = rng.randrange(len(base))
            base[k : k + 1] = rng.choice([[word()], [], [base[k], word()]])
        docs.append((i * 7 % 1009, rng.choice([" ", "\n", " \t"]).join(base).upper() if i % 5 == 0 else " ".join(base)))
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_brute_force(spark, seed):
    docs = corpus(seed, 160) + [(2000, None), (2001, ""), (2002, " \n"), (2003, "one two"), (2004, "ONE  two"), (2005, "one two three"), (2006, "a b c d e f g"), (2007, "a b c d e f g h"), (2008, "long words " * 9000), (2009, "long words " * 9001)]
    df = spark.createDataFrame([(d, t, "clash") for d, t in docs], "doc_id long, text string, class string")
    assert sorted(tuple(r) for r in N.near_duplicates(df).collect()) == brute(docs)


def test_every_pair_across_components_is_compared(spark, monkeypatch):
    monkeypatch.setattr(N, "proposals", lambda members, about: members.select(N.F.col("id").alias("a"), N.F.col("id").alias("b")).limit(0))
    monkeypatch.setattr(N, "BLOCK", 7)
    docs = corpus(3, 90)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    in_threes = [g for g in brute(docs) if sum(x[2] == g[2] for x in brute(docs)) > 12]
    got = {tuple(r) for r in N.near_duplicates(df).collect()}
    assert in_threes and set(in_threes) <= got


def test_null_ids_repeated_rows_and_empty_tables(spark):
    schema = "doc_id long, text string"
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (None, "x y"), (9, "A b c d e f")]
    got = sorted((tuple(r) for r in N.near_duplicates(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(5, 2, 5, True)] * 2 + [(None, 2, 5, False), (None, 1, None, True), (9, 2, 5, False)], key=str)
    assert N.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    kept = N.deduplicated(spark.createDataFrame([(9, "A b c d e f", 1), (5, "a b c d e f", 2), (7, None, 3)], "doc_id long, text string, n_shingles int"))
    assert sorted(tuple(r) for r in kept.collect()) == [(5, "a b c d e f", 2), (7, None, 3)]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 150), (150, 200)]
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 30)} | {200: 150}


def test_one_row_stays_of_copies_without_id(spark):
    a, b = "a b c d e f g h i j k l m", "n o p q r s t u v w"
    rows = [(None, a, 1), (None, a, 1), (None, a.upper(), 2), (4, b, 3), (None, b, 4), (None, b.upper(), 5), (None, None, 6), (None, None, 7), (None, " ", 8), (3, None, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node int")
    kept = [tuple(r) for r in N.deduplicated(df).collect()]
    assert sorted((t, n) for i, t, n in kept if t and t.strip()) in ([(a, 1), (b, 3)], [(a.upper(), 2), (b, 3)])
    assert sorted(n for _, t, n in kept if not t or not t.strip()) == [6, 7, 8, 9]


def test_cells_hold_a_bounded_number_of_shingles_and_lose_no_pair(monkeypatch):
    monkeypatch.setattr(N, "HELD", 50)
    rng = random.Random(6)
    size = {i: rng.randint(1, 30) for i in range(60)}
    found = [(i, size[i], N.np.array(sorted(rng.sample(range(60), rng.randint(1, 40))), N.np.int64)) for i in rng.sample(range(60), 40)]
    cells = list(N.cells_of(found, size, "x"))
    assert len({name for name, _, _ in cells}) == len(cells) > 5
    pairs = [(i, p) for _, ids, ps in cells for i, own in zip(ids, ps, strict=True) for p in own.tolist()]
    assert sorted(pairs) == sorted((i, p) for i, _, own in found for p in own.tolist())
    for _, ids, ps in cells:
        assert set(ids) >= {p for own in ps for p in own.tolist()}
        assert sum(size[i] for i in ids) <= 50 or len(ids) == 2


def test_hot_keys_join_their_facts(spark, monkeypatch):
    from sluice.llm import store

    monkeypatch.setattr(store, "HOT_KEYS", 3)
    rows = spark.createDataFrame([("hot", i) for i in range(70)] + [(None, 1000), (None, 1001)] + [(f"k{i}", 100 + i) for i in range(20)], "k string, v long")
    facts = spark.createDataFrame([("hot", 1, 70)] + [(f"k{i}", 10 + i, 1) for i in range(15)], "k string, x long, n long")
    got = {r.v: (r.k, r.x) for r in store.joined_by_key(rows, facts, "k", "n", 92).collect()}
    assert got == {i: ("hot", 1) for i in range(70)} | {1000: (None, None), 1001: (None, None)} | {100 + i: (f"k{i}", 10 + i if i < 15 else None) for i in range(20)}
    from sluice.functions.names import free_names

    assert free_names(["Text", "_text"], "text", "other") == ["__text", "other"]
