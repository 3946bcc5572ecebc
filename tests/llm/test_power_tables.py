"""Tables of powers, which the driver keeps too: they follow the texts seen, and hold the right powers."""

import random

from sluice.llm import grid as G


def test_short_texts_make_short_tables(monkeypatch):
    monkeypatch.setattr(G, "_powers", {})
    (keys, grid), = G.grids([([1], [b"a few words of a benchmark item that the driver cuts"])], G.ALNUM, G.LOWER)
    at, hashes = grid.windows(5)
    assert len(hashes) == 7 and len(set(hashes.tolist())) == 7
    assert len(G._powers) == 6 and sum(x.nbytes for x in G._powers.values()) < 10_000


def test_tables_grow_with_the_texts_and_stay_right(monkeypatch):
    monkeypatch.setattr(G, "_powers", {})
    rng = random.Random(4)
    for n in (1, 2, 7, 8, 1000, 30, 20_001):
        for prime, base in G.PRIMES:
            table = G.residues(base, n, prime)
            assert len(table) == n and all(table[i] == pow(base, i, prime) for i in [0, n - 1, *rng.choices(range(n), k=50)])
        table = G.powers(G.WORD_BASE, n)
        assert len(table) == n and all(int(table[i]) == pow(G.WORD_BASE, i, 1 << 64) for i in [0, n - 1, *rng.choices(range(n), k=50)])
    assert all(len(x) <= 20_001 * 9 // 8 + 1 for x in G._powers.values())
