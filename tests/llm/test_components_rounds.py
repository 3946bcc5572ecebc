from sluice.llm import components as C


def test_stars_settle_in_one_round(spark, monkeypatch):
    rounds, star = [], C.small_star
    monkeypatch.setattr(C, "small_star", lambda edges, total: rounds.append(total) or star(edges, total))
    stars = [(i, 1) for i in range(2, 20)] + [(i, 100) for i in range(101, 130)]
    for edges in (stars, []):
        rounds.clear()
        got = sorted(tuple(r) for r in C.components(spark.createDataFrame(edges, "a long, b long")).collect())
        assert got == edges and len(rounds) == 1
    chain = [(i, i + 1) for i in range(30)]
    assert sorted(tuple(r) for r in C.components(spark.createDataFrame(chain, "a long, b long")).collect()) == [(i, 0) for i in range(1, 31)]
