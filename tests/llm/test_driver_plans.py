"""What the driver plans on small tables: its memory there follows the number and the size of its plans."""

from sluice.llm import near_dup as N
from sluice.llm import store
from tests.llm.test_near_dup import brute


def test_small_tables_join_their_facts_without_a_shuffle(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4), (None, 5)], "k string, v long")
    facts = spark.createDataFrame([("a", 10, 2), ("b", 11, 1)], "k string, x long, n long")
    joined = store.joined_by_key(rows, facts, "k", "n", 5)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastExchange") == 1 and "Exchange hashpartitioning" not in plan
    assert joined.columns == ["k", "v", "x"]
    assert sorted((r.v, r.k, r.x) for r in joined.collect()) == [(1, "a", 10), (2, "a", 10), (3, "b", 11), (4, "c", None), (5, None, None)]


def test_components_are_joined_anew_only_for_new_links(spark, monkeypatch):
    calls, components = [], N.components
    monkeypatch.setattr(N, "components", lambda edges: calls.append(1) or components(edges))
    words = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(words[:29] + [f"x{i}"])) for i in range(6)] + [(9, " ".join(words[::-1])), (10, None)]
    got = N.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == brute(docs)
    assert len(calls) == 1
