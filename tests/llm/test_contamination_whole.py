"""Items without id and items larger than a block."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from sluice.llm import contamination, queries

A, B = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
DOCS = [(1, f"x {A} y"), (2, f"x {B} y"), (3, f"{A} {B}"), (4, "nothing here"), (5, None)]


def frames(spark, items):
    return spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def test_items_without_id_are_scanned_as_in_the_sql(spark):
    d, b = frames(spark, [(None, A), (7, B), (None, B + " more"), (None, None)])
    con = duckdb.connect()
    con.register("documents", d.toArrow())
    con.register("benchmark", b.toArrow())
    want = con.execute(queries.oracle_sql()["op9_benchmark_decontamination"])
    names = [c[0] for c in want.description]
    got = contamination.report(d, b).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
    assert sorted(r.doc_id for r in contamination.decontaminate(d, b).collect()) == [4, 5]
    assert contamination.decontaminate(d, b, mode="spans").where("doc_id = 1").first().text == "x  y"


@pytest.mark.parametrize("block_bytes", [1, 100, len(A), 200])
def test_items_of_a_block_or_more_are_blocks_of_their_own(spark, block_bytes):
    items = [(1, A), (2, B), (2, B), (3, "nothing"), (None, "here"), (4, "")]
    d, b = frames(spark, items)
    blocks = list(contamination.item_blocks(b, block_bytes))
    assert len(blocks) <= 5 and {i for block in blocks for i in block} == {(i, t.encode()) for i, t in items if t}
    got = contamination.find_contamination(d, b, block_bytes=block_bytes).select("doc_id", F.to_json("items").alias("i")).collect()
    assert {r.doc_id: r.i for r in got} == {1: "[1]", 2: "[2]", 3: "[1,2]", 4: "[3,null]", 5: "[]"}


def test_words_are_counted_whatever_the_blocks(spark):
    d, b = frames(spark, [(1, A)])
    for items, block_bytes in ((b, 1), (b, 1 << 20), (b.limit(0), 1)):
        assert sum(r.n_words for r in contamination.find_contamination(d, items, block_bytes=block_bytes).collect()) == 42 + 42 + 80 + 2


def test_many_blocks_are_held_one_at_a_time(spark, monkeypatch):
    """Broadcasts that are alive at once, over a benchmark of many blocks, and columns named like the results."""
    from sluice.llm import contamination as C

    rng = random.Random(7)
    items = [(i, " ".join(f"w{rng.randrange(3000)}" for _ in range(12))) for i in range(60)]
    docs = [(d, f"start {items[d % 60][1]} end" if d % 3 else "clean text of no item here", 5, "x", 7) for d in range(90)]
    alive, most, real = set(), [0], spark.sparkContext.broadcast

    def counted(value):
        held = real(value)
        alive.add(id(held))
        most[0] = max(most[0], len(alive))
        destroy = held.destroy
        monkeypatch.setattr(held, "destroy", lambda *a: (alive.discard(id(held)), destroy(*a)), raising=False)
        return held

    monkeypatch.setattr(spark.sparkContext, "broadcast", counted)
    d = spark.createDataFrame(docs, "doc_id long, text string, n_words int, spans string, items int")
    b = spark.createDataFrame(items, "item_id long, text string")
    kept = C.decontaminate(d, b, n=10, block_bytes=600).collect()
    assert most[0] == 1 and sorted(r.doc_id for r in kept) == [x[0] for x in docs if x[0] % 3 == 0]
    assert kept[0].asDict().keys() == {"doc_id", "text", "n_words", "spans", "items"} and {(r.n_words, r.spans, r.items) for r in kept} == {(5, "x", 7)}
