import hashlib
import re

from pyspark.sql import functions as F

from sluice.llm import contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string"


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, n=10):
    out = []
    for doc_id, text in docs:
        w, hit, who = words(text), set(), set()
        for item_id, item in items:
            v = words(item)
            size = min(n, len(v))
            for window in {tuple(v[i : i + size]) for i in range(len(v) - size + 1)} if size else ():
                for i in range(len(w) - size + 1):
                    if tuple(w[i : i + size]) == window:
                        hit |= set(range(i, i + size))
                        who.add(item_id)
        ids = ",".join(sorted(map(str, who)))
        out.append((doc_id, len(w), len(hit), len(who), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


LONG = " ".join(f"w{i}" for i in range(30))
ITEMS = [(1, LONG), (2, "Éa short-item"), (3, None), (4, ""), (12, LONG.upper()), (5, "!!"), (6, "solo")]
DOCS = [
    (1, f"before {LONG} after"), (2, None), (3, ""), (4, "x " + LONG.replace(" ", ", ")[:60]), (5, "Éa SHORT item; éa short item"),
    (6, "solo"), (6, "solo"), (7, "Solo " * 5000), (8, "nothing here"), (None, LONG), (9, " ".join(f"w{i}" for i in range(9))), (10, LONG[:40] + " cut " + LONG),
]


def frames(spark, docs=DOCS, items=ITEMS):
    d = spark.createDataFrame([(i, t, None, None, None, "clash") for i, t in docs], SCHEMA)
    return d, spark.createDataFrame(items, "item_id long, text string")


def test_report_matches_brute_force_in_one_block_and_in_many(spark):
    d, b = frames(spark)
    assert sorted((tuple(r) for r in contamination.report(d, b).collect()), key=str) == brute(DOCS, ITEMS)
    many = contamination.find_contamination(d, b, block_bytes=200).select("doc_id", "n_words", F.size("items").alias("n")).collect()
    assert sorted((tuple(r) for r in many), key=str) == sorted(((r[0], r[1], r[3]) for r in brute(DOCS, ITEMS)), key=str)


def test_empty_tables(spark):
    d, b = frames(spark)
    assert contamination.report(d.limit(0), b).count() == 0
    assert contamination.report(d, b.limit(0)).where("contaminated").count() == 0


def test_decisions_remove_documents_or_spans(spark):
    d, b = frames(spark)
    kept = contamination.decontaminate(d, b).collect()
    assert sorted(r.doc_id for r in kept) == [2, 3, 8, 9] and set(contamination.decontaminate(d, b).columns) == set(d.columns)
    cut = {r.doc_id: r.text for r in contamination.decontaminate(d, b, mode="spans").where("doc_id IN (1, 2, 8)").collect()}
    assert cut == {1: "before  after", 2: None, 8: "nothing here"}
