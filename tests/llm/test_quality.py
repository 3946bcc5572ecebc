import zlib

import numpy as np

from sluice.llm import quality as Q

SCHEMA = "doc_id long, text string, score string"
WORDS = "the of and river stone mountain walks under evening light with careful steps".split()


def data(n=160):
    rng = np.random.default_rng(5)
    docs, labels = [], []
    for i in range(n):
        good = i % 3 != 0
        words = list(rng.choice(WORDS, 60))
        docs.append((i, " ".join(words) if good else rng.choice(["!! ", "$$$ ", "&&& "]).join(w.upper() for w in words), "clash"))
        labels.append((i, int(good), 0))
    return docs, labels


def test_held_out_accuracy_and_edge_cases(spark):
    docs, labels = data()
    more = [(500, None, ""), (501, "", ""), (502, "river " * 30000, ""), (0, docs[0][1], "again"), (None, "stone", "")]
    got = Q.classify(spark.createDataFrame(docs + more, SCHEMA), spark.createDataFrame([*labels, (3, None, 0), (4, 7, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(docs) + len(more) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    want = {i: q for i, q, _ in labels}
    held = [r for r in got if r.held_out and r.doc_id in want]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert np.mean([r.predicted == want[r.doc_id] for r in held]) >= 0.95


def test_without_labels_or_rows(spark):
    docs, labels = data(6)
    d, l = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert {r.score for r in Q.classify(d, l.limit(0)).collect()} == {0.5}
    assert Q.classify(d.limit(0), l).count() == 0


def mix(x):
    m = (1 << 64) - 1
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & m
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & m
    return x ^ x >> 31


def plain_features(text: bytes) -> list[int]:
    """Words, pairs and n-grams of one text by plain loops (a word's hash by the library, of that word alone)."""
    words = [int(Q.Grid([w], Q.NOT_SPACE, None).hashes[0]) for w in text.split()]
    out = [h >> 64 - Q.BITS for h in words]
    for before, h in zip([0, *words], words, strict=False):
        out.append((0 if before == h else mix((before * 3 + h) & (1 << 64) - 1)) >> 64 - Q.BITS)
    closed = text + b"\n"
    for n in Q.ORDERS:
        for i in range(len(closed) - n + 1):
            h = n
            for c in closed[i : i + n]:
                h = (h * 0x01000193 + c) & 0xFFFFFFFF
            h ^= h >> 15
            h = h * 0x2C1B3C6D & 0xFFFFFFFF
            out.append(h >> 32 - Q.BITS)
    return out


TEXTS = [b"a bc bc", b"", b"xyz", b"x", b"zz zz zz top", "größe  ça\n va ".encode(), b"a", b"bc " * 50]


def test_scores_are_a_plain_loops_whatever_stands_beside():
    model = Q.Classifier(np.random.default_rng(0).normal(size=1 << Q.BITS), 0.25)
    plain = []
    for t in TEXTS:
        own = plain_features(t)
        plain.append(sum(int(model.weight[b]) for b in own) / (max(len(own), 1) * float(1 << Q.POINT)) + 0.25)
    for texts, want in ((TEXTS, plain), (TEXTS[::-1], plain[::-1]), *(([t], [w]) for t, w in zip(TEXTS, plain, strict=True))):
        assert model.logits(Q.Grid(texts, Q.NOT_SPACE, None)).tolist() == want


def test_trainer_is_a_plain_loops():
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(WORDS, 5)).encode() for _ in range(6)] + [b"!!", b"$ $ $"]
    labels = [1, 1, 1, 0, 1, 0, 0, 0]
    got = Q.train(texts, labels, dim=3, epochs=2, rate=0.5, seed=4)
    rng = np.random.default_rng(4)
    table = rng.uniform(-1 / 3, 1 / 3, (1 << Q.BITS, 3)).astype(np.float32).astype(float)
    out, bias, share = [[0.0] * 3, [0.0] * 3], [0.0, 0.0], [labels.count(v) / len(labels) for v in (0, 1)]
    for epoch in range(2):
        step = 0.5 * (1 - epoch / 2)
        for i in rng.permutation(len(texts)):
            own = plain_features(texts[i])
            mean = [sum(table[b][k] for b in own) / len(own) for k in range(3)]
            z = [sum(out[y][k] * mean[k] for k in range(3)) + bias[y] for y in (0, 1)]
            p1 = 1 / (1 + np.exp(z[0] - z[1]))
            p = [(q - (y == labels[i])) * 0.5 / share[labels[i]] for y, q in enumerate((1 - p1, p1))]
            pull = [p[0] * out[0][k] + p[1] * out[1][k] for k in range(3)]
            for y in (0, 1):
                bias[y] -= 0.05 * step * p[y]
                for k in range(3):
                    out[y][k] -= step * p[y] * mean[k]
            for b in own:
                for k in range(3):
                    table[b][k] -= step * pull[k] * 10 / len(own)
    want = [sum(table[b][k] * (out[1][k] - out[0][k]) for k in range(3)) for b in plain_features(b" ".join(texts))]
    assert np.allclose(got.weight[plain_features(b" ".join(texts))] / (1 << Q.POINT), want, atol=1e-3) and np.isclose(got.bias, bias[1] - bias[0], atol=1e-4)


def test_equal_texts_score_equal_over_any_partitions(spark):
    docs, labels = data(60)
    more = [(1000 + i, docs[i % 60][1], "") for i in range(300)]
    d, l = spark.createDataFrame(docs + more, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = Q.fit(d.limit(60), l)
    one, many = ({r.doc_id: r.score for r in Q.score(x, model).collect()} for x in (d.coalesce(1), d.repartition(7)))
    assert one == many and all(one[1000 + i] == one[i % 60] for i in range(300))


def test_training_holds_one_row_of_a_repeated_id_and_at_most_per_class(spark, monkeypatch):
    docs, labels = data(400)
    seen = []
    monkeypatch.setattr(Q, "train", lambda texts, labels: seen.append((texts, labels)) or Q.Classifier(np.zeros(1 << Q.BITS), 0.0))
    repeated = [(i, "another text", "") for i in range(400) for _ in range(5)]
    Q.fit(spark.createDataFrame(docs + repeated, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), per_class=10)
    ((texts, got),) = seen
    assert sorted(got) == [0] * 10 + [1] * 10 and len(texts) == 20
