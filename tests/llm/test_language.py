import itertools
import zlib

import numpy as np

from sluice.llm import language as L

EN = "the house of the old man was on the hill and it is that which they had seen before with this".split()
FR = "la maison de la vieille dame est sur une colline et elle qui avait vu les autres avec ceux dans".split()
RU = "дом на холме был старый и он видел что они были здесь вместе с этим человеком когда".split()


def rows(n=240):
    rng = np.random.default_rng(1)
    return [(i, " ".join(rng.choice(w, 40)).capitalize(), lang, "s", 1) for i, (w, lang) in zip(range(n), itertools.cycle([(EN, "en"), (FR, "fr"), (RU, "ru")]), strict=False)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_held_out_rows_are_predicted_from_the_others(spark):
    data = rows() + [(900, None, "en", "s", 0), (901, "", "fr", "s", 0), (902, "12 + 34 !!", None, "s", 9), (903, "ДОМ НА холме", None, "s", 9), (903, "ДОМ НА холме", None, "s", 9), (None, "the house", None, None, None), (904, "一二三四", None, "s", 4), (905, "la maison " * 20000, None, "s", 1)]
    got = L.identify(spark.createDataFrame(data, SCHEMA)).collect()
    assert len(got) == len(data)
    by_id = {r.doc_id: r for r in got}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert all(by_id[i].lang_pred == lang for i, _, lang, _, _ in rows())
    assert [by_id[i].lang_pred for i in (900, 901, 902, 903, 905, None)] == ["und", "und", "und", "ru", "fr", "en"]
    assert by_id[900].score == 0 and by_id[904].lang_pred in ("en", "fr", "ru") and all(0 <= r.score <= 1 for r in got)


def test_spans_of_mixed_text(spark):
    model = L.Model([r[1].encode() for r in rows()], [r[2] for r in rows()])
    a, b = "É " + " ".join(FR), " ".join(EN)
    text = f"{a} {b}"
    got = L.label_languages(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert [(text[s.start : s.end], s.lang) for s in got._spans] == [(a, "fr"), (b, "en")]


def test_a_quoted_passage_does_not_change_the_language(spark):
    model = L.Model([r[1].encode() for r in rows()], [r[2] for r in rows()])
    en, fr = " ".join(EN), " ".join(FR)
    texts = [f"{en} {fr} {fr} {fr} {en}", f"the {fr} {fr}"]
    got = L.label_languages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [r._lang for r in got] == ["en", "fr"] and got[0]._score < 0.5


def test_viterbi_matches_every_path():
    rng = np.random.default_rng(3)
    first = np.array([0, 4, 4, 5, 11])
    scores = rng.normal(size=(11, 3))
    labels = L.viterbi(scores, first, 1.5)
    for a, b in itertools.pairwise(first):
        def value(path, a=a):
            return sum(scores[a + i, x] for i, x in enumerate(path)) - 1.5 * sum(x != y for x, y in itertools.pairwise(path))

        best = max(itertools.product(range(3), repeat=int(b - a)), key=value)
        assert np.isclose(value(best), value(labels[a:b]))


def test_without_training_rows_or_rows(spark):
    df = spark.createDataFrame([(1, "the house", None, None, None)], SCHEMA)
    assert [(r.lang_pred, r.score) for r in L.identify(df).collect()] == [("und", 0.0)]
    assert L.identify(df.limit(0)).count() == 0


def plain_scores(model, text):
    """Each word's scores by loops over its own n-grams."""
    out = []
    for w in "".join(c if c.isascii() and c.isalpha() or ord(c) > 127 else " " for c in text).split():
        folded = b" " + "".join(c.lower() if ord(c) < 256 and c not in "ßÿ×" else c for c in w).encode() + b" "
        total = np.zeros(len(model.languages), np.int64)
        for n in L.ORDERS:
            for i in range(len(folded) - n + 1):
                h = 0
                for c in folded[i : i + n]:
                    h = (h * 0x01000193 + c) & 0xFFFFFFFF
                h ^= h >> 15
                total += model.log[n][(h * 0x2C1B3C6D & 0xFFFFFFFF) >> 32 - L.BITS]
        point = ord(w[0])
        script = L.NAMES.index([name for first, name in L.SCRIPTS if first <= point][-1])
        fits = model.allowed[script]
        scores = total / float(len(L.ORDERS) << L.POINT)
        out.append(scores + np.where(fits, 0, -50.0) if fits.any() else scores * 0)
    return np.array(out)


MIXED = ["A la maison, the house I saw", "É a ÉÀ x дом", "一 house", "", "z", "la" * 40 + " I", "the house-of дом! la 12"]


def test_word_scores_are_a_plain_loops_whatever_stands_beside():
    model = L.Model([r[1].encode() for r in rows()], [r[2] for r in rows()])
    want = [plain_scores(model, t) for t in MIXED]
    for order in (range(len(MIXED)), range(len(MIXED) - 1, -1, -1), *([i] for i in range(len(MIXED)))):
        grid = L.Grid([MIXED[i].encode() for i in order], L.LETTER, None)
        got = model.word_scores(grid)
        assert np.array_equal(got, np.concatenate([want[i].reshape(-1, 3) for i in order]))


def test_a_document_is_labelled_by_the_plain_rule():
    model = L.Model([r[1].encode() for r in rows()], [r[2] for r in rows()])
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice(EN + FR + RU, rng.integers(1, 30))) for _ in range(200)]
    grid = L.Grid([t.encode() for t in texts], L.LETTER, None)
    got = list(L.predictions(model, texts, grid, L.SWITCH))
    for t, (lang, score, spans) in zip(texts, got, strict=True):
        scores = plain_scores(model, t)
        labels = L.viterbi(scores, np.array([0, len(scores)]), L.SWITCH).tolist()
        size = {}
        for w, y in zip(t.split(), labels, strict=True):
            size[y] = size.get(y, 0) + len(w.encode())
        best = labels[0] if size[labels[0]] >= L.OPENING * sum(size.values()) else max(size, key=lambda y: (size[y], -y))
        assert lang == model.languages[best] and np.isclose(score, size[best] / sum(size.values()))
        assert [s["lang"] for s in spans] == [model.languages[y] for y, _ in itertools.groupby(labels)]


def test_long_texts_clashing_columns_and_repeated_ids(spark):
    data = [(i, t, lang, s, n) for i, t, lang, s, n in rows()] + [(7, "another text of it", "en", "s", 1)] * 50
    df = spark.createDataFrame(data, SCHEMA)
    model = L.fit(df, per_language=20)
    assert len(model.languages) == 3
    clash = spark.createDataFrame([(1, "the house " * 300_000, 5, "x", 2)], "doc_id long, text string, _lang int, _score string, _spans int")
    got = L.label_languages(clash, model).select("doc_id", "_lang", "_score").first()
    assert (got._lang, got._score) == ("en", 1.0)
    kept = L.label_languages(clash, model, names=("a", "b", "c")).first()
    assert (kept._lang, kept._score, kept._spans, kept.a) == (5, "x", 2, "en")
