import itertools

import numpy as np

from sluice.llm import main_text as M

PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav><!-- ad <p>no</p> --><div class="ad">Buy this now.</div>
<article><h1>Big  title &eacute;</h1><p><b>Lead text.<br><p>First   para,\n with <i>some</i> <a href="/x">link</a> text.</p><p>A &lt;tag&gt; &#8364; &nbsp; end.
<aside class="related"><p>Other stories to read.</p></aside><p>Last one here.</p></article>
<div class="comments"><p>I disagree with this.</p></div><form><label>Search</label><input name=q></form><footer>&copy; site &middot; All rights reserved.</footer>"""
WANT = "Big title é\nLead text.\nFirst para, with some link text.\nA <tag> € end.\nLast one here."


def test_blocks_of_broken_markup():
    blocks = M.leaf_blocks(PAGE)
    assert [b.text for b in blocks][:3] == ["One", "Two", "Buy this now."]
    first = next(b for b in blocks if b.text.startswith("First"))
    assert first.chain[-2:] == ("article", "p") and first.linked == 4
    assert [b.text for b in M.leaf_blocks("<p>a<p>b<div>c</p>d</div>e < f <b")] == ["a", "b", "c", "d", "e < f <b"]
    assert [b.text for b in M.leaf_blocks('<div hidden><p>x</p></div><p style="display: none">y</p><p>z<script>if (a<b) "</div>"')] == ["z"]


def test_held_out_pages_and_the_query(spark):
    model = M.default_model()
    right = total = 0
    for page, labels in M.labelled_pages(120, seed=5):
        got = model.decode(M.leaf_blocks(page))
        right, total = right + sum(map(int.__eq__, got, labels)), total + len(labels)
    assert right / total >= 0.98
    rows = [(1, "u", PAGE, "clash"), (1, "u", PAGE, "clash"), (2, None, None, ""), (3, "v", "", ""), (None, "w", "<p>", ""), (4, "x", "<article>" + "<p>Long sentence here.</p>" * 5000, "")]
    got = M.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    by_id = {r.page_id: r for r in got}
    assert len(got) == len(rows) and by_id[1].text == WANT and by_id[1].n_chars == len(WANT)
    assert [(by_id[i].text, by_id[i].n_chars) for i in (2, 3, None)] == [("", 0)] * 3 and by_id[4].text.count("\n") == 4999
    assert M.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_viterbi_matches_every_path():
    model = M.default_model()
    for page, _ in M.labelled_pages(40, seed=8):
        blocks = M.leaf_blocks(page)[:9]
        emit = [np.sum([model.weight[model.index[f]] for f in own if f in model.index], axis=0) for own in M.features(blocks)]

        def value(path, emit=emit):
            return sum(e[y] for e, y in zip(emit, path, strict=True)) + sum(model.move[a, b] for a, b in itertools.pairwise(path))

        assert np.isclose(value(model.decode(blocks)), max(map(value, itertools.product((0, 1), repeat=len(blocks)))))
