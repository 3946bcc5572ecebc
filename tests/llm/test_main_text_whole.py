"""Text that must not be lost before or by the labelling of blocks."""

import html
import random
import re
import time

import pytest

from sluice.llm import main_text as M


def texts(page):
    return [b.text for b in M.leaf_blocks(page)]


@pytest.mark.parametrize("attributes", ['class="overflow-hidden"', 'style="overflow:hidden"', 'class="hidden-xs"', 'aria-hidden="true"', "data-hidden", 'title="hidden"', 'style="--display:none"', 'data-style="display:none"', 'hidden="false"', 'class="a hidden b"'])
def test_words_of_other_attributes_do_not_hide(attributes):
    assert texts(f"<article {attributes}><p>kept</p></article>") == ["kept"]


@pytest.mark.parametrize("attributes", ["hidden", 'HIDDEN=""', "class=x hidden", "hidden=hidden", 'style="color:red; display : none"', "style=display:none"])
def test_hidden_attribute_and_style_hide(attributes):
    assert texts(f"<div {attributes}><p>x</p></div><p>z") == ["z"]


def test_an_article_in_a_wrapper_with_overflow_hidden():
    page = M.labelled_pages(1, seed=3)[0][0].replace("<body>", '<body style="overflow:hidden">')
    assert texts(page) == texts(M.labelled_pages(1, seed=3)[0][0]) != []


def test_self_closing_and_unclosed_raw_tags_drop_nothing_else():
    assert texts('<p>a <svg class="i"/> b</p><p>c<svg><path d="x"/>no</svg> d</p><p>e</p>') == ["a b", "c d", "e"]
    assert texts('<p>a <svg class="i" /> b</p><p>c</p>') == ["a b", "c"]
    for tag in ("svg", "object", "canvas", "audio", "video", "noscript"):
        assert texts(f"<p>a</p><{tag}><p>b</p><{tag}><p>c</p>") == ["a", "b", "c"]
    for tag in ("script", "style", "textarea", "iframe", "template"):  # HTML takes the rest of the page
        assert texts(f"<p>a</p><{tag}>b") == ["a"] == texts(f"<p>a</p><{tag}/>b")


def test_formulas_are_text():
    assert texts("<p>if <math><mi>x</mi><mo>=</mo><mn>2</mn></math> then</p><p>a <math/> b</p><p>c</p>") == ["if x=2 then", "a b", "c"]


@pytest.mark.parametrize("mark", ["©", "Cookie", "copyright", "Subscribe", "All rights"])
def test_marks_are_seen_anywhere_in_a_block(mark):
    (own,) = M.features(M.leaf_blocks(f"<div>{'word ' * 100}{mark} end</div>"))
    assert f"mark:{mark.lower()}" in own


def plain_blocks(page):
    """The block cutter by plain scans of a list of open tags: (text, characters in links, tags, class words)."""
    tag_at = re.compile(r"</?([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>")
    out, stack, text, linked = [], [], [], 0

    def close():
        nonlocal linked
        joined = " ".join(html.unescape("".join(text)).split())
        if joined:
            out.append((joined, linked, tuple(t for t, _, _ in stack), frozenset(n for _, names, _ in stack for n in names)))
        text.clear()
        linked = 0

    def add(c):
        nonlocal linked
        if not any(off for _, _, off in stack):
            text.append(c)
            linked += any(t == "a" for t, _, _ in stack)

    i = 0
    while i < len(page):
        if page.startswith("<!--", i):
            i = page.find("-->", i + 4) + 3 or len(page)
            continue
        m = tag_at.match(page, i)
        if not m:
            add(page[i])
            i += 1
            continue
        tag, i = m[1].lower(), m.end()
        if m[0][1] == "/":
            if tag in M.BLOCK:
                close()
            elif tag == "br":
                text.append(" ")
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
                if stack[k][0] in M.SCOPE and tag not in M.SCOPE:
                    break
            continue
        if tag in M.BLOCK:
            close()
            ends = M.CLOSES.get(tag, {"p"} if tag != "p" else ())
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ends:
                    del stack[k:]
                    break
                if stack[k][0] in M.SCOPE:
                    break
        elif tag in ("br", "img", "input"):
            text.append(" ")
        if tag == "script":
            end = re.compile("</script>").search(page, i)
            i = end.end() if end else len(page)
        elif tag not in M.VOID and not m[0].endswith("/>"):
            stack.append((tag, re.findall("[a-z]+", " ".join(re.findall('class="([^"]*)"', m[2]))), "hidden" in m[2].split()))
    close()
    return out


def test_blocks_are_a_plain_scans():
    rng = random.Random(12)
    tags = "p div li ul td tr table b a span article section h1 dt dd dl option br img blockquote i".split()
    for _ in range(1500):
        page = ""
        for _ in range(rng.randint(0, 40)):
            kind, tag = rng.random(), rng.choice(tags)
            attributes = rng.choice(["", "", "", ' class="x y"', ' class="ad"', " hidden", ' title="a>b"'])
            page += f"<{tag}{attributes}>" if kind < 0.4 else f"</{tag}>" if kind < 0.65 else rng.choice(["word ", "two  words", "&amp;", "\n", "< ", "<!-- <p> -->", "<script><p></script>", "<br/>"]) if kind < 0.98 else "<b/>"
        got = [(b.text, b.linked, b.chain, frozenset(f[5:] for own in [M.features([b])[0]] for f in own if f.startswith("name:"))) for b in M.leaf_blocks(page)]
        assert got == plain_blocks(page), page


def test_features_are_those_of_all_open_tags():
    for page, _ in M.labelled_pages(10, seed=4):
        blocks = M.leaf_blocks(page)
        for b, own in zip(blocks, M.features(blocks), strict=True):
            inner = [t for t in b.chain if t in M.BLOCK]
            assert {f for f in own if f.startswith("in:")} == {f"in:{t}" for t in b.chain} and len(own) == len(set(own))
            assert f"pair:{'/'.join(inner[-2:])}" in own and f"depth:{min(len(inner), 8)}" in own


def test_bad_markup_takes_linear_time():
    model = M.default_model()
    n = 150_000
    pages = ['<a "' * n, '<a "' * n + ">", "<a '\"" * n + ">", "<div>x" * n, "<b>" * n + "<h1>x</h1>" * n, "<b>" * n + "</i>" * n, "<x>" + "<div>" * n + "</x>" * n, '<div class="' + "a b " * n + '">x' * 3, "<" * n, "<!" * n, "&" * n,
             "<svg>" * n, "<!--" * n, "<p class='c%d'>x" * n, "".join(f'<div class="n{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}">x' for i in range(n)), "<li>a" * n, "<table><td>" * n]
    for page in pages:
        began = time.perf_counter()
        blocks = M.leaf_blocks(page)
        assert len(model.decode(blocks)) == len(blocks)
        assert time.perf_counter() - began < 15, page[:30]


def test_a_quote_that_never_closes_loses_no_text():
    assert texts('<p title="x>one</p><p>two</p>') == ["one", "two"]
    assert texts("<p>a <b title='>c</b> d</p>") == ["a c d"]
