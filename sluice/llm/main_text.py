"""HTML extraction: a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: runs of text between block-level tags, each with its chain of ancestor tags and their
class, id and role words. Comments, markup, scripts, styles and templates are not text. A chain CRF with two labels
(content, boilerplate), over ancestor-tag and text features of a block, is trained on labelled pages by gradient descent
on the exact conditional likelihood (forward-backward), and decoded by Viterbi. Blocks labelled content are joined in
page order.

``labelled_pages`` makes the training pages: a bounded number (``pages`` parameter) of whole pages in many layouts, with
the label of each block known from its making. ``train`` accepts any other labelled pages.

Extraction is a map over rows with no shuffle. Pages of any length and depth are read whole in linear time: a block
holds a link to its innermost open tag, which knows what its own tag adds to the features of all within, and open tags
are found by name. Null and empty pages, and pages without content, give empty text; unclosed, misnested and truncated
markup is read as browsers do in broad terms (after a quote that never closes, quotes no longer guard a >); repeated rows
are handled row by row; an empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.grid import sliced

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|</?([a-zA-Z][^\s/>]*)", re.S)
ATTRIBUTES = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+")
ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
#: HIDDEN says where to look closer: ANY_ATTRIBUTE's names and values tell whether the tag is hidden.
HIDDEN = re.compile(r"\bhidden\b|\bdisplay\b", re.I)
ANY_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
NOT_SHOWN = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
NAME = re.compile(r"[a-z]+")
#: Element names of the HTML standard by their role in cutting a page into blocks.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul title button".split())
RAW = frozenset("script style textarea noscript template svg iframe object canvas audio video title".split())
#: Of RAW, those whose text HTML takes to the end of the page where no closing tag follows; of the rest the tag alone is skipped.
SWALLOWS = frozenset("script style textarea template iframe title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": set(), "tbody": {"thead", "tr", "td", "th"}}
SCOPE = frozenset("article aside body div footer form header html main nav section table ul ol dl blockquote td th".split())
INLINE_ENDS_P = BLOCK - {"p"}
SPACE = re.compile(r"\s+")
STEPS = (0, 20, 60, 140, 320, 1 << 30)


class Open:
    """An open tag: its parent, what it adds to the features of all that is within (tags and names that no tag above it
    has), its innermost two block tags and how many there are."""

    __slots__ = ("added", "depth", "parent", "score", "tag", "two")

    def __init__(self, parent: Open | None, tag: str, added: tuple[str, ...], two: tuple[str, ...], depth: int) -> None:
        self.parent, self.tag, self.added, self.two, self.depth = parent, tag, added, two, depth
        self.score: tuple[float, float] | None = None


class Block:
    """Text of a leaf block, how much of it is in links, and the innermost open tag."""

    __slots__ = ("linked", "open", "text")

    def __init__(self, text: str, linked: int, innermost: Open | None) -> None:
        self.text, self.linked, self.open = text, linked, innermost

    @property
    def chain(self) -> tuple[str, ...]:
        """The open tags, outermost first."""
        out, node = [], self.open
        while node:
            out.append(node.tag)
            node = node.parent
        return tuple(reversed(out))


def is_hidden(attributes: str) -> bool:
    """Whether a tag has the attribute ``hidden`` itself or a style of ``display: none``. Words of other attributes and
    of their values (overflow:hidden, hidden-xs, aria-hidden) don't hide text."""
    for name, value in ANY_ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" and value.lower() not in ("false", "until-found") or name == "style" and NOT_SHOWN.search(value):
            return True
    return False


class Stack:
    """The open tags, with the places of each name and of the tags that bound a scope."""

    def __init__(self) -> None:
        self.tags: list[tuple[str, tuple[str, ...], bool]] = []
        self.nodes: list[Open] = []
        self.places: dict[str, list[int]] = {}
        self.scopes: list[int] = []
        self.seen: Counter[str] = Counter()
        self.hidden = 0

    def push(self, tag: str, names: tuple[str, ...], off: bool) -> None:
        above = self.nodes[-1] if self.nodes else None
        marks = (f"in:{tag}", *dict.fromkeys(f"name:{n}" for n in names))
        added = tuple(m for m in marks if not self.seen[m])
        self.seen.update(marks)
        two, depth = (above.two, above.depth) if above else ((), 0)
        if tag in BLOCK:
            two, depth = (*two, tag)[-2:], depth + 1
        self.places.setdefault(tag, []).append(len(self.tags))
        if tag in SCOPE:
            self.scopes.append(len(self.tags))
        self.tags.append((tag, marks, off))
        self.nodes.append(Open(above, tag, added, two, depth))
        self.hidden += off

    def pop(self, k: int) -> None:
        """Close all tags from place k on."""
        while len(self.tags) > k:
            tag, marks, off = self.tags.pop()
            self.nodes.pop()
            self.places[tag].pop()
            if tag in SCOPE:
                self.scopes.pop()
            self.seen.subtract(marks)
            self.hidden -= off

    def last(self, tag: str) -> int:
        """The place of the last open tag of this name, or -1."""
        held = self.places.get(tag)
        return held[-1] if held else -1

    def last_scope(self) -> int:
        return self.scopes[-1] if self.scopes else -1


def leaf_blocks(page: str) -> list[Block]:
    out: list[Block] = []
    stack = Stack()
    text: list[str] = []
    unclosed: set[str] = set()
    linked = 0
    guarded = True  # quotes guard a >

    def close_block() -> None:
        nonlocal linked
        if text:
            joined = SPACE.sub(" ", html.unescape("".join(text))).strip()
            if joined:
                out.append(Block(joined, linked, stack.nodes[-1] if stack.nodes else None))
            text.clear()
            linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        if piece and not stack.hidden:
            text.append(piece)
            linked += len(piece) if stack.last("a") >= 0 else 0

    at, end, last_end = 0, len(page), page.rfind(">")
    while at < end:
        m = TOKEN.search(page, at)
        add(page[at : m.start() if m else end])
        if not m:
            break
        at = m.end()
        if not m[1]:
            continue
        stop = ATTRIBUTES.match(page, at).end() if guarded and at <= last_end else page.find(">", at)
        if stop == -1 or not page.startswith(">", stop):
            if guarded and at <= last_end:
                guarded, at = False, m.start()
                stop = page.find(">", m.end())
            if stop == -1 or not page.startswith(">", stop):  # no tag: its sign and name are text
                add(m[0])
                at = m.end()
                continue
        attributes, at, tag = page[m.end() : stop], stop + 1, m[1].lower()
        if page[m.start() + 1] == "/":
            if tag in BLOCK:
                close_block()
            elif tag == "br":
                text.append(" ")
            place = stack.last(tag)
            if place >= 0 and (tag in SCOPE or stack.last_scope() <= place):
                stack.pop(place)
            continue
        if tag in BLOCK:
            close_block()
            ends = CLOSES.get(tag, {"p"} if tag in INLINE_ENDS_P else ())
            place = max((stack.last(t) for t in ends), default=-1)
            if place >= 0 and stack.last_scope() <= place:
                stack.pop(place)
        elif tag in ("br", "img", "input"):
            text.append(" ")
        closed = attributes.endswith("/")
        if tag in RAW:
            if tag == "svg" and closed or tag in unclosed:
                continue
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if close or tag in SWALLOWS:
                at = close.end() if close else end
            else:
                unclosed.add(tag)
            continue
        if tag in VOID or closed:
            continue
        names = tuple(NAME.findall(" ".join(v for _, v in ATTRIBUTE.findall(attributes)).lower())) if "=" in attributes else ()
        off = bool(attributes and HIDDEN.search(attributes) and is_hidden(attributes))
        stack.push(tag, names, off)
    close_block()
    return out


def bucket(value: float, steps: tuple = STEPS) -> int:
    return next(i for i, s in enumerate(steps) if value <= s)


def own_features(b: Block, i: int, n_blocks: int) -> list[str]:
    """Features of a block but for the tags and names above it."""
    n = len(b.text)
    two, depth = (b.open.two, b.open.depth) if b.open else ((), 0)
    own = [f"leaf:{two[-1] if two else '-'}", f"pair:{'/'.join(two)}", f"depth:{min(depth, 8)}", "bias", f"len:{bucket(n)}"]
    own += [f"link:{min(3, int(4 * b.linked / max(n, 1)))}", f"stop:{b.text[-1] in '.!?…\"”'}", f"commas:{min(3, b.text.count(','))}"]
    low = b.text.lower()
    own += [f"mark:{w}" for w in ("©", "cookie", "copyright", "subscribe", "all rights") if w in low]
    own.append("first" if i == 0 else "last" if i + 1 == n_blocks else "inside")
    return own


def features(blocks: list[Block]) -> list[list[str]]:
    """All features of each block, for training."""
    out = []
    for i, b in enumerate(blocks):
        own, node = own_features(b, i, len(blocks)), b.open
        while node:
            own += node.added
            node = node.parent
        out.append(own)
    return out


class Crf:
    """weight[feature, label] and move[label, label]; label 1 is content."""

    def __init__(self, index: dict[str, int], weight: np.ndarray, move: np.ndarray) -> None:
        self.index, self.weight, self.move = index, weight, move
        self.rows = {f: (float(weight[i, 0]), float(weight[i, 1])) for f, i in index.items()}

    def above(self, node: Open | None) -> tuple[float, float]:
        """Weights of the tags and names above a block, summed once for each open tag."""
        path = []
        while node and node.score is None:
            path.append(node)
            node = node.parent
        x, y = node.score if node else (0.0, 0.0)
        for node in reversed(path):
            known = [self.rows[f] for f in node.added if f in self.rows]
            x, y = x + sum(v for v, _ in known), y + sum(v for _, v in known)
            node.score = x, y
        return x, y

    def decode(self, blocks: list[Block]) -> list[int]:
        """Viterbi; a tie goes to boilerplate."""
        if not blocks:
            return []
        rows, back = self.rows, []
        (m00, m01), (m10, m11) = self.move.tolist()
        a = b = 0.0
        for i, block in enumerate(blocks):
            known = [rows[f] for f in own_features(block, i, len(blocks)) if f in rows]
            above = self.above(block.open)
            e0, e1 = above[0] + sum(x for x, _ in known), above[1] + sum(x for _, x in known)
            if i:
                to0, to1 = (0, a + m00) if a + m00 >= b + m10 else (1, b + m10), (0, a + m01) if a + m01 >= b + m11 else (1, b + m11)
                back.append((to0[0], to1[0]))
                a, b = to0[1] + e0, to1[1] + e1
            else:
                a, b = e0, e1
        label = int(b > a)
        path = [label]
        for step in reversed(back):
            label = step[label]
            path.append(label)
        return path[::-1]


def train(pages: list[tuple[list[Block], list[int]]], rounds: int = 150, l2: float = 0.02) -> Crf:
    """Full-batch gradient ascent (with per-weight step sizes) on the mean log likelihood of pages' label chains."""
    feats = [features(b) for b, _ in pages]
    index = {f: i for i, f in enumerate(sorted({f for page in feats for own in page for f in own}))}
    starts = np.cumsum([0] + [len(p) for p in feats])
    where = np.array([k for k, own in enumerate(o for p in feats for o in p) for _ in own], np.int64)
    which = np.array([index[f] for p in feats for own in p for f in own], np.int64)
    gold = np.array([y for _, labels in pages for y in labels], np.int64)
    n = len(gold)
    weight, move = np.zeros((len(index), 2)), np.zeros((2, 2))
    memory_w, memory_m = np.full_like(weight, 1e-8), np.full_like(move, 1e-8)
    order = np.argsort(-np.diff(starts), kind="stable")
    begin, count = starts[:-1][order], np.diff(starts)[order]
    steps = int(count[0]) if len(count) else 0
    active = [int((count > t).sum()) for t in range(steps)]
    truth = np.eye(2)[gold]
    inner = np.ones(n, bool)
    inner[starts[:-1][np.diff(starts) > 0]] = False
    pairs = np.zeros((2, 2))
    np.add.at(pairs, (gold[np.flatnonzero(inner) - 1], gold[inner]), 1)
    for _ in range(rounds):
        emit = np.zeros((n, 2))
        for y in (0, 1):
            emit[:, y] = np.bincount(where, weights=weight[which, y], minlength=n)
        ahead, behind = np.zeros((n, 2)), np.zeros((n, 2))
        for t in range(steps):
            at = begin[: active[t]] + t
            ahead[at] = emit[at] + (np.logaddexp.reduce(ahead[at - 1][:, :, None] + move, axis=1) if t else 0)
        for t in range(steps - 2, -1, -1):
            at = begin[: active[t + 1]] + t
            behind[at] = np.logaddexp.reduce(move + (emit[at + 1] + behind[at + 1])[:, None, :], axis=2)
        total = ahead + behind
        total -= total.max(1, keepdims=True)
        p = np.exp(total)
        p /= p.sum(1, keepdims=True)
        at = np.flatnonzero(inner)
        joint = ahead[at - 1][:, :, None] + move + (emit[at] + behind[at])[:, None, :]
        joint = np.exp(joint - joint.max((1, 2), keepdims=True))
        joint /= joint.sum((1, 2), keepdims=True)
        diff = truth - p
        grad = np.stack([np.bincount(which, weights=diff[where, y], minlength=len(index)) for y in (0, 1)], axis=1) / max(1, len(pages)) - l2 * weight
        grad_m = (pairs - joint.sum(0)) / max(1, len(pages)) - l2 * move
        memory_w += grad**2
        memory_m += grad_m**2
        weight += 0.3 * grad / np.sqrt(memory_w)
        move += 0.3 * grad_m / np.sqrt(memory_m)
    return Crf(index, weight, move)


def labelled_pages(pages: int = 300, seed: int = 11) -> list[tuple[str, list[int]]]:
    """Whole pages in many layouts and, for each leaf block in page order, whether it is main text."""
    rng = np.random.default_rng(seed)

    def pick(*options: str) -> str:
        return options[rng.integers(len(options))]

    def words(a: int, b: int) -> str:
        return " ".join("".join(pick("ba", "to", "ren", "li", "ou", "st", "er", "an", "ko", "mé", "ü", "ing") for _ in range(rng.integers(1, 5))) for _ in range(rng.integers(a, b)))

    def sentence(a: int = 3, b: int = 14) -> str:
        return words(a, b).capitalize() + pick(".", ".", ".", "!", "?")

    def prose(least: int = 1) -> str:
        return " ".join(sentence() for _ in range(rng.integers(least, 7)))

    def menu(n: int) -> tuple[str, int]:
        n = int(rng.integers(2, n))
        return "<ul>" + "".join(f'<li><a href="/{words(1, 2)}">{words(1, 3)}</a>{pick("</li>", "")}' for _ in range(n)) + "</ul>", n

    def content() -> list[tuple[str, int]]:
        parts: list[tuple[str, int]] = []
        if rng.random() < 0.8:
            parts.append((f"<h1>{words(1, 8)}</h1>", 1))
        for _ in range(rng.integers(1, 14)):
            kind = rng.random()
            if kind < 0.6:
                parts.append((f"<p>{prose()}{pick('</p>', '</p>', '</p>', '')}", 1))
            elif kind < 0.7:
                parts.append((f"<p><b>{sentence()}<br>", 1))
            elif kind < 0.78:
                parts.append((f"<{(h := pick('h2', 'h3', 'h4'))}>{words(1, 6)}</{h}>", 1))
            elif kind < 0.86:
                n = int(rng.integers(1, 5))
                parts.append(("<ul>" + "".join(f"<li>{sentence()}</li>" for _ in range(n)) + "</ul>", n))
            elif kind < 0.91:
                parts.append((f"<blockquote><p>{prose()}</p></blockquote>", 1))
            elif kind < 0.95:
                parts.append((f'<p>{sentence()} <a href="/x">{words(1, 4)}</a> {sentence()}</p>', 1))
            elif kind < 0.97:
                parts.append((f"<table><tr><td>{words(1, 3)}</td><td>{words(1, 3)}</td></tr></table>", 2))
            else:
                parts.append((f"<pre>{words(4, 20)}</pre>", 1))
        for name in ("advert", "ad", "share", "newsletter", "related", "sidebar"):
            if rng.random() < 0.06:
                tag = pick("div", "aside", "section")
                parts.insert(int(rng.integers(len(parts) + 1)), (f'<{tag} class="{name}"><p>{prose()}</p></{tag}>', -1))
        return parts

    out = []
    for _ in range(pages):
        blocks: list[tuple[str, list[int]]] = []

        def add(markup: str, n: int, label: int = 0, blocks=blocks) -> None:
            blocks.append((markup, [label] * n))

        if rng.random() < 0.5:
            tag = pick("header", 'div class="header"', 'div id="masthead"')
            add(f"<{tag}><p>{sentence()}</p></{tag.split()[0]}>", 1)
        if rng.random() < 0.85:
            tag, (m, n) = pick("nav", "nav", 'div class="menu"', 'div role="navigation"', 'div id="nav"'), menu(9)
            add(f"<{tag}>{m}</{tag.split()[0]}>", n)
        for name in ("ad", "advert", "banner", "notice", "cookie", "promo", "sponsored", "alert", "breadcrumb"):
            if rng.random() < 0.25:
                tag = pick("div", "div", "section", "p", "aside")
                add(f'<{tag} {pick("class", "class", "id")}="{name}{pick("", "-box", " top")}">{prose()}</{tag}>', 1)
        wrap = pick("article", "article", "article", "main", 'div class="content"', 'div id="main"', 'div class="post"', 'div class="entry body"', 'div class="article"')
        sidebar = rng.random() < 0.3

        def side() -> None:
            tag = pick("aside", 'div class="sidebar"', 'div id="side"', "aside")
            add(f"<{tag}><h3>{words(1, 4)}</h3><p>{prose()}</p></{tag.split()[0]}>", 2)

        if sidebar and rng.random() < 0.5:
            side()
        add(f"<{wrap}>", 0)
        for markup, n in content():
            add(markup, abs(n), int(n > 0))
        add(f"</{wrap.split()[0]}>", 0)
        if sidebar:
            side()
        if rng.random() < 0.3:
            n = int(rng.integers(1, 5))
            tag = pick('section class="comments"', 'div id="comments"', 'div class="comment-list"', 'div class="responses"')
            add(f"<{tag}>" + "".join(f"<{pick('p', 'div')}>{prose()}" for _ in range(n)) + f"</{tag.split()[0]}>", n)
        if rng.random() < 0.25:
            add(f"<form><label>{words(1, 3)}</label> <input name=q></form>", 1)
        if rng.random() < 0.85:
            tag = pick("footer", "footer", 'div class="footer"', 'div id="footer"')
            add(f"<{tag}>&copy; {words(1, 3)} &middot; {prose()}</{tag.split()[0]}>", 1)
        head = f"<!DOCTYPE html><html><head><title>{words(1, 6)}</title><style>p{{}}</style><script>var t='<p>';</script></head><body>"
        out.append((head + "".join(m for m, _ in blocks) + "</body></html>", [y for _, labels in blocks for y in labels]))
    return out


@lru_cache(maxsize=2)
def default_model(pages: int = 300) -> Crf:
    made = [(leaf_blocks(page), labels) for page, labels in labelled_pages(pages)]
    return train([(b, y) for b, y in made if len(b) == len(y)])


def extract(pages: DataFrame, model: Crf | None = None, blocks: bool = True) -> DataFrame:
    """Per row of pages: page_id, url, text and, with blocks, each leaf block's text and whether it is content."""
    held = pages.sparkSession.sparkContext.broadcast(model or default_model())
    kind = pa.list_(pa.struct([("text", pa.string()), ("content", pa.bool_())]))

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = held.value
        for batch in sliced(batches, "html"):
            texts, parts = [], []
            for page in batch.column("html"):
                found = leaf_blocks(page.as_py() or "")
                labels = crf.decode(found)
                texts.append("\n".join(b.text for b, y in zip(found, labels, strict=True) if y))
                if blocks:
                    parts.append([{"text": b.text, "content": bool(y)} for b, y in zip(found, labels, strict=True)])
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), *([pa.array(parts, kind)] if blocks else [])]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "blocks"][: len(columns)])

    schema = "page_id long, url string, text string" + (", blocks array<struct<text:string,content:boolean>>" if blocks else "")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(extracted, schema)


def main_text(pages: DataFrame, model: Crf | None = None) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row."""
    return extract(pages, model, blocks=False).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
