"""Main text of web pages by a minimum cut between content and boilerplate.

A page is cut into blocks of text at the tags that break lines. A block is a node: what it costs to call it content or
boilerplate are the capacities of its edges to the two terminals; smoothness edges join neighbours in the page and
neighbours under one parent, the stronger the nearer their common ancestor is. The least cut of this graph, found by
maximal flow, is the labelling; its content blocks, in page order, are the text.

Costs come from two logistic classifiers. That of the text (TEXT) looks at words, links, punctuation, signs of menus, words
shared with the rest of the page and with its title, repetition over pages, place in the page, the share of the page's words
that the block's parent holds, and neighbours. That of the marks (MARKS) looks at the elements around a block: whether it
lies in article or main, outside of one that the page has, in nav, footer and the like, in a box whose name tells what text
can't tell (reader comments, adverts, notices), and at the names of its nearest named elements, hashed. What an element
says to a block's disfavour counts by the share of the page's words that it does not hold, so that a name around the whole text
says nothing.

Both are fitted to all pages (of equal html once) by ridge regression around documented weights, which also stand alone where
there are no labels of both kinds; the ridge is that of EVIDENCE pages and grows with more. The text learns from weak labels and
sees no marks: blocks in article or main are content; blocks in nav or footer, and ones that REPEATED pages of the whole table or
more hold, are boilerplate. The marks learn from what the cut makes of the text alone, but for the boxes of telling names.

A page is parsed once. What blocks say without the other pages (FACTS, marks, keys) is written with the text; repetition is
counted over all keys, Newton's sums are added up over all blocks in a few rounds, and the last step labels what was written.

Names on html, body, main and headings say nothing; an inner article or main ends what the elements around it say.

Defined results: null or empty html, and html without text, give an empty text of 0 characters; markup that is not
closed, not known or of any depth is read as far as it goes, in time and memory that grow with its length; null and repeated ids are
kept, each row by itself; ids that are no integers are refused; an empty table gives an empty table; other columns don't matter.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Callable, Iterator
from hashlib import blake2b
from html.parser import HTMLParser
from itertools import chain
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import spread_join
from .store import Scratch, fresh, long_id

#: As many pages are weighed as the ridge is for; of more, each counts for less.
EVIDENCE = 500
REPEATED = 3
#: Up to this many keys of repeated blocks go to tasks as one sorted array; more are joined.
HELD = 1 << 21
#: How many blocks a task looks at together.
BLOCKS = 1 << 14
#: What a block says without the other pages: counts of words, of those in links, of those that end in punctuation, of letters
#: and of different words, and of these the ones elsewhere in the page and in its title; whether it ends a sentence or has signs
#: of menus, words under its parent, heading, item; its labels as bits (in article or main and no boilerplate, labels
#: boilerplate, in article or main); how far its common ancestor with the block before lies above both, and how many blocks
#: ago the last one under its parent was (0: none).
FACTS = ("words", "linked", "punctuation", "letters", "ends", "signs", "distinct", "shared", "title", "own", "heading", "item", "told", "apart", "sibling")
#: What the text looks at and the weights that training starts from.
TEXT = {
    "constant": -3.5, "words": 0.7, "links": -5.0, "punctuation": 2.0, "word_length": 0.0, "ends": 1.0, "signs": -2.5, "shared": 1.0, "title": 2.0,
    "repeated": -1.5, "edge": -0.5, "parent": 3.0, "neighbours": 0.2, "heading": 0.5, "item": -0.5,
}
#: How many numbers the names of elements are hashed to, and the weights of marks that training starts from.
NAMES = 64
MARKS = {"inside": 2.0, "outside": -2.0, "boilerplate": -3.0, "telling": -5.0} | {f"name_{k}": 0.0 for k in range(NAMES)}
#: How strongly training holds to the weights that it starts from.
RIDGE = 1.0
#: The parts of text and marks in a score lie within this.
CLIP = 8.0
#: Costs of different labels for neighbours in the page and for neighbours under one parent, where both lie right under
#: their common ancestor; with each level more between them the cost is divided by DEEPER.
NEAR, SIBLING, DEEPER = 0.8, 0.6, 1.25
#: How many of the named elements around a block are looked at, the nearest first.
AROUND = 3

HIDDEN = frozenset("script style noscript template head title svg math canvas iframe object audio video select option textarea button".split())
BREAKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BAD_TAGS = frozenset("nav footer header aside form menu dialog".split())
LABEL_TAGS = frozenset("nav footer".split())
GOOD_TAGS = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ITEMS = frozenset("li td th dt dd option".split())
#: What may stand in a head; anything else ends one that is open.
IN_HEAD = frozenset("html head base basefont bgsound link meta noframes noscript script style template title".split())
UNNAMED = frozenset("html body main h1 h2 h3 h4 h5 h6".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Names of boxes whose text may read like an article's.
TELLING = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|cookies?|consent|notice|comments?|disqus|replies|reply|related|recommend\w*|newsletter|side-?bar)(?:$|[\s_-])"
)


class Element(NamedTuple):
    """An open element: its name and number, the nearest article or main and boilerplate element around it (0: none), the
    number of the nearest named one, whether it labels its blocks as boilerplate, and whether it is hidden."""

    tag: str
    number: int
    main: int
    bad: int
    named: int
    labels: bool
    hidden: bool


class Block(NamedTuple):
    """Words of a block, how many of them in links, and its surroundings; `at` is the innermost element that breaks lines."""

    words: list[str]
    linked: int
    at: int
    main: int
    bad: int
    named: int
    labels: bool


class Page(NamedTuple):
    """Blocks, the words of the title, and of each element (number 0 is none): parent, depth, name, and for named ones
    their hashed names, whether these are telling, and the next named one around."""

    blocks: list[Block]
    title: set[str]
    parent: list[int]
    depth: list[int]
    tag: list[str]
    names: dict[int, tuple[frozenset[int], bool, int]]


class _Parser(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.page = Page([], set(), [0], [0], [""], {})
        self.open: list[Element] = [Element("", 0, 0, 0, 0, False, False)]
        self.breaking = [0]
        self.count: Counter[str] = Counter()
        self.held: list[str] = []
        self.linked = 0

    def _break(self) -> None:
        words = "".join(self.held).split()
        if words:
            e = self.open[-1]
            self.page.blocks.append(Block(words, min(self.linked, len(words)), self.breaking[-1], e.main, e.bad, e.named, e.labels))
        self.held, self.linked = [], 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "body" or tag not in IN_HEAD and self.open[-1].tag == "head":
            self._close("head", {"template"})
        if tag in BREAKS:
            self._break()
        if tag in VOID:
            return
        if tag in ("p", "li", "td", "th", "tr", "dt", "dd", "option"):
            self._close(tag, BREAKS - {"p", "li", "td", "th", "tr", "dt", "dd"})
        told, up, page = dict(attrs), self.open[-1], self.page
        number = len(page.parent)
        page.parent.append(self.breaking[-1])
        page.depth.append(page.depth[self.breaking[-1]] + 1)
        page.tag.append(tag)
        role = (told.get("role") or "").lower()
        main, bad, named, labels = up.main, up.bad, up.named, up.labels
        if tag in GOOD_TAGS or role in ("main", "article") or told.get("itemprop") == "articleBody" and not bad:
            main, bad, named, labels = number, 0, 0, False
        elif tag in BAD_TAGS and not (tag == "header" and main) or role in BAD_ROLES:
            bad, labels = bad or number, labels or tag in LABEL_TAGS
        name = "" if tag in UNNAMED else f"{told.get('class') or ''} {told.get('id') or ''}".lower()
        if name.strip():
            page.names[number] = (frozenset(crc32(w.encode()) % NAMES for w in name.split()[:8]), bool(TELLING.search(name)), named)
            named = number
        hidden = up.hidden or tag in HIDDEN or "hidden" in told or (told.get("aria-hidden") or "") == "true"
        self.count[tag] += 1
        self.open.append(Element(tag, number, main, bad, named, labels, hidden))
        if tag in BREAKS:
            self.breaking.append(number)

    def _close(self, tag: str, walls: frozenset[str] | set[str]) -> None:
        """Close the innermost open element of that name, and what it holds, unless a wall stands before it."""
        if not self.count[tag]:
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                for e in self.open[k:]:
                    self.count[e.tag] -= 1
                while self.breaking[-1] >= self.open[k].number:
                    self.breaking.pop()
                del self.open[k:]
                return
            if self.open[k].tag in walls:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag in BREAKS:
            self._break()
        self._close(tag, frozenset())

    def handle_data(self, data: str) -> None:
        if self.open[-1].tag == "title":
            self.page.title.update(data.lower().split())
        if self.open[-1].tag == "head" and data.strip():
            self._close("head", frozenset())
        if self.open[-1].hidden:
            return
        self.held.append(data)
        if self.count["a"]:
            self.linked += len(data.split())

    def done(self) -> Page:
        self.close()
        self._break()
        return self.page


def parsed(html: str) -> Page:
    parser = _Parser()
    parser.feed(html)
    return parser.done()


def key(words: list[str]) -> int:
    """A block's text as a number of 63 bits."""
    return _key(" ".join(words))


def _key(line: str) -> int:
    return int.from_bytes(blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).digest()) >> 1


def _held(page: Page, sizes: np.ndarray) -> np.ndarray:
    """The share of the page's words that each element holds, with all that is in it."""
    out = np.zeros(len(page.parent))
    np.add.at(out, [b.at for b in page.blocks], sizes)
    total = out.tolist()
    for e in range(len(total) - 1, 0, -1):  # children come after their parents
        total[page.parent[e]] += total[e]
    return np.array(total) / max(1, sizes.sum())


_PUNCTUATED = re.compile("[.,;:!?](?: |$)")
_SIGNS = re.compile("[\u00a9|\u00bb\u203a\u00b7]")


def facts(page: Page) -> tuple[np.ndarray, list[str], list[int]]:
    """A row a block, in the order of FACTS, the texts of blocks and their keys."""
    found = page.blocks
    lines = [" ".join(b.words) for b in found]
    low = [set(line.lower().split(" ")) for line in lines]
    times = Counter(chain.from_iterable(low))
    shared = {w for w, n in times.items() if n > 1}
    own = Counter()
    for b in found:
        own[page.parent[b.at]] += len(b.words)
    out, last = [], {}
    for k, (b, line, words) in enumerate(zip(found, lines, low, strict=True)):
        parent, n = page.parent[b.at], len(b.words)
        out.append((
            n,
            b.linked,
            len(_PUNCTUATED.findall(line)),
            len(line) - n + 1,
            line[-1] in ".!?",
            _SIGNS.search(" ".join(b.words[:8])) is not None,
            len(words),
            len(words & shared),
            len(words & page.title),
            own[parent],
            page.tag[b.at] in HEADINGS,
            page.tag[b.at] in ITEMS,
            (b.main > 0 and not b.bad) + 2 * b.labels + 4 * (b.main > 0),
            _apart(page, found[k - 1].at, b.at) if k else 0,
            k - last.get(parent, k),
        ))
        last[parent] = k
    return np.array(out, np.int32).reshape(-1, len(FACTS)), lines, list(map(_key, lines))


def features(told: np.ndarray, sizes: np.ndarray, repeated: np.ndarray) -> np.ndarray:
    """Rows in the order of TEXT from rows of FACTS, of pages of so many blocks each, and whether their texts are repeated."""
    f = dict(zip(FACTS, told.T.astype(float), strict=True))
    words, page = f["words"], np.repeat(np.arange(len(sizes)), sizes)
    total = np.bincount(page, words, len(sizes))
    before = np.cumsum(words) - words / 2 - (np.cumsum(total) - total)[page]
    log = np.log1p(words)
    wide, edge = np.pad(log, 1), np.concatenate([[True], page[1:] != page[:-1], [True]]) if len(page) else np.ones(2, bool)
    out = np.ones((len(told), len(TEXT)))
    columns = (
        log,
        f["linked"] / words,
        f["punctuation"] / words,
        f["letters"] / words / 10,
        f["ends"],
        f["signs"],
        f["shared"] / f["distinct"],
        f["title"] / f["distinct"],
        repeated,
        np.abs(2 * (before / total[page]) - 1),
        f["own"] / total[page],
        (np.where(edge[:-1], 0, wide[:-2]) + np.where(edge[1:], 0, wide[2:])) / 2,
        f["heading"],
        f["item"],
    )
    for k, column in enumerate(columns):
        out[:, k + 1] = column
    return out


def text_features(page: Page, repeated: dict[int, int] | frozenset[int]) -> np.ndarray:
    """A row a block, in the order of TEXT. repeated: the keys of blocks that several pages hold."""
    told, _, keys = facts(page)
    return features(told, np.array([len(told)]), np.array([k in repeated for k in keys], bool))


def mark_features(page: Page) -> np.ndarray:
    """A row a block, in the order of MARKS."""
    sizes = np.array([len(b.words) for b in page.blocks], float)
    rest = 1 - _held(page, sizes) if len(sizes) else sizes
    whole = {b.main for b in page.blocks if b.main}
    outside = 1 - min((rest[m] for m in whole), default=1.0)  # how much of the page its largest article or main holds
    out = np.zeros((len(sizes), len(MARKS)))
    for k, b in enumerate(page.blocks):
        out[k, 0] = b.main > 0
        out[k, 1] = outside * (not b.main)
        out[k, 2] = rest[b.bad] if b.bad else 0
        at = b.named
        for _ in range(AROUND):
            if at:
                buckets, telling, up = page.names[at]
                out[k, 3] = max(out[k, 3], telling * rest[at])
                for j in buckets:
                    out[k, 4 + j] = max(out[k, 4 + j], rest[at])
                at = up
    out[:, 0] *= 1 - out[:, 3]  # an article's box for comments isn't the article
    return out


class Model(NamedTuple):
    """Weights of the text and of the marks, and the keys of blocks that several pages hold."""

    text: np.ndarray
    marks: np.ndarray
    repeated: frozenset[int]


PRIOR = Model(np.array(list(TEXT.values())), np.array(list(MARKS.values())), frozenset())


def moments(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slope and curvature of the logistic likelihood at weights w: sums over rows."""
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return x.T @ (y - p), (x * (p * (1 - p))[:, None]).T @ x


def fit(sums: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], prior: np.ndarray, share: float = 1.0, start: np.ndarray | None = None, rounds: int = 30, within: float = 1e-6) -> np.ndarray:
    """Weights of a logistic regression with a ridge around prior weights, by Newton's method; sums are moments over all rows,
    each of which counts for a share."""
    w = prior.copy() if start is None else start.copy()
    for _ in range(rounds):
        slope, curve = sums(w)
        step = np.linalg.solve(share * curve + RIDGE * np.eye(len(w)), share * slope - RIDGE * (w - prior))
        w += step
        if np.abs(step).max() < within:
            break
    return w


def scores(page: Page, model: Model) -> np.ndarray:
    """What speaks for content: the text's part and the marks', both bounded."""
    return np.clip(text_features(page, model.repeated) @ model.text, -CLIP, CLIP) + np.clip(mark_features(page) @ model.marks, -CLIP, CLIP)


def minimum_cut(to_source: np.ndarray, to_sink: np.ndarray, edges: list[tuple[int, int, float]]) -> np.ndarray:
    """Which nodes stay with the source in a least cut, the smallest such set. Edges go both ways.

    A node whose terminals differ by more than all its open edges together is decided; its edges then count for its neighbours'
    terminals. What is left is solved by maximal flow (blocking flows of shortest paths)."""
    n = len(to_source)
    gain = (np.asarray(to_source, float) - np.asarray(to_sink, float)).tolist()
    around: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, c in edges:
        if a != b:
            around[a][b] = around[a].get(b, 0.0) + c
            around[b][a] = around[b].get(a, 0.0) + c
    weight = [sum(x.values()) for x in around]
    side, queue = [None] * n, deque(range(n))
    while queue:
        k = queue.popleft()
        if side[k] is not None or not (gain[k] > weight[k] + 1e-9 or gain[k] < -weight[k] - 1e-9):
            continue
        side[k] = gain[k] > 0
        for j, c in around[k].items():
            if side[j] is None:
                gain[j] += c if side[k] else -c
                weight[j] -= c
                queue.append(j)
    left = [k for k in range(n) if side[k] is None]
    for k, s in zip(left, _flow(left, gain, around, side), strict=True):
        side[k] = s
    return np.array(side, bool)


def _flow(nodes: list[int], gain: list[float], around: list[dict[int, float]], side: list) -> list[bool]:
    """Which of the nodes the source still reaches after a maximal flow over the edges among them."""
    if not nodes:
        return []
    at = {k: i for i, k in enumerate(nodes)}
    s, t = len(nodes), len(nodes) + 1
    arcs: list[list[int]] = [[] for _ in range(t + 1)]
    head: list[int] = []
    room: list[float] = []

    def add(a: int, b: int, forth: float, back: float) -> None:
        arcs[a].append(len(head))
        head.append(b)
        room.append(forth)
        arcs[b].append(len(head))
        head.append(a)
        room.append(back)

    for k, i in at.items():
        if gain[k] > 0:
            add(s, i, gain[k], 0.0)
        elif gain[k] < 0:
            add(i, t, -gain[k], 0.0)
        for j, c in around[k].items():
            if side[j] is None and k < j:
                add(i, at[j], c, c)
    while True:
        level, queue = [-1] * (t + 1), deque([s])
        level[s] = 0
        while queue:
            a = queue.popleft()
            for e in arcs[a]:
                if room[e] > 1e-9 and level[head[e]] < 0:
                    level[head[e]] = level[a] + 1
                    queue.append(head[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(len(nodes))]
        turn, path, a = [0] * (t + 1), [], s
        while True:
            if a == t:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                full = next(i for i, e in enumerate(path) if room[e] <= 1e-9)
                a = head[path[full] ^ 1]
                del path[full:]
                continue
            while turn[a] < len(arcs[a]):
                e = arcs[a][turn[a]]
                if room[e] > 1e-9 and level[head[e]] == level[a] + 1:
                    break
                turn[a] += 1
            if turn[a] < len(arcs[a]):
                path.append(arcs[a][turn[a]])
                a = head[path[-1]]
            elif path:
                e = path.pop()
                a = head[e ^ 1]
                turn[a] += 1
            else:
                break


def _apart(page: Page, one: int, two: int) -> int:
    """How far the common ancestor of two elements lies above the deeper one, but for the first step."""
    deepest = max(page.depth[one], page.depth[two])
    while one != two:
        if page.depth[one] >= page.depth[two]:
            one = page.parent[one]
        else:
            two = page.parent[two]
    return min(700, max(0, deepest - page.depth[one] - 1))


def edges(apart: list[int], sibling: list[int]) -> list[tuple[int, int, float]]:
    """Edges between neighbours in the page, and between blocks that follow each other under one parent."""
    out = []
    for k, (far, ago) in enumerate(zip(apart, sibling, strict=True)):
        if k:
            out.append((k - 1, k, NEAR / DEEPER**far))
        if ago:
            out.append((k - ago, k, SIBLING))
    return out


def smoothness(page: Page) -> list[tuple[int, int, float]]:
    """The edges of a page. The way from a block to the next over their common ancestor is no longer than the markup between
    them."""
    told = facts(page)[0]
    return edges(told[:, FACTS.index("apart")].tolist(), told[:, FACTS.index("sibling")].tolist())


def cut(score: np.ndarray, between: list[tuple[int, int, float]]) -> np.ndarray:
    """Which blocks are content: the least cut by the costs of calling each the other."""
    return minimum_cut(np.logaddexp(0, score), np.logaddexp(0, -score), between)


def labelled(page: Page, score: np.ndarray) -> np.ndarray:
    return cut(score, smoothness(page))


def content(page: Page, model: Model = PRIOR) -> np.ndarray:
    return labelled(page, scores(page, model)) if page.blocks else np.zeros(0, bool)


def main_text(html: str | None, model: Model = PRIOR) -> str:
    page = parsed(html or "")
    return " ".join(" ".join(b.words) for b, k in zip(page.blocks, content(page, model).tolist(), strict=True) if k)


class Digest(NamedTuple):
    """Some pages: rows of FACTS and MARKS, how many blocks each has, keys, and whether their texts are repeated."""

    facts: np.ndarray
    marks: np.ndarray
    sizes: np.ndarray
    keys: np.ndarray
    repeated: np.ndarray

    def text(self) -> np.ndarray:
        return features(self.facts, self.sizes, self.repeated)

    def told(self) -> np.ndarray:
        """Weak labels: 1 content, 0 boilerplate, -1 unknown."""
        bits = self.facts[:, FACTS.index("told")]
        return np.where(bits & 1, 1, np.where((bits & 2 > 0) | (bits & 4 == 0) & self.repeated, 0, -1))

    def cuts(self, score: np.ndarray) -> list[np.ndarray]:
        """Which blocks of each page are content."""
        apart, sibling = (self.facts[:, FACTS.index(c)].tolist() for c in ("apart", "sibling"))
        ends = np.cumsum(self.sizes).tolist()
        return [cut(score[e - n : e], edges(apart[e - n : e], sibling[e - n : e])) if n else np.zeros(0, bool) for e, n in zip(ends, self.sizes.tolist(), strict=True)]

    def text_rows(self) -> tuple[np.ndarray, np.ndarray]:
        told = self.told()
        return self.text()[told >= 0], told[told >= 0].astype(float)

    def mark_rows(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        said = np.concatenate([np.zeros(0, bool), *self.cuts(np.clip(self.text() @ text, -CLIP, CLIP))])
        plain = self.marks[:, 3] == 0
        return self.marks[plain], said[plain].astype(float)


def learned(htmls: list[str]) -> Model:
    """A model from some pages."""
    pages = [p for p in map(parsed, dict.fromkeys(htmls)) if p.blocks]
    if not pages:
        return PRIOR
    told = [facts(page) for page in pages]
    times = Counter(k for _, _, keys in told for k in set(keys))
    repeated = frozenset(k for k, n in times.items() if n >= REPEATED)
    keys = [k for _, _, keys in told for k in keys]
    digest = Digest(np.concatenate([t for t, _, _ in told]), np.concatenate(list(map(mark_features, pages))), np.array([len(t) for t, _, _ in told]), np.array(keys), np.array([k in repeated for k in keys]))
    share = min(1.0, EVIDENCE / len(pages))
    x, y = digest.text_rows()
    text = fit(lambda w: moments(x, y, w), PRIOR.text, share) if 0 < y.sum() < len(y) else PRIOR.text
    u, v = digest.mark_rows(text)
    return Model(text, fit(lambda w: moments(u, v, w), PRIOR.marks, share), repeated)


_DIGEST = "page_id long, url string, same long, text string, facts binary, keys array<long>, marks binary, places binary"


def _digest_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """page_id, url, same, html to pages as text (blocks joined by spaces) and what it says without the other pages."""
    for batch in batches:
        rows = []
        for html in batch.column(3).to_pylist():
            page = parsed(html or "")
            told, lines, keys = facts(page)
            marks = mark_features(page).ravel()
            places = np.flatnonzero(marks)
            rows.append((" ".join(lines), told.T.tobytes(), keys, marks[places].tobytes(), places.astype(np.int32).tobytes()))
        kinds = (pa.string(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.binary())
        columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], names=["page_id", "url", "same", "text", "facts", "keys", "marks", "places"])


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch by runs of pages of about BLOCKS blocks, so that memory doesn't grow with the pages of a batch."""
    run = np.cumsum(pc.list_value_length(batch.column("keys")).to_numpy(zero_copy_only=False)) // BLOCKS
    ends = [*np.flatnonzero(run[1:] != run[:-1]) + 1, batch.num_rows]
    for a, b in zip([0, *ends], ends):
        yield batch.slice(a, b - a)


def _loaded(batch: pa.RecordBatch, held: np.ndarray | None) -> Digest:
    """A digest of rows as _digest_task writes them. held: sorted keys of repeated blocks; without it the column `repeated`
    tells the places of a page's repeated blocks."""
    column = {n: batch.column(n) for n in batch.schema.names}
    keys = column["keys"].flatten().to_numpy(zero_copy_only=False)
    blobs = column["facts"].to_pylist()
    told = [np.frombuffer(b, np.int32).reshape(len(FACTS), -1).T for b in blobs]
    sizes = np.array([len(t) for t in told], np.int64)
    starts = np.cumsum(sizes) - sizes
    marks = np.zeros((len(keys), len(MARKS)))
    for start, values, places in zip(starts.tolist(), column["marks"].to_pylist(), column["places"].to_pylist(), strict=True):
        marks.ravel()[np.frombuffer(places, np.int32) + start * len(MARKS)] = np.frombuffer(values)
    repeated = np.zeros(len(keys), bool)
    if held is None:
        for start, places in zip(starts.tolist(), column["repeated"].to_pylist(), strict=True):
            repeated[[start + p for p in places or ()]] = True
    elif len(held):
        repeated = held[np.minimum(np.searchsorted(held, keys), len(held) - 1)] == keys
    return Digest(np.concatenate([np.zeros((0, len(FACTS)), np.int32), *told]), marks, sizes, keys, repeated)


def _sums_task(rows: Callable[[Digest], tuple[np.ndarray, np.ndarray]], held: np.ndarray | None, w: np.ndarray) -> Callable:
    """Pages to one sum a place: rows, labels of content, slope and curvature at w."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 + len(w) + len(w) ** 2)
        for batch in chain.from_iterable(map(_slices, batches)):
            x, y = rows(_loaded(batch, held))
            slope, curve = moments(x, y, w)
            total += np.concatenate([[len(y), y.sum()], slope, curve.ravel()])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["at", "value"])

    return task


def _summed(pages: DataFrame, rows: Callable, held: np.ndarray | None, w: np.ndarray) -> np.ndarray:
    out = np.zeros(2 + len(w) + len(w) ** 2)
    sums = pages.mapInArrow(_sums_task(rows, held, w), "at int, value double").groupBy("at").agg(F.sum("value").alias("value"))
    for r in sums.collect():  # as many as numbers in out, at most
        out[r.at] = r.value
    return out


def _fitted(pages: DataFrame, few: DataFrame, rows: Callable, held: np.ndarray | None, prior: np.ndarray, n: int) -> np.ndarray:
    """Weights from all pages (n). Newton's method starts from the weights of a few of them, which saves rounds over all."""
    size, shares = len(prior), {}

    def over(some: DataFrame) -> Callable:
        def sums(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            got = _summed(some, rows, held, w)
            shares["rows"], shares["content"] = got[:2]
            return got[2 : 2 + size], got[2 + size :].reshape(size, size)

        return sums

    share = min(1.0, EVIDENCE / n)
    start = fit(over(few), prior, within=1e-3) if share < 1 else prior
    out = fit(over(pages), prior, share, start, within=1e-4)  # a step of Newton's leaves the square of it
    return out if 0 < shares["content"] < shares["rows"] else prior


def _flagged(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """rows with `repeated`, the places of blocks whose keys are among some."""
    blocks = rows.select("row", F.posexplode("keys").alias("place", "key"))
    found = spread_join(blocks, keys, ["key"]).groupBy("row").agg(F.collect_list("place").alias("repeated"))
    return rows.join(found, "row", "left")


def _learn(digests: DataFrame, scratch: Scratch) -> tuple[Model, np.ndarray | None, DataFrame | None]:
    """A model of all pages, without keys. Those of repeated blocks come sorted; where they are more than HELD, as a table."""
    seen = digests.where(F.size("keys") > 0).select("row", "same", "facts", "keys", "marks", "places")
    copies = scratch.kept(seen.groupBy("same").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "copies")
    if not copies.isEmpty():
        later = spread_join(seen.select("row", "same"), copies.select("same", "first"), ["same"]).where("row <> first").select("row")
        seen = scratch.kept(seen.join(later, "row", "left_anti"), "seen")
    n = seen.count()
    if not n:
        return PRIOR, np.zeros(0, np.int64), None
    times = seen.select(F.explode(F.array_distinct("keys")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    keys = scratch.kept(times.where(F.col("n") >= REPEATED).select("key"), "repeated")
    held = None
    if keys.count() <= HELD:
        held, keys = np.sort(keys.toArrow().column(0).to_numpy()), None
    else:
        seen = scratch.kept(_flagged(seen, keys), "flagged")
    few = seen.where(F.pmod("same", F.lit(-(-n // EVIDENCE))) == 0)
    text = _fitted(seen, few, Digest.text_rows, held, PRIOR.text, n)
    marks = _fitted(seen, few, lambda digest: digest.mark_rows(text), held, PRIOR.marks, n)
    return Model(text, marks, frozenset()), held, keys


def _label_task(model: Model, held: np.ndarray | None) -> Callable:
    """Digests to their main text."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(map(_slices, batches)):
            digest = _loaded(batch, held)
            score = np.clip(digest.text() @ model.text, -CLIP, CLIP) + np.clip(digest.marks @ model.marks, -CLIP, CLIP)
            ends = np.cumsum(digest.facts[:, FACTS.index("words")] + digest.facts[:, FACTS.index("letters")], dtype=np.int64).tolist()
            texts, k = [], 0
            for text, side in zip(batch.column("text").to_pylist(), digest.cuts(score), strict=True):
                first = ends[k - 1] if k else 0
                cuts = [0, *(e - first for e in ends[k : k + len(side)])]
                texts.append(" ".join(text[a : b - 1] for a, b, c in zip(cuts, cuts[1:], side.tolist()) if c))
                k += len(side)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return task


_MAIN = "page_id long, url string, text string, n_chars long"


def _extract_task(model: Model) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [main_text(h, model) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return task


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars of each row of pages (page_id, url, html). Without a model, one of all these pages."""
    rows = pages.select(long_id(pages, "page_id"), F.col("url").cast("string"), "html")
    if model is not None:
        return rows.mapInArrow(_extract_task(model), _MAIN)
    spark = pages.sparkSession
    path = fresh(spark, "pages")
    written = rows.select("page_id", "url", F.xxhash64("html").alias("same"), "html").mapInArrow(_digest_task, _DIGEST)
    written.withColumn("row", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(path)
    digests = spark.read.schema(_DIGEST + ", row long").parquet(path)
    scratch = Scratch(spark, "html")
    model, held, keys = _learn(digests, scratch)
    if keys is not None:
        return _flagged(digests, keys).mapInArrow(_label_task(model, None), _MAIN)  # reads scratch; it goes with the process
    scratch.drop()
    return digests.mapInArrow(_label_task(model, held), _MAIN)
