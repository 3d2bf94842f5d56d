"""Main text of web pages by a minimum cut between content and boilerplate.

A page is read into text blocks with their place in the element tree; blocks and the elements around them are the nodes of a graph. A classifier gives each node its
capacities to the two terminals: a block's from its own text and links, an element's from its own tag and names, for each block in it. Edges tie a block to its element,
an element to the one around it, and neighbours under one parent. A block alone often looks like the wrong kind - a short line in an article, a long one in a
list of comments - and gets its label from what it hangs on, unless its own evidence outweighs the ties.

The classifier is naive Bayes. Its counts are of all pages: blocks in elements that HTML itself calls an article or an aside are its labelled rows, from which it learns what
words, links and class names tell, where no such element stands. A prior, of some occurrences of each, stands in until counts do.

The graph is a tree with ties between neighbouring children. On such a graph the minimum cut, which is as large as the maximum flow, follows from the leaves up in one pass.

Defined results: null, empty and text-free html give the empty string and 0; unclosed elements, comments and quotes end where HTML ends them; elements nest as
deep as they come; equal rows give equal results; extra columns are not read; an empty table gives no rows."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, texts_of, trim

_NAME = r"[a-zA-Z][^\s/>]*"
MARK = re.compile(rf"<!--(?:>|->|.*?--!?>|.*\Z)|<(/?)({_NAME})((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)({_NAME})([^>]*)>|<[!?/][^>]*>|<{_NAME}[^>]*\Z", re.S)
ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'=<>`]+))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("br button caption dd dt head html body legend li option optgroup tbody td tfoot th thead tr select".split())
SIBLINGS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "optgroup": ("option", "optgroup")}
BORDERS = frozenset("ul ol menu dl table select article section nav aside main body html td th div form footer header blockquote".split())

#: Elements whose text is not the page's, elements that HTML keeps for what stands beside the content, and names in class, id or role that are known to tell either.
UNSEEN = frozenset("script style head title noscript template iframe select textarea noembed noframes".split())
ASIDE = frozenset("nav aside footer form menu dialog button fieldset search".split())
POOR = frozenset(
    "ad ads adv advert advertisement advertising adsense sponsor sponsored promo promotion banner sidebar aside menu nav navbar navigation navigational topbar toolbar breadcrumb breadcrumbs pagination pager footer foot colophon comment comments commentlist discussion disqus reply replies respond notice notices cookie cookies consent gdpr alert newsletter subscribe subscription signup signin login share sharing social related recommended recommendations popular trending widget popup modal overlay dialog tags rail skip masthead disclaimer copyright legal paywall form search complementary contentinfo".split()
)
ARTICLE = frozenset("article articlebody post entry story".split())
RICH = ARTICLE | frozenset("main content body maincontent".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
HEADER_NAMES = frozenset("header head hero".split())
#: Evidence of telling elements, which no ties outweigh; for each block of an element, of what stands outside of a page's article, of one name and of all names.
TELLING, OUTSIDE, NAME, NAMES = 1e6, -2.0, 5.0, 8.0
#: What a block's words and its links may tell.
WORDS, LINKED = 1.0, 1.0
#: Ties: of a block to its element, of an element to the one around it, that for each block in it, and between neighbours. An element's names outweigh them, words and links do not.
OF_BLOCK, OF_ELEMENT, FOR_EACH, NEXT = 2.0, 1.0, 2.0, 0.5

#: Features of blocks with their prior log-odds; names known to tell have theirs, all others share SLOTS.
TEXT = {"words 1": -2.0, "words 2": -1.4, "words 5": 0.0, "words 10": 1.0, "words 20": 2.0, "words 40": 3.0, "heading": 1.6, "sentence": 1.0, "no sentence": -0.5, "linked": -4.0}
SLOTS = 1024
_PRIOR = {**{n: -NAME for n in sorted(POOR)}, **{n: NAME / 2 for n in sorted(RICH - ARTICLE)}, **{n: NAME for n in sorted(ARTICLE)}}
FEATURES = {k: j for j, k in enumerate([*TEXT, *_PRIOR])}
_FIRST_POOR = len(TEXT)
PRIOR = np.r_[list(TEXT.values()), list(_PRIOR.values()), np.zeros(SLOTS)]
#: Occurrences that the prior stands for: of what a text shows, and of a name.
TRUST = np.r_[np.full(len(TEXT), 20.0), np.full(len(_PRIOR) + SLOTS, 2.0)]


def slot(name: str) -> int:
    """The feature of a name."""
    return FEATURES[name] if name in _PRIOR else len(FEATURES) + zlib.crc32(name.encode("utf-8", "replace")) % SLOTS


class Element:
    """tag; names: features of its class, id and role; told: 1 or -1 if HTML itself says that it holds content or not, else 0; inside: whether an article is around or it is one."""

    __slots__ = ("tag", "parent", "names", "told", "inside", "link", "unseen", "hidden", "number")

    def __init__(self, tag: str, parent: Element | None, attrs: str):
        self.tag, self.parent, self.names, self.told, self.number = tag, parent, (), 0, -1
        self.inside, self.link, self.unseen, self.hidden = (parent.inside, parent.link, parent.unseen, parent.hidden) if parent else (0, False, False, False)
        self.unseen |= tag in UNSEEN
        self.link |= tag == "a"
        header = tag == "header"
        if attrs.strip(" /"):
            got = {k.lower(): v.strip("\"'") for k, v in ATTR.findall(attrs)}
            if tag not in ("html", "body"):
                words = set(re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", " ".join(got.get(k, "") for k in ("class", "id", "role", "itemprop"))).lower())) - {""}
                header |= bool(words & HEADER_NAMES)
                rich = bool(words & RICH) and not self.inside  # an article's parts may be called so too
                self.names = tuple(sorted({slot(w) for w in words if w not in RICH or rich}))
                if words & ARTICLE and not words & POOR:
                    self.inside = 2
                elif words & RICH and not words & POOR:
                    self.inside = max(self.inside, 1)
            style = got.get("style", "").replace(" ", "").lower()
            self.hidden |= "hidden" in got or got.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style
        if tag in ASIDE or header and self.inside < 2:  # an article has a head of its own, a page's container has not
            self.told = -1
        elif tag in ("article", "main"):
            self.told, self.inside = (1, 2)


def blocks(html: str) -> list[tuple[str, Element, int]]:
    """The page's text blocks in order: text with single spaces, element, characters of it in links."""
    top = Element("#", None, "")
    stack, out, open_ = [top], [], Counter()
    text: list[str] = []
    owner, linked, said = top, 0, False

    def flush() -> None:
        nonlocal linked, said
        if text:
            if words := " ".join("".join(text).split()):
                out.append((words, owner, linked))
            text.clear()
        linked, said = 0, False

    def put(raw: str) -> None:
        nonlocal owner, linked, said
        here = stack[-1]
        if raw and not here.unseen and not here.hidden:
            if not said and not raw.isspace():
                owner, said = here, True
            raw = unescape(raw) if "&" in raw else raw
            text.append(raw)
            if here.link:
                linked += len(raw.strip())

    def close(tags: tuple[str, ...], borders: frozenset) -> None:
        if not any(open_[t] for t in tags):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                open_.subtract(x.tag for x in stack[k:])
                del stack[k:]
                return
            if stack[k].tag in borders:
                return

    at = 0
    while m := MARK.search(html, at):
        put(html[at : m.start()])
        at = m.end()
        slash, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag in BLOCK:
            flush()
        if slash:
            if tag == "p" or tag in VOID:
                close(("p",), BORDERS) if tag == "p" else None
            else:
                close((tag,), frozenset() if tag in BLOCK else BORDERS)
            continue
        if tag in CLOSES_P:
            close(("p",), BORDERS)
        if tag in SIBLINGS:
            close(SIBLINGS[tag], BORDERS - frozenset(SIBLINGS[tag]))
        if tag in VOID:
            continue
        if tag in RAW:  # its content is no markup
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        stack.append(Element(tag, stack[-1], attrs))
        open_[tag] += 1
    put(html[at:])
    flush()
    return out


# ---------------------------------------------------------------- the classifier


def text_features(text: str, at: Element, linked: int) -> list[int]:
    n = text.count(" ") + 1
    size = next(k for k in (40, 20, 10, 5, 2, 1) if n >= k)
    out = [f"words {size}", "sentence" if text[-1] in ".!?…。" else "no sentence"]
    if at.tag in HEADING:
        out.append("heading")
    if linked > 0.5 * len(text):
        out.append("linked")
    return [FEATURES[x] for x in out]


def telling(at: Element, strict: bool = False) -> int:
    """What the nearest element that HTML itself keeps for content or for other things says of a block. strict: nothing, if a name known for other things stands between."""
    e: Element | None = at
    while e is not None:
        if e.told:
            return e.told
        if strict and any(_FIRST_POOR <= k < _FIRST_POOR + len(POOR) for k in e.names):
            return 0
        e = e.parent
    return 0


def counts(html: str, into: np.ndarray) -> None:
    """Adds a page's labelled blocks to counts (features and all, content and not)."""
    found = blocks(html)
    told: dict[int, int] = {}
    for _, at, _ in found:
        if id(at) not in told:
            told[id(at)] = telling(at, True)
    if not any(x > 0 for x in told.values()):
        return  # nothing says what the content of this page is
    for text, at, linked in found:
        kind = 0 if told[id(at)] > 0 else 1
        if kind and telling(at) > 0:
            continue
        seen, e = set(text_features(text, at, linked)), at
        while e is not None:
            seen.update(e.names)
            e = e.parent
        into[list(seen), kind] += 1
        into[-1, kind] += 1


def weights(n: np.ndarray) -> np.ndarray:
    """Log-odds of the features from counts as of counts(): the prior where there are few."""
    total = n[-1] + 20.0
    own, trust = n[:-1] * (total.sum() / 2 / total), TRUST[:, None] * np.exp(np.c_[PRIOR, -PRIOR] / 2)
    return np.log((own[:, 0] + trust[:, 0]) / (own[:, 1] + trust[:, 1]))


def block_evidence(text: str, at: Element, linked: int, w: np.ndarray) -> float:
    own = text_features(text, at, linked)
    links = FEATURES["linked"]
    words = 0.5 * sum(w[k] for k in own if k != links)
    return max(-WORDS, min(WORDS, words)) + (max(-LINKED, min(LINKED, w[links])) if links in own else 0.0)


def element_evidence(e: Element, has_article: bool, w: np.ndarray) -> float:
    """For each block in it."""
    if e.parent is None:
        return OUTSIDE if has_article else 1.0
    return max(-NAMES, min(NAMES, sum(max(-NAME, min(NAME, w[k])) for k in e.names)))


# ---------------------------------------------------------------- the cut


def min_cut(parent: list[int], lean: list[float], tie: list[float], next_tie: float) -> list[bool]:
    """For each node whether it stays with the content terminal. parent: of each node, before it in the list (-1: the root, first); lean: positive, the capacity from
    content; negative, to boilerplate; tie: the capacity to the parent; next_tie: between neighbouring children, which stand in the order of the list."""
    n = len(parent)
    children: list[list[int]] = [[] for _ in range(n)]
    for k in range(1, n):
        children[parent[k]].append(k)
    cost = [(max(x, 0.0), max(-x, 0.0)) for x in lean]  # of a node and all below it, if it is boilerplate, if it is content

    def steps(own: list[int], above: int) -> list[tuple[float, float, int, int]]:
        """Along the children: the least cost up to each, for either label, and the label before it."""
        out, low, high = [], 0.0, 0.0
        for j, k in enumerate(own):
            a, b = cost[k][0] + tie[k] * (above == 1), cost[k][1] + tie[k] * (above == 0)
            gap = next_tie if j else 0.0
            from_low, from_high = int(high + gap < low), int(high <= low + gap)
            low, high = a + min(low, high + gap), b + min(high, low + gap)
            out.append((low, high, from_low, from_high))
        return out

    for k in range(n - 1, -1, -1):
        if children[k]:
            cost[k] = tuple(cost[k][x] + min(steps(children[k], x)[-1][:2]) for x in (0, 1))
    out = [False] * n
    out[0] = cost[0][1] <= cost[0][0]
    for k in range(n):
        if own := children[k]:
            way = steps(own, int(out[k]))
            x = int(way[-1][1] <= way[-1][0])
            for j in range(len(own) - 1, -1, -1):
                out[own[j]] = bool(x)
                x = way[j][2 + x]
    return out


def graph(html: str, w: np.ndarray) -> tuple[list[str | None], list[int], list[float], list[float]]:
    """Nodes of a page: texts (None: an element), parents, leanings, ties."""
    found = blocks(html)
    has_article = any(at.inside and telling(at) >= 0 for _, at, _ in found)
    texts: list[str | None] = []
    parent, elements, below = [], [], []
    lean: list[float] = []
    for text, at, linked in found:
        new, e = [], at
        while e is not None and e.number < 0:
            new.append(e)
            e = e.parent
        for e in reversed(new):
            e.number = len(texts)
            texts.append(None)
            parent.append(e.parent.number if e.parent is not None else -1)
            elements.append(e)
            below.append(0)
            lean.append(0.0)
        texts.append(text)
        parent.append(at.number)
        elements.append(None)
        below.append(1)
        lean.append(block_evidence(text, at, linked, w))
    for k in range(len(texts) - 1, 0, -1):
        below[parent[k]] += below[k]
    tie = [OF_BLOCK] * len(texts)
    for k, e in enumerate(elements):
        if e is not None:
            lean[k], tie[k] = TELLING * e.told + element_evidence(e, has_article, w) * below[k], OF_ELEMENT + FOR_EACH * below[k]
    return texts, parent, lean, tie


def main_text(html: str, w: np.ndarray | None = None) -> str:
    """The text of one page. w: weights(), the prior's if not given."""
    texts, parent, lean, tie = graph(html, weights(np.zeros((len(PRIOR) + 1, 2))) if w is None else w)
    if not texts:
        return ""
    return " ".join(t for t, keep in zip(texts, min_cut(parent, lean, tie, NEXT), strict=True) if keep and t is not None)


def learn(pages: DataFrame) -> np.ndarray:
    """The classifier's weights from all pages: each task adds up its own counts, as many as there are features."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(PRIOR) + 1, 2), np.int64)
        for b in it:
            for x in texts_of(b, "html"):
                counts(x, total)
        some = np.nonzero(total.any(1))[0]
        yield pa.RecordBatch.from_pydict({"feature": pa.array(some, pa.int32()), "content": total[some, 0], "other": total[some, 1]})
        trim()

    total = np.zeros((len(PRIOR) + 1, 2))
    got = pages.select("html").mapInArrow(run, "feature int, content long, other long").groupBy("feature").agg(F.sum("content"), F.sum("other"))
    for k, a, b in got.collect():
        total[k] = a, b
    return weights(total)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    w = learn(pages)

    def rows(b: pa.RecordBatch) -> dict:
        texts = [main_text(x, w) for x in texts_of(b, "html")]
        return {"page_id": b.column(0), "url": b.column(1), "text": texts, "n_chars": [len(x) for x in texts]}

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(batches(rows, schema), "page_id long, url string, text string, n_chars long")
