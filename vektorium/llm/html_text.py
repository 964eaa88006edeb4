"""Main-text extraction: a minimum cut separates content blocks from boilerplate.

Terminals: the log odds of a classifier fitted on a bounded sample of pages that mark their article, and
what the page's own marks say. Edges: page order and tree proximity, of the same scale."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>?|<[!?/][^>]*>?", re.S
)
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Text up to the closing tag, or to the page's end, whatever it looks like.
RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in "script style textarea title noscript iframe noembed noframes xmp".split()}
#: Elements that aren't text of the page; those of SINGLE end where another of theirs starts. Where
#: such an element isn't closed, the next block starts outside of it.
NOT_SHOWN = {t: re.compile(rf"<(/?){t}(?=[\s/>])", re.I) for t in "template svg object select datalist option optgroup button canvas audio video".split()}
SINGLE = frozenset("select datalist option optgroup button".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Opening one of these ends an open paragraph.
ENDS_P = BLOCK - {"body", "html", "head"}
BOILERPLATE_TAGS = frozenset("nav footer aside menu dialog head search fieldset".split())
CONTENT_TAGS = frozenset(("article", "main"))
BOILERPLATE_NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertising alert author avatar banner bar bio breadcrumb breadcrumbs byline
    comment comments consent contact cookie cookies copyright crumb crumbs discussion disqus donate flash foot footer form
    gdpr header hidden legal login masthead menu message meta modal nav navbar navigation newsletter notice notification
    overlay pager pagination popup privacy promo promoted promotion rail reactions reader recommended related replies reply
    respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags teaser toast
    toolbar topbar tracking warning widget""".split()
)
CONTENT_NAMES = frozenset("article articlebody body content entry main post story text".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))

#: So many words of running text make an article; fewer may be a label.
ARTICLE_WORDS = 40

#: Costs are rounded to so many units.
UNIT = 1000

#: Weights of the classifier before it has seen a page, by feature: 1, words up to 40 as a share of 40,
#: share of letters in links, a sentence's end, heading, paragraph, distance from the page's middle.
PRIOR = (-1.2, 4.8, -4.0, 0.8, 0.6, 0.4, 0.0)
#: The most that the classifier, and what elements and names say, may weigh; links of blocks with one
#: parent, and with others. All are log odds.
CLASSIFIER, MARK, SIBLINGS, OTHERS = 4.0, 4.0, 1.5, 0.2
#: The classifier learns from so many different pages that mark their article, and so many blocks, evenly
#: spread, of each. A weight departs from its prior as if it had been seen in PRIOR_BLOCKS blocks.
SAMPLE_PAGES, SAMPLE_BLOCKS, PRIOR_BLOCKS = 256, 64, 4.0


class Block:
    __slots__ = ("parts", "linked", "kind", "mark", "parent", "text", "tag", "doubts", "inner", "article")

    def __init__(self, mark: int, kind: int, parent: int, tag: str, doubts: tuple[int, ...] = (), inner: int = 0, article: bool = False):
        self.parts: list[str] = []
        self.linked = 0
        self.mark, self.kind, self.parent, self.tag = mark, kind, parent, tag
        #: The elements round it that only their names, or a form's tag, make boilerplate; the element
        #: that holds it; and whether it is in an article or main element.
        self.doubts, self.inner, self.article = doubts, inner, article
        self.text = ""

    def weight(self) -> float:
        """Words outside of links, about."""
        return (self.text.count(" ") + 1) * (1 - self.linked / max(1, len(self.text.replace(" ", ""))))


def _kind(tag: str, attrs: str, above: int) -> tuple[int, bool]:
    """What an element says of all below it: -2 not shown, -1 boilerplate, 1 content, 0 nothing new; and whether its names call it boilerplate."""
    names: list[str] = []
    role = ""
    if attrs and not attrs.isspace():
        for name, a, b, c in _ATTR.findall(attrs):
            name, value = name.lower(), a or b or c
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return -2, False
            if name == "role":
                role = value.lower()
            elif name in ("class", "id", "itemprop", "data-role"):
                names += [w.lower() for w in _NAME_PART.findall(value)]
    if tag in BOILERPLATE_TAGS or role in ("navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "menu", "menubar"):
        return -1, False
    if tag == "header":
        return -1 if above != 1 else 2, False
    content = any(n in CONTENT_NAMES for n in names)
    named = tag == "form" or role == "form" or any(n in BOILERPLATE_NAMES for n in names)
    if tag in CONTENT_TAGS or role in ("main", "article"):
        return 1, named and not content and tag != "main" and role != "main"
    if tag in ("html", "body"):
        return 0, False
    return int(content), named


def _closed(html: str, tag: str) -> set[int]:
    """Where the elements of a tag start that have a closing tag of their own."""
    found, opened = set(), []
    for m in NOT_SHOWN[tag].finditer(html):
        if not m[1]:
            opened = [] if tag in SINGLE else opened
            opened.append(m.start())
        elif opened:
            found.add(opened.pop())
    return found


def blocks(html: str) -> list[Block]:
    """The page's runs of text between block tags, in page order. Scripts, styles, comments and what is hidden are left out."""
    found: list[Block] = []
    stack: list[tuple[str, int, int]] = [("", 0, 0)]  # tag, kind, number
    doubts: set[int] = set()
    number, links, now, at = 0, 0, None, 0
    closed: dict[str, set[int]] = {}
    loose: set[int] = set()  # elements not shown and not closed

    def put(raw: str) -> None:
        nonlocal now
        if stack[-1][1] == -2 or not raw:
            return
        if now is None:
            if raw.isspace():
                return
            mark = next((k for _, kind, k in reversed(stack) if kind and kind > -3), 0)
            holder = next(((t, k) for t, _, k in reversed(stack) if t in BLOCK), ("", 0))
            outer = next((k for t, _, k in reversed(stack[:-1]) if t in BLOCK and k != holder[1]), 0)
            round_it = tuple(k for _, _, k in stack if k in doubts) if doubts else ()
            now = Block(mark, stack[-1][1], outer, holder[0], round_it, stack[-1][2], any(t in CONTENT_TAGS for t, _, _ in stack))
            found.append(now)
        text = unescape(raw) if "&" in raw else raw
        now.parts.append(text)
        if links:
            now.linked += len("".join(text.split()))

    while m := _TOKEN.search(html, at):
        put(html[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag in BLOCK:
                now = None
            depth = next((d for d in range(len(stack) - 1, 0, -1) if stack[d][0] == tag), 0)
            if depth:
                for t, _, _ in stack[depth:]:
                    links -= t == "a"
                    if t in BLOCK:
                        now = None
                del stack[depth:]
            continue
        if tag in RAW:
            if not m[3].rstrip().endswith("/"):
                close = RAW[tag].search(html, at)
                at = close.start() if close else len(html)
            continue
        if loose and (tag in BLOCK or tag in NOT_SHOWN):
            depth = next((d for d in range(len(stack)) if stack[d][2] in loose), 0)
            if depth and (tag in BLOCK or stack[depth][0] == tag):
                for t, _, _ in stack[depth:]:
                    links -= t == "a"
                del stack[depth:]
            loose = {k for _, _, k in stack if k in loose}
        if tag in BLOCK:
            now = None
            if tag in ENDS_P:
                depth = next((d for d in range(len(stack) - 1, 0, -1) if stack[d][0] in BLOCK), 0)
                if depth and (stack[depth][0] == "p" or stack[depth][0] == tag and tag in ("li", "dt", "dd", "td", "th", "tr") or stack[depth][0] in HEADINGS and tag in HEADINGS):
                    for t, _, _ in stack[depth:]:
                        links -= t == "a"
                    del stack[depth:]
        elif tag == "br":
            if now is not None:
                now.parts.append(" ")
        if tag in VOID or m[3].rstrip().endswith("/") and tag not in BLOCK:
            continue
        above = stack[-1][1]
        kind, named = (-2, False) if above == -2 or tag in NOT_SHOWN else _kind(tag, m[3], above)
        number += 1
        if named:
            doubts.add(number)
        if tag in NOT_SHOWN:
            if tag not in closed:
                closed[tag] = _closed(html, tag)
            if m.start() not in closed[tag]:
                loose.add(number)
        stack.append((tag, kind or above if above > -1 or kind == -2 else -1, number))
        links += tag == "a"
    put(html[at:])
    for b in found:
        b.text = " ".join("".join(b.parts).split())
    return [b for b in found if b.text]


def settle(found: list[Block]) -> None:
    """Decides which elements that names call boilerplate are so, and marks the blocks in those.

    Such an element is a wrapper, and says nothing, if the page's text is in it: if outside of it
    there is neither a marked article nor a fifth of the running text (none, if it holds few words),
    or if it holds most text of the article and main elements. Outer elements are decided first.
    """
    inside: dict[int, list[Block]] = {}
    for b in found:
        if b.kind != -1:
            for k in b.doubts:
                inside.setdefault(k, []).append(b)
    if not inside:
        return
    weight = {id(b): b.weight() for b in found if b.kind != -1}
    total, articles = sum(weight.values()), sum(weight[id(b)] for b in found if b.article and b.kind != -1)
    lifted: set[int] = set()
    for k in sorted(inside):
        held = sum(weight[id(b)] for b in inside[k])
        article = sum(weight[id(b)] for b in inside[k] if b.article)
        if 2 * held < total and 2 * article <= articles:
            continue
        rest = [b for b in found if b.kind != -1 and k not in b.doubts and lifted.issuperset(b.doubts)]
        marked = sum(weight[id(b)] for b in rest if b.kind == 1)
        outer = all(b.article for b in inside[k]) and any(b.article for b in rest)  # it is itself a part of an article
        outside = sum(weight[id(b)] for b in rest)
        if article > 4 * marked and not outer or marked < ARTICLE_WORDS and 4 * outside < held and (held >= ARTICLE_WORDS or not outside):
            lifted.add(k)
    for b in found:
        if b.kind != -1 and not lifted.issuperset(b.doubts):
            b.kind, b.mark = -1, b.inner


def features(found: list[Block]) -> np.ndarray:
    """What the classifier sees of each block: nothing of names, nor of what the page marks."""
    rows = []
    for k, b in enumerate(found):
        density = b.linked / max(1, len(b.text.replace(" ", "")))
        ends, heading = b.text[-1] in ".!?:;…»”\"'。", b.tag in HEADINGS
        rows.append((1.0, min(b.text.count(" ") + 1, 40) / 40, density, ends, heading, b.tag == "p", abs(2 * (k + 0.5) / len(found) - 1)))
    return np.array(rows, np.float64)


def fitted(x: np.ndarray, y: np.ndarray, prior: tuple[float, ...] = PRIOR, steps: int = 25) -> tuple[float, ...]:
    """Weights of a logistic regression of labels y on features x, drawn to the prior; the prior where there are no rows."""
    mean = np.array(prior)
    w = mean.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - PRIOR_BLOCKS * (w - mean)
        curve = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + PRIOR_BLOCKS * np.eye(len(w))
        w = w + np.clip(np.linalg.solve(curve, slope), -2, 2)
    return tuple(float(v) for v in w)


def score(b: Block, odds: float, has_content: float) -> float:
    """Cost of calling the block boilerplate less that of calling it content: the classifier's log odds and the page's marks.

    has_content: how far, 0 to 1, what the page marks as content may be all of it. Elements that the
    page marks as boilerplate are so; what it marks as content, or leaves unmarked, the cut may overrule.
    """
    odds = max(-CLASSIFIER, min(CLASSIFIER, odds))
    if b.kind == -1:
        return min(odds, 0.0) - 2 * MARK
    if b.kind == 2:
        return MARK if b.tag in HEADINGS else -MARK
    return odds + MARK if b.kind == 1 else odds - MARK * has_content


def min_cut(terminal: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Labels (True: content) of least total cost: |terminal| where the label goes against its sign, and an edge's capacity where its ends differ.

    Nodes whose terminal outweighs all their open edges take its label first, which some minimum has;
    their edges become terminals of the other ends. Max-flow by shortest augmenting paths solves the
    rest. Among minima it takes the one with the least content.
    """
    n = len(terminal)
    t = list(terminal)
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for a, b, c in edges:
        near[a][b] = near[b][a] = near[a].get(b, 0) + c
    label: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        a = queue.popleft()
        if label[a] is None and (abs(t[a]) > sum(near[a].values()) or not near[a]):
            label[a] = t[a] > 0
            for b, c in near[a].items():
                t[b] += c if label[a] else -c
                del near[b][a]
                queue.append(b)
            near[a] = {}
    rest = [a for a in range(n) if label[a] is None]
    if not rest:
        return [bool(x) for x in label]
    s, e = n, n + 1
    cap: dict[int, dict[int, int]] = {a: dict(near[a]) for a in rest} | {s: {}, e: {}}
    for a in rest:
        cap[s][a], cap[a][s] = max(t[a], 0), 0
        cap[a][e], cap[e][a] = max(-t[a], 0), 0
    while True:
        before = {s: s}
        queue = deque([s])
        while queue and e not in before:
            a = queue.popleft()
            for b, c in cap[a].items():
                if c > 0 and b not in before:
                    before[b] = a
                    queue.append(b)
        if e not in before:
            break
        path, a = [], e
        while a != s:
            path.append((before[a], a))
            a = before[a]
        flow = min(cap[x][y] for x, y in path)
        for x, y in path:
            cap[x][y] -= flow
            cap[y][x] += flow
    for a in rest:
        label[a] = a in before
    return [bool(x) for x in label]


def costs(found: list[Block], weights: tuple[float, ...] = PRIOR) -> tuple[list[int], list[tuple[int, int, int]]]:
    """Terminal capacities of settled blocks, and edges between blocks that are next to each other or near in the tree."""
    marked, other = (sum(b.weight() for b in found if b.kind == k) for k in (1, 0))
    has_content = min(1.0, max(marked / (2 * ARTICLE_WORDS), 4 * marked / max(1.0, marked + other)))
    plain = not any(b.kind for b in found)
    # a page without any marks is more likely to be a mere text than one with menus round it
    odds = features(found) @ np.array(weights) - (PRIOR[0] if plain else 0.0)
    edges = []
    for k, b in enumerate(found):
        for step in (1, 2):
            if k + step < len(found):
                o = found[k + step]
                if b.mark == o.mark:
                    edges.append((k, k + step, round(UNIT * (SIBLINGS if b.parent == o.parent else OTHERS) / step)))
                elif step == 1:
                    edges.append((k, k + step, UNIT // 10))
    return [round(UNIT * score(b, x, has_content)) for b, x in zip(found, odds.tolist(), strict=True)], edges


def main_text(html: str | None, weights: tuple[float, ...] = PRIOR) -> tuple[str, int, int]:
    """The main text, the blocks kept and all blocks."""
    found = blocks(html) if html else []
    if not found:
        return "", 0, 0
    settle(found)
    kept = [b.text for b, x in zip(found, min_cut(*costs(found, weights)), strict=True) if x]
    return "\n".join(kept), len(kept), len(found)


def fit_weights(pages: DataFrame, html: str = "html", n_pages: int = SAMPLE_PAGES, n_blocks: int = SAMPLE_BLOCKS) -> tuple[float, ...]:
    """The classifier's weights, learnt from a bounded sample of pages that mark their article; PRIOR if none does.

    The sample is the n_pages different pages of lowest hash, so it does not depend on partitions, nor
    on how often a page occurs; of each, n_blocks evenly spread blocks at most reach the driver.
    """
    hashed = pages.select(F.col(html).alias("html"), F.xxhash64(html).alias("h")).where(F.col("html").rlike("(?i)<(article|main)[\\s>]"))
    lowest = hashed.select("h").distinct().orderBy("h").limit(n_pages).agg(F.max("h").alias("h")).first()["h"]
    if lowest is None:
        return PRIOR
    names = [f"x{k}" for k in range(len(PRIOR))]

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for page in batch["html"]:
                found = blocks(page)
                if not any(b.article for b in found):
                    continue
                settle(found)
                some = np.unique(np.linspace(0, len(found) - 1, min(len(found), n_blocks)).astype(int))
                yield pd.DataFrame(features(found)[some], columns=names).assign(y=[float(found[k].article and found[k].kind != -1) for k in some])

    sample = hashed.where(F.col("h") <= lowest).groupBy("h").agg(F.first("html").alias("html")).select("html")
    rows = sample.mapInPandas(learn, ", ".join(f"{c} double" for c in (*names, "y"))).toPandas()
    if not len(rows):
        return PRIOR
    rows = rows.sort_values([*names, "y"])  # sums in one order, whatever the partitions
    return fitted(rows[names].to_numpy(), rows["y"].to_numpy())


def extracted(html: Column | str = "html", weights: tuple[float, ...] = PRIOR) -> Column:
    """A struct column: ``text``, ``n_kept`` and ``n_blocks``.

    Null, empty and blank pages have an empty text and no blocks; an empty table gives no rows. Pages
    of any length are read whole; broken markup is closed as browsers do for paragraphs, list items
    and cells. Equal pages give equal texts, and ties between labels go to boilerplate.
    """

    @F.pandas_udf("text string, n_kept long, n_blocks long")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for pages in batches:
            yield pd.DataFrame([main_text(p if isinstance(p, str) else None, weights) for p in pages], columns=["text", "n_kept", "n_blocks"])

    return extract(F.col(html) if isinstance(html, str) else html)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    pages = pages.select("page_id", "url", extracted("html", fit_weights(pages)).alias("e"))
    return pages.select("page_id", "url", "e.text", F.length("e.text").cast("long").alias("n_chars"), "e.n_kept", "e.n_blocks")
