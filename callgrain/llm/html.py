"""Main text of web pages: parser events, text-to-tag ratios, Gaussian smoothing, threshold clustering.

The standard library's streaming parser turns a page into lines, one per block of text.
Each line has the ratio of its unlinked text to the tags it took. Ratios are smoothed
along the page with a Gaussian, and one threshold splits the lines into two clusters, so
that the logarithms in each differ least, weighted by text. The upper cluster is content.

The content lines choose the region: the deepest element that holds three quarters of
their text, widened to the article (or else main) element around it, to a parent that adds a further
eighth of content, and to headings beside it. All lines of the region are the page's
text, short ones too, but for elements that the method finds to be no content.

Markup is a weak signal beside that. Menus, footers, forms, adverts, comments and the
like, by tag, role or the whole name of a class or id, have their ratios divided by a
hundred and are smoothed by themselves. Such an element goes only if most of its text ends
up below the threshold. One that holds several lines and most of the page's unlinked
text counts like any other: a page wrapped in a form, or in a menu that was never closed,
keeps its text. Only elements that hold no page text (scripts, styles, controls) yield no
lines. A heading that no text follows is as weak. Links at the ends of the region go only
where no element parts them from the text, never within the element chosen first.

Defined cases: null and empty html give an empty text. Unclosed elements end with their
parents, paragraphs and items with the next block. Character references are decoded;
white space inside a block becomes one space; blocks are joined by one newline. A page
without any line has an empty text. Time and memory are linear in the page, however deep
its elements lie. Extra columns are left alone.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callgrain.llm.common import python_ready

# Element names, roles and class words.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
NO_TEXT = frozenset("script style noscript template head title button select textarea option datalist iframe object svg canvas audio video math map applet".split())
WEAK_TAGS = frozenset("nav footer aside header form dialog menu".split())
WEAK_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form tablist".split())
# A class name counts as a whole: words of the first list, with none but words of the second.
WEAK_WORDS = frozenset(
    "ad ads adv adbox adslot adunit advert adverts advertisement adsense sponsor sponsored sponsors promo promotion promotions cookie cookies consent gdpr newsletter "
    "subscribe subscription signup popup overlay modal toast sidebar aside widget widgets related recommended recommendations share sharing social comment comments "
    "commentlist reply replies respond disqus nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager footer masthead topbar toolbar login hidden".split()
)
PLAIN_WORDS = frozenset(
    "bar banner block body box button buttons card cards container content entry form header icons inline inner item items link links list main notice outer page panel "
    "post posts article articles section site slot stories top bottom left right thread title unit wrap wrapper area media the js text".split()
)
WEAK_IDS = frozenset(
    "ad ads adslot comments comment-list commentlist comments-section disqus_thread respond sidebar related-posts related-articles recommended-posts share-buttons share-bar sharing "
    "cookie-notice cookie-banner cookie-consent newsletter-signup subscribe-form navbar breadcrumb breadcrumbs pagination".split()
)
WEAK_ARTICLES = frozenset("comment comments reply ad ads advert sponsored related promo".split())
TEXT_BLOCKS = frozenset("h1 h2 h3 h4 h5 h6 p pre blockquote table tbody thead tfoot tr td th caption figure figcaption dt dd li".split())
HEADINGS = frozenset("h1 h2 h3".split())
PART_OF = ("with-", "has-", "no-", "without-")
ENDED_BY_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SIGMA, WEAK, SPAN = 2.0, 0.01, 10.0  # width of the smoothing in lines; factor of weak elements; ratios further below the highest are alike
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def weak_words(name: str) -> set[str]:
    """The words that make a whole name one of boilerplate; none if it has other words too."""
    words = {w.lower() for w in _WORDS.findall(name)}
    return words & WEAK_WORDS if not name.lower().startswith(PART_OF) and words <= WEAK_WORDS | PLAIN_WORDS else set()


def is_hidden(a: dict[str, str]) -> bool:
    return "hidden" in a or a.get("aria-hidden", "").lower() == "true" or bool(_HIDDEN.search(a.get("style", "")))


def is_weak(tag: str, attrs: list[tuple[str, str | None]], in_article: bool) -> bool:
    """Whether markup speaks against a block element. Names of text elements, and ids made from titles, say what the text is about."""
    if tag in WEAK_TAGS:
        return True
    if not attrs or tag in ("html", "body", "main"):
        return False
    a = {k: v or "" for k, v in attrs}
    if is_hidden(a) or a.get("role", "").lower() in WEAK_ROLES:
        return True
    if tag in TEXT_BLOCKS:
        return False
    classes, ids = a.get("class", "").split(), a.get("id", "").split()
    if tag == "article":
        return any(weak_words(n) & WEAK_ARTICLES for n in classes + ids)
    return any(weak_words(n) for n in (classes if in_article else classes + ids)) or any(n.lower() in WEAK_IDS for n in ids)


class LineParser(HTMLParser):
    """Collects lines, and block elements by number: each knows its parent only. Number 0 is the page.

    A line is (text, share of it in links, tags, number of its block element).
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int]] = []  # tag, innermost block element
        self.open: dict[str, list[int]] = {}  # places in the stack by tag
        self.blocks: list[int] = []  # places of blocks
        self.walls: list[int] = []  # places of blocks that no start tag ends
        self.hidden: list[int] = []  # places of hidden inline elements
        self.muted = self.links = self.articles = 0
        self.parts: list[str] = []
        self.linked = self.tags = 0
        self.lines: list[tuple[str, float, int, int]] = []
        self.parent, self.tag, self.weak = [0], ["page"], [False]

    def end_line(self) -> None:
        if self.parts:
            whole = "".join(self.parts)
            text = " ".join(whole.split())
            if text:
                self.lines.append((text, self.linked / len(whole), self.tags, self.stack[-1][1] if self.stack else 0))
        self.parts, self.linked, self.tags = [], 0, 0

    def _pop_to(self, depth: int) -> None:
        if self.blocks and self.blocks[-1] >= depth:
            self.end_line()
        while len(self.stack) > depth:
            tag = self.stack.pop()[0]
            self.open[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()
                if tag != "p" and tag not in ENDED_BY_SAME:
                    self.walls.pop()
            self.muted -= tag in NO_TEXT
            self.links -= tag == "a"
            self.articles -= tag == "article"
        while self.hidden and self.hidden[-1] >= depth:
            self.hidden.pop()

    def _close_implied(self, tag: str) -> None:
        if tag in BLOCK and self.blocks and self.stack[self.blocks[-1]][0] == "p":
            self._pop_to(self.blocks[-1])
        if tag == "body" and self.open.get("head"):
            self._pop_to(self.open["head"][-1])
        at = max((self.open[t][-1] for t in ENDED_BY_SAME.get(tag, ()) if self.open.get(t)), default=-1)
        if at > (self.walls[-1] if self.walls else -1):
            self._pop_to(at)

    def handle_starttag(self, tag, attrs):
        self._close_implied(tag)
        if tag in BLOCK:
            self.end_line()
        self.tags += 1
        if tag in VOID:
            if tag == "br":
                self.handle_data(" ")
            return
        at, inner = len(self.stack), self.stack[-1][1] if self.stack else 0
        if tag in BLOCK:
            self.blocks.append(at)
            if tag != "p" and tag not in ENDED_BY_SAME:
                self.walls.append(at)
            self.parent.append(inner)
            self.tag.append("main" if ("role", "main") in attrs else tag)
            self.weak.append(is_weak(tag, attrs, self.articles > 0))
            inner = len(self.tag) - 1
        elif attrs and is_hidden({k: v or "" for k, v in attrs}):
            self.hidden.append(at)
        self.stack.append((tag, inner))
        self.open.setdefault(tag, []).append(at)
        self.muted += tag in NO_TEXT
        self.links += tag == "a"
        self.articles += tag == "article"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCK:  # browsers ignore the slash of blocks
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        places = self.open.get(tag)
        if places and (tag in BLOCK or not self.blocks or self.blocks[-1] < places[-1]):  # an inline end tag doesn't end blocks
            self._pop_to(places[-1])

    def handle_data(self, data):
        if not self.muted and not self.hidden:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)


def smoothed(ratios: list[float], groups: list[int], sigma: float = SIGMA) -> list[float]:
    """Gaussian means of the ratios along the page, over lines of the same group."""
    reach = math.ceil(3 * sigma)
    weight = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(reach + 1)]
    out = []
    for i, g in enumerate(groups):
        total = mass = 0.0
        for j in range(max(0, i - reach), min(len(ratios), i + reach + 1)):
            if groups[j] == g:
                w = weight[abs(i - j)]
                total, mass = total + w * ratios[j], mass + w
        out.append(total / mass)
    return out


def threshold(values: list[float], sizes: list[int]) -> float:
    """The least value of the upper of two clusters, of which the weighted squared distances from their means sum up to least."""
    order = sorted(range(len(values)), key=values.__getitem__)
    n, total = sum(sizes), sum(v * s for v, s in zip(values, sizes, strict=True))
    best, cut, below, mass = -1.0, values[order[0]], 0.0, 0
    for a, b in zip(order, order[1:], strict=False):
        below, mass = below + values[a] * sizes[a], mass + sizes[a]
        if values[a] < values[b]:
            apart = (below / mass - (total - below) / (n - mass)) ** 2 * mass * (n - mass)
            if apart > best:
                best, cut = apart, values[b]
    return cut


def content_runs(ratios: list[float], groups: list[int], sizes: list[int]) -> list[bool]:
    """Which lines are content: smoothed ratios at or above the threshold between two clusters."""
    smooth = smoothed(ratios, groups)
    floor = max(max(smooth) / SPAN, 1e-9)
    values = [math.log(max(x, floor)) for x in smooth]
    cut = threshold(values, sizes)
    return [v >= cut for v in values]


def main_text(html: str | None) -> str:
    if not html:
        return ""
    p = LineParser()
    p.feed(html)
    p.close()
    p.end_line()
    lines, parent = p.lines, p.parent
    if not lines:
        return ""
    count, at, sizes = len(parent), [x[3] for x in lines], [len(x[0]) for x in lines]
    def held(amounts: list[int], inner: bool = True) -> list[int]:
        """Sums over the lines in each element; without inner, not in the block that is the line itself."""
        out = [0] * count
        for e, a in zip(at, amounts, strict=True):
            out[e if inner or p.tag[e] == "article" else parent[e]] += a
        for e in range(count - 1, 0, -1):
            out[parent[e]] += out[e]
        return out

    # an element that holds several lines and most of the unlinked text wraps the page, whatever its name
    plain, number = held([round(n * (1 - x[1])) for x, n in zip(lines, sizes, strict=True)]), held([1] * len(lines))
    weak = [w and not (number[e] > 3 and 2 * plain[e] > plain[0]) for e, w in enumerate(p.weak)]
    group = [0] * count  # the weak element that an element lies in
    article = [0] * count  # the article element that an element lies in, or else the main one
    for e in range(1, count):
        group[e] = e if weak[e] else group[parent[e]]
        article[e] = e if p.tag[e] == "article" or p.tag[e] == "main" and not article[parent[e]] else article[parent[e]]
    # a heading that no text follows heads a list of links, or nothing
    bare, follows = [False] * len(lines), False
    for i in range(len(lines) - 1, -1, -1):
        heading = p.tag[at[i]] in HEADINGS
        bare[i] = heading and not follows
        follows = follows if heading else lines[i][1] <= 0.5 and not group[at[i]]
    ratios = [n * (1 - x[1]) / max(1, x[2]) * (WEAK if group[x[3]] or b else 1.0) for x, n, b in zip(lines, sizes, bare, strict=True)]
    runs = content_runs(ratios, [-1 if b else group[e] for e, b in zip(at, bare, strict=True)], sizes)

    text = held(sizes)
    content = held([n if c else 0 for n, c in zip(sizes, runs, strict=True)])
    own_content = held([n if c else 0 for n, c in zip(sizes, runs, strict=True)], inner=False)
    linked = held([n if x[1] > 0.5 else 0 for x, n in zip(lines, sizes, strict=True)])
    heads = held([n if p.tag[x[3]] in HEADINGS and x[1] <= 0.5 and not b else 0 for x, n, b in zip(lines, sizes, bare, strict=True)])
    low = [weak[e] and 2 * content[e] < text[e] for e in range(count)]
    gone = [False] * count  # in an element that markup speaks against, and most of whose text lies below the threshold
    for e in range(1, count):
        gone[e] = gone[parent[e]] or low[e]
    left = held([0 if gone[e] else n for e, n in zip(at, sizes, strict=True)])
    region = max(e for e in range(count) if 4 * own_content[e] >= 3 * content[0])
    if article[region] and 2 * content[article[region]] >= left[article[region]]:
        region = article[region]
    inner, above = region, region
    while above:
        above = parent[above]
        more = left[above] - left[region]
        if more == 0:
            continue  # the same text: an element further up has to bring more
        if 8 * (content[above] - content[region]) >= content[0] or more == heads[above] - heads[region]:
            inner, region = region, above
        else:
            break
    regions = {region}
    inside, kept = [False] * count, []
    around = {e for r in regions for e in _up(parent, r)}  # what holds the region is kept with it
    for e in range(count):
        if e in regions:
            inside[e] = True
        elif e:
            drop = low[e] and e not in around and (p.tag[e] != "header" or regions == {0} or 2 * linked[e] > text[e])
            inside[e] = inside[parent[e]] and not drop
    kept = [i for i, e in enumerate(at) if inside[e]]
    if not kept:
        return ""
    if p.tag[region] in ("page", "html", "body"):  # no element parts the text from menus: links at the ends go, but for those of the element that it grew from
        own = [False] * count
        for e in range(1, count):
            own[e] = e == inner and p.tag[e] not in ("html", "body") or own[parent[e]]
        linked_only = [lines[i][1] > 0.5 and not own[at[i]] for i in kept]
        first, last = (next((k for k, x in enumerate(side) if not x), 0) for side in (linked_only, linked_only[::-1]))
        kept = kept[first if first > 1 else 0 : len(kept) - (last if last > 1 else 0)]
    before = kept[0] - 1
    if before >= 0 and p.tag[at[before]] == "h1" and not gone[at[before]] and lines[before][1] <= 0.5 and not any(p.tag[at[i]] == "h1" for i in kept):
        kept.insert(0, before)
    return "\n".join(lines[i][0] for i in kept)


def _up(parent: list[int], e: int) -> Iterator[int]:
    while e:
        yield e
        e = parent[e]


def _main_texts(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for pages in parts:
        yield pd.Series([main_text(h) for h in pages])


def extract(html: Column) -> Column:
    """The main text of each page."""
    return F.pandas_udf(_main_texts, "string")(html)


def op9_html_main_text(spark, sf_dir: str) -> DataFrame:
    python_ready(spark)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return pages.select("page_id", "url", extract(F.col("html")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
