"""Main text of web pages by gradient-boosted trees over DOM nodes.

Every element gets features of itself, its subtree, its siblings and its
ancestors (text and link density, depth, tags, tokens of class, id and role).
Boosted regression trees, fitted here on generated pages of many layouts with
known parts, give the log-odds that an element holds main text.  Decoding is
hierarchical: over each page's tree the choice with the greatest total
log-odds is taken in which no element below a rejected one is accepted.
"""

from __future__ import annotations

import functools
import random
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .storage import drop_columns_clashing

#: Elements by their use in HTML.  Dropped are those whose content is no text of the page: scripts,
#: controls, what stands in for media or scripts where these are off, and source annotations of formulas.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style noscript template head title textarea select option button input iframe object canvas audio video annotation annotation-xml".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose start ends an open element of the second set, up to one of the third.
_CLOSES = (
    (BLOCK - {"html", "body"}, frozenset({"p"}), frozenset({"html", "body", "td", "th", "button"})),
    (frozenset({"li"}), frozenset({"li"}), frozenset({"ul", "ol", "menu", "dir"})),
    (frozenset({"dd", "dt"}), frozenset({"dd", "dt"}), frozenset({"dl"})),
    (frozenset({"td", "th", "tr"}), frozenset({"td", "th"}), frozenset({"table", "tr"})),
    (frozenset({"tr"}), frozenset({"tr"}), frozenset({"table"})),
    (frozenset({"tbody", "thead", "tfoot"}), frozenset({"tbody", "thead", "tfoot", "tr", "td", "th"}), frozenset({"table"})),
    (frozenset({"option"}), frozenset({"option"}), frozenset({"select"})),
)
#: Elements that may stand in head; the start of any other one, or text, ends an open head.
_IN_HEAD = frozenset("head base link meta title style script noscript noframes template".split())
_RAW = re.compile(r"\s+")


class Page(HTMLParser):
    """A page's elements in order, and its texts with the element each stands in.

    Arrays by element: tag, parent (-1 for a root), names (class, id and role,
    lower-cased).  Unclosed and stray tags are mended by the rules of HTML that
    matter for nesting; the work for a tag does not grow with the open ones.
    Declarations of any form and comments without an end are no text.
    """

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.names, self.texts = ["#page"], [-1], [""], []
        self.open, self.depths, self.blocks = [0], {}, []
        self.feed(html)
        # What the parser has not taken is text only where it starts no markup.
        if self.rawdata.startswith(("<!", "<?")) or (self.rawdata.startswith("</") and self.rawdata[2:3].isalpha()) or (self.rawdata.startswith("<") and self.rawdata[1:2].isalpha()):
            self.rawdata = ""
        self.close()

    def parse_html_declaration(self, i):
        """``<![`` outside foreign content is a comment up to the next ``>``, whatever its keyword."""
        if self.rawdata.startswith("<![CDATA[", i):
            end = self.rawdata.find("]]>", i)
            if end >= 0:
                if any(self.depths.get(x) for x in ("math", "svg")):
                    self.handle_data(self.rawdata[i + 9 : end])
                return end + 3
        if self.rawdata.startswith("<![", i):
            return self.parse_bogus_comment(i)
        return super().parse_html_declaration(i)

    def _deepest(self, names):
        return max((self.depths[x][-1] for x in names if self.depths.get(x)), default=0)

    def _cut(self, k):
        """End the innermost open elements down to place ``k``."""
        while len(self.open) > k:
            name = self.tag[self.open.pop()]
            self.depths[name].pop()
            if name in BLOCK:
                self.blocks.pop()

    def _end_head(self, anywhere):
        """End head where it is the innermost open element, or ``anywhere`` with what is open in it."""
        k = self._deepest(("head",))
        if k and (anywhere or k == len(self.open) - 1):
            self._cut(k)

    def handle_starttag(self, tag, attrs):
        if tag not in _IN_HEAD:
            self._end_head(tag == "body")
        for starts, ends, stops in _CLOSES:
            if tag in starts and (k := self._deepest(ends)) > self._deepest(stops):
                if "p" not in ends or not self.blocks or self.blocks[-1] <= k:
                    self._cut(k)
        self.tag.append(tag)
        self.parent.append(self.open[-1])
        self.names.append(" ".join(v for k, v in attrs if v and k in ("class", "id", "role")).lower())
        if tag not in VOID:
            self.depths.setdefault(tag, []).append(len(self.open))
            if tag in BLOCK:
                self.blocks.append(len(self.open))
            self.open.append(len(self.tag) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if k := self._deepest((tag,)):
            if tag in BLOCK or not self.blocks or self.blocks[-1] < k:
                self._cut(k)

    def handle_data(self, data):
        if data:
            if data.strip(" \t\n\f\r"):
                self._end_head(False)
            self.texts.append((self.open[-1], len(self.tag) - 1, data))


#: Tokens of class, id and role that are counted, and tags that are told apart.
TOKENS = (
    "nav menu navbar breadcrumb header masthead banner footer copyright sidebar aside widget related ad ads advert sponsor promo cookie consent notice alert popup modal "
    "comment comments reply share social form search login subscribe newsletter content article main post entry body text story page wrapper container title"
).split()
TAGS = "article main section div p h1 h2 h3 ul ol li a nav header footer aside form table td blockquote pre span b body".split()
_TOKEN, _TAG = {t: i for i, t in enumerate(TOKENS)}, {t: i for i, t in enumerate(TAGS)}
_SPLIT = re.compile(r"[^a-z]+")
#: Elements whose features are laid out at once.
ROWS = 50_000


class Features:
    """The features of a page's elements: numbers, and bit masks of tag and tokens, their own and of all above."""

    def __init__(self, page: Page):
        n = len(page.tag)
        parent = np.array(page.parent)
        own, link, marks = (np.zeros(n, np.float32) for _ in range(3))
        depth, place = np.zeros(n, np.float32), np.zeros(n, np.float32)
        hidden, in_link = np.zeros(n, bool), np.zeros(n, bool)
        kids = [0] * n
        tags, tokens = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        for i in range(n):
            name, p = page.tag[i], page.parent[i]
            if name in _TAG:
                tags[i] = 1 << _TAG[name]
            if page.names[i]:
                tokens[i] = sum(1 << k for k in {_TOKEN[t] for t in _SPLIT.split(page.names[i]) if t in _TOKEN})
            if i:
                depth[i] = depth[p] + 1
                hidden[i] = hidden[p] or name in DROPPED
                in_link[i] = in_link[p] or name == "a"
                place[i] = kids[p]
                kids[p] += 1
        above_tags, above_tokens = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        for i in range(1, n):
            p = page.parent[i]
            above_tags[i] = above_tags[p] | tags[p]
            above_tokens[i] = above_tokens[p] | tokens[p]
        self.masks = ((tags, len(TAGS)), (tokens, len(TOKENS)), (above_tags, len(TAGS)), (above_tokens, len(TOKENS)))
        for at, _, data in page.texts:
            if hidden[at]:
                continue
            chars = len(data.strip())
            own[at] += chars
            marks[at] += data.count(".") + data.count(",") + data.count("?") + data.count("!")
            if in_link[at]:
                link[at] += chars
        is_tag = lambda t: np.array([x == t for x in page.tag], np.float32)
        below, text = np.ones(n, np.float32), own.copy()
        paras, items, links = is_tag("p"), is_tag("li"), is_tag("a")
        for i in range(n - 1, 0, -1):
            p = page.parent[i]
            for x in (below, text, link, marks, paras, items, links):
                x[p] += x[i]
        total = max(float(text[0]), 1.0)
        kids = np.array(kids, np.float32)
        up = np.maximum(parent, 0)
        one = np.float32(1)
        self.numbers = np.stack(
            [
                depth, np.log1p(text), np.log1p(own), link / np.maximum(text, one), text / below, np.log1p(below), marks / np.maximum(text, one) * 100, np.log1p(paras), np.log1p(items),
                np.log1p(links), text / total, text / np.maximum(text[up], one), place, place / np.maximum(kids[up], one), np.log1p(kids), link[up] / np.maximum(text[up], one), np.log1p(paras[up]),
            ],
            axis=1,
        ).astype(np.float32)

    def __len__(self) -> int:
        return len(self.numbers)

    def rows(self, begin: int, end: int) -> np.ndarray:
        """Some elements by all features."""
        bits = [((mask[begin:end, None] >> np.arange(n, dtype=np.uint64)) & np.uint64(1)).astype(np.float32) for mask, n in self.masks]
        return np.concatenate([self.numbers[begin:end], *bits], axis=1)


def features(page: Page) -> np.ndarray:
    """All elements of a page by all features."""
    return (f := Features(page)).rows(0, len(f))


class BoostedTrees:
    """Gradient-boosted regression trees for log-loss, with histogram splits."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 48, penalty: float = 2.0):
        self.depth, self.rate = depth, rate
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(self.cuts, x.T, strict=True)], axis=1)
        inner, leaves = 2**depth - 1, 2**depth
        self.column, self.cut, self.leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
        share = np.average(y, weights=weight)
        self.base = float(np.log(share / (1 - share)))
        score = np.full(len(y), self.base)
        offset = np.arange(x.shape[1]) * bins
        for t in range(trees):
            p = 1 / (1 + np.exp(-score))
            g, h = weight * (p - y), weight * p * (1 - p)
            node = np.zeros(len(y), np.int64)
            for level in range(depth):
                wide, first = 2**level, 2**level - 1
                slots = (node * (x.shape[1] * bins))[:, None] + offset + binned
                size = wide * x.shape[1] * bins
                gs = np.bincount(slots.ravel(), np.repeat(g, x.shape[1]), size).reshape(wide, x.shape[1], bins)
                hs = np.bincount(slots.ravel(), np.repeat(h, x.shape[1]), size).reshape(wide, x.shape[1], bins)
                gl, hl = gs.cumsum(axis=2), hs.cumsum(axis=2)
                gt, ht = gl[:, :, -1:], hl[:, :, -1:]
                gain = gl**2 / (hl + penalty) + (gt - gl) ** 2 / (ht - hl + penalty) - gt**2 / (ht + penalty)
                gain[:, :, -1] = 0
                best = gain.reshape(wide, -1).argmax(axis=1)
                col, at = best // bins, best % bins
                for k in range(wide):
                    self.column[t, first + k] = col[k]
                    cuts = self.cuts[col[k]]
                    self.cut[t, first + k] = cuts[at[k]] if at[k] < len(cuts) and gain[k, col[k], at[k]] > 1e-9 else np.inf
                node = node * 2 + (x[np.arange(len(y)), self.column[t, first + node]] > self.cut[t, first + node])
            value = -np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + penalty) * rate
            self.leaf[t] = value
            score += value[node]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for column, cut, leaf in zip(self.column, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = 2**level - 1 + node
                node = node * 2 + (x[rows, column[at]] > cut[at])
            out += leaf[node]
        return out


def decoded(parent: list[int], log_odds: np.ndarray) -> np.ndarray:
    """Accepted elements: the best total in which no accepted element is below a rejected one."""
    gain = np.array(log_odds, float)
    for i in range(len(parent) - 1, 0, -1):
        if gain[i] > 0:
            gain[parent[i]] += gain[i]
    keep = np.zeros(len(parent), bool)
    keep[0] = True
    for i in range(1, len(parent)):
        keep[i] = keep[parent[i]] and gain[i] > 0
    return keep


def main_text(page: Page, keep: np.ndarray) -> str:
    """The texts of accepted elements: white space (of Unicode, no-break spaces too) squeezed inside a block, blocks on lines of their own."""
    n = len(page.tag)
    dropped = [False] * n
    block = [0] * n
    for i in range(1, n):
        p = page.parent[i]
        dropped[i] = dropped[p] or page.tag[i] in DROPPED or not keep[i]
        block[i] = i if page.tag[i] in BLOCK else block[p]
    blocks, now, where = [], [], None
    before = 0
    for at, seen, data in page.texts:
        # A block element met since the last text ends the run, even where it holds none.
        new = block[at] != where or any(page.tag[k] in BLOCK for k in range(before + 1, seen + 1))
        broken = any(page.tag[k] == "br" for k in range(before + 1, seen + 1))
        if new and now:
            blocks.append("".join(now))
            now = []
        where, before = block[at], seen
        if not dropped[at]:
            now.append((" " if broken else "") + data)
    if now:
        blocks.append("".join(now))
    squeezed = (_RAW.sub(" ", b).strip(" ") for b in blocks)
    return "\n".join(b for b in squeezed if b)


def generated_page(rng: random.Random) -> tuple[str, list[bool]]:
    """A page of a random layout, and for each element in order whether it holds main text."""
    out, truth = [], []

    def words(low, high, stops=True):
        text = " ".join("".join(rng.choice("aeioubcdfglmnprstv") for _ in range(rng.randint(2, 9))) + ("," if rng.random() < 0.06 else "." if stops and rng.random() < 0.08 else "") for _ in range(rng.randint(low, high)))
        return text[:1].upper() + text[1:]

    def el(tag, main, attrs="", inside=None, close=True):
        out.append(f"<{tag}{' ' + attrs if attrs else ''}>")
        truth.append(main)
        if callable(inside):
            inside()
        elif inside:
            out.append(inside)
        if tag not in VOID and close:
            out.append(f"</{tag}>")

    def named(*tokens):
        return f'{rng.choice(["class", "class", "id"])}="{rng.choice(tokens)}"' if rng.random() < 0.75 else ""

    def link_list(main, n):
        def items():
            for _ in range(n):
                el("li", main, "", lambda: el("a", main, 'href="/x"', words(1, 3, False)))

        el(rng.choice(["ul", "ul", "ol"]), main, "", items)

    def junk(kind):
        tag, attrs = {
            "nav": ("nav", named("nav", "menu", "navbar")), "menu": ("div", f'class="{rng.choice(["menu", "nav-bar", "breadcrumb", "main-menu", "navigation nav"])}"'),
            "header": ("header", named("header", "masthead", "site-header")), "footer": ("footer", named("footer", "site-footer", "page-footer")), "foot": ("div", f'{rng.choice(["id", "class"])}="{rng.choice(["footer", "copyright", "site-footer"])}"'),
            "aside": ("aside", named("sidebar", "widget", "related")), "side": ("div", f'class="{rng.choice(["sidebar", "side widget", "related-posts related", "promo"])}"'),
            "ad": (rng.choice(["div", "section", "p", "aside"]), f'class="{rng.choice(["ad", "ads", "advert", "ad-banner", "sponsor", "promo"])}"'),
            "notice": (rng.choice(["div", "section"]), f'{rng.choice(["id", "class"])}="{rng.choice(["cookie", "cookie-notice", "notice", "alert", "popup modal", "cookie-banner consent"])}"'),
            "form": ("form", named("search", "login-form", "newsletter subscribe")), "comments": (rng.choice(["section", "div", "div", "ol"]), f'{rng.choice(["id", "class"])}="{rng.choice(["comments", "comment-list", "reply comments", "comments-area"])}"'),
            "share": ("div", f'class="{rng.choice(["share", "social", "share-links social"])}"'),
        }[kind]

        def inside():
            if kind in ("nav", "menu") or kind in ("aside", "side", "share") and rng.random() < 0.6:
                link_list(False, rng.randint(2, 9))
            elif kind == "comments":
                for _ in range(rng.randint(1, 5)):
                    el(rng.choice(["div", "article", "li"]), False, 'class="comment"', lambda: [el("p", False, "", words(4, 40)) for _ in range(rng.randint(1, 2))])
            elif kind == "form":
                el("label", False, "", words(1, 4))
                out.append('<input type="text">')
                truth.append(False)
            elif kind == "header":
                if rng.random() < 0.6:
                    el(rng.choice(["div", "p", "h2", "span"]), False, "", words(1, 6))
                if rng.random() < 0.6:
                    el("nav", False, "", lambda: link_list(False, rng.randint(2, 6)))
            elif kind in ("footer", "foot") and rng.random() < 0.4:
                el("p", False, "", "&copy; " + words(3, 20))
            else:
                if rng.random() < 0.5:
                    el("p", False, "", words(3, 25))
                else:
                    out.append(words(3, 25))

        el(tag, False, attrs, inside)

    def inline():
        roll = rng.random()
        if roll < 0.12:
            el(rng.choice(["a", "span"]), False, f'class="{rng.choice(["ad", "ad sponsor", "ad advert", "promo", "share", "social share", "sponsor"])}"', words(1, 8))
        elif roll < 0.2:
            el(rng.choice(["a", "span", "em", "b", "time", "small", "cite", "abbr", "code"]), True, f'class="{rng.choice(["term", "ref", "text", "title", "highlight", "external", "note", "date"])}"', words(1, 8))
        else:
            el(rng.choice(["b", "i", "em", "strong", "a", "a", "span", "code", "sub", "math", "small", "mark", "q", "u", "font"]), True, rng.choice(["", "", 'href="/x"']), words(1, rng.choice([5, 5, 25])))

    def paragraph():
        roll = rng.random()
        if roll < 0.68:
            def inside():
                out.append(words(1, 60) + " ")
                for _ in range(rng.choice([0, 0, 0, 1, 2])):
                    inline()
                    out.append(" " + words(1, 30))

            el("p", True, "", inside, rng.random() < 0.8)
        elif roll < 0.76:
            el(rng.choice(["h2", "h3"]), True, "", words(1, 8, False))
        elif roll < 0.84:
            el(rng.choice(["ul", "ol"]), True, "", lambda: [el("li", True, "", words(3, 25)) for _ in range(rng.randint(2, 6))])
        elif roll < 0.90:
            el("blockquote", True, "", lambda: el("p", True, "", words(6, 40)))
        elif roll < 0.94:
            el("div", True, "", words(5, 50))
        elif roll < 0.97:
            def table():
                for _ in range(rng.randint(2, 4)):
                    el("tr", True, "", lambda: [el("td", True, "", words(1, 4, False)) for _ in range(3)])

            el("table", True, "", table)
        else:
            el("pre", True, "", words(4, 20))

    def article():
        if rng.random() < 0.85:
            el("h1", True, "", words(2, 12, False))
        if rng.random() < 0.35:
            def open_bold():
                el("b", True, "", words(2, 14, False), False)
                out.append("<br>")
                truth.append(True)

            el("p", True, "", open_bold, False)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 8, 12])):
            paragraph()
            if rng.random() < 0.06:
                junk(rng.choice(["ad", "share", "aside", "notice"]))
        if rng.random() < 0.12:
            junk("comments")

    def body():
        top = [k for k in ("notice", "header", "nav", "menu", "ad", "form") if rng.random() < 0.42]
        end = [k for k in ("side", "aside", "ad", "comments", "share", "form", "foot", "footer", "notice") if rng.random() < 0.3]
        rng.shuffle(top)
        tag, attrs = rng.choice([("article", ""), ("article", ""), ("article", 'class="post"'), ("main", ""), ("div", 'id="content"'), ("div", 'class="article-body"'), ("section", 'class="entry content"'), ("div", 'class="post text"'), ("div", "")])
        wrapped = rng.random() < 0.4

        def all_parts():
            for k in top:
                junk(k)
            if wrapped and rng.random() < 0.5:
                el(rng.choice(["main", "div"]), True, named("container", "wrapper", "page"), lambda: el(tag, True, attrs, article))
            else:
                el(tag, True, attrs, article)
            for k in end:
                junk(k)

        if wrapped:
            el("div", True, named("wrapper", "page", "container"), all_parts)
        else:
            all_parts()

    el("html", True, "", lambda: el("body", True, "", body))
    return "<!DOCTYPE html>" + "".join(out), truth


@functools.cache
def fitted_model(pages: int = 700, seed: int = 7) -> BoostedTrees:
    """The trees, fitted on ``pages`` generated pages (always the same for the same arguments)."""
    rng = random.Random(seed)
    xs, ys, ws = [], [], []
    for _ in range(pages):
        html, truth = generated_page(rng)
        page = Page(html)
        if len(page.tag) != len(truth) + 1:
            continue
        x = features(page)
        xs.append(x[1:])
        ys.append(np.array(truth, float))
        ws.append(1 + x[1:, 1])
    return BoostedTrees(np.concatenate(xs), np.concatenate(ys), np.concatenate(ws))


def extracted(htmls: list[str], model: BoostedTrees) -> list[str]:
    """The main text of each page."""
    out = []
    pages = [Page(h) for h in htmls]
    of = [Features(p) for p in pages]
    # Small pages share a block of rows; a large one is cut into several.
    odds = [np.empty(len(f)) for f in of]
    blocks, held = [], 0
    for k, f in enumerate(of):
        for begin in range(0, len(f), ROWS):
            end = min(len(f), begin + ROWS)
            if held + end - begin > ROWS:
                _fill(odds, of, blocks, model)
                blocks, held = [], 0
            blocks.append((k, begin, end))
            held += end - begin
    _fill(odds, of, blocks, model)
    for p, x in zip(pages, odds, strict=True):
        out.append(main_text(p, decoded(p.parent, x)))
    return out


def _fill(odds: list[np.ndarray], of: list[Features], blocks: list[tuple[int, int, int]], model: BoostedTrees) -> None:
    if blocks:
        got, at = model.log_odds(np.concatenate([of[k].rows(a, b) for k, a, b in blocks])), 0
        for k, a, b in blocks:
            odds[k][a:b] = got[at : at + b - a]
            at += b - a


def extract_main_text(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None, model: BoostedTrees | None = None, at_once: int = 500_000) -> DataFrame:
    """``pages`` with text (empty if none) and n_chars, its code points.

    Null and empty html has no text.  Equal pages get equal texts; pages are
    judged one by one, ``at_once`` characters of html at a time.  Any string is
    a page: malformed markup is mended, never an error.  Columns with added
    names give way.  An empty table gives an empty one.
    """
    kept = drop_columns_clashing(pages.select(*keep) if keep else pages, "text", "n_chars")
    names = kept.columns
    given = pages.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(names)], F.col(f"`{html_col}`").alias("_html"))
    # Only arrays are broadcast, so that who unpacks them needs no module of this package.
    shared = pages.sparkSession.sparkContext.broadcast(vars(model or fitted_model()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = BoostedTrees.__new__(BoostedTrees)
        vars(trees).update(shared.value)
        for batch in batches:
            htmls = [h or "" for h in batch.column(len(names)).to_pylist()]
            texts, begin = [], 0
            while begin < len(htmls):
                end, size = begin, 0
                while end < len(htmls) and (end == begin or size + len(htmls[end]) <= at_once):
                    size += len(htmls[end])
                    end += 1
                texts += extracted(htmls[begin:end], trees)
                begin = end
            more = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *more], names=[*(f"_{i}" for i in range(len(names))), "text", "n_chars"])

    fields = [StructField(f"_{i}", kept.schema[i].dataType) for i in range(len(names))]
    out = given.mapInArrow(run, StructType([*fields, StructField("text", StringType()), StructField("n_chars", LongType())]))
    return out.withColumnsRenamed({f"_{i}": c for i, c in enumerate(names)})
