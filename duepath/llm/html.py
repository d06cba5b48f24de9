"""Main text of web pages from flat text blocks.

A page becomes a flat list of text blocks: markup, scripts and comments go, block elements separate, character
references are decoded, white space becomes one blank. A block is described by its words and link density, those of the
blocks before and after it, by how much of the page's unlinked text its container and its article hold, and by where it
stands: in a navigation, footer, form or hidden element, under a class that speaks of adverts or comments, in an article,
in a heading. A decision tree, grown from the blocks of the small whole pages in ``LABELLED``, weighs them together and
says which blocks are the main text; a class name alone decides nothing.

Defined cases: null html counts as empty; pages without main text give an empty string; unclosed and stray tags are
taken as they come; rows without page_id and repeated rows keep a row each; empty tables give no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of the document language: how elements behave.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
SILENT = frozenset("head title template noscript svg math iframe object select option datalist button canvas audio video map".split())
RAW = frozenset("script style textarea xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_ITSELF = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
ASIDE = frozenset("nav footer aside form menu dialog header".split())
#: Parts of class, id and role that name what surrounds an article.
HINTS = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices overlay paywall popup promo promoted promotion reader recommended related respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toc toolbar widget widgets".split())

_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
_LOOSE = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*+)([^>]*+)>?", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_PARTS = re.compile(r"[a-z]+")

#: Elements that hold a part of a page.
HOLDERS = frozenset("article main section div td body aside nav footer header form".split())


@dataclass
class Block:
    text: str
    words: int
    linked: int
    surrounding: bool
    hinted: bool
    article: int
    holder: int
    heading: bool

    @property
    def density(self) -> float:
        return self.linked / self.words if self.words else 0.0


def _place(name: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element surrounds the main text by what it is, and whether its class, id or role says so."""
    surrounding, hinted = name in ASIDE and not (name == "header" and in_article), False
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true":
            surrounding = True
        elif key == "style":
            surrounding = surrounding or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value))
        elif name not in ("html", "body", "main", "article") and any(p in HINTS for p in _PARTS.findall(value)):
            hinted = True
    return surrounding, hinted


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, bool, bool, bool]] = []
    # numbers of the open articles and containers, and how many there have been
    articles, holders, seen = [0], [0], [0]
    open_names: dict[str, int] = {}
    text: list[str] = []
    link_text: list[str] = []
    depth = {"aside": 0, "hinted": 0, "silent": 0, "link": 0, "heading": 0}

    def flush() -> None:
        body = " ".join(entities.unescape("".join(text)).split())
        if body:
            linked = len(entities.unescape(" ".join(link_text)).split())
            words = body.count(" ") + 1
            out.append(Block(body, words, min(linked, words), depth["aside"] > 0, depth["hinted"] > 0, articles[-1], holders[-1], depth["heading"] > 0))
        text.clear()
        link_text.clear()

    def pop() -> str:
        name, aside, hinted, article, holder, silent = stack.pop()
        if name in BLOCKS:
            flush()
        open_names[name] -= 1
        depth["aside"] -= aside
        depth["hinted"] -= hinted
        depth["silent"] -= silent
        if article:
            articles.pop()
        if holder:
            holders.pop()
        depth["link"] -= name == "a"
        depth["heading"] -= name in ("h1", "h2", "h3", "h4", "h5", "h6")
        return name

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at and not depth["silent"]:
            text.append(page[at:lt])
            if depth["link"]:
                link_text.append(page[at:lt])
        if lt == n:
            break
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        tag = _TAG.match(page, lt) or _LOOSE.match(page, lt)
        if not tag:
            if not depth["silent"]:
                text.append("<")
            at = lt + 1
            continue
        at = tag.end()
        name = tag[2].lower()
        if tag[1]:
            if open_names.get(name):
                while pop() != name:
                    pass
            elif name in BLOCKS:
                flush()
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if name in VOID:
            if name == "hr":
                flush()
            elif name == "br" and not depth["silent"]:
                text.append(" ")
            continue
        if name in BLOCKS:
            flush()
            while stack and stack[-1][0] in CLOSES_ITSELF.get(name, ()):
                pop()
            if name != "p" and stack and stack[-1][0] == "p":
                pop()
        if name == "body":
            while stack and stack[-1][0] == "head":
                pop()
        article, holder = name in ("article", "main"), name in HOLDERS
        aside, hinted = _place(name, tag[3], articles[-1] > 0)
        silent = name in SILENT
        if tag[3].endswith("/"):
            continue
        stack.append((name, aside, hinted, article, holder, silent))
        seen[0] += 1
        if article:
            articles.append(seen[0])
        if holder:
            holders.append(seen[0])
        open_names[name] = open_names.get(name, 0) + 1
        depth["aside"] += aside
        depth["hinted"] += hinted
        depth["silent"] += silent
        depth["link"] += name == "a"
        depth["heading"] += name in ("h1", "h2", "h3", "h4", "h5", "h6")
    flush()
    return out


NAMES = ("surrounding", "hinted", "unhinted_share", "in_article", "article_share", "holder_share", "heading", "words", "density", "words_before", "density_before", "words_after", "density_after")


def feature_rows(found: list[Block]) -> np.ndarray:
    """One row of ``NAMES`` per block; beyond the page's ends there are no words and no links.

    The shares compare unlinked words outside what surrounds: those of the block's article and of its container, each to
    the most that one article, or one container, has without a class that speaks against it. ``unhinted_share`` is how
    much of the text in articles (without any, in the page) stands under no such class.
    """
    if not found:
        return np.zeros((0, len(NAMES)))
    words, density = np.array([b.words for b in found], float), np.array([b.density for b in found])
    pad = lambda v, k: np.concatenate([[0.0], v[:-1]]) if k < 0 else np.concatenate([v[1:], [0.0]])
    free = np.array([0 if b.surrounding else b.words - b.linked for b in found], float)
    plain = np.where([b.hinted for b in found], 0.0, free)

    def share(groups: list[int], counted: np.ndarray) -> np.ndarray:
        _, place = np.unique(groups, return_inverse=True)
        most = np.bincount(place, weights=plain * counted).max()
        return np.minimum(np.bincount(place, weights=free)[place] / max(most, 1.0), 1.0)

    article = [b.article for b in found]
    inside = np.array(article) > 0 if any(article) else np.ones(len(found), bool)
    unhinted = np.full(len(found), (plain * inside).sum() / max((free * inside).sum(), 1.0))
    columns = [[b.surrounding for b in found], [b.hinted for b in found], unhinted, [a > 0 for a in article], share(article, np.array(article) > 0), share([b.holder for b in found], np.ones(len(found))), [b.heading for b in found]]
    return np.stack([*(np.asarray(c, float) for c in columns), words, density, pad(words, -1), pad(density, -1), pad(words, 1), pad(density, 1)], 1)


# The labelled table: small whole pages. [+n] is a run of n words of the main text, [n] one of n other words.
_NAV = "<nav><ul><li><a>[1]</a></li><li><a>[2]</a></li><li><a>[1]</a></li><li><a>[1]</a></li></ul></nav>"
_MENU = "<div><a>[1]</a> <a>[2]</a> <a>[1]</a></div><ul><li><a>[2]</a><li><a>[1]</a><li><a>[3]</a></ul>"
_STORY = "<h1>[+7]</h1><p>[+40]</p><p>[+12]</p><p>[+2]</p><p>[+75]</p><h2>[+3]</h2><p>[+28]</p><ul><li>[+6]</li><li>[+9]</li></ul><p>[+1]</p><p>[+33] <a>[+2]</a> [+4]</p><p>[+1] <a>[+1]</a></p><p>[+3] <a>[+4]</a></p>"
_SHORT = "<h1>[+5]</h1><p>[+22]</p><p>[+4]</p>"
_LINKS = "<ul><li><a>[5]</a></li><li><a>[7]</a></li><li><a>[4]</a></li></ul>"
LABELLED = (
    f"{_NAV}<div class=ad>[9]</div><article>{_STORY}</article><footer>[7]</footer>",
    f"{_NAV}<div class=ad>[14]</div><article>{_SHORT}</article><footer>[9]</footer>",
    f"{_NAV}<div class=cookie-notice><p>[30]</p></div><article>{_STORY}<div class=ad>[6]</div><p>[+25]</p><div class=newsletter><p>[14]</p></div></article><footer>[5]</footer>",
    f"{_MENU}<div>{_STORY}</div><div><article><h3><a>[5]</a></h3><p>[11]</p></article><article><h3><a>[6]</a></h3><p>[9]</p></article></div><div>[6]</div>",
    f"{_MENU}<div><h1>[+6]</h1><p>[+35]</p><p>[+50]</p><p>[+9]</p></div><div><article>[3]</article><article>[4]</article><article>[2]</article></div><p>[5]</p>",
    f"{_NAV}<article><div class=reader-content>{_STORY}</div></article><footer>[6]</footer>",
    f"{_NAV}<article><div class=reader-content>{_SHORT}</div></article><div class=ad>[8]</div><footer>[6]</footer>",
    f"{_NAV}<main><section class=social-history>{_STORY}</section></main><footer>[6]</footer>",
    f"{_NAV}<main><section class=social-history>{_SHORT}</section></main><footer>[9]</footer>",
    f"{_NAV}<article>{_STORY}</article><section id=comments><h2>[1]</h2><article><p>[24]</p></article><article><p>[38]</p></article><article><p>[3]</p></article></section><footer>[7]</footer>",
    f"{_NAV}<article>{_STORY}</article><div class=comments><div><p>[45]</p></div><div><p>[12]</p></div></div><aside><p>[20]</p></aside>",
    f"{_MENU}<div id=content>{_STORY}</div><div class=sidebar><h3>[2]</h3><p>[15]</p>{_LINKS}</div><div class=footer>[8]</div>",
    f"{_MENU}<div id=content>{_SHORT}<p>[+48]</p></div><div>[3]</div><div class=comment><p>[22]</p></div><div class=comment><p>[16]</p></div>",
    f"<header>[4]</header>{_NAV}<main><article>{_STORY}</article><section class=related><h2>[2]</h2>{_LINKS}</section></main><footer>[6]</footer>",
    f"{_NAV}<main><article>{_STORY}{_LINKS}<p>[+18]</p></article></main><footer>[6]</footer>",
    f"{_NAV}<main>{_LINKS}<h1>[+5]</h1><p>[+44]</p><p>[+31]</p>{_LINKS}</main><footer>[4]</footer>",
    f"<table><tr><td><a>[2]</a><br><a>[3]</a><br><a>[2]</a></td><td>{_STORY}</td></tr></table><p>[7]</p>",
    f"{_NAV}<article>{_STORY}<div class=sponsored><p>[26]</p></div><form><label>[3]</label></form></article><footer>[6]</footer>",
    f"{_MENU}<p>[4]</p><h1>[+6]</h1><p>[+50]</p><p>[+36]</p><p>[+64]</p><p>[3]</p>{_MENU}<p>[6]</p>",
    f"{_NAV}<div><a>[2]</a> [2] <a>[2]</a></div>{_MENU}<footer>[8]</footer>",
    f"{_MENU}<div class=content><div>{_SHORT}</div><div><p>[+60]</p></div><div><p>[+34]</p></div></div><div class=promo><p>[18]</p></div><div class=share><a>[1]</a> <a>[1]</a></div>",
    f"{_NAV}<div class=breadcrumbs><a>[1]</a> [1] <a>[2]</a></div><article><header><h1>[+8]</h1><p>[+5]</p></header><p>[+52]</p><figure><figcaption>[+9]</figcaption></figure><blockquote>[+15]</blockquote></article><div class=related>{_LINKS}</div>",
    f"<article>{_STORY}</article>",
    f"{_NAV}<article>{_SHORT}<div class=ad>[2]</div><aside>[4]</aside></article><section id=comments><article><p>[60]</p></article></section><footer>[6]</footer>",
    f"{_NAV}<article><h1>[+3]</h1><p>[+6]<p>[+2]<div class=ad>[3]</div></article><section id=comments><article><p>[13]</p></article><article><p>[5]</p></article></section><footer>[6]</footer>",
    f"{_NAV}<article><section><h1>[+6]</h1><p>[+120]</p><p>[+60]</p></section><section><h2>[+2]</h2><p>[+9]</p></section><section><h2>[+4]</h2><p>[+30]</p></section></article><footer>[6]</footer>",
    f"{_NAV}<article><div><p>[+90]</p></div><div><p>[+4]</p></div><div>[+30]</div><div class=ad>[5]</div><div><p>[+1]</p></div></article><div class=comments><div>[12]</div></div><footer>[6]</footer>",
    f"{_NAV}<article><h1>[+1]</h1><p>[+1]</p><p>[+45]</p>{_LINKS}</article><footer>[2]</footer>",
    f"<article>{_SHORT}{_LINKS}<p>[+30]</p>{_LINKS}</article>",
    "<div><a>[1]</a> <a>[1]</a></div><div>[+39]</div><div>[+33]</div><div><a>[1]</a> | <a>[1]</a></div>",
    f"<div><a>[2]</a> <a>[1]</a></div><div>[+60]</div>{_LINKS}<div>[+48]</div>{_LINKS}",
    f"<div>{_SHORT}</div>",
    "<p>[+24]</p>",
    "[+16]",
    "<h1>[+4]</h1><p>[+9]</p><p>[+40]</p><div class=ad>[8]</div><p>[+21]</p><p>[+6]</p>",
    f"<div class=post>{_SHORT}</div>{_LINKS}",
)
_RUN = re.compile(r"\[(\+?)(\d+)\]")


def labelled_table(scales: tuple[float, ...] = (0.5, 1.0, 2.5)) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows and labels of the labelled pages' blocks, each page as it is and without navigation and footer, at
    several lengths of its text."""
    rows, labels = [], []
    bare = [re.sub("<nav>.*?</nav>|<footer>.*?</footer>", "", page) for page in LABELLED]
    for page in dict.fromkeys((*LABELLED, *bare)):
        for scale in scales:
            words = lambda m: " ".join([f"{m[1] or '-'}w"] * max(1, round(int(m[2]) * (scale if int(m[2]) > 3 else 1))))  # noqa: B023, E731
            found = blocks(_RUN.sub(words, page))
            rows.append(feature_rows(found))
            labels.append(np.array([b.text.startswith("+") for b in found], float))
            # inside a navigation, footer or form the same blocks are none of the main text
            rows.append(np.concatenate([np.ones((len(found), 1)), rows[-1][:, 1:]], 1))
            labels.append(np.zeros(len(found)))
    return np.concatenate(rows), np.concatenate(labels)


@dataclass
class Node:
    column: int = -1
    cut: float = 0.0
    keep: bool = False
    low: "Node | None" = None
    high: "Node | None" = None

    def apply(self, rows: np.ndarray) -> np.ndarray:
        if self.low is None:
            return np.full(len(rows), self.keep)
        left = rows[:, self.column] <= self.cut
        out = np.empty(len(rows), bool)
        out[left], out[~left] = self.low.apply(rows[left]), self.high.apply(rows[~left])
        return out


def grow(rows: np.ndarray, keep: np.ndarray, depth: int = 12) -> Node:
    """A tree that cuts where the Gini impurity falls most; ties go to the first column and the lowest cut."""
    share = keep.mean() if len(keep) else 0.0
    if depth == 0 or share in (0.0, 1.0):
        return Node(keep=bool(share > 0.5))
    best = (-1.0, 0, 0.0)
    for c in range(rows.shape[1]):
        values = np.unique(rows[:, c])
        for cut in (values[:-1] + values[1:]) / 2:
            left = rows[:, c] <= cut
            p, q = keep[left].mean(), keep[~left].mean()
            gain = share * (1 - share) - left.mean() * p * (1 - p) - (1 - left.mean()) * q * (1 - q)
            if gain > best[0] + 1e-12:
                best = (gain, c, float(cut))
    if best[0] < 0:
        return Node(keep=bool(share > 0.5))
    left = rows[:, best[1]] <= best[2]
    return Node(best[1], best[2], False, grow(rows[left], keep[left], depth - 1), grow(rows[~left], keep[~left], depth - 1))


def train() -> Node:
    return grow(*labelled_table())


def main_text(page: str, tree: Node) -> str:
    found = blocks(page)
    return "\n".join(b.text for b, keep in zip(found, tree.apply(feature_rows(found))) if keep)


def extract(pages: DataFrame, tree: Node | None = None) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    model = tree or train()
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = [main_text(page.as_py() or "", model) for page in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(batches, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")
