"""Main text of web pages by composite text density (Sun et al., 2011).

Every node of the page's tree has characters C, tags T, characters and tags of links LC and LT.
Its density is C / T, weighed down the more of it are links. A node's children's densities are
summed; the node with the largest sum holds the article.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed names of HTML elements by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg math".split())
DROPPED = RAW | frozenset(
    "head nav aside footer form button select option input label fieldset menu dialog object canvas audio video".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table "
    "tbody td tfoot th thead tr ul".split()
)
#: Elements that a new element of the kind closes, if one of them is open within the limit.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: Words of a class or id for what is no article: adverts and readers' comments, and others.
READERS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adsbygoogle sponsor sponsored comment comments disqus replies respond".split()
)
NOISE = READERS | frozenset(
    "banner breadcrumb breadcrumbs cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription "
    "promo promos promotion related recommended recommendations share sharing social sidebar widget widgets menu nav navbar "
    "navigation footer masthead toolbar pagination pager skip skiplink search login signup signin complementary contentinfo dialog".split()
)
#: The same for parts of a page outside its article.
OUTSIDE = NOISE | {"header", "topbar"}
#: Words for the shape or place of a block, which may stand beside the words above.
LAYOUT = frozenset(
    "area article bar block blog body bottom box button buttons center closed col column container content count element entry "
    "footer form frame global group header icons inline inner item items js left level lg link links list main md media message "
    "middle module new open outer page panel policy position post row right root row section site slot sm sticky tab text the "
    "thread title top unit view visible wrap wrapper zone".split()
)
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*'|[^\s>]*+))*+)(?:>|\Z)",
    re.S,
)
#: One attribute: its name, and its value in double, single or no quotes.
ATTRIBUTE = re.compile(r"([^\s/>=\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'][^\s>]*)))?|\"[^\"]*\"|'[^']*'")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


def _says(mark: str, words: frozenset) -> bool:
    """Whether a class or id has a name that consists of such words, layout words and numbers only.

    ``comment-list`` and ``ad-1`` do; ``related-work`` names a topic.
    """
    for name in mark.split():
        parts = [p.lower() for p in PARTS.findall(name)]
        if any(p in words for p in parts) and all(p in words or p in LAYOUT or p.isdigit() for p in parts):
            return True
    return False


def _is_noise(name: str, attributes: str, in_article: bool) -> bool | None:
    """Whether an element is dropped whole by its name, or by what its class, id or role say.

    None leaves a marked block to what it holds. Headings are never marked; paragraphs only as
    adverts or readers' comments.
    """
    if name in DROPPED or name == "header" and not in_article:
        return True
    if not attributes or name in ("html", "body", "main"):
        return False
    found: dict[str, str] = {}
    for key, *values in ATTRIBUTE.findall(attributes):
        found.setdefault(key.lower(), "".join(values))
    style = found.get("style", "").lower().replace(" ", "")
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in style:
        return True
    if name in HEADINGS:
        return False
    words = READERS if name in ("p", "article") else NOISE if in_article else OUTSIDE
    marked = any(_says(found[k], words) for k in ("class", "id") if k in found)
    if not marked and (name == "p" or found.get("role", "").lower() not in ROLES):
        return False
    return None if name in BLOCKS else True


class Page:
    """The tree of one page as parallel lists, nodes in page order; blocks of text point to nodes.

    ``chars`` and the other counts leave out dropped elements and white space.
    """

    def __init__(self, html: str):
        self.parent, self.names = [-1], ["#page"]
        self.chars, self.link_chars = [0], [0]
        self.blocks: list[tuple[int, str]] = []
        self._run: list[str] = []
        self._run_node = 0
        self._suspects: list[int] = []
        self._read(html)
        if self._suspects:
            self._drop_suspects()
        n = len(self.parent)
        self.tags, self.link_tags = [0] * n, [0] * n
        for k in range(n - 1, 0, -1):
            p = self.parent[k]
            self.chars[p] += self.chars[k]
            self.link_chars[p] += self.link_chars[k]
            if self.chars[k]:
                self.tags[p] += self.tags[k] + 1
                self.link_tags[p] += self.link_tags[k] + (self.names[k] == "a")

    def _drop_suspects(self) -> None:
        """Leaves out the marked blocks, unless one holds the page's first heading or its ``main`` element."""
        n = len(self.parent)
        holds = [name == "main" for name in self.names]
        if "h1" in self.names:
            holds[self.names.index("h1")] = True
        for k in range(n - 1, 0, -1):
            holds[self.parent[k]] = holds[self.parent[k]] or holds[k]
        gone = [False] * n
        for k in self._suspects:
            gone[k] = not holds[k]
        for k in range(1, n):
            gone[k] = gone[k] or gone[self.parent[k]]
            if gone[k]:
                self.chars[k] = self.link_chars[k] = 0
        self.blocks = [(k, text) for k, text in self.blocks if not gone[k]]

    def _break(self, node: int) -> None:
        """Ends the block that is being read; the next one belongs to ``node``."""
        text = " ".join("".join(self._run).split())
        if text:
            self.blocks.append((self._run_node, text))
        self._run = []
        self._run_node = node

    def _read(self, html: str) -> None:
        stack, is_open, quiet, at = [0], Counter(), 0, 0

        def text(part: str) -> None:
            if quiet:
                return
            part = unescape(part)
            size = len("".join(part.split()))
            self.chars[stack[-1]] += size
            if is_open["a"]:
                self.link_chars[stack[-1]] += size
            self._run.append(part)

        def close(depth: int) -> None:
            nonlocal quiet
            while len(stack) > depth:
                name = self.names[stack.pop()]
                is_open[name] -= 1
                if name in BLOCKS and not quiet:
                    self._break(stack[-1])
                if quiet >= len(stack) + 1:
                    quiet = 0
                    self._run_node = stack[-1]

        def close_nearest(names: frozenset | set, limits: frozenset | set) -> None:
            for k in range(len(stack) - 1, 0, -1):
                if self.names[stack[k]] in names:
                    close(k)
                    return
                if self.names[stack[k]] in limits:
                    return

        while at < len(html):
            found = TOKEN.search(html, at)
            if not found:
                text(html[at:])
                break
            if found.start() > at:
                text(html[at : found.start()])
            at = found.end()
            name = (found[3] or "").lower()
            if not name:
                text(found[1] or "")
                continue
            if found[2]:
                if is_open[name]:
                    close_nearest({name}, frozenset())
                continue
            if name in BLOCKS and is_open["p"]:  # a block ends an open paragraph
                close_nearest({"p"}, {"table", "button", "object"})
            if name == "a" and is_open["a"]:
                close_nearest({"a"}, frozenset())
            if name in CLOSES:
                close_nearest(*CLOSES[name])
            if name in VOID:
                if not quiet:
                    if name in BLOCKS:
                        self._break(stack[-1])
                    elif name == "br":
                        self._run.append(" ")
                continue
            node = len(self.parent)
            self.parent.append(stack[-1])
            self.names.append(name)
            self.chars.append(0)
            self.link_chars.append(0)
            if name in ("svg", "math") and found[4].endswith("/"):
                continue
            if name in RAW:
                end = re.compile(f"</{re.escape(name)}\\b[^>]*>", re.I).search(html, at)
                at = end.end() if end else len(html)
                continue
            if not quiet and name in BLOCKS:
                self._break(node)
            stack.append(node)
            noise = not quiet and _is_noise(name, found[4], is_open["article"] + is_open["main"] > 0)
            if noise is None:
                self._suspects.append(node)
            if noise:
                if self._run and name not in BLOCKS:
                    self._run.append(" ")
                quiet = len(stack)
            is_open[name] += 1
        close(1)
        self._break(0)

    def densities(self, body: int) -> list[float]:
        """Composite text density of every node."""
        share = self.link_chars[body] / max(1, self.chars[body])
        out = []
        for c, t, lc, lt in zip(self.chars, self.tags, self.link_chars, self.link_tags):
            t, lt, plain, lc = max(1, t), max(1, lt), max(1, c - lc), max(1, lc)
            base = math.log(c / plain * lc + share * c + math.e)
            out.append(c / t * math.log(max(1.0, c / lc * t / lt)) / math.log(max(base, 1.01)) if c else 0.0)
        return out

    def article(self) -> str:
        """Blocks of the node with the largest sum of densities, in page order.

        If that node stands in an ``article`` or ``main`` element, the element counts. The
        threshold is the least density on the path from the body to the node: a subtree below it
        is left out if links make up most of it. Short headings and paragraphs stay.
        """
        n = len(self.parent)
        body = self.names.index("body") if "body" in self.names else 0
        density = self.densities(body)
        sums = [0.0] * n
        for k in range(1, n):
            sums[self.parent[k]] += density[k]
        best = max(range(n), key=lambda k: (sums[k], self.chars[k], -k))
        path, k = [], best
        while k >= 0:
            path.append(density[k])
            if self.names[k] in ("article", "main"):
                best = k
            if k == body:
                break
            k = self.parent[k]
        threshold = min(path)
        keep = [False] * n
        keep[best] = True
        for k in range(best + 1, n):
            keep[k] = keep[self.parent[k]] and not (density[k] < threshold and 2 * self.link_chars[k] > self.chars[k])
        return "\n".join(text for node, text in self.blocks if keep[node])


def main_text(html: str) -> str:
    return Page(html).article()


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for every page; no shuffle.

    A missing or empty page, and a page without text outside dropped elements, gives the empty
    text. Unclosed and stray tags are read as browsers do for paragraphs, lists and tables;
    repeated rows stay, other columns are not read. A page is read in time linear in its
    length.
    """
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}
    slim = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                texts = [main_text(h.as_py() or "") for h in b.column("html")]
                yield pa.RecordBatch.from_arrays(
                    [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    return slim.mapInArrow(extracted, f"page_id {kinds[id_col]}, url {kinds[url_col]}, text string, n_chars long")
