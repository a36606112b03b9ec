"""Main text of web pages by composite text density.

Every node of the page's tree gets its characters per tag, adjusted for how
many of them are links. A node's sum is that of its children's densities. From
the node with the largest sum the path up to the body gives the threshold, its
smallest density; every node below the body that reaches it and lies outside
what is chosen already contributes its subtree of largest sum. Elements that are
never part of an article (menus, scripts, adverts, comments of readers and so
on) count as no text. Names alone, and forms, never remove what holds the
article or most of the page's text. The choice is widened to the article or main
element around it; of a main element, lists of links under the threshold stay out.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from machinepulse.llm.common import bounded_batches

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    # A page cut short within a tag that has no name yet.
    r"|</?\Z"
    r"""|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)"""
    r"""(?P<attrs>[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+|[^>]*+)(?:>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
_VALUE = re.compile(r"""=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)""")
_RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "xmp", "noframes"}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main "
    "menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_NEVER = set(
    "head nav aside footer button select svg canvas object audio video dialog menu map "
    "datalist math".split()
)
# Noise too, but some pages are wrapped in one as a whole.
_WRAPPERS = {"form", "fieldset"}
_NOISE_NAMES = set(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion "
    "cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe "
    "subscription sidebar widget menu nav navbar navigation breadcrumb breadcrumbs footer header "
    "masthead topbar toolbar comment comments disqus reply replies respond share sharing social "
    "related recommended recommendations outbrain taboola pagination pager login signup "
    "copyright disclaimer".split()
)
# Compounds written as one word, such as cookiebar or navbarleft.
_NOISE_BEGINNING = re.compile(
    r"advert|cookie|sidebar|newsletter|breadcrumb|sponsor|navbar|subscri|disqus|paginat|commentlist"
)
# What readers write, of whatever length.
_READERS = set("comment comments disqus reply replies respond".split())
# Names that are everyday words too: noise only where at most words of layout
# follow, as in share-buttons, not in share-price.
_SUBJECTS = set(
    "ad ads advertising share sharing social related recommended recommendations comment notice "
    "notices promotion subscription disclaimer copyright consent cookie cookies menu navigation "
    "sponsor sponsored overlay newsletter reply".split()
)
_LAYOUT = set(
    "a area article articles bar banner block body bottom box btn button buttons card cards "
    "center col column container content count counter desktop dropdown entries entry fixed form "
    "foot footer grid group head header heading horizontal icon icons inline inner item items "
    "label large left leaderboard link links list main media mobile module network networks news "
    "outer overlay page pages panel placeholder popup post posts primary rail rectangle right row "
    "secondary section sections small slot slots stories story sticky tab tabs text thread "
    "title toggle toolbar tools top unit units vertical video videos view widget widgets wrap "
    "wrapper zone".split()
)
# The parts of a compound after one of these say what is there or not there beside the node.
_BESIDE = {"no", "has", "with", "without"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_NOISE_ROLES = set(
    "navigation banner contentinfo complementary search form dialog alert menu menubar".split()
)
_STRUCTURE = {"html", "body", "article", "main"}
# Elements that end when one of the same group begins beside them.
_SIBLINGS = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "option": {"option"},
}
_HOLDERS = {"ul", "ol", "dl", "table", "select", "menu", "body", "html", "article", "div"}


class Page:
    """The tree of one page: parents before children, and its events in page order.

    An event is (node, text); text is None where a block begins or ends, and a
    space for a line break.
    """

    def __init__(self, source: str) -> None:
        self.tags, self.parent, self.noise = ["#root"], [0], [False]
        # Nodes whose class or id names noise, and whether it names readers' comments.
        self._named: dict[int, bool] = {}
        self.first, self.last = [0], [0]
        self.events: list[tuple[int, str | None]] = []
        self._open, self._counts = [0], {}
        self._parse(source)
        while len(self._open) > 1:
            self._close()
        self.last[0] = len(self.events)
        if self._named:
            self._settle()

    def _parse(self, source: str) -> None:
        at, end = 0, len(source)
        while at < end:
            match = _MARKUP.search(source, at)
            self._text(source[at : match.start() if match else end])
            if not match:
                break
            at = match.end()
            tag = match["tag"]
            if not tag:
                continue
            tag = tag.lower()
            if match["end"]:
                self._end(tag)
            elif tag in _RAW:
                stop = re.compile(rf"</{tag}\s*(?:>|\Z)", re.I).search(source, at)
                at = stop.end() if stop else end
            else:
                self._begin(tag, match["attrs"])

    def _text(self, text: str) -> None:
        node = self._open[-1]
        if text and not self.noise[node]:
            self.events.append((node, html.unescape(text) if "&" in text else text))

    def _begin(self, tag: str, attrs: str) -> None:
        if tag in _BLOCKS and self._counts.get("p"):
            self._close_until({"p"}, _HOLDERS - {"body", "html"})
        if tag in _SIBLINGS:
            self._close_until(_SIBLINGS[tag], _HOLDERS)
        parent = self._open[-1]
        node = len(self.tags)
        self.tags.append(tag)
        self.parent.append(parent)
        self.noise.append(self.noise[parent] or self._is_noise(tag, attrs))
        if not self.noise[node]:
            names = self._noise_names(tag, attrs)
            if names or tag in _WRAPPERS:
                self._named[node] = bool(names & _READERS)
        if tag in _BLOCKS:
            self.events.append((node, None))
        self.first.append(len(self.events))
        self.last.append(len(self.events))
        if tag == "br" and not self.noise[node]:
            self.events.append((parent, " "))
        if tag not in _VOID and not attrs.endswith("/"):
            self._open.append(node)
            self._counts[tag] = self._counts.get(tag, 0) + 1

    def _end(self, tag: str) -> None:
        if self._counts.get(tag):
            while self.tags[self._close()] != tag:
                pass

    def _close_until(self, ending: set[str], barriers: set[str]) -> None:
        """Close open elements up to the outermost of ending that no barrier shields."""
        for depth in range(len(self._open) - 1, 0, -1):
            tag = self.tags[self._open[depth]]
            if tag in ending:
                while len(self._open) > depth:
                    self._close()
                return
            if tag in barriers:
                return

    def _close(self) -> int:
        node = self._open.pop()
        self._counts[self.tags[node]] -= 1
        self.last[node] = len(self.events)
        if self.tags[node] in _BLOCKS:
            self.events.append((node, None))
        return node

    def _is_noise(self, tag: str, attrs: str) -> bool:
        if tag in _NEVER:
            return True
        if tag == "header":
            return not self._in_article()
        if tag in _STRUCTURE or not attrs.strip():
            return False
        for name, value in _ATTRIBUTE.findall(attrs):
            name, value = name.lower(), value.strip("\"'").lower()
            if name == "role" and value in _NOISE_ROLES:
                return True
            if name == "aria-hidden" and value == "true":
                return True
            if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return True
        # What is left are names without a value.
        return bool(re.search(r"(?:^|\s)hidden\s*(?:[\s/=]|$)", _VALUE.sub("= ", attrs), re.I))

    def _noise_names(self, tag: str, attrs: str) -> set[str]:
        """The parts of class and id that name noise."""
        if tag in _STRUCTURE or not attrs.strip():
            return set()
        names = set()
        for name, value in _ATTRIBUTE.findall(attrs):
            if name.lower() in ("class", "id"):
                for compound in value.strip("\"'").lower().split():
                    names |= _noise_parts(compound)
        # What heads an article is part of it.
        if names == {"header"} and (tag in _HEADINGS or self._in_article()):
            return set()
        return names

    def _settle(self) -> None:
        """Make noise of forms and of nodes named so, unless they hold the article or most of the text.

        The article is the longest article element, and the longest main. An
        article elsewhere that is a quarter as long as the node, or any text
        elsewhere beside readers' comments, speaks against the node.
        """
        n = len(self.tags)
        plain, linked, in_link = [0] * n, [0] * n, [False] * n
        for node in range(1, n):
            in_link[node] = self.tags[node] == "a" or in_link[self.parent[node]]
        for node, text in self.events:
            if text:
                (linked if in_link[node] else plain)[node] += len(text) - text.count(" ")
        for node in range(n - 1, 0, -1):
            plain[self.parent[node]] += plain[node]
            linked[self.parent[node]] += linked[node]
        body = self.tags.index("body") if "body" in self.tags else 0
        holders, longest = set(), 0
        for tag in ("article", "main"):
            held = max((i for i in range(n) if self.tags[i] == tag), key=lambda i: plain[i], default=0)
            longest = max(longest, plain[held] if held else 0)
            while held and plain[held] and held not in holders:
                holders.add(held)
                held = self.parent[held]
        for node in range(1, n):
            if self.noise[self.parent[node]]:
                self.noise[node] = True
            elif node in self._named and node not in holders:
                if self._named[node]:
                    most = not longest and 10 * plain[node] > 9 * plain[body]
                else:
                    most = 2 * plain[node] > plain[body] and 4 * longest < plain[node]
                self.noise[node] = not most
        self.events = [
            (node, "" if text and self.noise[node] else text) for node, text in self.events
        ]

    def in_link(self, node: int) -> bool:
        while node and self.tags[node] != "a":
            node = self.parent[node]
        return bool(node)

    def _in_article(self) -> bool:
        return any(self.tags[n] in ("article", "main") for n in self._open)

    def text(self, node: int) -> Iterator[str]:
        """The blocks of a subtree in page order, white space collapsed, empty ones left out."""
        block: list[str] = []
        for _, text in [*self.events[self.first[node] : self.last[node]], (0, None)]:
            if text is not None:
                block.append(text)
            elif block:
                joined = " ".join("".join(block).split())
                if joined:
                    yield joined
                block = []


def _noise_parts(compound: str) -> set[str]:
    """The parts of one name that say it is noise, such as sidebar in left-sidebar."""
    parts = [p for p in re.split(r"[^a-z0-9]+", compound) if p]
    beside = next((i for i, p in enumerate(parts) if p in _BESIDE), len(parts))
    parts = parts[:beside]
    found = set()
    for i, part in enumerate(parts):
        if part in _SUBJECTS:
            rest = parts[i + 1 :]
            if all(p in _LAYOUT or p in _NOISE_NAMES or re.search(r"\d", p) for p in rest):
                found.add(part)
        elif part in _NOISE_NAMES or _NOISE_BEGINNING.match(part):
            found.add(part)
    return found


def densities(page: Page) -> tuple[list[float], list[float], int]:
    """Composite density and sum of child densities per node, and the body's place."""
    n = len(page.tags)
    chars, tags, link_chars, link_tags = ([0] * n for _ in range(4))
    for node, text in page.events:
        if text:
            chars[node] += len(text) - text.count(" ")
    body = page.tags.index("body") if "body" in page.tags else 0
    for node in range(n - 1, 0, -1):
        if page.noise[node]:
            continue
        is_link = page.tags[node] == "a"
        if is_link:
            link_chars[node], link_tags[node] = chars[node], link_tags[node]
        up = page.parent[node]
        chars[up] += chars[node]
        tags[up] += tags[node] + 1
        link_chars[up] += link_chars[node]
        link_tags[up] += link_tags[node] + is_link
    link_share = link_chars[body] / max(chars[body], 1)
    density, total = [0.0] * n, [0.0] * n
    for node in range(n - 1, -1, -1):
        c, t = chars[node], max(tags[node], 1)
        if c:
            lc, lt = link_chars[node], link_tags[node]
            base = math.log(c / max(c - lc, 1) * lc + link_share * c + math.e)
            ratio = (c / max(lc, 1)) * (t / max(lt, 1))
            # One is added to both, so that the logarithm exists for a base of
            # one and no text has a density of nothing.
            density[node] = c / t * math.log(1 + ratio) / math.log(1 + base)
        if node:
            total[page.parent[node]] += density[node]
    return density, total, body


def main_text(source: str | None) -> str:
    """The text of the article of a page, its blocks joined by a space."""
    if not source:
        return ""
    page = Page(source)
    density, total, body = densities(page)
    # Best sum in each subtree: (sum, node), earlier nodes winning ties.
    best = [(total[i] if density[i] else -1.0, i) for i in range(len(total))]
    for node in range(len(best) - 1, 0, -1):
        up = page.parent[node]
        if best[node][0] > best[up][0]:
            best[up] = best[node]
    chosen = best[body][1]
    if not density[body]:
        return ""
    if not any(total[i] for i in range(len(total))):
        # Text directly in the body, without any element around it.
        return " ".join(page.text(body))
    threshold, node = density[chosen] or density[body], chosen
    while node != body and node:
        threshold = min(threshold, density[node])
        node = page.parent[node]
    threshold = min(threshold, density[body])
    around = _articles(page)
    marked = {around[chosen]}
    # Parents come before children, so this goes down from the body.
    below, inside = [False] * len(page.tags), [False] * len(page.tags)
    for node in range(body, len(page.tags)):
        up = page.parent[node]
        below[node] = node == body or below[up]
        inside[node] = node in marked or inside[up]
        if below[node] and node != body and not inside[node] and density[node] >= threshold:
            found = around[best[node][1] if best[node][0] > 0 else node]
            marked.add(found)
            inside[node] = found <= node
    blocks, end = [], -1
    for node in sorted(marked):
        if page.first[node] >= end:
            if page.tags[node] == "main":
                _without_link_lists(page, node, density, threshold, chosen)
            blocks += page.text(node)
            end = max(end, page.last[node])
    return " ".join(blocks)


def _without_link_lists(
    page: Page, main: int, density: list[float], threshold: float, chosen: int
) -> None:
    """Leave out parts of a main element that are mostly links and too thin for the threshold.

    An article says what belongs to it, a main often holds lists of other pages as well.
    """
    for node in range(main + 1, len(page.tags)):
        if page.first[node] >= page.last[main]:
            break
        low, high = page.first[node], page.last[node]
        if density[node] >= threshold or low <= page.first[chosen] < high or low == high:
            continue
        plain = linked = 0
        for at in range(low, high):
            owner, text = page.events[at]
            if text:
                size = len(text) - text.count(" ")
                plain, linked = (plain, linked + size) if page.in_link(owner) else (plain + size, linked)
        if linked > plain and page.tags[node] in _BLOCKS:
            page.events[low:high] = [(o, "" if t else t) for o, t in page.events[low:high]]


def _articles(page: Page) -> list[int]:
    """For every node the outermost article or main element around it, or else the node."""
    around = list(range(len(page.tags)))
    for node, up in enumerate(page.parent):
        if page.tags[around[up]] in ("article", "main"):
            around[node] = around[up]
    return around


def extract(pages: DataFrame, source: str = "html", name: str = "text") -> DataFrame:
    """pages with a string column name, the main text of the whole html.

    Null and empty pages, and pages without text, give an empty text. A column
    called name is replaced. Each page is read in one task on its own, so
    neither ties nor repeated rows matter.
    """
    bounded_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(page) for page in batch], dtype=object)

    return pages.withColumn(name, text(F.col(source)))
