"""URL rules, and block decisions carried over to aliases of a page.

Redirects and canonical links tie addresses that are one page. Connected
components over those edges spread a block to every address of the component;
an address that a rule allows stays allowed.

DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable
from html.entities import html5
from string import ascii_lowercase, ascii_uppercase
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from machinepulse.llm.components import connected_components


_CANONICAL = r"""(?is)<link(?=[\s/])[^>]*[\s"'/]rel\s*=\s*["']?\s*canonical(?=[\s"'/>])[^>]*>"""
_REFRESH = r"""(?is)<meta(?=[\s/])[^>]*[\s"'/]http-equiv\s*=\s*["']?\s*refresh(?=[\s"'/>])[^>]*>"""
# What is no markup: comments, and elements whose content is read as text.
_UNREAD = r"(?is)<!--.*?(?:-->|\z)|<(script|style|template|textarea|title)(?=[\s/>]).*?(?:</\1(?=[\s/>])|\z)"
_SCHEME = "^[a-zA-Z][a-zA-Z0-9+.-]*:"
_SITE = "^[^/?#]*://[^/?#]*"
# A character reference as attributes have it, text without any, or a lone &.
_PIECES = r"(?s)&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[a-zA-Z][a-zA-Z0-9]*(?:;|(?![=a-zA-Z0-9])))|[^&]+|&"
# Named references, and numbers that stand for letters of windows-1252.
_REFERENCES = html5 | {
    f"#{k}": bytes([k]).decode("cp1252") for k in range(128, 160) if k not in (129, 141, 143, 144, 157)
}


class Rule(NamedTuple):
    """Fits a host and its subdomains where the path begins with path."""

    verdict: str
    host: str
    path: str


def host_of(url: Column) -> Column:
    """Between the first :// and the next /, ? or #, A-Z lower-cased; empty if there is none."""
    host = F.regexp_extract(_after_scheme(url), "^([^/?#]*)", 1)
    return F.translate(host, ascii_uppercase, ascii_lowercase)


def path_of(url: Column) -> Column:
    """From the host's end up to ? or #; empty without ://."""
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def _ruling(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule as text, verdict) of the longest fitting rule, both null if none fits.

    Of equally long ones an allowing rule wins.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    ordered = sorted(rules, key=lambda r: (len(r.host + r.path), r.verdict == "allow"))
    for rule in ordered:
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name = F.when(fits, rule.host + rule.path).otherwise(name)
        verdict = F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def page_edges(pages: DataFrame) -> DataFrame:
    """(a, b): an address and where each of its canonical links and refreshes points.

    Links in comments, scripts, styles, templates, titles and text areas are none.
    """
    url, html = F.col("url"), F.coalesce("html", F.lit(""))
    # Most pages have neither and are only searched.
    html = F.when(
        html.rlike("(?i)canonical|refresh"), F.regexp_replace(html, _UNREAD, " ")
    ).otherwise("")
    links = F.regexp_extract_all(html, F.lit(_CANONICAL), F.lit(0))
    metas = F.regexp_extract_all(html, F.lit(_REFRESH), F.lit(0))
    targets = F.concat(
        F.transform(links, lambda tag: _attribute(tag, "href")), F.transform(metas, _refresh)
    )

    def target(to: Column) -> Column:
        return address(_resolved(F.col("a"), to))

    return (
        pages.where(url.isNotNull())
        .select(address(url).alias("a"), F.explode(targets).alias("to"))
        .where("to != ''")
        .select("a", _once(F.regexp_replace(_decoded(F.col("to")), r"^\s+|\s+$|[\t\r\n]", ""), target).alias("b"))
        .where("b IS NOT NULL")
    )


def address(url: Column) -> Column:
    """What a page is known by: the url up to #, scheme and host in lower case, no dot segments."""

    def cased(whole: Column, site: Column) -> Column:
        rest = F.substring(whole, F.length(site) + 1, F.length(whole))
        path = _once(F.regexp_extract(rest, "^[^?]*", 0), _without_dots)
        query = F.regexp_extract(rest, r"(?s)\?.*", 0)
        lower = F.translate(site, ascii_uppercase, ascii_lowercase)
        return F.when(site == "", whole).otherwise(F.concat(lower, path, query))

    def of(whole: Column) -> Column:
        return _once(F.regexp_extract(whole, _SCHEME + "//[^/?]*", 0), lambda site: cased(whole, site))

    return _once(F.substring_index(url, "#", 1), of)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value stands once in the plan however often use has it."""
    return F.get(F.transform(F.array(value), use), 0)


def _without_dots(path: Column) -> Column:
    """A path after its . and .. segments were followed."""
    segments = F.split(F.substring(path, F.lit(2), F.length(path)), "/", -1)
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda done, s: F.when(s == ".", done)
        .when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.concat(done, F.array(s))),
    )
    # What ends in a dot segment is a folder.
    end = F.when(path.rlike(r"/\.\.?$") & (F.size(kept) > 0), "/").otherwise("")
    return F.when(
        path.rlike(r"/\.\.?(/|$)"), F.concat(F.lit("/"), F.array_join(kept, "/"), end)
    ).otherwise(path)


def _first_group(text: Column, pattern: str) -> Column:
    """The one of the pattern's three groups that took part."""
    return F.concat(*(F.regexp_extract(text, pattern, k) for k in (1, 2, 3)))


def _attribute(tag: Column, name: str) -> Column:
    """The value of an attribute as spelled; empty if there is none."""
    return _first_group(
        tag, rf"""(?is)(?<![\w-]){name}\s*=\s*(?:"([^"]*)"|'([^']*)'|["']?([^"'\s>]+))"""
    )


def _refresh(tag: Column) -> Column:
    """Where a refresh leads, quoted or not, after its seconds; empty if it stays."""
    content = _attribute(tag, "content")
    start = r"^\s*(?:[\d.]*\s*[;,]?\s*url\s*=\s*|[\d.]+\s*[;,\s]\s*)"
    found = _first_group(content, rf"""(?is){start}(?:"([^"]*)|'([^']*)|([^"'].*))""")
    # A content without quotes ends at the first space.
    bare = F.regexp_extract(tag, r"""(?is)\burl\s*=\s*["']?([^"'\s>;]+)""", 1)
    return F.when(found != "", found).otherwise(bare)


def _decoded(text: Column) -> Column:
    """text with its character references replaced, as in the value of an attribute."""
    known = F.str_to_map(
        F.lit("\x02".join(f"{k}\x01{v}" for k, v in _REFERENCES.items())), F.lit("\x02"), F.lit("\x01")
    )

    def letter(point: Column) -> Column:
        plain = F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")
        return F.coalesce(F.try_element_at(known, F.concat(F.lit("#"), point)), plain)

    def point(number: Column) -> Column:
        valid = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        return F.when(valid, number).otherwise(0xFFFD)

    def number(p: Column) -> Column:
        # Anything longer than eight digits is no letter.
        digits = F.substring(F.regexp_extract(p, "^&#[xX]?0*([0-9a-fA-F]*)", 1), 1, 9)
        read = F.when(p.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits)
        return F.coalesce(read.try_cast("long"), F.lit(0))

    def piece(p: Column) -> Column:
        numbered = _once(number(p), lambda n: _once(point(n), letter))
        named = F.coalesce(F.try_element_at(known, F.substring(p, F.lit(2), F.length(p))), p)
        return F.when(p.rlike("^&#[xX]?[0-9a-fA-F]"), numbered).when(p.rlike("^&."), named).otherwise(p)

    pieces = F.regexp_extract_all(text, F.lit(_PIECES), F.lit(0))
    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(pieces, piece), "")).otherwise(text)


def _resolved(base: Column, to: Column) -> Column:
    """The url that a link on base means; null for one that is not of the form scheme://."""
    site = F.regexp_extract(base, _SITE, 0)
    folder = F.regexp_extract(base, f"{_SITE}(?:[^?#]*/)?", 0)
    folder = F.when((folder == "") | folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    return (
        F.when(to == "", F.lit(None))
        .when(to.rlike(f"{_SCHEME}//"), to)
        .when(to.rlike(_SCHEME), F.lit(None))
        .when(to.startswith("//"), F.concat(F.regexp_extract(base, "^[^/?#]*:(?=//)", 0), to))
        .when(to.startswith("/"), F.concat(site, to))
        .when(to.startswith("?"), F.concat(F.substring_index(base, "?", 1), to))
        .when(to.startswith("#"), base)
        .otherwise(F.concat(folder, to))
    )


def judge(pages: DataFrame, rules: list[Rule], redirects: DataFrame | None = None) -> DataFrame:
    """One row per page: page_id, url, host, path, rule, verdict (allow or block).

    The longest rule that fits decides. An address no rule fits is blocked if
    any alias of it, over any number of edges, is blocked by a rule, else it is
    allowed. redirects adds edges (a, b) to those in the pages. Null urls have
    an empty host and path, no rule, and are allowed. rules are a driver-side
    list and become one expression. Other columns are not looked at.
    """
    edges = page_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(
            redirects.select(address(F.col("a")).alias("a"), address(F.col("b")).alias("b"))
        )
    members = connected_components(edges)
    blocked = (
        members.where(_ruling(rules, host_of(F.col("node")), path_of(F.col("node")))[1] == "block")
        .select("component")
        .distinct()
    )
    tainted = members.join(blocked, "component", "left_semi").select("node")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = _ruling(rules, F.col("host"), F.col("path"))
    judged = (
        pages.select("page_id", "url")
        .select("*", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
        .select("*", rule.alias("rule"), verdict.alias("ruled"), address(F.col("url")).alias("address"))
        .join(tainted, F.col("address") == F.col("node"), "left")
    )
    spread = F.when(F.col("node").isNotNull(), "block").otherwise("allow")
    return judged.select(
        "page_id", "url", "host", "path", "rule", F.coalesce("ruled", spread).alias("verdict")
    )
