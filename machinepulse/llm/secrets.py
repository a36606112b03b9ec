"""Secrets in texts: three fixed patterns, and strings of high sliding-window entropy.

Candidate strings are long runs of characters that keys are made of. A window
slides over each; counts per character are kept up to date by the character
that enters and the one that leaves, and with them the entropy, as a sum of
whole numbers so that equal windows give equal sums everywhere. Each character
class has its own threshold. An allow-list suppresses what looks random but is
not secret.

DataFrame functions only, no shuffle.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

ASSIGN = (
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"


class CharacterClass(NamedTuple):
    """bits: least entropy per character of a window that counts as random."""

    name: str
    pattern: str
    bits: float


# Narrowest first; the first that fits a candidate is its class.
CLASSES = (
    CharacterClass("hex", r"^[0-9a-fA-F]+$", 3.0),
    CharacterClass("upper", r"^[A-Z0-9]+$", 3.3),
    CharacterClass("any", r"^[A-Za-z0-9+/_=-]+$", 3.7),
)
# Words and words joined by signs, numbers, UUIDs, and values meant as examples.
ALLOWED = (
    r"^[+/_=-]*[A-Za-z]?[a-z]*(?:[+/_=-]+[A-Za-z]?[a-z]*)*$",
    r"^[A-Z]+(?:[+/_=-]+[A-Z]*)*$",
    r"^[0-9+/_=-]+$",
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"(?i)example|placeholder|changeme|xxxxxx",
)
KINDS = ("assign", "access", "hex", "entropy")
_SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_SCALE = 1_000_000
_BLOCK = 256


def weights(window: int = WINDOW) -> list[int]:
    """n * log2(n) in millionths, for a character that a window holds n times."""
    return [0, *(round(n * math.log2(n) * _SCALE) for n in range(1, window + 1))]


def most_weight(bits: float, window: int = WINDOW) -> int:
    """The sum of weights up to which a window has at least so many bits per character."""
    return math.floor((math.log2(window) - bits) * window * _SCALE)


def find(
    docs: DataFrame,
    text: str = "text",
    name: str = "secrets",
    allowed: tuple[str, ...] = ALLOWED,
    window: int = WINDOW,
) -> DataFrame:
    """docs with an array column name of structs (start, kind_order, end, kind).

    Places are code points from 0, end exclusive, ordered by start and then by
    kind as in KINDS. A pattern's matches are the leftmost ones that do not
    overlap, of which those with a value of 6 characters (assign), 20 (access)
    or 24 (hex) count. An entropy span reaches from the first to the last
    window of a candidate that is random enough. Null and empty texts have an
    empty array. A column called name is replaced.
    """
    # What no column of the input begins with.
    own = "__"
    while any(column.lower().startswith(own) for column in docs.columns):
        own += "_"
    whole = f"{own}text"
    plain = docs.select("*", F.coalesce(F.col(text), F.lit("")).alias(whole))
    found = _matches(plain, whole, f"{own}assign", ASSIGN, 2, 6)
    found = _matches(found, whole, f"{own}access", ACCESS, 0, 20)
    found = _matches(found, whole, f"{own}hex", HEX, 0, 24)
    found = _matches(found, whole, f"{own}entropy", CANDIDATE, 0, window)
    found = found.withColumn(
        f"{own}entropy",
        F.filter(
            F.transform(
                F.filter(f"{own}entropy", lambda c: ~_any(c["value"], allowed)),
                lambda c: _random_part(c, window),
            ),
            lambda c: c["end"] > c["start"],
        ),
    )
    tagged = [_tagged(f"{own}{kind}", kind, order) for order, kind in enumerate(KINDS)]
    return found.withColumn(name, F.array_sort(F.concat(*tagged))).drop(
        whole, *(f"{own}{kind}" for kind in KINDS)
    )


def _tagged(spans: str, kind: str, order: int) -> Column:
    return F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"),
            F.lit(order).alias("kind_order"),
            s["end"].alias("end"),
            F.lit(kind).alias("kind"),
        ),
    )


def _any(value: Column, patterns: tuple[str, ...]) -> Column:
    matched = F.lit(False)
    for pattern in patterns:
        matched = matched | value.rlike(pattern)
    return matched


def _matches(
    df: DataFrame, source: str, name: str, pattern: str, group: int, least: int
) -> DataFrame:
    """A column of (start, end, value) for the matches whose group has least characters.

    Splitting by the pattern gives what lies between the matches, and so, added
    up, their places. Most texts match nowhere and are only scanned once.
    """
    text = F.col(source)
    hit = text.rlike(pattern)
    whole, value, gap = f"{name}_m", f"{name}_v", f"{name}_g"
    df = df.select(
        "*",
        F.when(hit, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias(whole),
        F.when(hit, F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).alias(value),
        F.when(hit, F.split(text, pattern, -1)).alias(gap),
    )
    steps = F.zip_with(
        F.zip_with(
            F.slice(gap, 1, F.size(whole)),
            whole,
            lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("size")),
        ),
        value,
        lambda s, v: F.struct(s["gap"].alias("gap"), s["size"].alias("size"), v.alias("value")),
    )
    df = df.withColumn(whole, steps).drop(value, gap)
    placed = F.filter(_placed(F.col(whole)), lambda s: F.length(s["value"]) >= least)
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return df.withColumn(name, F.coalesce(placed, empty)).drop(whole)


def _placed(steps: Column) -> Column:
    """Running places of the matches, block by block so that long lists stay cheap."""
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / _BLOCK).cast("int")),
        lambda b: F.slice(steps, b * _BLOCK + 1, _BLOCK),
    )
    length = lambda block: F.aggregate(
        block, F.lit(0), lambda n, s: n + s["gap"] + s["size"]
    )
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def places(block: Column, at: Column) -> Column:
        return F.aggregate(
            block,
            F.struct(at.alias("at"), empty.alias("out")),
            lambda acc, s: F.struct(
                (acc["at"] + s["gap"] + s["size"]).alias("at"),
                F.concat(
                    acc["out"],
                    F.array(
                        F.struct(
                            (acc["at"] + s["gap"]).alias("start"),
                            (acc["at"] + s["gap"] + s["size"]).alias("end"),
                            s["value"].alias("value"),
                        )
                    ),
                ).alias("out"),
            ),
            lambda acc: acc["out"],
        )

    return F.flatten(
        F.transform(
            blocks,
            lambda block, i: places(
                block,
                F.aggregate(
                    F.slice(blocks, F.lit(1), i), F.lit(0), lambda n, earlier: n + length(earlier)
                ),
            ),
        )
    )


def _random_part(candidate: Column, window: int) -> Column:
    """(start, end) from the first to the last random window; empty if there is none."""
    value = candidate["value"]
    limit = F.lit(None).cast("long")
    for kind in reversed(CLASSES):
        limit = F.when(value.rlike(kind.pattern), most_weight(kind.bits, window)).otherwise(limit)
    table = F.array(*(F.lit(w).cast("long") for w in weights(window)))
    at = lambda i: F.instr(F.lit(_SYMBOLS), F.substring(value, i, 1)) - 1

    def change(counts: Column, symbol: Column, by: int) -> tuple[Column, Column]:
        """Counts after one occurrence more or less, and the change of the sum."""
        n = F.get(counts, symbol)
        new = F.transform(counts, lambda c, i: F.when(i == symbol, c + by).otherwise(c))
        return new, F.get(table, n + by) - F.get(table, n)

    def step(acc: Column, i: Column) -> Column:
        left = F.when(i > window, at(i - window)).otherwise(F.lit(-1))
        fewer, lost = change(acc["counts"], left, -1)
        more, won = change(fewer, at(i), 1)
        total = acc["total"] + F.coalesce(lost, F.lit(0)) + won
        random = (i >= window) & (total <= limit)
        return F.struct(
            more.alias("counts"),
            total.alias("total"),
            F.when(random & acc["first"].isNull(), i - window).otherwise(acc["first"]).alias("first"),
            F.when(random, i).otherwise(acc["last"]).alias("last"),
        )

    zero = F.struct(
        F.array_repeat(F.lit(0), len(_SYMBOLS)).alias("counts"),
        F.lit(0).cast("long").alias("total"),
        F.lit(None).cast("int").alias("first"),
        F.lit(None).cast("int").alias("last"),
    )
    return F.aggregate(
        F.sequence(F.lit(1), F.length(value)),
        zero,
        step,
        lambda acc: F.struct(
            (candidate["start"] + F.coalesce(acc["first"], F.lit(0))).alias("start"),
            (candidate["start"] + F.coalesce(acc["last"], F.lit(0))).alias("end"),
        ),
    )
