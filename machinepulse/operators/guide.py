"""Maintenance-guide pages: lookup by machine type, listings, profiles.

Pages come as rows (guide_id, position, page, content), one row per page of a
guide. Which pages belong to which machine type is a fixed table, so every
per-guide group below holds at most the pages that table names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from machinepulse.functions.numbers import whole_half_up

# Guide pages per machine type, and pages every type gets.
TYPE_PAGES = {
    "furnace": (6, 7),
    "conveyor": (8,),
    "slurry_pump": (10, 11),
    "motor": (12, 13),
}
TYPE_ALIASES = {"slurry pump": "slurry_pump"}
ALWAYS_PAGES = (7, 17, 18, 19, 20, 21)

# Keyword labels of a page, each with the words that earn it.
PAGE_KEYWORDS = {
    "refractory": ("refractory",),
    "bearing": ("bearing",),
    "cavitation": ("cavitation",),
    "impeller": ("impeller",),
    "vibration": ("vibration",),
    "temperature": ("temperature",),
    "pressure": ("pressure",),
    "safety/urgent": ("safety", "urgent"),
    "output-format": ("output format",),
    "priority": ("priority",),
    "workflow": ("workflow",),
}

# Page header, separator between pages, shown length of a line.
PAGE_HEADER = "--- Page %d ---"
PAGE_SEPARATOR = "\n\n"
LINE_LENGTH = 80

# Stands for machine types without pages of their own.
OTHER_TYPES = "other"


def page_list(guide_type: str) -> list[int]:
    """Own pages of a type first, then the always-included ones not among them."""
    own = TYPE_PAGES.get(guide_type, ())
    return [*own, *[page for page in ALWAYS_PAGES if page not in own]]


GUIDE_TYPES = (*TYPE_PAGES, OTHER_TYPES)
_USED_PAGES = sorted({page for kind in GUIDE_TYPES for page in page_list(kind)})


def guide_type(machine_type: Column) -> Column:
    """The entry of the page table that serves a machine type."""
    kind = F.lower(machine_type)
    for alias, name in TYPE_ALIASES.items():
        kind = F.when(kind == alias, F.lit(name)).otherwise(kind)
    return F.when(kind.isin(*TYPE_PAGES), kind).otherwise(F.lit(OTHER_TYPES))


def _block(page: Column, content: Column) -> Column:
    header = F.format_string(PAGE_HEADER, page)
    return F.concat(header, F.lit("\n"), F.coalesce(content, F.lit("")))


def guide_all(pages: DataFrame) -> DataFrame:
    """Every page as a text block with its header. Read in order of position
    and joined by a blank line the blocks of a guide are its whole text; they
    stay rows, since a guide may be of any size."""
    return pages.select(
        "guide_id", "position", "page", _block(F.col("page"), F.col("content")).alias("block")
    )


def guide_for_type(pages: DataFrame) -> DataFrame:
    """Guide text per guide and guide type: own pages, then the always-included
    ones, each in document order.

    Each page is shuffled once; the texts of the types are cut from the small
    array of used pages afterwards.
    """
    entry = F.struct(
        "position", "page", _block(F.col("page"), F.col("content")).alias("block")
    )
    per_guide = (
        pages.filter(F.col("page").isin(*_USED_PAGES))
        .groupBy("guide_id")
        .agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    )

    def blocks(wanted: tuple[int, ...]) -> Column:
        chosen = F.filter("entries", lambda e: e["page"].isin(*wanted))
        return F.transform(chosen, lambda e: e["block"])

    def text(kind: str) -> Column:
        own = TYPE_PAGES.get(kind, ())
        always = tuple(page for page in ALWAYS_PAGES if page not in own)
        parts = F.concat(blocks(own), blocks(always)) if own else blocks(always)
        return F.array_join(parts, PAGE_SEPARATOR)

    texts = F.array(
        *[
            F.struct(F.lit(kind).alias("guide_type"), text(kind).alias("guide_text"))
            for kind in GUIDE_TYPES
        ]
    )
    return per_guide.select("guide_id", F.inline(texts)).withColumn(
        "guide_chars", F.length("guide_text")
    )


def _listing(kinds: tuple[str, ...]) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(kind).alias("guide_type"),
                F.lit(place).cast("int").alias("place"),
                F.lit(page).cast("int").alias("page"),
            )
            for kind in kinds
            for place, page in enumerate(page_list(kind), start=1)
        ]
    )


def guide_page_list(readings: DataFrame) -> DataFrame:
    """Page numbers for each machine type that occurs in the readings."""
    types = readings.select("machine_type").distinct()
    kind = guide_type(F.col("machine_type"))
    own = F.array().cast("array<int>")
    for name, numbers in TYPE_PAGES.items():
        own = F.when(
            kind == name, F.array(*[F.lit(n).cast("int") for n in numbers])
        ).otherwise(own)
    always = F.array(*[F.lit(n).cast("int") for n in ALWAYS_PAGES])
    return types.select(
        "machine_type",
        own.alias("own_pages"),
        F.array_union(own, F.array_except(always, own)).alias("pages"),
    )


def _described(pages: DataFrame) -> DataFrame:
    """Length, first line and keywords of the used pages, without the text."""
    texts = pages.filter(F.col("page").isin(*_USED_PAGES)).select(
        "guide_id",
        "page",
        F.coalesce("content", F.lit("")).alias("content"),
        F.lower(F.coalesce("content", F.lit(""))).alias("lowered"),
    )

    def label_if(label: str, words: tuple[str, ...]) -> Column:
        hit = F.lit(False)
        for word in words:
            hit = hit | F.contains("lowered", F.lit(word))
        return F.when(hit, F.lit(label))

    def labels(table: dict[str, tuple[str, ...]]) -> Column:
        return F.array_compact(F.array(*[label_if(*item) for item in table.items()]))

    return texts.select(
        "guide_id",
        "page",
        F.length("content").alias("char_count"),
        F.substring(F.substring_index("content", "\n", 1), 1, LINE_LENGTH).alias("first_line"),
        labels({kind: (kind.replace("_", " "),) for kind in TYPE_PAGES}).alias("type_names"),
        labels(PAGE_KEYWORDS).alias("keywords"),
    )


def _listed(pages: DataFrame) -> DataFrame:
    """The pages each type should find in each guide, with what was found. Only
    descriptions are joined, not texts."""
    wanted = (
        pages.select("guide_id")
        .distinct()
        .select("guide_id", F.inline(_listing(tuple(TYPE_PAGES))))
    )
    return wanted.join(_described(pages), ["guide_id", "page"], "left")


def guide_page_profile(pages: DataFrame) -> DataFrame:
    """Per guide, type and listed page: state, length, first line, keywords."""
    found = F.col("char_count") > 0
    own_name = F.when(
        F.array_contains("type_names", F.col("guide_type")), F.array("guide_type")
    ).otherwise(F.array().cast("array<string>"))
    return _listed(pages).select(
        "guide_id",
        "guide_type",
        "place",
        "page",
        F.when(found, "found")
        .when(F.col("char_count") == 0, "empty")
        .otherwise("not found")
        .alias("page_state"),
        F.when(found, F.col("char_count")).alias("char_count"),
        F.when(found, F.col("first_line")).alias("first_line"),
        F.when(found, F.array_join(F.concat(own_name, "keywords"), ", ")).alias("keywords"),
    )


def guide_size(pages: DataFrame) -> DataFrame:
    """Characters of the listed pages per guide and type, and a quarter of that
    as a rough token count."""
    return (
        _listed(pages)
        .groupBy("guide_id", "guide_type")
        .agg(F.coalesce(F.sum("char_count"), F.lit(0)).alias("char_count"))
        .withColumn("token_estimate", whole_half_up(F.col("char_count") / 4))
    )
