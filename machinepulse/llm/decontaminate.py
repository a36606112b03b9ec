"""Benchmark passages in documents, by a prefix-filtered set join.

An item's windows are its runs of `window` words (the whole item if it has
fewer). A document that holds a window holds every shingle of it, so with the
shingles ordered by how often they occur in the corpus the prefix that must
match is the rarest one alone. Windows whose rarest shingle never occurs are
out. Where it does occur, its place in the window fixes where the window would
have to begin (positional bound) and end (length bound), and the words there
are compared one by one.

DataFrame functions only.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, functions as F

from machinepulse.llm.common import stored
from machinepulse.operators.reduction import may_match

# All of ASCII but digits and letters separates words.
_SEPARATORS = "".join(
    chr(c) for c in range(128) if not chr(c).isalnum()
)
# Rows of a table made from the benchmark up to which it is repeated on every
# executor; about 100 bytes each. Larger ones are joined by shuffling.
BROADCAST_ROWS = 500_000


def words(text: Column) -> Column:
    """Words of lower-cased (A-Z only) text: runs of 0-9, a-z and non-ASCII characters."""
    plain = F.translate(
        F.coalesce(text, F.lit("")),
        ascii_uppercase + _SEPARATORS,
        ascii_lowercase + " " * len(_SEPARATORS),
    )
    return F.array_remove(F.split(plain, " "), "")


def contamination(
    docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 3
) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, spans, item_ids, contaminated.

    spans lists (start, length) of occurring windows in words from 0, item_ids
    the items with an occurring window, as sorted texts. Null and empty texts
    have no words; items without words have no window; an item with a null id
    hits words but is not listed. Rows that repeat doc_id and text get equal
    results each. Other columns are not looked at. Empty tables are fine.
    """
    found, owned = _found(docs, items, window, shingle)
    # Windows of one document are at most as many as its words.
    hits = found.groupBy("id", "version").agg(
        F.sort_array(F.collect_set(F.struct("start", "length"))).alias("spans")
    )
    listed = (
        found.select("id", "version", "words")
        .distinct()
        .join(_small(owned.where("item is not null")), "words")
        .groupBy("id", "version")
        .agg(F.array_sort(F.collect_set(F.col("item"))).alias("item_ids"))
    )
    result = (
        docs.select(
            F.col("doc_id").alias("id"),
            F.xxhash64("text").alias("version"),
            F.size(words(F.col("text"))).cast("long").alias("n_words"),
        )
        .alias("d")
        .join(
            hits.join(listed, _same(hits, listed), "left").select(
                hits["id"], hits["version"], "spans", "item_ids"
            ).alias("h"),
            F.col("d.id").eqNullSafe(F.col("h.id")) & (F.col("d.version") == F.col("h.version")),
            "left",
        )
    )
    return result.select(
        F.col("d.id").alias("doc_id"),
        "n_words",
        F.coalesce(_covered(F.col("spans")), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,length:int>>")).alias("spans"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        F.col("spans").isNotNull().alias("contaminated"),
    )


def occurrences(
    docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 3
) -> DataFrame:
    """(id, version, start, length, words) of every occurring window.

    id is the doc_id and version the 64-bit hash of the text, which tells apart
    rows that share an id.
    """
    return _found(docs, items, window, shingle)[0]


def _found(
    docs: DataFrame, items: DataFrame, window: int, shingle: int
) -> tuple[DataFrame, DataFrame]:
    shingle = min(shingle, window)
    texts = docs.select(
        F.col("doc_id").alias("id"),
        # Tells apart rows that share an id but not the text.
        F.xxhash64("text").alias("version"),
        words(F.col("text")).alias("words"),
    )
    owned = stored(_windows(items, window), "windows")
    sought = owned.select("words").distinct()
    keyed = stored(
        sought.select(
            "words",
            F.least(F.size("words"), F.lit(shingle)).alias("g"),
            F.xxhash64("words").alias("window"),
        ).select(
            "words",
            "g",
            "window",
            F.posexplode(
                F.transform(
                    F.sequence(F.lit(1), F.size("words") - F.col("g") + 1),
                    lambda i: F.xxhash64(
                        "g", F.array_join(F.slice("words", i, F.col("g")), " ")
                    ),
                )
            ).alias("offset", "shingle"),
        ),
        "window-shingles",
    )
    sizes = sorted(row.g for row in keyed.select("g").distinct().collect())
    none = texts.select(
        "id", "version", F.lit(0).alias("start"), F.lit(0).alias("length"), "words"
    ).where(F.lit(False))
    if not sizes:
        return stored(none, "occurrences"), owned
    # The only pass over all places of all texts keeps those of the benchmark's
    # shingles; how often a shingle occurs and where follow from it.
    shingles = _small(keyed.select("shingle").distinct())
    places = None
    for g in sizes:
        here = _occurrences(texts, g).join(shingles, "shingle")
        places = here if places is None else places.unionByName(here)
    places = stored(places, "places")
    frequency = places.groupBy("shingle").agg(F.count("*").alias("frequency"))
    # A shingle without a frequency does not occur, and so neither does its window.
    rarity = F.struct(F.coalesce("frequency", F.lit(0)), "offset", "shingle")
    rarest = (
        keyed.join(frequency, "shingle", "left")
        .groupBy("words", "g")
        .agg(F.min(rarity).alias("rarest"))
        .where("rarest.col1 > 0")
        .select(
            F.col("words").alias("sought"),
            F.col("rarest.offset").alias("offset"),
            F.col("rarest.shingle").alias("shingle"),
        )
    )
    found = stored(_verified(texts, places, stored(rarest, "prefixes")), "occurrences")
    return found, owned


def _same(left: DataFrame, right: DataFrame) -> Column:
    return left["id"].eqNullSafe(right["id"]) & (left["version"] == right["version"])


def _windows(items: DataFrame, window: int) -> DataFrame:
    """(item, words) for each distinct window of each item."""
    rows = items.select(
        F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("all")
    ).where(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - window + 1, F.lit(1)))
    return rows.select(
        "item",
        F.explode(F.transform(starts, lambda i: F.slice("all", i, window))).alias("words"),
    ).distinct()


def _occurrences(texts: DataFrame, g: int) -> DataFrame:
    """Every place of every text with the hash of the g words that begin there."""
    ahead = [F.get("words", F.col("place") + k) for k in range(1, g)]
    return texts.select("*", F.posexplode("words").alias("place", "word")).select(
        "id",
        "version",
        "place",
        F.xxhash64(F.lit(g), F.concat_ws(" ", "word", *ahead)).alias("shingle"),
    )


def _verified(texts: DataFrame, places: DataFrame, rarest: DataFrame) -> DataFrame:
    """Occurring windows: the words at the only place the window can be, compared in full.

    The places are joined without words; the words of the few texts in question
    are fetched afterwards.
    """
    start = F.col("place") - F.col("offset")
    begun = (
        places.join(_small(rarest), "shingle")
        .where(start >= 0)
        .select("id", "version", start.alias("start"), "sought")
        .distinct()
    )
    begun = stored(begun.withColumnsRenamed({"id": "id_", "version": "version_"}), "candidates")
    if begun.count() > BROADCAST_ROWS:
        # Shuffled, but only the texts that have a candidate.
        keys = begun.select(F.xxhash64("id_", "version_").alias("key")).distinct()
        own = F.xxhash64("id", "version").alias("key")
        texts = texts.withColumn("key", own).where(may_match(keys, ["key"])).drop("key")
    else:
        begun = F.broadcast(begun)
    length = F.size("sought")
    return (
        texts.join(begun, F.expr("version = version_ and id <=> id_"))
        .where(F.slice("words", F.col("start") + 1, length) == F.col("sought"))
        .select("id", "version", "start", length.alias("length"), F.col("sought").alias("words"))
        .distinct()
    )


def _small(table: DataFrame) -> DataFrame:
    """Repeat a table on every executor only if its counted rows are few."""
    kept = stored(table, "benchmark")
    return F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept


def _covered(spans: Column) -> Column:
    """Words inside any of the sorted spans."""
    end = lambda x: x["start"] + x["length"]
    return F.aggregate(
        spans,
        F.struct(F.lit(0).alias("to"), F.lit(0).alias("n")),
        lambda acc, x: F.struct(
            F.greatest(acc["to"], end(x)).alias("to"),
            (
                acc["n"]
                + F.greatest(end(x) - F.greatest(acc["to"], x["start"]), F.lit(0))
            ).alias("n"),
        ),
        lambda acc: acc["n"],
    )
