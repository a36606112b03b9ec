"""Near copies: a size-aware heavy-light join on word n-gram sets.

Sets are compared by Jaccard similarity. Two filters that lose nothing come
first: equal sets become one, and a set with too many n-grams that no other set
has cannot have a partner, which a quarter of all n-grams (those with a small
hash) usually shows.

What is left is split by size. Small sets (light) enumerate their subsets of
exactly the size of the overlap they need; two of them are linked if and only
if they share one. Large sets (heavy) scan the inverted lists of their rarest
n-grams. The boundary is where the counted subsets cost more than the lists.

Only components are asked for, so a list of m near copies is not turned into
m * m pairs. Each set is first compared with the pivot it shares most lists
with. In lists whose members are then in several components, the sets outside
the largest one are looked at again: they are written, by size, in blocks of
bounded length to the shared folder, and all sets whose size allows a link with
a block scan its inverted lists, which each task reads from there. Where many
blocks would be needed, further pivots first make such sets fewer; what these
leave open is scanned too, in as many blocks as it takes. Pairs of open sets are
never emitted, and no n-gram passes through the driver.
"""

from __future__ import annotations

import gc
import hashlib
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations
from math import comb, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from machinepulse.llm.common import bounded_batches, handing_back, partitions, scratch, stored
from machinepulse.llm.components import connected_components

# Rows of (id) up to which the sets still of interest are repeated on every
# executor rather than joined by shuffling the texts.
BROADCAST_ROWS = 1_000_000
# Sizes above this never enumerate subsets, whatever the costs.
_LARGEST_LIGHT = 24
# N-grams of the sets that one scan holds in every task (36 MB with their
# owners; more only where one set has more), and the number of scans above which
# pivots are to make such sets fewer first.
_SCAN_GRAMS = 3_000_000
_MOST_SCANS = 24
# Sets in a partition of a scan, a few MB.
_SETS = 2_000
# Turns of comparison with pivots before the scans come in any case, and pivots
# of a list in one turn.
_PIVOT_TURNS = 8
_MOST_PIVOTS = 64
# Postings or pairs in a partition, about 10 MB.
_ROWS = 200_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit fingerprints of the n-word shingles of a text.

    A-Z are lower-cased; words are what ASCII white space separates. Fewer than
    n words are one shingle, no words none.
    """
    # Of bytes, lower and split know ASCII only, as asked for.
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    width = min(n, len(words))
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    count = len(words) - width + 1
    mixed = np.full(count, width, np.uint64)
    for k in range(width):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _MIX + hashed[k : k + count]
    mixed = (mixed ^ (mixed >> np.uint64(32))) * _MIX
    return np.unique(mixed ^ (mixed >> np.uint64(29)))


def near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 80, identifier: str = "doc_id"
) -> DataFrame:
    """One row per row of docs: identifier, n_shingles, component_id.

    Sets are linked if 100 * intersection >= percent * union; component_id is
    the smallest identifier reachable by links. Null texts and texts without
    words have an empty set, are linked with nothing and are their own
    component. Rows with equal texts share their component. A null identifier
    never names a component that has another. Shingles are compared as 64-bit
    fingerprints. Other columns are not looked at;
    an empty table gives an empty table.
    """
    return leaders(docs, words, percent, identifier).drop("version", "leads")


def leaders(
    docs: DataFrame, words: int = 5, percent: int = 80, identifier: str = "doc_id"
) -> DataFrame:
    """`near_duplicates` with version, the 64-bit hash of the text, and leads.

    leads marks one (identifier, version) of each component, the smallest with
    nulls last, and every row without words; rows that repeat both are marked
    alike. version tells apart rows that share an identifier.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent is between 50 and 100")
    spark = bounded_batches(docs.sparkSession)
    texts = docs.select(
        F.col(identifier).alias("id"), F.col("text").alias("text"), F.xxhash64("text").alias("version")
    )
    id_type = docs.schema[identifier].dataType.simpleString()
    rows = stored(
        texts.mapInArrow(handing_back(_describe(words)), f"id {id_type}, version long, n long, print binary"), "set-prints"
    )
    row = F.struct(F.col("id").isNull().alias("unnamed"), "id", "version")
    sets = (
        rows.where("n > 0")
        .groupBy("print")
        .agg(F.min("id").alias("id"), F.first("n").alias("n"), F.min(row).alias("first"))
    )
    kept = stored(_possible(texts, sets, words, percent), "possible")
    _release(spark)
    large = stored(_members(texts, kept, words), "sets")
    _release(spark)
    links = _links(large, percent)
    members = (
        large.select("node", "print")
        .join(links, "node")
        .groupBy("print")
        .agg(F.min("component").alias("component"))
    )
    first = sets.join(members, "print", "left")
    lowest = (
        first.where("component is not null")
        .groupBy("component")
        .agg(F.min("first").alias("lowest"))
    )
    named = first.join(lowest, "component", "left").select(
        "print", F.coalesce("lowest", "first").alias("leader")
    )
    leads = F.col("id").eqNullSafe(F.col("leader.id")) & (
        F.col("version") == F.col("leader.version")
    )
    return rows.join(named, "print", "left").select(
        F.col("id").alias(identifier),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("leader.id")).otherwise(F.col("id")).alias("component_id"),
        "version",
        F.when(F.col("n") > 0, leads).otherwise(F.lit(True)).alias("leads"),
    )


def needed(s: Column | int, t: Column | int, percent: int) -> Column | int:
    """The least overlap of sets of sizes s and t that makes a link, as a whole number."""
    total = percent * (s + t)
    if isinstance(total, int):
        return -(-total // (100 + percent))
    return F.ceil(total / (100 + percent))


def _describe(words: int) -> Callable:
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, words) for t in batch.column("text").to_pylist()]
            yield pa.record_batch(
                [
                    batch.column("id"),
                    batch.column("version"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_print(s) for s in sets], pa.binary()),
                ],
                names=["id", "version", "n", "print"],
            )

    return describe


def _print(members: np.ndarray) -> bytes:
    """Names a set; the first 8 bytes are used alone only where a clash does no harm."""
    return hashlib.blake2b(members.tobytes(), digest_size=16).digest()


def _possible(texts: DataFrame, sets: DataFrame, words: int, percent: int) -> DataFrame:
    """(id, print) of the sets that can have a partner.

    A link leaves a set at most (100 - percent) % of n-grams that the partner
    lacks, so with more that no other set has there is no link. The n-grams
    counted are those whose hash is in the lowest part of its range: the same
    ones in every set, and somewhat more of them than may be missing.
    """
    share = min(1.0, (100 - percent) / 100 + 0.05)
    limit = np.uint64(min(int(share * 2**64), 2**64 - 1))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, found = [], []
            for text in batch.column("text").to_pylist():
                members = shingles(text, words)
                low = members[: np.searchsorted(members, limit)]
                if len(low):
                    found.append(low.view(np.int64))
                    owner.append(np.full(len(low), _number(_print(members)), np.int64))
            if found:
                yield pa.record_batch(
                    [pa.array(np.concatenate(found)), pa.array(np.concatenate(owner))],
                    names=["gram", "owner"],
                )

    alone = (
        texts.select("text")
        .mapInArrow(handing_back(sample), "gram long, owner long")
        # Equal sets have equal owners, so copies do not make an n-gram shared.
        .groupBy("gram")
        .agg(F.min("owner").alias("owner"), F.max("owner").alias("other"))
        .where("owner = other")
        .groupBy("owner")
        .agg(F.count("*").alias("alone"))
    )
    number = F.conv(F.hex(F.substring("print", 1, 8)), 16, -10).cast("long")
    return (
        sets.withColumn("owner", number)
        .join(alone, "owner", "left")
        .where(100 * F.coalesce("alone", F.lit(0)) <= (100 - percent) * F.col("n"))
        .select("id", "print")
    )


def _number(name: bytes) -> int:
    return int.from_bytes(name[:8], "big", signed=True)


def _members(texts: DataFrame, kept: DataFrame, words: int) -> DataFrame:
    """(node, print, n, grams) of the kept sets, from one text of each.

    A row too many (texts that share an id) is compared like any other set.
    """
    ids = kept.select(F.col("id").alias("wanted")).distinct()
    if ids.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s for t in batch.column("text").to_pylist() if len(s := shingles(t, words))]
            yield pa.record_batch(
                [
                    pa.array([_print(s) for s in sets], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                ],
                names=["print", "n", "grams"],
            )

    return (
        texts.join(ids, F.col("id").eqNullSafe(F.col("wanted")), "left_semi")
        .select("text")
        .mapInArrow(handing_back(members), "print binary, n long, grams array<long>")
        # Written out by the caller, so a node keeps its number.
        .select(F.monotonically_increasing_id().alias("node"), "print", "n", "grams")
    )


def _links(sets: DataFrame, percent: int) -> DataFrame:
    """(node, component) of the sets that have a link."""
    spark = sets.sparkSession
    postings = stored(_postings(sets, percent), "postings")
    _release(spark)
    boundary = light_boundary(
        {row.n: row.n_sets for row in _small_sizes(sets)}, _list_length(postings), percent
    )
    # Lists serve pairs with a large member; its partner may be a little smaller.
    postings = postings.where(100 * F.col("n") >= percent * (boundary + 1))
    total = postings.count()
    parts = partitions(total, _ROWS)
    light = _light_pairs(sets, boundary, percent)
    pairs = light.unionByName(_strongest_pivot(postings, percent)).distinct().coalesce(parts)
    links = _linked(pairs, sets, percent)
    for turn in range(_PIVOT_TURNS + 1):
        members = stored(connected_components(links), "components")
        unsettled = stored(_unsettled(postings, members, parts), "unsettled")
        _release(spark)
        rows = unsettled.count()
        if not rows:
            return members
        outside = stored(_outsiders(unsettled, sets, parts), "outsiders")
        scans = partitions(outside.agg(F.sum("n")).first()[0], _SCAN_GRAMS)
        if scans <= _MOST_SCANS or turn == _PIVOT_TURNS:
            labelled = sets.join(members, "node", "left").select(
                "n", "grams", F.coalesce("component", "node").alias("component")
            )
            labelled = labelled.coalesce(partitions(sets.count(), _SETS))
            # Sorted, so that a scan skips pages of sizes which no block member can link with.
            labelled = stored(labelled.sortWithinPartitions("n"), "labelled")
            for block in _blocks(outside, scans):
                links = links.unionByName(stored(_scanned(labelled, block, percent), "links"))
            return stored(connected_components(links), "components")
        count = max(1, min(_MOST_PIVOTS, total // rows))
        pivots = stored(_pivots(unsettled, count, turn).coalesce(parts), "pivots")
        met = _meetings(unsettled, pivots, percent).coalesce(parts)
        links = links.unionByName(_linked(met, sets, percent))
        # A pivot has met all of its list.
        postings = unsettled.drop("component").join(pivots, ["gram", "node"], "left_anti")
    raise AssertionError("the last turn returns")


def _postings(sets: DataFrame, percent: int) -> DataFrame:
    """(gram, node, n, place) of each set's prefix: its rarest n-grams.

    Ordered by rarity, any two linked sets share one of the first
    n - needed + 1, where needed is percent of n. N-grams that one set alone
    has come first and need no list.
    """
    rows = sets.select("node", "n", F.explode("grams").alias("gram"))
    shared = rows.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1")
    found = (
        rows.join(shared, "gram")
        .groupBy("node", "n")
        .agg(F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("grams"))
    )
    alone = F.col("n") - F.size("grams")
    length = F.floor((100 - percent) * F.col("n") / 100).cast("long") + 1
    return (
        found.where(alone < length)
        .select(
            "node",
            "n",
            alone.alias("alone"),
            F.posexplode(F.slice("grams", F.lit(1), (length - alone).cast("int"))).alias("i", "g"),
        )
        .select(F.col("g.gram").alias("gram"), "node", "n", (F.col("alone") + F.col("i")).alias("place"))
    )


def _small_sizes(sets: DataFrame) -> list:
    return (
        sets.where(F.col("n") <= _LARGEST_LIGHT)
        .groupBy("n")
        .agg(F.count("*").alias("n_sets"))
        .collect()
    )


def _list_length(postings: DataFrame) -> float:
    """How long the list is that a posting is in, on average."""
    lists = postings.groupBy("gram").agg(F.count("*").cast("double").alias("m"))
    row = lists.agg(F.sum(F.col("m") * F.col("m")).alias("pairs"), F.sum("m").alias("m")).first()
    return row.pairs / row.m if row.m else 1.0


def overlaps(size: int, boundary: int, percent: int) -> list[int]:
    """The overlaps a light set may need with light partners: the subset sizes it enumerates."""
    partners = range(-(-percent * size // 100), min(boundary, 100 * size // percent) + 1)
    return sorted({needed(size, t, percent) for t in partners})


def light_boundary(sizes: dict[int, int], list_length: float, percent: int) -> int:
    """The size up to which enumerating subsets costs less than scanning lists.

    A light set costs its subsets; a heavy one costs its postings, each for as
    many turns as a list of this length may take, and the comparison of its
    members.
    """

    def heavy(n: int) -> float:
        return ((100 - percent) * n // 100 + 1) * (1 + log2(max(list_length, 1))) + n

    best, least = 0, sum(k * heavy(n) for n, k in sizes.items())
    for boundary in range(1, _LARGEST_LIGHT + 1):
        cost = sum(
            k * (sum(comb(n, o) for o in overlaps(n, boundary, percent)) if n <= boundary else heavy(n))
            for n, k in sizes.items()
        )
        if cost <= least:
            best, least = boundary, cost
    return best


def _light_pairs(sets: DataFrame, boundary: int, percent: int) -> DataFrame:
    """(a, b) of small sets that share a subset: each with the smallest set that has it.

    All sets of a subset of o n-grams that are linked through it are linked
    with the smallest one, so the others need no pairs among themselves.
    """

    def subsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for node, grams in zip(*(batch.column(c).to_pylist() for c in ("node", "grams"))):
                for o in overlaps(len(grams), boundary, percent):
                    for chosen in combinations(sorted(grams), o):
                        key = hashlib.blake2b(np.array(chosen).tobytes(), digest_size=16).digest()
                        out.append((key, o, node, len(grams)))
                    if len(out) > 50_000:
                        yield _subset_batch(out)
                        out = []
            if out:
                yield _subset_batch(out)

    rows = (
        sets.where(F.col("n") <= boundary)
        .select("node", "grams")
        .mapInArrow(handing_back(subsets), "subset binary, o long, node long, n long")
    )
    least = rows.groupBy("subset", "o").agg(F.min(F.struct("n", "node")).alias("least"))
    return (
        rows.join(least, ["subset", "o"])
        .where(needed(F.col("n"), F.col("least.n"), percent) <= F.col("o"))
        .select(_ordered("node", "least.node"))
        .select("pair.*")
        .where("a != b")
    )


def _subset_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64())
    columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)]
    return pa.record_batch(columns, names=["subset", "o", "node", "n"])


def _ordered(left: str, right: str) -> Column:
    return F.struct(F.least(left, right).alias("a"), F.greatest(left, right).alias("b")).alias("pair")


def _can_link(percent: int, other: str) -> Column:
    """Size and position bounds for a shared n-gram at place and at other.place."""
    n, m = F.col("n"), F.col(f"{other}.n")
    i, j = F.col("place"), F.col(f"{other}.place")
    most = F.least(i, j) + 1 + F.least(n - i - 1, m - j - 1)
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (most >= needed(n, m, percent))


def _strongest_pivot(postings: DataFrame, percent: int) -> DataFrame:
    """(a, b): each set with the pivot it shares most lists with.

    A list has one pivot per band of sizes that can link, its smallest set.
    """
    band = F.floor(F.log("n") / F.log(F.lit(100 / percent if percent < 100 else 1.0001)))
    rows = postings.withColumn("band", band)
    pivots = rows.groupBy("gram", "band").agg(F.min(F.struct("n", "node", "place")).alias("pivot"))
    met = rows.join(pivots, ["gram", "band"]).where(
        (F.col("node") != F.col("pivot.node")) & _can_link(percent, "pivot")
    )
    shared = met.groupBy("node", F.col("pivot.node").alias("to")).agg(F.count("*").alias("k"))
    best = shared.groupBy("node").agg(F.max(F.struct("k", F.col("to"))).alias("best"))
    return best.select(_ordered("node", "best.to")).select("pair.*")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets overlap enough, stored."""
    pairs = stored(pairs, "pairs")
    nodes = stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
    count = nodes.count()
    wanted = F.broadcast(nodes) if count <= BROADCAST_ROWS else nodes
    sets = sets.join(wanted, "node", "left_semi")
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("grams").alias("of_a"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("grams").alias("of_b"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    found = (
        pairs.join(left, "a")
        .join(right, "b")
        .where((100 + percent) * both >= percent * (F.col("n_a") + F.col("n_b")))
        .select("a", "b")
    )
    return stored(found.coalesce(partitions(count, 2_000)), "links")


def _unsettled(postings: DataFrame, members: DataFrame, parts: int) -> DataFrame:
    """Postings of the lists whose members are not all in one component."""
    known = postings.join(members, "node", "left").select(
        "gram", "node", "n", "place", F.coalesce("component", "node").alias("component")
    )
    known = known.coalesce(parts)
    lists = known.groupBy("gram").agg(
        F.min("component").alias("low"), F.max("component").alias("high")
    )
    mixed = lists.where("low != high").select("gram").coalesce(parts)
    return known.join(mixed, "gram", "left_semi").coalesce(parts)


def _outsiders(unsettled: DataFrame, sets: DataFrame, parts: int) -> DataFrame:
    """(node, n, grams, component) of sets outside the largest component of some list.

    A link between two components has such a set at one end at least.
    """
    sizes = unsettled.groupBy("gram", "component").agg(F.count("*").alias("k")).coalesce(parts)
    largest = sizes.groupBy("gram").agg(
        F.max(F.struct("k", F.col("component").alias("c"))).alias("largest")
    )
    nodes = (
        unsettled.join(largest.coalesce(parts), "gram")
        .where("component != largest.c")
        .select("node", "component")
        .coalesce(parts)
        .distinct()
        .coalesce(parts)
    )
    return sets.select("node", "n", "grams").join(nodes, "node")


def _blocks(outside: DataFrame, parts: int) -> list[list]:
    """The sets of outside as files in the shared folder, grouped into blocks of neighbouring sizes.

    Each block is a list of rows (path, n_grams, least, most), least and most
    being sizes of sets. Neither a file nor a block has more than _SCAN_GRAMS
    n-grams, unless one set alone has. Only these rows come to the driver.
    """
    pieces = stored(
        outside.repartitionByRange(parts, "n", "node")
        .sortWithinPartitions("n", "node")
        .mapInArrow(
            handing_back(_piece_writer(scratch(outside.sparkSession, "blocks"), _SCAN_GRAMS)),
            "path string, n_grams long, least long, most long",
        ),
        "pieces",
    )
    blocks, total = [], 0
    for piece in sorted(pieces.collect(), key=lambda r: (r.least, r.most, r.path)):
        if not blocks or total + piece.n_grams > _SCAN_GRAMS:
            blocks.append([])
            total = 0
        blocks[-1].append(piece)
        total += piece.n_grams
    return blocks


def _piece_writer(folder: str, limit: int) -> Callable:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = arrow_fs.FileSystem.from_uri(folder)
        held, sizes = [], []

        def finished() -> pa.RecordBatch:
            # A new name for each attempt; only those of finished attempts are listed.
            name = f"{uuid.uuid4().hex}.arrow"
            store.create_dir(root, recursive=True)
            with (
                store.open_output_stream(f"{root}/{name}", compression=None) as out,
                pa.ipc.new_stream(out, held[0].schema) as stream,
            ):
                for rows in held:
                    stream.write_batch(rows)
            row = (f"{folder}/{name}", sum(sizes), min(sizes), max(sizes))
            return pa.record_batch(
                [pa.array([v]) for v in row], names=["path", "n_grams", "least", "most"]
            )

        for batch in batches:
            start, total = 0, sum(sizes)
            for row, n in enumerate(batch.column("n").to_pylist()):
                if sizes and total + n > limit:
                    held.append(batch.slice(start, row - start))
                    yield finished()
                    held, sizes, start, total = [], [], row, 0
                sizes.append(n)
                total += n
            held.append(batch.slice(start))
        if sizes:
            yield finished()

    return write


@lru_cache(maxsize=1)
def _inverted(paths: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted n-grams, the set each is of, and the sizes and components of the sets.

    A worker keeps those of the last block, for its next task of the same scan.
    """
    tables = []
    for path in paths:
        store, name = arrow_fs.FileSystem.from_uri(path)
        with store.open_input_stream(name, compression=None) as source:
            tables.append(pa.ipc.open_stream(source).read_all())
    found = pa.concat_tables(tables)
    sizes = found.column("n").to_numpy()
    grams = np.concatenate([c.flatten().to_numpy() for c in found.column("grams").chunks])
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    order = np.argsort(grams, kind="stable")
    return grams[order], owner[order], sizes, found.column("component").to_numpy()


def _overlaps(owners: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of count sets occur among owners, and how often each."""
    if 8 * len(owners) < count:
        return np.unique(owners, return_counts=True)
    both = np.bincount(owners, minlength=count)
    present = np.flatnonzero(both)
    return present, both[present]


def _scanned(labelled: DataFrame, block: list, percent: int) -> DataFrame:
    """(a, b): components that a link joins, from sets scanning the inverted lists of a block.

    The lists of the block's n-grams are sorted arrays in every task. What a
    set finds in them gives its overlap with each set of the block. Sets that
    are too small or too large for all of the block are not read. A task
    reports a link only if it joins two components it has not joined yet, so it
    reports fewer than there are components in the block.
    """
    paths = tuple(piece.path for piece in block)
    least, most = min(piece.least for piece in block), max(piece.most for piece in block)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while root.get(x, x) != x:
                x = root[x]
            return x

        for batch in batches:
            grams, owner, sizes, component = _inverted(paths)
            column = batch.column("grams")
            values, ends = column.flatten().to_numpy(), np.cumsum(batch.column("n").to_numpy())
            joined = []
            for own, end, n in zip(
                batch.column("component").to_pylist(), ends, batch.column("n").to_pylist()
            ):
                members = values[end - n : end]
                low = np.searchsorted(grams, members)
                many = np.searchsorted(grams, members, "right") - low
                low, many = low[many > 0], many[many > 0]
                if not len(low):
                    continue
                # The places of all entries of these lists, one after the other.
                places = np.repeat(low - np.concatenate(([0], np.cumsum(many)[:-1])), many)
                met, both = _overlaps(owner[places + np.arange(len(places))], len(sizes))
                linked = met[(100 + percent) * both >= percent * (sizes[met] + n)]
                for other in np.unique(component[linked]).tolist():
                    a, b = top(own), top(other)
                    if a != b:
                        root[max(a, b)] = min(a, b)
                        joined.append((own, other))
            if joined:
                a, b = zip(*joined)
                yield pa.record_batch(
                    [pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"]
                )

    # A linked pair's smaller set has at least percent of the larger one's size.
    able = labelled.where(F.col("n").between(-(-percent * least // 100), 100 * most // percent))
    return able.select("component", "n", "grams").mapInArrow(handing_back(scan), "a long, b long")


def _pivots(unsettled: DataFrame, count: int, turn: int) -> DataFrame:
    """(gram, node, n, place, component): members of each list outside its largest component.

    Which ones differs by list and by turn, so that sets which share many lists
    meet many pivots. The count per list is cut before the shuffle too.
    """
    sizes = unsettled.groupBy("gram", "component").agg(F.count("*").alias("k"))
    largest = sizes.groupBy("gram").agg(
        F.max(F.struct("k", F.col("component").alias("c"))).alias("largest")
    )
    outside = unsettled.join(largest, "gram").where("component != largest.c").drop("largest")
    order = Window.partitionBy("gram").orderBy(F.xxhash64("node", "gram", F.lit(turn)), "node")
    return outside.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= count).drop("turn")


def _meetings(unsettled: DataFrame, pivots: DataFrame, percent: int) -> DataFrame:
    """(a, b): members of a list with its pivots, where they are in different components."""
    pivot = pivots.select("gram", F.struct("node", "n", "place", "component").alias("pivot"))
    return (
        unsettled.join(pivot, "gram")
        .where(F.col("component") != F.col("pivot.component"))
        .where(_can_link(percent, "pivot"))
        .select(_ordered("node", "pivot.node"))
        .select("pair.*")
        .distinct()
    )


def _release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
