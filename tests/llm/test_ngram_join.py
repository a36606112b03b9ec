from __future__ import annotations

import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from machinepulse.llm import ngram_join
from machinepulse.llm.ngram_join import light_boundary, near_duplicates, needed, overlaps, shingles
from tests.llm.rows import found, texts


def sets_of(rows):
    out = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    return out


def brute(rows):
    sets = sets_of(rows)
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    lists = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            lists[g].append(i)
    shared = Counter(pair for m in lists.values() for pair in combinations(sorted(m), 2))
    for (a, b), both in shared.items():
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            a, b = top(a), top(b)
            root[max(a, b)] = min(a, b)
    return [(i, len(sets[i]), top(i)) for i, _ in sorted(rows)]


def near_copies(seed, count=160, low=3, high=80):
    """Texts of few words in groups: edited copies of edited copies, and shared passages."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = [f"p{k}" for k in range(30)]
    rows, made = [], []
    for i in range(count):
        if made and rng.random() < 0.6:
            words = list(rng.choice(made))
            for _ in range(rng.randint(0, max(1, len(words) // 40))):
                at = rng.randrange(len(words))
                words[at : at + rng.randint(0, 1)] = [rng.choice(vocabulary)] * rng.randint(0, 1)
            words = words or ["w0"]
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.randint(low, high))]
            if rng.random() < 0.4:
                words = passage + words[: rng.randint(1, 12)]
        made.append(words)
        rows.append((i, rng.choice([" ", "\n", "  "]).join(words)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components_are_those_of_all_pairs(spark, seed):
    rows = near_copies(seed)
    got = near_duplicates(texts(spark, *rows))
    assert got.orderBy("doc_id").collect() == brute(rows)


def test_short_texts_take_the_light_path(spark):
    rows = near_copies(5, low=5, high=16)
    assert [tuple(r) for r in near_duplicates(texts(spark, *rows)).orderBy("doc_id").collect()] == brute(rows)


def test_scans_in_several_blocks_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "_SCAN_GRAMS", 500)
    rows = near_copies(11, low=20)
    assert [tuple(r) for r in near_duplicates(texts(spark, *rows)).orderBy("doc_id").collect()] == brute(rows)


@pytest.mark.parametrize("turns", [0, 3])
def test_pivot_turns_lose_nothing(spark, monkeypatch, turns):
    # No scans, so that pivots have their turns and full comparison the rest.
    monkeypatch.setattr(ngram_join, "_MOST_SCANS", -1)
    monkeypatch.setattr(ngram_join, "_PIVOT_TURNS", turns)
    rows = near_copies(7, low=20)
    assert [tuple(r) for r in near_duplicates(texts(spark, *rows)).orderBy("doc_id").collect()] == brute(rows)


def test_open_sets_are_scanned_at_every_size(spark, monkeypatch):
    """Above the bound of scans too, no pairs of open sets are compared."""
    calls = Counter()

    def counted(name):
        whole = getattr(ngram_join, name)

        def call(*args):
            calls[name] += 1
            return whole(*args)

        monkeypatch.setattr(ngram_join, name, call)

    for name in ("_linked", "_scanned"):
        counted(name)
    monkeypatch.setattr(ngram_join, "_MOST_SCANS", 1)
    monkeypatch.setattr(ngram_join, "_PIVOT_TURNS", 0)
    monkeypatch.setattr(ngram_join, "_SCAN_GRAMS", 500)
    rows = near_copies(7, low=20)
    assert [tuple(r) for r in near_duplicates(texts(spark, *rows)).orderBy("doc_id").collect()] == brute(rows)
    assert calls["_linked"] == 1 and calls["_scanned"] > 1


def test_blocks_are_bounded_and_hold_every_set_once(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(k, n := rng.randint(1, 90), list(range(n)), k % 7) for k in range(300)]
    rows.append((300, 2_000, list(range(2_000)), 1))
    outside = spark.createDataFrame(rows, "node long, n long, grams array<long>, component long")
    monkeypatch.setattr(ngram_join, "_SCAN_GRAMS", 500)
    blocks = ngram_join._blocks(outside, 4)
    assert len(blocks) > 20
    sizes, edges = [], []
    for block in blocks:
        grams, owner, n, component = ngram_join._inverted(tuple(piece.path for piece in block))
        assert len(grams) == len(owner) == n.sum() and len(component) == len(n)
        assert len(grams) <= 500 or len(n) == 1
        assert (grams[1:] >= grams[:-1]).all()
        assert min(p.least for p in block) == n.min() and max(p.most for p in block) == n.max()
        sizes += n.tolist()
        edges.append((n.min(), n.max()))
    assert sorted(sizes) == sorted(r[1] for r in rows)
    # Neighbouring sizes share a block, so a set has to scan few of them.
    assert all(high <= low for (_, high), (low, _) in zip(edges, edges[1:]))
    assert ngram_join._blocks(outside.limit(0), 4) == []


def test_overlaps_of_few_and_of_many_sets():
    for count in (3, 5_000):
        met, both = ngram_join._overlaps(np.array([2, 0, 2], np.int32), count)
        assert (met.tolist(), both.tolist()) == ([0, 2], [1, 2])


def test_edges_of_the_contract(spark):
    eleven = [f"v{k}" for k in range(14)]  # 10 shingles
    rows = [
        (1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "ONE\ttwo"), (6, "Ü x"), (7, "ü x"),
        (8, " ".join(eleven)), (9, " ".join(eleven[1:])),  # 9 of 10: linked
        (10, " ".join(eleven[3:])),  # 7 of 10: not, but 7 of 9 neither
        (11, "a b c d e"), (12, "a b c d e f"),  # 1 of 2
    ]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(texts(spark, *rows)).collect()}
    assert got[1] == (0, 1) and got[2] == (0, 2) and got[3] == (0, 3)
    assert got[4] == got[5] == (1, 4)
    assert got[6] == (1, 6) and got[7] == (1, 7)
    assert got[8] == (10, 8) and got[9] == (9, 8) and got[10] == (7, 10)
    assert got[11] == (1, 11) and got[12] == (2, 12)


def test_nulls_and_repeated_rows(spark):
    rows = [(None, "a b c"), (3, "a b c"), (3, "a b c"), (3, "other"), (None, "alone")]
    got = near_duplicates(texts(spark, *rows))
    assert found(got, "doc_id", "component_id") == [
        (None, None), (None, 3), (3, 3), (3, 3), (3, 3)
    ]
    assert near_duplicates(texts(spark, (1, "a")).limit(0)).collect() == []


def test_a_very_long_text(spark):
    words = [f"w{k % 5000}x{k // 5000}" for k in range(60_000)]
    changed = words[:30_000] + ["new"] + words[30_001:]
    got = near_duplicates(texts(spark, (1, " ".join(words)), (2, " ".join(changed)), (3, "x " * 9)))
    assert found(got, "doc_id", "component_id") == [(1, 1), (2, 1), (3, 3)]


def test_overlaps_cover_every_pair_of_sizes():
    for s in range(1, 25):
        for t in range(s, 25):
            if 100 * s >= 80 * t:
                both = needed(s, t, 80)
                assert 180 * both >= 80 * (s + t) > 180 * (both - 1)
                assert both in overlaps(s, 24, 80) and both in overlaps(t, 24, 80)


def test_the_boundary_follows_the_costs():
    sizes = {n: 100 for n in range(1, 25)}
    assert light_boundary(sizes, 2.0, 80) <= light_boundary(sizes, 1e9, 80)
    assert light_boundary({12: 100}, 2.0, 80) < 12 <= light_boundary({12: 100}, 1e12, 80)
    assert light_boundary({}, 1.0, 80) == 24


def test_shingles_are_distinct_and_sorted():
    got = shingles("a b c d e a b c d e")
    assert len(got) == 5 and list(got) == sorted(set(got.tolist()))
    assert len(shingles("a b")) == 1 and len(shingles(" ")) == 0
