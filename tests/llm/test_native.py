"""Secrets, URL aliases and decontamination: brute force, SQL twins, plans without Python."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from machinepulse.llm import decontaminate, registry, secrets, url_filter
from machinepulse.llm.components import connected_components
from tests.compare import duck, duck_rows, spark_rows
from tests.llm.rows import documents, found, pages, texts

SF = "/root/testdata/sf0.001"
NATIVE = ("op6_secrets", "op9_url_filter", "op10_decontaminate")


@pytest.mark.parametrize("name", NATIVE)
def test_no_python_runs(spark, name):
    text = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for node in ("Python", "Pandas", "Arrow", "NestedLoop", "CartesianProduct"):
        assert node not in text


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_twin(spark, name):
    assert spark_rows(registry.queries()[name](spark, SF)) == duck_rows(
        duck(SF), registry.oracle_sql()[name]
    )


def test_every_operator_is_registered():
    assert [name.split("_")[0] for name in registry.queries()] == [f"op{n}" for n in range(1, 14)]


# --- secrets ---------------------------------------------------------------------


def brute_spans(text):
    text = text or ""
    out = []
    for order, (kind, pattern, group, least) in enumerate(
        [
            ("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
            ("access", r"AKIA[A-Z0-9]+", 0, 20),
            ("hex", r"[0-9a-f]+", 0, 24),
        ]
    ):
        out += [
            (m.start(), order, m.end(), kind)
            for m in re.finditer(pattern, text)
            if len(m[group]) >= least
        ]
    for m in re.finditer(r"[A-Za-z0-9+/_=-]+", text):
        value = m[0]
        if len(value) < 20 or any(re.search(p, value) for p in secrets.ALLOWED):
            continue
        bits = next(c.bits for c in secrets.CLASSES if re.search(c.pattern, value))
        hot = []
        for i in range(len(value) - 19):
            counts = Counter(value[i : i + 20]).values()
            weight = sum(round(n * math.log2(n) * 1_000_000) for n in counts)
            if weight <= math.floor((math.log2(20) - bits) * 20_000_000):
                hot.append(i)
        if hot:
            out.append((m.start() + hot[0], 3, m.start() + hot[-1] + 20, "entropy"))
    return sorted(out)


def secret_texts():
    rng = random.Random(4)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    rows = [None, "", "nothing", "token: short", 'Secret = "abcdef"', "API_KEY:'a.b_c-d/e+f='",
            "secret:token\"=abcdefgh", "password==abcdef passwd =x", "AKIA" + "A" * 16, "AKIA" + "B" * 15,
            "AKIA AKIAAKIA" + "Z9" * 10, "0" * 24, "g" + "ab12" * 6 + "x", "ab12" * 5 + "abc",
            "ü é  token=ünïcode token=plain1 \U0001f600 token=after22"]
    for _ in range(40):
        parts = []
        for _ in range(rng.randint(1, 5)):
            kind = rng.randrange(5)
            size = rng.randint(10, 60)
            parts.append(
                [
                    "".join(rng.choices(alphabet, k=size)), "".join(rng.choices("0123456789abcdef", k=size)),
                    "token=" + "".join(rng.choices(alphabet, k=size)), "thewordsthatarelong" * rng.randint(1, 4),
                    "aaaaaaaaaaaaaaaaaaaaaaaa1" + "".join(rng.choices(alphabet, k=rng.randint(0, 30))),
                ][kind]
            )
        rows.append("é ".join(parts))
    # More matches than a block holds, and a very long candidate.
    rows.append(" ".join(f"token={'k' * 6}{i}" for i in range(700)))
    rows.append("".join(rng.choices(alphabet, k=3000)))
    return rows


def test_spans_are_those_of_a_plain_scan(spark):
    rows = secret_texts()
    got = secrets.find(texts(spark, *enumerate(rows))).select("doc_id", "secrets").collect()
    assert len(got) == len(rows)
    for row in got:
        assert [tuple(s) for s in row.secrets] == brute_spans(rows[row.doc_id]), row.doc_id


def test_columns_of_the_input_named_like_own_ones(spark):
    names = ["__text", "__assign", "__hex", "__HEX_m", "___text", "__entropy_g"]
    table = spark.createDataFrame([("token = abcdef123", *names)], ["text", *names])
    row = secrets.find(table).first()
    assert [row[name] for name in names] == names and row.secrets[0].kind == "assign"


def test_no_secrets_in_an_empty_table(spark):
    assert secrets.find(texts(spark, (1, "a")).limit(0)).collect() == []


# --- URLs ------------------------------------------------------------------------


def canonical(url):
    return f'<html><head><LINK data-x="1" rel="canonical" href="{url}"></head></html>'


def test_blocks_reach_aliases_and_allows_hold(spark):
    rules = registry.RULES
    refresh = '<meta http-equiv="refresh" content="0; url=http://x.org/c?a=1&amp;b=2">'
    rows = [
        (1, "http://x.org/a#top", canonical("http://spam.example.com/en/1")),  # alias of a block
        (2, "http://x.org/b", canonical("/a")),  # over two edges
        (3, "http://www.example.com/en/9", canonical("http://x.org/b")),  # allowed itself
        (4, "http://x.org/c?a=1&b=2", None),
        (5, "http://y.org/d", refresh),  # alias of an address without decision
        (6, "http://spam.example.com/en/1", ""),
        (7, "http://X.NET/es/q", ""), (8, "http://x.net/fr", ""), (9, "nothing", ""),
        (10, None, canonical("http://spam.example.com/en/1")), (11, "HTTP://Com/", ""),
        (12, "http://com?x", ""), (None, "http://x.org/b", ""), (2, "http://x.org/b", canonical("/a")),
    ]
    got = url_filter.judge(pages(spark, *rows), rules)
    verdicts = found(got, "page_id", "rule", "verdict")
    assert verdicts == sorted(
        [
            (1, None, "block"), (2, None, "block"), (2, None, "block"),
            (3, "www.example.com/en/", "allow"), (4, None, "allow"), (5, None, "allow"),
            (6, "example.com/en/", "block"), (7, "net/es/", "block"), (8, None, "allow"),
            (9, None, "allow"), (10, None, "allow"), (11, "com/", "allow"), (12, None, "allow"),
            (None, None, "block"),
        ],
        key=lambda row: tuple((v is not None, str(v)) for v in row),
    )
    hosts = {r.page_id: (r.host, r.path) for r in got.collect()}
    assert hosts[7] == ("x.net", "/es/q") and hosts[9] == hosts[10] == ("", "")
    assert hosts[12] == ("com", "")


@pytest.mark.parametrize(
    ("url", "html", "targets"),
    [
        ("http://h/a", canonical("http://s/1") + canonical("http://s/2"), ["http://s/1", "http://s/2"]),
        ("HTTP://H.Org/A#x", canonical("Https://S.Net/B?C#d"), ["https://s.net/B?C"]),
        ("https://h/a/b", canonical("?x=1"), ["https://h/a/b?x=1"]),
        ("https://h/a/b?y", canonical("../c/./d/.."), ["https://h/c/"]),
        ("https://h/a/b", canonical("./e"), ["https://h/a/e"]),
        ("https://h/a/b", canonical("../../../.."), ["https://h/"]),
        ("http://h", canonical("x"), ["http://h/x"]),
        ("http://h?q=/", canonical("x"), ["http://h/x"]),
        ("http://h/a/", canonical("//s/b") + canonical("/c"), ["http://h/c", "http://s/b"]),
        ("http://h/", canonical("/l?next=http://s/"), ["http://h/l?next=http://s/"]),
        ("http://h/", canonical("mailto:a@b.c"), []),
        (
            "http://h/",
            canonical("&#47;a&#x2F;b&sol;c?d&copy=1&amp;e&eacute;&#233;&#128;&#xD800;&#99999999999;&x;&"),
            ["http://h/a/b/c?d&copy=1&eéé€\ufffd\ufffd&x;&"],
        ),
        (
            "http://h/",
            "<meta http-equiv=refresh content='0; URL=\"/a;b&amp;c\"'><META content=\"5;url=d&amp;e\" "
            "HTTP-EQUIV='refresh'><meta http-equiv=refresh content=9><meta http-equiv=refresh content=0;url=f>",
            ["http://h/a;b&c", "http://h/d&e", "http://h/f"],
        ),
    ],
)
def test_every_edge_of_a_page(spark, url, html, targets):
    edges = found(url_filter.page_edges(pages(spark, (1, url, html))), "a", "b")
    assert sorted(b for _, b in edges) == targets
    assert {a for a, _ in edges} <= {url.replace("HTTP://H.Org/A#x", "http://h.org/A")}


def test_blocks_reach_aliases_spelled_otherwise(spark):
    rows = [
        (1, "http://x.org/a", canonical("http://y.org/") + canonical("../z/../es&#47;b")),
        (2, "http://X.ORG/a", ""), (3, "http://x.org/es/b", canonical("HTTP://Spam.NET/es/")),
    ]
    got = url_filter.judge(pages(spark, *rows), registry.RULES)
    assert dict(found(got, "page_id", "verdict")) == {1: "block", 2: "block", 3: "block"}


def test_what_is_no_link_makes_no_edge(spark):
    bad = "https://example.com/en/x"
    link = f'<link rel=canonical href="{bad}">'
    rows = {
        1: f"<!-- {link} -->",
        2: f'<link data-rel="canonical" href="{bad}">',
        3: f"<script>s = '{link}'</script>",
        4: f'<link rel="canonical" data-href="{bad}">',
        5: f"<template>{link}</template>",
        6: f"<!-- {link}",
        7: f'<links rel="canonical" href="{bad}">',
        8: f'<link rel="canonicals" href="{bad}">',
        # These are links.
        11: f"<!-- a -->{link}<!-- b -->",
        12: f"<link href='{bad}'\n REL = 'canonical'/>",
        13: f"<script>1</script><title>x</title>{link}",
        14: f'<link a="b"rel="canonical" href="{bad}">',
    }
    table = pages(spark, *[(i, f"https://page{i}.org/", h) for i, h in rows.items()])
    judged = url_filter.judge(table, registry.RULES)
    blocked = {r.page_id for r in judged.where("verdict = 'block'").collect()}
    assert blocked == {11, 12, 13, 14}


def test_blocks_over_many_generated_edges(spark):
    rng = random.Random(6)
    n = 300
    urls = [
        f"https://h{i}.{rng.choice(['org', 'net', 'com'])}/{rng.choice(['es/', 'fr/', ''])}p{i}"
        for i in range(n)
    ]
    to = {i: rng.sample(range(n), rng.choice([0, 0, 1, 1, 2])) for i in range(n)}
    # A chain, and a page that many point to.
    to |= {i: [i + 1] for i in range(100, 140)} | {i: [7] for i in range(200, 240)}
    near = {i: set() for i in range(n)}
    for i, targets in to.items():
        for j in targets:
            near[i].add(j)
            near[j].add(i)

    def ruled(url):
        host, path = re.fullmatch(r"https://([^/]*)(/.*)", url).groups()
        if host.endswith(".com"):
            return "allow"
        return "block" if host.endswith(".net") and path.startswith(("/es/", "/fr/")) else None

    want = {}
    for i in range(n):
        seen, open_ = {i}, [i]
        while open_:
            for j in near[open_.pop()] - seen:
                seen.add(j)
                open_.append(j)
        spread = "block" if any(ruled(urls[j]) == "block" for j in seen) else "allow"
        want[i] = ruled(urls[i]) or spread
    html = {
        i: "".join(f"<link rel=canonical href={urls[j]}>" for j in targets)
        for i, targets in to.items()
    }
    judged = url_filter.judge(pages(spark, *[(i, urls[i], html[i]) for i in range(n)]), registry.RULES)
    assert {r.page_id: r.verdict for r in judged.collect()} == want


def test_given_redirects_count(spark):
    rows = [(1, "http://a.org/", ""), (2, "http://b.org/", "")]
    redirects = spark.createDataFrame(
        [("http://a.org/", "http://t.net/es/"), (None, "http://b.org/")], "a string, b string"
    )
    got = url_filter.judge(pages(spark, *rows), registry.RULES, redirects)
    assert dict(found(got, "page_id", "verdict")) == {1: "block", 2: "allow"}
    assert url_filter.judge(pages(spark, *rows).limit(0), registry.RULES).collect() == []


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_of_random_edges(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)]
    edges += [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 6000 + i) for i in range(200)]
    root = {}

    def top(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((top(a), top(b)))
            root[b] = a
    got = connected_components(spark.createDataFrame([*edges, (None, 3)], "a long, b long"))
    assert {r.node: r.component for r in got.collect()} == {x: top(x) for x in root}


# --- decontamination -------------------------------------------------------------


def brute_hits(docs, items, window=10):
    def words(text):
        lowered = "".join(c.lower() if c.isascii() else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)

    out = []
    for i, text in docs:
        own, hit, ids, any_ = words(text), set(), set(), False
        for item, item_text in items:
            sought = words(item_text)
            size = min(window, len(sought))
            if not size:
                continue
            for k in range(len(sought) - size + 1):
                for at in range(len(own) - size + 1):
                    if own[at : at + size] == sought[k : k + size]:
                        hit |= set(range(at, at + size))
                        any_ = True
                        if item is not None:
                            ids.add(str(item))
        out.append((i, len(own), len(hit), sorted(ids), any_))
    return sorted(out, key=lambda row: tuple((v is not None, str(v)) for v in row))


def benchmark(spark, *rows):
    return spark.createDataFrame(list(rows), "item_id long, text string")


@pytest.mark.parametrize("limit", [500_000, -1])
def test_hits_are_those_of_a_plain_search(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", limit)
    rng = random.Random(6)
    vocabulary = ["the", "of", "and"] + [f"w{k}" for k in range(12)] + ["Ünï"]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 3, 9, 10, 11, 25])))) for k in range(12)]
    items += [(20, None), (21, "..."), (None, items[3][1]), (22, items[5][1]), (22, items[5][1])]
    items += [(23, " ".join(["the"] * 14))]
    rows = [(0, None), (1, ""), (2, "!?"), (3, " ".join(["The"] * 40))]
    for k in range(4, 40):
        text = rng.choices(vocabulary, k=rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            source = rng.choice(items)[1] or ""
            at = rng.randint(0, len(text))
            text[at:at] = source.upper().split()
        rows.append((k, rng.choice([" ", "--", ",\n"]).join(text)))
    rows += [(7, "same id, other text the of"), rows[9], (None, items[0][1])]
    got = decontaminate.contamination(texts(spark, *rows), benchmark(spark, *items))
    columns = ["doc_id", "n_words", "n_hit", "item_ids", "contaminated"]
    assert found(got, *columns) == brute_hits(rows, items)
    for row in got.collect():
        covered = set()
        for start, length in row.spans:
            covered |= set(range(start, start + length))
        assert len(covered) == row.n_hit


def test_no_words_in_the_join_of_places(spark, monkeypatch):
    """However large the benchmark is, what is joined by shingle are places."""
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(6)}"
    docs = [(i, " ".join(word() for _ in range(rng.randrange(300)))) for i in range(60)]
    docs += [(None, docs[3][1])] * 40 + [(3, docs[3][1]), (3, docs[4][1])]
    items = [(i, " ".join(docs[i][1].split()[5:20])) for i in range(0, 20, 2)] + [(99, "w1 w2")]
    table = spark.createDataFrame(items, "item_id long, text string")
    places = decontaminate._occurrences(
        texts(spark, *docs).select("doc_id", decontaminate.words(F.col("text")).alias("words")).selectExpr(
            "doc_id AS id", "doc_id AS version", "words"
        ), 3,
    )
    assert "words" not in places.columns
    got = decontaminate.contamination(texts(spark, *docs), table)
    assert found(got, "doc_id", "n_words", "n_hit", "item_ids", "contaminated") == sorted(
        brute_hits(docs, items), key=lambda row: tuple((v is not None, str(v)) for v in row)
    )


def test_nothing_to_compare_with(spark):
    table = texts(spark, (1, "a b"), (2, None))
    got = decontaminate.contamination(table, benchmark(spark, (1, None)))
    assert found(got, "doc_id", "n_words", "n_hit", "contaminated") == [(1, 2, 0, False), (2, 0, 0, False)]
    assert decontaminate.contamination(table.limit(0), benchmark(spark, (1, "a"))).collect() == []


def test_a_long_text_with_a_common_passage(spark):
    passage = " ".join(f"b{k}" for k in range(30))
    rows = [(i, f"x{i} " * 50 + passage) for i in range(200)] + [(500, "word " * 80_000 + passage)]
    got = decontaminate.contamination(documents(spark, [(*r, "en", "s") for r in rows]), benchmark(spark, (1, passage)))
    assert {r.n_hit for r in got.collect()} == {30}
