from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from machinepulse.operators import guide
from machinepulse.sources import quality
from tests.rows import by, only, pages, reading, readings

WHOLE = {number: f"text {number}" for number in range(1, 23)}


def headers(text: str) -> list[int]:
    return [int(line.split()[2]) for line in text.splitlines() if line.startswith("--- Page")]


@pytest.mark.parametrize(
    "kind,expected",
    [
        ("furnace", [6, 7, 17, 18, 19, 20, 21]),
        ("conveyor", [8, 7, 17, 18, 19, 20, 21]),
        ("slurry_pump", [10, 11, 7, 17, 18, 19, 20, 21]),
        ("motor", [12, 13, 7, 17, 18, 19, 20, 21]),
        ("other", [7, 17, 18, 19, 20, 21]),
    ],
)
def test_lookup(spark, kind, expected):
    row = by(guide.guide_for_type(pages(spark, WHOLE)), "guide_type")[kind]
    assert headers(row.guide_text) == expected
    assert row.guide_text.startswith(f"--- Page {expected[0]} ---\ntext {expected[0]}\n\n---")
    assert row.guide_chars == len(row.guide_text)


def test_pages_follow_the_document_not_their_numbers(spark):
    shuffled = {20: "t", 7: "g", 6: "f", 17: "s"}
    texts = by(guide.guide_for_type(pages(spark, shuffled)), "guide_type")
    assert headers(texts["furnace"].guide_text) == [7, 6, 20, 17]
    assert headers(texts["motor"].guide_text) == [20, 7, 17]


def test_guides_do_not_mix(spark):
    both = pages(spark, {7: "one"}, guide=1).union(pages(spark, {7: "two"}, guide=2))
    texts = by(guide.guide_for_type(both), "guide_id", "guide_type")
    assert texts[1, "motor"].guide_text == "--- Page 7 ---\none"
    assert texts[2, "motor"].guide_text == "--- Page 7 ---\ntwo"


@pytest.mark.parametrize(
    "name,kind",
    [("Slurry Pump", "slurry_pump"), ("FURNACE", "furnace"), ("crusher", "other"), (None, "other")],
)
def test_type_names(spark, name, kind):
    df = spark.createDataFrame([(name,)], "t string")
    assert only(df.select(guide.guide_type(F.col("t")).alias("k"))).k == kind


def test_page_list(spark):
    r = readings(spark, reading("A", machine_type="slurry pump"), reading("B", machine_type="x"))
    found = by(guide.guide_page_list(r), "machine_type")
    assert found["slurry pump"].pages == [10, 11, 7, 17, 18, 19, 20, 21]
    assert (found["x"].own_pages, found["x"].pages) == ([], [7, 17, 18, 19, 20, 21])


def test_profile_and_size(spark):
    content = {
        6: "",
        7: "First line " + "x" * 90 + "\nFURNACE Bearing, urgent; Output Format",
        17: "safety priority workflow cavitation impeller",
    }
    p = pages(spark, content)
    found = by(guide.guide_page_profile(p), "guide_type", "page")
    assert found["furnace", 6].page_state == "empty"
    assert found["furnace", 18].page_state == "not found"
    seven = found["furnace", 7]
    assert (seven.page_state, seven.place) == ("found", 2)
    assert seven.char_count == len(content[7]) and seven.first_line == content[7][:80]
    assert seven.keywords == "furnace, bearing, safety/urgent, output-format"
    assert found["motor", 7].keywords == "bearing, safety/urgent, output-format"
    assert found["motor", 17].keywords == (
        "cavitation, impeller, safety/urgent, priority, workflow"
    )
    total = len(content[7]) + len(content[17])
    size = by(guide.guide_size(p), "guide_type")["conveyor"]
    assert (size.char_count, size.token_estimate) == (total, int(total / 4 + 0.5))


def test_all_pages(spark):
    blocks = by(guide.guide_all(pages(spark, {3: "c", 1: None})), "position")
    assert blocks[1].block == "--- Page 3 ---\nc" and blocks[2].block == "--- Page 1 ---\n"


def test_repeated_pages_are_reported(spark):
    p = pages(spark, {7: "a", 8: "b"}).union(pages(spark, {7: "c"}))
    assert only(quality.repeated_pages(p)).page == 7
