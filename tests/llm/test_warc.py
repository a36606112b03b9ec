from __future__ import annotations

import base64
import gzip
import hashlib
import io

import pytest

from machinepulse.llm import registry, warc
from tests.llm.rows import found, pages


def record(payload=b"<p>x</p>", kind="response", refers_to=None):
    digest = warc.sha1_base32(payload)
    body = payload if kind == "response" else None
    return warc.Record("urn:page:1", kind, "http://a.b/", body, len(payload), digest, refers_to)


def test_records_come_back():
    made = [record(), record(b""), record(b"a\r\n\r\nb" * 9), record(kind="revisit", refers_to="urn:page:7")]
    data = b"".join(map(warc.serialize, made))
    for chunk in (1, 7, 1 << 20):
        got = list(warc.records(io.BytesIO(data), chunk))
        assert [(r.record_type, r.payload, r.payload_bytes, r.refers_to) for r in got] == [
            (r.record_type, r.payload, r.payload_bytes, r.refers_to) for r in made
        ]
    # Any gzip tool reads the members one after the other.
    assert gzip.decompress(data).count(b"WARC/1.1\r\n") == 4


def test_damage_is_noticed():
    whole = warc.serialize(record(b"abc" * 100))
    with pytest.raises(ValueError, match="cut short"):
        list(warc.records(io.BytesIO(whole + whole[:50])))
    plain = gzip.decompress(whole)
    for changed in (
        plain.replace(b"abcabc", b"abcabd", 1),
        plain.replace(b"sha1:", b"sha1:A", 1),
    ):
        with pytest.raises(warc.DigestError):
            list(warc.records(io.BytesIO(gzip.compress(changed))))
    for changed in (plain[:-1], plain + b"x", b"junk" + plain):
        with pytest.raises(ValueError):
            list(warc.records(io.BytesIO(gzip.compress(changed))))


def expected(rows):
    first = {}
    for page, _, html in rows:
        body = html or ""
        if page is not None and (body not in first or page < first[body]):
            first[body] = page
    out, seen = [], set()
    for page, _, html in rows:
        body = (html or "").encode()
        best = first.get(html or "")
        response = page == best and body not in seen
        if response:
            seen.add(body)
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out.append((page, len(body), digest, "response" if response else "revisit",
                    None if response else best))
    return sorted(out, key=lambda row: tuple((v is not None, str(v)) for v in row))


def read_back(spark, table, **how):
    manifest = warc.write_archives(table, **how)
    return warc.read_archives(spark, manifest), manifest


COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers")


def of(records):
    from pyspark.sql import functions as F

    page = lambda c: F.expr(f"try_cast(split({c}, ':')[2] AS bigint)")
    return records.withColumns({"page_id": page("record_id"), "refers": page("refers_to")})


def test_copies_revisit_the_smallest_page(spark):
    rows = [(i, f"http://h/{i}", "<p>hot</p>") for i in range(5, 300)]
    rows += [(1, "http://h/a\r\nb", None), (2, "u", ""), (3, None, "ü" * 50_000), (4, "u", "x")]
    rows += [(9, "u", "twice"), (9, "u", "twice"), (None, "u", "x")]
    records, manifest = read_back(spark, pages(spark, *rows), archive_bytes=4000)
    assert manifest.count() > 2
    assert found(of(records), *COLUMNS) == expected(rows)
    bodies = {r.target_uri: r.payload for r in records.where("record_type = 'response'").collect()}
    assert bodies[None] == ("ü" * 50_000).encode() and "http://h/a%0Ab" in bodies


def test_short_payloads_are_all_responses(spark):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")]
    records, _ = read_back(spark, pages(spark, *rows), least_bytes=4)
    kinds = dict(found(of(records), "page_id", "record_type"))
    assert kinds == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_an_empty_table(spark):
    records, manifest = read_back(spark, pages(spark, (1, "u", "x")).limit(0))
    assert manifest.count() == 0 and records.count() == 0


def test_an_archive_that_lost_records_fails(spark):
    from pyspark.sql import functions as F

    _, manifest = read_back(spark, pages(spark, (1, "u", "x")))
    with pytest.raises(Exception, match="has 1 records, not 2"):
        warc.read_archives(spark, manifest.withColumn("n_records", F.lit(2))).collect()
    assert registry.queries()["op5_warc"] is registry.op5_warc
