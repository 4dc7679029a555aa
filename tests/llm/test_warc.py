"""Archives: whole records, offsets, revisits, hot payloads."""

import base64
import gzip
import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import words
from tillroll.llm import warc
from tillroll.session import scratch_dir

PAGES = "page_id long, url string, html string"


def pages(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    common = "<html>" + words(rng, 50) + "</html>"
    rows = [(i, f"http://e.org/{i}?a b\r\nX: y", rng.choice([common, f"<p>é{i}</p>", words(rng, 400), "<p>x</p>"])) for i in range(300)]
    rows += [(1000, None, None), (1001, "http://e.org/", ""), (None, "http://e.org/n", "no id"), (None, None, "no id"), (1002, "u", "no id"),
             (5, "http://again.org/", rows[5][2]), (1003, "u", "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"), (1004, "u", "long " * 200_000)]
    rng.shuffle(rows)
    return rows


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


@pytest.mark.parametrize("least", [0, 10])
def test_pages_come_back(spark, least, monkeypatch):
    rows = pages(1)
    df = spark.createDataFrame(rows, PAGES).repartition(3).withColumns({c: F.lit(1) for c in ("digest", "archive", "ordinal", "bytes", "n")})
    got = warc.archive_pages(df, min_bytes=least).collect()
    assert len(got) == len(rows)
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest) for r in got) == sorted(
        (str(i), len((h or "").encode()), digest(h)) for i, _, h in rows)
    by_digest: dict = {}
    for r in got:
        by_digest.setdefault(r.payload_digest, []).append(r)
    for group in by_digest.values():
        responses = [r for r in group if r.record_type == "response"]
        if group[0].payload_bytes < least:
            assert len(responses) == len(group) and all(r.refers_to is None for r in group)
            continue
        best = max((r.page_id for r in group if r.page_id is not None), default=None)
        assert len(responses) == 1 and responses[0].page_id == best and responses[0].refers_to is None
        assert all(r.record_type == "revisit" and r.refers_to == best for r in group if r is not responses[0])


def test_archives_on_disk(spark):
    """Whole-file streams become members that the sidecar reaches one by one."""
    rows = pages(2)
    root = scratch_dir(spark, "warc-test")
    captured = warc.written(warc.capture(spark.createDataFrame(rows, PAGES).repartition(2), root), "captured")
    archives = warc.normalise(warc.revisits(captured), root).collect()
    assert sum(a.records for a in archives) == len(rows)
    for a in archives:
        whole = gzip.open(f"{root}/{a.archive.replace('members', 'raw')}").read()
        assert whole.count(b"WARC-Record-ID") == a.records
        data = open(f"{root}/{a.archive}", "rb").read()
        assert len(data) == a.bytes
        end, ids = 0, set()
        for line in open(f"{root}/{a.archive}.idx"):
            at = json.loads(line)
            assert at["offset"] == end
            end += at["length"]
            ids.add(at["id"])
            record = gzip.decompress(data[at["offset"]:end])
            head, _, rest = record.partition(b"\r\n\r\n")
            size = int(re.search(rb"Content-Length: (\d+)", head)[1])
            assert record.startswith(b"WARC/1.1\r\n") and rest[size:] == b"\r\n\r\n" and f"<{at['id']}>".encode() in head
            assert head.count(b"\r\n") == (9 if at["type"] == "revisit" else 7)  # a URL can't add a line
        assert end == len(data) and len(ids) == a.records


def test_rolling_and_hot_payloads(spark, monkeypatch):
    rows = [(i, f"u{i}", "same" if i % 3 else f"own {i}") for i in range(900)]
    monkeypatch.setattr(warc, "ARCHIVE_RECORDS", 64)
    root = scratch_dir(spark, "warc-roll")
    got = warc.archive_pages(spark.createDataFrame(rows, PAGES).coalesce(1), root)
    assert got.select("archive").distinct().count() >= 1
    assert got.where("record_type = 'revisit'").count() == 599
    assert {r.refers_to for r in got.where("record_type = 'revisit'").collect()} == {899}


def test_broken_streams_and_no_pages(spark):
    assert warc.archive_pages(spark.createDataFrame([], PAGES)).count() == 0
    whole = gzip.compress(warc.record("response", "urn:page:1/a/0", "u", "X", b"abc"))
    assert [b for _, b in warc.inflate_records(iter([whole[:20], whole[20:]]))] == [b"abc"]
    with pytest.raises(ValueError, match="after the last whole record"):
        list(warc.inflate_records(iter([gzip.compress(warc.record("response", "urn:page:1/a/0", "u", "X", b"abc")[:-3])])))
