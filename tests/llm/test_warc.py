import gzip
import random
from pathlib import Path

import pytest

from queuescope.llm import warc
from queuescope.llm.common import Scratch


def test_surt():
    for url, want in [
        ("http://www.Blog.Example.com:80/a/B?x=1#f", "com,example,blog)/a/B?x=1"), ("https://e.org", "org,e)/"),
        ("https://u:p@e.org:444/", "org,e:444)/"), ("http://e.org/a b\tc", "org,e)/a%20b%09c"), (None, "-"), ("nope", "-nope"),
        ("http://[bad", "-http://[bad"), ("http://[::1]:8080/x", "::1:8080)/x"),
    ]:
        assert warc.surt(url) == want


def plain(rows, least):
    best = {}
    for place, (id_, _, html) in enumerate(rows):
        payload = (html or "").encode()
        if len(payload) >= least:
            best[payload] = max(best.get(payload, (False, 0, 0)), (id_ is not None, id_ or 0, place))
    out = []
    for place, (id_, _, html) in enumerate(rows):
        payload = (html or "").encode()
        last = best.get(payload, (None, None, place))
        kind = "response" if last[2] == place else "revisit"
        refers = None if kind == "response" else (last[1] if last[0] else None)
        out.append((id_, len(payload), warc.payload_digest(payload), kind, refers))
    return sorted(out, key=str)


@pytest.mark.parametrize(("least", "bound", "chars"), [(0, 500_000, 16_000_000), (30, 0, 16_000_000), (0, 500_000, 9)])
def test_round_trip(spark, monkeypatch, least, bound, chars):
    monkeypatch.setattr(warc, "BROADCAST_CHARS", chars)
    monkeypatch.setattr(warc, "BLOCK_LINES", 7)
    monkeypatch.setattr(warc, "READ_BYTES", 2000)
    monkeypatch.setattr(warc, "BROADCAST_REVISITS", bound)
    rng = random.Random(3)
    urls = [f"http://h{rng.randint(1, 4)}.e.org/p{rng.randint(1, 9)}" for _ in range(150)] + ["http://one.org/"] * 60 + [None, "x y", "é\r\n"]
    htmls = ["", None, "a\r\n\r\nb", "日本" * 20, "long " * 20_000] + [f"<p>{k} {'x' * rng.randint(0, 60)}" for k in range(60)]
    rows = [(k if k % 40 else None, u, rng.choice(htmls)) for k, u in enumerate(urls)]
    rows += [rows[5], rows[5]]
    pages = spark.createDataFrame([(*r, 1, "t") for r in rows], "page_id int, url string, html string, row int, type string").coalesce(1)
    pages = pages.repartitionByRange(3, F_row(pages))
    scratch = Scratch(spark, "t")
    archive = warc.write_archive(pages, scratch, least=least)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_pages(archive, scratch).collect()), key=str)
    assert got == plain(rows, least)
    one = spark.createDataFrame([("org,one)/", None), ("no,such)/", None), ("org,e,h1)/p1", 10**9), (None, 1)], "key string, row long")
    found = warc.read_records(archive, warc.lookup(archive, one)).collect()
    assert len(found) == 60
    by_row = {r.row: r for r in found}
    assert {bytes(r.payload) for r in found if r.type == "response"} <= {(h or "").encode() for h in htmls}
    assert len(by_row) == 60 and archive.directory.count() > 20
    folder = Path(archive.folder.removeprefix("file:"))
    told = {r.file: (r.records, r.bytes) for r in archive.manifest.collect()}
    assert set(told) == {f.name for f in folder.glob("*.gz")}
    assert sum(n for n, _ in told.values()) == len(rows)
    assert all((folder / f).stat().st_size == size for f, (_, size) in told.items())
    for file in folder.glob("*.warc.gz"):
        raw = gzip.decompress(file.read_bytes())  # members one after the other, as any reader takes them
        assert raw.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and raw.endswith(b"\r\n\r\n")


def F_row(pages):
    from pyspark.sql import functions as F

    return F.monotonically_increasing_id()


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    scratch = Scratch(spark, "t")
    assert warc.read_pages(warc.write_archive(pages, scratch), scratch).collect() == []


def test_urls_with_line_separators(spark):
    urls = ["http://e.org/a\u0085b", "http://e.org/\u2028", "http://e.org/x\u2029y?\u0085z", "no\u2028url", "http://e.org/plain"]
    rows = [(k, u, f"<p>{k // 2}") for k, u in enumerate(urls)]
    scratch = Scratch(spark, "t")
    archive = warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), scratch)
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_pages(archive, scratch).collect()]
    assert sorted(got, key=str) == plain(rows, 0)


@pytest.mark.parametrize("most", [1, 3])
def test_more_parts_than_a_task_gets(spark, monkeypatch, most):
    monkeypatch.setattr(warc, "BROADCAST_PARTS", most)
    monkeypatch.setattr(warc, "BLOCK_LINES", 4)
    rows = [(k, "http://hot.org/" if k % 3 else f"http://h{k}.org/", f"<p>{k % 50}") for k in range(120)]
    scratch = Scratch(spark, "t")
    monkeypatch.setattr(warc, "INDEX_LINES", 15)
    monkeypatch.setattr(warc, "TASK_BYTES", 5_000)
    archive = warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), scratch)
    assert archive.directory.where("block = 0").count() > 3
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_pages(archive, scratch).collect()]
    assert sorted(got, key=str) == plain(rows, 0)
    asked = spark.createDataFrame([("org,hot)/", None), ("org,h0)/", None), ("a", None), ("z", 1)], "key string, row long")
    assert warc.lookup(archive, asked).count() == 81
