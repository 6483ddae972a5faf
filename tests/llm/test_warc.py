import base64
import gzip
import hashlib
import io
import random

import pytest

from stratagrid.llm import warc

PAGES = "page_id long, url string, html string"


def brute(pages):
    best = {}
    for i, _, html in pages:
        best[html or ""] = max(best.get(html or "", i), i)
    out = []
    for i, _, html in pages:
        data = (html or "").encode()
        keep = best[html or ""]
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if i == keep else "revisit", None if i == keep else keep))
    return sorted(out)


def some_pages(n=400):
    r = random.Random(1)
    bodies = [None, "", "x", "<p>é\r\n\r\nWARC/1.1\r\n</p>", "y" * 300_000] + [f"<html>{r.random()}</html>" for _ in range(150)]
    return [(i, f"http://a b.example/{i}\n", r.choice(bodies)) for i in r.sample(range(-50, 5000), n)]


def test_round_trip(spark):
    pages = some_pages()
    rows = warc.report(spark.createDataFrame(pages, PAGES).repartition(3))
    assert sorted(map(tuple, rows.collect())) == brute(pages)


def test_small_archives_and_payloads(spark, tmp_path):
    pages = some_pages(100)
    manifest = warc.write(spark.createDataFrame(pages, PAGES), f"file://{tmp_path}/a", archive_bytes=2000)
    assert manifest.count() > 5 and len(list((tmp_path / "a").iterdir())) == manifest.count()
    html = {i: (h or "").encode() for i, _, h in pages}
    for r in warc.read_archives(manifest).collect():
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == html[r.page_id]
    for path in (tmp_path / "a").iterdir():  # any gzip reader can read them
        assert gzip.decompress(path.read_bytes()).startswith(b"WARC/1.1\r\n")


@pytest.mark.parametrize("chunk", [1, 7, 1 << 16])
def test_reader_takes_any_chunks(chunk):
    data = [warc.record(i, "u", bytes([i]) * i * 50, None, False) for i in range(20)]
    found = list(warc.read(io.BytesIO(b"".join(map(warc.member, data))), chunk))
    assert [r.payload for r in found] == [bytes([i]) * i * 50 for i in range(20)]


def test_damage_is_seen():
    good = warc.record(1, "u", b"payload", None, False)
    for bad in (good.replace(b"payload", b"paylaod"), good[:-1], good.replace(b"WARC/1.1", b"WARC/9.9"), good.replace(b"Content-Length: ", b"Content-Length: 1")):
        with pytest.raises(warc.Damaged):
            list(warc.read(io.BytesIO(warc.member(bad))))
    with pytest.raises(warc.Damaged):
        list(warc.read(io.BytesIO(warc.member(good)[:-3])))


def test_min_bytes_repeats_and_empty(spark):
    pages = spark.createDataFrame([(1, "u", "a"), (2, "u", "a"), (2, "u", "a"), (3, "u", "long one"), (4, "u", "long one"), (None, None, "long one")], PAGES)
    rows = warc.read_archives(warc.write(pages, min_bytes=2)).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to) for r in rows) == [(0, "revisit", 4), (1, "response", None), (2, "response", None), (2, "response", None), (3, "revisit", 4), (4, "response", None)]
    assert warc.report(pages.limit(0)).count() == 0
