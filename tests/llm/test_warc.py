"""WARC archives: exact round trips, chunk by chunk."""

import gzip
import hashlib
import io
import zlib

import pytest

from strandwise.llm import op10_warc as W
from strandwise.llm.storage import new_folder

BIG = "<p>é" * 70_000
SAME = "same payload " * 20
PAGES = [
    (1, "http://a/1", "short"),
    (2, "http://a/2", "short"),
    (3, "http://a b/3\r\nX: y", SAME),
    (4, None, SAME),
    (5, "http://a/5", None),
    (6, "http://a/6", ""),
    (7, "http://a/7", BIG),
    (8, "http://a/8", BIG + "!"),
    (9, "http://a/9", "\r\n\r\nWARC/1.1\r\n" * 30),
    (None, "http://a/n", SAME),
    (None, "http://a/m", "only nulls " * 20),
    (None, "http://a/m", "only nulls " * 20),
    (2, "http://a/2", "short"),
    (3, "http://a/3", SAME),
]


@pytest.mark.parametrize("chunk", [7, 1000, 1 << 20])
def test_round_trip(spark, chunk):
    pages = spark.createDataFrame(PAGES if chunk > 7 else [p for p in PAGES if len(p[2] or "") < 1000], "page_id bigint, url string, html string")
    rows = pages.collect()
    clash = pages.selectExpr("*", "'x' as body", "'x' as digest", "'x' as n_bytes", "'x' as chunk")
    paths = W.write_archives(spark, W.record_chunks(spark, clash, chunk), new_folder(spark, "warc"))
    got = W.read_archives(spark, paths).collect()
    last = [r for r in got if r["last"]]
    assert len(last) == len(rows)
    payload = {}
    for r in rows:
        body = (r.html or "").encode()
        payload.setdefault(r.page_id, set()).add((len(body), hashlib.sha256(body).hexdigest()))
    first = {}
    for r in rows:
        if r.html and len(r.html.encode()) >= 100 and r.page_id is not None:
            first[r.html] = min(first.get(r.html, r.page_id), r.page_id)
    digests = {hashlib.sha256(h.encode()).hexdigest(): p for h, p in first.items()}
    for r in last:
        assert (r.bytes_so_far, r.digest_so_far) in payload[r.page_id]
        keeper = digests.get(r.digest_so_far)
        is_revisit = keeper is not None and r.page_id != keeper
        assert (r.record_type, r.refers_to) == (("revisit", keeper) if is_revisit else ("response", None))
    for r in got:
        assert len(r.chunk) <= W.CHUNK_BYTES


def test_reader_chunks_carry_digests_so_far():
    body = bytes(range(256)) * 50
    head = W._head(9, "http://x", len(body), hashlib.sha256(body).hexdigest(), None)
    raw = gzip.compress(head + body + b"\r\n\r\n")
    rows = list(W.read_records(io.BytesIO(raw + raw), chunk_bytes=999))
    assert len(rows) == 2 * -(-len(body) // 999)
    done = b""
    for r in rows[: len(rows) // 2]:
        done += r[4]
        assert len(r[4]) <= 999 and (r[5], r[6]) == (len(done), hashlib.sha256(done).hexdigest())
    assert done == body and rows[len(rows) // 2 - 1][7]


@pytest.mark.parametrize("how", ["digest", "torn"])
def test_damage_is_noticed(how):
    body = b"payload " * 40
    head = W._head(1, "http://x", len(body), hashlib.sha256(body if how == "torn" else b"other").hexdigest(), None)
    raw = gzip.compress(head + body + b"\r\n\r\n")
    with pytest.raises((ValueError, zlib.error)):
        list(W.read_records(io.BytesIO(raw[: len(raw) - 30] if how == "torn" else raw)))


def test_empty(spark):
    none = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert W.read_archives(spark, W.write_archives(spark, W.record_chunks(spark, none), new_folder(spark, "warc"))).count() == 0
