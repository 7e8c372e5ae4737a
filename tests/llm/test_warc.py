from __future__ import annotations

import base64
import gzip
import hashlib
import io

import pytest

from quillon.llm import warc
from quillon.llm.shared import shared_dir


def test_normaliser():
    raw = [warc.record(k, f"http://x/{k}", b"\r\n\r\nWARC/1.1" * k, warc.base32_sha1(b"\r\n\r\nWARC/1.1" * k), None) for k in range(20)] + [warc.record(None, None, b"", warc.base32_sha1(b""), 0)]
    for mono in (gzip.compress(b"".join(raw)), b"".join(map(gzip.compress, raw))):
        out = io.BytesIO()
        index = warc.normalise_file(io.BytesIO(mono), out)
        assert [gzip.decompress(out.getvalue()[o : o + n]) for o, n, _, _ in index] == raw
    with pytest.raises(ValueError):
        list(warc.inflate_records(io.BytesIO(gzip.compress(raw[3][:-5]))))


@pytest.mark.parametrize("least", [0, 3])
def test_archives(spark, least):
    pages = [(0, "u", "same"), (1, "u", None), (2, None, ""), (3, "a b", "same"), (4, "u", "é"), (5, "u", "x" * 2_000_000), (6, "u", "x" * 2_000_000), (7, "u", "é"), (None, "u", "lone")]
    d = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, payload int")
    path = shared_dir(spark, "test")
    got = {x["page_id"]: x for x in warc.read_archives(warc.archive(d, path, least), path).collect()}
    first = {}
    for k, _, h in pages:
        b = (h or "").encode()
        at = first.setdefault(b, k) if len(b) >= least else k
        x = got[k]
        assert (x["payload_bytes"], x["payload_digest"]) == (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode())
        assert (x["record_type"], x["refers_to"]) == (("response", None) if at == k else ("revisit", at))
        assert (bytes(x["payload"]) if at == k else x["payload"]) == (b if at == k else None)
    assert len(got) == len(pages)


def test_no_pages(spark):
    path = shared_dir(spark, "test")
    d = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.archive(d, path), path).count() == 0
