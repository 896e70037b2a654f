"""WARC bundles: round trip, revisits, seeking."""

from __future__ import annotations

import base64
import hashlib
import io

import zstandard

from basketry.llm import warc
from basketry.llm.common import scratch

ROWS = [(1, "http://a/", "same"), (2, "http://b/ü x\r\nX: y", "same"), (3, None, "same"), (4, "http://c/", None), (5, "http://c/", ""),
        (6, "u", "unique ü 🙂\r\n\r\nWARC/1.1\r\n"), (7, "u", "x" * 200_000), (None, "n", "same"), (None, "n", "alone"), (3, "again", "same"),
        *[(100 + i, f"http://h/{i}", f"page {i % 40}" * 50) for i in range(80)]]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows],
                                 "page_id long, url string, html string, sha string, frame int")


def plain(rows):
    payload = lambda h: (h or "").encode()
    out = []
    for i, _, h in rows:
        same = [k for k, _, x in rows if payload(x) == payload(h)]
        top = max((k for k in same if k is not None), default=None)
        again = len(same) > 1 and top is not None and i != top
        out.append((i, len(payload(h)), base64.b32encode(hashlib.sha1(payload(h)).digest()).decode(),
                    "revisit" if again else "response", top if again else None))
    return sorted(out, key=str)


def test_round_trip_equals_plain_grouping(spark):
    for frame, bundle in ((warc.FRAME_BYTES, warc.BUNDLE_BYTES), (2000, 6000)):
        got = warc.archive(pages(spark, ROWS), frame_bytes=frame, bundle_bytes=bundle).collect()
        assert sorted((tuple(r)[:5] for r in got), key=str) == plain(ROWS)


def test_lookup_seeks_single_records(spark):
    folder = scratch(spark, "warc-test")
    index = warc.write(pages(spark, ROWS), folder, frame_bytes=3000)
    ids = spark.createDataFrame([(7,), (6,), (1,)], "page_id long")
    got = {r.page_id: r for r in warc.lookup(index, folder, ids).collect()}
    assert bytes(got[6].payload).decode() == ROWS[5][2] and len(got[7].payload) == 200_000
    assert got[1].payload is None and got[1].refers_to == 3
    assert index.select("frame").distinct().count() > 1


def test_a_bundle_is_plain_zstandard_with_a_seek_table():
    out = io.BytesIO()
    out.close = lambda: None
    w = warc.BundleWriter(out)
    parts = [b"first frame" * 10, b"", b"third" * 1000]
    for p in parts:
        w.frame(p)
    w.close()
    raw = out.getvalue()
    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read() == b"".join(parts)
    r = warc.BundleReader(io.BytesIO(raw), len(raw))
    assert [r.frame(k) for k in (2, 0, 1)] == [parts[2], parts[0], parts[1]]


def test_empty(spark):
    assert warc.archive(pages(spark, [])).collect() == []
