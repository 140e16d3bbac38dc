"""Archives: round trip, revisits, and files that other readers understand."""

import base64
import glob
import gzip
import hashlib
import uuid

from tabscout.functions.lineage import shared_folder
from tabscout.llm.warc import read_archives, records, round_trip, write_archives

PAGES = [
    (1, "http://a/1", "<p>same</p>"),
    (2, "http://a/2", "other"),
    (7, "http://a/7", "<p>same</p>"),
    (5, None, "<p>same</p>"),
    (3, "http://a/3\r\nX: y", None),
    (4, "http://a/4", ""),
    (None, "http://a/n", "other"),
    (9, "http://a/9", "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n é 漢"),
    (10, "http://a/10", "tie"),
    (10, "http://a/10", "tie"),
    (None, "u", "alone"),
    (None, "u", "alone"),
    (12, "http://long", "ab " * 200_000),
]


def pages(spark):
    rows = [(*p, "X", "Y") for p in PAGES]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, digest string, original string").repartition(3)


def expected(least):
    out = []
    for page, _, html in PAGES:
        raw = (html or "").encode()
        same = [p for p, _, h in PAGES if (h or "").encode() == raw and p is not None]
        first = max(same, default=None) if sum((h or "").encode() == raw for _, _, h in PAGES) > 1 and len(raw) >= least else None
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        revisit = first is not None and page != first
        out.append((page, len(raw), digest, "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    for least in (0, 4):
        rows = round_trip(pages(spark), least).collect()
        assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=str) == expected(least)


def test_files_hold_whole_records(spark):
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    write_archives(pages(spark), path)
    found = {}
    for name in glob.glob(f"{path}/*.gz"):
        with gzip.open(name) as archive:
            for fields, block in records(archive):
                found.setdefault(fields["warc-record-id"], (fields, block))
                assert b"\n" not in fields.get("warc-target-uri", "").encode()
    for fields, block in found.values():
        if fields["warc-type"] == "revisit":
            original = found[fields["warc-refers-to"]]
            assert original[0]["warc-payload-digest"] == fields["warc-payload-digest"] and block.endswith(b"\r\n\r\n")
    payloads = {r.page_id: r.payload for r in read_archives(spark, path, payloads=True).collect()}
    assert bytes(payloads[9]).decode() == dict((p, h) for p, _, h in PAGES)[9]
    assert payloads[1] is None


def test_empty_table(spark):
    assert round_trip(pages(spark).where("page_id = -1")).count() == 0
