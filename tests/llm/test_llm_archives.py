import base64
import hashlib
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from tidemark.llm import warc
from tidemark.llm.scratch import scratch_path

SCHEMA = "page_id long, url string, html string, k long, sha string, at long, first long"


def expected(rows, least=0):
    first = {}
    for k, _, h, *_ in rows:
        h = h or ""
        if len(h.encode()) >= least and k is not None:
            first[h] = min(first.get(h, k), k)
    counts = [h or "" for _, _, h, *_ in rows]
    out = []
    for k, _, h, *_ in rows:
        b = (h or "").encode()
        again = h or ""
        revisit = again in first and counts.count(again) > 1 and k != first[again]
        out.append((k, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", first[again] if revisit else None))
    return sorted(out, key=repr)


def pages(n):
    body = lambda i: f"<html><body>{'<p>paragraph of page</p>' * (i % 9)} <h1>Ünï {i} 漢</h1></body></html>"
    rows = [(i, f"http://example.org/{i}\r\nX: y", body(i % 37 if i % 4 == 0 else i), 0, "", 1, 2) for i in range(n)]
    return rows + [(1000, None, None, 0, "", 1, 2), (1001, "", "", 0, "", 1, 2), (None, "u", body(4), 0, "", 1, 2), (None, None, "alone", 0, "", 1, 2), (7, "again", body(7), 0, "", 1, 2), (2000, "big", "<p>" + "x" * 3_000_000, 0, "", 1, 2)]


@pytest.mark.parametrize("least", [0, 60])
def test_round_trip(spark, least):
    rows = pages(200)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    path = scratch_path(spark, "warc")
    warc.write_archives(df, path, least=least, file_bytes=8000)
    warc.name_archives(spark, path)
    got = warc.read_archives(spark, path, payload=True).collect()
    assert all(r["problem"] is None and r["file"].endswith(".warc.zst") for r in got) and len({r["file"] for r in got}) > 3
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=repr) == expected(rows, least)
    text = {(k, h or "") for k, _, h, *_ in rows}
    assert all((r["page_id"], r["payload"].decode()) in text for r in got if r["record_type"] == "response")


def test_no_pages(spark):
    assert warc.archived(spark.createDataFrame([], SCHEMA)).count() == 0


def archive(records, dictionary=b"", **options):
    data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    out = warc.dictionary_frame(dictionary) if dictionary else b""
    return out + b"".join(zstandard.ZstdCompressor(dict_data=data, **options).compress(r) for r in records)


def test_dictionary_comes_from_the_first_frame():
    records = [warc.record(i, f"http://a.b/{i}", f"<p>common words of every page {i}</p>".encode() * 3) for i in range(300)]
    dictionary = zstandard.train_dictionary(2048, records).as_bytes()
    content = archive(records, dictionary)
    assert struct.unpack_from("<I", content)[0] == warc.DICTIONARY_MAGIC
    got = list(warc.read_archive(content))
    assert [p for _, _, p in got] == [None] * 300 and got[5][1]["headers"]["X-Page-ID"] == "5"
    raw = struct.pack("<II", warc.DICTIONARY_MAGIC, len(dictionary)) + dictionary  # the dictionary may also stand there as it is
    cut = content[8 + struct.unpack_from("<I", content, 4)[0]:]
    assert [p for _, _, p in warc.read_archive(raw + cut)] == [None] * 300
    assert all(p for _, _, p in warc.read_archive(cut))  # without it nothing decodes


def test_frames_without_stated_size_and_foreign_skippable_frames():
    records = [warc.record(i, "u", b"x" * i * 50_000) for i in range(4)]
    skip = struct.pack("<II", 0x184D2A53, 5) + b"hello"
    parts = [archive([r], write_content_size=False, write_checksum=True) for r in records]
    assert [r["payload_bytes"] for _, r, _ in warc.read_archive(skip.join(parts) + skip)] == [0, 50_000, 100_000, 150_000]


def test_broken_archives_are_told():
    good = warc.record(1, "u", b"payload")
    bad = [good.replace(b"WARC/1.1", b"WARC/9.9"), good.replace(b"WARC-Date", b"WARC-Dote"), good.replace(b"payload", b"payl"), good[:-2], good.replace(b"payload", b"PAYLOAD"), b"no record",
           good.replace(b"Content-Length: 7\r\n", b"Content-Length: 9\r\n"), good.replace(b"WARC-Type: response", b"nonsense line")]
    got = list(warc.read_archive(archive([good, *bad, good])))
    assert [p is None for _, _, p in got] == [True] + [False] * len(bad) + [True]
    whole = archive([good], write_checksum=True)
    for cut in (whole[:-3], whole + b"\0\0\0", whole[:10], b"\0" * 20):
        assert list(warc.read_archive(cut))[-1][2] is not None
    flipped = bytearray(whole)
    flipped[len(whole) // 2] ^= 0xFF
    assert list(warc.read_archive(bytes(flipped)))[-1][2] is not None
    assert list(warc.read_archive(b"")) == []


def test_lost_records_do_not_pass(spark):
    """A record with a problem, or one record too few, fails; a sound archive passes whole."""
    df = spark.createDataFrame(pages(20), SCHEMA)
    records = warc.archived(df)
    assert warc.all_sound(records, df.count()).count() == df.count() and "problem" not in warc.all_sound(records, df.count()).columns
    with pytest.raises(warc.BadArchive):
        warc.all_sound(records.where("page_id IS NULL OR page_id <> 3"), df.count())
    with pytest.raises(Exception, match="broken archive"):
        warc.all_sound(records.withColumn("problem", F.when(F.col("page_id") == 3, "cut off")), df.count())
