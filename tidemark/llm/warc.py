"""WARC archives in Zstandard: one frame per record, the dictionary in a leading skippable frame."""

import base64
import hashlib
import re
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import land, scratch_path

# Fixed values of the formats
DICTIONARY_MAGIC = 0x184D2A5D            # skippable frame that holds the dictionary
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
FRAME_MAGIC = 0xFD2FB528
VERSIONS = (b"WARC/1.0", b"WARC/1.1")
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: An empty skippable frame.  Spark's text writer ends each row with it, so a file is frames only.
SEPARATOR = struct.pack("<II", 0x184D2A50, 0).decode("latin-1")


class BadArchive(ValueError):
    """A frame, header or length that does not hold."""


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def _clean(value: str) -> str:
    """A header value without line ends and blanks at which a reader would cut it."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page_id, url, payload: bytes, refers_to=None, date: str = "2000-01-01T00:00:00Z") -> bytes:
    """One WARC/1.1 record: a response with its payload, or with ``refers_to`` a revisit that has only the HTTP headers.

    Both carry the digest and, in the HTTP header, the length of the full payload.
    """
    digest = sha1_base32(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", date),
            ("WARC-Target-URI", _clean(url) if url else f"urn:page:{page_id}"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"),
            ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page", str(refers_to))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Headers, block and payload of one record; raises BadArchive when a header or a length does not hold."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise BadArchive("the header does not end")
    lines = data[:end].split(b"\r\n")
    if lines[0] not in VERSIONS:
        raise BadArchive(f"version {lines[0][:20]!r}")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon:
            raise BadArchive(f"header line {name[:40]!r}")
        headers[name.strip()] = value.strip()
    for name in REQUIRED:
        if name not in headers:
            raise BadArchive(f"no {name}")
    if not headers["Content-Length"].isdigit():
        raise BadArchive("Content-Length is no number")
    length = int(headers["Content-Length"])
    block, tail = data[end + 4:end + 4 + length], data[end + 4 + length:]
    if len(block) != length or tail != b"\r\n\r\n":
        raise BadArchive(f"Content-Length {length}, but {len(data) - end - 8} bytes follow")
    if "WARC-Block-Digest" in headers and headers["WARC-Block-Digest"] != f"sha1:{sha1_base32(block)}":
        raise BadArchive("block digest")
    http, blank, payload = block.partition(b"\r\n\r\n")
    found = re.search(rb"(?im)^content-length:\s*(\d+)", http) if blank else None
    stated = int(found[1]) if found else len(payload)
    if headers["WARC-Type"] == "response":
        if stated != len(payload):
            raise BadArchive("payload length")
        if "WARC-Payload-Digest" in headers and headers["WARC-Payload-Digest"] != f"sha1:{sha1_base32(payload)}":
            raise BadArchive("payload digest")
    return {"headers": headers, "payload": payload, "payload_bytes": stated}


def dictionary_frame(dictionary: bytes) -> bytes:
    """The leading frame: the dictionary itself, compressed."""
    body = zstandard.ZstdCompressor(level=9).compress(dictionary)
    return struct.pack("<II", DICTIONARY_MAGIC, len(body)) + body


def frame_end(data: memoryview, at: int) -> int:
    """End of the zstd frame that starts at ``at``, from its block headers."""
    try:
        pos = at + zstandard.frame_header_size(data[at:at + 18])
        checksum = 4 if data[at + 4] & 4 else 0
        while True:
            word = data[pos] | data[pos + 1] << 8 | data[pos + 2] << 16
            pos += 3 + (1 if word >> 1 & 3 == 1 else word >> 3)
            if word & 1:
                break
    except (IndexError, zstandard.ZstdError) as e:
        raise BadArchive(f"frame at {at}: {e}") from e
    if pos + checksum > len(data):
        raise BadArchive(f"frame at {at} is cut off")
    return pos + checksum


def read_archive(content: bytes):
    """Yield (offset, record or None, problem or None): records in order; a broken record is told and the next one read."""
    data, at, reader, first = memoryview(content), 0, zstandard.ZstdDecompressor(), True
    while at < len(data):
        if len(data) - at < 8:
            yield at, None, "bytes behind the last frame"
            return
        magic, size = struct.unpack_from("<II", data, at)
        if magic in SKIPPABLE:
            if at + 8 + size > len(data):
                yield at, None, "skippable frame is cut off"
                return
            if first and magic == DICTIONARY_MAGIC:
                body = bytes(data[at + 8:at + 8 + size])
                if body[:4] == struct.pack("<I", FRAME_MAGIC):
                    body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
                reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body))
            at, first = at + 8 + size, False
            continue
        first = False
        if magic != FRAME_MAGIC:
            yield at, None, f"no frame at {at}"
            return
        try:
            end = frame_end(data, at)
        except BadArchive as e:
            yield at, None, str(e)
            return
        try:
            yield at, parse_record(reader.decompressobj().decompress(bytes(data[at:end]))), None
        except (BadArchive, zstandard.ZstdError) as e:
            yield at, None, str(e)
        at = end


def train_dictionary(pages: DataFrame, html: str = "html", size: int = 32 << 10, sample: int = 400, longest: int = 64 << 10, seed: int = 9) -> bytes:
    """A dictionary of ``size`` bytes from about ``sample`` whole pages of at most ``longest`` bytes (both bounds are parameters),
    drawn by hash over the table; empty when there is too little to learn from.  It only affects how small the archive is."""
    body = F.coalesce(F.col(html), F.lit(""))
    fit = pages.select(body.alias("b")).where(F.octet_length("b").between(64, longest))
    n = fit.count()
    draw = F.pmod(F.xxhash64(F.lit(seed), "b"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    rows = fit.where(draw < min(1.0, sample / max(n, 1))).groupBy("b").agg(F.count(F.lit(1))).select("b").limit(4 * sample).collect()
    texts = [b"WARC/1.1\r\n" + r["b"].encode() for r in rows]
    if len(texts) < 16:
        return b""
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, texts)) // 8 + 256), texts).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0, file_bytes: int = 16 << 20, level: int = 3) -> None:
    """Write one record per row to ``path`` as ``part-*`` files of about ``file_bytes`` of payload (more where one page is larger).

    Of rows with equal payloads of at least ``least`` bytes the one with the smallest key is the response and the others
    are revisits of it.  Rows that share that smallest key are all responses; a null key is larger than any other, and where
    all keys of a payload are null, all are responses.  A null page is an empty payload, a null URL becomes a URN of the key.
    An empty table writes no record.

    Only key and digest are compared over the whole table (the smallest key per digest is combined before the shuffle);
    pages move once, to the task that writes them.  Files go through Spark's own writer, so a lost task is written again.
    """
    spark = pages.sparkSession
    body = F.coalesce(F.col(html), F.lit(""))
    link = pages.select(F.col(key).cast("long").alias("k"), F.col(url).cast("string").alias("u"), body.alias("b"))
    link = link.withColumn("sha", F.sha1(F.encode("b", "UTF-8"))).withColumn("at", F.xxhash64("k", "sha"))
    slim = land(link.select("k", "at", "sha", F.octet_length("b").cast("long").alias("n")), "warc-rows")
    firsts = slim.where(F.col("n") >= least).groupBy("sha").agg(F.min("k").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1 AND first IS NOT NULL")
    later = slim.join(firsts.select("sha", "first"), "sha").where(F.col("k").isNull() | (F.col("k") != F.col("first"))).select("at", "sha", "first").distinct()
    total = slim.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    files = max(1, -(-total // file_bytes))
    # one key column, so the pages' partitioning serves the join; the digest is compared as well
    same = F.col("l.sha").substr(1, 40) == F.col("d.sha").substr(1, 40)
    placed = link.repartition(int(files), "at").alias("d").join(later.alias("l"), "at", "left").select("k", "u", "b", F.when(same, F.col("first")).alias("first"))
    dictionary = train_dictionary(pages, html)

    def frames(batches):
        data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        squeeze = zstandard.ZstdCompressor(level=level, dict_data=data, write_content_size=True, write_checksum=True)
        opened = False
        for batch in batches:
            rows = zip(*(batch.column(i) for i in range(4)), strict=True)
            out = [dictionary_frame(dictionary)] if dictionary and not opened and batch.num_rows else []
            opened = opened or bool(batch.num_rows)
            for k, u, b, first in rows:
                out.append(squeeze.compress(record(k.as_py(), u.as_py(), b.as_py().encode("utf-8", "surrogatepass"), first.as_py())))
                if len(out) >= 256:
                    yield pa.RecordBatch.from_pydict({"frame": pa.array(out, pa.binary())})
                    out = []
            if out:
                yield pa.RecordBatch.from_pydict({"frame": pa.array(out, pa.binary())})

    placed.mapInArrow(frames, "frame binary").select(F.col("frame").cast("string").alias("value")).write.option("lineSep", SEPARATOR).text(path)


def name_archives(spark: SparkSession, path: str) -> None:
    """Give the files of ``write_archives`` the usual ending (a rename per file)."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for f in fs.listStatus(folder):
        name = f.getPath().getName()
        if name.startswith("part-") and name.endswith(".txt"):
            fs.rename(f.getPath(), spark._jvm.org.apache.hadoop.fs.Path(folder, name[:-4] + ".warc.zst"))


FIELDS = "file string, at long, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, problem string"


def read_archives(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """Records of all archives below ``path``, one row each; ``payload`` adds the bytes (null for a revisit).

    Every record is decoded from its own frame and its headers, lengths and digests are checked; a record that fails has
    only ``file``, ``at`` and ``problem``.  A file is one task's work, so archives should stay well below an executor's memory.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")

    def records(batches):
        names = [x.split()[0] for x in FIELDS.split(", ")] + ["payload"] * payload
        kinds = [{"string": pa.string(), "long": pa.int64()}[x.split()[1]] for x in FIELDS.split(", ")] + [pa.binary()] * payload
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                rows = []
                for at, rec, problem in read_archive(content.as_py()):
                    if rec is None:
                        rows.append((name.as_py(), at, *[None] * 6, problem, *[None] * payload))
                    else:
                        h = rec["headers"]
                        number = lambda x: int(x) if x is not None and re.fullmatch(r"-?\d+", x) else None
                        rows.append((name.as_py(), at, number(h.get("X-Page-ID")), h.get("WARC-Target-URI"), h["WARC-Type"], rec["payload_bytes"], h.get("WARC-Payload-Digest", "").removeprefix("sha1:"),
                                     number(h.get("X-Refers-To-Page")), None, *[rec["payload"] if h["WARC-Type"] == "response" else None] * payload))
                    if len(rows) >= 2000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds, strict=True)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds, strict=True)], names=names)

    return files.mapInArrow(records, FIELDS + (", payload binary" if payload else ""))


def archived(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` to archives in the session's shared folder, read them back, and return the records."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path, **options)
    name_archives(spark, path)
    return read_archives(spark, path)


def all_sound(records: DataFrame, pages: int) -> DataFrame:
    """``records`` without ``problem``, written once; fails where one has a problem, or where there are not as many as ``pages``."""
    said = F.raise_error(F.concat_ws(" ", F.lit("broken archive:"), "file", F.lit("at"), "at", F.lit("-"), "problem")).cast("boolean")
    out = land(records.where(F.when(F.col("problem").isNotNull(), said).otherwise(True)).drop("problem"), "warc-records")
    found = out.count()
    if found != pages:
        raise BadArchive(f"{found} records of {pages} pages")
    return out
