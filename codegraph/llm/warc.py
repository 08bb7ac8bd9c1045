"""Web archives: write records, index them first, then read them back by coalesced byte ranges."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import urllib.parse
import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import new_path, stage

#: A task starts another archive beyond so many bytes.
FILE_BYTES = 256 << 20
#: Ranges of one file with gaps up to GAP are read at once, up to READ bytes; a reading task gets about TASK bytes.
GAP, READ, TASK = 64 << 10, 8 << 20, 64 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "file string, offset long, length long, page_id long, url string, payload_digest string, payload_bytes long, record_type string, refers_to long"
RECORD = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _escaped(url: str, also: str = "") -> str:
    return re.sub(rf"[\x00-\x20\x7f-\xa0{also}]", lambda m: urllib.parse.quote(m[0]), url)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, record_id: str | None = None) -> bytes:
    """One record as a gzip member. A revisit names the page with the payload and keeps its length instead of it.

    The target is the URL with blanks and controls escaped; a URL that has some is kept as it is in a field of its own.
    """
    number = lambda p: "none" if p is None else str(p)
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{record_id or uuid.uuid4()}>", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", f"X-Page-ID: {number(page_id)}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_escaped(url)}")
        if _escaped(url) != url:
            head.append(f"X-Page-URL: {_escaped(url, '%')}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page: {refers_to}"]
    return gzip.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n", 5, mtime=0)


def parse(member: bytes) -> tuple:
    """``(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to)`` of one gzip member; checks the digest."""
    head, _, rest = gzip.decompress(member).partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    field = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    number = lambda x: None if x in (None, "none") else int(x)
    http, _, payload = rest[: int(field["content-length"])].partition(b"\r\n\r\n")
    size, digest = int(re.search(rb"(?i)\ncontent-length: (\d+)", http)[1]), field["warc-payload-digest"].removeprefix("sha1:")
    revisit = field["warc-type"] == "revisit"
    if not revisit and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"the payload of {field['warc-record-id']} is damaged")
    url = urllib.parse.unquote(field["x-page-url"]) if "x-page-url" in field else field.get("warc-target-uri")
    return number(field["x-page-id"]), url, None if revisit else payload, size, digest, field["warc-type"], number(field.get("x-refers-to-page"))


def _qualified(spark, path: str) -> str:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return re.sub(r"^file:/+", "file:///", found)


def write_archives(pages: DataFrame, path: str | None = None, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write one record per row under ``path`` and return the index, one row per record.

    The payload is the html in UTF-8, empty for null. Of rows with equal payloads of at least ``min_bytes`` the largest
    page_id is a response and rows with other ids revisit it; rows that repeat that id are responses too, and so are
    rows of a group without any id. Which rows are revisits is found on digests alone; payloads are moved at most once.
    The index is written by Spark, so it lists the files of the tasks that succeeded; what a lost task left is no
    part of it.
    """
    spark = pages.sparkSession
    folder = _qualified(spark, path or new_path(spark, "warc"))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    light = stage(rows.where(F.octet_length("payload") >= min_bytes).select("page_id", "digest"), "digests")
    first = stage(light.groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first"), "first")
    again = stage(light.join(first, "digest").where("not page_id <=> first").select(F.col("page_id").alias("id"), F.col("digest").alias("same"), "first").distinct(), "revisits")
    marked = rows.join(again, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("same")), "left").select("page_id", "url", "payload", "first")

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = arrow_fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        out, at, name = None, 0, ""
        try:
            for frame in frames:
                index = []
                for page_id, url, payload, refers_to in zip(*(frame[c].astype(object).where(frame[c].notna(), None) for c in ("page_id", "url", "payload", "first"))):
                    if out is None or at >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"part-{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    ids = [None if x is None else int(x) for x in (page_id, refers_to)]
                    digest = base32_sha1(payload)
                    # The same for a record that is written again at the same place of a file, and for no other.
                    member = record(ids[0], url, payload, digest, ids[1], str(uuid.uuid5(uuid.NAMESPACE_URL, f"{name}/{at}")))
                    out.write(member)
                    index.append((f"{folder}/{name}", at, len(member), ids[0], url, digest, len(payload), "response" if ids[1] is None else "revisit", ids[1]))
                    at += len(member)
                yield pd.DataFrame(index, columns=[c.split()[0] for c in INDEX.split(", ")], dtype=object)
        finally:
            if out is not None:
                out.close()

    return stage(marked.mapInPandas(write, INDEX), "warc-index")


def read_records(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records that the rows of ``index`` (file, offset, length) name; payload is null for revisits or if not asked for.

    Rows are dealt out by ranges of file and offset and sorted; neighbours are read with one request. A record whose
    payload doesn't have its digest fails the job.
    """
    total = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, source = [], _Ranges()
        with source:
            for frame in frames:
                for file, offset, length in frame.itertuples(index=False):
                    if held and (file != held[0][0] or offset - held[-1][1] - held[-1][2] > GAP or offset + length - held[0][1] > READ):
                        yield _frame(source.fetch(held), payloads)
                        held = []
                    held.append((file, offset, length))
            if held:
                yield _frame(source.fetch(held), payloads)

    dealt = index.select("file", "offset", "length").repartitionByRange(max(1, -(-total // TASK)), "file", "offset").sortWithinPartitions("file", "offset")
    return dealt.mapInPandas(read, RECORD)


class _Ranges:
    """Reads sorted byte ranges; one file is open at a time."""

    def __init__(self):
        self.name = self.handle = None

    def __enter__(self):
        return self

    def __exit__(self, *_):
        if self.handle is not None:
            self.handle.close()

    def fetch(self, held: list[tuple]) -> list[tuple]:
        """The records of neighbouring ranges ``(file, offset, length)`` of one file, by one request."""
        if held[0][0] != self.name:
            self.__exit__()
            self.name = held[0][0]
            fs, path = arrow_fs.FileSystem.from_uri(self.name)
            self.handle = fs.open_input_file(path)
        start = held[0][1]
        data = self.handle.read_at(max(o + n for _, o, n in held) - start, start)
        return [parse(data[o - start : o - start + n]) for _, o, n in held]


def _frame(rows: list[tuple], payloads: bool) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in RECORD.split(", ")], dtype=object)
    if not payloads:
        out["payload"] = None
    return out
