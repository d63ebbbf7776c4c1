"""WARC archives: a writer that stores equal payloads once, and a splittable reader.

Records are gzip members of their own. Reading tasks get byte ranges of the files, look for the gzip magic, and take a
candidate only if its first bytes unpack to a WARC header; from there on members follow one another. A task owns the
records that start inside its range and reads past its end to finish the last one.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thornwall.config import shared_folder
from thornwall.llm.common import file_system, parts, task_name, written

MAGIC = b"\x1f\x8b\x08"
#: Fixed: the profile of a revisit by equal payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes read at once, and bytes of a range that one task reads.
CHUNK, SPLIT = 1 << 20, 16 << 20
NAMES = uuid.UUID("8c2b1f0e-5d1c-5a41-9f0b-2f6f6f0a7b11")


def _head(values: list[tuple[str, object]]) -> bytes:
    clean = [(k, "".join(c if " " <= c != "\x7f" else "%" + c.encode().hex() for c in str(v))) for k, v in values if v is not None]
    return "".join(f"{k}: {v}\r\n" for k, v in clean).encode()


def record_id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, f'{page} {digest}')}>"


def record(page: int | None, url: str | None, payload: bytes, original: int | None) -> bytes:
    """One gzip member: a response, or a revisit of page ``original`` without the payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = b"HTTP/1.1 200 OK\r\n" + _head([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))]) + b"\r\n"
    values: list[tuple[str, object]] = [
        ("WARC-Type", "response" if original is None else "revisit"),
        ("WARC-Record-ID", record_id(page, digest)),
        ("WARC-Date", "1970-01-01T00:00:00Z"),  # the table has no time of capture
        ("WARC-Target-URI", url if url is not None else "urn:unknown"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Page-Id", page),
    ]
    if original is None:
        block += payload
    else:
        values += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(original, digest)), ("Page-Refers-To", original)]
    head = b"WARC/1.1\r\n" + _head([*values, ("Content-Length", len(block))]) + b"\r\n"
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(head) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def write_archives(
    pages: DataFrame, folder: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """Write a record per row; returns the manifest (path, bytes, records). One archive per task."""
    payload = F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    narrow = written(rows.select("page", "digest", F.octet_length("payload").alias("bytes")), "digests")
    owners = narrow.where((F.col("bytes") >= min_bytes) & F.col("page").isNotNull()).groupBy("digest")
    owners = owners.agg(F.min("page").alias("original"), F.count("*").alias("many")).where("many > 1").drop("many")
    copies = narrow.join(owners, "digest").where("page is not null and page <> original").select("page", "digest", "original").distinct()
    joined = rows.join(copies, ["page", "digest"], "left").select("page", "url", "payload", "original")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(folder)
        part, attempt = task_name()
        name = f"pages-{part:06d}-{attempt}.warc.gz"
        out = None
        size = many = 0
        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if out is None:
                    out = system.open_output_stream(f"{base}/{name}", compression=None)
                data = record(*row)
                out.write(data)
                size += len(data)
                many += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "bytes": size, "records": many}])

    system, base = file_system(folder)
    system.create_dir(base, recursive=True)
    return written(joined.mapInArrow(run, "path string, bytes long, records long"), "manifest")


class Members:
    """The records of one file that start in a byte range, as unpacked bytes."""

    def __init__(self, source, start: int, stop: int) -> None:
        self.source, self.stop = source, stop
        self.at = start
        self.held = b""

    def _more(self) -> bool:
        self.source.seek(self.at + len(self.held))
        data = self.source.read(CHUNK)
        self.held += data
        return bool(data)

    def _skip(self, many: int) -> None:
        self.at += many
        self.held = self.held[many:]

    def _unpack(self) -> tuple[bytes, int] | None:
        """(record, packed bytes) of the member at the present place, None if it is no WARC record."""
        reader = zlib.decompressobj(31)
        out: list[bytes] = []
        checked, fed = False, 0
        try:
            while not reader.eof:
                if fed == len(self.held) and not self._more():
                    return None
                piece = reader.decompress(self.held[fed : fed + CHUNK])
                fed = min(len(self.held), fed + CHUNK)
                out.append(piece)
                if not checked and sum(map(len, out)) >= 8:
                    if not b"".join(out).startswith(b"WARC/1."):
                        return None
                    checked = True
        except zlib.error:
            return None
        whole = b"".join(out)
        return (whole, fed - len(reader.unused_data)) if checked and b"\r\n\r\n" in whole else None

    def __iter__(self) -> Iterator[bytes]:
        while True:
            while len(self.held) < len(MAGIC):
                if not self._more():
                    return
            place = self.held.find(MAGIC)
            if place < 0:
                self._skip(len(self.held) - len(MAGIC) + 1)
                if self.at >= self.stop:
                    return
                continue
            self._skip(place)
            if self.at >= self.stop:
                return
            found = self._unpack()
            if found is None:
                self._skip(1)
            else:
                yield found[0]
                self._skip(found[1])


def _values(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.lower(): v for k, _, v in (line.partition(": ") for line in lines) if k}


def parse(whole: bytes) -> dict[str, object]:
    """What a record says: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (None for a revisit).

    The length and digest of a response are those of its payload as read; those of a revisit come from its headers.
    """
    head, _, block = whole.partition(b"\r\n\r\n")
    values = _values(head)
    block = block[: int(values["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    response = values["warc-type"] == "response"
    page, refers = values.get("page-id"), values.get("page-refers-to")
    return {
        "page_id": None if page is None else int(page),
        "url": values.get("warc-target-uri"),
        "payload_bytes": len(payload) if response else int(_values(http)["content-length"]),
        "payload_digest": base64.b32encode(hashlib.sha1(payload).digest()).decode() if response else values["warc-payload-digest"].removeprefix("sha1:"),
        "record_type": values["warc-type"],
        "refers_to": None if refers is None else int(refers),
        "payload": payload if response else None,
    }


def read_archives(files: DataFrame, split: int = SPLIT, payloads: bool = False) -> DataFrame:
    """The records of ``files`` (path, bytes), every range of ``split`` bytes a task's work.

    Returns (page_id, payload_bytes, payload_digest, record_type, refers_to), with url and payload too if wanted.
    Bytes that are no WARC record are passed over.
    """
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
    if payloads:
        kinds |= {"url": pa.string(), "payload": pa.binary()}
    shape = pa.schema(list(kinds.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, stop in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                system, place = file_system(path)
                with system.open_input_file(place) as source:
                    rows: list[dict] = []
                    size = 0
                    for whole in Members(source, start, stop):
                        rows.append({k: v for k, v in parse(whole).items() if k in kinds})
                        size += len(whole) if payloads else 200
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=shape)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=shape)

    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split).cast("long")))
    ranges = files.where("bytes > 0").select("path", starts.alias("start"), "bytes")
    ranges = ranges.select("path", "start", F.least("bytes", F.col("start") + F.lit(split)).alias("stop"))
    ddl = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return ranges.repartition(parts(files.sparkSession), "path", "start").mapInArrow(run, ddl + (", url string, payload binary" if payloads else ""))


def archive_report(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write all pages and read the archives back: (page_id, payload_bytes, payload_digest, record_type, refers_to).

    Of equal payloads of at least ``min_bytes`` the one with the smallest id is a response, the others revisit it; rows
    that repeat the smallest id are responses too. Null html is the empty payload. A null id is always a response.
    """
    folder = shared_folder(pages.sparkSession)
    return read_archives(write_archives(pages, folder, min_bytes))
