"""WARC archives: a writer with revisit records and a splittable reader.

Writing: pages with equal payloads (by SHA-1 digest and length) share one
response record, that of the smallest page id; the others are revisit records
that name it and keep its digest and length in their headers.  Each record is
one gzip member, so an archive can be read from any member on.

Reading: a task gets a byte range of a file, looks for the gzip magic from its
start, accepts a place when a member there decodes to a WARC header, and owns
all records that begin inside its range, the last of which may end beyond it.
A member that fails to decode is skipped by looking for the next magic.  Files
are read in pieces of ``READ_BYTES`` and records one by one.

Defined results: a null html is an empty payload; a null url is an empty one;
payloads below ``min_bytes`` are always responses; repeated rows of one page id
are equal records (those of the smallest id are all responses); a null page id
refers to nothing and is a response's only if all its equals have none; empty
tables give no files and no records; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from voicegrid.llm.shared_files import new_folder, open_file, write_file
from voicegrid.llm.text_arrays import column_of, in_chunks
from voicegrid.session import scratch_table

ARCHIVE_BYTES = 64 << 20
SPLIT_BYTES = 8 << 20
READ_BYTES = 1 << 20
MAGIC = b"\x1f\x8b\x08"
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_name(page_id: int | None) -> str:
    return "<urn:page:none>" if page_id is None else f"<urn:page:{page_id}>"


def page_of(name: str | None) -> int | None:
    number = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number.lstrip("-").isdigit() else None


def build_record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One gzip member.  A revisit's block is the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_name(page_id)}",
        f"WARC-Date: {DATE}", f"WARC-Target-URI: {' '.join(url.split())}", f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_name(refers_to)}"]
    whole = ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(whole) + packer.flush()


def with_roles(pages: DataFrame, id_col: str, html_col: str, min_bytes: int) -> DataFrame:
    """``page_id``, ``refers_to`` and ``revisit`` of every page, from digests alone."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads = [(html or "").encode() for html in column_of(batch, "html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    column_of(batch, "page_id"), pa.array([hashlib.sha1(x).digest() for x in payloads], pa.binary()),
                    pa.array([len(x) for x in payloads], pa.int64()),
                ],
                ["page_id", "digest", "size"],
            )

    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(html_col).alias("html"))
    rows = scratch_table(rows.mapInArrow(digests, "page_id long, digest binary, size long"), "digests")
    # Stored, so that adaptive execution may split a payload that fills the table when it is joined.
    first = scratch_table(
        rows.where(F.col("size") >= min_bytes).groupBy("digest", "size").agg(F.min("page_id").alias("first")), "first"
    )
    roles = rows.join(first, ["digest", "size"], "left")
    revisit = F.coalesce(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False))
    return scratch_table(
        roles.select("page_id", "digest", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit")), "roles"
    )


def write_archives(
    pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0,
    archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Writes every page into archives and returns the manifest: ``path``, ``n_bytes`` and ``n_records``."""
    folder = new_folder(pages.sparkSession, "warc")
    revisits = with_roles(pages, id_col, html_col, min_bytes).where("revisit").select("page_id", "digest", "refers_to").distinct()
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.coalesce(html_col, F.lit("")).alias("html"),
    ).withColumn("digest", F.unhex(F.sha1("html")))
    same = rows["page_id"].eqNullSafe(revisits["page_id"]) & (rows["digest"] == revisits["digest"])
    marked = rows.join(revisits, same, "left").select(
        rows["page_id"], "url", "html", "refers_to", revisits["digest"].isNotNull().alias("revisit")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            row = {"path": write_file(folder, ".warc.gz", b"".join(held)), "n_bytes": size, "n_records": len(held)}
            return pa.RecordBatch.from_pylist([row])

        for batch in in_chunks(batches, "html"):
            for row in batch.to_pylist():
                held.append(
                    build_record(row["page_id"], row["url"] or "", row["html"].encode(), row["refers_to"], row["revisit"])
                )
                size += len(held[-1])
                if size >= archive_bytes:
                    yield close()
                    held, size = [], 0
        if held:
            yield close()

    return scratch_table(marked.mapInArrow(run, "path string, n_bytes long, n_records long"), "archives")


class _Bytes:
    """A file's bytes from a position on, in pieces."""

    def __init__(self, handle, at: int) -> None:
        self.handle, self.at, self.data = handle, at, b""
        handle.seek(at)

    def more(self) -> bool:
        piece = self.handle.read(READ_BYTES)
        self.data += piece
        return bool(piece)

    def skip(self, count: int) -> None:
        self.data, self.at = self.data[count:], self.at + count


def _member(source: _Bytes) -> tuple[bytes, int] | None:
    """The gzip member at the source's position and its length, if it holds a whole WARC record."""
    unpacker, out, used = zlib.decompressobj(31), [], 0
    begun = b""
    try:
        while True:
            piece = source.data[used : used + READ_BYTES]
            if not piece:
                if not source.more():
                    return None
                continue
            out.append(unpacker.decompress(piece))
            used += len(piece)
            if len(begun) < 5:
                begun += out[-1][:5]
                if not begun.startswith(b"WARC/"[: len(begun)]):
                    return None
            if unpacker.eof:
                return b"".join(out), used - len(unpacker.unused_data)
    except zlib.error:
        return None


def records_in(handle, start: int, end: int) -> Iterator[bytes]:
    """Records that begin in [start, end)."""
    source = _Bytes(handle, start)
    while source.at < end:
        at = source.data.find(MAGIC)
        if at < 0:
            source.skip(max(0, len(source.data) - len(MAGIC) + 1))
            if not source.more():
                return
            continue
        source.skip(at)
        if source.at >= end:
            return
        found = _member(source)
        if found is None:
            source.skip(1)
        else:
            yield found[0]
            source.skip(found[1])


def parse_record(record: bytes) -> dict | None:
    """Headers and payload of one record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}
    block = rest[: int(fields.get("content-length", 0))]
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = fields.get("warc-type") == "revisit"
    size = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), 0)
    stated = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    return {
        "page_id": page_of(fields.get("warc-record-id")), "url": fields.get("warc-target-uri"),
        "record_type": fields.get("warc-type"), "payload_bytes": size if revisit else len(payload),
        "payload_digest": stated if revisit else digest_of(payload), "stated_digest": stated,
        "refers_to": page_of(fields.get("warc-refers-to")) if revisit else None, "payload": None if revisit else payload,
    }


def archive_files(folder: str) -> list[tuple[str, int]]:
    """All archives below a folder with their sizes, for archives that come without a manifest."""
    system, path = fs.FileSystem.from_uri(folder)
    found = system.get_file_info(fs.FileSelector(path, recursive=True))
    scheme = folder.split("://")[0] + "://" if "://" in folder else ""
    return [(scheme + x.path, x.size) for x in found if x.is_file and x.path.endswith(".warc.gz")]


RECORD_SCHEMA = (
    "page_id long, url string, record_type string, payload_bytes long, payload_digest string, stated_digest string, "
    "refers_to long"
)


def read_archives(files: DataFrame, *, payload: bool = False, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """One row for each record of the files (``path``, ``n_bytes``), read in ranges of ``split_bytes``."""
    names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")] + ["payload"] * payload
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    text_schema = RECORD_SCHEMA + ", payload binary" * payload
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in text_schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for split in batch.to_pylist():
                rows, held = [], 0
                with open_file(split["path"]) as handle:
                    for record in records_in(handle, split["start"], split["end"]):
                        row = parse_record(record)
                        rows.append({name: row[name] for name in names})
                        held += 200 + (len(record) if payload else 0)
                        if held > 2 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n_bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long")))
    splits = files.select("path", "n_bytes", starts.alias("start"))
    splits = splits.select("path", "start", F.least(F.col("start") + split_bytes, F.col("n_bytes")).alias("end"))
    # A task for each few ranges, so that adaptive execution doesn't join rows that stand for whole ranges.
    return splits.repartition(max(1, min(splits.count(), 100_000)), "path", "start").mapInArrow(run, text_schema)
