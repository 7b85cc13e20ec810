"""WARC archives: write as one gzip stream per file, normalise to one member per record, read back.

``write_archives`` writes each partition's records as whole-file gzip streams, the form in which
records cannot be reached one by one.  ``normalise`` inflates each such stream once, in chunks,
rewrites every record as a gzip member of its own and writes a sidecar index with the offset and
length of each member.  ``read_records`` goes by the index alone: it seeks, inflates one member and
parses one record.

Files go to the shared folder under names that no other attempt of a task uses, and only files that
a finished task has returned count, so a lost executor leaves at most an unread file behind.

Defined cases: a null html is an empty payload; a null or odd url is written as it is, without line
breaks; of equal payloads of at least ``least`` bytes the smallest page_id is the response and all
others revisit it; repeated rows of that page_id are responses too; a null page_id revisits any
other, and is a response where all are null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import small_batches
from ebbtide.operators.lineage import shared_folder, stored

#: Bytes of a file after which a task starts the next one.
FILE_BYTES = 32_000_000
CHUNK = 1 << 20
LEVEL = 2
NO_ID = "-"


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _open(uri: str):
    """(file system, path) of a URI; any store that pyarrow knows."""
    return pafs.FileSystem.from_uri(uri)


def _record(page_id, url, payload: bytes, digest: str, refers_to, revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit carries no payload but its size and digest."""
    clean = " ".join((url or "").split())
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
            f"WARC-Record-ID: <urn:page:{NO_ID if page_id is None else page_id}>",
            f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha1:{digest}",
            f"X-Payload-Length: {len(payload)}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: <urn:page:{refers_to}>"]
    body = b"" if revisit else payload
    return "\r\n".join([*head, f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")[1:]
    return {k: v for k, _, v in (line.partition(": ") for line in lines)}


def _parse(stream: Iterator[bytes]) -> Iterator[tuple[bytes, dict[str, str], int]]:
    """Records of an inflated stream: (whole bytes, fields, start of the payload)."""
    held = bytearray()
    for part in stream:
        held += part
        at = 0
        while (stop := held.find(b"\r\n\r\n", at)) >= 0:
            fields = _fields(bytes(held[at:stop]))
            end = stop + 4 + int(fields["Content-Length"]) + 4
            if end > len(held):
                break
            yield bytes(held[at:end]), fields, stop + 4 - at
            at = end
        del held[:at]
    if held:
        raise ValueError(f"{len(held)} bytes after the last whole record")


def decide(pages: DataFrame, least: int = 0) -> DataFrame:
    """Pages with their payload digest and the page that each revisits: __id, __url, __html,
    __digest, __first (null: a response)."""
    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_digest(html.encode()) for html in batch.column("__html").to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(found, pa.string())],
                                  names=[*batch.schema.names, "__digest"])

    plain = pages.select(F.col("page_id").cast("long").alias("__id"), F.col("url").cast("string").alias("__url"),
                         F.coalesce(F.col("html"), F.lit("")).alias("__html"))
    known = plain.mapInArrow(digests, "__id long, __url string, __html string, __digest string")
    light = plain.select("__id", "__html").mapInArrow(digests, "__id long, __html string, __digest string")
    repeats = stored(light.filter(F.octet_length("__html") >= least).groupBy(F.col("__digest").alias("__d"))
                     .agg(F.min("__id").alias("__least"), F.count("*").alias("__n"))
                     .filter("__n > 1").select("__d", "__least"))
    # One row for each repeated payload; a payload of a third of all rows stays where it is when this
    # side is small and is split by Spark's skew join when not.
    side = F.broadcast(repeats) if repeats.count() <= 100_000 else repeats
    return known.join(side, F.col("__digest") == F.col("__d"), "left").select(
        "__id", "__url", "__html", "__digest",
        F.when((F.octet_length("__html") >= least) & ~F.col("__id").eqNullSafe(F.col("__least")),
               F.col("__least")).alias("__first"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write decided pages; returns the manifest (file, records) of whole-stream archives."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        out = packer = name = None
        size = records = 0
        done: list[tuple[str, int]] = []
        for batch in batches:
            for ident, url, html, digest, first in zip(*(batch.column(c).to_pylist() for c in
                                                         ("__id", "__url", "__html", "__digest", "__first"))):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, packer = system.open_output_stream(f"{root}/{name}", compression=None), zlib.compressobj(LEVEL, wbits=31)
                    size = records = 0
                part = packer.compress(_record(ident, url, html.encode(), digest, first, first is not None))
                out.write(part)
                size, records = size + len(part), records + 1
                if size >= FILE_BYTES:
                    out.write(packer.flush())
                    out.close()
                    out = None
                    done.append((name, records))
        if out is not None:
            out.write(packer.flush())
            out.close()
            done.append((name, records))
        yield pa.record_batch([pa.array([n for n, _ in done], pa.string()),
                               pa.array([r for _, r in done], pa.int64())], names=["file", "records"])

    return stored(pages.mapInArrow(run, "file string, records long"))


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite archives (file, ...) with one member per record and a sidecar index each.

    Returns a row for each archive: the new file and its sidecar, a JSON line for each record.
    """
    def inflated(source) -> Iterator[bytes]:
        unpack = zlib.decompressobj(wbits=31)
        while chunk := source.read(CHUNK):
            while chunk:
                yield unpack.decompress(chunk, CHUNK)
                chunk = unpack.unconsumed_tail
        yield unpack.flush()
        if not unpack.eof:
            raise ValueError("the gzip stream ends early")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        for batch in batches:
            made = []
            for name in batch.column("file").to_pylist():
                stem = f"{name.removesuffix('.warc.gz')}-{uuid.uuid4().hex[:8]}"
                offset = 0
                with system.open_input_stream(f"{root}/{name}", compression=None) as source, \
                        system.open_output_stream(f"{root}/{stem}.members.warc.gz", compression=None) as out, \
                        system.open_output_stream(f"{root}/{stem}.index.jsonl", compression=None) as index:
                    for whole, fields, _ in _parse(inflated(source)):
                        packer = zlib.compressobj(LEVEL, wbits=31)
                        member = packer.compress(whole) + packer.flush()
                        out.write(member)
                        index.write((json.dumps({"offset": offset, "length": len(member),
                                                 "record": fields["WARC-Record-ID"],
                                                 "digest": fields["WARC-Payload-Digest"]}) + "\n").encode())
                        offset += len(member)
                made.append((f"{stem}.members.warc.gz", f"{stem}.index.jsonl", offset))
            yield pa.record_batch([pa.array(v, t) for v, t in zip(
                list(zip(*made)) or [[]] * 3, (pa.string(), pa.string(), pa.int64()))], names=["file", "index", "bytes"])

    n = max(1, archives.count())
    return stored(archives.select("file").repartition(n).mapInArrow(run, "file string, index string, bytes long"))


def read_records(spark, members: DataFrame, folder: str) -> DataFrame:
    """All records of the normalised files, each reached by its index entry.

    page_id, record_type, url, refers_to, payload (null for a revisit), payload_bytes, payload_digest.
    """
    schema = ("page_id long, record_type string, url string, refers_to long, payload binary, "
              "payload_bytes long, payload_digest string")
    names = [field.split()[0] for field in schema.split(", ")]

    def page(name: str | None) -> int | None:
        ident = name.removeprefix("<urn:page:").removesuffix(">") if name else NO_ID
        return None if ident in (NO_ID, "None") else int(ident)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string())
        for batch in batches:
            for name, index in zip(batch.column("file").to_pylist(), batch.column("index").to_pylist()):
                rows, held = [], 0
                with system.open_input_file(f"{root}/{name}") as file, \
                        system.open_input_stream(f"{root}/{index}", compression=None) as lines:
                    for line in _lines(lines):
                        entry = json.loads(line)
                        member = zlib.decompress(file.read_at(entry["length"], entry["offset"]), wbits=31)
                        (_, fields, start), = _parse(iter([member]))
                        revisit = fields["WARC-Type"] == "revisit"
                        payload = None if revisit else member[start:-4]
                        declared = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        if not revisit and _digest(payload) != declared:
                            raise ValueError(f"digest of {fields['WARC-Record-ID']} in {name} differs")
                        rows.append((page(fields["WARC-Record-ID"]), fields["WARC-Type"], fields["WARC-Target-URI"],
                                     page(fields.get("WARC-Refers-To")), payload,
                                     int(fields["X-Payload-Length"]) if revisit else len(payload), declared))
                        held += len(payload or b"") + 200
                        if held >= 4_000_000:
                            yield pa.record_batch([pa.array(v, t) for v, t in zip(zip(*rows), kinds)], names=names)
                            rows, held = [], 0
                if rows:
                    yield pa.record_batch([pa.array(v, t) for v, t in zip(zip(*rows), kinds)], names=names)

    n = max(1, members.count())
    return members.select("file", "index").repartition(n).mapInArrow(run, schema)


def _lines(stream) -> Iterator[bytes]:
    held = b""
    while chunk := stream.read(CHUNK):
        *whole, held = (held + chunk).split(b"\n")
        yield from whole
    if held:
        yield held


def archive(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write ``pages`` as archives, normalise them and read every record back."""
    spark = pages.sparkSession
    small_batches(spark)
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    system, root = _open(folder)
    system.create_dir(root, recursive=True)
    files = write_archives(decide(pages, least), folder)
    return read_records(spark, normalise(files, folder), folder)
