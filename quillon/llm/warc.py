"""Operator 5. WARC archives: a normaliser of monolithic gzip files.

An archive compressed as one gzip stream can be read from its start only. The normaliser inflates the stream once, cuts it
at record borders, rewrites each record as a gzip member of its own and writes a sidecar index of offsets, so readers fetch
single records. Everything is streamed: a task holds one record and the index of one archive.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import BROADCAST_ROWS, bounded_batches, filesystem, materialize, shared_dir, with_partner

# Fixed values of the WARC 1.1 format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_DATE = "2024-01-01T00:00:00Z"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record, or, given refers_to, a revisit record: HTTP head without the payload."""
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {RECORD_DATE}"]
    if url:
        head.append("WARC-Target-URI: " + "".join(url.split()))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return VERSION + b"\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_head(raw: bytes) -> dict[str, str]:
    """Header fields by lower-case name."""
    lines = raw.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record starts here")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def inflate_records(file, step: int = 1 << 20) -> Iterator[bytes]:
    """Whole records of a gzip stream (of one member or many), in order."""
    unpack, buffer, want = zlib.decompressobj(31), bytearray(), None
    while raw := file.read(step):
        while raw:
            buffer += unpack.decompress(raw, 4 * step)
            raw = unpack.unconsumed_tail
            while True:
                if want is None:
                    if (at := buffer.find(b"\r\n\r\n")) < 0:
                        break
                    want = at + 8 + int(parse_head(bytes(buffer[:at]))["content-length"])
                if len(buffer) < want:
                    break
                yield bytes(buffer[:want])
                del buffer[:want]
                want = None
            if unpack.eof:
                raw = unpack.unused_data
                unpack = zlib.decompressobj(31)
    if buffer or want:
        raise ValueError("the archive ends within a record")


def normalise_file(src, out, level: int = 6) -> list[tuple[int, int, str, str]]:
    """Rewrite an archive with each record as its own member. Returns offset, length, record id, type of each."""
    index, offset = [], 0
    for raw in inflate_records(src):
        packer = zlib.compressobj(level, zlib.DEFLATED, 31)
        member = packer.compress(raw) + packer.flush()
        out.write(member)
        head = parse_head(raw[: raw.index(b"\r\n\r\n")])
        index.append((offset, len(member), head["warc-record-id"], head["warc-type"]))
        offset += len(member)
    return index


def plan_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, refers_to: of equal payloads of at least min_bytes the smallest page_id is the response (null
    refers_to), others revisit it. Payloads are equal if SHA-1 and length are. Null html: an empty payload. A null page_id
    is never referred to unless all ids of the payload are null. Rows of one page_id and payload: the first is the
    response's id for all, and each row is a response."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    keyed = rows.withColumns({"sha": F.sha1("payload"), "size": F.octet_length("payload")})
    first = keyed.where(F.col("size") >= min_bytes).groupBy("sha", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = materialize(first, "warc-repeated")
    n = first.count()
    # Payloads that occur once are not in the table. Where it is small, no payload is shuffled; else by digest and salt, so
    # copies of one page don't meet in one task.
    joined = keyed.join(F.broadcast(first), ["sha", "size"], "left") if n <= BROADCAST_ROWS // 4 else _with_first(keyed, first)
    return joined.select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def _with_first(keyed: DataFrame, first: DataFrame) -> DataFrame:
    """keyed with `first` of its SHA-1 and length. The two are one key, of which copies of one page are dealt by salts."""
    one = F.struct("sha", "size").alias("_payload")
    return with_partner(keyed.select("*", one), "_payload", "page_id", first.select(one, "first"), how="left").drop("_payload")


def write_monolithic(plan: DataFrame, path: str, level: int = 1) -> DataFrame:
    """Write one archive for each partition, as one gzip stream: file string, records long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, n = None, f"mono-{uuid.uuid4().hex}.warc.gz", 0
        packer = zlib.compressobj(level, zlib.DEFLATED, 31)
        for batch in batches:
            if out is None:
                fs, base = filesystem(path)
                fs.create_dir(base, recursive=True)
                out = fs.open_output_stream(f"{base}/{name}", compression=None)
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out.write(packer.compress(record(page_id, url, payload, base32_sha1(payload), refers_to)))
                n += 1
        if out is not None:
            out.write(packer.flush())
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "records": [n]})

    return materialize(bounded_batches(plan).mapInArrow(run, "file string, records long"), "warc-files")


def normalise(files: DataFrame, src: str, dst: str, level: int = 6) -> DataFrame:
    """Normalise the archives files.file of folder src into dst: file, sidecar, records. The sidecar has a JSON array for
    each record: offset, length, record id, type. An archive is one task's work, as its stream can't be split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                fs, base = filesystem(src)
                _, to = filesystem(dst)
                fs.create_dir(to, recursive=True)
                new = f"{uuid.uuid4().hex}.warc.gz"
                with fs.open_input_stream(f"{base}/{name}", compression=None) as file, fs.open_output_stream(f"{to}/{new}", compression=None) as out:
                    index = normalise_file(file, out, level)
                with fs.open_output_stream(f"{to}/{new}.idx", compression=None) as out:
                    out.write("".join(json.dumps(x) + "\n" for x in index).encode())
                yield pa.RecordBatch.from_pydict({"file": [new], "sidecar": [f"{new}.idx"], "records": [len(index)]})

    spread = files.select("file").repartition(files.sparkSession.sparkContext.defaultParallelism * 4, "file")
    return materialize(spread.mapInArrow(run, "file string, sidecar string, records long"), "warc-index")


def read_record(file, offset: int, length: int) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC header, HTTP header and payload of the member at an offset."""
    file.seek(offset)
    raw = zlib.decompress(file.read(length), 31)
    at = raw.index(b"\r\n\r\n")
    head = parse_head(raw[:at])
    block = raw[at + 4 : at + 4 + int(head["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("utf-8", "replace").split("\r\n")[1:])}
    return head, fields, payload


RECORD_SCHEMA = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:x-page:").removesuffix(">")
    return int(number) if number else None


def read_archives(index: DataFrame, path: str, payloads: bool = True) -> DataFrame:
    """The records of normalised archives by their sidecars. Responses' digests and lengths are those of the payload read,
    and must equal what the header says; revisits' are those of the header. payloads=False leaves the payload null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, sidecar in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, base = filesystem(path)
                with fs.open_input_stream(f"{base}/{sidecar}", compression=None) as file:
                    entries = [json.loads(x) for x in file.read().splitlines()]
                rows, size = [], 0
                with fs.open_input_file(f"{base}/{name}") as file:
                    for offset, length, urn, kind in entries:
                        head, http, payload = read_record(file, offset, length)
                        digest, n = head["warc-payload-digest"].removeprefix("sha1:"), int(http["content-length"])
                        if kind == "response" and (base32_sha1(payload) != digest or len(payload) != n):
                            raise ValueError(f"record {urn} is damaged")
                        kept = payload if payloads and kind == "response" else None
                        rows.append((_page(urn), head.get("warc-target-uri"), kind, n, digest, _page(head.get("warc-refers-to")), kept))
                        size += len(kept or b"") + 200
                        if size > 16_000_000:
                            yield _rows(rows)
                            rows, size = [], 0
                if rows:
                    yield _rows(rows)

    spread = index.select("file", "sidecar").repartition(index.sparkSession.sparkContext.defaultParallelism * 4, "file")
    return spread.mapInArrow(run, RECORD_SCHEMA)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def archive(pages: DataFrame, path: str, min_bytes: int = 0, level: int = 6) -> DataFrame:
    """Write pages to archives under path and normalise them: the index for read_archives(index, path). An empty table: no
    archive. Extra columns of pages don't matter; a page's row becomes one record, repeated rows included."""
    files = write_monolithic(plan_revisits(pages, min_bytes), f"{path}/mono")
    index = normalise(files, f"{path}/mono", path, level)
    fs, base = filesystem(f"{path}/mono")
    if fs.get_file_info(base).type.name == "Directory":
        fs.delete_dir(base)  # the index is written, so no task reads these again
    return index


def op5_warc(spark, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, written, normalised and read back."""
    path = shared_dir(spark, "warc")
    index = archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archives(index, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
