"""WARC archives with revisit records.

`write_archives` writes one response record per row into gzip members, one archive or more per task. `resolve` shuffles record headers only:
the first record of each payload digest stays a response, the others revisit it. `deduplicate` copies the archives record by record, an archive a
task, with headers made anew (a record id of its own, digests, the place of the original) and no payload for revisits. `read_archives` reads records back.
Archives are written under a temporary name and moved into place when whole, and a repeated task writes the same bytes, so a lost executor leaves no half archive.

Nulls: a null payload is empty; a null row id is kept as such and sorts after all others. Payloads of any length are written whole; a task
holds one of them at a time. Ties: rows equal in id and payload are separate records, in the order of archive and place. Empty tables give no
archive and no row. Extra columns are not carried, so their names can't clash.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rubrica.llm.common import delete_path, forget, fresh_path, pieces, small_batches, tidy, written

# Names of the WARC 1.1 standard.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = "1970-01-01T00:00:00Z"

INDEX = "file string, seq long, row_id long, url string, payload_digest string, payload_bytes long"
LEVEL = 4


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(row_id: int | None, file: str, seq: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{row_id}/{file}/{seq}')}>"


def record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    head = b"\r\n".join([VERSION, *(f"{k}: {' '.join(str(v).split())}".encode() for k, v in headers if v is not None), f"Content-Length: {len(block)}".encode()])
    return head + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """One gzip member, with no time in it, so that equal records are equal bytes."""
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def http_head(length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()


def file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class Archive:
    """An archive that appears under its name only when it is whole."""

    def __init__(self, folder: str, name: str):
        self.fs, at = file_system(folder)
        self.path, self.size = f"{at}/{name}", 0
        self.temp = f"{at}/.{name}.{uuid.uuid4().hex}"
        self.fs.create_dir(at, recursive=True)
        self.out = self.fs.open_output_stream(self.temp, compression=None)

    def add(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        from pyarrow import fs

        self.out.close()
        if self.fs.get_file_info(self.path).type != fs.FileType.NotFound:
            self.fs.delete_file(self.path)  # an earlier attempt of the same task; its bytes are the same
        self.fs.move(self.temp, self.path)


def records_in(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive, read member by member in pieces of bounded size."""
    files, at = file_system(path)
    with files.open_input_stream(at, compression=None) as f:
        raw, data, d = b"", bytearray(), None
        while True:
            if not raw:
                raw = f.read(1 << 20)
                if not raw:
                    break
            d = d or zlib.decompressobj(31)
            data += d.decompress(raw)
            raw = d.unused_data if d.eof else b""
            if d.eof:
                d = None
                head, _, rest = bytes(data).partition(b"\r\n\r\n")
                headers = dict(line.decode().split(": ", 1) for line in head.split(b"\r\n")[1:])
                yield headers, rest[: int(headers["Content-Length"])]
                data = bytearray()


def payload_in(block: bytes) -> bytes:
    return block.partition(b"\r\n\r\n")[2]


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", roll_bytes: int = 128 << 20) -> DataFrame:
    """Writes a response record per row into archives of about roll_bytes; returns the index of the records, to be materialized at once."""
    small_batches(pages.sparkSession)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, roll, archive, seq = TaskContext.get().partitionId(), 0, None, 0
        for b in (x for whole in batches for x in pieces(whole, "p")):
            rows = []
            for k, u, p in zip(*(b.column(c).to_pylist() for c in ("k", "u", "p")), strict=True):
                if archive is None:
                    name = f"crawl-{part:06d}-{roll:05d}.warc.gz"
                    archive, seq, roll = Archive(folder, name), 0, roll + 1
                digest = digest_of(p)
                archive.add(member(record([("WARC-Type", "response"), ("WARC-Record-ID", record_id(k, name, seq)), ("WARC-Date", EPOCH), ("WARC-Target-URI", u), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Row-Id", k), ("Content-Type", "application/http; msgtype=response")], http_head(len(p)) + p)))
                rows.append((name, seq, k, u, digest, len(p)))
                seq += 1
                if archive.size >= roll_bytes:
                    archive.close()
                    archive = None
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["file", "seq", "row_id", "url", "payload_digest", "payload_bytes"])
        if archive is not None:
            archive.close()

    slim = pages.select(F.col(key).cast("long").alias("k"), F.col(url).cast("string").alias("u"), F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary").alias("p"))
    return slim.mapInArrow(run, INDEX)


def resolve(index: DataFrame, least_bytes: int = 0) -> DataFrame:
    """The index with record_type and, for revisits, the place of the response (to_file, to_seq, refers_to).

    The shuffle carries headers only. The first record of a digest is found by a partial aggregate; a digest that holds a large share of
    the records is split by the adaptive skew join, as the other side has one row for each digest.
    """
    by = ["payload_digest", "payload_bytes"]
    place = F.struct(F.col("row_id").isNull().alias("none"), "row_id", "file", "seq", "url")
    first = index.where(F.col("payload_bytes") >= least_bytes).groupBy(*by).agg(F.min(place).alias("first"))
    out = index.join(first, by, "left")
    again = F.coalesce((F.col("first.file") != F.col("file")) | (F.col("first.seq") != F.col("seq")), F.lit(False))
    return out.select(*index.columns, F.when(again, "revisit").otherwise("response").alias("record_type"), *[F.when(again, F.col(f"first.{c}")).alias(n) for c, n in (("row_id", "refers_to"), ("file", "to_file"), ("seq", "to_seq"), ("url", "to_url"))])


def tasks_for(files: int) -> int:
    """Partitions for so many archives: several for each, as they are dealt by hash."""
    return max(1, min(4 * files, 1 << 17))


def deduplicate(resolved: DataFrame, source: str, folder: str, files: int | None = None) -> DataFrame:
    """Copies the archives in `source`, `files` of them (counted where it isn't told), to `folder`, revisits without payload; returns (file, records) to be materialized at once."""
    files = resolved.select("file").distinct().count() if files is None else files
    own = lambda row, file, seq: record_id(row, f"deduplicated/{file}", seq)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, archive, records, n = None, None, iter(()), 0
        done = lambda: pa.RecordBatch.from_pylist([{"file": name, "records": n}], schema=pa.schema([("file", pa.string()), ("records", pa.int64())]))
        for b in batches:
            for r in b.to_pylist():
                if r["file"] != name:
                    if archive:
                        archive.close()
                        yield done()
                    name, n = r["file"], 0
                    archive, records = Archive(folder, name), records_in(f"{source}/{name}")
                headers, block = next(records)
                again = r["record_type"] == "revisit"
                fresh = [("WARC-Type", r["record_type"]), ("WARC-Record-ID", own(r["row_id"], name, n)), ("WARC-Date", headers["WARC-Date"]), ("WARC-Target-URI", headers.get("WARC-Target-URI"))]
                if again:
                    block = http_head(r["payload_bytes"])
                    fresh += [("WARC-Refers-To", own(r["refers_to"], r["to_file"], r["to_seq"])), ("WARC-Refers-To-Target-URI", r["to_url"]), ("WARC-Refers-To-Date", EPOCH), ("WARC-Profile", REVISIT_PROFILE), ("X-Refers-To-Row-Id", r["refers_to"]), ("X-Payload-Length", r["payload_bytes"])]
                fresh += [("WARC-Payload-Digest", headers["WARC-Payload-Digest"]), ("WARC-Block-Digest", f"sha1:{digest_of(block)}"), ("X-Row-Id", r["row_id"]), ("Content-Type", "application/http; msgtype=response")]
                archive.add(member(record(fresh, block)))
                n += 1
        if archive:
            archive.close()
            yield done()

    cols = ["file", "seq", "row_id", "payload_bytes", "record_type", "refers_to", "to_file", "to_seq", "to_url"]
    return resolved.select(*cols).repartition(tasks_for(files), "file").sortWithinPartitions("file", "seq").mapInArrow(run, "file string, records long")


READ = "row_id long, url string, payload_bytes long, payload_digest string, digest_ok boolean, record_type string, refers_to long, refers_to_record string, record_id string, file string, seq long"


def read_archives(files: DataFrame, folder: str, count: int) -> DataFrame:
    """A row for each record of the named archives, `count` of them. A response's digest and length are taken from its payload, a revisit's from its header."""

    def number(x: str | None) -> int | None:
        return None if x is None else int(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.strip().split(" ")[0] for x in READ.split(", ")]
        kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
        schema = pa.schema([(n, kinds[x.split(" ")[1]]) for n, x in zip(names, READ.split(", "), strict=True)])
        for b in batches:
            for file in b.column("file").to_pylist():
                rows: list[tuple] = []
                for seq, (h, block) in enumerate(records_in(f"{folder}/{file}")):
                    told = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    if h["WARC-Type"] == "response":
                        p = payload_in(block)
                        own, size = digest_of(p), len(p)
                    else:
                        own, size = told, int(h["X-Payload-Length"])
                    rows.append((number(h.get("X-Row-Id")), h.get("WARC-Target-URI"), size, own, own == told, h["WARC-Type"], number(h.get("X-Refers-To-Row-Id")), h.get("WARC-Refers-To"), h["WARC-Record-ID"], file, seq))
                    if len(rows) == 2000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return files.select("file").repartition(tasks_for(count), "file").mapInArrow(tidy(run), READ)


def revisit_archives(spark: SparkSession, pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes, resolves, copies and reads back; the deduplicated archives stay in the shared folder, the first copies go."""
    raw, deduped = fresh_path(spark, "warc-crawl"), fresh_path(spark, "warc-revisit")
    index = written(write_archives(pages, raw), "warc-index")
    count = index.select("file").distinct().count()
    files = written(deduplicate(resolve(index, least_bytes), raw, deduped, count), "warc-files")
    delete_path(spark, raw)
    forget(index)
    return read_archives(files, deduped, count)


def op5_revisit_archives(spark, sf_dir: str) -> DataFrame:
    from rubrica.llm.common import read

    out = revisit_archives(spark, read(spark, sf_dir, "pages"), 0)
    return out.select(F.col("row_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok", "file", "seq")
