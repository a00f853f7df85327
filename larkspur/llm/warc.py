"""WARC archives: writing pages as gzip members, and reading them back by byte ranges.

Every record is a gzip member of its own. Of pages with equal payloads the one
with the smallest id is stored whole, the others as revisits of it. A reading
task gets a byte range of a file, searches it for the magic of gzip, checks
each candidate by decoding the beginning of the record, and owns just the
records whose members begin inside its range, to their ends.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written
from .exact_dedup import may_repeat, repeated_filter

MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
SPLIT_BYTES, CHUNK = 32 << 20, 1 << 20
#: Revisits, of some 60 bytes each, that are sent to every writing task; more are joined.
FEW_REVISITS = 200_000
#: Beyond so many ranges a reading task gets several.
MAX_TASKS = 100_000
SCHEMA = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, path string, offset long"
#: Schemes that pyarrow opens on executors for reading ranges; files elsewhere are read whole by Spark.
#: Stores where a rename moves no bytes.
RENAMES = ("file", "hdfs", "viewfs", "abfs", "abfss")
RANGED = ("file", "s3", "s3a", "gs", "gcs", "hdfs", "abfs", "abfss")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _member(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def _name(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def _page(name: str) -> int | None:
    m = re.fullmatch(r"<urn:x-page:(-?\d+)>", name or "")
    return int(m[1]) if m else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """One record. Control characters and spaces of a URL are percent-encoded; a null URL is left out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f\x85\u2028\u2029]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url))
    head.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if revisit:
        head += [f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Fields of one record, its payload checked against its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, said = fields.get("warc-type", ""), fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response" and said and digest(payload) != said:
        raise ValueError(f"the payload of {fields.get('warc-record-id')} doesn't have its digest")
    size = re.search(rb"(?im)^content-length:\s*(\d+)", http)
    return {
        "page_id": _page(fields.get("warc-record-id", "")), "url": fields.get("warc-target-uri"), "record_type": kind,
        "payload_bytes": len(payload) if kind == "response" else int(size[1]) if size else None, "payload_digest": said or digest(payload),
        "refers_to": _page(fields.get("warc-refers-to", "")), "payload": payload if kind == "response" else None,
    }


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, few_revisits: int = FEW_REVISITS) -> None:
    """Writes a record for every row into *.warc.gz files of a folder; a null html is an empty payload.

    Payloads of at least `min_bytes` that are equal are stored once, as the
    response with the smallest id; null ids never are that one unless all are.
    Rows that repeat an id and its payload get the same kind of record. A record
    is made in memory, so a payload can have some hundred MB; other columns are
    left out. An empty table writes no record.
    """
    spark = pages.sparkSession
    raw = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), raw.alias("payload"), F.unhex(F.sha1(raw)).alias("sha"))
    keys = written(rows.where(F.length("payload") >= min_bytes).select("page_id", "sha"), "payload-keys")
    first = keys.groupBy("sha").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null")
    # Ids of a payload are made distinct before they meet its first id, so that a frequent payload is many keys; the join after that can be split.
    own = keys.groupBy("sha", "page_id").agg(F.count("*").alias("n")).select("sha", "page_id")
    again = own.join(written(first.select("sha", "refers_to"), "first"), "sha").where("not page_id <=> refers_to").select(F.col("page_id").alias("p"), F.col("sha").alias("s"), "refers_to")
    again = written(again, "revisits")

    def revisits(part: DataFrame, few: bool) -> DataFrame:
        on = F.col("page_id").eqNullSafe(F.col("p")) & (F.col("sha") == F.col("s"))
        return part.join(F.broadcast(again) if few else again, on, "left").select("page_id", "url", "payload", "refers_to")

    if again.count() <= few_revisits:  # checked, so that they can be sent to every task and no payload moves
        both = revisits(rows, True)
    else:  # payloads that surely don't repeat stay where they are; only the others move
        look = may_repeat(spark, repeated_filter(keys.select(F.xxhash64("sha").alias("h"))))
        flagged = rows.withColumn("maybe", look(F.xxhash64("sha")))
        alone = flagged.where("not maybe").select("page_id", "url", "payload", F.lit(None).cast("long").alias("refers_to"))
        both = alone.union(revisits(flagged.where("maybe").drop("maybe"), False))

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 256):
                out = []
                for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in b.slice(s, 256).columns), strict=True):
                    m = _member(record(page_id, url, payload, refers_to, refers_to is not None))
                    # Each row ends in the separator of the sink below, a zero byte, as most members do; a member of no bytes ends in zeros.
                    out.append(m[:-1] if m[-1] == 0 else m + _member(b"")[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    both.mapInArrow(members, "value binary").select(F.col("value").cast("string")).write.text(folder, lineSep="\0")
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getUri().getScheme() not in RENAMES:
        return  # renaming copies there: files keep the sink's names
    for f in fs.listStatus(path(folder)):  # names only
        name = f.getPath().getName()
        if name.endswith(".txt"):
            fs.rename(f.getPath(), path(folder, name.removesuffix(".txt") + ".warc.gz"))


def _open(uri: str):
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem().open_input_file(re.sub("^file:/*", "/", uri))
    store, path = fs.FileSystem.from_uri(re.sub("^s3a:", "s3:", uri))
    return store.open_input_file(path)


def scan(f, start: int, end: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of the members of an opened file that begin in [start, end).

    `f` has seek and read. Bytes that look like a member but don't decode to a
    record are passed over.
    """

    def inflate(at: int) -> tuple[bytes, int] | None:
        d, out, pos, checked = zlib.decompressobj(31), bytearray(), at, False
        f.seek(at)
        while not d.eof:
            data = f.read(CHUNK if pos > at else 1 << 14)
            if not data:
                return None  # cut short
            pos += len(data)
            try:
                out += d.decompress(data)
            except zlib.error:
                return None
            if not checked and len(out) >= 5:
                if out[:5] != b"WARC/":
                    return None
                checked = True
        return (bytes(out), pos - len(d.unused_data)) if checked or not out else None

    at = start
    held, held_at = b"", start
    while at < end:
        if not held_at <= at < held_at + len(held) - 2:
            f.seek(at)
            held, held_at = f.read(min(CHUNK, end + 2 - at)), at
            if len(held) < 3:
                return
        i = held.find(MAGIC, at - held_at)
        if i < 0:
            at = held_at + len(held) - 2
            if held_at + len(held) >= min(end + 2, size):
                return
            continue
        at = held_at + i
        if at >= end:
            return
        got = inflate(at)
        if got is None:
            at += 1
            continue
        data, after = got
        if data:
            yield at, data
        at = after


def read(spark: SparkSession, folder: str, split_bytes: int = SPLIT_BYTES, with_payload: bool = False, glob: str = "*.{warc.gz,txt}") -> DataFrame:
    """One row per record of the archives in a folder, with the payload if asked for.

    Every range of `split_bytes` is a task's unit of work; a record is inflated
    whole in memory. A folder without archives gives an empty result.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "path", "offset", *["payload"] * with_payload]
    schema = SCHEMA + ", payload binary" * with_payload

    def rows(path: str, f, start: int, end: int, size: int) -> Iterator[pd.DataFrame]:
        out, held = [], 0
        for at, data in scan(f, start, end, size):
            out.append(parse(data) | {"path": path, "offset": at})
            held += len(data)
            if held > 8 << 20 or len(out) >= 1024:
                yield frame(out)
                out, held = [], 0
        if out:
            yield frame(out)

    def frame(out: list[dict]) -> pd.DataFrame:
        df = pd.DataFrame(out, columns=[*dict.fromkeys([*out[0], *names])])[names]
        return df.astype({"page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64"})

    def ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, size, start in b.itertuples(index=False):
                with _open(path) as f:
                    yield from rows(path, f, int(start), min(int(size), int(start) + split_bytes), int(size))

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in b.itertuples(index=False):
                yield from rows(path, io.BytesIO(content), 0, len(content), len(content))

    uri = spark._jvm.org.apache.hadoop.fs.Path(folder)
    scheme = uri.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme()
    if scheme not in RANGED:
        return found.select("path", "content").mapInPandas(whole, schema)
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(split_bytes).cast("long")))
    tasks = found.where("length > 0").select("path", "length", starts.alias("start"))
    # An explicit number: ranges are few bytes each, and would be packed together by their size.
    return tasks.repartition(max(1, min(tasks.count(), MAX_TASKS))).mapInPandas(ranges, schema)
