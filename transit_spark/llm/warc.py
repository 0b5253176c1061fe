"""WARC archives: monolithic gzip files rewritten with a member for each record and a sidecar index of offsets."""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transit_spark.llm.scratch import folder, keep

#: Uncompressed bytes after which a task begins another archive, and bytes read at once.
ARCHIVE_BYTES, CHUNK = 64 << 20, 1 << 20
INDEX = "archive string, offset bigint, length bigint, record_id string, record_type string, target_uri string, digest string"


def record(key: str, kind: str, uri: str | None, digest: str, size: int, refers_to: str | None, payload: bytes) -> bytes:
    """One WARC record. A revisit has the HTTP headers of its payload, whose length they give, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    head = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<urn:x-page:{key}>",
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": " ".join(uri.split()) if uri else None,
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if kind == "revisit" else None,
        "WARC-Refers-To": None if refers_to is None else f"<urn:x-page:{refers_to}>",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(http) + len(payload),
    }
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None).encode() + b"\r\n" + http + payload + b"\r\n\r\n"


def headers(raw: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in raw.decode("utf-8", "replace").split("\r\n")[1:]) if k}


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, whole record) of a stream of uncompressed WARC; holds one record and a chunk."""
    held = bytearray()
    chunks = iter(chunks)

    def more() -> bool:
        try:
            held.extend(next(chunks))
        except StopIteration:
            return False
        return True

    while True:
        while (at := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held.strip():
                    raise ValueError("a WARC record breaks off in its headers")
                return
        head = headers(bytes(held[:at]))
        end = at + 4 + int(head["content-length"]) + 4
        while len(held) < end:
            if not more():
                raise ValueError("a WARC record breaks off in its block")
        yield head, bytes(held[:end])
        del held[:end]


def inflated(stream: io.IOBase) -> Iterator[bytes]:
    """Uncompressed chunks of a gzip file, of one member or many, in one pass."""
    inflate = zlib.decompressobj(31)
    while data := stream.read(CHUNK):
        while data:
            if out := inflate.decompress(data, CHUNK):
                yield out
            data = inflate.unconsumed_tail
            if inflate.eof:
                data = inflate.unused_data
                inflate = zlib.decompressobj(31)


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def archive(pages: DataFrame, path: str, key: str = "page_id", uri: str = "url", html: str = "html", revisit_bytes: int = 100) -> DataFrame:
    """Writes ``pages`` to monolithic gzip archives below ``path``; (archive) of those that belong to the result.

    Of rows with equal payloads of at least ``revisit_bytes`` the one with the smallest key is a response, others
    revisit it; rows which repeat that key and payload are responses too. A null html is an empty payload. Archives
    of task attempts that failed are not in the result.
    """
    payload = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).cast("string").alias("key"), F.col(key).alias("order"), F.col(uri).cast("string").alias("uri"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    known = pages.select(F.col(key).alias("order"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("size")).where(F.col("size") >= revisit_bytes)
    first = keep(known.groupBy("digest").agg(F.min("order").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", F.col("first").cast("string").alias("first")))
    rows = rows.join(first, "digest", "left").select("key", "uri", "payload", "digest", "first")
    spark = pages.sparkSession
    spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(spark._jvm.org.apache.hadoop.fs.Path(path))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _open(path)
        name, size, out = "", 0, None
        for batch in batches:
            for k, u, p, d, f in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                again = f is not None and f != k
                if out is None:
                    name = f"{uuid.uuid4().hex}.mono.warc.gz"
                    target = files.open_output_stream(f"{base}/{name}", compression=None)
                    out = gzip.GzipFile(fileobj=target, mode="wb", compresslevel=1, mtime=0)
                size += out.write(record(k or "", "revisit" if again else "response", u, d, len(p), f if again else None, b"" if again else p))
                if size >= ARCHIVE_BYTES:
                    out.close()
                    target.close()
                    yield pa.RecordBatch.from_pydict({"archive": [name]})
                    size, out = 0, None
        if out is not None:
            out.close()
            target.close()
            yield pa.RecordBatch.from_pydict({"archive": [name]})

    return keep(rows.mapInArrow(write, "archive string"))


def normalise(archives: DataFrame, path: str) -> DataFrame:
    """Index rows (INDEX) of ``archives`` below ``path``: each is inflated once as a stream and rewritten beside itself with
    one gzip member a record; the offsets also go to a sidecar file, archive + ``.idx``, a tab-separated line a record."""
    spread = archives.repartition(max(1, archives.count()), "archive")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _open(path)
        for batch in batches:
            for old in batch.column(0).to_pylist():
                name = f"{old.split('.', 1)[0]}-{uuid.uuid4().hex[:8]}.warc.gz"
                at, rows = 0, []
                with files.open_input_stream(f"{base}/{old}", compression=None) as source, files.open_output_stream(f"{base}/{name}", compression=None) as out:
                    for head, raw in records(inflated(source)):
                        member = gzip.compress(raw, 6, mtime=0)
                        out.write(member)
                        rows.append((name, at, len(member), head.get("warc-record-id", ""), head.get("warc-type", ""), head.get("warc-target-uri", ""), head.get("warc-payload-digest", "")))
                        at += len(member)
                with files.open_output_stream(f"{base}/{name}.idx", compression=None) as sidecar:
                    sidecar.write("".join("\t".join(map(str, r[1:])) + "\n" for r in rows).encode())
                for lo in range(0, len(rows), 10_000):
                    kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 4]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[lo : lo + 10_000], strict=True), kinds, strict=True)], names=["archive", "offset", "length", "record_id", "record_type", "target_uri", "digest"])

    return keep(spread.mapInArrow(run, INDEX))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """INDEX rows from the sidecar files below ``path``."""
    parts = F.split("value", "\t")
    lines = spark.read.option("pathGlobFilter", "*.idx").text(path).select("value", F.regexp_extract(F.input_file_name(), r"([^/]+)\.idx$", 1).alias("archive"))
    return lines.select("archive", *[parts[i].cast(t).alias(n) for i, (n, t) in enumerate((("offset", "bigint"), ("length", "bigint"), ("record_id", "string"), ("record_type", "string"), ("target_uri", "string"), ("digest", "string")))])


def read(index: DataFrame, path: str, schema: str, take: Callable[[dict[str, str], dict[str, str], bytes], tuple]) -> DataFrame:
    """``take(headers, HTTP headers, payload)`` of each record of ``index``, fetched by its offset as a member of its own."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _open(path)
        name, source = None, None
        for batch in batches:
            out = []
            for archive, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if archive != name:
                    if source is not None:
                        source.close()
                    name, source = archive, files.open_input_file(f"{base}/{archive}")
                source.seek(offset)
                raw = gzip.decompress(source.read(length))
                at = raw.index(b"\r\n\r\n") + 4
                head = headers(raw[: at - 4])
                block = raw[at : at + int(head["content-length"])]
                cut = block.index(b"\r\n\r\n") + 4
                out.append(take(head, headers(block[: cut - 4]), block[cut:]))
            yield pa.RecordBatch.from_pydict({n: list(c) for n, c in zip(names, zip(*out, strict=True), strict=True)} if out else {n: [] for n in names})
        if source is not None:
            source.close()

    return index.select("archive", "offset", "length").mapInArrow(run, schema)


def digests(head: dict[str, str], http: dict[str, str], payload: bytes) -> tuple:
    """key, payload_bytes, payload_digest, record_type, refers_to of a record; a response's are taken from its payload and must be those stated."""
    page = lambda x: x.removeprefix("<urn:x-page:").removesuffix(">") if x else None
    stated = (int(http["content-length"]), head["warc-payload-digest"].removeprefix("sha256:"))
    if head["warc-type"] == "response" and stated != (len(payload), hashlib.sha256(payload).hexdigest()):
        raise ValueError(f"record {head['warc-record-id']}: the payload is not the one stated")
    return page(head["warc-record-id"]) or None, *stated, head["warc-type"], page(head.get("warc-refers-to"))


def round_trip(pages: DataFrame, key: str = "page_id", uri: str = "url", html: str = "html") -> DataFrame:
    """``key``, payload_bytes, payload_digest, record_type, refers_to of each page after ``archive``, ``normalise`` and ``read`` by the sidecars' offsets.

    Rows without a key keep none; an empty table gives no rows; other columns are not read.
    """
    path = folder(pages.sparkSession)
    written = normalise(archive(pages, path, key, uri, html), path)
    index = read_index(pages.sparkSession, path).join(written.select("archive").distinct(), "archive", "left_semi")  # not those of failed attempts
    back = read(index.repartition("archive").sortWithinPartitions("archive", "offset"), path, "key string, payload_bytes bigint, payload_digest string, record_type string, refers_to string", digests)
    kind = pages.schema[key].dataType
    return back.select(F.col("key").cast(kind).alias(key), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
