"""WARC archives: writing captures as transactions and joining them again.

Every page is one transaction: a ``request``, a ``response`` or ``revisit`` and a ``metadata``
record; request and metadata name the response or revisit in WARC-Concurrent-To, a revisit names its
response in WARC-Refers-To.  Every record is a gzip member of its own, so any one of them can be read
alone: ``index`` holds, for every capture, the archive and the place of its records.  Reading all takes
whole archives as streams, follows each record's Content-Length (a payload may hold any bytes), and
joins the records of a transaction by their concurrent-to ids into one nested row per capture.

Recovery: a task writes archives under names of its own and returns the places as rows; the rows that
Spark commits (Parquet, beside the archives) name what counts, files of lost or repeated attempts are
in none.

Scale: payload digests and sizes are computed in the scan; what decides response or revisit moves
only digests and ids, grouped before the shuffle, and joined back by a join that AQE splits when one
payload is a third of all pages.  Payloads are shuffled once, by page.  An archive is closed after
``BYTES_PER_FILE`` packed bytes; reading and writing tasks hold an Arrow batch or one record, whatever the
archive's size.

Defined results: null html is an empty payload; null urls are written as empty; equal pages (id, url
and html) are captures of their own, with the same record type; of equal payloads all rows with the largest id are
responses; a null id counts as smaller than any other; no pages give no rows; further columns are ignored, whatever their
names; a long html is one record, as long as Spark holds it in a row.
"""
from __future__ import annotations

import hashlib
import io
import zlib
from uuid import uuid4

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .tokens import _uri

MIN_REVISIT_BYTES = 1000
NO_ID = -(1 << 63)
BYTES_PER_FILE = 256 << 20
PIECE = 1 << 14
VERSION = "WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
END = "\r\n\r\n"
INDEX = "page_id long, type string, record_id string, path string, start long, length long, main_start long, main_length long"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "


def _record_id(kind: str, page_id: str = "page_id", url: str = "url", copy: Column | None = None) -> Column:
    """urn:uuid of the capture's record of this kind, from what the capture is and its copy number."""
    h = F.md5(F.concat_ws("|", F.lit(kind), F.coalesce(F.col(page_id).cast("string"), F.lit("")), F.col(url), F.col("digest"),
                          (F.col("copy") if copy is None else copy).cast("string")).cast("binary"))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _one_line(url: str) -> Column:
    return F.regexp_replace(F.col(url), r"[\r\n]", "")


def _record(kind: Column, record_id: Column, uri: Column, headers: list[Column], body: Column) -> Column:
    """One WARC record without its closing separator."""
    lines = [F.lit(VERSION), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), record_id),
             F.lit(f"WARC-Date: {DATE}"), F.concat(F.lit("WARC-Target-URI: "), uri), *headers,
             F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string"))]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(END), body)


def plan_captures(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, payload_bytes, refers_to, refers_url, copy: one row a capture."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    # a null id is the smallest long with a flag in here: plain keys let one exchange serve the grouping and the join
    p = pages.select(F.col("page_id").isNotNull().alias("has_id"), F.coalesce(F.col("page_id").cast("long"), F.lit(NO_ID)).alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
                     html.alias("html"))
    p = p.withColumns({"digest": F.sha1(F.col("html").cast("binary")), "payload_bytes": F.octet_length("html").cast("long")})
    keys = ["page_id", "has_id", "url", "digest"]
    slim = p.groupBy(*keys).agg(F.max("payload_bytes").alias("payload_bytes"), F.count("*").alias("copies"))
    newest = (slim.where(F.col("payload_bytes") >= MIN_REVISIT_BYTES).groupBy("digest").agg(F.max(F.struct("has_id", "page_id", "url")).alias("newest")))
    slim = slim.join(newest, "digest", "left")
    other = F.col("newest.has_id") & ((F.col("newest.page_id") != F.col("page_id")) | ~F.col("has_id"))
    slim = slim.select(*keys, "copies", F.when(other, F.col("newest.page_id")).alias("refers_to"), F.when(other, F.col("newest.url")).alias("refers_url"))
    body = p.groupBy(*keys).agg(F.first("html").alias("html"), F.max("payload_bytes").alias("payload_bytes"))
    c = body.join(slim, keys)
    c = c.withColumn("page_id", F.when(F.col("has_id"), F.col("page_id"))).drop("has_id")
    return c.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))


def records(captures: DataFrame) -> DataFrame:
    """page_id, type, record_id and the three records of every capture: ``request``, ``main``, ``metadata`` (binary)."""
    uri = _one_line("url")
    revisit = F.col("refers_to").isNotNull()
    kind = F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))
    main_id = _record_id("response")
    together = F.concat(F.lit("WARC-Concurrent-To: "), main_id)
    page = F.concat(F.lit("X-Page-ID: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    digest = F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"))
    refers = F.concat_ws(
        "\r\n", F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        F.concat(F.lit("WARC-Refers-To: "), _record_id("response", "refers_to", "refers_url", F.lit(1))),
        F.concat(F.lit("WARC-Refers-To-Target-URI: "), _one_line("refers_url")), F.lit(f"WARC-Refers-To-Date: {DATE}"),
        F.concat(F.lit("X-Refers-To-Page: "), F.col("refers_to").cast("string")))
    request = _record(F.lit("request"), _record_id("request"), uri, [together, F.lit("Content-Type: application/http;msgtype=request")],
                      F.concat(F.lit("GET "), uri, F.lit(" HTTP/1.1"), F.lit(END)))
    main = _record(
        kind, main_id, uri, [page, digest, F.lit("Content-Type: application/http;msgtype=response"), F.when(revisit, refers)],
        F.concat(F.lit(HTTP), F.col("payload_bytes").cast("string"), F.lit(END), F.when(revisit, F.lit("")).otherwise(F.col("html"))))
    metadata = _record(F.lit("metadata"), _record_id("metadata"), uri, [together, F.lit("Content-Type: application/warc-fields")],
                       F.concat(F.lit("payloadBytes: "), F.col("payload_bytes").cast("string"), F.lit("\r\n")))
    return captures.select("page_id", kind.alias("type"), main_id.alias("record_id"), request.cast("binary").alias("request"),
                           main.cast("binary").alias("main"), metadata.cast("binary").alias("metadata"))


class _Archive:
    """Writes one archive, a gzip member a record."""

    def __init__(self, path: str):
        from pyarrow import fs

        files, name = fs.FileSystem.from_uri(path)
        self.path, self.size, self.sink = path, 0, files.open_output_stream(name, compression=None)

    def add(self, record) -> int:
        """The packed length of ``record`` (a buffer), written with its separator."""
        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = pack.compress(record) + pack.compress(END.encode()) + pack.flush()
        self.sink.write(member)
        self.size += len(member)
        return len(member)


def write(pages: DataFrame, folder: str | None = None, *, bytes_per_file: int = BYTES_PER_FILE) -> str:
    """Writes archives of all pages and their index; the folder's path.  The records of a capture lie side by side."""
    import pyarrow as pa
    from pyarrow import fs

    folder = _uri(folder or f"{ensure_checkpoint_dir(pages.sparkSession).rstrip('/')}/warc-{uuid4().hex}")
    files, name = fs.FileSystem.from_uri(f"{folder}/archives")
    files.create_dir(name, recursive=True)

    def run(batches):
        from pyspark import TaskContext

        task, archive = f"{TaskContext.get().partitionId():06d}-{uuid4().hex}", None
        count = 0
        for batch in batches:
            places = []
            columns = [batch.column(c) for c in ("request", "main", "metadata")]
            for row in range(batch.num_rows):
                if archive is None:
                    archive = _Archive(f"{folder}/archives/{task}-{count:04d}.warc.gz")
                    count += 1
                start = archive.size
                lengths = [archive.add(c[row].as_buffer()) for c in columns]
                places.append((archive.path, start, sum(lengths), start + lengths[0], lengths[1]))
                if archive.size >= bytes_per_file:
                    archive.sink.close()
                    archive = None
            if places:
                path, *numbers = zip(*places)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in ("page_id", "type", "record_id")], pa.array(path), *[pa.array(x, pa.int64()) for x in numbers]],
                    names=["page_id", "type", "record_id", "path", "start", "length", "main_start", "main_length"])
        if archive is not None:
            archive.sink.close()

    records(plan_captures(pages)).mapInArrow(run, INDEX).write.parquet(f"{folder}/index")
    return folder


def index(spark, folder: str) -> DataFrame:
    """A row a capture: page_id, type and record_id of its response or revisit, path of the archive, start and length of
    its records there (request, main, metadata in a row), and of the main one."""
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def read_record(path: str, start: int, length: int) -> tuple[dict, bytes]:
    """(headers, body) of the one record at a place that the index gives; nothing else is read."""
    from pyarrow import fs

    files, name = fs.FileSystem.from_uri(path)
    with files.open_input_file(name) as f:
        f.seek(start)
        (found,) = _parse(f.read(length))
    return found


def _parse(source):
    """(headers, body) of every record of one archive, given as bytes or as a stream; unpacked piece by piece."""
    source = io.BytesIO(source) if isinstance(source, bytes) else source
    unpack, buffer, packed = None, bytearray(), b""

    def more() -> bool:
        nonlocal unpack, packed
        while packed := packed or source.read(PIECE):
            unpack = unpack or zlib.decompressobj(31)
            got = unpack.decompress(packed, 1 << 20)
            packed = unpack.unused_data if unpack.eof else unpack.unconsumed_tail
            if unpack.eof:
                unpack = None  # another gzip member may follow
            if got:
                buffer.extend(got)
                return True
        if unpack is not None:
            raise ValueError("a gzip member is cut off")
        return False

    while True:
        while (end := buffer.find(b"\r\n\r\n")) < 0:
            if not more():
                if buffer.strip():
                    raise ValueError("a record's header is cut off")
                return
        head = buffer[:end].decode().split("\r\n")
        if head[0] != VERSION:
            raise ValueError(f"no record begins with {head[0][:40]!r}")
        headers = dict(x.split(": ", 1) for x in head[1:])
        stop = end + 4 + int(headers["Content-Length"])
        while len(buffer) < stop + 4:
            if not more():
                raise ValueError("a record's block is cut off")
        yield headers, bytes(buffer[end + 4:stop])
        del buffer[:stop + 4]


def read_records(spark, folder: str) -> DataFrame:
    """One row a record: type, id, concurrent_to, uri, page_id, digest (of the header), refers_to, refers_id, payload fields."""
    import pandas as pd

    names = ["type", "id", "concurrent_to", "uri", "page_id", "digest", "refers_to", "refers_id", "body_bytes", "body_sha1", "fields"]

    def frame(rows):
        return pd.DataFrame(rows, columns=names).astype({c: "Int64" for c in ("page_id", "refers_to", "body_bytes")})

    def run(batches):
        from pyarrow import fs

        for batch in batches:
            for path in batch["path"]:
                files, name = fs.FileSystem.from_uri(path)
                with files.open_input_stream(name, compression=None, buffer_size=1 << 20) as stream:
                    out = []
                    for head, body in _parse(stream):
                        kind = head["WARC-Type"]
                        payload = body.split(b"\r\n\r\n", 1)[1] if kind == "response" else b""
                        page, refers = head.get("X-Page-ID"), head.get("X-Refers-To-Page")
                        out.append((kind, head["WARC-Record-ID"], head.get("WARC-Concurrent-To"), head.get("WARC-Target-URI"),
                                    int(page) if page else None, head.get("WARC-Payload-Digest"), int(refers) if refers else None,
                                    head.get("WARC-Refers-To"), len(payload) if kind == "response" else None,
                                    hashlib.sha1(payload).hexdigest() if kind == "response" else None,
                                    body.decode() if kind == "metadata" else None))
                        if len(out) >= 4096:
                            yield frame(out)
                            out = []
                    yield frame(out)

    # an archive a task: paths are dealt out in turn
    paths = index(spark, folder).select("path").distinct().repartition(4 * max(1, spark.sparkContext.defaultParallelism), "path")
    return paths.mapInPandas(run, "type string, id string, concurrent_to string, uri string, page_id long, digest string, "
                                  "refers_to long, refers_id string, body_bytes long, body_sha1 string, fields string")


def captures(found: DataFrame) -> DataFrame:
    """One nested row per capture: its response or revisit with the request and metadata that name it.

    One grouping by the id all three share: the main record's own, the others' concurrent-to."""
    parts = found.withColumn("capture", F.coalesce("concurrent_to", "id"))
    main = F.col("type").isin("response", "revisit")

    def one(condition, *cols):
        return F.first(F.when(condition, F.struct(*cols)), ignorenulls=True)

    return parts.groupBy("capture").agg(
        one(main, "type", "id", "uri", "page_id", "digest", "refers_to", "refers_id", "body_bytes", "body_sha1").alias("main"),
        one(F.col("type") == "request", "id", "uri").alias("request"),
        one(F.col("type") == "metadata", "id", "fields").alias("metadata"),
        F.count("*").alias("records"))


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes the archives, reads them back and gives a row per capture."""
    c = captures(read_records(pages.sparkSession, write(pages)))
    stated = F.regexp_extract("metadata.fields", r"payloadBytes: ([0-9]+)", 1).cast("long")
    header = F.substring(F.col("main.digest"), len("sha1:") + 1, 40)
    return c.select(
        F.col("main.page_id").alias("page_id"), F.coalesce("main.body_bytes", stated).alias("payload_bytes"),
        F.coalesce("main.body_sha1", header).alias("payload_digest"), F.col("main.type").alias("record_type"),
        F.col("main.refers_to").alias("refers_to"), (F.col("records") == 3).alias("complete"),
        ((header == F.coalesce("main.body_sha1", header)) & (stated == F.coalesce("main.body_bytes", stated))).alias("verified"))
