"""WARC archives with a two-level capture index, written and read back by range."""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import math
import re
import uuid
import zlib
from urllib.parse import quote, unquote

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KEY, durable, durable_folder, table, with_key

#: Lines of a compressed index block, least captures of an index part (one file), and most parts.
BLOCK_LINES, PART_LINES, MOST_PARTS = 1000, 16_000, 65_536
#: Bytes of archives that one task reads back.
READ_BYTES = 64_000_000
#: Revisits of up to this many bytes are broadcast to the writers; more are joined by a shuffle.
BROADCAST_BYTES = 16_000_000
#: Payloads shorter than this are always stored whole.
LEAST_PAYLOAD = 0

DATE = "2024-01-01T00:00:00Z"
CAPTURES = "capture string, file string, start long, length long"
DIRECTORY = "part int, first string, file string, start long, length long"
READ = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string"


def base32_sha1(payload: Column) -> Column:
    """The bare base32 SHA-1 of bytes: 40 bits are 8 digits of base 32, four times."""
    digest = F.sha1(payload)
    digits = F.concat(*[F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)])
    return F.translate(F.upper(digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def url_key(url: str | None) -> str:
    """A URL with its host reversed and in lower case, without scheme and fragment: `org,example,www)/a?b`."""
    rest = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*://", "", (url or "").strip()).split("#", 1)[0]
    host, path = re.match(r"([^/?]*)(.*)", rest, re.DOTALL).groups()
    host = host.rsplit("@", 1)[-1].lower()
    host, port = re.match(r"(.*?)(:\d*)?$", host, re.DOTALL).groups()
    return re.sub(r"\s", "%20", ",".join(reversed(host.split("."))) + (port or "") + ")" + (path or "/"))


def capture_key(url: str | None, key: int) -> str:
    """The sort key of a capture: its URL key, then the row's key, so that no two are equal."""
    return f"{url_key(url)} {key + (1 << 63):020d}"


def record_id(key: int) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(b'page %d' % key).digest())}>"


def warc_record(key: int, page_id: str | None, url: str | None, payload: bytes, digest: str, source_key: int | None, source_id: str | None) -> bytes:
    """A response record with the payload, or a revisit record without it if there is a source."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if source_key is not None else http + payload
    head = ["WARC/1.0", f"WARC-Type: {'response' if source_key is None else 'revisit'}", f"WARC-Record-ID: {record_id(key)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe="%/:=&?~#+!$,;'@()*[]")}")
    if page_id is not None:
        head.append(f"X-Page-ID: {quote(page_id)}")
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if source_key is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(source_key)}"]
        head += [f"X-Refers-To-Page-ID: {quote(source_id)}"] if source_id is not None else []
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of a WARC record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    return headers, rest[: int(headers["Content-Length"])]


def write_batches(folder: str):
    """A mapInArrow function that writes a task's pages into one new archive and gives CAPTURES.

    Each record is a gzip member of its own. The name is new for each attempt; only the files named by
    attempts that succeeded are ever read.
    """

    def write(batches):
        out, store, path, at = None, None, None, 0
        for batch in batches:
            rows = []
            for key, page_id, url, payload, digest, source_key, source_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    store, base = fs.FileSystem.from_uri(folder)
                    path = f"{base}/{uuid.uuid4().hex}.warc.gz"
                    out = store.open_output_stream(path, compression=None)
                raw = gzip.compress(warc_record(key, page_id, url, payload, digest, source_key, source_id), 3, mtime=0)
                out.write(raw)
                rows.append((capture_key(url, key), path, at, len(raw)))
                at += len(raw)
            if rows:
                yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["capture", "file", "start", "length"]), preserve_index=False)
        if out is not None:
            out.close()

    return write


def index_batches(folder: str, lines: int):
    """A mapInArrow function over sorted captures that writes an index file of compressed blocks.

    A block holds `lines` lines (capture, file, start, length); its DIRECTORY row has the first capture.
    """

    def write(batches):
        out, store, path, at, part, held = None, None, None, 0, None, []

        def block():
            nonlocal out, store, path, at
            if out is None:
                store, base = fs.FileSystem.from_uri(folder)
                path = f"{base}/{uuid.uuid4().hex}.idx.gz"
                out = store.open_output_stream(path, compression=None)
            raw = gzip.compress("\n".join("\t".join(map(str, x)) for x in held).encode(), 6, mtime=0)
            out.write(raw)
            row = (part, held[0][0], path, at, len(raw))
            at += len(raw)
            held.clear()
            return row

        def directory(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["part", "first", "file", "start", "length"])

        for batch in batches:
            rows = []
            for number, *line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                part = number
                held.append(line)
                if len(held) == lines:
                    rows.append(block())
            if rows:
                yield directory(rows)
        if held:
            yield directory([block()])
        if out is not None:
            out.close()

    return write


def locate_in(folder: str):
    """A cogroup function: the queries of an index part and that part's directory give their captures.

    A query's block is found by binary search in the directory, and its line by binary search in the
    block, which is read by its range and kept only until the next one.
    """

    def locate(queries: pd.DataFrame, directory: pd.DataFrame) -> pd.DataFrame:
        store, _ = fs.FileSystem.from_uri(folder)
        directory = directory.sort_values("first", ignore_index=True)
        firsts, held, found, files = directory["first"].tolist(), None, [], {}
        for capture in sorted(queries["capture"]):
            at = bisect.bisect_right(firsts, capture) - 1
            if at < 0:
                continue
            if at != held:
                held, row = at, directory.iloc[at]
                source = files.get(row.file) or files.setdefault(row.file, store.open_input_file(row.file))
                lines = [x.split("\t") for x in gzip.decompress(source.read_at(int(row.length), int(row.start))).decode().split("\n")]
                keys = [x[0] for x in lines]
            i = bisect.bisect_left(keys, capture)
            if i < len(keys) and keys[i] == capture:
                found.append((capture, lines[i][1], int(lines[i][2]), int(lines[i][3])))
        return pd.DataFrame(found, columns=["capture", "file", "start", "length"])

    return locate


def read_batches(folder: str):
    """A mapInArrow function over captures in file order: reads each by its range and gives READ."""

    def read(batches):
        store, _ = fs.FileSystem.from_uri(folder)
        path = source = None
        for batch in batches:
            out = []
            for file, start, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if file != path:
                    path, source = file, store.open_input_file(file)
                headers, block = parsed_record(zlib.decompress(source.read_at(length, start), 31))
                size, digest = int(headers["X-Payload-Length"]), headers["WARC-Payload-Digest"].removeprefix("sha1:")
                if headers["WARC-Type"] == "response":
                    payload = block.partition(b"\r\n\r\n")[2]
                    if (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()) != (size, digest):
                        raise ValueError(f"{file} is damaged at {start}")
                ids = [unquote(headers[k]) if k in headers else None for k in ("X-Page-ID", "X-Refers-To-Page-ID")]
                out.append((ids[0], size, digest, headers["WARC-Type"], ids[1]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return read


def new_folder(spark) -> str:
    """The URI of a new folder in the shared folder."""
    folder = f"{durable_folder(spark)}/warc-{uuid.uuid4().hex}"
    store, path = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder))
    store.create_dir(path, recursive=True)
    return re.sub(r"^file:/+", "file:///", folder)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_PAYLOAD) -> DataFrame:
    """Writes a record for each of `pages` (with KEY) into archives in `folder`; returns CAPTURES.

    Of equal payloads of at least `least` bytes the one with the largest id (null ids lowest; text ids in
    the order of text) is a response, the others revisit it; null html is an empty payload. Records carry
    the ids as text. Only digests are shuffled; payloads go from the scan to the file.
    """
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    slim = durable(pages.select(KEY, F.col(id_col).alias("id"), F.length(payload).alias("bytes"), base32_sha1(payload).alias("digest")))
    last = F.max(F.struct(F.col("id").isNotNull().alias("some"), F.col("id").alias("id"), F.col(KEY).alias("key"))).alias("last")
    groups = slim.filter(F.col("bytes") >= least).groupBy("digest", "bytes").agg(last, F.count("*").alias("n")).filter("n > 1")
    revisits = slim.join(groups, ["digest", "bytes"]).filter(F.col(KEY) != F.col("last.key"))
    revisits = durable(revisits.select(KEY, F.col("last.key").alias("source_key"), F.col("last.id").cast("string").alias("source_id")))
    if revisits.count() * 24 <= BROADCAST_BYTES:
        revisits = F.broadcast(revisits)
    rows = pages.join(revisits, KEY, "left").select(KEY, F.col(id_col).cast("string"), F.col(url_col).cast("string"), payload.alias("payload"), base32_sha1(payload).alias("digest"), "source_key", "source_id")
    return durable(rows.mapInArrow(write_batches(folder), CAPTURES))


class CaptureIndex:
    """Two levels: sorted capture lines in compressed blocks, and a sparse directory of their first keys.

    Captures are sorted over the cluster into parts of at least `part_lines`; parts grow with the table
    once there are MOST_PARTS of them, so that the driver, which keeps the first key of each part, never
    keeps more. Directories are looked up where the queries of their part are.
    """

    def __init__(self, captures: DataFrame, folder: str, lines: int = BLOCK_LINES, part_lines: int = PART_LINES):
        self.folder = folder
        parts = max(1, min(MOST_PARTS, math.ceil(captures.count() / part_lines)))
        ordered = captures.repartitionByRange(parts, "capture").sortWithinPartitions("capture")
        ordered = ordered.select(F.spark_partition_id().alias("part"), "capture", "file", "start", "length")
        self.directory = durable(ordered.mapInArrow(index_batches(folder, lines), DIRECTORY))
        firsts = self.directory.groupBy("part").agg(F.min("first").alias("first")).orderBy("first").collect()
        self.parts = [(r["first"], r["part"]) for r in firsts]

    def locate(self, queries: DataFrame) -> DataFrame:
        """CAPTURES of the `queries` (capture) that are in the index."""
        starts = queries.sparkSession.sparkContext.broadcast(self.parts)

        def route(batches):
            firsts, parts = [x for x, _ in starts.value], [x for _, x in starts.value]
            for batch in batches:
                captures = batch.column(0)
                at = [max(0, bisect.bisect_right(firsts, c) - 1) for c in captures.to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([parts[i] for i in at], pa.int32()), captures], ["part", "capture"])

        if not self.parts:
            return queries.sparkSession.createDataFrame([], CAPTURES)
        routed = queries.mapInArrow(route, "part int, capture string")
        return routed.groupBy("part").cogroup(self.directory.groupBy("part")).applyInPandas(locate_in(self.folder), CAPTURES)


def read_captures(located: DataFrame, folder: str, task_bytes: int = READ_BYTES) -> DataFrame:
    """READ of `located` captures, in tasks of about `task_bytes` of archive, at least as many as archives.

    Each task has a run of captures of few files in the order of their places, so it reads ahead.
    """
    files, size = located.agg(F.count_distinct("file"), F.coalesce(F.sum("length"), F.lit(0))).first()
    tasks = max(1, files, math.ceil(size / task_bytes))
    # Files are ordered by a hash, as the driver gets samples of what the rows are dealt by.
    ordered = located.repartitionByRange(tasks, F.xxhash64("file"), "start").sortWithinPartitions(F.xxhash64("file"), "start")
    return ordered.select("file", "start", "length").mapInArrow(read_batches(folder), READ)


def query_batches(batches):
    for batch in batches:
        keys = [capture_key(u, k) for k, u in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string())], ["capture"])


def op8_warc(spark, sf_dir):
    """Every page written as a record, found in the index by its URL and key, and read back by its range."""
    pages = with_key(table(spark, sf_dir, "pages").select("page_id", "url", "html"), "page_id")
    folder = new_folder(spark)
    index = CaptureIndex(write_archives(pages, folder), folder)
    queries = pages.select(KEY, "url").mapInArrow(query_batches, "capture string")
    found = read_captures(durable(index.locate(queries)), folder)
    return found.select(F.col("page_id").cast("long"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long"))


OP8_SQL = r"""
WITH page AS (SELECT page_id, coalesce(html, '') AS payload FROM pages
), named AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload) AS last,
         list_transform(generate_series(0, 3), lambda g: ('0x' || sha1(payload)[1 + 10 * g:10 + 10 * g])::BIGINT) AS parts
  FROM page
)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes,
       array_to_string(list_transform(generate_series(0, 31), lambda d: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + ((parts[1 + d // 8] >> (35 - 5 * (d % 8))) & 31)]), '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to
FROM named
"""
