"""WARC archives with a two-level capture index.

Archives are written by Spark's own text writer, so they land wherever Spark can write: every record is a
gzip member of its own, and the line separator between records is an empty gzip member, which readers of
multi-member files skip. Equal payloads are stored once and revisited.

The index has a line for each record: reversed-host URL key, page, file, offset, length. The lines are
sorted over the whole archive and cut into compressed blocks; a sparse directory holds the first key of each
block. A look-up finds the block by binary search in the directory, the line by binary search in the block,
and then reads only the record's bytes of its file: the places are dealt to tasks by file and offset, and a
task seeks to them through a file-system handle. No file is ever read whole into memory, so archives and
records may have any size that one record's own bytes allow.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm.common import dropped, scratch, table, written

#: Payloads of fewer bytes are never revisited.
REVISIT_BYTES = 1000
#: Records of one archive file.
FILE_RECORDS = 1000
#: Index lines of a block; more where the directory would pass its bound otherwise.
BLOCK_LINES, DIRECTORY_ENTRIES = 256, 100_000
#: The directory holds so much of the first key of a block.
DIRECTORY_CHARS = 200
#: Bytes of one read of a file that is scanned, and of a run of neighbouring places that are read together.
READ_BYTES, RUN_BYTES = 1 << 20, 8 << 20
#: The tables have no time of capture; records carry this one.
DATE = "1970-01-01T00:00:00Z"

_ID = "urn:caseloom:page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: What may not stand in a header line or would be lost at its ends: control characters and blanks of any kind.
_UNSAFE = re.compile(r"[\x00-\x20\x7f-\xa0\u1680\u2000-\u200f\u2028-\u202f\u205f\u3000\ufeff]")


def safe(url: str) -> str:
    """``url`` with every blank and control character as percent-encoded UTF-8."""
    return _UNSAFE.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


#: An empty gzip member, without time or name.
_BETWEEN = bytes([0x1F, 0x8B, 8, 0, 0, 0, 0, 0, 0, 3, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0])


def record(page_id: str, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC record: the whole response, or a revisit that names the record with the payload."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    fields = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{_ID}{page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
    ]
    if url is not None:
        fields.append("WARC-Target-URI: " + safe(url))
    if refers_to is None:
        block += payload
    else:
        fields += [f"WARC-Refers-To: <{_ID}{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    fields.append(f"Content-Length: {len(block)}")
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip(" \t").lower(): v.strip(" \t") for k, _, v in (line.partition(":") for line in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


def _page(name: str) -> str:
    return name.removeprefix(f"<{_ID}").removesuffix(">")


def url_key(url: str | None) -> str:
    """Sort key of a url: host with its labels reversed, then the rest: ``org,example)/path?query``."""
    if not url or "://" not in url:
        return ")" + (url or "")
    rest = url.partition("://")[2]
    m = re.match(r"[^/?#]*", rest)
    return ",".join(reversed(m[0].lower().split("."))) + ")" + rest[m.end() :].partition("#")[0]


def _line_key(url: str | None, page_id: str) -> str:
    """Key of an index line; the url must be as the record has it."""
    return url_key(url) + " " + page_id


def write_archive(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> str:
    """Write a record for every row of ``pages`` (page_id, url, html) and return the folder.

    Of equal payloads of ``revisit_bytes`` or more the one with the largest page_id is stored; the others
    revisit it. A null html is an empty payload; rows that repeat the stored page are stored as well; rows
    without page_id are always stored.
    """
    spark = pages.sparkSession
    payload = F.coalesce("html", F.lit("")).cast("binary")
    hashed = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    narrow = hashed.filter(F.octet_length("payload") >= revisit_bytes).select("page_id", "digest")
    stored = narrow.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("low")).filter("low < refers_to")
    revisits = narrow.join(stored.select("digest", "refers_to"), "digest").filter("page_id < refers_to").distinct()
    revisits = written(revisits, "revisits")  # its size on disk tells Spark whether to broadcast it
    chosen = hashed.join(revisits, ["page_id", "digest"], "left")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns))
            yield pa.RecordBatch.from_arrays([pa.array([_member(record(*r)) for r in rows], pa.binary())], ["value"])

    fields = chosen.select(F.coalesce(F.col("page_id").cast("string"), F.lit("")), "url", "payload", "digest", F.col("refers_to").cast("string"))
    path = scratch(spark, "archive")
    lines = fields.mapInArrow(packed, "value binary").select(F.col("value").cast("string"))
    lines.write.option("maxRecordsPerFile", FILE_RECORDS).option("lineSep", _BETWEEN.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)
    return path


def _files(spark: SparkSession, path: str) -> DataFrame:
    """The archive's files by name only; their content is not read."""
    return spark.read.format("binaryFile").load(path).select("path")


def _opened(path: str) -> pa.NativeFile:
    """A random-access handle of a file on any file system that both Spark and Arrow know."""
    if path.startswith("file:"):
        path = "file://" + path.removeprefix("file:").removeprefix("//")
    system, name = pyarrow.fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


def members(source: BinaryIO) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and data of every gzip member that holds something, from one pass over a file."""
    piece, at = memoryview(source.read(READ_BYTES)), 0
    while len(piece):
        z, start, out = zlib.decompressobj(31), at, []
        while not z.eof:
            if not len(piece):
                raise ValueError("an archive ends within a record")
            out.append(z.decompress(piece))
            used = len(piece) - len(z.unused_data)
            at, piece = at + used, piece[used:]
            if not len(piece):
                piece = memoryview(source.read(READ_BYTES))
        data = b"".join(out)
        if data:
            yield start, at - start, data


def write_index(spark: SparkSession, archive: str) -> DataFrame:
    """The blocks of the capture index of an archive: ``block, first, n, lines`` (compressed)."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                with _opened(path) as source:
                    for offset, length, data in members(source):
                        fields, _ = parse(data)
                        rows.append((_line_key(fields.get("warc-target-uri"), _page(fields["warc-record-id"])), path, offset, length))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int64(), pa.int64()))], ["key", "path", "offset", "length"])

    captures = written(_files(spark, archive).mapInArrow(listed, "key string, path string, offset bigint, length bigint"), "captures")
    lines = max(BLOCK_LINES, -(-captures.count() // DIRECTORY_ENTRIES))

    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out(rows):
            body = "\n".join("\t".join(map(str, r)) for r in rows).encode()
            return pa.RecordBatch.from_arrays([pa.array([rows[0][0]]), pa.array([len(rows)], pa.int64()), pa.array([zlib.compress(body)], pa.binary())], ["first", "n", "lines"])

        for batch in batches:
            held += zip(*(c.to_pylist() for c in batch.columns))
            while len(held) >= lines:
                yield out(held[:lines])
                held = held[lines:]
        if held:
            yield out(held)

    ordered = captures.orderBy("key", "path", "offset").mapInArrow(blocked, "first string, n bigint, lines binary")
    blocks = written(ordered.withColumn("block", F.monotonically_increasing_id()), "index")
    dropped(captures)
    return blocks


def look_up(requests: DataFrame, blocks: DataFrame) -> DataFrame:
    """``path, offset, length`` of every record of the pages in ``requests`` (page_id, url), once each."""
    # at most DIRECTORY_ENTRIES entries, and one more for each task of the sort, of at most DIRECTORY_CHARS characters
    directory = sorted((r["first"], r["block"]) for r in blocks.select(F.left("first", F.lit(DIRECTORY_CHARS)).alias("first"), "block").collect())
    shared = requests.sparkSession.sparkContext.broadcast(([d[0] for d in directory], [d[1] for d in directory]))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, numbers = shared.value
        for batch in batches:
            keys, found = [], []
            for page_id, url in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                key = _line_key(None if url is None else safe(url), page_id)
                head = key[:DIRECTORY_CHARS]
                # the key's lines may begin in the block before the first that starts like it
                for at in range(max(0, bisect_left(firsts, head) - 1), bisect_right(firsts, head)):
                    keys.append(key)
                    found.append(numbers[at])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(found, pa.int64())], ["key", "block"])

    def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for keys, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lines = [line.split("\t") for line in zlib.decompress(packed).decode().split("\n")]
                names = [line[0] for line in lines]
                for key in keys:
                    for line in lines[bisect_left(names, key) : bisect_right(names, key)]:
                        rows.append((line[1], int(line[2]), int(line[3])))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], ["path", "offset", "length"])

    asked = requests.select(F.coalesce(F.col("page_id").cast("string"), F.lit("")), "url").mapInArrow(placed, "key string, block bigint")
    asked = asked.groupBy("block").agg(F.collect_set("key").alias("keys"))  # no more keys than the block has lines, if each was captured
    return asked.join(blocks, "block").select("keys", "lines").mapInArrow(located, "path string, offset bigint, length bigint")


def read_records(spark: SparkSession, places: DataFrame, page_type: str = "bigint") -> DataFrame:
    """``page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload`` at the places given.

    Size and digest of a response are computed from its payload and must be those of its header; a revisit
    has those of the payload that it refers to, and no payload of its own. Places that lie together in a file
    are read together, up to ``RUN_BYTES``.
    """
    kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary())
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]

    def judged(data: bytes) -> tuple:
        fields, block = parse(data)
        head, _, payload = block.partition(b"\r\n\r\n")
        digest = fields["warc-payload-digest"].removeprefix("sha1:")
        size = int(re.search(rb"(?im)^content-length:\s*([0-9]+)", head)[1])
        kind, refers = fields["warc-type"], fields.get("warc-refers-to")
        if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
            raise ValueError(f"record {fields['warc-record-id']} does not hold what its header says")
        return (_page(fields["warc-record-id"]) or None, fields.get("warc-target-uri"), size, digest, kind, _page(refers) if refers else None, payload if kind == "response" else None)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, source = None, None
        for batch in batches:
            for run in _runs(zip(*(c.to_pylist() for c in batch.columns))):
                if run[0][0] != path:
                    if source is not None:
                        source.close()
                    path = run[0][0]
                    source = _opened(path)
                low = run[0][1]
                source.seek(low)
                held = memoryview(source.read(run[-1][1] + run[-1][2] - low))
                rows = [judged(zlib.decompress(held[offset - low : offset - low + length], 31)) for _, offset, length in run]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
        if source is not None:
            source.close()

    dealt = places.repartition("path", F.floor(F.col("offset") / RUN_BYTES)).sortWithinPartitions("path", "offset")
    out = dealt.mapInArrow(read, "page_id string, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to string, payload binary")
    return out.withColumn("page_id", F.col("page_id").cast(page_type)).withColumn("refers_to", F.col("refers_to").cast(page_type))


def _runs(places: Iterator[tuple[str, int, int]]) -> Iterator[list[tuple[str, int, int]]]:
    """Sorted places in runs that are worth one read: of one file, with gaps of no more than a record's size."""
    run: list[tuple[str, int, int]] = []
    for place in places:
        if run and (place[0] != run[0][0] or place[1] + place[2] - run[0][1] > RUN_BYTES or place[1] - run[-1][1] - run[-1][2] > 65536):
            yield run
            run = []
        run.append(place)
    if run:
        yield run


def op5_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to an archive and read back through the index: one row a page, or an error.

    A null html is an empty payload; a null url is one without a host; payloads and urls may have any length and
    hold any character; of rows that repeat the stored page each has its record; an empty table gives no row;
    no other column is read, whatever its name.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    archive = write_archive(pages)
    places = written(look_up(pages, write_index(spark, archive)), "places")
    asked, found = pages.count(), places.count()
    if asked != found:
        raise ValueError(f"{asked} pages were archived and {found} records found")
    return read_records(spark, places, pages.schema["page_id"].dataType.simpleString()).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op5_warc_archive": op5_warc_archive}
ORACLE = {
    "op5_warc_archive": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT payload_digest, max(page_id) AS top FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < top THEN top END AS refers_to
FROM p LEFT JOIN m USING (payload_digest)""",
}
