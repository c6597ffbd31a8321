"""WARC archives of pages with a two-level capture index.

Archives. Each task writes its pages as WARC 1.1 records, a gzip member each, into files of its own in the shared
folder. Of pages with equal payloads (by SHA-1 and length) the first by page_id is a response; the others are
revisits that keep its digest, its HTTP headers and a reference to it, but no payload. Payloads are not shuffled
unless more digests repeat than may be broadcast; then a digest of many pages is split off as hot.

Index. Captures are sorted by key (the URL with its host's labels reversed) over ranges; each range is written as a
file of compressed blocks of ``BLOCK_LINES`` captures, and a directory of its blocks (first and last key, place)
follows them in the same file. The driver holds one row for each range: first and last key, and where the directory is.

Lookup. Keys are sent to the ranges whose bounds hold them (binary search in the bounds), there to the blocks that
the directory names (binary search), and only those blocks are read and searched (binary search) for captures. A key
with captures in many blocks has them all read, each in the task of its block. Captures are then dealt by
archive file and stretch of it, and read as ranges, neighbours together.

What is written by a task that fails or runs twice is never referred to: files have unique names, and only the
rows that Spark commits name them. Archives and index stay in the shared folder; ``discard`` removes them.

A null html is an empty payload, a null or host-less url has the key of its text (null: empty). Repeated rows are
records of their own: of those alike in page_id, url and payload one is the response and the others revisit it. A
null page_id comes last. Texts are read whole (a record must fit in memory); an empty table gives no rows and no files; columns
besides ``page_id``, ``url`` and ``html`` are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signflow.functions.skew import join_hot
from signflow.llm.common import prepare
from signflow.session import discard, materialize, scratch

#: Captures in a block of the index; bytes after which a task begins another archive file, and of a stretch that one task reads.
BLOCK_LINES, ARCHIVE_BYTES, STRETCH_BYTES = 1000, 1 << 30, 16 << 20
#: Rows alike in everything that are numbered at a time.
RUN = 10_000
#: Gap in bytes that a range read passes over rather than read twice, and bytes that it takes at a time at most.
GAP, AT_ONCE = 64 << 10, 8 << 20
#: Repeated digests (about 100 bytes each) up to which they are broadcast.
BROADCAST_REPEATED = 50_000
DATE = "2000-01-01T00:00:00Z"
CRLF = b"\r\n"


def surt(url: str | None) -> str:
    """The URL with its scheme left out and its host's labels reversed, as in ``com,example)/a?b``; other texts as they are."""
    try:
        parts = urlsplit(url or "")
        host = parts.hostname if "://" in (url or "") else None
    except ValueError:
        host = None
    if not host:
        return url or ""
    rest = url.split("://", 1)[1]
    cut = min((i for c in "/?#" if (i := rest.find(c)) >= 0), default=len(rest))
    port = rest[:cut].rpartition("@")[2].rpartition(":")[2] if parts.netloc.rpartition("@")[2].count(":") == 1 else ""
    return ",".join(reversed(host.split("."))) + (f":{port}" if port.isdigit() else "") + ")" + (rest[cut:] or "/")


def digest32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record_id(page_id: int | None, url: str | None) -> str:
    """A URN that depends on the page alone."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{url}')}>"


def head(lines: list[tuple[str, object]], first: str) -> bytes:
    clean = lambda v: str(v).replace("\r", "%0D").replace("\n", "%0A")
    return CRLF.join([first.encode(), *(f"{k}: {clean(v)}".encode("utf-8", "surrogatepass") for k, v in lines if v is not None), b"", b""])


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, kind: str, first: tuple[int | None, str | None]) -> bytes:
    """A WARC record: a response with its payload, or a revisit of ``first`` with the HTTP headers alone."""
    http = head([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", size)], "HTTP/1.1 200 OK")
    block = http + payload if kind == "response" else http
    lines = [("WARC-Type", kind), ("WARC-Record-ID", record_id(page_id, url)), ("WARC-Date", DATE), ("WARC-Target-URI", url), ("Page-ID", page_id), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if kind == "revisit":
        lines += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(*first)), ("WARC-Refers-To-Target-URI", first[1]), ("Refers-To-Page-ID", first[0])]
    lines += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    return head(lines, "WARC/1.1") + block + CRLF + CRLF


def fields(raw: bytes) -> dict[str, str]:
    """Names (lower case) and values of header lines."""
    return {k.decode().strip().lower(): v.decode("utf-8", "surrogatepass").strip() for k, _, v in (x.partition(b":") for x in raw.split(CRLF)[1:]) if k}


def parse(raw: bytes) -> dict:
    """What a record says: its headers, and of its HTTP message payload_bytes, payload_digest and payload (of a revisit none)."""
    top, _, rest = raw.partition(CRLF + CRLF)
    own = fields(top)
    block = rest[: int(own["content-length"])]
    if rest[len(block) :] != CRLF + CRLF:
        raise ValueError("a WARC record ends where its length doesn't")
    http, _, payload = block.partition(CRLF + CRLF)
    said = own["warc-payload-digest"].removeprefix("sha1:")
    if own["warc-type"] == "response":
        found = digest32(hashlib.sha1(payload).digest())
        if found != said:
            raise ValueError(f"a payload's digest is {found}, not {said}")
        return own | {"payload": payload, "payload_bytes": len(payload), "payload_digest": found}
    return own | {"payload": None, "payload_bytes": int(fields(http)["content-length"]), "payload_digest": said}


def squeeze(raw: bytes) -> bytes:
    """One gzip member."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def expand(raw: bytes) -> bytes:
    return zlib.decompress(raw, 31)


def opened(path: str):
    """The file system of a path or URI, and the path in it."""
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)


def ranges(file: str, places: list[tuple[int, int]]) -> Iterator[bytes]:
    """The bytes at sorted (offset, length), read in runs whose gaps are small."""
    fs, path = opened(file)
    with fs.open_input_file(path) as f:
        i = 0
        while i < len(places):
            start, j, end = places[i][0], i, places[i][0] + places[i][1]
            while j + 1 < len(places) and places[j + 1][0] - end <= GAP and places[j + 1][0] + places[j + 1][1] - start <= AT_ONCE:
                j += 1
                end = max(end, places[j][0] + places[j][1])
            data = f.read_at(end - start, start)
            for o, n in places[i : j + 1]:
                yield data[o - start : o - start + n]
            i = j + 1


class Writer:
    """Members in files of a folder, each of which ends at about ARCHIVE_BYTES."""

    def __init__(self, folder: str, suffix: str):
        self.fs, self.path = opened(folder)
        self.folder, self.suffix, self.out, self.at, self.name = folder, suffix, None, 0, ""
        self.fs.create_dir(self.path, recursive=True)

    def add(self, member: bytes) -> tuple[str, int, int]:
        """File, offset and length of the member."""
        if self.out is None:
            name = f"{uuid.uuid4().hex}.{self.suffix}"
            self.name, self.at = f"{self.folder}/{name}", 0
            self.out = self.fs.open_output_stream(f"{self.path}/{name}", compression=None)
        self.out.write(member)
        place = self.name, self.at, len(member)
        self.at += len(member)
        if self.at >= ARCHIVE_BYTES:
            self.close()
        return place

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


CAPTURE = "key string, page_id bigint, kind string, file string, offset bigint, length bigint"
_NAMES = [x.split()[0] for x in CAPTURE.split(", ")]


def _captures(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], _NAMES)


def typed(pages: DataFrame) -> tuple[DataFrame, list[str]]:
    """page_id, url, payload (binary; null for revisits), size, sha1, kind and the response's first_id and first_url, a row for each record; and the scratch tables it reads."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha1", F.unhex(F.sha1("payload"))).withColumn("size", F.octet_length("payload").cast("bigint"))
    own = F.struct(F.col("page_id").isNull().alias("last"), "page_id", "url")
    repeated = rows.groupBy("sha1", "size").agg(F.min(own).alias("first"), F.count("*").alias("pages")).where("pages > 1")
    repeated, path = materialize(repeated, "digests")
    n, paths = repeated.count(), [path]
    if n <= BROADCAST_REPEATED:
        told = rows.join(F.broadcast(repeated.drop("pages")), ["sha1", "size"], "left")
    else:
        slim, slim_path = materialize(rows, "payloads")
        paths.append(slim_path)
        told = join_hot(slim, repeated, ["sha1", "size"], "pages", slim.count(), "left")
    first = F.col("first").eqNullSafe(own)
    kind = F.when(F.col("first").isNull(), "response").when(first, "first").otherwise("revisit")
    told = told.withColumn("kind", kind).withColumn("payload", F.when(F.col("kind") != "revisit", F.col("payload")))
    told = told.select("page_id", "url", "payload", "size", "sha1", "kind", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"))
    # Rows alike in page_id, url and payload: one is the response, the others revisit it
    alike = told.where("kind = 'first'").groupBy("sha1", "size").agg(F.first("page_id").alias("page_id"), F.first("url").alias("url"), F.first("payload").alias("payload"), F.count("*").alias("rows"))
    one = alike.select("page_id", "url", "payload", "size", "sha1", F.lit("response").alias("kind"), F.lit(None).cast("bigint").alias("first_id"), F.lit(None).cast("string").alias("first_url"))
    more = alike.where("rows > 1").select("page_id", "url", "size", "sha1", F.explode(F.sequence(F.lit(1), F.col("rows") - 1, F.lit(RUN))).alias("from"), "rows").repartition("sha1", "from")
    more = more.select("page_id", "url", "size", "sha1", F.explode(F.sequence("from", F.least(F.col("from") + RUN, "rows") - 1)).alias("k"))
    more = more.select("page_id", "url", F.lit(None).cast("binary").alias("payload"), "size", "sha1", F.lit("revisit").alias("kind"), F.col("page_id").alias("first_id"), F.col("url").alias("first_url"))
    return told.where("kind <> 'first'").unionByName(one).unionByName(more), paths


def write(pages: DataFrame, folder: str) -> tuple[DataFrame, list[str]]:
    """Captures (see CAPTURE) of the archives written to ``folder``, a record for each page; and the scratch tables that it wrote, the captures among them."""
    prepare(pages.sparkSession)
    rows, paths = typed(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, done = Writer(folder, "warc.gz"), []
        for b in batches:
            for page_id, url, payload, size, sha1, kind, first_id, first_url in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "size", "sha1", "kind", "first_id", "first_url")), strict=True):
                raw = record(page_id, url, payload, size, digest32(sha1), kind, (first_id, first_url))
                done.append((surt(url), page_id, kind, *out.add(squeeze(raw))))
            if len(done) >= 5000:
                yield _captures(done)
                done = []
        out.close()
        if done:
            yield _captures(done)

    captures, path = materialize(rows.mapInArrow(run, CAPTURE), "captures")
    return captures, [*paths, path]


@dataclass
class Index:
    """Its ranges in order: first key, last key, file, and the directory's offset and length."""

    bounds: list[tuple[str, str, str, int, int]]


def index(captures: DataFrame, folder: str) -> Index:
    """Write the capture index; the driver gets one row for each range of keys."""
    prepare(captures.sparkSession)
    ordered = captures.repartitionByRange("key", "page_id", "file", "offset").sortWithinPartitions("key", "page_id", "file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, blocks = Writer(folder, "cdx.gz"), [], []
        place = None

        def block() -> None:
            nonlocal place
            lines = "".join(json.dumps(row) + "\n" for row in held)
            place = _same_file(out, squeeze(lines.encode("ascii")))
            blocks.append((held[0][0], held[-1][0], *place[1:]))
            held.clear()

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in _NAMES), strict=True):
                held.append(row)
                if len(held) >= BLOCK_LINES:
                    block()
        if held:
            block()
        if blocks:
            file, offset, length = _same_file(out, squeeze(json.dumps(blocks).encode("ascii")))
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (blocks[0][0], blocks[-1][1], file, offset, length)], ["first", "last", "file", "offset", "length"])

    rows = ordered.mapInArrow(run, "first string, last string, file string, offset bigint, length bigint").collect()
    return Index(sorted(tuple(r) for r in rows))


def _same_file(out: Writer, member: bytes) -> tuple[str, int, int]:
    """Add a member without ending the file at any size: a range has one file."""
    if out.out is None:
        return out.add(member)
    out.out.write(member)
    place = out.name, out.at, len(member)
    out.at += len(member)
    return place


def lookup(ix: Index, keys: DataFrame) -> DataFrame:
    """The captures (see CAPTURE) of the distinct ``key`` values of ``keys``."""
    spark = keys.sparkSession
    prepare(spark)
    held = spark.sparkContext.broadcast(ix.bounds)  # a row for each range

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = held.value
        firsts, lasts = [b[0] for b in bounds], [b[1] for b in bounds]
        for b in batches:
            found = [(k, i) for k in b.column("key").to_pylist() for i in range(bisect.bisect_left(lasts, k), bisect.bisect_right(firsts, k))]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.int32())], ["key", "range"])

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, directories = held.value, {}
        for b in batches:
            found = []
            for k, i in zip(b.column("key").to_pylist(), b.column("range").to_pylist(), strict=True):
                if i not in directories:
                    directories.clear()  # rows come sorted by range
                    _, _, file, offset, length = bounds[i]
                    blocks = json.loads(expand(next(ranges(file, [(offset, length)]))))
                    directories[i] = [x[0] for x in blocks], [x[1] for x in blocks], blocks
                firsts, lasts, blocks = directories[i]
                found += [(k, i, *blocks[j][2:]) for j in range(bisect.bisect_left(lasts, k), bisect.bisect_right(firsts, k))]
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], t) for c, t in enumerate((pa.string(), pa.int32(), pa.int64(), pa.int64()))], ["key", "range", "at", "size"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, here, lines, firsts = held.value, None, [], []
        for b in batches:
            found = []
            for k, i, at, size in zip(*(b.column(c).to_pylist() for c in ("key", "range", "at", "size")), strict=True):
                if here != (i, at):
                    here = i, at
                    lines = [tuple(json.loads(x)) for x in expand(next(ranges(bounds[i][2], [(at, size)]))).decode("ascii").splitlines()]
                    firsts = [x[0] for x in lines]
                found += lines[bisect.bisect_left(firsts, k) : bisect.bisect_right(firsts, k)]
            yield _captures(found)

    asked = keys.select("key").where("key is not null").distinct().mapInArrow(route, "key string, range int")
    placed = asked.repartition("range").sortWithinPartitions("range").mapInArrow(narrow, "key string, range int, at bigint, size bigint")
    return placed.repartition("range", "at").sortWithinPartitions("range", "at", "key").mapInArrow(read, CAPTURE)


RECORD = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


def records(captures: DataFrame, payloads: bool = True) -> DataFrame:
    """The records (see RECORD) at ``captures``, read as ranges of their archives; payloads are checked against their digests, and left out if not asked for."""
    prepare(captures.sparkSession)
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def told(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], k) for i, k in enumerate(kinds)], [x.split()[0] for x in RECORD.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, held = [], 0
            by_file: dict[str, list] = {}
            for f, o, n in zip(*(b.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                by_file.setdefault(f, []).append((o, n))
            for f, places in by_file.items():
                for raw in ranges(f, sorted(places)):
                    x = parse(expand(raw))
                    ids = [int(x[c]) if c in x else None for c in ("page-id", "refers-to-page-id")]
                    found.append((ids[0], x.get("warc-target-uri"), x["payload_bytes"], x["payload_digest"], x["warc-type"], ids[1], x["payload"] if payloads else None))
                    held += len(x["payload"] or b"") if payloads else 0
                    if held > AT_ONCE:
                        yield told(found)
                        found, held = [], 0
            yield told(found)

    stretch = F.floor(F.col("offset") / STRETCH_BYTES)
    dealt = captures.repartition("file", stretch).sortWithinPartitions("file", "offset")
    return dealt.select("file", "offset", "length").mapInArrow(run, RECORD)


def keys_of(pages: DataFrame, url: Column) -> DataFrame:
    """The index keys of the rows' URLs."""
    prepare(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([surt(u) for u in b.column("url").to_pylist()], pa.string())], ["key"])

    return pages.select(url.cast("string").alias("url")).mapInArrow(run, "key string")


def archive(pages: DataFrame) -> tuple[str, Index]:
    """Write archives and index of ``pages`` to a new shared folder; where, and the index."""
    spark: SparkSession = pages.sparkSession
    folder = scratch(spark, "warc")
    captures, paths = write(pages, folder)
    ix = index(captures, f"{folder}/index")
    discard(spark, *paths)
    return folder, ix


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, by looking all URLs up in the index of archives just written."""
    _, ix = archive(pages)
    found = records(lookup(ix, keys_of(pages, F.col("url"))), payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
