"""WARC archives: a writer, and a reader that splits gzip archives at any byte.

Writer: a gzip member for each record. Of pages with equal payloads of ``REVISIT_BYTES`` or more, the largest page_id is stored as a response and the
others as revisits that refer to it. Only those can have a copy; shorter ones are written where they are read. Copies are found on digests; the join key differs from the aggregate's, so both sides are dealt by it and the
adaptive planner can split a digest that a large part of the pages share.

Reader: a task takes a byte range, looks for the gzip magic, and accepts a candidate only if it inflates to a WARC header and another member or the end follows. It owns the
members that start inside its range and reads the last one beyond the range's end. The position after a member is known from inflating it, so
magic bytes inside a member's data are met only before the first member of a range, where these checks reject them.
Damaged members are passed over (and one before which nothing was read, if the next one's magic is damaged).

Files are reached through pyarrow's file systems (local paths, hdfs, s3, gs); tasks write below a folder of the shared scratch space.

Defined results: a null html is an empty payload; a null url gives a record without target; a null page_id is kept as null, and the
response of its group if all are null; rows of one page_id and payload that repeat have one type; very long payloads are stored whole; an empty table gives no archives and no records. Of pages, page_id, url and
html are read, whatever other columns are called.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import batch, bounded_batches, filesystem, materialize, put_file, scratch, tidy

REVISIT_BYTES = 1000
SPLIT_BYTES = 8 << 20
DATE = "2020-01-01T00:00:00Z"
MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CHUNK = 1 << 16
_HEADER_BYTES = 1 << 20


def record(page_id: int | None, url: str | None, payload: bytes, length: int, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member. A revisit has the HTTP header of the full payload, and no payload."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode() + (b"" if revisit else payload)
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c >= " " else f"%{ord(c):02X}" for c in url))
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    whole = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(whole) + packer.flush()


def parse(content: bytes):
    """(headers by lower-case name, block) of each record in an inflated member."""
    at = 0
    while content.startswith(b"WARC/", at):
        end = content.find(b"\r\n\r\n", at)
        if end < 0:
            return
        headers = {}
        for line in content[at:end].split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
        try:
            size = int(headers["content-length"])
        except (KeyError, ValueError):
            return
        yield headers, content[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def _find(read, at: int, end: int, size: int) -> int | None:
    """The first place of MAGIC that starts in [at, end)."""
    while at < end:
        data = read(at, min(1 << 20, size - at))
        k = data.find(MAGIC)
        if k >= 0:
            return at + k if at + k < end else None
        if len(data) < len(MAGIC):
            return None
        at += len(data) - len(MAGIC) + 1
    return None


def _inflate(read, at: int, size: int) -> tuple[bytes, int] | None:
    """The content and end of the member at ``at``, if it begins with a WARC header."""
    unpacker, out, checked, pos = zlib.decompressobj(31), [], False, at
    try:
        while not unpacker.eof:
            data = read(pos, min(_CHUNK, size - pos))
            if not data:
                return None
            pos += len(data)
            out.append(unpacker.decompress(data))
            if not checked:
                head = b"".join(out)
                if not b"WARC/".startswith(head[:5]) and not head.startswith(b"WARC/"):
                    return None
                end = head.find(b"\r\n\r\n")
                if end < 0 and len(head) > _HEADER_BYTES:
                    return None
                if end >= 0:
                    if b"\r\nwarc-type:" not in head[:end].lower():
                        return None
                    checked, out = True, [head]
    except zlib.error:
        return None
    return (b"".join(out), pos - len(unpacker.unused_data)) if checked else None


def members(read, size: int, start: int, end: int):
    """(offset, content) of each valid member that starts in [start, end). read(at, n) gives bytes of the archive.

    The first byte of the archive and the end of a member are places where members begin. A candidate found by looking for the magic has to be
    followed by another member or the end of the archive, which what is stored inside a member is not.
    """
    at, known = start, start == 0
    while at < end:
        place = _find(read, at, min(end, size), size)
        if place is None:
            return
        known = known and place == at
        found = _inflate(read, place, size)
        if found is None or not (known or found[1] >= size or read(found[1], len(MAGIC)) == MAGIC):
            at, known = place + 1, False
        else:
            yield place, found[0]
            at, known = found[1], True


def archive_rows(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload (null for a revisit), payload_bytes, digest, refers_to, revisit."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html")).withColumns({"payload_bytes": F.octet_length("html").cast("long"), "digest": F.sha1("html")})
    long = rows.filter(F.col("payload_bytes") >= revisit_bytes)
    copies = long.groupBy(F.unhex("digest").alias("sha")).agg(F.max("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    copies = copies.select(F.lower(F.hex("sha")).alias("of"), "first")
    joined = long.join(copies, long.digest == copies.of, "left")
    revisit = F.col("of").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    found = joined.select("page_id", "url", F.when(~revisit, F.col("html")).alias("payload"), "payload_bytes", "digest", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))
    short = rows.filter(F.col("payload_bytes") < revisit_bytes).select("page_id", "url", F.col("html").alias("payload"), "payload_bytes", "digest", F.lit(None).cast("long").alias("refers_to"), F.lit(False).alias("revisit"))
    return found.unionByName(short)


def write_archives(pages: DataFrame, folder: str, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Write an archive for each task below folder; path and size of each."""
    bounded_batches(pages.sparkSession)
    schema = pa.schema([("path", pa.string()), ("size", pa.int64())])

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        path = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"

        def records():
            for b in batches:
                for page_id, url, payload, length, digest, refers_to, revisit in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "payload_bytes", "digest", "refers_to", "revisit"))):
                    yield record(page_id, url, (payload or "").encode("utf-8", "surrogatepass"), length, digest, refers_to, revisit)

        made = records()
        first = next(made, None)
        if first is not None:
            yield batch(schema, path=[path], size=[put_file(path, (x for part in ((first,), made) for x in part))])

    return materialize(archive_rows(pages, revisit_bytes).mapInArrow(tidy(run), "path string, size long"), "archives")


def _page(urn: str | None) -> int | None:
    digits = (urn or "").strip("<>").rpartition(":")[2]
    return int(digits) if digits.lstrip("-").isdigit() else None


_RECORD = "path string, at long, record_type string, record_id string, target_uri string, date string, refers_to string, http_length long, declared_digest string, payload binary, payload_digest string"


def read_archives(files: DataFrame, split_bytes: int = SPLIT_BYTES, payloads: bool = True) -> DataFrame:
    """A row for each record of the archives in files(path, size). payload_digest is computed here; payload is null if payloads is false."""
    schema = pa.schema([("path", pa.string()), ("at", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("refers_to", pa.string()), ("http_length", pa.int64()), ("declared_digest", pa.string()), ("payload", pa.binary()), ("payload_digest", pa.string())])
    names = schema.names

    def rows_of(path, at, content):
        for headers, block in parse(content):
            length, payload = None, block
            if headers.get("content-type", "").startswith("application/http"):
                head, _, payload = block.partition(b"\r\n\r\n")
                for line in head.lower().split(b"\r\n"):
                    if line.startswith(b"content-length:") and line[15:].strip().isdigit():
                        length = int(line[15:])
            kind = headers.get("warc-type")
            whole = None if kind == "revisit" else payload
            yield path, at, kind, headers.get("warc-record-id"), headers.get("warc-target-uri"), headers.get("warc-date"), headers.get("warc-refers-to"), length if whole is None else len(whole), headers.get("warc-payload-digest"), whole if payloads else None, None if whole is None else hashlib.sha1(whole).hexdigest()

    def run(batches):
        for b in batches:
            for path, size, start in zip(*(b.column(c).to_pylist() for c in ("path", "size", "start"))):
                fs, name = filesystem(path)
                with fs.open_input_file(name) as f:

                    def read(at, n, f=f):
                        f.seek(at)
                        return f.read(n)

                    held, weight = [], 0
                    for at, content in members(read, size, start, start + split_bytes):
                        for row in rows_of(path, at, content):
                            held.append(row)
                            weight += len(row[9] or b"") + 500
                        if weight > 4 << 20:
                            yield batch(schema, **dict(zip(names, zip(*held))))
                            held, weight = [], 0
                    if held:
                        yield batch(schema, **dict(zip(names, zip(*held))))

    ranges = files.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    count = files.filter("size > 0").agg(F.sum(F.ceil(F.col("size") / split_bytes))).first()[0] or 1
    return ranges.repartition(int(count)).mapInArrow(tidy(run), _RECORD)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages as archives and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to, url."""
    files = write_archives(pages, scratch(pages.sparkSession, "warc"))
    records = read_archives(files, payloads=False)
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")
    declared = F.regexp_extract("declared_digest", "^sha1:([0-9a-f]{40})$", 1)
    return records.select(page("record_id").alias("page_id"), F.col("http_length").alias("payload_bytes"), F.coalesce("payload_digest", declared).alias("payload_digest"), "record_type", page("refers_to").alias("refers_to"), F.col("target_uri").alias("url"))
