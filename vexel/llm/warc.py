"""Web archives (WARC/1.1) in Zstandard: one frame a record, and the dictionary in a skippable frame ahead of them.

An archive is written by one task, as rows of Spark's text writer: each row is a whole frame, and what the writer puts
behind a row is an empty skippable frame, which readers pass over. So archives go to any store that Spark writes to,
under its commit protocol: a task that is repeated leaves no second archive.

The reader walks the frames of an archive by their lengths, decodes each by itself, and checks the record in it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# Fixed values of the formats.
FRAME, DICTIONARY, COMPRESSED_OR_RAW = 0xFD2FB528, 0x184D2A5D, 0xEC30A437
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: An empty skippable frame.
GAP = "P*M\x18\0\0\0\0"

SAMPLES, SAMPLE_BYTES, DICTIONARY_BYTES = 256, 16 << 10, 64 << 10
LEVEL = 3
LARGEST = 1 << 30  # bytes of a decoded record at most; a frame that claims more is an error
BATCH = 4 << 20  # bytes of records in a batch of results
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the namespace of URLs


class Damaged(ValueError):
    """What a frame or record breaks of its format."""


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def trained(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes | None:
    """A dictionary of the samples; none if they are too few to learn from."""
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, samples)) // 8), samples, k=256, d=8).as_bytes() or None
    except (zstandard.ZstdError, ValueError):
        return None


def dictionary_frame(dictionary: bytes) -> bytes:
    packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
    return struct.pack("<II", DICTIONARY, len(packed)) + packed


def record_id(page_id: int | None, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'page:{page_id}:{payload_digest}')}>"


def _uri(url: str) -> str:
    """The URL without what would end its header line."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def _record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    named = [("WARC-Type", kind), *fields, ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Length", str(len(block)))]
    head = b"".join(f"{name}: {value}\r\n".encode() for name, value in named)
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, revisits: int | None, date: str) -> bytes:
    """A response record with the payload or, for a page whose payload that of page `revisits` equals, a revisit record
    with its HTTP headers only."""
    sha = digest(payload)
    fields = [("WARC-Record-ID", record_id(page_id, sha)), ("WARC-Date", date), ("WARC-Target-URI", _uri(url or "")), ("WARC-Payload-Digest", f"sha1:{sha}"), ("Content-Type", "application/http; msgtype=response")]
    if page_id is not None:
        fields.append(("X-Page-Id", str(page_id)))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if revisits is None:
        return _record("response", fields, http + payload)
    fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(revisits, sha)), ("X-Refers-To-Page-Id", str(revisits))]
    return _record("revisit", fields, http)


def _kinds(pages: DataFrame, least: int) -> DataFrame:
    """Adds `revisits`: the smallest page_id of those with an equal payload of `least` bytes or more, null for that page."""
    rows = pages.withColumn("same", F.sha2("payload", 256))
    first = rows.where(F.octet_length("payload") >= least).groupBy("same").agg(F.min("page_id").alias("first"))
    # Many pages to one row: Spark can split the side of a payload that many pages have.
    joined = rows.join(first, "same", "left")
    other = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "payload", F.when(other, F.col("first")).alias("revisits"))


def _dictionary(pages: DataFrame) -> bytes | None:
    """Learnt from the beginnings of SAMPLES payloads, chosen by a hash of the id: a bounded sample."""
    rows = pages.where(F.octet_length("payload") > 0).select(F.xxhash64("page_id", "url").alias("h"), F.substring("payload", 1, SAMPLE_BYTES).alias("start")).orderBy("h", "start").limit(SAMPLES)
    return trained([bytes(r.start) for r in rows.collect()])


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", least: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes a record for each row of pages to archives in the folder `path`, an archive for each partition.

    The payload is the text in UTF-8 (null: empty). Of pages with equal payloads of at least `least` bytes that with the
    smallest id is a response and the others revisit it; rows that repeat this id are responses, too. Null ids come
    after all others and stay out of the record, as do null URLs. No pages give no records; other columns are ignored.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("payload"))
    dictionary = _dictionary(rows)
    lead = dictionary_frame(dictionary) if dictionary else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learnt = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=learnt, write_checksum=True, write_content_size=True)
        held, size = [lead] if lead else [], 0
        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(4))):
                page_id, url, payload, revisits = (x.as_py() for x in row)
                held.append(packer.compress(page_record(page_id, url, payload, revisits, date)))
                size += len(held[-1])
                if size >= BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["frame"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["frame"])

    common.small_batches(pages.sparkSession)
    frames = _kinds(rows, least).mapInArrow(run, "frame binary")
    frames.select(F.col("frame").cast("string").alias("value")).write.mode("overwrite").option("lineSep", GAP).option("compression", "none").text(path)


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard or skippable frame that starts at `at` ends, by the lengths in its headers."""
    try:
        (magic,) = struct.unpack_from("<I", data, at)
        if magic in SKIPPABLE:
            end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
        elif magic != FRAME:
            raise Damaged(f"no frame at {at}")
        else:
            flags = data[at + 4]
            single, has_sum = flags >> 5 & 1, flags >> 2 & 1
            end = at + 5 + (not single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
            last = False
            while not last:
                head = int.from_bytes(data[end : end + 3], "little")
                if end + 3 > len(data):
                    raise Damaged(f"frame at {at} is cut off")
                last, kind, size = head & 1, head >> 1 & 3, head >> 3
                if kind == 3:
                    raise Damaged(f"frame at {at} has a block of an unknown kind")
                end += 3 + (1 if kind == 1 else size)
            end += 4 * has_sum
    except (struct.error, IndexError) as e:
        raise Damaged(f"frame at {at} is cut off") from e
    if end > len(data):
        raise Damaged(f"frame at {at} is cut off")
    return end


def read_dictionary(data: memoryview) -> tuple[bytes | None, int]:
    """The dictionary of the leading skippable frame, packed or not, if there is one, and where the records start."""
    if len(data) < 8 or struct.unpack_from("<I", data, 0)[0] != DICTIONARY:
        return None, 0
    end = frame_end(data, 0)
    held = bytes(data[8:end])
    if held[:4] == struct.pack("<I", FRAME):
        try:
            held = zstandard.ZstdDecompressor().decompress(held, max_output_size=LARGEST)
        except zstandard.ZstdError as e:
            raise Damaged(f"the dictionary can't be decoded: {e}") from e
    if held[:4] != struct.pack("<I", COMPRESSED_OR_RAW):
        raise Damaged("the leading frame holds no dictionary")
    return held, end


def _fields(head: bytes, what: str) -> dict[str, str]:
    """Named fields by lower-case name; lines that begin with a space go on with the field before."""
    fields: dict[str, str] = {}
    name = None
    for line in head.split(b"\r\n"):
        text = line.decode("utf-8", "replace")
        if name and text[:1] in (" ", "\t"):
            fields[name] += f" {text.strip()}"
            continue
        name, colon, value = text.partition(":")
        name = name.strip().lower()
        if not colon or not name:
            raise Damaged(f"a line of the {what} headers has no name")
        fields.setdefault(name, value.strip())
    return fields


def _length(fields: dict[str, str], what: str) -> int:
    value = fields.get("content-length", "")
    if not (value.isascii() and value.isdigit()):
        raise Damaged(f"the {what} headers have no Content-Length")
    return int(value)


def _checked(fields: dict[str, str], name: str, data: bytes) -> None:
    kind, _, value = fields.get(name, "").partition(":")
    if kind.lower() == "sha1" and value.upper() != digest(data):
        raise Damaged(f"{name} is of other bytes")


def parsed(record: bytes) -> dict:
    """The fields of a decoded record, whose headers, lengths and digests are checked."""
    head, gap, rest = record.partition(b"\r\n\r\n")
    version, _, head = head.partition(b"\r\n")
    if not gap or not version.startswith(b"WARC/1."):
        raise Damaged("no WARC record")
    fields = _fields(head, "record's")
    for name in ("warc-type", "warc-record-id", "warc-date"):
        if not fields.get(name):
            raise Damaged(f"the record has no {name}")
    if len(rest) != _length(fields, "record's") + 4 or rest[-4:] != b"\r\n\r\n":
        raise Damaged("the record's length isn't its Content-Length")
    block = rest[:-4]
    _checked(fields, "warc-block-digest", block)
    kind = fields["warc-type"].lower()
    payload, size = block, len(block)
    if kind in ("response", "revisit") and fields.get("content-type", "").lower().startswith("application/http"):
        http, gap, payload = block.partition(b"\r\n\r\n")
        if not gap or not http.startswith(b"HTTP/"):
            raise Damaged("the record holds no HTTP response")
        sent = _fields(http.partition(b"\r\n")[2], "HTTP") if b"\r\n" in http else {}
        size = len(payload)
        if kind == "revisit":
            size = _length(sent, "HTTP")
            if payload:
                raise Damaged("a revisit has a payload")
        elif "content-length" in sent and _length(sent, "HTTP") != size:
            raise Damaged("the payload's length isn't its Content-Length")
    if kind != "revisit":
        _checked(fields, "warc-payload-digest", payload)
    named = fields.get("warc-payload-digest", "")
    whole = lambda name: int(v) if (v := fields.get(name, "")).lstrip("-").isdigit() else None
    return {
        "record_type": kind, "record_id": fields["warc-record-id"], "target_uri": fields.get("warc-target-uri"), "date": fields["warc-date"], "page_id": whole("x-page-id"), "refers_to": whole("x-refers-to-page-id"),
        "refers_to_id": fields.get("warc-refers-to"), "payload_digest": named.partition(":")[2].upper() or (digest(payload) if kind != "revisit" else None), "payload_bytes": size, "payload": payload if kind != "revisit" else None, "error": None,
    }


def records(data: bytes, largest: int = LARGEST) -> Iterator[tuple[int, dict]]:
    """Place and fields of each record of an archive. A record that breaks its format has only an error; behind a frame
    whose end can't be found, nothing is read."""
    view, at = memoryview(data), 0
    try:
        dictionary, at = read_dictionary(view)
        reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        while at < len(view):
            end = frame_end(view, at)
            if struct.unpack_from("<I", view, at)[0] == FRAME:
                try:
                    if (size := zstandard.frame_content_size(view[at:end])) > largest:
                        raise Damaged(f"the record has {size} bytes")
                    yield at, parsed(reader.decompress(view[at:end], max_output_size=largest if size < 0 else 0))
                except (Damaged, zstandard.ZstdError) as e:
                    yield at, {"error": str(e)}
            at = end
    except Damaged as e:
        yield at, {"error": str(e)}


COLUMNS = {
    "record_type": pa.string(), "record_id": pa.string(), "target_uri": pa.string(), "date": pa.string(), "page_id": pa.int64(), "refers_to": pa.int64(),
    "refers_to_id": pa.string(), "payload_digest": pa.string(), "payload_bytes": pa.int64(), "payload": pa.binary(), "error": pa.string(),
}
READ = "archive string, offset long, record_type string, record_id string, target_uri string, date string, page_id long, refers_to long, refers_to_id string, payload_digest string, payload_bytes long, payload binary, error string"


def read(spark: SparkSession, path: str, payloads: bool = True, largest: int = LARGEST) -> DataFrame:
    """A row for each record of the archives in a folder or of a glob: its place and fields, or what is wrong with it as
    `error`. A task holds one archive at a time, of 2 GB at most. Revisits have no payload; theirs is that of the record
    they refer to. No archives give no rows, a folder that isn't there is Spark's error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[tuple[str, int, dict]]) -> pa.RecordBatch:
            columns = [pa.array([r[2].get(c) for r in rows], t) for c, t in COLUMNS.items()]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), *columns], ["archive", "offset", *COLUMNS])

        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                held, size = [], 0
                for at, fields in records(content.as_buffer(), largest):
                    size += 500 + len(fields.get("payload") or b"") * payloads
                    held.append((name.as_py(), at, fields if payloads else fields | {"payload": None}))
                    if size >= BATCH:
                        yield made(held)
                        held, size = [], 0
                if held:
                    yield made(held)

    common.small_batches(spark)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, READ)


def archived(pages: DataFrame, path: str | None = None) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each row of pages, from archives that are
    written to a folder (one in the shared folder by default) and read back. A damaged record is an error."""
    spark = pages.sparkSession
    path = path or common.shared_dir(spark)
    write(pages, path)
    found = read(spark, path, payloads=False)
    sound = F.when(F.col("error").isNotNull(), F.raise_error(F.concat("archive", F.lit(": "), "error"))).otherwise(F.col("record_type"))
    return found.select("page_id", "payload_bytes", "payload_digest", sound.alias("record_type"), "refers_to")
