"""WARC archives: writing with chunked framing and segments, reading with segment reassembly.

Writing. A page becomes a response record whose block is an HTTP message in chunked transfer coding.
Of pages with equal payloads of at least `REVISIT_BYTES` the one with the smallest id is the response;
the others become revisit records that name it. A block longer than `segment_bytes` is cut: the first
record has segment number 1, the rest are continuation records that name it as their origin, and the
last carries the total length. So no record is larger than a segment, however long the page.

Reading. Files are parsed record by record. Whole responses are decoded at once. Segments are grouped
by origin, put in order of their numbers, checked for gaps and against the total length, joined and
decoded; revisits are resolved by the record they name. `intact` says whether length, framing and
digest hold.

Edge cases: a null payload is empty; a null page id comes last among equals and is kept; rows with
equal id and payload are one record written as often, and come back as often; of rows that share the
smallest id and the payload all are responses; an empty table gives no record; further columns are
ignored; an url is optional and line breaks in it become spaces.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewise.operators.staging import write_and_read

REVISIT_BYTES = 100
CHUNK_BYTES = 8192
SEGMENT_BYTES = 32768
#: Records of at most a segment each, so this bounds a file.
RECORDS_PER_FILE = 2000

END = b"\r\n\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
HTTP_REVISIT = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = []
    for start in range(0, len(payload), size):
        piece = payload[start : start + size]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError if the framing is broken."""
    parts, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if size == 0:
            return b"".join(parts)
        piece = body[at : at + size]
        if len(piece) != size or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("broken chunk")
        parts.append(piece)
        at += size + 2


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP message."""
    head, _, body = block.partition(END)
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """One record without the two line ends that close it."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}:{digest[:24]}>"


def page_records(
    page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, revisit: bool, segment_bytes: int
) -> list[bytes]:
    common = [
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if url:
        common.append(("WARC-Target-URI", " ".join(url.split())))
    if revisit:
        fields = [("WARC-Type", "revisit"), ("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(first, digest))]
        return [record(fields + common, HTTP_REVISIT)]
    block = HTTP + chunked(payload)
    pieces = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    if len(pieces) == 1:
        return [record([("WARC-Type", "response"), *common], block)]
    out = [record([("WARC-Type", "response"), *common, ("WARC-Segment-Number", 1)], pieces[0])]
    origin = record_id(page_id, digest)
    for n, piece in enumerate(pieces[1:], 2):
        fields = [
            ("WARC-Type", "continuation"),
            ("WARC-Record-ID", f"{origin[:-1]}:{n}>"),
            ("WARC-Date", DATE),
            ("WARC-Segment-Origin-ID", origin),
            ("WARC-Segment-Number", n),
        ]
        if n == len(pieces):
            fields.append(("WARC-Segment-Total-Length", len(block)))
        out.append(record(fields, piece))
    return out


def write_archives(
    pages: DataFrame,
    path: str,
    segment_bytes: int = SEGMENT_BYTES,
    records_per_file: int = RECORDS_PER_FILE,
    compression: str = "gzip",
) -> None:
    """Write (page_id, url, html) as archive files under `path`, which every executor can reach."""
    url = F.col("url") if "url" in pages.columns else F.lit(None)
    rows = pages.select(
        "page_id", url.cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    slim = rows.where(F.octet_length("payload") >= REVISIT_BYTES).groupBy("digest")
    firsts = slim.agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    rows = rows.join(firsts, "digest", "left").withColumn(
        "revisit", F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256).to_pydict()
                made: list[bytes] = []
                for row in zip(*(part[k] for k in ("page_id", "url", "payload", "digest", "first", "revisit")), strict=True):
                    made += page_records(*row, segment_bytes)
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["value"])

    records = rows.mapInArrow(build, "value binary").select(F.col("value").cast("string"))
    # The text writer copies the bytes of a value and closes each record with two line ends.
    writer = records.write.option("lineSep", END.decode()).option("maxRecordsPerFile", records_per_file)
    writer.option("compression", compression).text(path)


def inflated(data: bytes, step: int = 1 << 16) -> bytes:
    """All gzip members of a file as one text: archives have one member a record, or one for all. Padding may follow."""
    view, at, parts = memoryview(data), 0, []
    while at < len(data) and data[at]:
        member = zlib.decompressobj(47)
        while not member.eof and at < len(data):
            piece = view[at : at + step]
            parts.append(member.decompress(piece))
            at += len(piece) - len(member.unused_data)
        if not member.eof:
            raise ValueError("an archive ends inside a compressed record")
    return b"".join(parts)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of every record of a file; field names in lower case."""
    at = 0
    while at < len(data):
        end = data.index(END, at)
        head = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not head[0].startswith("WARC/"):
            raise ValueError("no record where one should start")
        fields = {k.strip().lower(): v.strip() for k, v in (line.split(":", 1) for line in head[1:])}
        start = end + len(END)
        stop = start + int(fields["content-length"])
        if data[stop : stop + len(END)] != END:
            raise ValueError("a record is longer or shorter than it says")
        yield fields, data[start:stop]
        at = stop + len(END)


PARSED = (
    "id string, page_id long, type string, refers string, digest string, segment int, total long, "
    "payload_bytes long, payload_digest string, intact boolean, piece binary"
)


def page_of(record: str | None) -> int | None:
    """The page id inside a record id."""
    part = record.strip("<>").split(":")[2] if record else "null"
    return None if part == "null" else int(part)


def decoded(block: bytes, digest: str | None) -> dict:
    """Payload length and digest of a block, and whether they hold."""
    try:
        payload = payload_of(block)
    except (ValueError, IndexError):
        return {"payload_bytes": None, "payload_digest": None, "intact": False}
    found = hashlib.sha256(payload).hexdigest()
    return {"payload_bytes": len(payload), "payload_digest": found, "intact": found == digest}


def _parsed_row(fields: dict[str, str], block: bytes) -> dict:
    kind = fields["warc-type"]
    own = fields.get("warc-segment-origin-id") if kind == "continuation" else fields["warc-record-id"]
    digest = fields.get("warc-payload-digest", "").removeprefix("sha256:") or None
    segment = fields.get("warc-segment-number")
    total = fields.get("warc-segment-total-length")
    row = dict.fromkeys(("payload_bytes", "payload_digest", "intact", "piece"))
    row |= {"id": own, "page_id": page_of(own), "type": kind, "refers": fields.get("warc-refers-to"), "digest": digest}
    row |= {"segment": int(segment) if segment else None, "total": int(total) if total else None}
    if segment:
        row["piece"] = block
    elif kind == "response":
        row |= decoded(block, digest)
    return row


def parse_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of every archive file; only segments carry their bytes."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(PARSED))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                data = content.as_py()
                if data[:2] == b"\x1f\x8b":
                    data = inflated(data)
                rows = [_parsed_row(f, b) for f, b in parse_records(data)]
                for start in range(0, len(rows), 512):
                    yield pa.RecordBatch.from_pylist(rows[start : start + 512], schema=schema)

    files = spark.read.format("binaryFile").load(path).where("length > 0").select("content")
    return files.mapInArrow(parse, PARSED)


def joined(segments: DataFrame) -> DataFrame:
    """Reassembled pages: (id, page_id, n, payload_bytes, payload_digest, intact)."""
    grouped = segments.groupBy("id", "page_id").agg(
        F.sort_array(F.collect_set(F.struct("segment", "piece"))).alias("parts"),
        F.max("total").alias("total"),
        F.max("digest").alias("digest"),
        F.sum((F.col("segment") == 1).cast("int")).cast("int").alias("n"),
    )
    out = "id string, page_id long, n int, payload_bytes long, payload_digest string, intact boolean"

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                row = {k: batch.column(k)[i].as_py() for k in ("id", "page_id", "n", "total", "digest", "parts")}
                parts = row.pop("parts")
                block = b"".join(p["piece"] for p in parts)
                whole = [p["segment"] for p in parts] == list(range(1, len(parts) + 1)) and row.pop("total") == len(block)
                made = decoded(block, row.pop("digest")) if whole else decoded(b"", None)
                rows.append({"id": row["id"], "page_id": row["page_id"], "n": row["n"] or 0} | made)
            names = ["id", "page_id", "n", "payload_bytes", "payload_digest", "intact"]
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in zip(names, kinds, strict=True)], names)

    return grouped.mapInArrow(assemble, out)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per page: page_id, payload_bytes, payload_digest, record_type, refers_to, intact."""
    parsed = write_and_read(parse_files(spark, path), "records")
    whole = parsed.where("type = 'response' and segment is null")
    pieces = joined(parsed.where("segment is not null"))
    pieces = pieces.withColumn("_times", F.explode(F.sequence(F.lit(1), F.greatest("n", F.lit(1))))).drop("n", "_times")
    fields = ["id", "page_id", "payload_bytes", "payload_digest", "intact"]
    responses = write_and_read(whole.select(*fields).unionByName(pieces.select(*fields)), "responses")
    named = responses.groupBy("id").agg(*[F.first(c).alias(f"_{c}") for c in ("page_id", "payload_bytes", "payload_digest", "intact")])
    revisits = parsed.where("type = 'revisit'").select("page_id", "refers", "digest")
    revisits = revisits.join(named, revisits["refers"] == named["id"], "left")
    return responses.select(
        "page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"),
        F.lit(None).cast("long").alias("refers_to"), "intact",
    ).unionByName(
        revisits.select(
            "page_id", F.col("_payload_bytes").alias("payload_bytes"), F.col("_payload_digest").alias("payload_digest"),
            F.lit("revisit").alias("record_type"), F.col("_page_id").alias("refers_to"),
            (F.coalesce(F.col("_intact"), F.lit(False)) & (F.col("_payload_digest") == F.col("digest"))).alias("intact"),
        )
    )
