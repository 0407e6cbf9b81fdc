"""WARC archives: written with an index first, then read by coalesced byte ranges.

`write_archives` writes one gzip member per record and returns the index: file, offset, length,
URL and digest of each record. `read_records` reads the records that an index selects: their
ranges, sorted and coalesced, are fetched in a few large reads per file.
"""

import hashlib
import uuid
import zlib

import pyarrow as pa
from marketlens.llm.runtime import file_system, ship, stored
from marketlens.session import new_table_path
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Payloads below this are stored whole each time: a revisit record would not be smaller.
LEAST_REVISIT_BYTES = 100
#: Ranges of a file at most this far apart are read together, up to READ_BYTES at once.
GAP_BYTES = 64 << 10
READ_BYTES = 8 << 20
#: Records carry this date, as the pages have none.
DATE = "2024-01-01T00:00:00Z"

_RECORD_ID = "urn:marketlens:page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("file", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("length", T.LongType()),
    ]
)
_READ = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("header_digest", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


def _header_line(text):
    """A header value: control characters, which would end or break the line, as %XX."""
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in text)


def record_bytes(page_id, url, payload, digest, refers_to):
    """One WARC/1.1 record with an HTTP response; a revisit keeps the HTTP header only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = refers_to is not None
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{_RECORD_ID}{page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header_line(url)}")
    if revisit:
        lines += [f"WARC-Refers-To: <{_RECORD_ID}{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw):
    """(headers by lower-case name, payload; None for a revisit) of one whole record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        headers[name.strip().lower().decode()] = value.strip().decode()
    block = rest[: int(headers["content-length"])]
    payload = block.partition(b"\r\n\r\n")[2] if headers["warc-type"] == "response" else None
    return headers, payload


def _page_of(record_id):
    text = record_id.strip("<>").removeprefix(_RECORD_ID)
    return None if text == "None" else int(text)


def _writer(folder, level):
    def write(batches):
        system, root = file_system(folder)
        system.create_dir(root, recursive=True)
        # A name per attempt: what a lost attempt leaves behind is in no index.
        name, sink, at = f"{uuid.uuid4().hex}.warc.gz", None, 0
        try:
            for batch in batches:
                sink = sink or system.open_output_stream(f"{root}/{name}", compression=None)
                offsets, lengths = [], []
                for row in batch.to_pylist():
                    refers_to = row["refers_to"]
                    payload = (row["payload"] or "").encode()
                    raw = record_bytes(
                        row["page_id"], row["url"], payload, row["payload_digest"], refers_to
                    )
                    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
                    member = pack.compress(raw) + pack.flush()
                    sink.write(member)
                    offsets.append(at)
                    lengths.append(len(member))
                    at += len(member)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("page_id"),
                        batch.column("url"),
                        batch.column("payload_digest"),
                        batch.column("record_type"),
                        pa.array([name] * batch.num_rows, pa.string()),
                        pa.array(offsets, pa.int64()),
                        pa.array(lengths, pa.int64()),
                    ],
                    INDEX.names,
                )
        finally:
            if sink is not None:
                sink.close()

    return write


def write_archives(pages, folder, id_col="page_id", url_col="url", payload_col="html", level=1):
    """Write a record for each row to archives in `folder`; return their stored index.

    Of rows with equal payloads of LEAST_REVISIT_BYTES or more, those with the smallest id become
    response records and the others revisits of it; a null payload is empty, a row without id is a
    response, and rows that repeat an id are records of their own. Other columns are ignored.
    """
    ship(pages.sparkSession)
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"),
    ).withColumn("payload_digest", F.sha2(F.col("payload").cast("binary"), 256))
    long_enough = F.octet_length("payload") >= LEAST_REVISIT_BYTES
    firsts = (
        rows.filter(long_enough)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("first_id"), F.count("page_id").alias("n"))
        .filter("n > 1")
        .select("payload_digest", "first_id")
    )
    marked = rows.join(firsts, "payload_digest", "left").withColumn(
        "refers_to", F.when(F.col("page_id") > F.col("first_id"), F.col("first_id"))
    )
    marked = marked.select(
        "page_id",
        "url",
        "payload_digest",
        F.when(F.col("refers_to").isNull(), "response").otherwise("revisit").alias("record_type"),
        "payload",
        "refers_to",
    )
    return stored(marked.mapInArrow(_writer(folder, level), INDEX), "warc-index")


def coalesced(spans, gap=GAP_BYTES, most=READ_BYTES):
    """Sorted (offset, length) pairs as groups, each one contiguous read."""
    groups = []
    for offset, length in spans:
        if groups:
            begin, end, members = groups[-1]
            if offset - end <= gap and offset + length - begin <= most:
                groups[-1][1] = max(end, offset + length)
                members.append((offset, length))
                continue
        groups.append([offset, offset + length, [(offset, length)]])
    return groups


def _reader(folder, with_payload):
    def rows_of(source, spans):
        for begin, end, members in coalesced(spans):
            data = source.read_at(end - begin, begin)
            for offset, length in members:
                member = data[offset - begin : offset - begin + length]
                headers, payload = parse_record(zlib.decompress(member, 31))
                yield {
                    "page_id": _page_of(headers["warc-record-id"]),
                    "record_type": headers["warc-type"],
                    "refers_to": _page_of(headers["warc-refers-to"]) if payload is None else None,
                    "payload_bytes": None if payload is None else len(payload),
                    "payload_digest": None if payload is None else hashlib.sha256(payload).hexdigest(),
                    "header_digest": headers["warc-payload-digest"].removeprefix("sha256:"),
                    "url": headers.get("warc-target-uri"),
                    "payload": payload if with_payload else None,
                }

    def read(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(_READ)
        system, root = file_system(folder)
        for batch in batches:
            by_file = {}
            for row in batch.to_pylist():
                by_file.setdefault(row["file"], []).append((row["offset"], row["length"]))
            for name, spans in by_file.items():
                with system.open_input_file(f"{root}/{name}") as source:
                    held, size = [], 0
                    for row in rows_of(source, sorted(spans)):
                        held.append(row)
                        size += len(row["payload"] or b"")
                        if len(held) >= 2000 or size >= READ_BYTES:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_pylist(held, schema)

    return read


def read_records(index, folder, with_payload=False):
    """The records that `index` selects (any rows of it), read from the archives in `folder`.

    A revisit has no payload of its own: its payload columns are null; `resolved` fills them in.
    """
    ship(index.sparkSession)
    spans = index.select(
        "file", "offset", "length", F.floor(F.col("offset") / READ_BYTES).alias("block")
    )
    near = spans.repartition("file", "block").sortWithinPartitions("file", "offset")
    return near.select("file", "offset", "length").mapInArrow(_reader(folder, with_payload), _READ)


def resolved(records):
    """Records with the payload size and digest of revisits taken from the record they refer to.

    Only digests and sizes are shuffled. A revisit whose response isn't among the records, or has
    another digest than its header says, keeps nulls.
    """
    held = records.filter("record_type = 'response'").groupBy("page_id", "payload_digest")
    held = held.agg(F.max("payload_bytes").alias("held_bytes")).select(
        F.col("page_id").alias("refers_to"),
        F.col("payload_digest").alias("header_digest"),
        F.col("payload_digest").alias("held_digest"),
        "held_bytes",
    )
    return records.join(held, ["refers_to", "header_digest"], "left").select(
        "page_id",
        F.coalesce("payload_bytes", "held_bytes").alias("payload_bytes"),
        F.coalesce("payload_digest", "held_digest").alias("payload_digest"),
        "record_type",
        "refers_to",
        "url",
    )


def archive_round_trip(pages, folder=None):
    """Write all rows as records, read every archive back, and return one row per page."""
    folder = folder or new_table_path(pages.sparkSession, "warc")
    index = write_archives(pages, folder)
    records = stored(read_records(index, folder).drop("payload"), "warc-records")
    return resolved(records)
