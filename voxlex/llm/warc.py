"""WARC archives whose records are compressed one by one with a dictionary.

Each task that writes builds a Zstandard dictionary from its own first
records (``sample_bytes`` of them at most, a documented bound; every record
is compressed with it), embeds it in a leading skippable frame, and writes
each record as a frame of its own, so that a record can be read alone once the
dictionary is known.  Reading goes through the archives only.

Records with equal payloads (SHA-1 and length) of at least ``revisit_bytes``
bytes: the one with the largest page_id is a ``response``, the others are
``revisit`` records without payload that refer to it; smaller payloads are
all responses.  Rows that repeat the largest page_id itself are responses.
Null html is an empty payload, a null url an empty one; a null page_id is
never the largest.  An empty table writes no archive.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlex.llm.common import bound_arrow, open_fs, stage, workspace, write_file

#: Magic of the skippable frame that holds the dictionary (fixed value).
DICT_FRAME = 0x184D2A5D
WHEN = "2000-01-01T00:00:00Z"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def mark_revisits(pages: DataFrame, revisit_bytes: int) -> DataFrame:
    """Adds ``refers_to``: the response's page_id for revisits, else null.

    Digests are counted with a partial aggregate.  A digest with over a
    thousandth of all rows is joined from a broadcast table, which holds at
    most a thousand rows whatever the input; the others join by shuffle, so
    no key of that join is hot.
    """
    keyed = pages.withColumn("sha", F.sha1(F.encode("html", "utf-8"))).withColumn(
        "bytes", F.octet_length("html").cast("bigint"))
    reps = (keyed.where(F.col("bytes") >= revisit_bytes).groupBy("sha", "bytes")
            .agg(F.max("page_id").alias("rep"), F.count("*").alias("n")).where("n > 1 AND rep IS NOT NULL"))
    total = pages.count()
    hot = reps.where(F.col("n") * 1000 > total).select("sha", "bytes", F.col("rep").alias("hot_rep"))
    cold = reps.where(F.col("n") * 1000 <= total).select(F.col("sha").alias("cold_sha"), F.col("bytes").alias("cold_bytes"), "rep")
    return (keyed.join(F.broadcast(hot), ["sha", "bytes"], "left")
            .withColumn("key", F.when(F.col("hot_rep").isNull(), F.col("sha"))
                        .otherwise(F.concat(F.lit("~"), F.xxhash64("page_id", "url").cast("string"))))
            .join(cold, (F.col("key") == F.col("cold_sha")) & (F.col("bytes") == F.col("cold_bytes")), "left")
            .withColumn("to", F.coalesce("hot_rep", "rep"))
            .select("page_id", "url", "html",
                    F.when(~F.col("page_id").eqNullSafe(F.col("to")), F.col("to")).alias("refers_to")))


def _record(kind: str, page, url: str, payload: bytes, refers) -> bytes:
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    body = http if kind == "revisit" else http + payload
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{'' if page is None else page}>"),
            ("WARC-Date", WHEN), ("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")),
            ("WARC-Payload-Digest", "sha1:" + digest32(payload)),
            ("Content-Type", "application/http; msgtype=response")]
    if kind == "revisit":
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                 ("WARC-Refers-To", f"<urn:page:{refers}>")]
    head.append(("Content-Length", str(len(body))))
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() + body + b"\r\n\r\n"


def _dictionary(sample: list[bytes], size: int):
    import zstandard
    try:
        return zstandard.train_dictionary(size, sample)
    except zstandard.ZstdError:      # too few records to train on
        return zstandard.ZstdCompressionDict(b"".join(sample)[-size:] or b"\0" * 8,
                                             dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def write_archives(pages: DataFrame, folder: str, dict_bytes: int = 32_768,
                   sample_bytes: int = 1 << 20, archive_bytes: int = 64 << 20, level: int = 3) -> DataFrame:
    """Write ``pages(page_id, url, html, refers_to)``; returns the manifest
    (uri, bytes, records), one row per archive."""
    bound_arrow(pages.sparkSession)

    def write(batches):
        import zstandard
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        held, held_bytes, packer, lead = [], 0, None, b""
        out, size, n, seq = [], 0, 0, 0

        def begin():
            nonlocal packer, lead
            d = _dictionary(held, dict_bytes)
            packer = zstandard.ZstdCompressor(level=level, dict_data=d)
            raw = d.as_bytes()
            lead = struct.pack("<II", DICT_FRAME, len(raw)) + raw
            info = b"software: corpus archive writer\r\nformat: WARC File Format 1.1\r\n"
            lead += packer.compress(
                (f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:info:{part}>\r\nWARC-Date: {WHEN}\r\n"
                 f"Content-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n").encode() + info + b"\r\n\r\n")

        def put(rec):
            nonlocal size, n
            z = packer.compress(rec)
            out.append(z)
            size += len(z)
            n += 1

        def close():
            nonlocal out, size, n, seq
            uri = write_file(folder, f"pages-{part:06d}-{seq:05d}.warc.zst", [lead, *out])
            row = pa.RecordBatch.from_arrays(
                [pa.array([uri]), pa.array([size + len(lead)], pa.int64()), pa.array([n], pa.int64())],
                names=["uri", "bytes", "records"])
            out, size, n, seq = [], 0, 0, seq + 1
            return row

        for b in batches:
            for page, url, html, to in zip(*(c.to_pylist() for c in b.columns[:4])):
                rec = _record("response" if to is None else "revisit", page, url, html.encode(), to)
                if packer is None:
                    held.append(rec)
                    held_bytes += len(rec)
                    if held_bytes < sample_bytes:
                        continue
                    begin()
                    for r in held:
                        put(r)
                    held = []
                else:
                    put(rec)
                if size >= archive_bytes:
                    yield close()
        if held:
            begin()
            for r in held:
                put(r)
        if n:
            yield close()

    return pages.select("page_id", "url", "html", "refers_to").mapInArrow(
        write, "uri string, bytes bigint, records bigint")


def parse_archive(f):
    """(headers, block) of every record of an open archive."""
    import zstandard
    magic, n = struct.unpack("<II", f.read(8))
    if magic != DICT_FRAME:
        raise ValueError("no leading dictionary frame")
    d = zstandard.ZstdCompressionDict(f.read(n))
    with zstandard.ZstdDecompressor(dict_data=d).stream_reader(f, read_across_frames=True) as z:
        buf = b""

        def upto(mark: bytes) -> bytes:
            nonlocal buf
            at = buf.find(mark)
            while at < 0:
                more = z.read(1 << 16)
                if not more:
                    return b""
                buf += more
                at = buf.find(mark)
            got, buf = buf[:at], buf[at + len(mark):]
            return got

        while head := upto(b"\r\n\r\n"):
            lines = head.decode().split("\r\n")
            if lines[0] != "WARC/1.1":
                raise ValueError(f"not a record: {lines[0][:40]!r}")
            fields = dict(x.split(": ", 1) for x in lines[1:])
            need = int(fields["Content-Length"]) + 4
            if len(buf) < need:
                parts, have = [buf], len(buf)
                while have < need:
                    more = z.read(max(1 << 16, need - have))
                    if not more:
                        raise ValueError("archive ends inside a record")
                    parts.append(more)
                    have += len(more)
                buf = b"".join(parts)
            block, buf = buf[:need - 4], buf[need:]
            yield fields, block


def read_archives(manifest: DataFrame) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest,
    payload) of every record; the payload of a revisit is null, its length
    and digest are those of its headers.  A response whose payload does not
    have the digest of its header fails the read."""
    todo = manifest.select("uri").repartition(
        max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "uri")
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def page(s):
        s = s.removeprefix("<urn:page:").removesuffix(">")
        return int(s) if s else None

    def read(batches):
        for b in batches:
            for uri in b.column(0).to_pylist():
                rows = []
                fs, path = open_fs(uri)
                with fs.open_input_stream(path) as f:
                    for h, block in parse_archive(f):
                        if h["WARC-Type"] == "warcinfo":
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                        revisit = h["WARC-Type"] == "revisit"
                        if not revisit and digest32(payload) != digest:
                            raise ValueError(f"{uri}: payload of {h['WARC-Record-ID']} is damaged")
                        n = int(http.rpartition(b"Content-Length: ")[2])
                        rows.append((page(h["WARC-Record-ID"]), h["WARC-Target-URI"], h["WARC-Type"],
                                     page(h["WARC-Refers-To"]) if revisit else None, n, digest,
                                     None if revisit else payload))
                        if len(rows) == 256:
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return todo.mapInArrow(read, "page_id bigint, url string, record_type string, refers_to bigint, "
                                 "payload_bytes bigint, payload_digest string, payload binary")


def round_trip(pages: DataFrame, revisit_bytes: int = 0) -> DataFrame:
    """Write all pages to archives and read the archives back."""
    folder = workspace(pages.sparkSession, "warc")
    filled = pages.select(F.col("page_id").cast("bigint").alias("page_id"),
                          F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    manifest = stage(write_archives(mark_revisits(filled, revisit_bytes), folder), folder, "manifest")
    return read_archives(manifest)
