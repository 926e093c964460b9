"""WARC records in seekable Zstandard bundles.

A task writes its records into bundles: records are grouped into frames that
can be decompressed alone, and a seek table in a skippable frame at the end
(the public "seekable format") gives every frame's sizes. An index table maps
each record to its bundle, its frame, and its place in the frame, so a reader
takes single records, or ranges of frames, without the rest of a bundle.

Of records with equal payloads one is a response and the others revisit it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialise, new_path

#: Bytes of records in a frame and in a bundle, before compression, about; frames that one read takes.
FRAME, BUNDLE, READ_FRAMES = 1 << 20, 1 << 28, 16
LEVEL = 3
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, bundle string, frame int, offset int, length int"


def record_name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record. A revisit has the response's HTTP header, with the payload's length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_name(page_id)}",
            "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += [f"WARC-Refers-To: {record_name(refers_to)}", f"WARC-Profile: {_PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int) -> tuple[dict[str, str], bytes, bytes, int]:
    """The record at a place: its header, HTTP header, payload, and where the next one begins."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no record at {at}")
    head = dict(x.split(": ", 1) for x in lines[1:])
    block = data[end + 4:end + 4 + int(head["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    stop = end + 4 + len(block)
    if data[stop:stop + 4] != b"\r\n\r\n":
        raise ValueError(f"the record at {at} has no end")
    return head, http, payload, stop + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The skippable frame with (compressed, decompressed) sizes."""
    body = b"".join(struct.pack("<II", *x) for x in frames) + struct.pack("<IBI", len(frames), 0, _SEEKABLE)
    return struct.pack("<II", _SKIPPABLE, len(body)) + body


class Bundle:
    """Reader of a bundle: any frame by its number."""

    def __init__(self, source: pa.NativeFile):
        self.source, size = source, source.size()
        count, _, magic = struct.unpack("<IBI", source.read_at(9, size - 9))
        if magic != _SEEKABLE:
            raise ValueError("no seek table")
        table = source.read_at(8 * count, size - 9 - 8 * count)
        self.frames, at = [], 0
        for packed, plain in struct.iter_unpack("<II", table):
            self.frames.append((at, packed, plain))
            at += packed

    def frame(self, k: int) -> bytes:
        at, packed, plain = self.frames[k]
        return zstandard.ZstdDecompressor().decompress(self.source.read_at(packed, at), max_output_size=plain)


def _writer(path: str):
    names = ["page_id", "bundle", "frame", "offset", "length"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pa.fs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        packer = zstandard.ZstdCompressor(level=LEVEL)
        sink, name, frames, plain, buf, rows = None, None, [], 0, [], []

        def flush() -> pa.RecordBatch | None:
            nonlocal plain, buf, rows
            if not buf:
                return None
            data = b"".join(buf)
            packed = packer.compress(data)
            sink.write(packed)
            frames.append((len(packed), len(data)))
            plain += len(data)
            out = pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([name] * len(rows), pa.string()),
                                   pa.array([len(frames) - 1] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
                                   pa.array([r[2] for r in rows], pa.int32())], names=names)
            buf, rows = [], []
            return out

        size = 0
        for batch in batches:
            for page, url, payload, refers, revisit in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "payload", "refers_to", "revisit"))):
                if sink is None:    # a name of its own for each attempt: only what a finished task returns is read
                    name = f"{root}/{uuid.uuid4().hex}.warc.zst"
                    sink, frames, plain, size = fs.open_output_stream(name, compression=None), [], 0, 0
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                data = record(page, url, payload, digest, refers, revisit)
                rows.append((page, size, len(data)))
                buf.append(data)
                size += len(data)
                if size >= FRAME:
                    yield flush()
                    size = 0
                    if plain >= BUNDLE:
                        sink.write(seek_table(frames))
                        sink.close()
                        sink = None
        if sink is not None:
            last = flush()
            if last is not None:
                yield last
            sink.write(seek_table(frames))
            sink.close()
    return run


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write a record for each row into bundles under ``path``; returns the index (``INDEX``).

    The payload is the body in UTF-8, null being empty. Among rows with equal
    payloads of at least ``min_bytes`` bytes the largest id is the response and the
    rest are revisits; smaller payloads, and the rows that repeat the largest id,
    are all responses. A null id is below all others. Null URLs have no header.
    """
    body = F.coalesce(F.col(body_col), F.lit("")).cast("binary")
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), body.alias("payload"))
    same = F.concat(F.sha1("payload"), F.sha2("payload", 256))
    # only payloads that come again are joined; few of them, and the join needs no shuffle of the pages
    again = materialise(src.where(F.octet_length("payload") >= min_bytes).groupBy(same.alias("same"))
                        .agg(F.count("*").alias("n"), F.max("page_id").alias("response")).where("n > 1").select("same", "response"), "payloads")
    src = src.join(again, same == again["same"], "left")
    revisit = again["response"].isNotNull() & ~again["response"].eqNullSafe(F.col("page_id"))
    src = src.select("page_id", "url", "payload", F.when(revisit, F.col("response")).alias("refers_to"), revisit.alias("revisit"))
    return materialise(src.mapInArrow(_writer(path), INDEX), "warc-index")


def _number(urn: str | None) -> int | None:
    n = urn[len("<urn:page:"):-1] if urn else ""
    return int(n) if n else None


def _reader(root: str, payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pa.fs.FileSystem.from_uri(root)
        for batch in batches:
            for name, first, stop in zip(*(batch[c].to_pylist() for c in ("bundle", "first", "stop"))):
                with fs.open_input_file(name) as f:
                    bundle = Bundle(f)
                    for k in range(first, min(stop, len(bundle.frames))):
                        data, at, rows = bundle.frame(k), 0, []
                        while at < len(data):
                            head, http, payload, at = parse(data, at)
                            digest, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
                            size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
                            if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                                raise ValueError(f"{head['WARC-Record-ID']} in {name} is damaged")
                            rows.append((_number(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), kind, size, digest,
                                         _number(head.get("WARC-Refers-To")), payload if payloads and kind == "response" else None))
                        yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(
                            (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()))],
                            names=["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"])
    return run


def read(index: DataFrame, path: str, payloads: bool = True) -> DataFrame:
    """All records of the bundles that ``index`` names, read frame by frame and checked against their digests.

    page_id, url, record_type, payload_bytes, payload_digest (bare base32
    SHA-1), refers_to, payload (null for revisits, and unless asked for).
    """
    last = index.groupBy("bundle").agg(F.max("frame").alias("last"))
    units = materialise(last.select("bundle", F.explode(F.sequence(F.lit(0), F.col("last"), F.lit(READ_FRAMES))).alias("first"))
                        .withColumn("stop", F.col("first") + READ_FRAMES), "warc-reads")
    n = units.count()
    spread = units.repartition(max(1, min(n, 20_000)))
    return spread.mapInArrow(_reader(path, payloads), "page_id long, url string, record_type string, payload_bytes long, "
                             "payload_digest string, refers_to long, payload binary")


def fetch(wanted: DataFrame, path: str) -> DataFrame:
    """Single records by their index rows: page_id, record (bytes). Only their frames are read."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pa.fs.FileSystem.from_uri(path)
        for batch in batches:
            out = []
            for name, frame, offset, length in zip(*(batch[c].to_pylist() for c in ("bundle", "frame", "offset", "length"))):
                with fs.open_input_file(name) as f:
                    out.append(Bundle(f).frame(frame)[offset:offset + length])
            yield pa.record_batch([batch["page_id"], pa.array(out, pa.binary())], names=["page_id", "record"])
    return wanted.mapInArrow(run, "page_id long, record binary")


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` into bundles in the work folder and read them back, without payloads."""
    path = new_path(pages.sparkSession, "bundles")
    return read(write(pages, path, min_bytes=min_bytes), path, payloads=False).drop("payload")
