"""WARC bundles in the seekable Zstandard format, written and read in parallel.

A bundle is a file of independent Zstandard frames, each holding whole WARC records, and ends with a seek table in a
skippable frame (compressed and plain size per frame, number of frames, magic number), so plain zstd tools read
it too. The index maps every record id to its bundle, frame, and offset inside the frame; a reader fetches the seek
table and then only the frames it needs.

Every task writes bundles under names of its own attempt and moves them in place when they are complete; the index
names only bundles of finished tasks, so a lost executor leaves at most files that nothing points to. Files are
opened through pyarrow.fs, so the folder may be any store that it knows and all executors share.

Null html is an empty payload, a null url has no WARC-Target-URI. Rows that share page_id and payload are all
responses if their page_id is the largest of the payload.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lutrin.llm.common import written
from lutrin.session import shared_folder

#: Fixed values of the seekable format and of the WARC standard.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 256 << 20
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
INDEX = "page_id long, record_id string, bundle string, frame long, offset long, length long"
RECORD = ("page_id long, record_id string, record_type string, refers_to string, url string, payload binary, "
          "payload_bytes long, payload_digest string")


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'page {page_id} {digest}')}>"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> tuple[str, bytes]:
    """Id and bytes of a response, or of a revisit of the response of page `refers_to`."""
    digest = digest_of(payload)
    own = record_id(page_id, digest)
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (b"" if revisit else payload)
    named = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", own), ("WARC-Date", date)]
    if page_id is not None:
        named.append(("X-Page-ID", str(page_id)))
    if url is not None:
        named.append(("WARC-Target-URI", "".join(f"%{ord(c):02X}" if ord(c) < 33 or ord(c) == 127 else c for c in url)))
    if revisit:
        named += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page", str(refers_to))]
    named += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response"),
              ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in named) + "\r\n"
    return own, head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    entries = b"".join(struct.pack("<II", *f) for f in frames)
    footer = struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer


class BundleWriter:
    """One bundle: records are gathered into frames; `close` ends it with the seek table and moves it in place."""

    def __init__(self, folder: str, frame_bytes: int):
        self.path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        self.store, self.place = _store(self.path)
        self.store.create_dir(self.place.rsplit("/", 1)[0], recursive=True)
        self.stream = self.store.open_output_stream(self.place + ".part")
        self.frame_bytes, self.frames, self.buffer, self.size = frame_bytes, [], bytearray(), 0
        self.zstd = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)

    def add(self, data: bytes) -> tuple[int, int]:
        at = (len(self.frames), len(self.buffer))
        self.buffer += data
        if len(self.buffer) >= self.frame_bytes:
            self.flush()
        return at

    def flush(self) -> None:
        if self.buffer:
            frame = self.zstd.compress(bytes(self.buffer))
            self.stream.write(frame)
            self.frames.append((len(frame), len(self.buffer)))
            self.size += len(frame)
            self.buffer = bytearray()

    def close(self) -> None:
        self.flush()
        self.stream.write(seek_table(self.frames))
        self.stream.close()
        self.store.move(self.place + ".part", self.place)


class BundleReader:
    """Random access to the frames of one bundle by its seek table."""

    def __init__(self, path: str):
        store, place = _store(path)
        self.file = store.open_input_file(place)
        end = self.file.size()
        count, _, magic = struct.unpack("<IBI", self.file.read_at(9, end - 9))
        if magic != SEEKABLE:
            raise ValueError(f"{path} has no seek table")
        raw = self.file.read_at(8 * count, end - 9 - 8 * count)
        self.sizes = list(struct.iter_unpack("<II", raw))
        self.starts = [0]
        for packed, _ in self.sizes:
            self.starts.append(self.starts[-1] + packed)
        self.number, self.frame = -1, b""

    def read(self, frame: int, offset: int, length: int) -> bytes:
        if frame != self.number:
            data = self.file.read_at(self.sizes[frame][0], self.starts[frame])
            self.frame, self.number = zstandard.ZstdDecompressor().decompress(data, max_output_size=self.sizes[frame][1]), frame
        return self.frame[offset:offset + length]

    def close(self) -> None:
        self.file.close()


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Named fields and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    named = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[:int(named["Content-Length"])]
    return named, block.partition(b"\r\n\r\n")[2]


def with_originals(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, html; other columns go) with `refers_to`: the largest page_id with an equal payload, null for that page itself.

    Only pages whose payload occurs more than once are looked up; payloads below `least_bytes` refer to nothing.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", "html", F.sha2(payload, 256).alias("_key"), F.octet_length(payload).alias("_size"))
    most = (rows.filter(F.col("_size") >= least_bytes).groupBy("_key").agg(F.max("page_id").alias("_last"), F.count("*").alias("_n"))
            .filter("_n > 1").drop("_n"))
    other = F.col("_last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_last"))
    return rows.join(most, "_key", "left").withColumn("refers_to", F.when(other, F.col("_last"))).select("page_id", "url", "html", "refers_to")


def write(pages: DataFrame, folder: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Writes pages (page_id, url, html, refers_to) to bundles in `folder`; returns the index as a written table."""

    def bundled(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bundle = None
        for pdf in pdfs:
            out = []
            for page_id, url, html, refers in zip(pdf["page_id"], pdf["url"], pdf["html"], pdf["refers_to"], strict=True):
                page_id, refers = (None if pd.isna(x) else int(x) for x in (page_id, refers))
                own, data = record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), refers)
                if bundle and bundle.size >= bundle_bytes:
                    bundle.close()
                    bundle = None
                bundle = bundle or BundleWriter(folder, frame_bytes)
                out.append((page_id, own, bundle.path, *bundle.add(data), len(data)))
            made = pd.DataFrame(out, columns=["page_id", "record_id", "bundle", "frame", "offset", "length"])
            yield made.astype({"page_id": "Int64"})
        if bundle:
            bundle.close()

    whole = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "html", F.col("refers_to").cast("string").alias("refers_to"))
    return written(whole.mapInPandas(bundled, INDEX))


def read(index: DataFrame) -> DataFrame:
    """The records that the index rows name, read from their frames; a revisit has an empty payload."""

    def fetched(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, path = None, None
        for pdf in pdfs:
            out = []
            for bundle, frame, offset, length in zip(pdf["bundle"], pdf["frame"], pdf["offset"], pdf["length"], strict=True):
                if bundle != path:
                    if reader:
                        reader.close()
                    reader, path = BundleReader(bundle), bundle
                named, payload = parsed(reader.read(frame, offset, length))
                page = named.get("X-Page-ID")
                head = named["WARC-Type"]
                size, digest = len(payload), digest_of(payload)
                if head == "revisit":
                    size, digest = None, named["WARC-Payload-Digest"].removeprefix("sha1:")
                out.append((int(page) if page else None, named["WARC-Record-ID"], head, named.get("WARC-Refers-To"),
                            named.get("WARC-Target-URI"), payload, size, digest))
            made = pd.DataFrame(out, columns=[x.split()[0] for x in RECORD.split(", ")])
            yield made.astype({"page_id": "Int64", "payload_bytes": "Int64"})
        if reader:
            reader.close()

    near = index.repartition("bundle").sortWithinPartitions("bundle", "frame", "offset")
    return near.mapInPandas(fetched, RECORD)


def resolved(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): revisits take the size of their response."""
    light = written(records.select("page_id", "record_id", "record_type", "refers_to", "payload_bytes", "payload_digest"))
    named = light.filter("record_type = 'revisit'").select(F.col("refers_to").alias("record_id")).distinct()
    first = (light.filter("record_type = 'response'").join(named, "record_id", "left_semi")
             .groupBy(F.col("record_id").alias("refers_to")).agg(F.max("page_id").alias("_page"), F.max("payload_bytes").alias("_bytes")))
    return light.join(first, "refers_to", "left").select(
        "page_id", F.coalesce("payload_bytes", "_bytes").alias("payload_bytes"), "payload_digest", "record_type",
        F.col("_page").alias("refers_to"))


def archive_folder(spark) -> str:
    return f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
