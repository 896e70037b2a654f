"""WARC archives in seekable Zstandard bundles.

Writing: each task groups its records into frames of about ``FRAME_BYTES``, compresses
every frame by itself, and appends them to bundle files of about ``BUNDLE_BYTES`` in a
shared folder. A bundle ends with a seek table in a skippable frame (the Zstandard
seekable format), so any Zstandard tool reads a bundle from front to back, and a reader
with the table reads one frame alone. The task returns an index row per record: bundle,
frame, and offset and length within the decompressed frame. Spark commits the index of
one attempt of each task; file names are unique to an attempt, so the index never names a
file of an attempt that failed, and such files are merely left over.

Equal payloads: digests are counted first (on the map side, so a group of copies is a
row per task). Of records with an equal digest, those with the largest page_id are
responses, the others revisit it. A revisit stores the headers of the payload, its
digest and length, but not the payload.

Reading: index rows are grouped by frame; each task opens a bundle, reads its seek table
and its frame, and parses the records at their offsets. Digests of stored payloads are
computed anew and must equal the header's.

Defined cases: null html is an empty payload; payloads below ``min_bytes`` are never
revisits; records without a page_id revisit the largest page_id of their payload if any,
else are responses; repeated rows of the largest page_id are all responses; a null url
leaves its header out. Empty tables give empty results. Extra columns are ignored."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import chunks, filesystem, over_batches, scratch, written

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 64 << 20
LEVEL = 3
DATE = "2020-01-01T00:00:00Z"      # the pages carry no date, and a rerun writes the same bytes

# Fixed values of the seekable format.
_SKIPPABLE = 0x184D2A5E
_SEEKABLE = 0x8F92EAB1


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ------------------------------------------------------------ records
def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None,
           is_revisit: bool) -> bytes:
    """One WARC/1.1 record; ids are urn:page:<page_id>, none for null."""
    name = lambda i: f"<urn:page:{'none' if i is None else i}>"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if not is_revisit:
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}",
            f"WARC-Date: {DATE}", "Content-Type: application/http; msgtype=response",
            f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="%/:=&?~#+!$,;'@()*[]"))
    if is_revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {name(refers_to)}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _page(urn: str) -> int | None:
    tail = urn.strip("<>").rsplit(":", 1)[1]
    return None if tail == "none" else int(tail)


def parse(raw: bytes) -> dict:
    """Fields of one record. A response's digest is taken from its bytes and checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    h = dict(x.split(": ", 1) for x in lines)
    block = rest[:int(h["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    told = h["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
    if h["WARC-Type"] == "response" and (digest(payload) != told or len(payload) != size):
        raise ValueError(f"payload of {h['WARC-Record-ID']} does not fit its header")
    return {"page_id": _page(h["WARC-Record-ID"]), "url": h.get("WARC-Target-URI"),
            "record_type": h["WARC-Type"], "payload_bytes": size, "payload_digest": told,
            "refers_to": _page(h["WARC-Refers-To"]) if "WARC-Refers-To" in h else None,
            "payload": payload if h["WARC-Type"] == "response" else None}


# ------------------------------------------------------------ bundles
class BundleWriter:
    """Independent frames and a footer seek table."""

    def __init__(self, out):
        self.out, self.frames = out, []
        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
        self.size = 0

    def frame(self, raw: bytes) -> int:
        packed = self.packer.compress(raw)
        self.out.write(packed)
        self.frames.append((len(packed), len(raw)))
        self.size += len(packed)
        return len(self.frames) - 1

    def close(self) -> None:
        table = b"".join(struct.pack("<II", *f) for f in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, _SEEKABLE)
        self.out.write(struct.pack("<II", _SKIPPABLE, len(table) + len(footer)) + table + footer)
        self.out.close()


class BundleReader:
    """Reads single frames through the seek table."""

    def __init__(self, source, size: int):
        self.source = source
        source.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != _SEEKABLE:
            raise ValueError("no seek table")
        entry = 12 if flags & 0x80 else 8
        source.seek(size - 9 - n * entry)
        table = source.read(n * entry)
        self.sizes = [struct.unpack_from("<II", table, i * entry) for i in range(n)]
        self.starts = [0]
        for packed, _ in self.sizes:
            self.starts.append(self.starts[-1] + packed)

    def frame(self, k: int) -> bytes:
        self.source.seek(self.starts[k])
        return zstandard.ZstdDecompressor().decompress(self.source.read(self.sizes[k][0]),
                                                       max_output_size=max(1, self.sizes[k][1]))


_INDEX = "page_id long, bundle string, frame long, offset long, length long"


def classified(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, is_revisit, refers_to). Only digests that occur twice are joined,
    so without copies nothing meets; a hot digest is split by the skew join."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    again = (rows.where(F.octet_length("html") >= min_bytes).groupBy("sha")
             .agg(F.count("*").alias("n"), F.max("page_id").alias("largest"))
             .where("n > 1 AND largest IS NOT NULL").select("sha", "largest"))
    is_revisit = F.col("largest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("largest"))
    return rows.join(again, "sha", "left").select(
        "page_id", "url", "html", is_revisit.alias("is_revisit"),
        F.when(is_revisit, F.col("largest")).alias("refers_to"))


def write(pages: DataFrame, folder: str, min_bytes: int = 0, frame_bytes: int = FRAME_BYTES,
          bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Writes the bundles under ``folder`` and returns their index, itself written."""
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)

    def run(batches):
        store, base = filesystem(folder)
        bundle, name, raw, held = None, "", [], []

        def end_frame():
            nonlocal raw, held
            k = bundle.frame(b"".join(raw))
            rows, raw, held = [(i, name, k, o, n) for i, o, n in held], [], []
            ids, names, frames, offsets, lengths = zip(*rows)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(names, pa.string()), pa.array(frames, pa.int64()),
                 pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())],
                ["page_id", "bundle", "frame", "offset", "length"])
        size = 0
        for b in chunks(batches):
            cols = (b.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to", "is_revisit"))
            for i, url, html, refers, revisit in zip(*cols):
                if bundle is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    bundle = BundleWriter(store.open_output_stream(f"{base}/{name}", compression=None))
                r = record(i, url, html.encode("utf-8", "surrogatepass"), refers, revisit)
                held.append((i, size, len(r)))
                raw.append(r)
                size += len(r)
                if size >= frame_bytes:
                    yield end_frame()
                    size = 0
                    if bundle.size >= bundle_bytes:
                        bundle.close()
                        bundle = None
        if held:
            yield end_frame()
        if bundle is not None:
            bundle.close()
    return written(over_batches(classified(pages, min_bytes), run, _INDEX), "warc-index")


def read(index: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """One row per index row: what the record in the archive says. A frame's rows are
    bounded by the frame's size."""
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "bundle", "frame", "offset"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    schema = ("page_id long, url string, record_type string, payload_bytes long, payload_digest string, "
              "refers_to long, bundle string, frame long, offset long")
    if payloads:
        names, kinds, schema = [*names, "payload"], [*kinds, pa.binary()], schema + ", payload binary"
    kinds = pa.schema(list(zip(names, kinds)))

    def run(batches):
        store, base = filesystem(folder)
        for b in batches:
            for row in b.to_pylist():
                path = f"{base}/{row['bundle']}"
                with store.open_input_file(path) as f:
                    frame = BundleReader(f, f.size()).frame(row["frame"])
                out = [parse(frame[r["offset"]:r["offset"] + r["length"]])
                       | {"bundle": row["bundle"], "frame": row["frame"], "offset": r["offset"]} for r in row["records"]]
                yield pa.RecordBatch.from_pylist([{n: r[n] for n in names} for r in out], schema=kinds)
    frames = index.groupBy("bundle", "frame").agg(
        F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("records"))
    return over_batches(frames, run, schema)


def lookup(index: DataFrame, folder: str, ids: DataFrame) -> DataFrame:
    """The records of the page_ids in ``ids``, with their payload (a revisit's is null; its
    refers_to names the record that has it)."""
    return read(index.join(ids.select("page_id").distinct(), "page_id", "left_semi"), folder, payloads=True)


def archive(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, bundle, frame, offset):
    writes all pages and reads them back."""
    folder = folder or scratch(pages.sparkSession, "warc")
    return read(write(pages, folder, **options), folder).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "bundle", "frame", "offset")
