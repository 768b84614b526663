"""Media columns: content-addressed payloads in tar shards, read back by byte ranges.

A payload is stored losslessly as an 8-bit grey image, 192 samples a row, in PNG
(filter 0, zlib). Images go into plain tar files; a member's name is the SHA-256 of
its payload, so equal payloads are one member. Rows carry the digest and the shard,
offset and length of that member. Metadata columns come from reading the header bytes
alone, content by reading exactly the member's range.

A payload is stored once in all shards. A first pass finds the digests that more than one
row has. A task then writes the payloads that no other row has into a shard of its own,
unshuffled; of the repeated ones it passes on one copy each, and these are written by
digest. A filter of fixed size says which digests are repeated: if it is full, more payloads
than needed are passed on, and the result stays the same.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skriba.llm.shared import FILTER_BITS, id_filter, lean, probable, remove, store, work_dir
from skriba.llm.token_output import filesystem

WIDTH = 192
# Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER_BYTES = 33
#: zlib's level for the samples.
LEVEL = 6


def payload(text: str | None) -> bytes:
    """UTF-8 of a text (null: empty), filled with spaces to a positive multiple of WIDTH."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * (-len(raw) % WIDTH if raw else WIDTH)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(samples: bytes) -> bytes:
    """An 8-bit grey image whose rows are the payload, WIDTH samples each."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def read_header(head: bytes) -> dict:
    """Width, height, bit depth and colour type from an image's first HEADER_BYTES."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR" or struct.unpack(">I", head[29:33])[0] != zlib.crc32(head[12:29]):
        raise ValueError("not an image header")
    width, height, depth, colour = struct.unpack(">IIBB", head[16:26])
    return {"width": width, "height": height, "depth": depth, "colour": colour}


def from_png(image: bytes) -> bytes:
    """The samples of an image of to_png, its checksums held."""
    shape = read_header(image[:HEADER_BYTES])
    at, data = HEADER_BYTES, b""
    while at < len(image):
        size, kind = struct.unpack(">I4s", image[at : at + 8])
        body = image[at + 8 : at + 8 + size]
        if struct.unpack(">I", image[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + body):
            raise ValueError("a chunk does not match its checksum")
        data += body if kind == b"IDAT" else b""
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(shape["height"], shape["width"] + 1)
    if lines[:, 0].any():
        raise ValueError("a filter other than 0")
    return lines[:, 1:].tobytes()


def feature(samples: bytes) -> str:
    """Size in rows, mean, standard deviation and entropy of the samples, and the share
    of bytes over 127: what a filter on media columns looks at."""
    x = np.frombuffer(samples, np.uint8)
    counts = np.bincount(x, minlength=256)
    p = counts[counts > 0] / len(x)
    return f"h={len(x) // WIDTH};mean={x.mean():.4f};std={x.std():.4f};entropy={-(p * np.log2(p)).sum():.4f};high={counts[128:].sum() / len(x):.4f}"


class Shard:
    """A tar file in the making; `add` returns where the member's image begins, and its length."""

    def __init__(self, fs, base):
        import uuid

        self.name, self.at = f"media-{uuid.uuid4().hex}.tar", 0
        self.out = fs.open_output_stream(f"{base}/{self.name}", compression=None)

    def add(self, digest: bytes, samples: bytes) -> tuple[int, int]:
        import tarfile

        image = to_png(samples)
        info = tarfile.TarInfo(digest.hex() + ".png")
        info.size = len(image)
        head = info.tobuf(tarfile.PAX_FORMAT)
        self.out.write(head + image + b"\0" * (-len(image) % 512))
        offset = self.at + len(head)
        self.at = offset + len(image) + -len(image) % 512
        return offset, len(image)

    def close(self):
        self.out.write(b"\0" * 1024)
        self.out.close()


def repeated_digests(docs: DataFrame) -> DataFrame:
    """Digests of payloads that more than one row has."""

    def scan(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(payload(t)).digest() for t in batch.column(0).to_pylist()], pa.binary())], ["digest"])

    return docs.select("text").mapInArrow(lean(scan), "digest binary").groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")


PLACES = "digest binary, shard string, offset long, length long, doc_ids array<long>, sizes array<long>, content binary"


def store_media(docs: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Write the tar shards; returns the members (digest, shard, offset, length), one a digest,
    and the rows (digest, doc_ids, sizes), for every task and digest one at most.

    Tasks stream: beside the repeated digests that it has met, a task holds one batch. A
    repeated task writes another file; the stored result names the one that counted."""
    spark = docs.sparkSession
    repeated = store(repeated_digests(docs), folder, "repeated")
    # A digest's own bits are its slot, in the filter as in the tasks.
    slot = F.pmod(F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long"), F.lit(FILTER_BITS))
    bits = spark.sparkContext.broadcast(id_filter(repeated, "digest", slot))

    def rows_of(found):
        import pyarrow as pa

        for k in range(0, len(found), 20_000):
            part = found[k : k + 20_000]
            types = [pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), types)], names)

    def write(batches):
        fs, base = filesystem(folder)
        shard, met = None, {}
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                samples = payload(text)
                key, size = hashlib.sha256(samples).digest(), len((text or "").encode("utf-8", "surrogatepass"))
                if probable(np.array([int.from_bytes(key[:7], "big") % FILTER_BITS]), bits.value)[0]:
                    if key not in met:
                        met[key] = [], []
                        out.append((key, None, None, None, [], [], samples))
                    met[key][0].append(doc_id)
                    met[key][1].append(size)
                else:
                    shard = shard or Shard(fs, base)
                    out.append((key, shard.name, *shard.add(key, samples), [doc_id], [size], None))
            yield from rows_of(out)
        if shard:
            shard.close()
        yield from rows_of([(key, None, None, None, ids, sizes, None) for key, (ids, sizes) in met.items()])

    def write_repeated(batches):
        fs, base = filesystem(folder)
        shard = None
        for batch in batches:
            out = []
            for key, samples in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = shard or Shard(fs, base)
                out.append((key, shard.name, *shard.add(key, samples), [], [], None))
            yield from rows_of(out)
        if shard:
            shard.close()

    names = [c.strip().split()[0] for c in PLACES.split(",")]
    fs, base = filesystem(folder)
    fs.create_dir(base, recursive=True)
    places = store(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(write), PLACES), folder, "places")
    passed = places.where("content IS NOT NULL").groupBy("digest").agg(F.first("content").alias("content"))
    more = store(passed.mapInArrow(lean(write_repeated), PLACES), folder, "more-places")
    remove(spark, f"{folder}/repeated")
    members = places.where("shard IS NOT NULL").union(more).select("digest", "shard", "offset", "length")
    return members, places.where(F.size("doc_ids") > 0).select("digest", "doc_ids", "sizes")


def header_at(handle, offset: int) -> dict:
    """Metadata of the member whose image begins at `offset`: a range read of its header alone."""
    handle.seek(offset)
    return read_header(handle.read(HEADER_BYTES))


def read_headers(found: DataFrame, folder: str) -> DataFrame:
    """Metadata columns of (digest, shard, offset): reads HEADER_BYTES of each member."""

    def read(batches):
        import pyarrow as pa

        fs, base = filesystem(folder)
        name, handle = None, None
        for batch in batches:
            out = []
            for digest, shard, offset in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if shard != name:
                    name, handle = shard, fs.open_input_file(f"{base}/{shard}")
                h = header_at(handle, offset)
                out.append((digest, h["width"], h["height"], h["depth"]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.binary(), pa.int32(), pa.int32(), pa.int32()])], ["digest", "width", "height", "depth"])

    by_shard = found.select("digest", "shard", "offset").repartition("shard", F.floor(F.col("offset") / F.lit(1 << 24))).sortWithinPartitions("shard", "offset")
    return by_shard.mapInArrow(lean(read), "digest binary, width int, height int, depth int")


def read_media(found: DataFrame, folder: str) -> DataFrame:
    """Metadata columns from each member's header alone; then its range is read back, the
    payload held against its digest and its columns computed: one row per digest."""
    schema = "digest binary, shard string, offset long, length long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int, depth int"

    def read(batches):
        import pyarrow as pa

        fs, base = filesystem(folder)
        name, handle = None, None
        for batch in batches:
            out = []
            for digest, shard, offset, length in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if shard != name:
                    name, handle = shard, fs.open_input_file(f"{base}/{shard}")
                head = header_at(handle, offset)
                handle.seek(offset)
                image = handle.read(length)
                samples = from_png(image)
                sha = hashlib.sha256(samples)
                if sha.digest() != digest:
                    raise ValueError(f"{shard}:{offset} does not hold its digest's content")
                out.append((digest, shard, offset, length, len(samples), sha.hexdigest(), zlib.crc32(samples[-16:]), len(image), hashlib.sha256(image).hexdigest(), feature(samples), head["width"], head["height"], head["depth"]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    import pyarrow as pa

    types = [pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
    names = [c.strip().split()[0] for c in schema.split(",")]
    return found.select("digest", "shard", "offset", "length").repartition("shard", F.floor(F.col("offset") / F.lit(1 << 24))).sortWithinPartitions("shard", "offset").mapInArrow(lean(read), schema)


def media_table(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes, payload_bytes, payload_sha256,
    tail_crc32, media_bytes, media_sha256, feature, shard, offset and length of the stored
    form, and its metadata columns width, height and depth, from reads of its header alone.

    Null and empty texts are one row of spaces. Equal payloads have equal values and the
    same place. Repeated rows give repeated results, a null doc_id is returned as
    null, very long texts are one image, extra columns are ignored, an empty table gives an
    empty result."""
    folder = work_dir(docs.sparkSession, "media")
    members, rows = store_media(docs, folder)
    read = store(read_media(members, folder), folder, "read")
    remove(docs.sparkSession)
    # A digest comes once a task here, however many rows have it; they spread behind the join.
    each = rows.join(read, "digest").withColumn("row", F.explode(F.arrays_zip("doc_ids", "sizes")))
    return each.select(F.col("row.doc_ids").alias("doc_id"), F.col("row.sizes").alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "shard", "offset", "length", "width", "height", "depth")


__all__ = ["Shard", "feature", "from_png", "header_at", "media_table", "payload", "read_header", "read_headers", "read_media", "repeated_digests", "store_media", "to_png"]
