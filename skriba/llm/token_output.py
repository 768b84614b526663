"""Token ids as seekable shards: one zstandard frame a document, a seek table at the end.

A shard is a file in the public seekable zstandard format:

    frame ... frame | skippable frame 0x184D2A5D | skippable frame 0x184D2A5E

The last skippable frame is the seek table: for every frame its compressed size,
its size and the low 32 bits of the xxh64 checksum of its content, then the number
of frames, a descriptor byte (0x80: with checksums) and the magic 0x8F92EAB1. The
one before it lists the frames' document ids (int64), and two bitmaps behind them: frames
that go on with the document of the frame before, and documents without an id. Any reader of
the seekable format can read a shard; ours fetches the tail and then single documents.

Ids are little-endian unsigned 32-bit integers.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skriba.llm.shared import batch_rows, lean, store, work_dir, worker_cache

# Fixed values of the seekable zstandard format.
SEEK_MAGIC, SKIP_SEEK, SKIP_IDS = 0x8F92EAB1, 0x184D2A5E, 0x184D2A5D
CHECKSUMS = 0x80
#: Bytes of ids in one frame at most; a longer document goes on in the next frame.
FRAME_BYTES = 1 << 26
#: Bytes of text that one shard aims at; rows sampled for each shard's cut, and in all.
SHARD_BYTES, CUT_SAMPLE, MOST_SAMPLED = 1 << 25, 100, 1_000_000
#: Entries of a worker's chunk cache; when it is full, it keeps those met again since it was
#: this full. A dictionary doubles its room at 699,050 entries.
CACHE_CHUNKS, NEARLY_FULL = 690_000, 500_000
#: Entries that stay in a worker between tasks.
KEPT_CHUNKS = 87_000
#: Rows that an encoding worker gets at once.
BATCH_ROWS = 500
#: Sentence punctuation, which ends chunks.
PUNCTUATION = ".,;:!?"
_SET_OFF = re.compile(r"([.,;:!?](?<=[^\W\d_].)[.,;:!?]*)(?=[ \n]|$)")


def filesystem(uri: str):
    """pyarrow's file system for a URI of the shared store, and the path on it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1) if uri.startswith("file:") else f"file://{uri}")


class ChunkEncoder:
    """Encodes texts chunk by chunk, keeping the ids of chunks seen before.

    The vocabulary's normaliser and pre-tokenizer never join characters across a
    space or a line feed, so ids of a text are those of its chunks in a row; and they
    part letters from the punctuation behind them and fold case, so the ids of "Word," are
    those of "word" and of ",". A text that holds a special token's string is encoded as a whole."""

    def __init__(self, path: str):
        import os

        # Spark's tasks are the threads; a pool in each would stand in the others' way.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        # A worker process runs many tasks: they share the vocabulary and what they have learned.
        kept = worker_cache("chunks")
        if path not in kept:
            tokenizer = Tokenizer.from_file(path)
            kept[path] = tokenizer, [t.content for t in tokenizer.get_added_tokens_decoder().values()], {"": b""}, set()
        self.tokenizer, self.special, self.cache, self.again = kept[path]

    @staticmethod
    def simplify(text: str) -> str:
        """The text in lower case with its sentence punctuation set off, if all of it is
        Latin-1, where that is certain to leave the ids as they are."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
        return _SET_OFF.sub(r" \1", text.lower())

    def learn(self, chunks) -> None:
        """Bring chunks into the cache; lines of many cost far less than calls for each,
        and the offsets tell whose the ids are."""
        new = list(chunks)
        lines = [new[k : k + 512] for k in range(0, len(new), 512)]
        for line, e in zip(lines, self.tokenizer.encode_batch([" ".join(x) for x in lines], add_special_tokens=False)):
            starts = np.cumsum([0] + [len(c) + 1 for c in line])
            cuts = (np.searchsorted([o[0] for o in e.offsets], starts) * 4).tolist()
            ids = array("I", e.ids).tobytes()
            self.cache.update(zip(line, [ids[x:y] for x, y in zip(cuts, cuts[1:])]))

    def settle(self) -> None:
        """At a task's end: keep the chunks met first, which the frequent ones are among. More workers
        live than run, since they take turns; a full cache in each would add up."""
        stay = dict(islice(self.cache.items(), KEPT_CHUNKS))
        self.cache.clear()
        self.again.clear()
        self.cache.update(stay)
        self.cache[""] = b""

    def encode_all(self, texts) -> list[bytes]:
        """Ids of every text (null: none)."""
        out: list = [b""] * len(texts)
        split = []
        for k, text in enumerate(texts):
            if not text:
                continue
            if "<" in text and any(s in text for s in self.special):
                out[k] = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
            else:
                split.append((k, self.simplify(text).replace("\n", " ").split(" ")))
        met = set().union(*(chunks for _, chunks in split))
        new = met.difference(self.cache)
        if len(self.cache) > NEARLY_FULL:
            self.again |= met - new
        if len(self.cache) + len(new) > CACHE_CHUNKS:
            stay = {c: ids for c, ids in self.cache.items() if c in self.again}
            self.again.clear()
            self.cache.clear()
            self.cache.update(stay if len(stay) <= CACHE_CHUNKS // 2 else {})
            self.cache[""] = b""
            new = met.difference(self.cache)
        self.learn(new)
        find = self.cache.__getitem__
        for k, chunks in split:
            out[k] = b"".join(map(find, chunks))
        return out


def write_shard(out, frames) -> list[tuple]:
    """Write (doc_id, goes_on, compressed frame, size, checksum) rows; returns nothing
    but the file: the caller keeps the counts."""
    ids, goes_on, unnamed, table = [], [], [], []
    for doc_id, more, frame, size, check in frames:
        out.write(frame)
        ids.append(doc_id or 0)
        goes_on.append(more)
        unnamed.append(doc_id is None)
        table.append(struct.pack("<III", len(frame), size, check))
    named = np.asarray(ids, "<i8").tobytes() + b"".join(np.packbits(np.asarray(x, bool), bitorder="little").tobytes() for x in (goes_on, unnamed))
    out.write(struct.pack("<II", SKIP_IDS, len(named)) + named)
    seek = b"".join(table) + struct.pack("<IBI", len(table), CHECKSUMS, SEEK_MAGIC)
    out.write(struct.pack("<II", SKIP_SEEK, len(seek)) + seek)


def compress(ids: bytes, compressor) -> list[tuple[bytes, int, int]]:
    """Frames (content, size, checksum) for one document's ids."""
    import xxhash

    cuts = range(0, max(1, len(ids)), FRAME_BYTES)
    parts = [ids[c : c + FRAME_BYTES] for c in cuts]
    return [(compressor.compress(p), len(p), xxhash.xxh64_intdigest(p) & 0xFFFFFFFF) for p in parts]


class ShardReader:
    """Random access to a shard: reads its tail first, then only the frames asked for."""

    def __init__(self, handle, size: int):
        import zstandard

        self.handle, self.unzip = handle, zstandard.ZstdDecompressor()
        handle.seek(size - 9)
        frames, flags, magic = struct.unpack("<IBI", handle.read(9))
        if magic != SEEK_MAGIC or flags != CHECKSUMS:
            raise ValueError("no seek table with checksums at the end")
        tail = 12 * frames + 9 + 8
        marks = (frames + 7) // 8
        named = 8 * frames + 2 * marks
        handle.seek(size - tail - named - 8)
        raw = handle.read(8 + named + 8 + 12 * frames)
        self.ids = np.frombuffer(raw, "<i8", frames, 8)
        self.goes_on, self.unnamed = (np.unpackbits(np.frombuffer(raw, np.uint8, marks, 8 + 8 * frames + k * marks), bitorder="little")[:frames].astype(bool) for k in (0, 1))
        table = np.frombuffer(raw, "<u4", 3 * frames, 8 + named + 8).reshape(-1, 3)
        self.packed, self.sizes, self.checks = table[:, 0].astype(np.int64), table[:, 1].astype(np.int64), table[:, 2]
        self.starts = np.concatenate(([0], np.cumsum(self.packed)))
        self.firsts = np.flatnonzero(~self.goes_on)

    def __len__(self) -> int:
        return len(self.firsts)

    def document(self, k: int) -> bytes:
        """Ids of the k-th document, every frame held against its checksum."""
        import xxhash

        last = self.firsts[k + 1] if k + 1 < len(self.firsts) else len(self.ids)
        out = []
        for f in range(self.firsts[k], last):
            self.handle.seek(int(self.starts[f]))
            size = int(self.sizes[f])
            part = self.unzip.decompress(self.handle.read(int(self.packed[f])), max_output_size=size) if size else b""
            if len(part) != size or xxhash.xxh64_intdigest(part) & 0xFFFFFFFF != self.checks[f]:
                raise ValueError(f"frame {f} does not match its checksum")
            out.append(part)
        return b"".join(out)

    def name(self, k: int) -> int | None:
        """The k-th document's id."""
        return None if self.unnamed[self.firsts[k]] else int(self.ids[self.firsts[k]])

    def find(self, doc_id: int | None) -> bytes:
        """Ids of the first document with this id."""
        named = self.unnamed[self.firsts] if doc_id is None else (self.ids[self.firsts] == doc_id) & ~self.unnamed[self.firsts]
        at = np.flatnonzero(named)
        if not len(at):
            raise KeyError(doc_id)
        return self.document(int(at[0]))


def shard_cuts(rows: DataFrame, shard_bytes: int) -> np.ndarray:
    """First doc_ids of the shards behind the first one, in order, from a sample of rows
    weighed by their text: CUT_SAMPLE rows a shard, at most MOST_SAMPLED. An id that takes several
    shards is there several times. The sample decides how evenly shards are filled, nothing else."""
    sized = rows.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).alias("b"))
    n, total = sized.agg(F.count("*"), F.sum("b")).first()
    shards = max(1, -(-(total or 0) // shard_bytes))
    if shards == 1:
        return np.zeros(0, np.int64)
    wanted = min(CUT_SAMPLE * shards, MOST_SAMPLED)
    some = sorted((r.doc_id, r.b) for r in sized.where("doc_id IS NOT NULL").sample(min(1.0, wanted / n), 17).collect())
    upto = np.cumsum([b for _, b in some])
    ids = np.array([d for d, _ in some], np.int64)
    if not len(ids):
        return np.zeros(0, np.int64)
    return ids[np.minimum(np.searchsorted(upto, upto[-1] * np.arange(1, shards) / shards), len(ids) - 1)]


def shard_numbers(ids: list, crcs: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Shards of documents, in order of (doc_id, crc); null ids come first. Rows of an id that
    takes several shards are dealt to them by ranges of the crc."""
    none = np.array([d is None for d in ids], bool)
    keys = np.array([0 if d is None else d for d in ids], np.int64)
    low, high = np.searchsorted(cuts, keys, side="left"), np.searchsorted(cuts, keys, side="right")
    # Of one cut at an id, its rows stand behind the cut; of more, in the shards that begin with it.
    own = high - np.maximum(high - low, 1) + (high > low)
    out = np.where(high - low > 1, own + ((high - low) * crcs.astype(np.float64) / (1 << 32)).astype(np.int64), high)
    return np.where(none, 0, out)


def write_tokens(docs: DataFrame, vocabulary: str, end_id: int, folder: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encode every text and write shards in ascending doc_id order; returns the
    manifest (shard, path, bytes, documents, tokens, start), start being the number
    of ids in the shards before.

    Null texts count as empty; very long ones go on in further frames; each document ends
    with `end_id`. Documents are dealt to shards by ranges of doc_id, cut so that each gets about
    `shard_bytes` of text; rows without a doc_id come first, rows that repeat one stand side by
    side in the order of their ids' crc, over several shards if they are many. Extra columns are
    ignored. An empty table gives an empty manifest. A task that is repeated writes a file of its
    own, and the manifest names the file of the one that counted."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cuts = spark.sparkContext.broadcast(shard_cuts(rows, shard_bytes))
    count = len(cuts.value) + 1

    def encode(batches):
        import pyarrow as pa
        import zstandard

        encoder, zipper = ChunkEncoder(vocabulary), zstandard.ZstdCompressor(level=1, write_checksum=False)
        end = np.uint32(end_id).tobytes()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            encoded = [raw + end for raw in encoder.encode_all(batch.column(1).to_pylist())]
            crcs = [zlib.crc32(raw) for raw in encoded]
            columns = [[], [], [], [], [], [], [], []]
            room = 0
            for doc_id, shard, crc, raw in zip(ids, shard_numbers(ids, np.array(crcs, np.int64), cuts.value).tolist(), crcs, encoded):
                for part, (frame, size, check) in enumerate(compress(raw, zipper)):
                    for column, value in zip(columns, (shard, doc_id, crc, part, frame, size, check, len(raw) // 4)):
                        column.append(value)
                    room += len(frame)
                if room > 1 << 24:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)
                    columns, room = [[], [], [], [], [], [], [], []], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)
        encoder.settle()

    import pyarrow as pa

    types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    names = ["shard", "doc_id", "crc", "part", "frame", "size", "checksum", "tokens"]
    frames = rows.mapInArrow(lean(encode, "chunks"), "shard int, doc_id long, crc long, part int, frame binary, size long, checksum long, tokens long")

    def write(batches):
        import uuid

        import pyarrow as pa

        def entries():
            for batch in batches:
                yield from zip(*(batch.column(k).to_pylist() for k in range(8)))

        from itertools import groupby

        fs, base = filesystem(folder)
        done = []
        for shard, group in groupby(entries(), key=lambda e: e[0]):
            counts = [0, 0]

            def listed(group=group, counts=counts):
                for _, doc_id, _, part, frame, size, check, tokens in group:
                    if not part:
                        counts[0] += 1
                        counts[1] += tokens
                    yield doc_id, part > 0, frame, size, check

            path = f"{base}/shard-{shard:08d}-{uuid.uuid4().hex}.zst"
            with fs.open_output_stream(path, compression=None) as out:
                write_shard(out, listed())
            done.append((shard, path, fs.get_file_info(path).size, *counts))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()])], ["shard", "path", "bytes", "documents", "tokens"])

    filesystem(folder)[0].create_dir(filesystem(folder)[1], recursive=True)
    dealt = frames.repartitionById(count, F.col("shard")).sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "crc", "part")
    with batch_rows(spark, BATCH_ROWS):
        manifest = store(dealt.mapInArrow(lean(write), "shard int, path string, bytes long, documents long, tokens long"), folder, "manifest")
    # One row a shard: the running total is over files, not documents.
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return manifest.withColumn("start", before)


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """Read shards back, document by document: doc_id, start, n_tokens, ids_crc32 and
    the shard's number in its name. Every frame is held against its checksum.

    One row per document written: null and empty texts have their end id alone, repeated
    rows a row each, documents of several frames one row; an empty manifest gives no rows."""

    def read(batches):
        import pyarrow as pa

        fs, _ = filesystem(folder)
        for batch in batches:
            for path, size, start in zip(*(batch.column(k).to_pylist() for k in range(3))):
                out = []
                with fs.open_input_file(path) as handle:
                    reader = ShardReader(handle, size)
                    for k in range(len(reader)):
                        ids = reader.document(k)
                        out.append((reader.name(k), start, len(ids) // 4, zlib.crc32(ids), path.rsplit("/", 1)[-1][:14]))
                        start += len(ids) // 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()])], ["doc_id", "start", "n_tokens", "ids_crc32", "shard"])

    # About one shard a task: a manifest row stands for a whole file.
    files = max(1, manifest.count())
    listed = manifest.select("path", "bytes", "start", "shard").repartitionById(files, F.col("shard")).select("path", "bytes", "start")
    return listed.mapInArrow(lean(read), "doc_id long, start long, n_tokens long, ids_crc32 long, shard string")


def token_table(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """Write the shards of a table into the shared folder and read them back; see
    `write_tokens` and `read_tokens` for nulls, ties, empty tables and long texts."""
    folder = work_dir(docs.sparkSession, "tokens")
    manifest = store(write_tokens(docs, vocabulary, end_id, folder), folder, "starts")
    return read_tokens(manifest, folder)


__all__ = ["ChunkEncoder", "ShardReader", "read_tokens", "token_table", "write_shard", "write_tokens"]
