"""Exact substring deduplication by level-wise doubling of repeated windows.

The first level looks at windows of half the judged length, and of those only at the
anchors: in every run of words that a judged window spans, the half-length windows of
least hash. Equal judged windows have equal anchors at equal places, so a window whose
anchor occurs once in the corpus is unique. Only windows around repeated anchors are
extended to twice the length, hashed and brought together again; what repeats there is
removed except where it starts first. Doubling ends there: a longer repeat is a chain
of repeated windows of the judged length, each of them already found.

What a task has met twice itself is settled in that task, and only its first occurrence
is sent to the others; so a passage that a third of all documents share is one row a
task, not one a document. Documents that are equal word for word are settled by their
digests, and only the first of them is extended.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skriba.llm.hashing import grams, mix, word_hashes
from skriba.llm.shared import keep_listed, store, work_dir

U = np.uint64
WINDOW = 20
#: Occurrences that a task gathers before it settles them.
GATHER = 2_000_000
NONE = U(0xFFFFFFFFFFFFFFFF)


def least_ahead(values: np.ndarray, n: int) -> np.ndarray:
    """Minimum of values[k:k + n] for every k, by doubling."""
    if len(values) < n:
        return values[:0]
    out, width = values, 1
    while width * 2 <= n:
        out = np.minimum(out[: len(out) - width], out[width:])
        width *= 2
    rest = n - width
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def anchors_of(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of a text's anchors."""
    half = grams(hashes, window // 2)
    span = window - window // 2 + 1
    least = least_ahead(half, span)
    if not len(least):
        return np.zeros(0, np.int64), half[:0]
    # A position is an anchor if it is the least of any window that holds it.
    padded = np.concatenate((np.zeros(span - 1, U), least, np.zeros(span - 1, U)))
    highest = ~least_ahead(~padded, span)
    at = np.flatnonzero(half == highest)
    return at, half[at]


def candidates_of(hashes: np.ndarray, window: int, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the windows that have a repeated anchor among `positions`."""
    half = grams(hashes, window // 2)
    span = window - window // 2 + 1
    repeated = np.full(len(half), NONE)
    repeated[positions] = half[positions]
    at = np.flatnonzero((least_ahead(half, span) == least_ahead(repeated, span)) & (least_ahead(repeated, span) != NONE))
    return at, grams(hashes, window)[at]


#: Mixes the second hash of a window's words; equal windows must agree in both.
SECOND = U(0xC2B2AE3D27D4EB4F)


def seconds(hashes: np.ndarray, n: int, at: np.ndarray) -> np.ndarray:
    """32 more bits about the windows of n words from the places `at` on: their words hashed anew."""
    return (grams(mix(hashes ^ SECOND), n)[at] >> U(32)).astype(np.uint32).view(np.int32)


class _Gather:
    """Occurrences (hash, second hash, doc, place) of one task, settled in bulk: of every hash the
    first occurrence (kind 0, by hash; `again`: it was met later too), and all later
    ones (kind 1, by document)."""

    def __init__(self):
        self.parts: list = []
        self.size = 0

    def add(self, hashes, second, doc, places):
        if len(hashes):
            self.parts.append((hashes, np.full(len(hashes), doc, np.int64), places.astype(np.int32), second))
            self.size += len(hashes)

    def settle(self):
        import pyarrow as pa

        if not self.size:
            return
        h, d, p, c = (np.concatenate([x[k] for x in self.parts]) for k in range(4))
        self.parts, self.size = [], 0
        order = np.lexsort((p, d, c, h))
        h, d, p, c = h[order], d[order], p[order], c[order]
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])))
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        # A row that repeats its document's id and place is the same occurrence.
        later = (d != d[head]) | (p != p[head])
        again = np.zeros(len(h), bool)
        again[head[later]] = True
        sent = new | later
        key = np.where(later, mix(d.view(U)), h).view(np.int64)
        arrays = [key, np.where(later, 0, c).astype(np.int32), later.astype(np.int8), d, p, again]
        for k in range(0, len(h), 100_000):
            cut = sent[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(a[k : k + 100_000][cut]) for a in arrays], ["key", "second", "kind", "doc_id", "place", "again"])


ROWS = "key long, second int, kind byte, doc_id long, place int, again boolean"


def repeated_anchors(docs: DataFrame, window: int) -> DataFrame:
    """doc_id and the places of its anchors that occur elsewhere too."""

    def scan(batches):
        gather = _Gather()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, last, hashes, at in word_hashes(batch.column(1).to_pylist(), False):
                for k in range(first, last):
                    own = hashes[at[k - first] : at[k - first + 1]]
                    places, found = anchors_of(own, window)
                    gather.add(found, seconds(own, window // 2, places), ids[k], places)
                if gather.size > GATHER:
                    yield from gather.settle()
        yield from gather.settle()

    rows = docs.mapInArrow(scan, ROWS)
    met = rows.withColumn("n", F.count("*").over(Window.partitionBy("key", "second", "kind")))
    return met.where("kind = 1 OR again OR n > 1").groupBy("doc_id").agg(F.collect_set("place").alias("places"))


def repeated_windows(docs: DataFrame, window: int) -> DataFrame:
    """doc_id and the starts of its windows that also start earlier; `docs` has the
    places of repeated anchors."""

    def scan(batches):
        gather = _Gather()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            places = batch.column(2)
            for first, last, hashes, at in word_hashes(batch.column(1).to_pylist(), False):
                for k in range(first, last):
                    own = hashes[at[k - first] : at[k - first + 1]]
                    met = places[k].values.to_numpy(zero_copy_only=False).astype(np.int64)
                    # Only where rows of different texts share a doc_id can a place lie behind the text.
                    met = met[met <= len(own) - window // 2]
                    starts, found = candidates_of(own, window, met)
                    gather.add(found, seconds(own, window, starts), ids[k], starts)
                if gather.size > GATHER:
                    yield from gather.settle()
        yield from gather.settle()

    rows = docs.select("doc_id", "text", "places").mapInArrow(scan, ROWS)
    first = F.min(F.struct("doc_id", "place")).over(Window.partitionBy("key", "second", "kind"))
    later = rows.withColumn("first", first).where((F.col("kind") == 1) | (F.struct("doc_id", "place") != F.col("first")))
    return later.groupBy("doc_id").agg(F.collect_set("place").alias("starts"))


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def outlines(docs: DataFrame) -> DataFrame:
    """doc_id, n_words and the digest of all words joined by one space."""

    def scan(batches):
        import pyarrow as pa

        for batch in batches:
            words = [(t or "").encode("utf-8", "surrogatepass").split() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(w) for w in words], pa.int64()), pa.array([_sha(w) for w in words], pa.string())], ["doc_id", "n_words", "sha"])

    return docs.mapInArrow(scan, "doc_id long, n_words long, sha string")


def kept_words(words: list[bytes], starts, window: int) -> list[bytes]:
    """Words that no window from `starts` covers."""
    change = np.zeros(len(words) + 1, np.int64)
    starts = np.asarray(starts, np.int64)
    starts = starts[starts + window <= len(words)]
    np.add.at(change, starts, 1)
    np.add.at(change, starts + window, -1)
    covered = np.cumsum(change[:-1]) > 0
    return [w for w, c in zip(words, covered) if not c]


def cut_texts(docs: DataFrame, window: int, texts: bool) -> DataFrame:
    """doc_id, n_removed and the digest of the kept words of (doc_id, text, starts), and
    the kept text itself if `texts`."""

    def scan(batches):
        import pyarrow as pa

        for batch in batches:
            out: list = [[], [], [], []]
            for doc_id, text, starts in zip(*(batch.column(k).to_pylist() for k in range(3))):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                kept = kept_words(words, starts, window)
                row = (doc_id, len(words) - len(kept), _sha(kept), b" ".join(kept).decode("utf-8", "surrogatepass") if texts else None)
                for column, value in zip(out, row):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, [pa.int64(), pa.int64(), pa.string(), pa.string()])], ["doc_id", "n_removed", "kept_sha", "kept_text"])

    return docs.select("doc_id", "text", "starts").mapInArrow(scan, "doc_id long, n_removed long, kept_sha string, kept_text string")


def substring_dedup(docs: DataFrame, window: int = WINDOW, texts: bool = False) -> DataFrame:
    """One row per distinct doc_id: doc_id, n_words, n_removed, kept_sha256, and kept_text
    (null unless `texts`; null too where nothing is removed).

    A word goes if a window of `window` words covers it whose words also start earlier:
    in a smaller doc_id, or further ahead in the same document; all windows are judged on
    the input. Null texts have no words; texts shorter than a window keep all. Rows that
    repeat a doc_id with its text are one document; of different texts under one doc_id
    that with the most words is reported, and all their windows count. Rows without a
    doc_id have no order and are left out. Extra columns are ignored; an empty table
    gives an empty result."""
    folder = work_dir(docs.sparkSession, "substring")
    rows = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    told = outlines(rows).groupBy("doc_id").agg(F.max(F.struct("n_words", "sha")).alias("o")).select("doc_id", "o.*")
    told = store(told, folder, "outlines")
    firsts = store(told.where(F.col("n_words") >= window).groupBy("sha").agg(F.min("doc_id").alias("first")), folder, "firsts")
    told = store(told.join(firsts, "sha", "left").select("doc_id", "n_words", "sha", (F.col("doc_id") != F.col("first")).alias("copy")), folder, "told")
    anchors = repeated_anchors(rows, window).join(told.where("copy").select("doc_id"), "doc_id", "left_anti")
    anchors = store(anchors, folder, "anchors")
    later = store(repeated_windows(keep_listed(rows, anchors, "doc_id"), window), folder, "windows")
    cut = cut_texts(keep_listed(rows, later, "doc_id"), window, texts)
    cut = store(cut.groupBy("doc_id").agg(F.max(F.struct("n_removed", "kept_sha", "kept_text")).alias("c")).select("doc_id", "c.*") if texts else cut.dropDuplicates(["doc_id"]), folder, "cut")
    copy = F.coalesce("copy", F.lit(False))
    none = hashlib.sha256(b"").hexdigest()
    joined = told.join(cut, "doc_id", "left")
    return joined.select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(copy, none).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"),
        F.when(copy, "").otherwise(F.col("kept_text")).alias("kept_text"),
    )


__all__ = ["anchors_of", "candidates_of", "kept_words", "substring_dedup"]
