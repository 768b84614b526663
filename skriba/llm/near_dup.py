"""Near duplicates by a chosen-path set similarity join.

A document's set is its distinct word shingles. Documents with equal sets are one
class, and only a class's smallest document takes part. Its minwise tokens (the
least value of the set under each of COORDINATES hash functions) are the material of
the paths. The roots of the TREES choose BRANCHES coordinates each, no two the same one,
and a document goes on to one child per chosen coordinate, named by its token there;
a node further down chooses coordinates by hashing its own path, and names its
children by the tokens' bytes in the sketch. Similar sets agree in most tokens, so they
meet in some child of most nodes; every coordinate is a hash function of its own, so trees
miss a pair independently.

A node with few documents is compared exhaustively by sketches (one byte of every
token); documents whose sketches agree enough are compared on their texts' full sets. A
larger node compares every document with a pivot, and then branches. First each document
is compared with its smallest similar one of a node, then with all others that this has
not connected it with: links found so far give every document a component, a node whose
documents are all of one component is done, and pairs inside a component are never
made. So a large group of near copies costs its own size at every level, not its
square, and nothing is capped: in a node that has used all its levels, or where that
takes few pairs, the documents outside its main component are compared with all others in
blocks, by sketches first like any other.

What travels is a sketch for each document and eight bytes for each node it is in; texts
travel only for documents with a similar sketch. Tables of a level are deleted when the
next one stands on its own.

Every pair of sets that reach the similarity meets in the first level of the trees
with a chance of 1 - (1 - J)^(TREES * BRANCHES), 1 - 3e-6 at 0.8; its sketches
then agree enough (six standard deviations of slack) with one of 1 - 1e-8.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skriba.llm.hashing import grams, mix, word_hashes
from skriba.llm.shared import FILTER_BITS, batch_rows, components, driver_rows, drop_listed, id_filter, lean, likely, probable, remove, store, work_dir

U = np.uint64
COORDINATES, TREES, BRANCHES, LEVELS = 128, 4, 2, 12
#: Documents of a node that are compared exhaustively.
SMALL_NODE = 128
#: Large nodes are finished in blocks as soon as that takes at most so many pairs a document:
#: those of documents outside a node's main component with all of the node.
PAIRS_PER_DOC = 1_000
#: A large node is dense if it has this share of its parent's documents; documents of a part of it.
DENSE, DENSE_PART = 0.5, 512
#: Rows with texts that a Python worker gets at once.
WIDE_ROWS = 1_000
_random = np.random.Generator(np.random.PCG64(4111))
FACTORS = _random.integers(1, 1 << 32, COORDINATES, dtype=np.uint32) | np.uint32(1)
SHIFTS = _random.integers(0, 1 << 32, COORDINATES, dtype=np.uint32)
#: The coordinates that the trees' roots choose.
CHOSEN = np.random.Generator(np.random.PCG64(97)).permutation(COORDINATES)[: TREES * BRANCHES]


def shingle_set(hashes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text's word hashes; with fewer than n words the
    whole sequence is one shingle; no words, no shingles."""
    if not len(hashes):
        return hashes
    return np.unique(grams(hashes, min(n, len(hashes))))


def minwise(shingles: np.ndarray) -> np.ndarray:
    """The least of the set under every hash function."""
    out = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    x = (shingles >> U(32)).astype(np.uint32)
    for k in range(0, len(x), 4096):
        part = x[k : k + 4096]
        np.minimum(out, (FACTORS[:, None] * part[None, :] + SHIFTS[:, None]).min(axis=1), out=out)
    return out


def sketch_of(tokens: np.ndarray) -> np.ndarray:
    """One byte of each minwise token; the highest of a minimum is mostly zero, so mix first."""
    return ((tokens * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)


def features(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, size of the set, its 128-bit digest (two longs), a hash of the text, the
    sketch and the tokens that the trees' roots choose."""

    def scan(batches):
        import hashlib

        import pyarrow as pa

        for batch in batches:
            out = [[], [], [], [], []]
            for first, last, hashes, at in word_hashes(batch.column(2).to_pylist(), True):
                for k in range(first, last):
                    s = shingle_set(hashes[at[k - first] : at[k - first + 1]], n)
                    digest = hashlib.md5(s.tobytes()).digest()
                    tokens = minwise(s) if len(s) else None
                    row = (len(s), int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True))
                    row += (sketch_of(tokens).tobytes(), tokens[CHOSEN].tobytes()) if len(s) else (None, None)
                    for column, value in zip(out, row):
                        column.append(value)
            made = [pa.array(c, t) for c, t in zip(out, [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made[:3], batch.column(1), *made[3:]], ["doc_id", "n", "d1", "d2", "t", "sketch", "chosen"])

    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("t"), "text")
    return rows.mapInArrow(lean(scan), "doc_id long, n long, d1 long, d2 long, t long, sketch binary, chosen binary")


def text_hash():
    return F.xxhash64("text")


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc and text of the listed (doc_id, t) documents; a row that repeats a doc_id with
    another text is not the listed one. The id filter runs before the join's exchange."""
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("t"), "text")
    found = rows.where(likely(rows, ids, "doc_id")).join(ids, ["doc_id", "t"])
    # One text a document is listed, so this needs no other exchange than the join's.
    return found.groupBy("doc_id", "t").agg(F.first("text").alias("text")).select(F.col("doc_id").alias("doc"), "text")


def children(paths: np.ndarray, level: int, sketches: np.ndarray) -> np.ndarray:
    """Names of the children that documents with these sketches go to from these nodes."""
    out = np.empty((len(paths), BRANCHES), U)
    for b in range(BRANCHES):
        seed = mix(paths + U((level * 0xD6E8FEB86659FD93 + (b + 1) * 0xA0761D6478BD642F) % (1 << 64)))
        token = sketches[np.arange(len(paths)), (seed >> U(40)).astype(np.int64) % COORDINATES]
        out[:, b] = mix(seed ^ (token.astype(U) + U(1)) * U(0x2545F4914F6CDD1D))
    return out


def roots(reps: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """First level: (node, doc, up) of every tree's children; with `only` those rows whose node
    is probably in it."""
    # Names are hashes already: their last bits are their slots.
    bits = None if only is None else reps.sparkSession.sparkContext.broadcast(id_filter(only, "node", F.pmod("node", F.lit(FILTER_BITS))))

    def scan(batches):
        import pyarrow as pa

        for batch in batches:
            tokens = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, len(CHOSEN))
            names = mix(tokens.astype(U) + (np.arange(1, len(CHOSEN) + 1).astype(U) << U(32))[None, :]).view(np.int64).ravel()
            ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), len(CHOSEN))
            if bits is not None:
                there = probable(names % FILTER_BITS, bits.value)
                names, ids = names[there], ids[there]
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(ids)], ["node", "doc"])

    return reps.select("doc", "chosen").mapInArrow(lean(scan), "node long, doc long").withColumn("up", F.lit(1 << 60))


def branch(nodes: DataFrame, reps: DataFrame, level: int) -> DataFrame:
    """Children of (node, doc, size) rows; `up` is the size of the parent."""

    def scan(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                node, doc, size = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
                sketches = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, COORDINATES)
                names = children(node.view(U), level, sketches).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(names.ravel()), pa.array(np.repeat(doc, BRANCHES)), pa.array(np.repeat(size, BRANCHES))], ["node", "doc", "up"])

    with_sketch = nodes.join(reps.select("doc", "sketch"), "doc").select("node", "doc", "size", "sketch")
    return with_sketch.mapInArrow(lean(scan), "node long, doc long, up long").distinct()


def compare_blocks(blocks: DataFrame, reps: DataFrame, percent: int, crossing: bool) -> DataFrame:
    """What sketches say about the documents of a block, from rows (block, doc, label);
    blocks are bounded, and read one at a time from rows sorted by block.

    Not `crossing`: (a, b, block), each document's pair with its smallest similar one, and a block
    that it was met in. `crossing`: (block, doc, label) of the documents that are similar to one of another label."""
    needed = percent / 100 - 6 * (percent / 100 * (1 - percent / 100) / COORDINATES) ** 0.5

    def alike(sizes, sketches, labels):
        # Two unequal tokens share their byte once in 256.
        for i in range(len(sizes)):
            agree = ((sketches == sketches[i]).mean(axis=1) * 256 - 1) / 255
            near = (agree >= needed) & (100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i])) & (labels != labels[i])
            yield np.flatnonzero(near)

    def judge(held):
        held.sort(key=lambda h: h[1])
        docs, labels, sizes = (np.array([h[k] for h in held], np.int64) for k in (1, 2, 3))
        sketches = np.frombuffer(b"".join(h[4] for h in held), np.uint8).reshape(-1, COORDINATES)
        if crossing:
            found = [i for i, near in enumerate(alike(sizes, sketches, labels)) if len(near)]
            return [held[0][0]] * len(found), docs[found].tolist(), labels[found].tolist()
        pairs = {(min(i, near[0]), max(i, near[0])) for i, near in enumerate(alike(sizes, sketches, labels)) if len(near)}
        return [int(docs[i]) for i, _ in pairs], [int(docs[j]) for _, j in pairs], [held[0][0]] * len(pairs)

    names = ["block", "doc", "label"] if crossing else ["a", "b", "block"]

    def scan(batches):
        import pyarrow as pa

        def told(found):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], names)

        held: list = []
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if held and held[0][0] != row[0]:
                    if len(held) > 1:
                        yield told(judge(held))
                    held = []
                held.append(row)
        if len(held) > 1:
            yield told(judge(held))

    rows = blocks.join(reps.select("doc", "n", "sketch"), "doc").select("block", "doc", "label", "n", "sketch")
    found = rows.repartition("block").sortWithinPartitions("block").mapInArrow(lean(scan), ", ".join(f"{n} long" for n in names))
    return found if crossing else found.groupBy("a", "b").agg(F.min("block").alias("block"))


def sets_of(texts, n: int):
    """The sets of many texts, one after the other."""
    for first, last, hashes, at in word_hashes(texts, True):
        for k in range(last - first):
            yield shingle_set(hashes[at[k] : at[k + 1]], n)


def confirm(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Pairs (a, b, block) whose full sets reach the similarity. Every `a` meets its partners of a
    block, which are fewer than a block's documents, in one task: its set is held, theirs pass by."""

    def scan(batches):
        import pyarrow as pa

        at = centre = None
        for batch in batches:
            out: list = [[], []]
            block, role, doc = (batch.column(k).to_pylist() for k in range(3))
            for k, s in enumerate(sets_of(batch.column(3).to_pylist(), n)):
                if not role[k]:
                    at, centre = doc[k], s
                else:
                    common = len(np.intersect1d(centre, s, assume_unique=True))
                    if 100 * common >= percent * (len(centre) + len(s) - common):
                        out[0].append(at)
                        out[1].append(doc[k])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["a", "b"])

    dealt = pairs.select("a", "b", F.xxhash64("a", "block").alias("block"))
    rows = dealt.select("block", F.lit(1).alias("role"), F.col("b").alias("doc")).union(dealt.select("block", F.lit(0).alias("role"), F.col("a").alias("doc")).distinct())
    held = rows.join(texts, "doc").select("block", "role", "doc", "text")
    return held.repartition("block").sortWithinPartitions("block", "role").mapInArrow(lean(scan), "a long, b long")


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """One row per distinct doc_id: doc_id, n_shingles, class_id (the smallest document
    with the same set), component_id, kept (doc_id = component_id), n_links (confirmed
    links of its class in the spanning set that the components come from).

    Words are folded A-Z only. Texts that are null or without words have an empty set
    and link with nothing; texts with fewer words than a shingle are one shingle; very long
    texts are taken whole. Rows that repeat a doc_id are one document (the one whose set is
    largest, then of the greatest digest); rows without a doc_id are left out. Of equal sets
    the smallest doc_id stands for all. Extra columns are ignored, whatever their names; an
    empty table gives an empty result."""
    with batch_rows(docs.sparkSession, WIDE_ROWS):
        return _near_duplicates(docs.select("doc_id", "text"), shingle_words, percent)[0]


def _near_duplicates(docs: DataFrame, shingle_words: int, percent: int) -> tuple[DataFrame, str]:
    """The result, stored by itself, and its folder."""
    spark = docs.sparkSession
    folder, kept = work_dir(spark, "near"), work_dir(spark, "near-result")
    table = store(features(docs, shingle_words), folder, "features")
    members = table.groupBy("doc_id").agg(F.max(F.struct("n", "d1", "d2", "t")).alias("s")).select("doc_id", "s.*")
    classes = store(members.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("class_id")), folder, "classes")
    members = store(members, folder, "members")
    heads = classes.select(F.col("class_id").alias("doc_id"), "n", "d1", "d2")
    reps = table.join(heads, ["doc_id", "n", "d1", "d2"]).dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("doc"), "n", "sketch", "chosen")
    reps = store(reps, folder, "reps")
    remove(spark, f"{folder}/features")
    count = reps.count()
    links = driver_rows(spark, [], "a long, b long")
    labels = texts = have = None
    spent: list[str] = []

    def kept_for_now(df, name):
        spent.append(f"{folder}/{name}")
        return store(df, folder, name)

    def need(ids, name):
        # Texts of these documents, as far as they are not there yet.
        nonlocal texts, have
        ids = ids if have is None else ids.join(have, "doc_id", "left_anti")
        listed = store(ids.join(members.select("doc_id", "t"), "doc_id"), folder, f"listed-{name}")
        if not listed.isEmpty():
            more = store(texts_of(docs, listed), folder, f"texts-{name}")
            texts = more if texts is None else texts.unionByName(more)
            have = listed.select("doc_id") if have is None else have.unionByName(listed.select("doc_id"))

    def connect(found, name):
        nonlocal links, labels
        found = store(found, folder, f"links-{name}")
        if found.isEmpty():
            return False
        links = links.unionByName(found)
        if labels is not None:
            # What was connected before stays so as stars; only their links and the new ones count.
            spent.append(labels[1])
            found = labels[0].select(F.col("doc").alias("a"), F.col("label").alias("b")).where("a <> b").unionByName(found)
        found = components(found, f"{folder}/cc-{name}", "cc").select(F.col("node").alias("doc"), F.col("component").alias("label"))
        labels = store(found, folder, f"labels-{name}"), f"{folder}/labels-{name}"
        spent.append(f"{folder}/cc-{name}")
        return True

    def judge(rows, crossing, name):
        # Sketches first; texts travel only for what they let pass.
        near = kept_for_now(compare_blocks(rows, reps, percent, crossing), f"near-{name}")
        if near.isEmpty():
            return False
        need(near.select(F.explode(F.array("doc") if crossing else F.array("a", "b")).alias("doc_id")).distinct(), name)
        return connect(compare_sets(near, texts, shingle_words, percent) if crossing else confirm(near, texts, shingle_words, percent), name)

    nodes = None
    for level in range(LEVELS + 1):
        open_, changed = None, True
        for crossing in (False, True):
            name = f"{level}-{'crossing' if crossing else 'pivot'}"
            # Without new links the nodes are open as they were.
            open_ = _open_nodes(nodes, reps, labels and labels[0], kept_for_now, name) if changed else open_
            if not crossing:
                changed = judge(_with_pivot(open_, level), False, name)
                continue
            # What is left may be little enough to be compared at once: then no more levels.
            large = open_.where(F.col("few") > SMALL_NODE)
            work = large.agg(F.sum(F.col("few").cast("double"))).first()[0] or 0.0
            last = level == LEVELS or work <= PAIRS_PER_DOC * count
            judge(_across(open_ if last else open_.where((F.col("few") <= SMALL_NODE) | F.col("dense"))), True, name)
        large = large.where("NOT dense")
        done = last or large.isEmpty()
        if not done:
            nodes = store(branch(large.select("node", "doc", "size"), reps, level + 1), folder, f"nodes-{level + 1}")
            spent.append(f"{folder}/nodes-{level}")
        open_ = large = None
        remove(spark, *spent)
        spent.clear()
        if done:
            break
    # Two blocks may tell the same link.
    degree = links.distinct().select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("n_links"))
    told = classes.join(degree, "class_id", "left")
    told = told.join(labels[0].withColumnRenamed("doc", "class_id"), "class_id", "left") if labels else told.withColumn("label", F.lit(None).cast("long"))
    joined = members.join(told.select("n", "d1", "d2", "class_id", "label", "n_links"), ["n", "d1", "d2"], "left")
    class_id = F.coalesce("class_id", "doc_id")
    component = F.coalesce("label", class_id)
    result = joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("doc_id") == component).alias("kept"), class_id.alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    result = store(result, kept, "result")
    remove(spark, folder)
    return result, kept


def _open_nodes(nodes: DataFrame | None, reps: DataFrame, labels: DataFrame | None, kept_for_now, name: str) -> DataFrame:
    """Rows of nodes (None: the first level's) whose documents are not all of one component: node, doc, label, size,
    pivot (the node's smallest document), main (the component of most documents), few (how
    many are not of it) and dense. Only rows whose node probably is such a one are shuffled."""

    def labelled(rows):
        if labels is None:
            return rows.withColumn("label", F.col("doc"))
        return rows.join(labels, "doc", "left").select("node", "doc", "up", F.coalesce("label", "doc").alias("label"))

    rows = roots(reps) if nodes is None else nodes
    if labels is None:
        stats = rows.groupBy("node").agg(F.count("*").alias("size"), F.min("doc").alias("pivot"), F.max("up").alias("up")).where("size > 1")
        stats = stats.select("node", "size", "pivot", F.col("pivot").alias("main"), (F.col("size") - 1).alias("few"), "up")
    else:
        by_label = labelled(rows).groupBy("node", "label").agg(F.count("*").alias("n"), F.min("doc").alias("least"), F.max("up").alias("up"))
        stats = by_label.groupBy("node").agg(F.sum("n").alias("size"), F.min("least").alias("pivot"), F.max(F.struct("n", "label")).alias("m"), F.max("up").alias("up"))
        stats = stats.select("node", "size", "pivot", F.col("m.label").alias("main"), (F.col("size") - F.col("m.n")).alias("few"), "up").where("few > 0")
    stats = kept_for_now(stats.select("node", "size", "pivot", "main", "few", (F.col("size") >= DENSE * F.col("up")).alias("dense")), f"stats-{name}")
    rows = roots(reps, stats) if nodes is None else nodes.where(likely(nodes, stats, "node"))
    return kept_for_now(labelled(rows).drop("up").join(stats, "node"), f"open-{name}")


def _parts():
    return F.ceil(F.col("size") / F.lit(SMALL_NODE)).cast("int")


def _with_pivot(open_: DataFrame, level: int) -> DataFrame:
    """(block, doc, label): nodes cut into parts of about SMALL_NODE documents; the pivot
    belongs to all parts of its node."""
    rows = open_.select(F.xxhash64("node", F.pmod(F.xxhash64("doc", F.lit(level)), _parts())).alias("block"), "doc", "label")
    pivots = open_.where((F.col("doc") == F.col("pivot")) & (F.col("size") > SMALL_NODE))
    spread = pivots.select("node", "doc", "label", F.explode(F.sequence(F.lit(0), _parts() - 1)).alias("part"))
    return rows.union(spread.select(F.xxhash64("node", F.col("part").cast("long")).alias("block"), "doc", "label")).distinct()


def _across(open_: DataFrame) -> DataFrame:
    """(block, doc, label) so that every document outside the main component of its node meets
    every other document of the node: those documents in parts, all documents in parts, and
    every part of the ones with every part of the others as one block."""
    part = F.when(F.col("few") <= SMALL_NODE, SMALL_NODE).otherwise(DENSE_PART)
    few_parts, parts = (F.ceil(F.col(c) / part).cast("int") for c in ("few", "size"))
    few_own, own = F.pmod(F.xxhash64("doc", F.lit(1)), few_parts), F.pmod(F.xxhash64("doc"), parts)

    def block(i, j):
        return F.xxhash64("node", i.cast("long"), j.cast("long"))

    as_any = F.transform(F.sequence(F.lit(0), few_parts - 1), lambda i: block(i, own))
    as_few = F.transform(F.sequence(F.lit(0), parts - 1), lambda j: block(few_own, j))
    blocks = F.when(F.col("label") == F.col("main"), as_any).otherwise(F.array_union(as_any, as_few))
    return open_.select(F.explode(blocks).alias("block"), "doc", "label")


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every two sets: a product of the matrix that has a
    row for each set and a column for each item that two sets share, made in slices
    of the items' range so that long sets need little room."""
    out = np.zeros((len(sets), len(sets)), np.float32)
    slices = 1 + sum(len(s) for s in sets) // 400_000
    edges = [U((1 << 64) * k // slices) for k in range(slices)]
    cuts = [np.append(np.searchsorted(s, np.array(edges, U)), len(s)) for s in sets]
    for k in range(slices):
        parts = [s[c[k] : c[k + 1]] for s, c in zip(sets, cuts)]
        _, where, counts = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        rows = np.repeat(np.arange(len(sets)), [len(p) for p in parts])
        shared = counts[where] > 1
        column, rows = (np.cumsum(counts > 1) - 1)[where[shared]], rows[shared]
        order = np.argsort(column, kind="stable")
        column, rows = column[order], rows[order]
        for first in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
            span = slice(np.searchsorted(column, first), np.searchsorted(column, first + 4096))
            block = np.zeros((len(sets), 4096), np.float32)
            block[rows[span], column[span] - first] = 1
            out += block @ block.T
    return out


def compare_sets(blocks: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (a < b) between documents of a block by their full sets: of each block those
    that join documents which neither earlier components nor its other links join.
    Two blocks may tell the same link."""

    def forest(docs, labels, items):
        order = np.argsort(docs)
        sizes = np.array([len(items[k]) for k in order])
        common = common_counts([items[k] for k in order])
        # Sizes are far below 2**24, where float32 is exact; the comparison is made in float64.
        alike = np.array([100.0 * row.astype(float) >= percent * (size + sizes - row) for row, size in zip(common, sizes)])
        up: dict = {}

        def top(x):
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        out = []
        for i, j in zip(*np.nonzero(np.triu(alike, 1))):
            a, b = top(int(labels[order[i]])), top(int(labels[order[j]]))
            if a != b:
                up[a] = b
                out.append((int(docs[order[i]]), int(docs[order[j]])))
        return out

    def scan(batches):
        import pyarrow as pa

        held: list = []

        def told():
            rows = forest(np.array([h[1] for h in held], np.int64), np.array([h[2] for h in held], np.int64), [h[3] for h in held])
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            for *row, s in zip(*(batch.column(k).to_pylist() for k in range(3)), sets_of(batch.column(3).to_pylist(), n)):
                if held and held[0][0] != row[0]:
                    yield told()
                    held = []
                held.append((*row, s))
        if held:
            yield told()

    rows = blocks.join(texts, "doc").select("block", "doc", "label", "text")
    return rows.repartition("block").sortWithinPartitions("block").mapInArrow(lean(scan), "a long, b long")


def drop_near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """Rows of `docs` without those whose doc_id is not the smallest of its component, with
    all columns as they are; rows without a doc_id are kept, rows that repeat one are
    judged as one document, texts that are null or empty are no near copies. An empty table
    gives an empty result; very long texts are taken whole."""
    spark = docs.sparkSession
    folder = work_dir(spark, "near-spare")
    with batch_rows(spark, WIDE_ROWS):
        judged, done = _near_duplicates(docs.select("doc_id", "text"), shingle_words, percent)
    spare = store(judged.where("NOT kept").select("doc_id"), folder, "spare")
    remove(spark, done)
    return drop_listed(docs, spare, "doc_id", folder)


__all__ = ["drop_near_duplicates", "near_duplicates", "shingle_set"]
