"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that a document
belongs to). A flow network routes words from the patterns to the sources' quotas:
each pattern has one arc per repetition, of its whole size as capacity, whose cost
rises with the repetition (convex), so a second copy is used only where no first copy
helps. The flow says how many words of each pattern go to each source at each
repetition; documents are then taken in the order of a seeded hash until that many
words are reached, without ever sorting a source: a histogram of hash ranges finds the
range where the cut falls, and is refined until that range is small. The range's rows
are gone through one by one, each taken if it still fits; what very long documents leave
is carried on to the ranges behind.

A pattern whose sources are in no other pattern needs no network: its flow is the lesser of
the target and its words times the repeats. Only patterns that overlap are routed, each
connected group of them in a network of its own.

The plan is one row a pattern: how often all of it is taken, up to which hash it is taken
once more, and the few hashes behind that. Whether a row is taken follows from the plan and
the row alone, so texts are never shuffled.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skriba.llm.shared import driver_rows, remove, store, work_dir

#: Bits of the seeded hash, how many of them one refinement fixes, and hashes that a cut's range may hold.
HASH_BITS, STEP_BITS, CUT_ROWS = 60, 12, 256
#: A pattern is filled when so small a share of its last copy's words is missing, or after so many pieces.
FILLED, PIECES = 0.001, 12
# Weights of the sources in their order, repeating; budget; most repetitions.
WEIGHTS, BUDGET_PERCENT, REPEATS = (3, 1, 2), 150, 2


def quotas(sizes: dict, weights: dict, budget: Fraction, most: dict) -> dict:
    """Shares of the budget by weight, none above its `most`: the excess is shared
    again by weight among the others until no share is above."""
    left, out, open_ = Fraction(budget), {}, sorted(sizes, key=lambda s: (s is None, s or ""))
    while open_:
        total = sum(weights[s] for s in open_)
        share = {s: left * weights[s] / total for s in open_}
        over = [s for s in open_ if share[s] > most[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = Fraction(most[s])
            left -= out[s]
        open_ = [s for s in open_ if s not in over]
    return out


def min_cost_flow(patterns: dict, targets: dict, repeats: int) -> dict:
    """Words of each pattern at each repetition, {(pattern, source): words}, that fill
    the targets as far as the capacities allow at least cost.

    `patterns` maps a tuple of sources to its words. Successive shortest paths with
    Dijkstra and potentials on pattern -> source arcs; the arcs source of flow -> pattern
    come once per repetition at costs 0, 1, 2 ... (convex)."""
    nodes = ["s", *[("p", p) for p in patterns], *[("q", q) for q in targets], "t"]
    at = {n: i for i, n in enumerate(nodes)}
    arcs: list[list[int]] = []  # to, capacity, cost
    out: list[list[int]] = [[] for _ in nodes]

    def arc(a, b, capacity, cost):
        out[at[a]].append(len(arcs))
        arcs.append([at[b], capacity, cost])
        out[at[b]].append(len(arcs))
        arcs.append([at[a], 0, -cost])

    middle = {}
    for p, words in patterns.items():
        for r in range(repeats):
            arc("s", ("p", p), words, r)
        for q in p:
            middle[p, q] = len(arcs)
            arc(("p", p), ("q", q), words * repeats, 0)
    for q, words in targets.items():
        arc(("q", q), "t", words, 0)
    potential = [0] * len(nodes)
    while True:
        distance = [None] * len(nodes)
        distance[0], back, heap = 0, {}, [(0, 0)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > distance[u]:
                continue
            for k in out[u]:
                v, capacity, cost = arcs[k]
                if capacity > 0:
                    e = d + cost + potential[u] - potential[v]
                    if distance[v] is None or e < distance[v]:
                        distance[v], back[v] = e, k
                        heapq.heappush(heap, (e, v))
        if distance[at["t"]] is None:
            break
        potential = [p + (d if d is not None else 0) for p, d in zip(potential, distance)]
        path, v = [], at["t"]
        while v:
            path.append(back[v])
            v = arcs[back[v] ^ 1][0]
        push = min(arcs[k][1] for k in path)
        for k in path:
            arcs[k][1] -= push
            arcs[k ^ 1][1] += push
    return {pq: arcs[k ^ 1][1] for pq, k in middle.items() if arcs[k ^ 1][1]}


def word_count(column: str):
    """Number of words, runs of other bytes than space and 9 to 13; null has none."""
    text = F.coalesce(F.col(column), F.lit(""))
    return F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def routed(patterns: dict, targets: dict, repeats: int) -> dict:
    """Words of each pattern that the targets ask for: in closed form where a pattern's
    only source is in no other pattern, by flow in each connected group of the others."""
    met: dict = {}
    for p in patterns:
        for s in p:
            met[s] = met.get(s, 0) + 1
    amounts = {p: 0 for p in patterns}
    group: dict = {}

    def top(x):
        while group.setdefault(x, x) != x:
            group[x] = group[group[x]]
            x = group[x]
        return x

    shared = []
    for p, words in patterns.items():
        if len(p) == 1 and met[p[0]] == 1:
            amounts[p] = min(targets[p[0]], words * repeats)
        elif p:
            shared.append(p)
            for s in p[1:]:
                group[top(s)] = top(p[0])
    parts: dict = {}
    for p in shared:
        parts.setdefault(top(p[0]), []).append(p)
    for own in parts.values():
        sources = {s for p in own for s in p}
        for (p, _), words in min_cost_flow({p: patterns[p] for p in own}, {s: targets[s] for s in sources}, repeats).items():
            amounts[p] += words
    return amounts


def _ordered(sources):
    return [(s is None, s or "") for s in sources]


def _rows(docs: DataFrame, sources, seed: int, size) -> DataFrame:
    """What a plan looks at of every row: row (all columns as they are), size, sources, key
    (the sources as one text) and h, the seeded hash."""
    rows = docs.select(F.struct("*").alias("row"), size.alias("size"), F.array_sort(F.array_distinct(sources)).alias("sources"), F.xxhash64(F.lit(seed), "doc_id", size).alias("h"))
    return rows.withColumns({"key": F.to_json(F.struct("sources")), "h": F.shiftrightunsigned("h", 64 - HASH_BITS)})


def _pieces(table: DataFrame, wanted: dict) -> dict:
    """For each key of `wanted` {key: words}: (pieces, hashes). A row is taken if a piece
    (start, stop, most) has start <= h < stop and size <= most, or if its hash is listed;
    rows taken have about so many words.

    `table`: key, h, size, one row for each row that may be taken. Every step sums a
    histogram of the open ranges in Spark and finds the cell in which each key's words run
    out: one row a key comes back, however many there are. In a range of few rows each hash is
    taken if it still fits; what is left then is looked for behind it, among rows that fit."""
    spark = table.sparkSession
    # Open ranges: where the piece starts, the size that fits, the range's first hash, bits of a cell, words left.
    open_ = {k: (0, 1 << 62, 0, HASH_BITS - STEP_BITS, words) for k, words in wanted.items() if words > 0}
    pieces: dict = {k: [] for k in wanted}
    hashes: dict = {k: [] for k in wanted}
    while open_:
        state = driver_rows(spark, [(k, *x) for k, x in open_.items()], "key string, start long, most long, lo long, shift int, words long")
        inside = table.join(state, "key").where(f"h >= start AND size <= most AND shiftright(h, shift + {STEP_BITS}) = shiftright(lo, shift + {STEP_BITS})")
        cells = inside.groupBy("key", "words", F.expr("shiftright(h, shift)").alias("cell")).agg(F.sum("size").alias("size"), F.count("*").alias("n"))
        running = cells.withColumn("upto", F.sum("size").over(Window.partitionBy("key").orderBy("cell"))).where("upto > words")
        found = {r.key: r.c for r in running.groupBy("key").agg(F.min(F.struct("cell", "upto", "size", "n")).alias("c")).collect()}
        following, small = {}, []
        for k, (start, most, _, shift, words) in open_.items():
            r = found.get(k)
            if r is None:
                pieces[k].append((start, 1 << HASH_BITS, most))
            elif r.n > CUT_ROWS and shift:
                following[k] = (start, most, r.cell << shift, shift - STEP_BITS, words - (r.upto - r["size"]))
            else:
                small.append((k, start, most, r.cell << shift, shift, words - (r.upto - r["size"])))
        if small:
            ranges = driver_rows(spark, small, "key string, start long, most long, lo long, shift int, words long")
            near = table.join(ranges, "key").where("h >= start AND size <= most AND shiftright(h, shift) = shiftright(lo, shift)")
            by_key: dict = {}
            for r in near.groupBy("key", "h").agg(F.sum("size").alias("size")).collect():
                by_key.setdefault(r.key, []).append((r.h, r["size"]))
            for k, start, most, lo, shift, left in small:
                pieces[k].append((start, lo, most))
                for h, size in sorted(by_key.get(k, [])):
                    if size <= left:
                        hashes[k].append(h)
                        left -= size
                if left > FILLED * wanted[k] and len(pieces[k]) < PIECES:
                    following[k] = (lo + (1 << shift), left, 0, HASH_BITS - STEP_BITS, left)
        open_ = following
    return {k: (pieces[k], hashes[k]) for k in wanted}


def planned(docs: DataFrame, sources, targets_of, seed: int = 11, repeats: int = REPEATS, size=None) -> tuple[DataFrame, dict, dict]:
    """Every row of `docs` with how often the mix takes it: row (all columns as they are),
    size, sources, times (0 to `repeats`); and the words and the target of every source.

    `sources`: a column with the array of a document's sources (null members allowed).
    `targets_of`: function from {source: words} to {source: target words}. Documents are
    taken whole. Rows that agree in doc_id and size are taken alike. Null texts have size 0 and are
    not taken; an empty table gives an empty result; columns may have any names. Results depend
    only on the rows and `seed`."""
    spark = docs.sparkSession
    folder = work_dir(spark, "mix")
    rows = _rows(docs, sources, seed, word_count("text") if size is None else size)
    table = store(rows.select("key", "sources", "h", "size"), folder, "rows")
    found = table.groupBy("key").agg(F.first("sources").alias("sources"), F.sum("size").alias("words")).collect()
    key_of = {tuple(r.sources): r.key for r in found}
    totals: dict = {}
    for r in sorted(found, key=lambda r: _ordered(r.sources)):
        for s in r.sources:
            totals[s] = totals.get(s, 0) + int(r.words)
    patterns = {tuple(r.sources): int(r.words) for r in sorted(found, key=lambda r: _ordered(r.sources)) if r.words}
    targets = targets_of(totals)
    amounts = routed(patterns, {s: round(t) for s, t in targets.items()}, repeats)
    cuts = _pieces(table.where("size > 0").select("key", "h", "size"), {key_of[p]: amounts[p] % patterns[p] for p in patterns})
    plan = [(key_of[p], amounts[p] // patterns[p], [{"start": a, "stop": b, "most": m} for a, b, m in cuts[key_of[p]][0]], cuts[key_of[p]][1]) for p in patterns]
    remove(spark, folder)
    lookup = driver_rows(spark, plan, "key string, whole int, pieces array<struct<start:long,stop:long,most:long>>, hashes array<long>")
    fits = F.exists("pieces", lambda p: (F.col("h") >= p["start"]) & (F.col("h") < p["stop"]) & (F.col("size") <= p["most"])) | F.array_contains("hashes", F.col("h"))
    times = F.when((F.col("size") > 0) & F.col("whole").isNotNull(), F.least(F.lit(repeats), F.col("whole") + F.when(fits, 1).otherwise(0))).otherwise(0)
    return rows.join(lookup, "key", "left").select("row", "size", "sources", times.alias("times")), totals, targets


def mix(docs: DataFrame, sources, targets_of, seed: int = 11, repeats: int = REPEATS, size=None) -> DataFrame:
    """doc_id, size, sources and times of every row; see `planned`."""
    return planned(docs, sources, targets_of, seed, repeats, size)[0].select("row.doc_id", "size", "sources", "times")


def by_weight(totals: dict) -> dict:
    """The production targets: sources in code point order, null last, weigh WEIGHTS in
    turn and share BUDGET_PERCENT of all words, none above REPEATS times its own."""
    names = sorted(totals, key=lambda s: (s is None, s or ""))
    weights = {s: WEIGHTS[k % len(WEIGHTS)] for k, s in enumerate(names)}
    return quotas(totals, weights, Fraction(sum(totals.values()) * BUDGET_PERCENT, 100), {s: REPEATS * n for s, n in totals.items()})


def mix_sources(docs: DataFrame, targets_of=by_weight) -> DataFrame:
    """One row per row of `docs`: doc_id, source, size, source_size, target, times, taken.

    A row belongs to its own source alone. Null sources are one source; a null doc_id is
    returned as null; null and empty texts have size 0; an empty table gives an empty result."""
    rows, totals, targets = planned(docs, F.array("source"), targets_of)
    told = driver_rows(docs.sparkSession, [(s, int(n), float(targets[s])) for s, n in totals.items()], "source string, source_size long, target double")
    rows = rows.select("row.doc_id", F.col("sources")[0].alias("of"), "size", "times")
    joined = rows.join(told, F.col("of").eqNullSafe(F.col("source")), "left")
    return joined.select("doc_id", "source", "size", "source_size", "target", "times", (F.col("size") * F.col("times")).alias("taken"))


def mixed_documents(docs: DataFrame, targets_of=by_weight) -> DataFrame:
    """The mix itself: every row of `docs` as often as it is taken, its columns as they
    are, whatever their names. Rows that agree in doc_id and size are taken alike; rows
    without words are not taken; an empty table gives an empty result. No row is shuffled."""
    rows = planned(docs, F.array("source"), targets_of)[0]
    return rows.where("times > 0").select(F.explode(F.array_repeat("row", F.col("times"))).alias("row")).select("row.*")


__all__ = ["by_weight", "min_cost_flow", "mix", "mix_sources", "mixed_documents", "planned", "quotas", "routed", "word_count"]
