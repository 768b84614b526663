"""Language-model scores by a hierarchical Pitman-Yor model.

Every context has a restaurant of its own: the context of a token is the word before it (or
the start of the text). Their customers are training tokens, their tables send a customer
each to the one parent restaurant, whose own tables draw from the uniform distribution over
the vocabulary and one unseen type. Seating is sampled by Gibbs: in every sweep each dish of
each restaurant gets its number of tables anew from its exact conditional given its
customers (generalised Stirling numbers), with the parent's probabilities and the
restaurants' totals of the sweep before, as is usual when sampling is distributed. The
predictive probabilities of the sweeps after BURN are averaged.

A cell is a word in a context. Texts are read in runs of about GATHER tokens; a run sends each of its
cells once, with its count, to a partition by the hash of word and context, so frequent words
and pairs are no burden on one task. Neither a context's totals nor a word's at the parent are
in one partition: in every sweep partitions send their sums, once for each word and context that
they hold, to owners by the word's hash, which add them up, seat the parent's dishes and
answer. At the end each cell's score goes back to the runs that have sent it. What partitions
keep between sweeps are files of the shared folder, named by the rows that pass between them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skriba.llm.hashing import mix, word_hashes
from skriba.llm.shared import batch_rows, lean, remove, store, work_dir
from skriba.llm.token_output import filesystem

U = np.uint64
#: Numbered contexts of a seating in one process, besides the last; tables have as many as words.
CONTEXTS = 64
#: Discounts and strengths of the context restaurants and of their parent.
DISCOUNT, STRENGTH, PARENT_DISCOUNT, PARENT_STRENGTH = 0.7, 20.0, 0.6, 50.0
BURN, SAMPLES = 1, 3
#: Tokens of a run; bytes of text for a partition of cells.
GATHER, PART_BYTES = 3_000_000, 36_000_000
#: Rows that workers get at once where each is an array.
WIDE_ROWS = 16
#: Customers of a dish that are seated by their exact conditional; the rest by expectation.
EXACT = 32
#: The hashes that stand for a text's end and, as a context, for its start.
END, START = U(0x0123456789ABCDEF), U(0xFEDCBA9876543210)


def stirling(discount: float, n: int) -> np.ndarray:
    """Logs of the generalised Stirling numbers S(c, t), c and t up to n."""
    out = np.full((n + 1, n + 1), -np.inf)
    out[0, 0] = 0.0
    for c in range(n):
        for t in range(1, c + 2):
            stay = out[c, t] + np.log(c - discount * t) if c - discount * t > 0 else -np.inf
            out[c + 1, t] = np.logaddexp(out[c, t - 1], stay)
    return out


def sample_tables(customers: np.ndarray, rate: np.ndarray, discount: float, numbers: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """Tables of dishes with these customers, by one uniform number each: from
    P(t) ~ S(c, t) rate**t up to EXACT customers, and in expectation for those beyond (each
    opens a table with the chance rate / (rate + customers - discount * tables))."""
    tables = np.minimum(customers, 1).astype(np.float64)
    some = np.flatnonzero(customers > 1)
    few = np.minimum(customers[some], EXACT).astype(np.uint8)
    order = np.argsort(few, kind="stable")
    some, few = some[order], few[order]
    for at in range(0, len(some), 100_000):
        part, c = some[at : at + 100_000], few[at : at + 100_000]
        t = np.arange(1, int(c[-1]) + 1)
        weights = numbers[c, 1 : len(t) + 1] + t[None, :] * np.log(rate[part])[:, None]
        upto = np.cumsum(np.exp(weights - weights.max(axis=1, keepdims=True)), axis=1)
        tables[part] = 1 + (upto[:, :-1] <= (chance[part] * upto[:, -1])[:, None]).sum(axis=1)
    large = np.flatnonzero(customers > EXACT)
    if len(large):
        n, t, r, goal = np.full(len(large), float(EXACT)), tables[large], rate[large], customers[large].astype(float)
        while (n < goal).any():
            step = np.minimum(goal - n, np.maximum(1.0, n * 0.25))
            t = np.minimum(t + step * r / (r + n - discount * t), n + step)
            n = n + step
        tables[large] = np.round(t)
    return tables


def chances(keys: np.ndarray, sweep: int) -> np.ndarray:
    """A uniform number for each key, anew in every sweep and the same in every task."""
    return (mix(keys ^ mix(np.array([sweep + 1], U))) >> U(11)) * 2.0**-53


def at_parent(sent, tables, all_sent: float, all_tables: float, base: float):
    """The parent's predictive probability of words by their customers and tables there."""
    return (sent - PARENT_DISCOUNT * tables + (PARENT_STRENGTH + PARENT_DISCOUNT * all_tables) * base) / (PARENT_STRENGTH + all_sent)


class Seating:
    """The whole model in one process: `word`, `context` (numbers) and `customers` describe its
    cells, the dishes of the context restaurants. What `language_scores` is held against."""

    def __init__(self, words: int, word, context, customers, settings: dict, seed: int):
        self.words, self.word, self.context, self.customers = words, word, context, customers
        self.settings, self.rng = settings, np.random.Generator(np.random.PCG64(seed))
        self.numbers = stirling(DISCOUNT, EXACT), stirling(PARENT_DISCOUNT, EXACT)
        self.tables = np.minimum(customers, 1).astype(np.float64)
        self._at_parent()
        self.parent_tables = np.minimum(self.sent, 1.0)

    def _at_parent(self):
        self.sent = np.bincount(self.word, self.tables, self.words)

    def totals(self) -> np.ndarray:
        """Tables by context, then the parent's tables."""
        return np.concatenate((np.bincount(self.context, self.tables, len(self.settings["customers"])), [self.parent_tables.sum()]))

    def parent(self, totals) -> np.ndarray:
        """The parent's predictive probability of every word; totals are the corpus's."""
        return at_parent(self.sent, self.parent_tables, totals[:-1].sum(), totals[-1], self.settings["base"])

    def sweep(self, totals) -> None:
        """Sample all tables given the corpus's totals before."""
        rate = (STRENGTH + DISCOUNT * totals[self.context]) * self.parent(totals)[self.word]
        self.tables = sample_tables(self.customers, rate, DISCOUNT, self.numbers[0], self.rng.random(len(self.customers)))
        self._at_parent()
        root = (PARENT_STRENGTH + PARENT_DISCOUNT * totals[-1]) * self.settings["base"]
        self.parent_tables = sample_tables(self.sent, np.full(self.words, root), PARENT_DISCOUNT, self.numbers[1], self.rng.random(self.words))

    def predictive(self, totals) -> np.ndarray:
        """Probability of every cell's word after its context."""
        below = STRENGTH + np.asarray(self.settings["customers"])[self.context]
        own = self.customers - DISCOUNT * self.tables
        return (own + (STRENGTH + DISCOUNT * totals[self.context]) * self.parent(totals)[self.word]) / below

    def replay(self, history) -> None:
        """The sweeps that led to here: history[k] are the totals after k sweeps."""
        for totals in history:
            self.sweep(np.asarray(totals))

    def scores(self, history) -> np.ndarray:
        """log10 of the averaged predictive probability of every cell."""
        total = np.zeros(len(self.word))
        for k in range(1, len(history)):
            self.sweep(np.asarray(history[k - 1]))
            if k > BURN:
                total += self.predictive(np.asarray(history[k]))
        return np.log10(total / (len(history) - 1 - BURN))


def tokens_of(texts):
    """Yields (first, last, tokens, contexts, offsets) for runs of texts: hashes of words and
    one end each, and of the word before each (START at a text's beginning)."""
    for first, last, hashes, at in word_hashes(texts, True):
        n = last - first
        offsets = np.concatenate(([0], np.cumsum(np.diff(at) + 1)))
        tokens = np.empty(len(hashes) + n, U)
        ends = offsets[1:] - 1
        body = np.ones(len(tokens), bool)
        body[ends] = False
        tokens[body] = hashes
        tokens[ends] = END
        contexts = np.empty(len(tokens), U)
        contexts[1:] = tokens[:-1]
        contexts[offsets[:-1]] = START
        yield first, last, tokens, contexts, offsets


def pair_keys(words: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    """Hashes of cells, which draw their chances; cells are told apart by both words."""
    return mix(words * U(0x9E3779B97F4A7C15) + contexts)


def places(words: np.ndarray, contexts: np.ndarray, parts: int) -> np.ndarray:
    """Partitions of cells: a word's are in an eighth of them at most, by its contexts, so that a frequent
    word's cells are no burden on one and a word is not held in all."""
    salt = mix(contexts + START) % U(max(1, parts // 8))
    return ((pair_keys(words, salt) >> U(24)) % U(parts)).astype(np.uint32)


def _row(schema: list, values: tuple):
    """A record batch of one row; arrays go as their bytes."""
    import pyarrow as pa

    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    columns = [pa.array([v.tobytes() if isinstance(v, np.ndarray) else v], kinds[k]) for (_, k), v in zip(schema, values)]
    return pa.RecordBatch.from_arrays(columns, [n for n, _ in schema])


def planes(x: np.ndarray) -> np.ndarray:
    """The first bytes of all numbers, then the second ones and so on: small numbers then pack well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T)


def numbers_of(raw, kind) -> np.ndarray:
    kind = np.dtype(kind)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()


def rising(x: np.ndarray) -> np.ndarray:
    """Planes of the steps between sorted hashes."""
    return planes(np.diff(x, prepend=U(0)))


def risen(raw) -> np.ndarray:
    return np.cumsum(numbers_of(raw, U), dtype=U)


def _schema(text: str) -> list:
    return [tuple(x.split()) for x in text.split(", ")]


def _rows(batches):
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


def save(folder: str, name: str, *arrays: np.ndarray) -> str:
    """A new file of the shared folder with these arrays; a repeated task writes one of its own."""
    import uuid

    import pyarrow as pa

    fs, base = filesystem(folder)
    path = f"{base}/{name}-{uuid.uuid4().hex}"
    batch = pa.RecordBatch.from_arrays([pa.array([planes(a).tobytes()], pa.large_binary()) for a in arrays], [str(k) for k in range(len(arrays))])
    with fs.open_output_stream(path, compression=None) as out, pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return path


def load(folder: str, path: str, *kinds) -> list[np.ndarray]:
    import pyarrow as pa

    with filesystem(folder)[0].open_input_stream(path, compression=None) as file:
        batch = pa.ipc.open_stream(file).read_next_batch()
    return [numbers_of(column[0].as_buffer(), kind) for column, kind in zip(batch.columns, kinds)]


def _bits(starts: np.ndarray) -> np.ndarray:
    return np.packbits(starts)


def _numbers(bits, n: int) -> np.ndarray:
    """Of n places in order the number of the group that each is in, by marks of groups' starts."""
    return np.cumsum(np.unpackbits(np.frombuffer(bits, np.uint8), count=n)) - 1


def _changes(*columns) -> np.ndarray:
    """Where rows differ from the row before."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


_DEALT = "part int, run string, words binary, starts binary, contexts binary, at binary, n binary"
_SENT = "to int, part int, cells string, state string, words binary, sent binary, contexts binary, tables binary, counts binary, customers binary"
_TOLD = "to int, part int, cells string, state string, sent binary, seated binary, tables binary, counts binary, customers binary"


def deal(docs: DataFrame, parts: int, folder: str) -> DataFrame:
    """For each partition of cells and run of texts a row with the run's cells there, in order of
    word and context: the words, where each begins, the contexts, which of them each cell has,
    and training tokens. A run's documents and the cells of its tokens are in its file."""

    def scan(batches):
        held: list = []
        size = 0

        def told():
            if not held:
                return
            ids, train, sizes, tokens, contexts = (np.concatenate([h[k] for h in held]) for k in range(5))
            held.clear()
            known = np.repeat(train, sizes)
            part = places(tokens, contexts, parts)
            order = np.lexsort((contexts, tokens, part))
            tokens, contexts, part = tokens[order], contexts[order], part[order]
            new = _changes(tokens, contexts)
            number = np.cumsum(new) - 1
            place = np.empty(len(order), np.uint32)
            place[order] = number
            n = np.bincount(number, known[order]).astype(np.uint32)
            path = save(folder, "run", ids, train, sizes, place)
            tokens, contexts, part = tokens[new], contexts[new], part[new]
            del order, number, place, known, new
            cuts = np.searchsorted(part, np.arange(parts + 1))
            for p in range(parts):
                own = slice(cuts[p], cuts[p + 1])
                if own.start < own.stop:
                    starts = _changes(tokens[own])
                    table, at = np.unique(contexts[own], return_inverse=True)
                    yield _row(schema, (p, path, rising(tokens[own][starts]), _bits(starts), rising(table), at.astype(np.uint16 if len(table) <= 1 << 16 else np.uint32), n[own]))

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            train = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for first, last, tokens, contexts, offsets in tokens_of(batch.column(1).to_pylist()):
                held.append((ids[first:last], train[first:last], np.diff(offsets), tokens, contexts))
                size += len(tokens)
                if size > GATHER:
                    yield from told()
                    size = 0
        yield from told()

    schema = _schema(_DEALT)
    return docs.select("doc_id", "text", "train").mapInArrow(lean(scan), _DEALT)


def _owners(keys: np.ndarray, parts: int):
    """Order of keys by their owner, and where each owner's begin."""
    to = ((mix(keys) >> U(24)) % U(parts)).astype(np.uint32)
    order = np.argsort(to, kind="stable")
    return order, np.searchsorted(to[order], np.arange(parts + 1))


def _messages(p: int, path: str, state: str, parts: int, words, contexts, sent, tables, counts, customers):
    """Rows of a partition to the owners of its words and contexts."""
    schema, none = _schema(_SENT), np.zeros(0, np.int64)
    by_word, w = _owners(words, parts)
    by_context, c = _owners(contexts, parts)
    for q in range(parts):
        own, other = by_word[w[q] : w[q + 1]], by_context[c[q] : c[q + 1]]
        if len(own) or len(other):
            yield _row(schema, (q, p, path, state, rising(words[own]), sent[own], rising(contexts[other]), tables[other], none if counts is None else counts[own], none if customers is None else customers[other]))


def _sum(at, values, n: int) -> np.ndarray:
    return np.bincount(at, values, n).astype(np.int64)


def gathered(dealt: DataFrame, parts: int, folder: str) -> DataFrame:
    """Writes each partition's cells, and where those of each run are among them; returns the
    first sums: one table for each cell with customers."""

    def scan(batches):
        held: dict[int, list] = {}
        for p, *row in _rows(batches):
            held.setdefault(p, []).append(row)
        for p, rows in held.items():
            runs, words, contexts, n = [], [], [], []
            while rows:
                run, w, starts, table, at, count = rows.pop()
                n.append(np.frombuffer(count, np.uint32))
                table = risen(table)
                words.append(risen(w)[_numbers(starts, len(n[-1]))])
                contexts.append(table[np.frombuffer(at, np.uint16 if len(table) <= 1 << 16 else np.uint32)])
                runs.append(run)
            sizes = np.array([len(x) for x in n], np.int64)
            words, contexts, n = np.concatenate(words), np.concatenate(contexts), np.concatenate(n)
            order = np.lexsort((contexts, words))
            words, contexts = words[order], contexts[order]
            new = _changes(words, contexts)
            number = np.cumsum(new) - 1
            customers = _sum(number, n[order], int(number[-1]) + 1)
            place = np.empty(len(order), np.int64)
            place[order] = number
            del order, number, n
            # A run's cells are in this order too, so steps between them are small.
            steps = np.diff(place, prepend=0)
            words, contexts = words[new], contexts[new]
            starts = _changes(words)
            table, at = np.unique(contexts, return_inverse=True)
            word = np.cumsum(starts) - 1
            path = save(f"{folder}/cells", "cells", words[starts], _bits(starts), table, at.astype(np.uint32), customers, np.frombuffer("\n".join(runs).encode(), np.uint8), sizes, steps)
            first = np.minimum(customers, 1)
            words = words[starts]
            yield from _messages(p, path, "", parts, words, table, _sum(word, first, len(words)), _sum(at, first, len(table)), _sum(word, customers, len(words)), _sum(at, customers, len(table)))

    return dealt.repartitionById(parts, F.col("part")).mapInArrow(lean(scan), _SENT)


def answered(sent: DataFrame, parts: int, sweep: int, root: float) -> DataFrame:
    """Owners' answers: sums for the words and contexts that a partition has sent, in the order
    sent, and tables of words at the parent; to -1 the totals of customers and tables there, and of
    words in training."""

    def scan(batches):
        held: dict[int, list] = {}
        for q, *row in _rows(batches):
            held.setdefault(q, []).append(row)
        schema, numbers = _schema(_TOLD), stirling(PARENT_DISCOUNT, EXACT)
        for q, rows in held.items():
            got = {k: [risen(r[k]) if k in (3, 5) else np.frombuffer(r[k], np.int64) for r in rows] for k in range(3, 9)}
            words, at = np.unique(np.concatenate(got[3]), return_inverse=True)
            contexts, at_context = np.unique(np.concatenate(got[5]), return_inverse=True)
            customers = _sum(at, np.concatenate(got[4]), len(words))
            seated = np.minimum(customers, 1) if not sweep else sample_tables(customers, np.full(len(words), root), PARENT_DISCOUNT, numbers, chances(words, sweep)).astype(np.int64)
            tables = _sum(at_context, np.concatenate(got[6]), len(contexts))
            counts, everyone = np.concatenate(got[7]), np.concatenate(got[8])
            counts, everyone = (_sum(at, counts, len(words)), _sum(at_context, everyone, len(contexts))) if not sweep else (None, None)
            totals = np.array([customers.sum(), seated.sum(), 0 if sweep else (counts > 0).sum(), 0 if sweep else counts.sum()], np.int64)
            none = np.zeros(0, np.int64)
            yield _row(schema, (-1, -1, "", "", totals, none, none, none, none))
            x = y = 0
            for k, (p, path, state, *_) in enumerate(rows):
                own, other = at[x : x + len(got[3][k])], at_context[y : y + len(got[5][k])]
                x, y = x + len(own), y + len(other)
                yield _row(schema, (p, q, path, state, customers[own], seated[own], tables[other], none if sweep else counts[own], none if sweep else everyone[other]))

    return sent.repartitionById(parts, F.col("to")).mapInArrow(lean(scan), _TOLD)


_SCORED = "part int, run string, score binary, n binary"


def swept(told: DataFrame, parts: int, folder: str, sweep: int, totals: tuple) -> DataFrame:
    """Partitions' sums after one more sweep; behind the last one, for each run the scores of
    the cells that it has sent, log10 of the averaged predictive probabilities, and their words' counts."""
    all_sent, all_tables, base = totals
    last = sweep == BURN + SAMPLES

    def scan(batches):
        held: dict[int, list] = {}
        for p, *row in _rows(batches):
            held.setdefault(p, []).append(row)
        numbers, schema = stirling(DISCOUNT, EXACT), _schema(_SCORED)
        for p, rows in held.items():
            # Owners in order are the order in which the keys were sent.
            rows.sort(key=lambda r: r[0])
            path, state = rows[0][1:3]
            back = [np.concatenate([np.frombuffer(r[k], np.int64) for r in rows]) for k in range(3, 8)]
            rows.clear()
            words, starts, contexts, at, customers, runs, sizes, steps = load(folder, path, U, np.uint8, U, np.uint32, np.int64, np.uint8, np.int64, np.int64)
            word = _numbers(starts, len(at))
            by_word, by_context = _owners(words, parts)[0], _owners(contexts, parts)[0]

            def placed(values, order):
                out = np.empty(len(order), np.int64)
                out[order] = values
                return out

            sent, seated, sums = placed(back[0], by_word), placed(back[1], by_word), placed(back[2], by_context)
            if sweep:
                tables, total, counts, everyone = load(folder, state, np.int64, np.float32, np.int64, np.int64)
            else:
                tables, total, counts, everyone = np.minimum(customers, 1), np.zeros(len(at), np.float32), placed(back[3], by_word), placed(back[4], by_context)
            new = (STRENGTH + DISCOUNT * sums)[at] * at_parent(sent, seated, all_sent, all_tables, base)[word]
            if sweep > BURN:
                total = (total + (customers - DISCOUNT * tables + new) / (STRENGTH + everyone)[at]).astype(np.float32)
            if not last:
                tables = sample_tables(customers, new, DISCOUNT, numbers, chances(pair_keys(words[word], contexts[at]), sweep + 1)).astype(np.int64)
                del new
                state = save(f"{folder}/state-{sweep}", "state", tables, total, counts, everyone)
                yield from _messages(p, path, state, parts, words, contexts, _sum(word, tables, len(words)), _sum(at, tables, len(contexts)), None, None)
                continue
            score, seen, upto, begin = np.log10(total / np.float32(SAMPLES)), counts[word], np.cumsum(steps), 0
            for run, n in zip(runs.tobytes().decode().split("\n"), sizes.tolist()):
                cells = upto[begin : begin + n]
                begin += n
                yield _row(schema, (p, run, score[cells], seen[cells]))

    made = told.where("to >= 0").repartitionById(parts, F.col("to"))
    return made.mapInArrow(lean(scan), _SCORED if last else _SENT)


def summed(scored: DataFrame, parts: int, folder: str, below: float) -> DataFrame:
    """Sums of each document of each run."""
    kind = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"

    def scan(batches):
        from itertools import groupby

        import pyarrow as pa

        for run, rows in groupby(_rows(batches), key=lambda r: r[1]):
            found = [(np.frombuffer(score, np.float32), np.frombuffer(n, np.int64)) for _, _, score, n in rows]
            score, n = (np.concatenate([f[k] for f in found]) for k in (0, 1))
            ids, train, sizes, place = load(folder, run, np.int64, bool, np.int64, np.uint32)
            starts = np.cumsum(sizes) - sizes
            add = [np.add.reduceat(x[place], starts) for x in ((n > 0).astype(np.int64), np.log10((n + 1) / below), score.astype(np.float64))]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids, ~train, sizes, *add)], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    # Cells of a run are numbered by partition, so its answers in that order are all of them.
    return scored.repartition(4 * parts, "run").sortWithinPartitions("run", "part").mapInArrow(lean(scan), kind)


def language_scores(docs: DataFrame, train) -> DataFrame:
    """One row per distinct doc_id: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score and perplexity (by the model, per token).

    `train` is a boolean column that says which documents the model learns from. Null
    texts are empty: their one token is the end. Rows that repeat a doc_id with its text
    give one row; with different texts, sums and counts are the mean of theirs. Rows
    without a doc_id are left out, since sums are gathered by it. Extra columns are
    ignored. Without training tokens every probability is the base distribution's."""
    spark = docs.sparkSession
    folder = work_dir(spark, "lm")
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(train, F.lit(False)).alias("train"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // PART_BYTES))
    fs, base = filesystem(folder)
    for name in ("cells", *(f"state-{k}" for k in range(BURN + SAMPLES))):
        fs.create_dir(f"{base}/{name}", recursive=True)
    with batch_rows(spark, WIDE_ROWS):
        sent = store(gathered(deal(rows, parts, folder), parts, folder), folder, "sent-0")
        remove(spark)
        root, uniform, trained, vocabulary = 0.0, 1.0, 0, 0
        for sweep in range(1 + BURN + SAMPLES):
            told = store(answered(sent, parts, sweep, root), folder, f"told-{sweep}")
            remove(spark, f"{folder}/sent-{sweep}")
            totals = sum((np.frombuffer(bytes(r.sent), np.int64) for r in told.where("to < 0").select("sent").collect()), np.zeros(4, np.int64)).tolist()
            if not sweep:
                vocabulary, trained = totals[2:]
                uniform = 1.0 / (vocabulary + 1)
            root = (PARENT_STRENGTH + PARENT_DISCOUNT * totals[1]) * uniform
            made = swept(told, parts, folder, sweep, (totals[0], totals[1], uniform))
            if sweep < BURN + SAMPLES:
                sent = store(made, folder, f"sent-{sweep + 1}")
                remove(spark, f"{folder}/told-{sweep}", *([f"{folder}/state-{sweep - 1}"] if sweep else []))
        each = store(summed(made, parts, folder, trained + vocabulary + 1), folder, "documents")
    remove(spark, *(f"{folder}/{name}" for name in ("cells", f"told-{sweep}", f"state-{sweep - 1}")))
    # Sums of an id's rows are rounded, so that they don't depend on the order of the tasks.
    means = [F.round(F.avg(c)).cast("long").alias(c) for c in ("n_tokens", "n_known")] + [F.round(F.avg(c), 9).alias(c) for c in ("base_score", "score")]
    found = each.groupBy("doc_id").agg(F.max("held_out").alias("held_out"), *means)
    perplexity = F.pow(F.lit(10.0), F.least(-F.col("score") / F.col("n_tokens"), F.lit(300.0)))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(trained).cast("long").alias("train_tokens"), "base_score", "score", perplexity.alias("perplexity"))


def language_model_scores(docs: DataFrame) -> DataFrame:
    """Scores of all documents, learned from those whose crc32 of the id as text leaves
    another remainder than 2 when divided by 7."""
    return language_scores(docs, F.crc32(F.col("doc_id").cast("string")) % 7 != 2)


__all__ = ["Seating", "language_model_scores", "language_scores", "sample_tables", "stirling"]
