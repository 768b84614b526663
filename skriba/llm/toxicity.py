"""Toxicity by a weighted finite-state pattern grammar over clauses.

A clause is read as a row of symbols (insult, threat, target, negation, report, quote; all
other words are silent but count). Five transducers rewrite it one after the other: reported
speech marks what follows a reporting verb or stands inside quotation marks; negation marks
what stands behind it, and a second one undoes the first; target, threat and insult remember
what was met, a threat being made only in a clause that has its target. They are
composed once into one machine, whose state after the last word says whether the clause
matched. A matched clause adds the weights of its insults and threats to their readings:
bare, at a target, negated or reported. A document's features are its clauses' weights by
reading; a logistic model over them gives the score. Words that match no clause count for
nothing.

The insult entries (whole words, and stems that any ending may follow) and all weights are
learned from labelled rows; targets, negations, reporting verbs and threats are closed
classes.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import ArrowUDFType

from skriba.llm.shared import batch_rows, driver_rows, lean

# Closed word classes in English, German, French and Spanish.
TARGETS = "you your yours he she they him her them his their du dich dir dein deine ihr euch sie er tu toi vous votre ta ton il elle ils elles lui tú tu usted ustedes vosotros él ella ellos".split()
NEGATIONS = "not no never nobody nor neither isn't aren't wasn't don't doesn't nicht kein keine keinen nie niemals niemand ne pas jamais aucun aucune ni personne nunca jamás ningún ninguna nadie tampoco".split()
REPORTS = "said says say saying called calls quoted claimed wrote asked sagte sagt sagen nannte nennt schrieb zitiert behauptet dit disait disent appelle appelé écrit cite dijo dice dicen llamó llama escribió cita".split()
THREATS = {"kill": 1.0, "murder": 1.0, "stab": 0.8, "strangle": 1.0, "töten": 1.0, "umbringen": 1.0, "erwürgen": 1.0, "tuer": 1.0, "étrangler": 1.0, "matar": 1.0, "asesinar": 1.0, "estrangular": 1.0}
READINGS = ("bare", "target", "negated", "reported")
#: What a clause counts in the sum over all readings, before its reading's own weight is learned.
PRIOR = (1.0, 1.2, 0.6, 0.6)
#: Words behind a negation that it reaches.
REACH = 6
#: Share of the toxic training rows that an insult entry must be met in, and rows at least.
LEAST_SHARE, LEAST_ROWS = 0.01, 3
#: Rows that the grammar is fitted on at most: those whose hashed ids come first.
TRAIN_ROWS = 20_000
#: Texts that a fitting worker gets at once.
BATCH_ROWS = 500
#: Insult entries kept at most, and letters of a stem.
MAX_ENTRIES, STEM_LETTERS = 2_000, (4, 5, 6, 7)
#: A document is rejected from this score on.
REJECT = 0.7
CLAUSE_END = re.compile(r"[.!?;:\n]")
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
QUOTES = "\"\u201c\u201d\u201e\u00ab\u00bb"
TOKEN = re.compile(rf"{WORD.pattern}|[{QUOTES}]")
MATCHES = ("insult", "threat")


def _slices(batches):
    """Batches of BATCH_ROWS rows at most, whatever the session's setting."""
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(at, BATCH_ROWS)


def training_rows(labels: DataFrame, rows: int = TRAIN_ROWS) -> list[tuple[int, int]]:
    """(doc_id, toxic) of the training fold: crc32 of the id as text modulo 3 is not 1.
    At most `rows` of them, by the order of a hash of their ids."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return [(r.doc_id, r.toxic) for r in known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect()]


def _features_of(text: str) -> set[str]:
    """Words of a text and their stems; a stem ends with a star."""
    words = set(WORD.findall(text.lower()))
    return words | {w[:k] + "*" for w in words for k in STEM_LETTERS if len(w) > k}


def _least_run(text: str) -> int:
    """The least hash of three words in a row: near copies mostly share it."""
    import zlib

    words = WORD.findall(text.lower())
    return min((zlib.crc32(" ".join(words[k : k + 3]).encode()) for k in range(max(1, len(words) - 2))), default=0)


def learn_insults(texts: DataFrame) -> dict[str, float]:
    """Insult entries with their weights from (text, toxic) rows: words and stems that
    are far more frequent in toxic documents than chance allows, weighed by their
    smoothed log odds. The counts are summed in Spark; what comes to the driver are the entries
    that toxic rows hold often enough, their counts, and which of those kept each toxic row
    holds: all bounded by TRAIN_ROWS rows and LEAST_SHARE."""
    total = {r.toxic: r.n for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = total.get(1, 0), total.get(0, 0)
    if not bad or not good:
        return {}

    least = max(LEAST_ROWS, LEAST_SHARE * bad)

    def counted(rows, wanted):
        def count(batches):
            from collections import Counter

            import pyarrow as pa

            for batch in batches:
                n: Counter = Counter()
                for text in batch.column(0).to_pylist():
                    met = _features_of(text or "")
                    n.update(met if wanted is None else met & wanted)
                yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["entry", "n"])

        return rows.select("text").mapInArrow(lean(count), "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n"))

    # Only what toxic texts hold often enough is looked for in the others.
    pos = {r.entry: r.n for r in counted(texts.where("toxic = 1"), None).where(F.col("n") >= least).collect()}
    neg = {r.entry: r.n for r in counted(texts.where("toxic = 0"), frozenset(pos)).collect()}
    # An entry's log odds must be over 2 and 2.5 of their standard errors, and it may be met
    # once in other texts for every five times in toxic ones.
    strong = []
    for entry, n in pos.items():
        m = neg.get(entry, 0)
        w = math.log((n + 0.5) / (bad + 1)) - math.log((m + 0.5) / (good + 1))
        if m * 5 <= n and w > 2.0 and w > 2.5 * math.sqrt(1 / (n + 0.5) + 1 / (m + 0.5)):
            strong.append((-w * math.sqrt(n), entry, w, n))
    found = [(entry, w, n) for _, entry, w, n in sorted(strong)[:MAX_ENTRIES]]
    # Of a stem and a longer entry below it that is met as often, the longer one says more;
    # below a stem that is kept, a longer entry adds nothing.
    longer: dict[str, int] = {}
    for entry, _, n in found:
        for k in STEM_LETTERS:
            if k < len(entry.rstrip("*")):
                longer[entry[:k] + "*"] = max(n, longer.get(entry[:k] + "*", 0))
    weights = {entry: w for entry, w, n in found if longer.get(entry, 0) < 0.98 * n}
    weights = {e: w for e, w in weights.items() if not any(e[:k] + "*" in weights for k in STEM_LETTERS if k < len(e.rstrip("*")))}
    order = list(weights)

    def incidence(batches):
        import pyarrow as pa

        at = {e: k for k, e in enumerate(order)}
        for batch in batches:
            texts = batch.column(0).to_pylist()
            got = [sorted(at[f] for f in _features_of(t or "") if f in at) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.list_(pa.int32())), pa.array([_least_run(t or "") for t in texts], pa.int64())], ["entries", "run"])

    # Copies of one toxic text make all of its words stand out. So an entry must be met in
    # texts of which most differ by their least run of three words; or, the strongest
    # entries going first, in enough texts that fewer than two others have explained.
    rows: dict[int, list[int]] = {}
    met = texts.where("toxic = 1").select("text").mapInArrow(lean(incidence), "entries array<int>, run long").collect()
    for k, r in enumerate(met):
        for e in r.entries:
            rows.setdefault(e, []).append(k)
    explained, kept = np.zeros(len(met), int), {}
    runs = np.array([r.run for r in met])
    for k, e in enumerate(order):
        own = np.array(rows.get(k, []), int)
        if len(np.unique(runs[own])) >= max(least, 0.6 * len(own)) or (explained[own] < 2).sum() >= least:
            kept[e] = weights[e]
            explained[own] += 1
    return kept


class Transducer:
    """A deterministic transducer over symbols: `arcs` {(state, symbol): (state, symbol)};
    without an arc a symbol passes through and the state stays. `ends` {state: mark} says what a
    clause that ends in a state has matched."""

    def __init__(self, arcs: dict, ends: dict | None = None, start=0):
        self.arcs, self.ends, self.start = arcs, ends or {}, start

    def step(self, state, symbol):
        return self.arcs.get((state, symbol), (state, symbol))

    def marks(self, state) -> frozenset:
        return frozenset([self.ends[state]] if state in self.ends else [])


class Composed(Transducer):
    """`first` and then `second` as one machine over the alphabet, its states numbered."""

    def __init__(self, first: Transducer, second: Transducer, alphabet):
        numbers, arcs, open_ = {(first.start, second.start): 0}, {}, [(first.start, second.start)]
        while open_:
            a, b = open_.pop()
            for x in alphabet:
                a2, y = first.step(a, x)
                b2, z = second.step(b, y)
                if (a2, b2) not in numbers:
                    numbers[a2, b2] = len(numbers)
                    open_.append((a2, b2))
                arcs[numbers[a, b], x] = numbers[a2, b2], z
        super().__init__(arcs)
        self._marks = {k: first.marks(a) | second.marks(b) for (a, b), k in numbers.items()}

    def marks(self, state) -> frozenset:
        return self._marks[state]


SYMBOLS = ("word", "insult", "threat", "target", "negation", "report", "quote")


def reported_speech() -> Transducer:
    """State 0: own words; 1: inside quotation marks; 2: behind a reporting verb; 3: both."""
    arcs: dict = {}
    for state in range(4):
        arcs[state, "quote"] = state ^ 1, "word"
        arcs[state, "report"] = state | 2, "word"
        for m in MATCHES:
            arcs[state, m] = state, f"{m}/reported" if state else m
    return Transducer(arcs)


def negation() -> Transducer:
    """The state counts the words that a negation still reaches."""
    arcs: dict = {}
    for left in range(REACH + 1):
        for x in ("word", "target", *MATCHES, *(f"{m}/reported" for m in MATCHES)):
            arcs[left, x] = max(0, left - 1), f"{x}/negated" if left and x in MATCHES else x
        arcs[left, "negation"] = 0 if left else REACH, "word"
    return Transducer(arcs)


def _seen(symbols, mark) -> Transducer:
    """Remembers that one of the symbols was met."""
    return Transducer({(state, x): (1, x) for state in (0, 1) for x in symbols}, {1: mark})


def _all(match: str) -> list[str]:
    return [match, f"{match}/reported", f"{match}/negated"]


def target() -> Transducer:
    return _seen(["target"], "targeted")


def threat() -> Transducer:
    """State 1: a target was met, 2: a threat, 3: both, which makes it one."""
    arcs = {(state, x): (state | 2, x) for state in range(4) for x in _all("threat")}
    return Transducer(arcs | {(state, "target"): (state | 1, "target") for state in range(4)}, {3: "threat"})


def insult() -> Transducer:
    return _seen(_all("insult"), "insult")


def composed() -> Transducer:
    """All five as one machine."""
    machine = reported_speech()
    for following in (negation(), target(), threat(), insult()):
        machine = Composed(machine, following, SYMBOLS)
    return machine


class Grammar:
    """The composed transducers and their entries. `weights` is the logistic model over the
    readings, its last entry the bias; None before it is fitted."""

    def __init__(self, insults: dict[str, float], weights=None):
        self.insults, self.weights = insults, weights
        self.closed = dict.fromkeys(TARGETS, "target") | dict.fromkeys(NEGATIONS, "negation") | dict.fromkeys(REPORTS, "report") | dict.fromkeys(QUOTES, "quote")
        machine = composed()
        states = {k for k, _ in machine.arcs}
        self.table = [{x: machine.arcs[k, x] for x in SYMBOLS} for k in range(len(states))]
        self.matched = [machine.marks(k) for k in range(len(states))]

    def anchors(self):
        """Aho-Corasick automaton of all entries that can begin a match: by word, its weight as
        an insult or threat, whether any ending may follow, and which of the two it is."""
        import ahocorasick

        known: dict = {}
        for kind, entries in (("threat", THREATS), ("insult", self.insults)):
            for e, w in entries.items():
                word = e.rstrip("*")
                before = known.get(word, (0.0, False, kind))
                known[word] = max(w, before[0]), e.endswith("*") or before[1], kind
        found = ahocorasick.Automaton()
        for word, (w, open_end, kind) in known.items():
            found.add_word(word, (len(word), w, open_end, kind))
        found.make_automaton()
        return found

    def read(self, clause: str, hits: dict[int, tuple[float, str]], quoted: bool = False) -> list[float]:
        """Run a clause through the machine: the weights of its matches by reading, all 0 if it
        does not match. `hits` are (weight, kind) by the position where a word starts; `quoted`
        says whether the clause begins inside quotation marks."""
        state, met = 0, []
        if quoted:
            state, _ = self.table[state]["quote"]
        for m in TOKEN.finditer(clause):
            hit = hits.get(m.start())
            state, said = self.table[state][hit[1] if hit else self.closed.get(m[0], "word")]
            if hit:
                met.append((hit, said))
        marks, out = self.matched[state], [0.0] * len(READINGS)
        for (weight, kind), said in met:
            if kind in marks:
                reading = said.partition("/")[2] or ("target" if "targeted" in marks else "bare")
                out[READINGS.index(reading)] += weight
        return out

    def clauses(self, text: str | None, anchors) -> list[float]:
        """Weights of the matched clauses: their sum over all readings, then by reading,
        every clause and every sum saturating."""
        out = [0.0] * len(READINGS)
        if not text or not len(anchors):
            return [0.0, *out]
        low = text.lower()
        starts: dict[int, tuple[float, str]] = {}
        for last, (size, w, open_end, kind) in anchors.iter(low):
            at = last - size + 1
            if (at == 0 or not low[at - 1].isalpha()) and (open_end or last + 1 == len(low) or not low[last + 1].isalpha()):
                starts[at] = max((w, kind), starts.get(at, (0.0, kind)))
        order, k = sorted(starts), 0
        while k < len(order):
            at = order[k]
            before = max((low.rfind(c, 0, at) for c in ".!?;:\n"), default=-1)
            end = CLAUSE_END.search(low, at)
            done = end.start() if end else len(low)
            inside = {}
            while k < len(order) and order[k] < done:
                inside[order[k] - before - 1] = starts[order[k]]
                k += 1
            # Quotation marks reach over clauses, but not over lines.
            line = low[low.rfind("\n", 0, before + 1) + 1 : before + 1]
            quoted = sum(line.count(c) for c in QUOTES) % 2 == 1
            for r, weight in enumerate(self.read(low[before + 1 : done], inside, quoted)):
                out[r] += math.log1p(weight)
        return [math.log1p(x) for x in (sum(x * w for x, w in zip(out, PRIOR)), *out)]

    def score(self, features) -> float:
        z = float(np.dot(self.weights[:-1], features) + self.weights[-1])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Logistic regression by Newton steps. The sum over all readings and the bias are
    almost free; the readings' own weights are held towards zero, so that a reading
    with few training rows counts as PRIOR says."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.array([0.01] + [2.0] * (x.shape[1] - 2) + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9)
        step = np.clip(np.linalg.solve(hessian, gradient), -4, 4)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Grammar:
    """Learn the grammar from the training fold. Without toxic or without other labelled
    rows nothing is learned and every text scores as the share of toxic labels."""
    with batch_rows(docs.sparkSession, BATCH_ROWS):
        return _fit(docs, labels, rows)


def _fit(docs: DataFrame, labels: DataFrame, rows: int) -> Grammar:
    spark = docs.sparkSession
    known = training_rows(labels, rows)
    if not known:
        return Grammar({}, np.array([0.0] * (1 + len(READINGS)) + [-3.0]))
    table = F.broadcast(driver_rows(spark, known, "doc_id long, toxic int"))
    texts = docs.select("doc_id", "text").join(table, "doc_id").select("text", "toxic")
    grammar = Grammar(learn_insults(texts))

    def features(batches):
        import pyarrow as pa

        anchors = grammar.anchors()
        for batch in batches:
            got = [grammar.clauses(t, anchors) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], pa.float64()) for k in range(1 + len(READINGS))] + [batch.column(1)], ["clauses", *READINGS, "toxic"])

    schema = "clauses double, " + ", ".join(f"{r} double" for r in READINGS) + ", toxic int"
    got = texts.mapInArrow(lean(features), schema).collect()
    # In one order whatever the tasks': sums of floats then agree between runs.
    data = np.array(sorted(tuple(r) for r in got), float).reshape(-1, len(READINGS) + 2)
    share = (data[:, -1].sum() + 0.5) / (len(data) + 1)
    if not grammar.insults or not 0 < data[:, -1].sum() < len(data):
        return Grammar(grammar.insults, np.array([1.0] + [0.0] * len(READINGS) + [math.log(share / (1 - share))]))
    grammar.weights = fit_logistic(data[:, :-1], data[:, -1])
    return grammar


def toxicity(docs: DataFrame, labels: DataFrame, grammar: Grammar | None = None) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score, predicted, and the summed
    clause weights by reading.

    Null and empty texts have no clause and score by the bias alone. Only the text is
    an input of a score, so repeated rows and ties score alike; a null doc_id is returned as
    null and counts as held out; very long texts are read whole; extra columns are ignored,
    whatever their names; an empty table gives an empty result."""
    grammar = grammar or fit(docs, labels)

    def scores(batches):
        import pyarrow as pa

        anchors = grammar.anchors()
        for batch in _slices(batches):
            got = [grammar.clauses(t, anchors) for t in batch.column(1).to_pylist()]
            arrays = [batch.column(0), pa.array([grammar.score(g) for g in got], pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array([g[k] for g in got], pa.float64()) for k in range(1 + len(READINGS))], ["doc_id", "score", "clauses", *READINGS])

    schema = "doc_id long, score double, clauses double, " + ", ".join(f"{r} double" for r in READINGS)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(True))
    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(scores), schema)
    return rows.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= REJECT, 1).otherwise(0).alias("predicted"), "clauses", *READINGS)


def keep_civil(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of `docs` whose text scores below REJECT, all columns as they are.

    Null and empty texts score by the bias alone; repeated rows go or stay together; a row needs no
    doc_id; an empty table gives an empty result. Only texts go to the Python workers, and only a mark for each comes back."""
    grammar = fit(docs, labels)

    def civil(columns):
        import pyarrow as pa

        anchors = grammar.anchors()
        for column in columns:
            kept: list[bool] = []
            for at in range(0, len(column), BATCH_ROWS):
                kept.extend(grammar.score(grammar.clauses(t, anchors)) < REJECT for t in column.slice(at, BATCH_ROWS).to_pylist())
            yield pa.array(kept, pa.bool_())

    return docs.where(F.arrow_udf(lean(civil), "boolean", ArrowUDFType.SCALAR_ITER)("text"))


__all__ = ["Grammar", "fit", "keep_civil", "toxicity", "training_rows"]
