"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

An item's windows are the sets to be contained: 13 consecutive words, or the whole of
a shorter item. A window's tokens are its shingles of SHINGLE words (fewer in a shorter
window), ordered by how rare they are in the corpus. Containment asks for all of them, so one
is a sufficient prefix, and the rarest is the one that produces the fewest candidates.
Documents are joined with the windows on that token alone; its position in the window then
bounds where the window must begin (not before the document, nor with its end behind it),
and the candidate is verified word by word over as many words as the window has.

Whether a text is contaminated follows from the text alone, so hits are gathered by a
128-bit hash of the text: copies are judged once, and rows that share a doc_id are not mixed up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skriba.llm.shared import remove, store, work_dir

WINDOW, SHINGLE = 13, 3
#: Bytes of windows that may be broadcast; beyond it candidates are shuffled.
BROADCAST_BYTES = 32 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII but a-z and 0-9, behind the folding of A-Z.
GAPS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words_of(text):
    """Words of a text: A-Z folded, runs of a-z, 0-9 and all beyond ASCII; null has none.

    A leading gap is cut off first, so that the only empty piece of the split is that
    of a text without words, which array_remove drops."""
    folded = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(folded, GAPS), "")


def windows_of(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (window_id, words) and the items that have them (window_id, item_id).

    Items without words have no window; repeated items and windows count once."""
    items = benchmark.where("item_id IS NOT NULL").select("item_id", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(WINDOW))
    starts = items.select("item_id", "w", length.alias("n"), F.explode(F.sequence(F.lit(1), F.size("w") - length + 1)).alias("at"))
    spread = starts.select("item_id", F.slice("w", F.col("at"), F.col("n")).alias("words"))
    named = spread.withColumn("window_id", F.sha2(F.array_join("words", " "), 256))
    return named.groupBy("window_id").agg(F.first("words").alias("words")), named.select("window_id", "item_id").distinct()


def token_at(words, at, n: int):
    """Hash of the n words from place `at` on (0 the first); a verified match compares words."""
    return F.xxhash64(*[F.get(words, at + k) for k in range(n)])


def spread_tokens(texts: DataFrame, lengths: list[int]) -> DataFrame:
    """Every place of every text with its token: the columns of `texts` (w: the words), pos,
    n (words of the token) and token."""
    at = texts.select("*", F.posexplode("w").alias("pos", "_word"))
    if len(lengths) == 1:
        n = lengths[0]
        out = at.withColumns({"n": F.lit(n), "token": token_at(F.col("w"), F.col("pos"), n)})
    else:
        each = [F.struct(F.lit(n).alias("n"), token_at(F.col("w"), F.col("pos"), n).alias("token")) for n in lengths]
        out = at.withColumn("_t", F.explode(F.array(*each))).withColumns({"n": F.col("_t.n"), "token": F.col("_t.token")}).drop("_t")
    return out.where(F.col("pos") + F.col("n") <= F.size("w")).drop("_word")


def window_tokens(windows: DataFrame, lengths: list[int]) -> DataFrame:
    """window_id, words, pos, n and token: those tokens of a window that may be its prefix."""
    spread = spread_tokens(windows.select("window_id", "words", F.col("words").alias("w")), lengths)
    return spread.where(F.col("n") == F.least(F.size("words"), F.lit(SHINGLE))).drop("w")


def prefixes_of(texts: DataFrame, windows: DataFrame, lengths: list[int], small: bool) -> DataFrame:
    """Each window's prefix: its token that is rarest in the corpus (ties by the first place).
    Windows with a token that the corpus does not hold are in no text."""
    tokens = window_tokens(windows, lengths)
    vocabulary = tokens.select("n", "token").distinct()
    met = spread_tokens(texts, lengths).select("n", "token").join(F.broadcast(vocabulary) if small else vocabulary, ["n", "token"], "left_semi")
    counts = met.groupBy("n", "token").agg(F.count("*").alias("times"))
    best = tokens.join(counts, ["n", "token"], "left").groupBy("window_id", "words").agg(F.min(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "pos", "n", "token")).alias("b"))
    return best.where("b.times > 0").select("window_id", "words", F.size("words").alias("length"), "b.n", "b.token", F.col("b.pos").alias("offset"))


def occurrences(texts: DataFrame, prefixes: DataFrame, lengths: list[int], small: bool, folder: str) -> DataFrame:
    """All places of windows in texts: k1, k2, window_id, start (from 0), length."""
    place = ["k1", "k2", "window_id", "start", "length"]
    verified = F.slice("w", F.col("start") + 1, F.col("length")) == F.col("words")
    inside = (F.col("start") >= 0) & (F.col("start") + F.col("length") <= F.col("size"))
    spread = spread_tokens(texts.withColumn("size", F.size("w")), lengths)
    if small:
        # One pass: the text's words stay a reference until a candidate is verified.
        near = spread.join(F.broadcast(prefixes), ["n", "token"]).withColumn("start", F.col("pos") - F.col("offset"))
        return near.where(inside).where(verified).select(place)
    # Windows beyond a broadcast: shuffle (text's hash, place, token) only, then fetch the
    # texts that have candidates, each once.
    near = spread.select("k1", "k2", "size", "pos", "n", "token").join(prefixes.drop("words"), ["n", "token"]).withColumn("start", F.col("pos") - F.col("offset"))
    near = store(near.where(inside).select(place).distinct(), folder, "near")
    ids = store(near.select("k1", "k2").distinct(), folder, "near-ids")
    words = texts.join(ids, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.first("w").alias("w"))
    return near.join(prefixes.select("window_id", "words"), "window_id").join(words, ["k1", "k2"]).where(verified).select(place)


def text_key(text):
    """A 128-bit hash of a text, as two columns; null is a text of its own without words."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("second"), text).alias("k2")]


def judged_texts(docs: DataFrame, benchmark: DataFrame, folder: str) -> DataFrame:
    """One row per text with hits: k1, k2, n_hit, items (its items' ids as sorted strings)."""
    windows, owners = windows_of(benchmark)
    windows = store(windows, folder, "windows")
    told = windows.agg(F.sum(F.length(F.array_join("words", " ")) + 8 * F.size("words") + 100), F.collect_set(F.least(F.size("words"), F.lit(SHINGLE)))).first()
    # The only choice made by size: whether the windows' bytes allow a broadcast. Results agree.
    small, lengths = (told[0] or 0) <= BROADCAST_BYTES, sorted(told[1]) or [SHINGLE]
    texts = docs.select(*text_key(F.col("text")), words_of(F.col("text")).alias("w"))
    prefixes = store(prefixes_of(texts, windows, lengths, small), folder, "prefixes")
    found = store(occurrences(texts, prefixes, lengths, small, folder).distinct(), folder, "found")
    # Covered words: each start reaches as far as its longest window; overlaps count once.
    reach = found.groupBy("k1", "k2", "start").agg(F.max(F.col("start") + F.col("length")).alias("stop"))
    before = Window.partitionBy("k1", "k2").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    fresh = reach.withColumn("from", F.greatest("start", F.coalesce(F.max("stop").over(before), F.lit(0))))
    hits = fresh.groupBy("k1", "k2").agg(F.sum(F.greatest(F.lit(0), F.col("stop") - F.col("from"))).cast("long").alias("n_hit"))
    pairs = found.select("k1", "k2", "window_id").distinct().join(owners, "window_id").select("k1", "k2", "item_id").distinct()
    named = pairs.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.col("item_id").cast("string"))).alias("items"))
    return store(hits.join(named, ["k1", "k2"]), folder, "hits")


def contaminated(n_hit, n_words):
    return (n_hit > 0) & (20 * n_hit >= n_words)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated, and items (the sorted item ids as strings).

    A word is hit inside any occurrence of a window; a document is contaminated if it
    has a hit and 20 * n_hit >= n_words. Texts that are null or have no words have no
    hits; very long texts are taken whole. Every row is judged by its own text, so rows that repeat a
    doc_id may differ, and a null doc_id is returned as null. Repeated items and windows count
    once, items without an id or without words not at all. Extra columns are ignored; an
    empty benchmark hits nothing, an empty table gives an empty result."""
    folder = work_dir(docs.sparkSession, "decontam")
    told = judged_texts(docs, benchmark, folder)
    sizes = docs.select("doc_id", *text_key(F.col("text")), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    joined = sizes.join(told, ["k1", "k2"], "left")
    return joined.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), contaminated(n_hit, F.col("n_words")).alias("contaminated"), items.alias("items"))


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of `docs` whose text is not contaminated, all columns as they are, whatever their
    names; null texts, repeated rows and rows without a doc_id are judged by their text like
    all others. An empty benchmark or table takes nothing away."""
    spark = docs.sparkSession
    folder, kept = work_dir(spark, "decontam"), work_dir(spark, "decontam-result")
    told = judged_texts(docs, benchmark, folder)
    keyed = docs.select(F.struct("*").alias("row"), *text_key(F.col("text")))
    # Words are counted again only in texts with hits.
    sized = keyed.join(told.select("k1", "k2", "n_hit"), ["k1", "k2"]).select("k1", "k2", "n_hit", F.size(words_of(F.col("row.text"))).alias("n_words"))
    bad = store(sized.where(contaminated(F.col("n_hit"), F.col("n_words"))).select("k1", "k2").distinct(), kept, "contaminated")
    remove(spark, folder)
    return keyed.join(bad, ["k1", "k2"], "left_anti").select("row.*")


__all__ = ["clean_documents", "decontaminate", "judged_texts", "windows_of", "words_of"]
