"""Loan-stem lexicons: loading, ranking, longest-prefix matching and conversion.

The match explodes each distinct word into its prefixes and joins them with the lexicon
by equality, then keeps the best entry: one hash join and one partial aggregate
instead of a nested loop. The lexicon is broadcast by Spark where its size allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skriba.functions.orthography import ALL, LETTER, all_caps, convert_suffix, convert_word, lower_first, raise_first, suffix_class, tokens

REQUIRED = ("cyrillic_stem", "latin_stem")
OPTIONAL = ("matched_russian_reading", "original_latin", "original_greek", "mode", "case_mode", "match_case", "source", "notes", "suffix_context", "url")
#: Allowed values and default of the columns that have a domain.
DOMAINS = {"mode": (("stem", "word"), "stem"), "case_mode": (("auto", "preserve"), "auto"), "match_case": (("any", "capitalized"), "any")}


def trimmed(column: Column) -> Column:
    """Without white space of any kind at the ends; blank becomes null."""
    return F.nullif(F.regexp_replace(column, "(?U)^\\s+|\\s+$", ""), F.lit(""))


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file: header names in any order and case, ragged rows allowed, quotes doubled
    inside quoted cells. A file without a header is an error."""
    table = spark.read.csv(path, header=True, escape='"', multiLine=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return normalise(table)


def lexicon_columns(rows: DataFrame) -> DataFrame:
    """The twelve columns of a lexicon file in their order; missing and null cells are blank, a blank
    match_case is written out."""
    names = (*REQUIRED, *OPTIONAL)
    out = rows.select(*[(F.coalesce(F.col(n).cast("string"), F.lit("")) if n in rows.columns else F.lit("")).alias(n) for n in names])
    return out.withColumn("match_case", F.coalesce(F.nullif(F.trim("match_case"), F.lit("")), F.lit("any")))


def write_lexicon(rows: DataFrame, path: str, mode: str = "error") -> None:
    """Write a lexicon as CSV files with a header; cells that need it are quoted, quotes doubled.
    Spark commits all files of a job together or none."""
    lexicon_columns(rows).write.mode(mode).csv(path, header=True, escape='"', emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_text(rows: DataFrame, column: str, path: str, mode: str = "error") -> None:
    """Write a text column, a line for each row."""
    rows.select(F.col(column).alias("value")).write.mode(mode).text(path)


def normalise(table: DataFrame) -> DataFrame:
    """All columns of a lexicon, trimmed, with defaults, and `problem`: why a row makes the
    lexicon invalid, else null. Rows without both keys are left out. Unknown columns
    are ignored; of columns that are the same but for case and blanks the last counts."""
    names = {}
    for k, name in enumerate(table.columns):
        names[name.strip().lower()] = k
    missing = [r for r in REQUIRED if r not in names]
    if missing:
        raise ValueError(f"the lexicon has no column {missing[0]}")
    table = table.toDF(*[f"_{k}" for k in range(len(table.columns))])
    out = table.select(*[(trimmed(F.col(f"_{names[n]}")) if n in names else F.lit(None).cast("string")).alias(n) for n in (*REQUIRED, *OPTIONAL)])
    problem = F.when(F.col("cyrillic_stem").isNull() | F.col("latin_stem").isNull(), "one key is blank")
    for name, (allowed, default) in DOMAINS.items():
        value = F.coalesce(F.lower(name), F.lit(default))
        problem = problem.when(~value.isin(*allowed), f"unknown {name}")
        out = out.withColumn(name, value)
    out = out.where("cyrillic_stem IS NOT NULL OR latin_stem IS NOT NULL")
    return out.withColumn("problem", problem).withColumn("cyrillic_stem", F.lower("cyrillic_stem"))


def valid(lexicon: DataFrame) -> DataFrame:
    """The lexicon, or an error at run time if any row has a problem."""
    checked = F.when(F.col("problem").isNotNull(), F.raise_error(F.concat(F.lit("lexicon: "), F.col("problem"))).cast("string")).otherwise(F.col("cyrillic_stem"))
    return lexicon.withColumn("cyrillic_stem", checked).drop("problem")


def ranked(lexicon: DataFrame, order: str | None = None) -> DataFrame:
    """With `rank`, a value that sorts entries as the match prefers them: longer stems, then
    words before stems, then the stem, then the file's order."""
    seq = F.col(order) if order else F.monotonically_increasing_id()
    return lexicon.withColumn("rank", F.struct((-F.length("cyrillic_stem")).alias("length"), (F.col("mode") == "stem").alias("stem"), F.col("cyrillic_stem").alias("key"), seq.alias("seq")))


def match_words(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(word) rows with the best entry: all words stay, `cyrillic_stem` is null without one.

    A word entry needs the whole word, a stem entry a prefix; an entry for capitalized
    words needs a capital first letter, and is passed over otherwise."""
    entries = ranked(lexicon)
    low = F.lower("word")
    longest = lexicon.agg(F.max(F.length("cyrillic_stem"))).first()[0] or 0
    if not longest:
        return words.select("word", *[F.lit(None).cast("string").alias(c) for c in lexicon.columns])
    lengths = F.sequence(F.lit(1), F.least(F.length("word"), F.lit(longest)))
    spread = words.where(F.length("word") > 0).select("word", F.explode(F.transform(lengths, lambda n: F.left(low, n))).alias("cyrillic_stem"))
    fits = (F.col("mode") == "stem") | (F.col("cyrillic_stem") == low)
    first = F.left("word", F.lit(1))
    fits &= (F.col("match_case") == "any") | (first != F.lower(first))
    best = spread.join(entries, "cyrillic_stem").where(fits).groupBy("word").agg(F.min_by(F.struct(*lexicon.columns), "rank").alias("e"))
    return words.select("word").join(best, "word", "left").select("word", "e.*")


def convert_words(words: DataFrame, lexicon: DataFrame, apostrophe: bool = False) -> DataFrame:
    """(word, latin): entries for what they match, native rules for the rest. A stem's own
    capitals decide its case, the whole word's those of the suffix."""
    matched = match_words(words, lexicon)
    n = F.length("cyrillic_stem")
    part, suffix = F.left("word", n), F.substring(F.col("word"), n + 1, F.lit(ALL))
    first = F.left("word", F.lit(1))
    stem = F.when(all_caps(part), F.upper("latin_stem")).when(F.col("case_mode") == "preserve", F.col("latin_stem")).when(first != F.lower(first), raise_first(F.col("latin_stem"))).otherwise(lower_first(F.col("latin_stem")))
    tail = convert_suffix(suffix, suffix_class(F.col("suffix_context"), F.col("cyrillic_stem")), all_caps(F.col("word")))
    joint = F.when(tail != "", "'").otherwise("") if apostrophe else F.lit("")
    loan = F.concat(stem, joint, F.when(suffix == "", "").otherwise(tail))
    return matched.select("word", F.when(F.col("cyrillic_stem").isNull(), convert_word(F.col("word"))).otherwise(loan).alias("latin"), "cyrillic_stem")


def convert_documents(docs: DataFrame, lexicon: DataFrame, key: str, text: str, apostrophe: bool = False) -> DataFrame:
    """(key, latin) of whole texts. Every distinct word is matched once; texts are put together
    again by position."""
    spread = docs.select(key, F.posexplode_outer(tokens(F.coalesce(F.col(text), F.lit("")))).alias("pos", "word"))
    words = spread.where(F.col("word").rlike(LETTER)).select("word").distinct()
    told = spread.join(convert_words(words, lexicon, apostrophe).select("word", "latin"), "word", "left")
    piece = F.struct("pos", F.coalesce("latin", "word", F.lit("")).alias("out"))
    return told.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["out"]), "").alias("latin"))


def prefix_conflicts(lexicon: DataFrame) -> DataFrame:
    """Pairs of stems of which one is a prefix of the other, found by equality of prefixes."""
    stems = lexicon.select("cyrillic_stem").distinct()
    spread = stems.select(F.col("cyrillic_stem").alias("longer"), F.explode(F.transform(F.sequence(F.lit(1), F.length("cyrillic_stem")), lambda n: F.left("cyrillic_stem", n))).alias("shorter"))
    return spread.where("shorter <> longer").join(stems.withColumnRenamed("cyrillic_stem", "shorter"), "shorter", "left_semi")


def first_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with equal keys the first by `order`: an aggregate, not a sort per key."""
    rest = [c for c in rows.columns if c not in keys]
    kept = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("r"))
    return kept.select(*keys, "r.*").select(*rows.columns)
