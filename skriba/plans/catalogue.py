"""Registered queries of the text engine and their SQL counterparts.

The tables hold no Cyrillic or Greek, so texts are respelt first, alike in both engines.
SQL has no lookbehind: its side explodes letters and looks at the one before, or replaces
every pair of letters that makes a difference.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skriba.functions import greek as G
from skriba.functions import orthography as O
from skriba.functions import phonetics as P
from skriba.functions import languages as LANG
from skriba.operators import lexicon as L
from skriba.operators import wiki as W
from skriba.plans import fixtures as X
from skriba.sources import pages as PG
from skriba.sources import response_cache as RC

LEXICON = "cyrillic_stem string, latin_stem string, mode string, case_mode string, match_case string, suffix_context string"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", O.pseudo_cyrillic(F.col("text")).alias("t"))


def _words(spark, sf_dir) -> DataFrame:
    return _docs(spark, sf_dir).select(F.explode(F.regexp_extract_all("t", F.lit("[а-яё]+"), F.lit(0))).alias("word")).distinct()


def _pairs(spark, text: str) -> DataFrame:
    return spark.createDataFrame(X.pairs(text), "input string, expected string").select("input")


def _lexicon(spark, sf_dir) -> DataFrame:
    """A lexicon from the documents' own words: beginnings of three and of five letters that are
    met 20 times, and words of four to eight letters that are met 50 times as whole words. So most
    words have several entries, of which the longest counts, and words go before stems."""
    words = _docs(spark, sf_dir).select(F.explode(F.regexp_extract_all("t", F.lit("[а-яё]{3,}"), F.lit(0))).alias("word"))
    counted = words.groupBy("word").agg(F.count("*").alias("n"))
    parts = [counted.where(F.length("word") >= k).groupBy(F.left("word", F.lit(k)).alias("cyrillic_stem")).agg(F.sum("n").alias("n")).where("n >= 20").select("cyrillic_stem", F.lit("stem").alias("mode")) for k in (3, 5)]
    whole = counted.where("n >= 50 AND length(word) BETWEEN 4 AND 8").select(F.col("word").alias("cyrillic_stem"), F.lit("word").alias("mode"))
    rows = parts[0].union(parts[1]).union(whole)
    latin = F.concat(F.lit("Q"), F.length("cyrillic_stem").cast("string"), F.left("mode", F.lit(1)))
    return rows.select("cyrillic_stem", latin.alias("latin_stem"), "mode", F.lit("auto").alias("case_mode"), F.lit("any").alias("match_case"), F.lit(None).cast("string").alias("suffix_context"))


def _dictionary(spark) -> DataFrame:
    return L.valid(L.normalise(spark.createDataFrame(X.ROWS, LEXICON)))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, respelt in Cyrillic, converted to Latin letters."""
    return _docs(spark, sf_dir).select("doc_id", O.convert_text(F.col("t")).alias("latin"))


def q_tokens(spark, sf_dir):
    """Word tokens with their position among all tokens."""
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(O.tokens(F.col("t"))).alias("pos", "token"))


def q_word_count(spark, sf_dir):
    """Words by language."""
    return _docs(spark, sf_dir).groupBy("lang").agg(F.sum(F.regexp_count("t", F.lit("[а-яё]+"))).cast("long").alias("words"))


def q_native_words(spark, sf_dir):
    """Distinct words, converted."""
    return _words(spark, sf_dir).select("word", O.convert_word(F.col("word")).alias("latin"))


def q_native_case(spark, sf_dir):
    """Distinct words in capitals, and with a capital first letter."""
    w = _words(spark, sf_dir)
    return w.select("word", O.convert_word(F.upper("word")).alias("caps"), O.convert_word(O.raise_first(F.col("word"))).alias("title"))


def q_fixture_native(spark, sf_dir):
    return _pairs(spark, X.NATIVE).select("input", O.convert_word(F.col("input")).alias("latin"))


def q_fixture_loans(spark, sf_dir):
    words = _pairs(spark, X.LOANS).withColumnRenamed("input", "word")
    return L.convert_words(words, _dictionary(spark)).select(F.col("word").alias("input"), "latin")


def q_lexicon_rank(spark, sf_dir):
    """Entries in the order the match prefers them."""
    ranked = L.ranked(_dictionary(spark)).select("cyrillic_stem", "mode", "rank.length", "rank.stem")
    return ranked.select("cyrillic_stem", "mode", (-F.col("length")).alias("letters"), F.col("stem").alias("is_stem"))


def q_prefix_match(spark, sf_dir):
    """Each distinct word's best entry."""
    return L.match_words(_words(spark, sf_dir), _lexicon(spark, sf_dir)).select("word", "cyrillic_stem", "mode")


def q_convert_docs(spark, sf_dir):
    """Whole documents converted with the lexicon."""
    return L.convert_documents(_docs(spark, sf_dir), _lexicon(spark, sf_dir), "doc_id", "t")


def q_convert_apostrophe(spark, sf_dir):
    """Distinct words converted with the lexicon, an apostrophe behind stems."""
    return L.convert_words(_words(spark, sf_dir), _lexicon(spark, sf_dir), True).select("word", "latin")


def q_suffix_context(spark, sf_dir):
    """A suffix behind stems of every class."""
    rows = spark.createDataFrame([r[:3] for r in X.SUFFIXES], "stem string, context string, suffix string")
    return rows.select("stem", "context", "suffix", O.convert_suffix(F.col("suffix"), O.suffix_class(F.col("context"), F.col("stem")), F.lit(False)).alias("latin"))


def q_lexicon_coverage(spark, sf_dir):
    """Distinct words with and without an entry."""
    got = q_prefix_match(spark, sf_dir)
    return got.agg(F.count("*").alias("words"), F.count("cyrillic_stem").alias("matched"))


def q_lexicon_file(spark, sf_dir):
    """What a lexicon file holds of rows without all columns."""
    rows = spark.createDataFrame([r[:3] for r in X.ROWS], "cyrillic_stem string, latin_stem string, mode string")
    return L.lexicon_columns(rows)


def q_prefix_conflicts(spark, sf_dir):
    return L.prefix_conflicts(_dictionary(spark)).select("shorter", "longer")


def q_russian_reading(spark, sf_dir):
    """What distinct words sound like."""
    return _words(spark, sf_dir).select("word", P.reading(F.col("word")).alias("reading"), P.reading(F.col("word"), False).alias("consonants"))


def q_sound_match(spark, sf_dir):
    rows = spark.createDataFrame(X.pairs(X.SOUNDS + " " + X.UNLIKE), "cyr string, source string")
    return rows.select("cyr", "source", P.sounds_like(P.reading(F.col("cyr")), F.col("source")).alias("ok"))


def q_consonant_match(spark, sf_dir):
    rows = spark.createDataFrame(X.pairs(X.CONSONANTS + " " + X.UNLIKE), "cyr string, source string")
    return rows.select("cyr", "source", P.consonants_like(P.reading(F.col("cyr"), False), F.col("source")).alias("ok"))


def q_trim_stem(spark, sf_dir):
    rows = spark.createDataFrame([r[:2] for r in X.TRIMMED], "cyr string, source string")
    return rows.select("cyr", "source", P.trimmed_stem(P.reading(F.col("cyr")), F.col("source"))["stem"].alias("stem"))


def _greek(mode):
    def run(spark, sf_dir):
        return _pairs(spark, X.GREEK[mode]).select("input", getattr(G, f"romanise_{mode}")("input").alias("latin"))

    run.__doc__ = f"Greek pairs, {mode}."
    return run


def q_greek_stem(spark, sf_dir):
    return _pairs(spark, X.STEMS).select("input", G.romanise_classical(G.greek_stem("input")).alias("latin"))


def q_greek_docs(spark, sf_dir):
    """Whole documents, respelt in Greek, romanised."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", G.romanise_alalc(G.pseudo_greek(F.col("text"))).alias("latin"))


def q_compact_spaces(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", W.compact_spaces(F.col("text")).alias("text"))


def q_markup_strip(spark, sf_dir):
    """Plain text of the pages' markup."""
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", W.markup_stripped("html").alias("text"))


def _pages(spark) -> DataFrame:
    return spark.createDataFrame(X.page_rows(), "seq int, title string, content string, categories array<string>")


def _crawl(spark, **options) -> DataFrame:
    templates = spark.createDataFrame(X.TEMPLATES, "name string, content string")
    return W.crawl_rows(_pages(spark), W.Options(**options), templates)


_ROW = ("cyrillic_stem", "latin_stem", "matched_russian_reading", "original_latin", "mode", "match_case", "source", "kind")


def q_crawl_rows(spark, sf_dir):
    return _crawl(spark).where("disposition = 'accepted'").select("title", *_ROW)


def q_dispositions(spark, sf_dir):
    return _crawl(spark).groupBy("disposition").agg(F.count("*").alias("n"))


def q_whitelist(spark, sf_dir):
    """Rows of two languages, told by any of their names."""
    return _crawl(spark, languages=LANG.whitelist("GREEK language, german")).where("disposition = 'accepted'").select("title", "source")


def q_limit_pages(spark, sf_dir):
    """The first two rows from a title on, of the first ten pages."""
    return _crawl(spark, from_title="м", page_limit=10, limit=2).where("disposition = 'accepted'").select("title")


def q_no_templates(spark, sf_dir):
    """Pages whose row comes from another page's etymology alone."""
    found = _crawl(spark).where("disposition = 'accepted'").select("title")
    return found.join(_crawl(spark, resolve_templates=False).where("disposition = 'accepted'").select("title"), "title", "left_anti")


def q_enriched(spark, sf_dir):
    """Rows with what their pages add."""
    rows = spark.createDataFrame([r[:5] for r in X.ENRICHED], "title string, cyrillic_stem string, latin_stem string, source string, notes string")
    rows = rows.withColumns({"mode": F.lit("stem"), "original_latin": F.col("latin_stem")})
    pages = spark.createDataFrame(X.META_PAGES, "title string, content string, categories array<string>")
    return W.enriched(rows, pages).select("title", "latin_stem", "source", "notes")


def _appendix(spark, **options) -> DataFrame:
    lines = spark.createDataFrame([(k, x) for k, x in enumerate(X.APPENDIX, 1)], "line_no int, line string").withColumn("page", F.lit("a"))
    return W.appendix_rows(lines, W.Options(**options))


def q_appendix(spark, sf_dir):
    return _appendix(spark).where("disposition = 'accepted'").select("line_no", "source", "cyrillic_stem", "latin_stem", "original_greek", "match_case")


def q_appendix_dispositions(spark, sf_dir):
    """Bullets of two languages and others."""
    return _appendix(spark, languages=["German", "Greek"]).groupBy("disposition").agg(F.count("*").alias("n"))


def q_limit_appendix(spark, sf_dir):
    """The first rows after sorting."""
    return _appendix(spark, limit=2).select("line_no", "cyrillic_stem")


def q_markup_fixture(spark, sf_dir):
    return spark.createDataFrame([r[:1] for r in X.MARKUP], "input string").select("input", W.markup_stripped("input").alias("text"))


def q_templates(spark, sf_dir):
    """Calls of the pages' templates: an inner one before the one around it."""
    calls = _pages(spark).select("title", F.posexplode(W.calls_of("content")).alias("k", "call"))
    return calls.select("title", F.element_at("call", 1).alias("name"), (F.size("call") - 1).alias("arguments")).groupBy("name").agg(F.count("*").alias("n"), F.sum("arguments").alias("arguments"))


def q_sections(spark, sf_dir):
    """Pages by the sections that they have."""
    pages = _pages(spark)
    names = ("значение", "перевод")
    return pages.select("title", *[(F.size(W.named_sections("content", F.lit(n))) > 0).alias(k) for n, k in zip(names, ("meaning", "translation"))]).where("meaning OR translation")


def q_spellings(spark, sf_dir):
    """Spellings without marks, and whether they are Latin and Greek terms."""
    rows = spark.createDataFrame([r[:1] for r in X.SPELLINGS], "input string")
    return rows.select("input", P.strip_diacritics(F.col("input")).alias("bare"), W.is_latin_term("input").alias("latin"), W.is_greek_term("input").alias("greek"))


def q_strip_diacritics(spark, sf_dir):
    """Whole documents without marks on their letters."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", P.strip_diacritics(F.col("text")).alias("text"))


def q_latin_terms(spark, sf_dir):
    """Documents' distinct words, punctuation cut off, by whether they are Latin terms."""
    words = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.explode(F.split("text", "[ \\t\\n\\x0B\\f\\r]+")).alias("word")).where("word <> ''").distinct()
    return words.groupBy(W.is_latin_term("word").alias("ok")).agg(F.count("*").alias("n"))


def q_pages_decoded(spark, sf_dir):
    """Pages of recorded answers, and why some have no content."""
    answers = spark.createDataFrame([(x,) for x in X.ANSWERS], "body string")
    return PG.pages_of(answers).select("title", "content", F.size("categories").alias("categories"), "problem")


def q_page_lookup(spark, sf_dir):
    """Titles with their page, or the problem."""
    answers = spark.createDataFrame([(x,) for x in X.ANSWERS], "body string")
    titles = spark.createDataFrame([("лампа",), ("нет такой",)], "title string")
    return PG.lookup(titles, PG.pages_of(answers)).select("title", "content", "problem")


def q_page_urls(spark, sf_dir):
    """Addresses of the documents' words as pages, by their length."""
    return _words(spark, sf_dir).select("word", W.page_url(F.col("word")).alias("url"))


def q_title_batches(spark, sf_dir):
    """Requests for the documents' words as titles, fifty at most in one."""
    numbered = _words(spark, sf_dir).groupBy(F.left("word", F.lit(2)).alias("range")).agg(F.count("*").alias("n"))
    return numbered.select("range", F.ceil(F.col("n") / F.lit(PG.batch_size(500))).cast("long").alias("requests"))


def q_cache_fresh(spark, sf_dir):
    """Events as a cache: bodies not older than thirty days before the last one."""
    events = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat(F.lit("https://example.org/"), "source").alias("url"), F.col("doc_id").cast("string").alias("body"), F.timestamp_seconds(F.col("doc_id") * 3600).alias("fetched_at"))
    cache = events.select(RC.key_of(F.col("url")).alias("key"), "url", "body", "fetched_at")
    now = F.timestamp_seconds(F.lit(1000 * 3600))
    return RC.fresh(cache, events.select("url").distinct(), now, 30 * 24 * 3600).select("url", "body")


def q_dedup_first(spark, sf_dir):
    """Of documents with equal first words the first."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.regexp_extract("text", "^[^ ]*", 0).alias("word"))
    return L.first_wins(docs, ["word"], "doc_id")


def q_limit(spark, sf_dir):
    """The first hundred documents in order."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(100).select("doc_id", "lang")


def queries() -> dict:
    own = (q_tokens, q_word_count, q_native_words, q_native_case, q_fixture_native, q_fixture_loans, q_lexicon_rank, q_prefix_match, q_lexicon_coverage, q_prefix_conflicts, q_russian_reading, q_sound_match, q_consonant_match, q_trim_stem, q_greek_stem, q_greek_docs, q_compact_spaces, q_markup_strip, q_crawl_rows, q_dispositions, q_dedup_first, q_limit)
    own += (q_convert_docs, q_convert_apostrophe, q_suffix_context, q_lexicon_file, q_whitelist, q_limit_pages, q_no_templates, q_enriched, q_appendix, q_appendix_dispositions, q_limit_appendix, q_markup_fixture, q_templates, q_sections, q_spellings, q_strip_diacritics, q_latin_terms, q_pages_decoded, q_page_lookup, q_page_urls, q_title_batches, q_cache_fresh)
    return {"q_native_docs": flagship} | {f.__name__: f for f in own} | {f"q_greek_{m}": _greek(m) for m in X.GREEK}


def _text(value) -> str:
    return "NULL" if value is None else "true" if value is True else "false" if value is False else str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"


def _values(rows, names: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_text, r)) + ')' for r in rows)}) t({names})"


def _respelt(column: str = "text") -> str:
    out = f"lower({column})"
    for a, b in O.RESPELLING:
        out = f"replace({out}, '{a}', '{b}')"
    return f"translate({out}, '{O.LATIN_LETTERS}', '{O.CYRILLIC_LETTERS}')"


_WORDS = f"SELECT DISTINCT unnest(regexp_extract_all({_respelt()}, '[а-яё]+')) AS word FROM documents"


def _native(rows: str) -> str:
    """(k, latin) of (k, t): small letters, each by the class of the one before."""
    paired, hard, soft = (f"prev IN ({', '.join(repr(c) for c in letters)})" for letters in (O.PAIRED, O.HARD, O.SOFT))
    jot = " ".join(f"WHEN c = '{a}' THEN CASE WHEN {paired} THEN 'e{b}' WHEN {hard} OR {soft} OR prev = 'й' THEN '{b}' ELSE 'j{b}' END" for a, b in O.JOTATED)
    digraphs = " ".join(f"WHEN c = '{a}' THEN '{b}'" for a, b in O.DIGRAPHS)
    return f"""
WITH src AS (SELECT k, regexp_replace(t, '(с)з|(з)с', chr(57344) || '\\1\\2', 'g') AS t FROM ({rows})),
letters AS (SELECT k, unnest(range(1, length(t) + 1)) AS pos, unnest(string_split(t, '')) AS c FROM src WHERE t <> ''),
seen AS (SELECT k, pos, c, lag(c) OVER (PARTITION BY k ORDER BY pos) AS prev FROM letters),
made AS (SELECT k, pos, CASE
  WHEN c = chr(57344) THEN '' WHEN prev = chr(57344) THEN CASE c WHEN 'с' THEN 'zz' ELSE 'ss' END
  WHEN c = 'э' THEN CASE WHEN regexp_matches(prev, '^[а-яё]$') THEN 'ae' ELSE 'e' END
  WHEN c = 'и' THEN CASE WHEN {paired} THEN 'ei' WHEN prev IN ('ь', 'ъ') THEN 'ji' ELSE 'i' END
  WHEN c = 'е' THEN CASE WHEN {paired} THEN 'ee' WHEN {hard} THEN 'ae' WHEN {soft} OR prev = 'й' THEN 'e' ELSE 'je' END
  {jot} WHEN c = 'ь' THEN CASE WHEN {paired} THEN 'e' ELSE '' END WHEN c = 'ъ' THEN '' {digraphs}
  ELSE translate(c, '{O.ONE_TO_ONE[0]}', '{O.ONE_TO_ONE[1]}') END AS o FROM seen)
SELECT s.k, coalesce(m.latin, '') AS latin FROM src s LEFT JOIN (SELECT k, string_agg(o, '' ORDER BY pos) AS latin FROM made GROUP BY k) m ON m.k = s.k"""


def _chain(text: str, pairs) -> str:
    for a, b in pairs:
        text = f"replace({text}, '{a}', '{b}')"
    return text


def _native_text(text: str) -> str:
    """Small letters by the native rules, in replacements of all pairs of letters that matter."""
    out = f"regexp_replace({text}, '(с)з|(з)с', chr(57344) || '\\1\\2', 'g')"
    out = f"replace(regexp_replace({out}, '([^а-яё]|^)э', '\\1e', 'g'), 'э', 'ae')"
    jotated = [("е", "e"), *O.JOTATED]
    pairs = [(s + "и", s + "ji") for s in "ьъ"]
    pairs += [(c + v, c + w) for c in O.PAIRED for v, w in [("и", "ei"), ("ь", "e"), *((v, "e" + w) for v, w in jotated)]]
    pairs += [(c + v, c + ("ae" if v == "е" else w)) for c in O.HARD for v, w in jotated] + [(c + v, c + w) for c in O.SOFT + "й" for v, w in jotated]
    pairs += [("и", "i"), *((v, "j" + w) for v, w in jotated), ("ь", ""), ("ъ", "")]
    out = f"replace(replace({_chain(out, pairs)}, chr(57344) || 'с', 'zz'), chr(57344) || 'з', 'ss')"
    return f"translate({_chain(out, O.DIGRAPHS)}, '{O.ONE_TO_ONE[0]}', '{O.ONE_TO_ONE[1]}')"


def _greek_text(text: str) -> str:
    """Unmarked small Greek letters with long vowels marked: clusters, pairs of vowels, letters."""
    low = f"translate(lower({text}), '{G.RESPELLING[0]}', '{G.RESPELLING[1]}')"
    out = _chain(low, [("γγ", "ng"), ("γξ", "nx"), ("γχ", "nch")])
    out = f"regexp_replace({out}, '(^|[^α-ωa-zēō])γκ', '\\1gk', 'g')"
    out = f"regexp_replace({out}, 'γκ($|[^α-ωa-zēō])', 'gk\\1', 'g')"
    for pair, first, inside in (("μπ", "b", "mp"), ("ντ", "d", "nt")):
        out = f"replace(regexp_replace({out}, '(^|[^α-ωa-zēō])({pair})', '\\1{first}', 'g'), '{pair}', '{inside}')"
    out = _chain(out, [("γκ", "nk"), ("αυ", "au"), ("ευ", "eu"), ("ηυ", "ēu"), ("ου", "ou"), ("ωυ", "ōu"), ("αι", "ai"), ("ει", "ei"), ("οι", "oi"), ("υι", "ui")])
    out = f"regexp_replace({out}, '(^|[^α-ωa-zēō])ρ', '\\1rh', 'g')"
    return out


def _letters(text: str) -> str:
    """What is left of Greek letters, each for itself; a ρ behind an r is rh."""
    for _ in range(3):
        text = f"regexp_replace({text}, '(rh|ρ)ρ', '\\1rh', 'g')"
    pairs = [("η", "ē"), ("ω", "ō"), *((c, w) for c, w in G.SINGLES.items() if c not in "ηω")]
    return _chain(text, pairs)


def oracle_sql() -> dict:
    """SQL, or the expected rows themselves for fixtures."""
    native = _native_text("word")
    words = f"SELECT word, {native} AS latin FROM ({_WORDS})"
    title = "CASE WHEN left(word, 1) IN ('ь', 'ъ') THEN latin ELSE upper(left(latin, 1)) || substr(latin, 2) END"
    counted = f"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all({_respelt()}, '[а-яё]{{3,}}')) AS word FROM documents) GROUP BY word"
    stems = " UNION ALL ".join(f"SELECT left(word, {k}) AS stem, 'stem' AS mode FROM c WHERE length(word) >= {k} GROUP BY 1 HAVING sum(n) >= 20" for k in (3, 5))
    lexicon = f"c AS ({counted}), lex AS ({stems} UNION ALL SELECT word, 'word' FROM c WHERE n >= 50 AND length(word) BETWEEN 4 AND 8)"
    fits = " UNION ALL ".join(f"SELECT w.word, l.stem, l.mode FROM w JOIN lex l ON l.mode = 'stem' AND length(l.stem) = {k} AND left(w.word, {k}) = l.stem" for k in (3, 5)) + " UNION ALL SELECT w.word, l.stem, l.mode FROM w JOIN lex l ON l.mode = 'word' AND l.stem = w.word"
    best = f"{lexicon}, w AS ({_WORDS}), fit AS ({fits}), best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY length(stem) DESC, mode = 'stem', stem) AS r FROM fit) WHERE r = 1)"
    matched = f"WITH {best} SELECT w.word, b.stem AS cyrillic_stem, b.mode FROM w LEFT JOIN best b ON b.word = w.word"
    # A letter of the stem's class stands for it ahead of the suffix, and its output is cut off.
    letter, written = ("CASE " + " ".join(f"WHEN right(stem, 1) IN ({', '.join(repr(c) for c in letters)}) THEN {value}" for letters, value in cases) + " END" for cases in (
        [(O.VOWELS, "'о'"), (O.PAIRED, "'к'"), (O.HARD, "'ш'"), (O.SOFT, "'ч'"), ("ьъ", "'ъ'"), ("й", "'й'")],
        [(O.VOWELS, "1"), (O.PAIRED, "1"), (O.HARD, "2"), (O.SOFT, "2"), ("ьъ", "0"), ("й", "1")],
    ))
    tail = _native_text("sentinel || substr(word, length(stem) + 1)")
    loans = f"{best}, s AS (SELECT *, {letter} AS sentinel, {written} AS cut FROM best), loan AS (SELECT word, 'q' || length(stem) || left(mode, 1) AS head, substr({tail}, cut + 1) AS tail FROM s)"
    converted = f"{loans}, told AS (SELECT w.word, coalesce(l.head || l.tail, {_native_text('w.word')}) AS latin, l.head || CASE WHEN l.tail <> '' THEN chr(39) ELSE '' END || l.tail AS marked FROM w LEFT JOIN loan l ON l.word = w.word)"
    pieces = f"p AS (SELECT doc_id, unnest(range(len(x))) AS pos, unnest(x) AS token FROM (SELECT doc_id, regexp_extract_all({_respelt()}, '[а-яё]+|[^а-яё]+') AS x FROM documents))"
    consonants = "lower(word)"
    for c in P.RUSSIAN_CONSONANTS:
        consonants = f"regexp_replace({consonants}, '{c}+', '{c}', 'g')"
    folded = _chain(consonants, [("я", "а"), ("ё", "е"), ("э", "е"), ("ы", "и"), ("ю", "у"), ("ь", ""), ("ъ", "")])
    accepted = [(p[0], *p[3]) for p in X.PAGES if isinstance(p[3], tuple)]
    states = ["accepted" if isinstance(p[3], tuple) else p[3] for p in X.PAGES]
    plain = "html"
    for a, b in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        plain = f"replace({plain}, '{a}', '{b}')"
    single = {c: r for c, r in P.WITHOUT_MARKS.items() if len(r) == 1}
    bare = f"translate({_chain('text', [(c, r) for c, r in P.WITHOUT_MARKS.items() if len(r) > 1])}, '{''.join(single)}', '{''.join(single.values())}')"
    splits = "[ \\t\\n\\x0B\\f\\r]+"
    url = "'https://ru.wiktionary.org/wiki/' || url_encode(word)"
    return {
        "q_native_docs": f"SELECT k AS doc_id, latin FROM ({_native(f'SELECT doc_id AS k, {_respelt()} AS t FROM documents')})",
        "q_tokens": f"SELECT doc_id, CAST(unnest(range(len(x))) AS INTEGER) AS pos, unnest(x) AS token FROM (SELECT doc_id, regexp_extract_all({_respelt()}, '[а-яёА-ЯЁ]+|[^а-яёА-ЯЁ]+') AS x FROM documents)",
        "q_word_count": f"SELECT lang, CAST(sum(len(regexp_extract_all({_respelt()}, '[а-яё]+'))) AS BIGINT) AS words FROM documents GROUP BY lang",
        "q_native_words": words,
        "q_native_case": f"SELECT word, CASE WHEN length(word) > 1 THEN upper(latin) ELSE {title} END AS caps, {title} AS title FROM ({words})",
        "q_russian_reading": f"SELECT word, regexp_replace({folded}, '[^{P.RUSSIAN_CONSONANTS}{P.RUSSIAN_VOWELS}]', '', 'g') AS reading, regexp_replace({folded}, '[^{P.RUSSIAN_CONSONANTS}]', '', 'g') AS consonants FROM ({_WORDS})",
        "q_greek_docs": f"SELECT doc_id, {_letters(_greek_text('text'))} AS latin FROM documents",
        "q_markup_strip": f"SELECT page_id, trim(regexp_replace(regexp_replace({plain}, '<!--.*?-->', ' ', 'gs'), '\\s+', ' ', 'g')) AS text FROM pages",
        "q_dispositions": _values([(x, states.count(x)) for x in sorted(set(states))], "disposition, n"),
        "q_convert_docs": f"WITH {converted}, {pieces} SELECT d.doc_id, coalesce(string_agg(coalesce(t.latin, p.token), '' ORDER BY p.pos), '') AS latin FROM documents d LEFT JOIN p ON p.doc_id = d.doc_id LEFT JOIN told t ON t.word = p.token GROUP BY d.doc_id",
        "q_convert_apostrophe": f"WITH {converted} SELECT word, coalesce(marked, latin) AS latin FROM told",
        "q_suffix_context": _values(X.SUFFIXES, "stem, context, suffix, latin"),
        "q_lexicon_file": _values([(r[0], r[1], "", "", "", r[2], "", "any", "", "", "", "") for r in X.ROWS], ", ".join((*L.REQUIRED, *L.OPTIONAL))),
        "q_whitelist": _values([(p[0], p[7]) for p in accepted if p[7] in ("Greek", "German")], "title, source"),
        "q_limit_pages": _values([(t,) for t in X.LIMITED], "title"),
        "q_no_templates": _values([("порт",)], "title"),
        "q_enriched": _values([(r[0], *r[5:]) for r in X.ENRICHED], "title, latin_stem, source, notes"),
        "q_appendix": _values(X.APPENDIX_ROWS, "line_no, source, cyrillic_stem, latin_stem, original_greek, match_case"),
        "q_appendix_dispositions": _values(X.APPENDIX_STATES, "disposition, n"),
        "q_limit_appendix": _values(X.APPENDIX_FIRST, "line_no, cyrillic_stem"),
        "q_markup_fixture": _values(X.MARKUP, "input, text"),
        "q_templates": _values(X.TEMPLATE_CALLS, "name, n, arguments"),
        "q_sections": _values([("гольф", True, True), ("сауна", True, True)], "title, meaning, translation"),
        "q_spellings": _values(X.SPELLINGS, "input, bare, latin, greek"),
        "q_strip_diacritics": f"SELECT doc_id, {bare} AS text FROM documents",
        "q_latin_terms": f"SELECT regexp_matches(word, '\\p{{Latin}}') AND NOT regexp_matches(word, '\\p{{Greek}}|\\p{{Cyrillic}}|\\p{{Nd}}') AND lower(word) NOT IN ('nbsp', 'ref') AS ok, count(*) AS n FROM (SELECT DISTINCT unnest(regexp_split_to_array(text, '{splits}')) AS word FROM documents) WHERE word <> '' GROUP BY 1",
        "q_pages_decoded": _values(X.DECODED, "title, content, categories, problem"),
        "q_page_lookup": _values([("лампа", "свет", None), ("нет такой", None, "missing")], "title, content, problem"),
        "q_page_urls": f"SELECT word, {url} AS url FROM ({_WORDS})",
        "q_title_batches": f"SELECT left(word, 2) AS range, CAST(ceil(count(*) / 50.0) AS BIGINT) AS requests FROM ({_WORDS}) GROUP BY 1",
        "q_cache_fresh": "SELECT 'https://example.org/' || source AS url, CAST(max(doc_id) AS VARCHAR) AS body FROM documents WHERE doc_id >= 1000 - 30 * 24 AND source IS NOT NULL GROUP BY source",
        "q_fixture_native": _values(X.pairs(X.NATIVE), "input, latin"),
        "q_fixture_loans": _values(X.pairs(X.LOANS), "input, latin"),
        "q_lexicon_rank": _values([(r[0], r[2], len(r[0]), r[2] == "stem") for r in X.ROWS], "cyrillic_stem, mode, letters, is_stem"),
        "q_prefix_match": matched,
        "q_lexicon_coverage": f"SELECT count(*) AS words, count(cyrillic_stem) AS matched FROM ({matched})",
        "q_prefix_conflicts": _values([("жюл", "жюль")], "shorter, longer"),
        "q_sound_match": _values([(*p, True) for p in X.pairs(X.SOUNDS)] + [(*p, False) for p in X.pairs(X.UNLIKE)], "cyr, source, ok"),
        "q_consonant_match": _values([(*p, True) for p in X.pairs(X.CONSONANTS)] + [(*p, False) for p in X.pairs(X.UNLIKE)], "cyr, source, ok"),
        "q_trim_stem": _values(X.TRIMMED, "cyr, source, stem"),
        "q_greek_stem": _values(X.pairs(X.STEMS), "input, latin"),
        "q_compact_spaces": "SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM documents",
        "q_crawl_rows": _values(accepted, ", ".join(("title", *_ROW))),
        "q_dedup_first": "SELECT regexp_extract(text, '^[^ ]*', 0) AS word, min(doc_id) AS doc_id FROM documents GROUP BY 1",
        "q_limit": "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 100",
    } | {f"q_greek_{m}": _values(X.pairs(X.GREEK[m]), "input, latin") for m in X.GREEK}
