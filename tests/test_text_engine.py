"""Known pairs for the orthography, lexicon, phonetics and Greek functions."""

import pytest
from pyspark.sql import functions as F

from skriba.functions import greek, phonetics
from skriba.functions.orthography import convert_text, convert_word
from skriba.operators import lexicon as L
from skriba.functions import languages, markup
from skriba.functions.markup import template_calls
from skriba.operators import wiki as W
from skriba.plans.fixtures import CONSONANTS, GREEK, LOANS, NATIVE, PAGES, READINGS, ROWS, SOUNDS, STEMS, TEMPLATES, TRIMMED, UNLIKE, page_rows, pairs
from skriba.sources import fetch, naming, pages, response_cache
from skriba.streaming import convert


def dictionary(spark):
    rows = spark.createDataFrame(ROWS, "cyrillic_stem string, latin_stem string, mode string, case_mode string, match_case string, suffix_context string")
    return L.valid(L.normalise(rows))


def test_native_pairs(spark):
    got = spark.createDataFrame(pairs(NATIVE), "w string, e string").select("w", "e", convert_word(F.col("w")).alias("g")).collect()
    assert [(r.w, r.g) for r in got] == [(r.w, r.e) for r in got]


def test_native_texts(spark):
    texts = [("Я ЛЮБЛЮ чай.", "Ja LEUBLEU czaj."), ("до́м", "dóm"), ("", ""), (None, None), ("ЖУК и Щука", "ZSUK i Szeuka")]
    got = spark.createDataFrame(texts, "w string, e string").select("e", convert_text(F.col("w")).alias("g")).collect()
    assert [r.g for r in got] == [r.e for r in got]


def test_native_functions_stay_in_the_jvm(spark):
    plan = spark.createDataFrame([("шина",)], "w string").select(convert_text(F.col("w")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_lexicon_pairs(spark):
    words = spark.createDataFrame(pairs(LOANS), "word string, e string")
    got = {r.word: r.latin for r in L.convert_words(words.select("word"), dictionary(spark)).collect()}
    assert got == dict(pairs(LOANS))
    quoted = L.convert_words(spark.createDataFrame([("Зевса",), ("Жюль",)], "word string"), dictionary(spark), apostrophe=True)
    assert {r.word: r.latin for r in quoted.collect()} == {"Зевса": "Zevs'a", "Жюль": "Jule"}


def test_lexicon_document(spark):
    docs = spark.createDataFrame([(1, "Шина и поэта, Зевса!"), (2, None)], "id int, t string")
    got = {r.id: r.latin for r in L.convert_documents(docs, dictionary(spark), "id", "t").collect()}
    assert got == {1: "Schiena i poëta, Zevsa!", 2: ""}


@pytest.mark.parametrize("row,problem", [(("а", None, None, None, None, None), "one key is blank"), (("а", "a", "x", None, None, None), "unknown mode"), (("а", "a", None, "x", None, None), "unknown case_mode"), (("а", "a", None, None, "x", None), "unknown match_case"), (("а", "a", None, None, None, "x"), None)])
def test_lexicon_problems(spark, row, problem):
    rows = spark.createDataFrame([row, (None, " ", None, None, None, None)], "Cyrillic_Stem string, latin_stem string, mode string, case_mode string, match_case string, suffix_context string")
    assert [r.problem for r in L.normalise(rows).collect()] == [problem]


def test_lexicon_needs_its_keys(spark):
    with pytest.raises(ValueError):
        L.normalise(spark.createDataFrame([("а",)], "cyrillic_stem string"))


def test_first_wins_and_conflicts(spark):
    rows = spark.createDataFrame([("а", 2, "y"), ("а", 1, "x"), ("б", 3, "z")], "k string, seq int, v string")
    assert sorted(tuple(r) for r in L.first_wins(rows, ["k"], "seq").collect()) == [("а", 1, "x"), ("б", 3, "z")]
    assert [tuple(r) for r in L.prefix_conflicts(dictionary(spark)).collect()] == [("жюл", "жюль")]


def test_sounds(spark):
    for text, function, vowels, expected in ((SOUNDS, phonetics.sounds_like, True, True), (CONSONANTS, phonetics.consonants_like, False, True), (UNLIKE, phonetics.sounds_like, True, False), (UNLIKE, phonetics.consonants_like, False, False)):
        rows = spark.createDataFrame(pairs(text), "c string, s string").withColumn("r", phonetics.reading(F.col("c"), vowels))
        bad = [(r.c, r.s) for r in rows.withColumn("ok", function("r", "s")).collect() if r.ok != expected]
        assert not bad


def test_readings(spark):
    rows = spark.createDataFrame(pairs(READINGS), "c string, e string")
    assert all(r.g == r.e for r in rows.withColumn("g", phonetics.reading(F.col("c"))).collect())


@pytest.mark.parametrize("cyr,latin,stem", TRIMMED)
def test_trimmed_stems(spark, cyr, latin, stem):
    row = spark.createDataFrame([(cyr, latin)], "c string, l string").select(phonetics.trimmed_stem(phonetics.reading(F.col("c")), F.col("l")).alias("t")).first()
    assert row.t.stem == stem


@pytest.mark.parametrize("mode", GREEK)
def test_greek(spark, mode):
    import unicodedata

    rows = spark.createDataFrame(pairs(GREEK[mode]), "g string, e string")
    got = rows.withColumn("r", getattr(greek, f"romanise_{mode}")("g")).collect()
    assert [(r.g, unicodedata.normalize("NFC", r.r)) for r in got] == [(r.g, unicodedata.normalize("NFC", r.e)) for r in got]


def test_greek_stems(spark):
    rows = spark.createDataFrame(pairs(STEMS), "g string, e string")
    got = rows.withColumn("r", greek.romanise_classical(greek.greek_stem("g"))).collect()
    assert [(r.g, r.r) for r in got] == [(r.g, r.e) for r in got]


def test_pages(spark):
    rows = spark.createDataFrame(page_rows(), "seq int, title string, content string, categories array<string>")
    got = {r.title: r for r in W.crawl_rows(rows, templates=spark.createDataFrame(TEMPLATES, "name string, content string")).collect()}
    for title, _, _, row in PAGES:
        r = got[title]
        if isinstance(row, str):
            assert r.disposition == row, title
        else:
            assert (r.cyrillic_stem, r.latin_stem, r.matched_russian_reading, r.original_latin, r.mode, r.match_case, r.source, r.kind) == row
    assert got["гольф"].notes == W.NOTES["translation"] and got["лампа"].url.endswith("%D0%BB%D0%B0%D0%BC%D0%BF%D0%B0")


def test_translations_of_unmarked_languages(spark):
    """A meaning that speaks for a language without a translation lets the usual ones in."""
    body = "= {{-ru-}} =\n=== Морфологические и синтаксические свойства ===\n{{сущ-ru|клуб|м 1a}}\n==== Значение ====\n# в Японии\n=== Перевод ===\n{{перев|de|Klub}}"
    rows = spark.createDataFrame([(1, "клуб", body)], "seq int, title string, content string")
    assert [(r.latin_stem, r.source) for r in W.crawl_rows(rows).collect()] == [("Klub", "German")]
    assert [r.disposition for r in W.crawl_rows(rows, W.Options(translation_languages=["Dutch"])).collect()] == ["skipped"]
    assert [r.disposition for r in W.crawl_rows(rows, W.Options(languages=["Dutch"])).collect()] == ["filtered"]


def test_languages():
    assert languages.whitelist(" greek language ,ENGLISH,English") == ["Greek", "English"] and languages.whitelist("") == []
    with pytest.raises(ValueError):
        languages.whitelist("Klingon")
    assert languages.from_russian("Из древнегреческого языка") == "Greek" and languages.meant("издания") == ["Danish"]
    assert W.category_language("Категория:Слова французского происхождения/ru") == "French"
    assert W.category_language("Category:Мужские имена латинского происхождения/ru") == "Latin" and W.category_language("Категория:Реки") == ""


def test_terms():
    assert markup.first_term("от [[Gift|Gift box]], Gabe", "latin", False) == "Gabe" and markup.first_term("от Gift box", "latin", True) == "Gift box"
    assert markup.marked_candidates("заимств. из нем. Schacht, франц. scène")[0]["latin"] == "Schacht"
    assert markup.sections("== А ==\nx\n=== Б ===\ny\n== В ==\nz", {"а"}) == ["x\n=== Б ===\ny"]
    assert W.declension_stem("пальто", [["сущ-ru", "пальто́", "м неизм"]]) == "пальто" and W.declension_stem("роль", [["сущ-ru", "роль", "ж 8a"], ["морфо-ru", "рол", "+ь"]]) == "роль"


def test_lexicon_file_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("шин", 'Sch"ie"n, x', "a;b"), ("мяч", "miacz", "")], "cyrillic_stem string, latin_stem string, notes string")
    path = str(tmp_path / "lexicon")
    L.write_lexicon(rows, path)
    back = {r.cyrillic_stem: r for r in L.read_lexicon(spark, path).collect()}
    assert back["шин"].latin_stem == 'Sch"ie"n, x' and back["шин"].notes == "a;b" and back["мяч"].match_case == "any" and back["мяч"].problem is None
    L.write_text(rows, "notes", str(tmp_path / "text"))
    assert {r.value for r in spark.read.text(str(tmp_path / "text")).collect()} == {"a;b", ""}


def test_response_cache(spark, tmp_path):
    path, now = str(tmp_path / "cache"), F.lit("2024-05-02 00:00:00").cast("timestamp")
    old = F.lit("2024-05-01 00:00:00").cast("timestamp")
    response_cache.write(spark.createDataFrame([("u1", "old"), ("u2", "two")], "url string, body string"), old, path)
    response_cache.write(spark.createDataFrame([("u1", "new")], "url string, body string"), now, path)
    cache, urls = response_cache.read(spark, path), spark.createDataFrame([("u1",), ("u2",), ("u3",)], "url string")
    bodies = lambda ttl: {r.url: r.body for r in response_cache.fresh(cache, urls, now, ttl).collect()}
    assert bodies(90_000) == {"u1": "new", "u2": "two"} and bodies(3_600) == {"u1": "new"} and bodies(0) == {}
    assert {r.url for r in response_cache.misses(cache, urls, now, 3_600).collect()} == {"u2", "u3"}
    clash = cache.withColumn("url", F.lit("other"))
    assert response_cache.fresh(clash, urls, now, 90_000).count() == 0


def test_fetching():
    from datetime import datetime, timedelta, timezone

    clock, slept = [datetime(2024, 5, 1, tzinfo=timezone.utc)], []

    def sleep(seconds):
        slept.append(seconds)
        clock[0] += timedelta(seconds=seconds)

    def run(answers, **options):
        slept.clear()
        answers = iter(answers)

        def get(url):
            a = next(answers)
            if isinstance(a, Exception):
                raise a
            return a

        return fetch.Fetcher(get, sleep, lambda: clock[0], spacing=0, **options).fetch("u")

    ok, busy = fetch.Answer(200, "{}"), fetch.Answer(503)
    assert run([busy, OSError("x"), fetch.Answer(200, '{"error":{"code":"maxlag"}}'), ok]) == "{}" and slept == [5, 10, 20]
    assert run([fetch.Answer(429, "", {"Retry-After": "7"}), ok]) == "{}" and slept == [7]
    assert run([fetch.Answer(429, "", {"Retry-After": "Wed, 01 May 2024 00:02:00 GMT"}), ok]) == "{}" and 0 < slept[0] <= 120
    assert fetch.backoff(9, None, clock[0]) == 30
    for answers in ([fetch.Answer(404)], [busy] * 6):
        with pytest.raises(RuntimeError):
            run(answers)
    assert run([], cached=lambda u: "kept") == "kept"
    spaced = fetch.Fetcher(lambda u: ok, sleep, lambda: clock[0])
    slept.clear()
    spaced.fetch("a"), spaced.fetch("b")
    assert slept == [fetch.SPACING] and spaced.misses == 2


def test_recorded_pages(spark, tmp_path):
    from skriba.plans.fixtures import ANSWERS

    (tmp_path / "a.json").write_text("\n".join(x for x in ANSWERS if x.startswith("{")), encoding="utf-8")
    got = {r.title: r for r in pages.read_recorded(spark, str(tmp_path)).collect()}
    assert got["лампа"].content == "свет" and got["лампа"].categories == ["a", "b"] and got["нора"].missing and got["пусто"].content is None
    assert [r.title for r in pages.read_recorded(spark, str(tmp_path), from_title="п").collect()] == ["пусто"]
    titles = spark.range(120).select(F.col("id").alias("seq"), F.col("id").cast("string").alias("title"))
    assert sorted(len(r.titles) for r in pages.batches(titles, 1000).collect()) == [20, 50, 50]


def test_names():
    usual = languages.whitelist(languages.USUAL)
    assert naming.lexicon_name(W.Options(languages=usual)) == "loan_stems.wiktionary.pages.csv"
    some = W.Options(languages=["Greek", "Dutch"], title="а б", limit=5, resolve_templates=False, phrases=True, keep_marks=True)
    assert naming.lexicon_name(some) == "loan_stems.wiktionary.pages.title-а-б.no-template-resolve.langs-Dutch-Greek.phrases.keep-diacritics.csv"
    assert naming.lexicon_name(W.Options(limit=5), "appendix", "x/y") == "loan_stems.wiktionary.appendix.source-x-y.limit-5.langs-all.csv"


def test_streams(spark, tmp_path):
    spark.createDataFrame([("Шина", "а"), ("чай", "а")], "text string, k string").write.parquet(str(tmp_path / "in"))
    stream = convert.convert_stream(spark.readStream.schema("text string, k string").parquet(str(tmp_path / "in")))
    timed = convert.first_stems(stream.withColumn("at", F.current_timestamp()), "k", "at", "1 hour")
    for name, frame in (("all_rows", stream), ("firsts", timed)):
        query = frame.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination(120)
    assert {r.latin for r in spark.table("all_rows").collect()} == {"Szina", "czaj"} and spark.table("firsts").count() == 1


def test_nested_templates():
    assert template_calls("{{a|{{b|c|d}}|[[e]]}} {{x") == [["b", "c", "d"], ["a", "{{b|c|d}}", "[[e]]"]]


def test_entities_without_a_semicolon_stay(spark):
    import duckdb

    from skriba.plans.catalogue import oracle_sql

    rows = [(1, "<title>a&&& b&amp</title> c&amp;amp;d <!-- x\ny --> &copy;&middot;"), (2, 'x &quot y &quo z &quot;&am&a;&ampd;'), (3, None), (4, "")]
    got = spark.createDataFrame(rows, "page_id long, html string").select("page_id", W.markup_stripped("html").alias("text")).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", rows)
    assert sorted(map(tuple, got)) == sorted(con.execute(oracle_sql()["q_markup_strip"]).fetchall())
    assert markup.closed_entities("&lt;&#1090;&#x442;&nbsp;&lt &#9 &nbsp") == "<тт\xa0&lt &#9 &nbsp"
