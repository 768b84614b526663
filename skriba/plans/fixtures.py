"""Known pairs: inputs of the fixture queries, with what they must give. Fixed values; the pages are our own."""

NATIVE = """Я=Ja ЖУК=ZSUK Женя=Zsaenea жена=zsaena жизнь=zsizne мажь=mazs вражий=vrazsij вражьи=vrazsji шина=szina шея=szaeja щука=szeuka чай=czaj ночь=nocz вечный=veecznij
русский=russkeij сзади=zzadei французский=frantzusskeij подъезд=podjezd семья=seemeja Марья=Mareja Мариа=Mareia Мария=Mareija поэт=poaet поёт=pojot поит=poit эй=ej ёж=jozs ел=jel ель=jele
это=eto эхо=exo мэр=maer тя=tea те=tee тё=teo ти=tei тю=teu ть=te юг=jug мой=moj мои=moi цена=tzaena цирк=tzirk царь=tzare щи=szei вещь=veesze борщ=borsze семя=seemea вьюга=vejuga
дьявол=dejavol диавол=deiavol сз=zz зс=ss сзывать=zzivate госзаказ=gozzakaz кавказский=kavkasskeij зсз=ssz сзс=zzs шёл=szol мышь=misz божьи=bozsji Евангелие=Jevangeeleije"""
ROWS = [("шин", "Schien", "stem", "preserve", "any", None), ("поэт", "poët", "stem", "auto", "any", None), ("зевс", "Zevs", "stem", "auto", "capitalized", None), ("евангелие", "Evangelije", "word", "auto", "any", None), ("жюль", "Jule", "word", "auto", "capitalized", None), ("жюл", "Jule", "stem", "auto", "capitalized", "soft")]
LOANS = "шина=Schiena шины=Schieni поэт=poët поэта=poëta Зевса=Zevsa зевса=zeevsa Евангелие=Evangelije Жюль=Jule Жюля=Julea жюля=zsulea ШИНа=SCHIENa"
SOUNDS = "фактор=factor фаз=phas бренди=brandy абрикос=abrikoos ахиллес=Achilleas ёлк=yolk фальш=fals ж=zh дж=g эй=ui ау=ui у=oe ку=cu кв=qu ск=sc ш=sc щ=sc йолк=yolk ай=i айова=Iowa этика=etica сыр=sir евангел=ευαγγελ философ=φιλοσοφ"
CONSONANTS = "х=x кс=x з=x х=ch ч=ch ш=ch к=qu кв=qu б=b в=b ш=sch с=sch ж=sch п=ph л=ll онор=honor г=h й=j дж=j ц=ts ц=tz ц=cz ч=cz с=ç ж=zh дж=g кв=cu к=cu ск=sc ш=sc щ=sc фаз=phase фальш=fals ахиллес=Achilleas"
UNLIKE = "агиограф=graph факсимиле=facere фалда=Falte"
GREEK = {
    "classical": "ου=u αυ=au ευ=eu υι=ui ῃ=ei ηυ=eu ῳ=oi ωυ=ou ᾳ=ai ᾱυ=au ᾰυ=au Εὔα=Eva εὐαγγέλιον=evangelion Βαβυλών=Babylon Κύρος=Cyros ἄγκυρα=ancyra",
    "alalc": "ου=ou αυ=au ευ=eu υι=ui ηυ=ēu ωυ=ōu Βαβυλών=Babylōn Κύρος=Kyros Γκιζίκης=Gkizikēs Γκέτεμποργκ=Gketemporgk Ουάσιγκτον=Ouasinkton ἄγκυρα=ankyra Μπραντ=Brant Πιτ=Pit Ντίνι=Dini Λαμπέρτο=Lamperto",
    "plain": "Βαβυλών=Babylon Κύρος=Kyros",
    "rich": "Ἄνδρα=Ắndră μοι=moi ἔννεπε=énnepe Μοῦσα=Moûsă πολύτροπον=polý̆tropon ὃς=hós μάλα=mắlă πολλὰ=pollắ",
}
STEMS = "εὐαγγέλιον=evangeli εὐαγγελίου=evangeli εὐαγγελίῳ=evangeli πρόβλημα=problem Ἀχιλλεύς=Achill Ἀπόλλων=Apollon"
READINGS = "ахиллес=ахилес агиограф=агиограф ёлка=елка йолка=йолка жюль=жул этика=етика сыр=сир"
TRIMMED = (("фактор", "factor", "factor"), ("факсимиле", "facere", None), ("фаз", "phase", "phas"), ("фалда", "Falte", None), ("бренди", "brandywein", "brandy"), ("фальшь", "falsus", "fals"), ("фальшак", "falsus", None), ("ёлк", "yolk", "yolk"), ("гиперборе", "Hyperborēī", "Hyperborē"), ("ев", "Eu", "Eu"), ("ев", "Eva", "Ev"), ("исав", "Hesau", "Esau"), ("ев", "eavesdropper", None))
MORPHOLOGY, ETYMOLOGY = "=== Морфологические и синтаксические свойства ===", "=== Этимология ==="
#: (title, body of the Russian section below the morphology heading, categories, row); the row is
#: (stem, latin, reading, original, mode, match_case, source, kind), or the page's disposition.
PAGES = (
    ("трактор", "{{сущ-ru|тра́ктор|м 1a}}\n{{морфо-ru|трактор|+∅}}\n=== Этимология ===\nОт {{lang|en|tractor}}.", [], ("трактор", "tractor", "трактор", "tractor", "stem", "any", "English", "")),
    ("какао", "{{сущ-ru|кака́о|с 0}}\n=== Этимология ===\n{{lang|en|facility}}", [], "filtered"),
    ("лампа", "{{сущ-ru|ла́мпа|ж 1a}}\n=== Этимология ===\nИз нем. Lampe, далее из лат. lampas", [], ("ламп", "Lamp", "ламп", "Lampe", "stem", "any", "German", "")),
    ("сцена", "{{сущ-ru|сце́на|ж 1a}}\n=== Этимология ===\nзаимств. через франц. scène", [], "filtered"),
    ("система", "{{сущ-ru|систе́ма|ж 1a}}\n{{морфо-ru|корень=систем|оконч=а}}\n=== Этимология ===\nот др.-греч. σύστημα", [], ("систем", "system", "систем", "system", "stem", "any", "Greek", "")),
    ("догма", "{{сущ-ru|до́гма|ж 1a}}\n=== Этимология ===\n{{lang|grc|δόγμα}}", [], ("догм", "dogm", "догм", "dogm", "stem", "any", "Greek", "")),
    ("пальто", "{{сущ-ru|пальто́|с неизм}}\n=== Этимология ===\n{{lang|fr|paletot}}", [], "filtered"),
    ("метро", "{{сущ-ru|метро́|с неизм}}\n=== Этимология ===\n{{lang|fr|métro}}", [], ("метро", "metro", "метро", "métro", "word", "any", "French", "")),
    ("Мадрид", "{{сущ-ru|Мадри́д|м 1a}}\n=== Этимология ===\n{{lang|es|Madrid}}", [], ("мадрид", "Madrid", "мадрид", "Madrid", "stem", "capitalized", "Spanish", "")),
    ("марта", "{{сущ-ru|Ма́рта|ж 1a}}\n=== Этимология ===\n{{lang|la|Marta}}", ["Категория:Женские имена"], ("март", "Mart", "март", "Marta", "stem", "capitalized", "Latin", "")),
    ("тракторный", "{{прил ru|тра́кторный}}\n=== Этимология ===\n{{lang|en|tractor}}", [], "skipped"),
    ("порт", "{{сущ-ru|порт|м 1a}}\n=== Этимология ===\nпроисходит от {{этимология:порт|да}}", [], ("порт", "port", "порт", "portus", "stem", "any", "Latin", "")),
    ("гольф", "{{сущ-ru|гольф|м 1a}}\n==== Значение ====\n# игра, возникшая в Великобритании\n=== Этимология ===\n??\n=== Перевод ===\n* {{перев|de|Golfspiel}}\n* {{перев|en|golf}}", [], ("гольф", "golf", "голф", "golf", "stem", "any", "English", "translation")),
    ("сауна", "{{сущ-ru|са́уна|ж 1a}}\n==== Значение ====\n# финская баня\n=== Перевод ===\n* {{t|sv|sauna}}", [], "skipped"),
    ("трактора", "{{сущ-ru|тра́ктор|м 1a}}\n=== Этимология ===\n{{lang|en|tractor}}", [], "skipped"),
    ("робот", "{{сущ-ru|ро́бот|м 1a}}", ["Категория:Слова чешского происхождения/ru"], "filtered"),
    ("alpha", "", [], "skipped"),
    ("вода", "{{сущ-ru|вода́|ж 1d}}", [], "skipped"),
)
#: Template calls of all pages: (name, calls, arguments in all).
TEMPLATE_CALLS = (("-ru-", 18, 0), ("сущ-ru", 16, 32), ("прил ru", 1, 1), ("морфо-ru", 2, 4), ("lang", 9, 18), ("этимология:порт", 1, 1), ("перев", 2, 4), ("t", 1, 2))
#: Etymology templates that pages refer to.
TEMPLATES = (("порт", "{{lang|la|portus}} «гавань»"),)
#: Lines of an appendix; rows (line, source, stem, latin, greek, case) that it gives.
APPENDIX = (
    "* [[пролог]] — не под заголовком",
    "== Из немецкого языка ==",
    "* [[Шахта|шахта]] — {{lang|de|Schachte}}",
    "* [[бутерброд]]&nbsp;— от Butterbrot «хлеб с маслом»",
    "* [[шахта]] — Schacht",
    "просто строка",
    "* без ссылки",
    "=== Из греческого ===",
    "* [[атом]] – ἄτομος",
    "** [[логика#Русский|логика]] - λογική",
    "== Из цыганского языка ==",
    "* [[чувак]] — čuvak",
)
APPENDIX_ROWS = (
    (3, "German", "шахта", "Schachte", None, "capitalized"),
    (4, "German", "бутерброд", "Butterbrot", None, "any"),
    (9, "Greek", "атом", "atom", "ἄτομος", "any"),
    (10, "Greek", "логика", "logice", "λογική", "any"),
    (12, "цыганского", "чувак", "cuvak", None, "any"),
)
#: Markup and its plain text.
MARKUP = (
    ("а [[б|в]] ''г'' {{lang|en|y|z}} <!-- c -->д&nbsp;е<ref>f</ref>", "а в г y д е"),
    ("" + "\x27\x27\x27жи\x27\x27\x27 {{шаблон|a={{b}}}} [[река]]<ref name=x/> &lt;т&gt;", "жи река <т>"),
    ("{{этимология:порт|да}} {{открыт", "порт {{открыт"),
)
#: Spellings without marks; whether they are Latin and Greek terms.
SPELLINGS = (("Ærøskøbing", "AEroskobing", True, False), ("Straße", "Strasse", True, False), ("Łódź", "Lodz", True, False), ("ỳ", "ỳ", True, False), ("λόγος", "λόγος", False, True), ("x2", "x2", False, False), ("nbsp", "nbsp", False, False))


#: (stem, context, suffix, what the suffix becomes).
SUFFIXES = (("шин", "native", "е", "ee"), ("шин", "vowel", "е", "je"), ("шин", "hard", "е", "ae"), ("шин", "soft", "я", "a"), ("шин", "sign", "и", "ji"), ("шин", "j", "ю", "u"), ("шин", "none", "э", "e"), ("жюл", "soft", "ем", "em"), ("чай", None, "я", "a"), ("роль", None, "и", "ji"))
#: Rows, and what their pages add: (title, stem, latin, source, notes, latin then, source then, notes then).
ENRICHED = (
    ("порт", "порт", "port", "French", "n", "portus", "Latin", "n; latin stem from word-page etymology marker; source from word-page origin category"),
    ("тракт", "тракт", "trakt", "German", "", "tract", "German", "latin stem from word-page etymology marker; word page marks etymology as incomplete"),
    ("лак", "лак", "lack", "German", "n", "lack", "German", "n"),
    ("нет", "нет", "net", "French", "n", "net", "French", "n; page enrichment failed"),
)
META_PAGES = (
    ("порт", "=== Этимология ===\nот {{lang|la|portus|гавань}}\n", ["Категория:Слова латинского происхождения/ru"]),
    ("тракт", "=== Этимология ===\nот {{lang|la|tractue}} и {{этимология:дорога|да}}\n", ["Категория:Нужна этимология/ru"]),
    ("лак", "=== Этимология ===\n{{lang|de|Lak}}\n", []),
)
#: Titles of the limited crawl; counts and first rows of the appendix.
LIMITED = ("трактор", "система")
APPENDIX_STATES = (("accepted", 4), ("filtered", 2), ("skipped", 2))
APPENDIX_FIRST = ((4, "бутерброд"), (3, "шахта"))
#: Recorded answers and their pages (title, content, number of categories, problem).
ANSWERS = (
    '{"continue":{"gapcontinue":"м"},"query":{"pages":[{"title":"лампа","revisions":[{"slots":{"main":{"content":"свет"}}}],"categories":[{"title":"a"},{"title":"b"}],"extra":1},{"title":"нора","missing":true}]}}',
    '{"error":{"code":"maxlag","info":"x","lag":6.5}}',
    "no json",
    '{"query":{"pages":[{"title":"пусто"}]}}',
)
DECODED = (("лампа", "свет", 2, None), ("нора", None, 0, "missing"), ("пусто", None, 0, "no revisions"))


def pairs(text):
    return [tuple(x.split("=")) for x in text.split()]


def page_rows():
    """(seq, title, content, categories) of PAGES."""
    return [(k, t, f"= {{{{-ru-}}}} =\n{MORPHOLOGY}\n{body}\n", c) for k, (t, body, c, _) in enumerate(PAGES)]
