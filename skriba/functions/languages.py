"""Donor languages: codes, names, and what texts call them."""

from __future__ import annotations

# Names of languages, and their codes in templates.
NAMES = """English|German|French|Italian|Greek|Latin|Dutch|Hebrew|Swedish|Danish|Spanish|Arabic|Portuguese|Turkish|Turkic|Persian|Chinese|Japanese|Korean|Polish
Finnish|Norwegian|Armenian|Sanskrit|Abkhaz|Albanian|Hungarian|Malay|Aboriginal Australian""".replace("\n", "|").split("|")
CODES = {"en": "English", "de": "German", "fr": "French", "it": "Italian", "el": "Greek", "grc": "Greek", "la": "Latin", "nl": "Dutch", "he": "Hebrew", "hbo": "Hebrew", "sv": "Swedish", "da": "Danish", "es": "Spanish", "ja": "Japanese"}
#: Languages that a crawl takes unless it is told otherwise.
USUAL = "English,German,French,Italian,Greek,Latin,Dutch,Hebrew,Swedish,Danish,Spanish"
# Beginnings of words that name a language in a heading or category, in order.
NAMED_BY = "англий English|француз French|немец German|герман German|нидерланд Dutch|голланд Dutch|итальян Italian|латин Latin|древнегреч Greek|гречес Greek|еврей Hebrew|иврит Hebrew|араб Arabic|испан Spanish|португал Portuguese|турец Turkish|тюрк Turkic|персид Persian|китай Chinese|япон Japanese|корей Korean|польск Polish|финск Finnish|швед Swedish|датск Danish|норвеж Norwegian|армян Armenian|санскрит Sanskrit|абхаз Abkhaz|албан Albanian|венгер Hungarian|малай Malay|австрали Aboriginal Australian"
# What stands before a donor term in a text, in order; "/" between spellings.
MARKERS = "англ./английск English|нем./немецк German|франц./французск French|итал./итальянск Italian|др.-греч./древнегреч/греч./греческ Greek|лат./латинск Latin|нидерл./нидерландск/голл./голландск Dutch|ивр./иврит/евр./еврейск/древнеевр Hebrew|швед./шведск Swedish|датск Danish|исп./испанск Spanish|япон./японск Japanese"
# What in a meaning speaks for a language, anywhere in the text.
MEANINGS = """English англ./английск/англи/британ/великобрит/соединенные штат/соединённые штат/соединенных штат/соединённых штат/сша/американск/канада/канадск
German нем./немецк/германи/германск/австрия/австрийск/швейцари/швейцарск/прусси/прусск/бавари/баварск
French франц./французск/франци/бельгия/бельгийск/квебек/франкоязыч
Italian итал./итальянск/итали/сицилия/сицилийск/сардини/сардинск
Greek др.-греч./древнегреч/греч./греческ/греци/эллад/византия/византийск
Latin лат./латинск/римск/римлян/древнеримск/ватикан
Dutch нидерл./нидерландск/голл./голландск/нидерланд/голланд/фламандск/фландри
Hebrew ивр./иврит/евр./еврейск/древнеевр/израил/иудейск
Swedish швед./шведск/швеци
Danish датск/дания/дании/данию/данией/данийск
Spanish исп./испанск/испани/латиноамериканск/мексик/аргентин/перуан/чилийск/колумбия/колумбийск/кубинск
Japanese япон./японск/япони"""

KNOWN = {n.lower(): n for n in NAMES}
MARKER_TABLE = [(tuple(m.rpartition(" ")[0].split("/")), m.rpartition(" ")[2]) for m in MARKERS.split("|")]
MEANING_TABLE = [(line.split(" ", 1)[0], tuple(line.split(" ", 1)[1].split("/"))) for line in MEANINGS.split("\n")]
_NAMED_TABLE = [tuple(x.split(" ", 1)) for x in NAMED_BY.split("|")]


def canonical(name: str) -> str:
    """The usual name of a language, or what was given where it has none."""
    key = " ".join(name.lower().split()).strip(" .,:;()[]{}").removesuffix(" language")
    return KNOWN.get(key, name.strip())


def from_russian(text: str) -> str:
    """The language that a Russian heading or category names; else the text without the word
    for language."""
    low = " ".join(text.lower().split()).strip(" .,:;()[]{}").removeprefix("из ")
    for word in ("языка", "язык"):
        low = low.replace(word, "")
    low = " ".join(low.split())
    return next((name for start, name in _NAMED_TABLE if start in low), low)


def whitelist(text: str | None) -> list[str]:
    """Names between commas, each once; an unknown one is an error, no name allows all."""
    found = [canonical(part) for part in (text or "").split(",") if part.strip()]
    for name in found:
        if name not in NAMES:
            raise ValueError(f"unknown language {name!r}")
    return list(dict.fromkeys(found))


def meant(text: str) -> list[str]:
    """Languages that a meaning speaks for; spellings may stand inside other words."""
    low = " ".join(text.lower().split())
    return [name for name, spellings in MEANING_TABLE if any(s in low for s in spellings)]
