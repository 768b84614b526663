"""Does a Latin or Greek spelling sound like a Russian word?

The Russian side is a reading in built-in expressions; the other side's units have
alternative readings, so a spelling is a regular language, and one anchored pattern.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

# Alternative readings of source units, "/" between them, "-" for silence.
LATIN_CLUSTERS = "sch ш/с/ж zh ж ph ф/п th т/ф ch х/ч/ш/к sh ш ll л cu кв/к/ку qu кв/к/ку sc ск/ш/щ ts ц tz ц cz ц/ч ck к"
LATIN_VOWEL_CLUSTERS = "eau о ai е/ай/аи/ей au о/ау/ав eu е/ев/ой ou у/оу/ау/о ui уи/и/ей/ау oe е/ое/у yo е/йо ei ей/е/ай oi ой/уа/ои ae е/ай/ае ie и/ие/е ea и/е/еа ee и/е oo у/о ue у/е"
LATIN_CONSONANTS = "b б/в p п f ф v в w в g г/ж/дж c к/с/ц/ч k к q к h х/к/г/- x х/кс/з d д t т s с/з/ш/ж/щ/ц z з/с/ц/ж j й/ж/дж l л r р m м n н"
LATIN_VOWELS = "a а/е e е/и/а i и/е/й/ай o о u у/и y и/ай/й/-"
GREEK_CLUSTERS = "γγ нг/г γκ нк/гк/к γχ нх/гх μπ б/мп ντ д/нт τζ дз/дж τσ ц/тс"
GREEK_VOWEL_CLUSTERS = "αι е/ай/аи ει и/ей/еи οι и/ой/ои υι и/уи/ви ου у αυ ав/ау ευ ев/еу ηυ ев/еу"
GREEK_CONSONANTS = "β б/в γ г/й δ д ζ з/дз θ т/ф κ к λ л μ м ν н ξ кс/х π п ρ р σ с/з ς с/з τ т φ ф/п χ х/к ψ пс"
GREEK_VOWELS = "α а/е ε е η и/е ι и/й ο о ω о υ и/у/в"
RUSSIAN_CONSONANTS = "бпфвйгкхчдтсзшжщцлрмн"
RUSSIAN_VOWELS = "аеиоу"
PUNCTUATION = " \t\r\n.,;:()[]{}<>\"“”«»„'’ʼʻ-"
#: Latin vowels, with the marks that count.
FINAL_VOWELS = "aeiouyáàâäãåāăąéèêëēĕėęěíìîïīĭįóòôöõøōŏőúùûüūŭůűųýỳŷÿ"
# Letters that no decomposition explains, and letters with marks that are left as they are.
SPELT_OUT = "Æ AE Ǽ AE Ǣ AE æ ae ǽ ae ǣ ae Œ OE œ oe ẞ SS ß ss Þ Th þ th Ð D ð d Đ D đ d Ħ H ħ h ı i ĸ k Ŀ L ŀ l Ł L ł l ŉ n Ø O ø o Ǿ O ǿ o ſ s Ŧ T ŧ t"
MARKED_RANGES = ((0x00C0, 0x017F), (0x01CD, 0x01D4), (0x01FA, 0x01FB), (0x01A0, 0x01A1), (0x01AF, 0x01B0), (0x1E00, 0x1E95))
LEFT_MARKED = "ḠṼṽṾṿ"


def _table(*texts: str) -> dict[str, list[str]]:
    words = " ".join(texts).split()
    return {u: ["" if r == "-" else r for r in rs.split("/")] for u, rs in zip(words[::2], words[1::2])}


def reading(word: Column, vowels: bool = True) -> Column:
    """What a Russian word sounds like: doubled consonants once, vowels folded, signs gone."""
    out = F.regexp_replace(F.lower(word), f"([{RUSSIAN_CONSONANTS}])\\1+", "$1")
    out = F.translate(out, "яёэыюьъ", "аееиу")
    return F.regexp_replace(out, f"[^{RUSSIAN_CONSONANTS}{RUSSIAN_VOWELS if vowels else ''}]", "")


def _without_marks() -> dict[str, str]:
    """Letters with marks and what is left of them: by decomposition in MARKED_RANGES, and the
    letters that are spelt out."""
    out = {}
    for first, last in MARKED_RANGES:
        for code in range(first, last + 1):
            base = unicodedata.normalize("NFD", chr(code))[0]
            if base != chr(code) and base.isascii() and chr(code) not in LEFT_MARKED:
                out[chr(code)] = base
    words = SPELT_OUT.split()
    return out | dict(zip(words[::2], words[1::2]))


WITHOUT_MARKS = _without_marks()


def strip_diacritics(text: Column) -> Column:
    """Latin letters without their marks, in built-in expressions; other letters stay."""
    out = F.regexp_replace(text, "\\p{Mn}", "")
    single = {c: r for c, r in WITHOUT_MARKS.items() if len(r) == 1}
    for c, r in WITHOUT_MARKS.items():
        if len(r) > 1:
            out = F.replace(out, F.lit(c), F.lit(r))
    return F.translate(out, "".join(single), "".join(single.values()))


def plain(text: str) -> str:
    """Latin letters without the marks that are known, Greek ones without any."""
    out = []
    for c in text:
        greek = "\u0370" <= c <= "\u03ff" or "\u1f00" <= c <= "\u1fff"
        out.append(unicodedata.normalize("NFD", c)[0] if greek else WITHOUT_MARKS.get(c, c))
    return "".join(c for c in "".join(out) if unicodedata.category(c) != "Mn")


def units(source: str, vowels: bool = True) -> list[list[str]]:
    """Alternative readings of a spelling's units, longest units first; letters without a
    reading are skipped."""
    text = plain(source.lower())
    greek = any("GREEK" in unicodedata.name(c, "") for c in text)
    if greek:
        consonants, vowel_table = _table(GREEK_CLUSTERS, GREEK_CONSONANTS), _table(GREEK_VOWEL_CLUSTERS, GREEK_VOWELS)
    else:
        consonants, vowel_table = _table(LATIN_CLUSTERS, LATIN_CONSONANTS), _table(LATIN_VOWEL_CLUSTERS, LATIN_VOWELS)
    table = consonants | (vowel_table if vowels else {})
    if not vowels and not greek:
        table = table | {"cu": ["кв", "к"], "qu": ["кв", "к"]}
    out, at = [], 0
    while at < len(text):
        for n in (3, 2, 1):
            unit = text[at : at + n]
            if len(unit) == n and unit in table:
                out.append(table[unit])
                at += n
                break
        else:
            at += 1
    return out


def pattern(source: str, vowels: bool = True) -> str:
    """A regular expression for all readings of a spelling."""
    return "".join(f"(?:{'|'.join(u)})" for u in units(source, vowels))


def matches(target: str, source: str, vowels: bool = True) -> bool:
    """Whether one reading of the source is the target; nothing matches nothing only."""
    return bool(target) and re.fullmatch(pattern(source, vowels), target) is not None


def trim_to_sound(target: str, source: str, drop_vowels: bool) -> tuple[str, str] | None:
    """The shortest prefix of a spelling (or a variant of it) that sounds like the target, if
    it has at least half of the spelling's letters."""
    letters = sum(c.isalpha() for c in source)
    for end in range(1, len(source) + 1):
        prefix = source[:end].rstrip(PUNCTUATION)
        short = prefix
        if drop_vowels and target[-1:] not in RUSSIAN_VOWELS:
            short = prefix[:1] + prefix[1:].rstrip(FINAL_VOWELS + FINAL_VOWELS.upper())
        variants = dict.fromkeys((_without_h(prefix), prefix, _without_h(short), short))
        if 2 * sum(c.isalpha() for c in prefix) >= letters:
            for v in variants:
                if v and matches(target, v):
                    return v, target
    return None


def _without_h(text: str) -> str:
    if text[:1] not in ("h", "H") or len(text) < 2:
        return text
    return text[1].upper() + text[2:] if text[0] == "H" else text[1:]


@F.pandas_udf(BooleanType())
def sounds_like(target: pd.Series, source: pd.Series) -> pd.Series:
    """Readings of a Russian word (with vowels) against a spelling."""
    return pd.Series([None if t is None or s is None else matches(t, s) for t, s in zip(target, source)])


@F.pandas_udf(BooleanType())
def consonants_like(target: pd.Series, source: pd.Series) -> pd.Series:
    """Readings without vowels against a spelling's consonants."""
    return pd.Series([None if t is None or s is None else matches(t, s, False) for t, s in zip(target, source)])


_TRIMMED = StructType([StructField("stem", StringType()), StructField("reading", StringType())])


def _trimmed(drop_vowels: bool):
    @F.pandas_udf(_TRIMMED)
    def run(target: pd.Series, source: pd.Series) -> pd.DataFrame:
        got = [trim_to_sound(t, s, drop_vowels) if t and s else None for t, s in zip(target, source)]
        return pd.DataFrame({"stem": [g[0] if g else None for g in got], "reading": [g[1] if g else None for g in got]})

    return run


#: Shortest sounding prefix of a spelling; `trimmed_stem` drops final vowels behind consonants.
trimmed_stem, sounding_stem = _trimmed(True), _trimmed(False)
