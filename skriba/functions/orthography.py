"""Native orthography: Cyrillic words to Latin letters, in built-in expressions only.

A letter's output depends on the class of the letter before it. In small letters it is always
one Latin letter, with another one ahead of it in some classes: that one is set first, while
the consonants are still Cyrillic, one pass for each; one translation does the rest. With
capitals a mark for the class is set instead, and marked letters are replaced as strings, for
the small and the capital letter. Words in capitals are converted in small letters and raised
as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letter classes and outputs.
PAIRED = "бвгдзклмнпрстфх"
HARD = "жшц"
SOFT = "чщ"
VOWELS = "аеёиоуыэюя"
ONE_TO_ONE = ("бвгдзклмнпрстфхаоуыйБВГДЗКЛМНПРСТФХАОУЫЙ", "bvgdzklmnprstfxaouijBVGDZKLMNPRSTFXAOUIJ")
DIGRAPHS = (("ж", "zs"), ("ш", "sz"), ("ц", "tz"), ("ч", "cz"), ("щ", "sze"))
JOTATED = (("ё", "o"), ("ю", "u"), ("я", "a"))
#: A letter of each class, and its output: they stand for the end of a stem.
SENTINELS = (("vowel", "о", "o"), ("paired", "к", "k"), ("hard", "ш", "sz"), ("soft", "ч", "cz"), ("sign", "ъ", ""), ("j", "й", "j"), ("none", "", ""))
LETTER = "[а-яёА-ЯЁ]"
TOKENS = "[а-яёА-ЯЁ]+|[^а-яёА-ЯЁ]+"
#: Stands before the second letter of a pair that is written as one.
_PAIR_MARK = "\ue000"
#: Stand before a letter: what stands before that is paired, hard, soft or й, a sign, any letter.
_PAIRED, _HARD, _SOFT, _SIGN, _ANY = "\ue001", "\ue002", "\ue003", "\ue004", "\ue005"


#: More characters than a string can have.
ALL = (1 << 31) - 1


def _both(letters: str) -> str:
    return letters + letters.upper()


def _marks() -> list[tuple[str, str, str]]:
    """(letters before, letters behind, mark)."""
    return [(PAIRED, "иеёюяь", _PAIRED), (HARD, "еёюя", _HARD), (SOFT + "й", "еёюя", _SOFT), ("ьъ", "и", _SIGN)]


def _replacements() -> list[tuple[str, str]]:
    """Marked letters, then those without a mark, and what is written for them."""
    out = [(_PAIRED + "и", "ei"), (_SIGN + "и", "ji"), ("и", "i")]
    out += [(_PAIRED + "е", "ee"), (_HARD + "е", "ae"), (_SOFT + "е", "e"), ("е", "je")]
    for letter, written in JOTATED:
        out += [(_PAIRED + letter, "e" + written), (_HARD + letter, written), (_SOFT + letter, written), (letter, "j" + written)]
    return [*out, (_PAIRED + "ь", "e"), (_ANY + "э", "ae"), ("э", "e")]


#: Pairs that are written as one, by the letter that is left of them.
_PAIRS = ((_PAIR_MARK + "с", "zz"), (_PAIR_MARK + "з", "ss"))


def _small(word: Column) -> Column:
    out = F.regexp_replace(word, "(с)з|(з)с", f"{_PAIR_MARK}$1$2")
    out = F.regexp_replace(out, f"(?<=[{PAIRED}])(?=[иеёюяь])", _PAIRED)
    out = F.regexp_replace(out, f"(?<=[{HARD}])(?=е)|(?<=[а-яё])(?=э)", _HARD)
    out = F.regexp_replace(out, f"(?<=[ьъ])(?=и)|(?<![{PAIRED}{HARD}{SOFT}й{_PAIRED}{_HARD}])(?=[еёюя])", _SIGN)
    for letter, result in (*_PAIRS, *DIGRAPHS):
        out = F.replace(out, F.lit(letter), F.lit(result))
    return F.translate(out, ONE_TO_ONE[0] + "иеёюяэ" + _PAIRED + _HARD + _SIGN + "ьъ", ONE_TO_ONE[1] + "ieouae" + "eaj")


def native(word: Column, capitals: bool = True) -> Column:
    """Letters of a text converted by the native rules, letter by letter; a word in capitals
    is not raised as a whole here. Null stays null. Without `capitals` only small
    letters are looked for."""
    if not capitals:
        return _small(word)
    # The case of a pair is its first letter's, whatever the second's is.
    out = F.regexp_replace(word, "([сС])[зЗ]|([зЗ])[сС]", f"{_PAIR_MARK}$1$2")
    out = F.regexp_replace(out, f"(?<={LETTER})(?=[эЭ])", _ANY)
    for before, behind, mark in _marks():
        out = F.regexp_replace(out, f"(?<=[{_both(before)}])(?=[{_both(behind)}])", mark)
    for letter, result in (*_replacements(), *_PAIRS, *DIGRAPHS):
        out = F.replace(out, F.lit(letter), F.lit(result))
        out = F.replace(out, F.lit(letter[:-1] + letter[-1].upper()), F.lit(result[:1].upper() + result[1:]))
    return F.translate(out, ONE_TO_ONE[0] + "ьъЬЪ", ONE_TO_ONE[1])


def all_caps(word: Column) -> Column:
    """Two letters or more, none of them small."""
    return (F.length(word) > 1) & (word == F.upper(word)) & word.rlike(LETTER)


def convert_word(word: Column) -> Column:
    """One word (or run of other characters) with its case."""
    return F.when(all_caps(word), F.upper(native(F.lower(word), False))).otherwise(native(word))


def tokens(text: Column) -> Column:
    """Words and the runs between them, in order; joined they are the text."""
    return F.regexp_extract_all(text, F.lit(TOKENS), F.lit(0))


def convert_text(text: Column) -> Column:
    """A whole text. Texts without two capitals in a row need no tokens."""
    by_token = F.array_join(F.transform(tokens(text), convert_word), "")
    return F.when(~text.rlike("[А-ЯЁ]"), native(text, False)).when(text.rlike("[А-ЯЁ]{2}"), by_token).otherwise(native(text))


def suffix_class(name: Column, stem: Column) -> Column:
    """The class that a suffix stands behind: a named one, or that of the stem's last
    letter. Unknown names count as native."""
    last = F.lower(F.right(stem, F.lit(1)))
    own = F.when(last.rlike(f"[{VOWELS}]"), "vowel").when(last.rlike(f"[{PAIRED}]"), "paired").when(last.rlike(f"[{HARD}]"), "hard").when(last.rlike(f"[{SOFT}]"), "soft").when(last.rlike("[ьъ]"), "sign").when(last == "й", "j").otherwise("none")
    return F.when(name.isin("none", "vowel", "paired", "hard", "soft", "sign", "j"), name).otherwise(own)


def convert_suffix(suffix: Column, kind: Column, whole_caps: Column) -> Column:
    """A suffix behind a stem of this class; raised if the whole word is in capitals."""
    letter, length = F.lit(""), F.lit(0)
    for name, sentinel, result in SENTINELS:
        letter = F.when(kind == name, sentinel).otherwise(letter)
        length = F.when(kind == name, len(result)).otherwise(length)
    small = F.upper(native(F.concat(letter, F.lower(suffix)), False))
    return F.substring(F.when(whole_caps, small).otherwise(native(F.concat(letter, suffix))), length + 1, F.lit(ALL))


def raise_first(text: Column) -> Column:
    return F.concat(F.upper(F.left(text, F.lit(1))), F.substring(text, 2, ALL))


def lower_first(text: Column) -> Column:
    return F.concat(F.lower(F.left(text, F.lit(1))), F.substring(text, 2, ALL))


def pseudo_cyrillic(text: Column) -> Column:
    """Latin-letter test prose respelt in all 33 Cyrillic letters."""
    out = F.lower(text)
    for a, b in RESPELLING:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.translate(out, LATIN_LETTERS, CYRILLIC_LETTERS)


# Fixed values of the test respelling.
RESPELLING = (("th", "ж"), ("ch", "ч"), ("sh", "ш"), ("er", "э"), ("ou", "ю"), ("on", "ё"), ("en", "ь"), ("re", "щ"), ("an", "ъ"))
LATIN_LETTERS, CYRILLIC_LETTERS = "abcdefghijklmnopqrstuvwxyz", "абцдефгхийклмнопярстуввхыз"
