"""Greek text in Latin letters: Classical and ALA-LC, plain, with length marks, or rich.

Every character is decomposed into a base letter and its marks; marks decide breathing,
length, accent and subscript. Runs as Arrow functions: Spark has no Unicode
decomposition.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Marks, and what letters and their combinations become.
ACUTE, GRAVE, CIRCUMFLEX, ROUGH, DIAERESIS, SUBSCRIPT, LONG, SHORT = "\u0301", "\u0300", "\u0342", "\u0314", "\u0308", "\u0345", "\u0304", "\u0306"
SAME_MARK = {"\u0341": ACUTE, "\u0340": GRAVE, "\u0302": CIRCUMFLEX}
KEPT_MARKS = {ACUTE, GRAVE, CIRCUMFLEX, ROUGH, DIAERESIS, SUBSCRIPT, LONG, SHORT}
#: Precomposed letters with an oxia that are passed through as they are.
PASSED = {chr(c) for c in (0x1F71, 0x1F73, 0x1F75, 0x1F77, 0x1F79, 0x1F7B, 0x1F7D, 0x1FBB, 0x1FC9, 0x1FCB, 0x1FD3, 0x1FDB, 0x1FE3, 0x1FEB, 0x1FF9, 0x1FFB)}
LETTERS = "αβγδεζηθικλμνξοπρσςτυφχψωϝ"
VOWELS = "αεηιουω"
SINGLES = dict(zip("αβγδεζηθικλμνξοπρσςτυφχψωϝ", "a b g d e z e th i k l m n x o p r s s t y ph ch ps o w".split()))
DIPHTHONGS = {"αι": "ai", "αυ": "au", "ει": "ei", "ευ": "eu", "ηυ": "eu", "οι": "oi", "ου": "ou", "υι": "ui", "ωυ": "ou"}
CLASSICAL_DIPHTHONGS = {"αι": "ae", "αυ": "au", "ει": "e", "ευ": "eu", "ηυ": "eu", "οι": "oe", "ου": "u", "υι": "ui", "ωυ": "ou"}
BEFORE_VOWEL = {"αυ": "av", "ευ": "ev", "ηυ": "ev", "ωυ": "ov"}
TRIMMED = " \t\r\n-'’ʼʻ."
#: Endings of a declension stem with the letters they lose, in order; "ξ" and "ψ" are replaced.
ENDINGS = (("μα", 1), ("ξ", "κ"), ("ψ", "π"), ("ευσ", 3), ("ιον", 2), ("ιου", 2), ("ιοισ", 3), ("ιων", 2), ("ιοι", 2), ("ιω", 1), ("ια", 1), ("ον", 1), ("οσ", 1), ("ασ", 1), ("ησ", 1), ("ουσ", 1), ("ισ", 1), ("υσ", 1), ("ωσ", 1))


class Token:
    """A letter with its marks, or any other character as it is."""

    __slots__ = ("base", "raw", "upper", "marks", "start", "end")

    def __init__(self, base, raw, upper, marks, start, end):
        self.base, self.raw, self.upper, self.marks, self.start, self.end = base, raw, upper, marks, start, end


def tokenise(text: str) -> list[Token]:
    """Marks belong to the character before them, whatever it is."""
    out: list[Token] = []
    for at, c in enumerate(text):
        if unicodedata.category(c) == "Mn":
            mark = SAME_MARK.get(c, c)
            if out:
                out[-1].end = at + 1
                if mark in KEPT_MARKS:
                    out[-1].marks.add(mark)
            continue
        parts = [SAME_MARK.get(x, x) for x in unicodedata.normalize("NFD", c)]
        base = parts[0].lower()
        if base in LETTERS and c not in PASSED:
            out.append(Token(base, c, parts[0] != base and parts[0].isupper(), {m for m in parts[1:] if m in KEPT_MARKS}, at, at + 1))
        else:
            out.append(Token("", c, False, set(), at, at + 1))
    return out


def _raise(text: str, upper: bool) -> str:
    return text[:1].upper() + text[1:] if upper else text


def _accented(text: str, marks: set, last: bool) -> str:
    """The accent on the first or last vowel; grave counts as acute."""
    mark = "\u0302" if CIRCUMFLEX in marks else ACUTE if ACUTE in marks or GRAVE in marks else ""
    places = [k for k, c in enumerate(text) if unicodedata.normalize("NFD", c)[0] in "aeiouy"]
    if not mark or not places:
        return text
    k = places[-1 if last else 0]
    # A breve that stands alone stays behind the accent.
    end = k + 1
    return text[:k] + unicodedata.normalize("NFC", text[k:end] + mark) + text[end:]


def romanise(text: str | None, mode: str = "alalc") -> str | None:
    """`mode`: classical, plain, alalc (long e and o marked) or rich (lengths and accents)."""
    if text is None:
        return None
    classical, marked, rich = mode == "classical", mode in ("alalc", "rich"), mode == "rich"
    # Without rich marks ALA-LC writes eta and omega long.
    tokens = tokenise(text)
    out, k = [], 0
    while k < len(tokens):
        t = tokens[k]
        if not t.base:
            out.append(t.raw)
            k += 1
            continue
        first = k == 0 or not tokens[k - 1].base
        after = tokens[k + 1] if k + 1 < len(tokens) and tokens[k + 1].base else None
        pair = t.base + (after.base if after else "")
        if after and pair in DIPHTHONGS and DIAERESIS not in after.marks and SUBSCRIPT not in t.marks | after.marks:
            third = tokens[k + 2] if k + 2 < len(tokens) and tokens[k + 2].base else None
            if classical:
                got = BEFORE_VOWEL[pair] if pair in BEFORE_VOWEL and third and third.base in VOWELS else CLASSICAL_DIPHTHONGS[pair]
            else:
                got = {"ηυ": "ēu", "ωυ": "ōu"}.get(pair, DIPHTHONGS[pair]) if marked else DIPHTHONGS[pair]
            got = _accented(got, t.marks | after.marks, True) if rich else got
            got = "h" + got if ROUGH in t.marks | after.marks else got
            out.append(_raise(got, t.upper))
            k += 2
            continue
        last = k + 2 >= len(tokens) or not tokens[k + 2].base
        cluster = {"γγ": "ng", "γξ": "nx", "γχ": "nch"}.get(pair) or ("nc" if classical else "gk" if first or last else "nk") * (pair == "γκ")
        if not classical and not cluster:
            cluster = {"μπ": "b" if first else "mp", "ντ": "d" if first else "nt"}.get(pair, "")
        if after and cluster:
            out.append(_raise(cluster, t.upper))
            k += 2
            continue
        got = SINGLES[t.base]
        if classical and t.base == "κ":
            got = "c"
        if t.base == "ρ" and (ROUGH in t.marks or first or tokens[k - 1].base == "ρ"):
            got = "rh"
        if t.base in "ηω" and marked:
            got = "ē" if t.base == "η" else "ō"
        if t.base in "αιυ" and not classical and marked:
            length = LONG if LONG in t.marks else SHORT if SHORT in t.marks else DIAERESIS if DIAERESIS in t.marks and t.base == "ι" else ""
            if rich and not length and CIRCUMFLEX not in t.marks:
                length = SHORT
            got = unicodedata.normalize("NFC", got + length)
        if SUBSCRIPT in t.marks:
            got = "ai" if t.base == "α" else ("ei" if t.base == "η" else "oi") if classical and t.base in "ηω" else got + "i"
        if rich:
            got = _accented(got, t.marks, False)
        if ROUGH in t.marks and t.base != "ρ":
            got = "h" + got
        out.append(_raise(got, t.upper))
        k += 1
    return "".join(out)


def declension_stem(text: str | None) -> str | None:
    """The word without its ending; texts of fewer than three letters stay."""
    if text is None:
        return None
    letters = [t for t in tokenise(text) if t.base]
    if len(letters) < 3:
        return text
    base = "".join("σ" if t.base == "ς" else t.base for t in letters)
    for ending, loss in ENDINGS:
        if base.endswith(ending):
            if isinstance(loss, str):
                return text[: letters[-1].start] + loss + text[letters[-1].end :]
            return text[: letters[-loss].start].rstrip(TRIMMED)
    return text


#: Letters and marks that may belong to a Greek word; nothing else acts on its neighbours.
_RUN = re.compile("[\u0300-\u036f\u0370-\u03ff\u1f00-\u1fff]+")


def _between(text: str) -> str:
    """What stands between Greek words; marks on other letters are dropped."""
    return text if text.isascii() else "".join(c for c in text if unicodedata.category(c) != "Mn")


def romanise_text(text: str, mode: str, known: dict[str, str]) -> str:
    """A whole text, word by word: every different word is romanised once."""
    out, at = [], 0
    for m in _RUN.finditer(text):
        out.append(_between(text[at : m.start()]))
        word = m[0]
        if word not in known:
            if len(known) >= KNOWN_WORDS:
                known.clear()
            known[word] = romanise(word, mode)
        out.append(known[word])
        at = m.end()
    return "".join(out) + _between(text[at:])


#: Words that a task remembers.
KNOWN_WORDS = 200_000


def _function(mode: str):
    @F.pandas_udf(StringType())
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, str] = {}
        for text in parts:
            yield text.map(lambda t: romanise_text(t, mode, known), na_action="ignore")

    return run


romanise_classical, romanise_alalc, romanise_plain, romanise_rich = (_function(m) for m in ("classical", "alalc", "plain", "rich"))


@F.pandas_udf(StringType())
def greek_stem(text: pd.Series) -> pd.Series:
    return text.map(declension_stem, na_action="ignore")


def pseudo_greek(text):
    """Latin-letter test prose in Greek letters, without marks."""
    return F.translate(F.lower(text), *RESPELLING)


# Fixed values of the test respelling.
RESPELLING = ("abcdefghijklmnopqrstuvwxyz", "αβψδεφγηιξκλμνοπχρστυβωθυζ")
