"""Wiki markup: a scanner for plain text, templates, sections, links and donor terms.

Texts are read from left to right, once; nested braces are kept on a stack.
"""

from __future__ import annotations

import functools
import html
import re
import unicodedata
from html.entities import html5

from skriba.functions.languages import CODES, MARKER_TABLE, canonical

# Names of templates, and characters that are cut off terms.
TRANSLATION_TEMPLATES = {"перев", "перев+", "перев-", "t", "t+", "t-", "t0", "tø", "trad", "trad+", "trad-"}
REFERENCE = "этимология:"
EDGES = " \t\r\n.,;:()[]{}<>\"“”«»"
APOSTROPHES = "’ʼʻ"
LEADING_WORDS = ("от ", "из ", "сокр. от ", "сокр. ", "искаж. ", "собств. ", "собственное ")
#: Words that a donor term may have.
TERM_WORDS = 5
_CLOSED = re.compile("&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);")


@functools.lru_cache(1 << 14)
def script(c: str) -> str:
    """latin, greek, cyrillic, mark, other (letters and digits), or nothing."""
    if unicodedata.category(c) == "Mn":
        return "mark"
    if not (c.isalpha() or c.isdigit()):
        return ""
    name = unicodedata.name(c, "").split(" ")[0].lower()
    return name if name in ("latin", "greek", "cyrillic") else "other"


def _closing(text: str, at: int, opening: str, closing: str) -> int:
    """Where the closing of what opens at `at` begins; -1 without one."""
    depth, k = 0, at
    while k < len(text) - 1:
        two = text[k : k + 2]
        if two == opening:
            depth, k = depth + 1, k + 2
        elif two == closing:
            depth -= 1
            if not depth:
                return k
            k += 2
        else:
            k += 1
    return -1


def arguments(body: str) -> list[str]:
    """Parts of a template's inside between bars that no inner template holds."""
    out, depth, start, k = [], 0, 0, 0
    while k < len(body):
        two = body[k : k + 2]
        if two in ("{{", "}}"):
            depth = depth + 1 if two == "{{" else max(0, depth - 1)
            k += 2
            continue
        if body[k] == "|" and not depth:
            out.append(body[start:k].strip())
            start = k + 1
        k += 1
    return [*out, body[start:].strip()]


def _skipped(text: str, k: int) -> int:
    """The end of a comment or reference that begins at k, else k."""
    if text.startswith("<!--", k):
        end = text.find("-->", k)
        return end + 3 if end >= 0 else k
    if text.startswith("<ref", k) and not text[k + 4 : k + 5].isalnum():
        tag = text.find(">", k)
        if tag >= 0 and text[tag - 1] == "/":
            return tag + 1
        end = text.find("</ref>", k)
        return end + 6 if tag >= 0 and end >= 0 else k
    return k


def _plain(text: str) -> str:
    out, k = [], 0
    while k < len(text):
        c = text[k]
        if c == "<" and (end := _skipped(text, k)) > k:
            out.append(" ")
            k = end
        elif c == "{" and text.startswith("{{", k) and (end := _closing(text, k, "{{", "}}")) >= 0:
            parts = arguments(text[k + 2 : end])
            name = parts[0].lower()
            if name == "lang" and len(parts) > 2:
                out.append(_plain(parts[2]))
            elif name.startswith(REFERENCE):
                out.append(parts[0][len(REFERENCE) :])
            else:
                out.append(" ")
            k = end + 2
        elif c == "[" and text.startswith("[[", k) and (end := _closing(text, k, "[[", "]]")) >= 0:
            target, bar, shown = text[k + 2 : end].partition("|")
            out.append(_plain(shown if bar and shown else target))
            k = end + 2
        elif c == "'":
            end = k
            while end < len(text) and text[end] == "'":
                end += 1
            # Three mark bold, two italics; one is left of four or seven.
            out.append("'" if (end - k) % 3 == 1 else "")
            k = end
        else:
            out.append(c)
            k += 1
    return "".join(out)


def closed_entities(text: str) -> str:
    """The text with those entities resolved that a semicolon ends; of a page that was cut off
    within one (&amp, &quot) its letters stay."""
    return _CLOSED.sub(lambda m: html.unescape(m[0]) if m[0][1] == "#" else html5.get(m[0][1:], m[0]), text)


def strip_markup(text: str, resolved=html.unescape) -> str:
    """Plain text: entities resolved (by `resolved`); comments, references and templates gone, but for the
    terms of lang and etymology templates; of links what they show; white space compacted."""
    return " ".join(_plain(resolved(text).replace("\xa0", " ")).split())


def template_calls(text: str) -> list[list[str]]:
    """Calls of balanced {{...}}, an inner one before the one around it; each is its name and
    arguments, split at bars outside inner calls."""
    out, open_, at = [], [], 0
    while at < len(text) - 1:
        two = text[at : at + 2]
        if two == "{{":
            open_.append(at + 2)
            at += 2
        elif two == "}}" and open_:
            out.append(arguments(text[open_.pop() : at]))
            at += 2
        else:
            at += 1
    return [c for c in out if c[0]]


def template_name(call: list[str]) -> str:
    return " ".join(call[0].replace("_", " ").lower().split())


def named_arguments(call: list[str]) -> dict[str, str]:
    """Values by lower-case name; the last of a name counts."""
    pairs = (a.partition("=") for a in call[1:] if "=" in a)
    return {k.strip().lower(): v.strip() for k, _, v in pairs if k.strip()}


def free_arguments(call: list[str]) -> list[str]:
    """Arguments without a name."""
    return [a for a in call[1:] if not a.partition("=")[1] or not a.partition("=")[0].strip()]


def heading(line: str) -> tuple[int, str]:
    """Level and title of a heading line; level 0 for any other line."""
    bare = line.strip()
    level, tail = len(bare) - len(bare.lstrip("=")), len(bare) - len(bare.rstrip("="))
    title = bare.strip("=").strip()
    return (level, title) if title and level >= 2 and tail >= level else (0, "")


def sections(text: str, names: set[str]) -> list[str]:
    """Bodies of the sections of these (lower-case) names; each ends at the next heading of its
    level or above, and blank ones are left out."""
    out: list[str] = []
    level, body = 0, []
    for line in [*text.split("\n"), None]:
        here, title = (1, "") if line is None else heading(line)
        if here and level and here <= level:
            out.append("\n".join(body))
            level, body = 0, []
        if here and not level and strip_markup(title).lower() in names:
            level = here
        elif level and line is not None:
            body.append(line)
    return [s for s in out if s.strip()]


def _is_top(line: str) -> bool:
    bare = line.rstrip()
    return len(bare) > 2 and bare[0] == "=" == bare[-1] and bare[1:].lstrip()[:1] not in ("=", "")


def russian_section(text: str) -> str | None:
    """What stands below the heading of the Russian section up to the next top-level one."""
    out: list[str] | None = None
    for line in text.split("\n"):
        if _is_top(line):
            if out is not None:
                break
            if line.rstrip()[1:-1].strip() == "{{-ru-}}":
                out = []
        elif out is not None:
            out.append(line)
    return None if out is None else "\n".join(out)


def etymologies(section: str) -> list[str]:
    """Bodies below third-level etymology headings, each up to the next third-level heading
    that is set off by a blank."""
    out: list[list[str]] = []
    open_ = False
    for line in section.split("\n"):
        if line.startswith("===") and heading(line) == (3, "Этимология"):
            out.append([])
            open_ = True
        elif line.startswith("===") and line[3:4].isspace() and line.rstrip().endswith("==="):
            open_ = False
        elif open_:
            out[-1].append(line)
    return ["\n".join(body) for body in out]


def morphology(section: str) -> str:
    """The morphology sections, or what stands before the etymology."""
    found = sections(section, {"морфологические и синтаксические свойства"})
    if found:
        return "\n".join(found)
    before: list[str] = []
    for line in section.split("\n"):
        if line.startswith("===") and heading(line) == (3, "Этимология"):
            break
        before.append(line)
    return "\n".join(before)


def tidy_term(text: str) -> str:
    """One blank between words, one kind of apostrophe, no punctuation at words' edges."""
    for c in APOSTROPHES:
        text = text.replace(c, "'")
    return " ".join(w for w in (x.strip(EDGES) for x in text.strip(EDGES).split()) if w)


def is_term(text: str, of: str) -> bool:
    """Letters of one script only, at least one, no digits; marks, blanks and punctuation may
    stand between them. Leftovers of markup are no Latin terms."""
    kinds = {script(c) for c in text}
    return of in kinds and kinds <= {of, "mark", ""} and not (of == "latin" and text.lower() in ("nbsp", "ref"))


def term_end(text: str, at: int, of: str) -> int:
    """End of up to TERM_WORDS words of a script that begin at `at`; `at` itself without any."""
    end = at
    for _ in range(TERM_WORDS):
        if at >= len(text) or script(text[at]) != of:
            break
        while at < len(text) and (script(text[at]) in (of, "mark") or text[at] in "'.-" + APOSTROPHES):
            at += 1
        end = at
        while at < len(text) and text[at].isspace():
            at += 1
        if at == end:
            break
    return end


def terms(text: str, of: str):
    """All terms of a script, from left to right."""
    at = 0
    while at < len(text):
        end = term_end(text, at, of)
        if end > at:
            yield text[at:end]
        at = max(end, at + 1)


def candidate(source: str, latin: str | None = None, greek: str | None = None, kind: str = "", ref: str | None = None) -> dict:
    return {"source": source, "latin": latin, "greek": greek, "kind": kind, "ref": ref}


def term_candidate(source: str, raw: str) -> dict | None:
    """A donor term in Latin letters, or in Greek ones where the source is Greek."""
    term = tidy_term(strip_markup(raw))
    if is_term(term, "latin"):
        return candidate(source, latin=term)
    if source == "Greek" and is_term(term, "greek"):
        return candidate(source, greek=term)
    return None


def marked_candidates(text: str) -> list[dict]:
    """Terms right behind a language's marker in plain text, in the order of the text."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    found = []
    for order, (spellings, source) in enumerate(MARKER_TABLE):
        for rank, of in enumerate(("latin", "greek") if source == "Greek" else ("latin",)):
            at = 0
            while at < len(low):
                end = 0
                if not at or low[at - 1].isspace() or low[at - 1] in ",;:({":
                    for s in spellings:
                        if low.startswith(s, at):
                            start = at + len(s)
                            while start < len(low) and low[start].isspace():
                                start += 1
                            end = term_end(text, start, of)
                            if end > start:
                                term = tidy_term(text[start:end])
                                if is_term(term, of):
                                    found.append((max(0, at - 1), order, rank, candidate(source, **{of: term})))
                                break
                            end = 0
                at = max(end, at + 1)
    found.sort(key=lambda f: f[:3])
    return [f[3] for f in found]


def template_candidates(text: str) -> list[dict]:
    """Of every lang or translation template the first argument that is a donor term."""
    out = []
    for call in template_calls(text):
        name = template_name(call)
        source = CODES.get(call[1].strip().lower()) if len(call) > 2 else None
        if source and (name in ("lang", "lang2") or name in TRANSLATION_TEMPLATES):
            found = (term_candidate(source, a) for a in call[2:] if "=" not in a)
            out += [c for c in found if c][:1]
    return out


def chunks(section: str):
    """Parts of an etymology: ("text", part), and ("ref", name) for each template that stands
    for another page's etymology."""
    start, at = 0, section.find("{{")
    while at >= 0:
        end = section.find("}}", at)
        inside = section[at + 2 : end] if end >= 0 else ""
        name = inside.split("|")[0]
        if "{" not in inside and "\n" not in name and name.lstrip().lower().startswith(REFERENCE) and name.strip()[len(REFERENCE) :]:
            yield "text", section[start:at]
            yield "ref", name.strip()[len(REFERENCE) :].strip()
            start = at = end + 2
        else:
            at += 2
        at = section.find("{{", at)
    yield "text", section[start:]


def etymology_candidates(section: str) -> list[dict]:
    """Candidates in order: of a text its marked terms, then its templates'; a reference is a
    candidate with `ref` alone, to be replaced by what its template holds."""
    out: list[dict] = []
    for kind, part in chunks(section):
        if kind == "ref":
            out.append(candidate("", ref=part))
        else:
            out += marked_candidates(strip_markup(part)) + template_candidates(part)
    return out


def resolved_candidates(text: str) -> list[dict]:
    """Candidates that an etymology template holds: its templates', then its marked terms."""
    return template_candidates(text) + marked_candidates(strip_markup(text))


def translation_candidates(section: str) -> list[dict]:
    out: list[dict] = []
    for body in sections(section, {"перевод", "список переводов"}):
        out += marked_candidates(strip_markup(body)) + template_candidates(body)
    return [c | {"kind": "translation", "source": canonical(c["source"])} for c in out]


def without_source_words(text: str) -> str:
    """The text without one of the words that lead in a donor term."""
    bare = text.strip()
    return next((bare[len(w) :].strip() for w in LEADING_WORDS if bare.lower().startswith(w)), bare)


def first_term(raw: str, of: str, phrases: bool) -> str | None:
    """The first valid term of a script in marked-up text."""
    for found in terms(without_source_words(strip_markup(raw)), of):
        term = tidy_term(found)
        if is_term(term, of) and (phrases or " " not in term):
            return term
    return None


def russian_term(text: str) -> str:
    """A Russian word or phrase in small letters, without markup, stress and punctuation."""
    return strip_markup(text).replace("́", "").strip(EDGES).lower()


def russian_stem(text: str) -> str:
    """Letters of a stem; nothing if it holds anything but the 33 letters, blanks and hyphens."""
    bare = russian_term(text).replace(" ", "").replace("-", "")
    return bare if all("а" <= c <= "я" or c == "ё" for c in bare) else ""
