"""File names that tell how a lexicon was crawled."""

from __future__ import annotations

from skriba.functions.languages import USUAL, whitelist
from skriba.operators.wiki import Options

# Fixed value: the appendix that is read unless another is named.
APPENDIX = "Приложение:Заимствованные слова в русском языке"
TOKEN_LETTERS = 80


def file_token(text: str) -> str:
    """Letters, digits, points and underscores; runs of anything else are one hyphen."""
    out: list[str] = []
    for c in " ".join(text.split()):
        if c.isalnum() or c in "_.":
            out.append(c)
        elif out[-1:] != ["-"]:
            out.append("-")
    return "".join(out[:TOKEN_LETTERS]).strip("-_.") or "default"


def language_token(names: list[str]) -> str:
    """Nothing for the usual languages, `all` for none, else the names in order."""
    if sorted(names) == sorted(whitelist(USUAL)):
        return ""
    return "-".join(sorted(names)) or "all"


def lexicon_name(options: Options, source: str = "pages", appendix: str = APPENDIX, enriched: bool = False) -> str:
    """The name of a crawl's file: only what differs from the usual run is in it."""
    source = source.strip().lower() or "pages"
    parts = ["loan_stems", "wiktionary", file_token(source)]
    if source == "appendix":
        parts += [f"source-{file_token(appendix)}"] if appendix.strip() not in ("", APPENDIX) else []
    else:
        if options.title:
            parts.append(f"title-{file_token(options.title)}")
        elif options.from_title:
            parts.append(f"from-{file_token(options.from_title)}")
        parts += [f"page-limit-{options.page_limit}"] if options.page_limit else []
        parts += [] if options.resolve_templates else ["no-template-resolve"]
    parts += [f"limit-{options.limit}"] if options.limit and not options.title else []
    for label, names in (("langs", options.languages), ("translation-langs", options.translation_languages)):
        parts += [f"{label}-{file_token(token)}"] if (token := language_token(names)) else []
    flags = (("enriched", enriched), ("phrases", options.phrases), ("keep-diacritics", options.keep_marks), ("keep-final-vowels", options.keep_final_vowels))
    return ".".join(parts + [name for name, on in flags if on]) + ".csv"
