"""Personal data by anchor expansion.

One Aho-Corasick pass finds anchors: at-signs, plus signs, digits, scheme and
cues of identifiers and secrets. From each anchor a small deterministic parser walks left and right
over the characters its kind allows, and validates what it spans (octets, Luhn,
mod 97, lengths). No pattern is tried anywhere else in the text.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skriba.llm.shared import lean

# The base kinds in their order, then the kinds this method adds.
BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "account", "address", "link", "secret")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
LABEL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-")
DIGITS = frozenset("0123456789")
PHONE = frozenset(" ().0123456789-")
#: Cues that name an identifier; the number behind them is the span.
ACCOUNT_CUES = ("account", "acct", "passport", "ssn", "konto", "compte", "cuenta")
#: Street words; a house number before (English) or behind (the others) makes an address.
STREET_CUES = ("street", "avenue", "boulevard", "straße", "strasse", "rue ", "calle ")
SCHEMES = ("https://", "http://", "ftp://")
#: Names that a secret is assigned to, beginnings of secrets that need no name, and their letters.
SECRET_NAMES = ("token", "password", "passwd", "secret", "api_key", "api-key", "apikey", "bearer")
SECRET_HEADS = ("akia", "ghp_", "xoxb-", "sk_live_")
SECRET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-+/=.~")
SECRET_LEAST, SECRET_MOST = 16, 512


def luhn(digits: str) -> bool:
    """Check digit of payment cards."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def email_at(text: str, at: int, floor: int):
    """The address around an at-sign, its local part starting at `floor` or later."""
    start = at
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    if start == at:
        return None
    end, labels, p, n = at + 1, 0, at + 1, len(text)
    while True:
        q = p
        while q < n and text[q] in LABEL:
            q += 1
        if q == p:
            break
        labels, end = labels + 1, q
        if q < n and text[q] == ".":
            p = q + 1
        else:
            break
    return (start, end) if labels >= 2 else None


def number_run(text: str, p: int) -> int:
    """End of the digits from p on."""
    n = len(text)
    while p < n and text[p] in DIGITS:
        p += 1
    return p


def ip_at(text: str, p: int):
    """Four numbers joined by dots from p on: their end, else None; and where the
    numbers end that are not such a group's start any more."""
    end = number_run(text, p)
    q, parts = end, 1
    while parts < 4 and q < len(text) and text[q] == "." and q + 1 < len(text) and text[q + 1] in DIGITS:
        q = number_run(text, q + 1)
        parts += 1
    return (q if parts == 4 else None), end


def card_at(text: str, p: int) -> int:
    """End of digits from p on that single spaces or hyphens may part."""
    n = len(text)
    while True:
        p = number_run(text, p)
        if p + 1 < n and text[p] in " -" and text[p + 1] in DIGITS:
            p += 1
        else:
            return p


def phone_at(text: str, p: int):
    """End of the number behind a plus sign: the last digit of the run that phones are
    written with, at least one character between it and the first."""
    n = len(text)
    if p + 1 >= n or text[p + 1] not in DIGITS:
        return None
    q = p + 2
    while q < n and text[q] in PHONE:
        q += 1
    q -= 1
    while q > p + 2 and text[q] not in DIGITS:
        q -= 1
    return q + 1 if q > p + 2 else None


def iban_at(text: str, p: int):
    """An account number in international form that starts at p, checked modulo 97."""
    q, kept = p, []
    while q < len(text) and len(kept) < 34 and (text[q].isascii() and text[q].isalnum() and not text[q].islower() or text[q] == " " and kept and len(kept) % 4 == 0 and text[q - 1] != " "):
        if text[q] != " ":
            kept.append(text[q])
        q += 1
    while kept and not text[q - 1].isalnum():
        q -= 1
    while len(kept) >= 15:
        raw = "".join(kept[4:] + kept[:4])
        if int("".join(str(int(c, 36)) for c in raw)) % 97 == 1:
            return q
        kept.pop()
        q -= 1
        while q > p and text[q - 1] == " ":
            q -= 1
    return None


def secret_at(text: str, p: int, named: bool):
    """(start, end) of the secret at p; a named one stands behind a sign or a blank, and
    perhaps in quotation marks. It has both letters and digits, and no more than SECRET_MOST."""
    if named:
        q = p
        while p < len(text) and p < q + 6 and text[p] in " \t:=\"'":
            p += 1
        if p == q:
            return None
    end = p
    while end < len(text) and end <= p + SECRET_MOST and text[end] in SECRET:
        end += 1
    while end > p and text[end - 1] in ".=-":
        end -= 1
    run = text[p:end]
    if not SECRET_LEAST <= len(run) <= SECRET_MOST or run.isalpha() or not any(c in DIGITS for c in run) or not any(c.isalpha() for c in run):
        return None
    return p, end


_account_number = re.compile(r"[\s:#.]{0,3}(?:no\.?|number|nr\.?|n°)?[\s:#.]{0,3}([0-9][0-9 -]{4,20}[0-9])")
_house_before = re.compile(r"([0-9]{1,5}[A-Za-z]?(?: [A-Z][\w'-]*){1,3} )$")
_house_behind = re.compile(r"(?:[A-Z][\w'-]*(?: [A-Z][\w'-]*){0,3} ?)?,? ?[0-9]{1,5}[A-Za-z]?\b")


def automaton():
    """All anchors; cues are matched without regard to ASCII case by the caller."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, words in (("@", "@"), ("+", "+"), ("0", "0123456789"), ("account", ACCOUNT_CUES), ("street", STREET_CUES), ("link", SCHEMES), ("iban", ("iban",)), ("secret", SECRET_NAMES), ("head", SECRET_HEADS)):
        for w in words:
            found.add_word(w, (kind, len(w)))
    found.make_automaton()
    return found


def find_spans(text: str | None, anchors) -> list[tuple[str, int, int]]:
    """All spans of a text, by kind (base kinds first) and start; ends are exclusive.

    The base kinds are leftmost, do not overlap within their kind, and a span that
    fails its check is dropped without trying a shorter one."""
    if not text:
        return []
    spans = {k: [] for k in BASE_KINDS + ADDED_KINDS}
    done = dict.fromkeys(("email", "ip", "card", "phone", "digits", "link", "address", "secret"), 0)
    # Only A-Z are folded, so that positions stay those of the text.
    folded = text.lower() if text.isascii() else text.translate(_FOLD)
    for last, (kind, size) in anchors.iter(folded):
        start = last - size + 1
        if kind == "0":
            if start >= done["card"]:
                end = card_at(text, start)
                if end - start > 1:
                    digits = text[start:end].replace(" ", "").replace("-", "")
                    if 13 <= len(digits) <= 19 and luhn(digits):
                        spans["card"].append((start, end))
                    done["card"] = end
                else:
                    done["card"] = end
            if start >= done["ip"] and start >= done["digits"]:
                end, run = ip_at(text, start)
                done["digits"] = run
                if end is not None:
                    # A part may have any number of zeros ahead.
                    if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in text[start:end].split("."))):
                        spans["ip"].append((start, end))
                    done["ip"] = end
        elif kind == "@":
            if found := email_at(text, start, done["email"]):
                spans["email"].append(found)
                done["email"] = found[1]
        elif kind == "+":
            if start >= done["phone"] and (end := phone_at(text, start)):
                if 9 <= sum(c in DIGITS for c in text[start:end]) <= 15:
                    spans["phone"].append((start, end))
                done["phone"] = end
        elif kind == "account":
            if (start == 0 or not folded[start - 1].isalpha()) and (m := _account_number.match(folded, last + 1)):
                spans["account"].append(m.span(1))
        elif kind == "iban":
            p = last + 1
            while p < len(text) and p < last + 4 and text[p] in " :":
                p += 1
            if end := iban_at(text, p):
                spans["iban"].append((p, end))
        elif kind == "street":
            if size and folded[last] == " ":
                m = (start == 0 or not folded[start - 1].isalpha()) and _house_behind.match(text, last + 1)
                if m and start >= done["address"]:
                    spans["address"].append((start, m.end()))
                    done["address"] = m.end()
            elif m := _house_before.search(text, max(0, start - 80), start):
                if m.start() >= done["address"]:
                    spans["address"].append((m.start(), last + 1))
                    done["address"] = last + 1
        elif kind in ("secret", "head"):
            named = kind == "secret"
            if start >= done["secret"] and (start == 0 or not folded[start - 1].isalnum()) and (at := secret_at(text, last + 1 if named else start, named)):
                spans["secret"].append(at)
                done["secret"] = at[1]
        elif start >= done["link"]:
            # A link is personal only where it carries a name or password before its host.
            end = last + 1
            while end < len(text) and not text[end].isspace() and text[end] not in "/?#<>\"'":
                end += 1
            if "@" in text[last + 1 : end]:
                spans["link"].append((start, end))
            done["link"] = end
    return [(k, s, e) for k in BASE_KINDS + ADDED_KINDS for s, e in sorted(spans[k])]


_FOLD = {c: c + 32 for c in range(65, 91)}


def personal_data(docs: DataFrame) -> DataFrame:
    """Spans of every text, one row per row of `docs`: doc_id, n_email, n_ip, n_card,
    n_phone, base_sha256, spans, n_added.

    Null and empty texts have no spans. Rows are judged alone, so repeated rows give
    repeated results; extra columns are ignored, whatever their names; a null doc_id is returned as
    null; very long texts are read whole, in time linear in their length; an empty table gives an
    empty result. Positions count code points."""

    def scan(batches):
        import pyarrow as pa

        anchors = automaton()
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                spans = find_spans(text, anchors)
                base = [s for s in spans if s[0] in BASE_KINDS]
                told = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
                rest = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
                counts = [sum(s[0] == k for s in base) for k in BASE_KINDS]
                out.append((doc_id, *counts, hashlib.sha256(told.encode()).hexdigest(), rest, len(spans) - len(base)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    import pyarrow as pa

    types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()]
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(scan), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
