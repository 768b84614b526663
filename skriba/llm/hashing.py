"""Words of many texts hashed at once with numpy.

Every word gets a 64-bit polynomial hash over random byte codes, then mixed; equal
words get equal hashes, and two of a billion different words share one with a
chance of about 3 %, two of a corpus's tens of millions with one in ten thousand.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Bytes that are hashed at once; what is in between takes about 50 times as much.
PIECE = 1 << 19
#: Bytes 9 to 13 and 32 end a word.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
CODES = np.random.Generator(np.random.PCG64(7001)).integers(1, 1 << 63, 256, dtype=U) | U(1)
BASE, GRAM = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


class _Local(dict):
    """A cache that stays in its process: it is pickled empty."""

    def __reduce__(self):
        return _Local, ()


_powers = _Local()


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base squared ... modulo 2**64, at least n of them, kept per size class."""
    size = max(PIECE + 1, 1 << max(0, n - 1).bit_length())
    if n > PIECE + 1:
        return np.cumprod(np.concatenate(([U(1)], np.full(n - 1, base, U))), dtype=U)
    if (base, size) not in _powers:
        _powers[base, size] = np.cumprod(np.concatenate(([U(1)], np.full(size - 1, base, U))), dtype=U)
    return _powers[base, size]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of the public MurmurHash3."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def _hash_piece(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and byte starts of the words in one piece that begins and ends at a word's edge."""
    buf = np.frombuffer(raw, np.uint8)
    space = np.concatenate(([True], SPACE[buf], [True]))
    starts = np.flatnonzero(space[:-1] & ~space[1:])
    ends = np.flatnonzero(~space[:-1] & space[1:])
    if not len(starts):
        return np.zeros(0, U), starts
    total = np.zeros(len(buf) + 1, U)
    np.cumsum(CODES[buf] * powers(BASE, len(buf))[: len(buf)], out=total[1:])
    inverse = powers(pow(BASE, -1, 1 << 64), len(buf))
    return mix((total[ends] - total[starts]) * inverse[starts]), starts


def _pieces(raw: bytes):
    """Cuts of a long text at white space, about PIECE bytes each."""
    at = 0
    while len(raw) - at > PIECE:
        window = raw[at : at + PIECE]
        cut = max(window.rfind(c) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if cut <= 0:
            rest = SPACE[np.frombuffer(raw, np.uint8, offset=at + PIECE)]
            cut = PIECE + (int(rest.argmax()) if rest.any() else len(rest))
        yield raw[at : at + cut]
        at += cut
    yield raw[at:]


def word_hashes(texts, lower: bool):
    """Yields (first, last, hashes, offsets): for texts[first:last], the words' hashes,
    and offsets so that text k has hashes[offsets[k]:offsets[k + 1]]. None has no words;
    `lower` folds A-Z only."""
    group: list[bytes] = []
    size = first = 0

    def flush(last):
        raw = b"\n".join(group)
        hashes, starts = _hash_piece(raw.lower() if lower else raw)
        begins = np.cumsum([0] + [len(g) + 1 for g in group])
        return first, last, hashes, np.searchsorted(starts, begins)

    for k, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass") if text else b""
        if group and size + len(raw) > PIECE:
            yield flush(k)
            group, size, first = [], 0, k
        if len(raw) > PIECE:
            parts = [_hash_piece(p.lower() if lower else p)[0] for p in _pieces(raw)]
            hashes = np.concatenate(parts)
            yield k, k + 1, hashes, np.array([0, len(hashes)])
            first = k + 1
            continue
        group.append(raw)
        size += len(raw) + 1
    if group:
        yield flush(first + len(group))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on; shorter than the words by n - 1."""
    if len(hashes) < n:
        return np.zeros(0, U)
    total = np.zeros(len(hashes) + 1, U)
    np.cumsum(hashes * powers(GRAM, len(hashes))[: len(hashes)], out=total[1:])
    inverse = powers(pow(GRAM, -1, 1 << 64), len(hashes))
    return mix((total[n:] - total[:-n]) * inverse[: len(hashes) - n + 1] + U(n))
