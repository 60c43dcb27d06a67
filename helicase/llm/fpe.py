"""Keyed bijections on strings of one shape: letters stay letters of their script, digits digits, all else stays.

The strings of a shape are numbered in mixed radix; the numbers are permuted by a keyed Feistel network with
cycle-walking. ``moved`` is that permutation conjugated with a half turn: a bijection without fixed points. So
different strings never get one surrogate, and none keeps its own.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Mapping, Sequence
from functools import lru_cache

LATIN_VOWELS, LATIN_CONSONANTS = "aeiou", "bcdfghjklmnpqrstvwxyz"
CYRILLIC_VOWELS, CYRILLIC_CONSONANTS = "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ"
ACCENTED = "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿ"
GREEK = "αβγδεζηθικλμνξοπρστυφχψω"
#: Scripts without case, by range of code points.
RANGES = ((0x05D0, 0x05EA), (0x0621, 0x063A), (0x0641, 0x064A), (0x0905, 0x0939), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3))
ROUNDS = 8


def _span(lo: int, hi: int) -> str:
    return "".join(map(chr, range(lo, hi + 1)))


@lru_cache(maxsize=4096)
def alphabet(ch: str, spoken: bool = False) -> str:
    """The characters that may stand for ch; empty if only itself. spoken: vowels for vowels, consonants for consonants."""
    low = ch.lower()
    if len(low) != 1:
        return ""
    groups = [LATIN_VOWELS, LATIN_CONSONANTS, CYRILLIC_VOWELS, CYRILLIC_CONSONANTS] if spoken else [_span(97, 122), _span(0x0430, 0x044F)]
    for group in (*groups, "0123456789", ACCENTED, GREEK):
        if low in group:
            return group
    return next((_span(a, b) for a, b in RANGES if a <= ord(low) <= b), "")


def _round(key: bytes, tweak: bytes, i: int, x: int, m: int) -> int:
    n = (m.bit_length() + 71) // 8
    out = b""
    while len(out) < n:
        out += hashlib.blake2b(x.to_bytes((x.bit_length() + 7) // 8 or 1, "big") + b"|" + tweak, key=key[:64], salt=bytes([i, len(out) // 64 % 256])).digest()
    return int.from_bytes(out[:n], "big") % m


def permuted(x: int, n: int, key: bytes, tweak: bytes, back: bool = False) -> int:
    """A keyed permutation of range(n)."""
    m = math.isqrt(n - 1) + 1
    while True:
        left, right = divmod(x, m)
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                left, right = (right - _round(key, tweak, i, left, m)) % m, left
            else:
                left, right = right, (left + _round(key, tweak, i, right, m)) % m
        x = left * m + right
        if x < n:
            return x


def moved(x: int, n: int, key: bytes, tweak: bytes) -> int:
    """A keyed permutation of range(n) without fixed points, for n of 2 or more.

    Twice gives x again for even n, so it must not be walked until a result is in some subset: rank the subset instead.
    """
    return permuted((permuted(x, n, key, tweak) + n // 2) % n, n, key, tweak, back=True)


def replaced(text: str, key: bytes, tweak: str, spoken: bool = False, fixed: Sequence[int] = (), allowed: Mapping[int, str] | None = None) -> str:
    """text with its letters and digits replaced, those at the fixed positions kept; the case of each letter stays.
    allowed: characters that may stand at a position, the text's own among them."""
    held, allowed = set(fixed), allowed or {}
    places = [(i, a) for i, ch in enumerate(text) if i not in held and (a := allowed.get(i) or alphabet(ch, spoken))]
    n, x = 1, 0
    for i, a in places:
        x = x * len(a) + a.index(text[i].lower())
        n *= len(a)
    if n < 2:
        return text
    shape = "".join("?" if i not in held and alphabet(ch, spoken) else ch for i, ch in enumerate(text.lower()))
    kinds = ",".join(a[0] for _, a in places)
    x = moved(x, n, key, f"{tweak}|{shape}|{kinds}".encode())
    out = list(text)
    for i, a in reversed(places):
        x, digit = divmod(x, len(a))
        out[i] = a[digit].upper() if text[i] != text[i].lower() else a[digit]
    return "".join(out)
