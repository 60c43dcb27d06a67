"""Codecs whose steps depend on all steps before: plain Python and numpy kernels, called in Arrow batches."""

from __future__ import annotations

import heapq
import zlib
from functools import lru_cache

import numpy as np

BITS = "ATCG"
# For (last but one, last) base, the bases of the digits 0 to 3.
QUATTRO = {
    "": "ACTG",
    "A": "ACGT", "C": "TACG", "G": "GTAC", "T": "TACG",
    "AA": "TGAC", "GA": "GACT", "TA": "CTGA", "CA": "ACTG",
    "CC": "ATCG", "GC": "TCGA", "TC": "GATC", "AC": "CGAT",
    "GG": "TAGC", "CG": "AGCT", "TG": "CTAG", "AG": "GCTA",
    "TT": "CTGA", "CT": "ACTG", "GT": "GACT", "AT": "TGAC",
}
# For the previous base, the bases of the digits 0 to 2.
ROTATION_3 = {"": "CGT", "A": "CGT", "C": "GTA", "G": "TAC", "T": "ACG"}
# The frequencies of a to z (and A to Z); every other byte has 500.
LETTERS = [8167, 1492, 2202, 4253, 12702, 2228, 2015, 6094, 6966, 153, 1292, 4025, 2406, 6749, 7507, 1929, 95, 5987, 7000, 9356, 2758, 978, 2560, 150, 1994, 77]


def digits_of(data: bytes) -> str:
    """Bytes as base-4 digits, four a byte."""
    return "".join(f"{b >> 6}{b >> 4 & 3}{b >> 2 & 3}{b & 3}" for b in data)


def quattro_encode(digits: str) -> str:
    """Base-4 digits by the two-base rotation."""
    out, state = [], ""
    for d in digits:
        base = QUATTRO[state][int(d)]
        out.append(base)
        state = (state + base)[-2:]
    return "".join(out)


def quattro_decode(seq: str) -> str:
    return "".join(str(QUATTRO[seq[max(0, i - 2) : i]].index(b)) for i, b in enumerate(seq))


def rotate3_encode(digits: str) -> str:
    out, last = [], ""
    for d in digits:
        last = ROTATION_3[last][int(d)]
        out.append(last)
    return "".join(out)


def rotate3_decode(seq: str) -> str:
    return "".join(str(ROTATION_3[seq[i - 1] if i else ""].index(b)) for i, b in enumerate(seq))


@lru_cache(maxsize=8)
def huffman(base: int, freq: tuple[int, ...] | None = None) -> tuple[str, ...]:
    """Code word of each byte: a base-ary Huffman code of the frequencies of all 256, or of the fixed ones. Of equal
    frequencies the node with the smallest byte comes first, so the code is the same everywhere."""
    freq = freq or tuple(LETTERS[(b | 32) - 97] if chr(b).isascii() and chr(b).isalpha() else 500 for b in range(256))
    heap = [(f, b, b) for b, f in enumerate(freq)]
    heapq.heapify(heap)
    take = 2 + (256 - 2) % (base - 1) if base < 256 else 256
    while len(heap) > 1:
        nodes = [heapq.heappop(heap) for _ in range(min(take, len(heap)))]
        heapq.heappush(heap, (sum(n[0] for n in nodes), min(n[1] for n in nodes), [n[2] for n in nodes]))
        take = base
    codes = [""] * 256
    todo = [(heap[0][2], "")]
    while todo:
        node, code = todo.pop()
        if isinstance(node, int):
            codes[node] = code
        else:
            todo += [(child, code + str(i)) for i, child in enumerate(node)]
    return tuple(codes)


def frequencies(lines: list[str]) -> tuple[int, ...]:
    """Frequencies of all bytes from lines ``byte=count``; bytes that aren't named have 0. Bad lines are an error."""
    out = [0] * 256
    for line in lines:
        if line.strip():
            byte, sep, n = line.partition("=")
            if not sep or not 0 <= (b := int(byte) & 0xFF) < 256 or int(n) < 0 or not -128 <= int(byte) < 256:
                raise ValueError(f"no byte and count: {line!r}")
            out[b] = int(n)
    return tuple(out)


@lru_cache(maxsize=8)
def _words(base: int, freq: tuple[int, ...] | None = None) -> dict[str, int]:
    return {c: b for b, c in enumerate(huffman(base, freq))}


def huffman_encode(data: bytes, base: int, freq: tuple[int, ...] | None = None) -> str:
    codes = huffman(base, freq)
    return "".join([codes[b] for b in data])


def huffman_decode(digits: str, base: int, freq: tuple[int, ...] | None = None) -> bytes:
    words, out, start = _words(base, freq), bytearray(), 0
    for end in range(1, len(digits) + 1):
        b = words.get(digits[start:end])
        if b is not None:
            out.append(b)
            start = end
    if start != len(digits):
        raise ValueError("digits end inside a code word")
    return bytes(out)


def bin_encode(data: bytes) -> str:
    """Binary Huffman bits at two a base; the first base tells whether a bit is left over and which."""
    bits = huffman_encode(data, 2)
    even = len(bits) & ~1
    head = "A" if len(bits) == even else "G" if bits[-1] == "0" else "C"
    return head + "".join(BITS[int(bits[i : i + 2], 2)] for i in range(0, even, 2))


def bin_decode(seq: str) -> bytes:
    bits = "".join(f"{BITS.index(b):02b}" for b in seq[1:])
    return huffman_decode(bits + {"A": "", "G": "0", "C": "1"}[seq[0]], 2)


def text_encode(text: str, codec: str) -> str:
    data = text.encode()
    if codec == "rotating3":
        return rotate3_encode(huffman_encode(data, 3))
    if codec == "rotating4":
        return quattro_encode(huffman_encode(data, 4))
    if codec == "naive4":
        return huffman_encode(data, 4).translate(str.maketrans("0123", BITS))
    if codec == "bin":
        return bin_encode(data)
    if codec == "fountain":
        return fountain_encode(data)
    raise ValueError(f"no codec {codec!r}")


def text_decode(seq: str, codec: str) -> str:
    if codec == "rotating3":
        data = huffman_decode(rotate3_decode(seq), 3)
    elif codec == "rotating4":
        data = huffman_decode(quattro_decode(seq), 4)
    elif codec == "naive4":
        data = huffman_decode(seq.translate(str.maketrans(BITS, "0123")), 4)
    elif codec == "bin":
        data = bin_decode(seq)
    elif codec == "fountain":
        data = fountain_decode(seq)
    else:
        raise ValueError(f"no codec {codec!r}")
    return data.decode()


CODECS = ("rotating3", "rotating4", "naive4", "bin", "fountain")

# Packed numbers: a type's signature and its bases.
PACKED = {"HALF_BYTE": ("A", 2), "BYTE": ("C", 4), "SHORT": ("T", 8), "INT_32": ("GA", 16), "INT_64": ("GT", 32)}


def packed_type(n: int) -> str:
    """The narrowest type for an unsigned number; negative ones need all bits."""
    return next(t for t, (_, size) in PACKED.items() if 0 <= n < 4**size or size == 32)


def pack(n: int, kind: str) -> str:
    sign, size = PACKED[kind]
    n &= 4**size - 1
    return sign + quattro_encode("".join(str(n >> 2 * i & 3) for i in reversed(range(size))))


def unpack(seq: str, at: int = 0, signed: bool = False) -> tuple[int, int]:
    """(number, where the next begins)."""
    kind = next(t for t, (sign, _) in PACKED.items() if seq.startswith(sign, at))
    sign, size = PACKED[kind]
    at += len(sign)
    n = int(quattro_decode(seq[at : at + size]), 4)
    if signed and n >= 4**size // 2:
        n -= 4**size
    return n, at + size


def unpack_all(seq: str, signed: bool = False) -> list[int]:
    """Numbers until what follows is none."""
    out, at = [], 0
    while at < len(seq):
        try:
            n, at = unpack(seq, at, signed)
        except (StopIteration, ValueError):
            break
        out.append(n)
    return out


class Ranlux:
    """Subtract-with-borrow generator in single precision (Luescher; James 1994)."""

    SKIP = (0, 24, 73, 199, 365)

    def __init__(self, luxury: int, seed: int) -> None:
        self.skip, s = self.SKIP[luxury], seed if seed > 0 else 314159265
        self.ulp = np.float32(2.0**-24)
        self.x = [np.float32(0)] * 24
        for i in range(24):
            k = s // 53668
            s = 40014 * (s - k * 53668) - k * 12211
            s += 2147483563 if s < 0 else 0
            self.x[i] = np.float32(s % (1 << 24)) * self.ulp
        self.i, self.j, self.used = 23, 9, 0
        self.carry = self.ulp if self.x[23] == 0 else np.float32(0)

    def _step(self) -> np.float32:
        u = self.x[self.j] - self.x[self.i] - self.carry
        if u < 0:
            u, self.carry = u + np.float32(1), self.ulp
        else:
            self.carry = np.float32(0)
        self.x[self.i] = u
        self.i, self.j = (self.i - 1) % 24, (self.j - 1) % 24
        return u

    def raw(self) -> float:
        out = self._step()
        if out < self.ulp * np.float32(4096):
            out = out + self.ulp * self.x[self.j]
        if out == 0:
            out = self.ulp * self.ulp
        self.used += 1
        if self.used == 24:
            self.used = 0
            for _ in range(self.skip):
                self._step()
        return float(out)

    def choose(self, low: int, high: int) -> int:
        return int(low + (high - low + 1) * self.raw())


@lru_cache(maxsize=4096)
def swaps(seed: int, length: int, luxury: int = 4) -> tuple[tuple[int, int], ...]:
    """Fisher-Yates swaps of a uniform permutation."""
    rand = Ranlux(luxury, seed)
    return tuple((i, rand.choose(0, i)) for i in range(length - 1, 0, -1))


def strand_seed(seq: str) -> int:
    v = 1
    for b in set(seq):
        v = v * seq.count(b) & 0xFFFFFFFF
    return v - (1 << 32) if v >> 31 else v


def permute(seq: str, seed: int, back: bool = False) -> str:
    s = list(seq)
    for i, j in reversed(swaps(seed, len(s))) if back else swaps(seed, len(s)):
        s[i], s[j] = s[j], s[i]
    return "".join(s)


def sig_hash(values: list[int]) -> int:
    """64-bit multiplicative hash with arithmetic shifts, wrapped."""
    wrap = lambda v: (v + (1 << 63)) % (1 << 64) - (1 << 63)
    h = 2166136261
    for v in values:
        h = wrap((h ^ v) * 16777619)
    h = wrap(h + wrap(h << 13))
    h ^= h >> 7
    h = wrap(h + wrap(h << 3))
    h ^= h >> 17
    return wrap(h + wrap(h << 5))


# Reed-Solomon over GF(256), generator polynomial 0x11D.
_EXP = [1] * 512
for _i in range(1, 512):
    _v = _EXP[_i - 1] << 1
    _EXP[_i] = _v ^ 0x11D if _v & 0x100 else _v
_LOG = {_EXP[i]: i for i in range(255)}


def _mul(a: int, b: int) -> int:
    return 0 if a == 0 or b == 0 else _EXP[_LOG[a] + _LOG[b]]


def _poly(p: list[int], x: int) -> int:
    y = 0
    for v in p:
        y = _mul(y, x) ^ v
    return y


def rs_encode(data: bytes, parity: int) -> bytes:
    gen = [1]
    for i in range(parity):
        gen = [a ^ b for a, b in zip([*gen, 0], [0, *[_mul(g, _EXP[i]) for g in gen]], strict=True)]
    rest = [*data, *[0] * parity]
    for i in range(len(data)):
        if head := rest[i]:
            for j, g in enumerate(gen):
                rest[i + j] ^= _mul(g, head)
    return data + bytes(rest[len(data) :])


def rs_decode(code: bytes, parity: int) -> bytes:
    """Corrects up to parity // 2 wrong bytes: Berlekamp-Massey, root search, Forney."""
    c = list(code)
    syn = [_poly(c, _EXP[i]) for i in range(parity)]
    if not any(syn):
        return code[: len(code) - parity]
    loc, old = [1], [1]
    for i in range(parity):
        old.append(0)
        delta = syn[i]
        for j in range(1, len(loc)):
            delta ^= _mul(loc[-1 - j], syn[i - j])
        if delta:
            if len(old) > len(loc):
                new = [_mul(x, delta) for x in old]
                old = [_mul(x, _EXP[255 - _LOG[delta]]) for x in loc]
                loc = new
            scaled = [_mul(x, delta) for x in old]
            pad = [0] * (len(loc) - len(scaled)) + scaled
            loc = [a ^ b for a, b in zip([0] * (len(pad) - len(loc)) + loc, pad, strict=True)]
    while loc and loc[0] == 0:
        loc.pop(0)
    errors = len(loc) - 1
    where = [len(c) - 1 - i for i in range(len(c)) if _poly(loc, _EXP[(255 - i) % 255]) == 0]
    if errors * 2 > parity or len(where) != errors:
        raise ValueError("too many errors")
    # values by solving the syndrome equations
    xs = [_EXP[(len(c) - 1 - p) % 255] for p in where]
    rows = [[_EXP[_LOG[x] * i % 255] for x in xs] + [syn[i]] for i in range(errors)]
    for k in range(errors):
        p = next(r for r in range(k, errors) if rows[r][k])
        rows[k], rows[p] = rows[p], rows[k]
        inv = _EXP[255 - _LOG[rows[k][k]]]
        rows[k] = [_mul(v, inv) for v in rows[k]]
        for r in range(errors):
            if r != k and rows[r][k]:
                rows[r] = [a ^ _mul(rows[r][k], b) for a, b in zip(rows[r], rows[k], strict=True)]
    for p, row in zip(where, rows, strict=True):
        c[p] ^= row[-1]
    if any(_poly(c, _EXP[i]) for i in range(parity)):
        raise ValueError("too many errors")
    return bytes(c[: len(c) - parity])


def strand_bytes(seq: str) -> bytes:
    """Bases to bytes, four each; the rest is padded with A. The first byte counts the padding."""
    fill = -len(seq) % 4
    digits = (seq + "A" * fill).translate(str.maketrans(BITS, "0123"))
    return bytes([fill]) + bytes(int(digits[i : i + 4], 4) for i in range(0, len(digits), 4))


def bytes_strand(data: bytes) -> str:
    digits = "".join(f"{b >> 6}{b >> 4 & 3}{b >> 2 & 3}{b & 3}" for b in data[1:]).translate(str.maketrans("0123", BITS))
    return digits[: len(digits) - data[0]]


def ecc_encode(seq: str, parity: int = 2) -> str:
    """seq with Reed-Solomon parity, in blocks of 255 bytes."""
    data, size = strand_bytes(seq), 255 - parity
    code = b"".join(rs_encode(data[i : i + size], parity) for i in range(0, len(data), size))
    return digits_of(code).translate(str.maketrans("0123", BITS))


def ecc_decode(seq: str, parity: int = 2) -> str:
    digits = seq.translate(str.maketrans(BITS, "0123"))
    code = bytes(int(digits[i : i + 4], 4) for i in range(0, len(digits), 4))
    return bytes_strand(b"".join(rs_decode(code[i : i + 255], parity) for i in range(0, len(code), 255)))


def longest_run(seq: str) -> int:
    best = run = 1
    for a, b in zip(seq, seq[1:], strict=False):
        run = run + 1 if a == b else 1
        best = max(best, run)
    return best


def _mask(packet: int, n: int) -> int:
    """The source symbols that a packet sums; the first n packets are the symbols themselves."""
    if packet < n:
        return 1 << packet
    bits, i = 0, 0
    while not bits:
        for k in range(0, n, 32):
            bits |= zlib.crc32(f"{packet}:{k}:{i}".encode()) << k
        bits &= (1 << n) - 1
        i += 1
    return bits


def fountain_encode(data: bytes, max_run: int = 6, spare: int = 0) -> str:
    """Rateless code: linear packets over the symbols of an eighth of the data, 64 bytes at most, screened by the longest
    run of their strands. Most strands of that size pass, so packets are drawn until enough do.

    Layout: packed length and symbol size, then packets of a packed number and the symbol's bytes, rotated."""
    size = max(1, min(64, len(data) // 8))
    n = max(1, -(-len(data) // size))
    symbols = [int.from_bytes(data[i * size : (i + 1) * size].ljust(size, b"\0"), "big") for i in range(n)]
    out = [pack(len(data), packed_type(len(data))), pack(size, packed_type(size))]
    basis: dict[int, int] = {}
    left, packet = n + spare, 0
    while left or len(basis) < n:
        mask = _mask(packet, n)
        value = 0
        for i in range(n):
            if mask >> i & 1:
                value ^= symbols[i]
        strand = pack(packet, packed_type(packet)) + quattro_encode(digits_of(value.to_bytes(size, "big")))
        packet += 1
        if longest_run(strand) > max_run:
            continue
        out.append(strand)
        left = max(0, left - 1)
        while mask:
            top = mask.bit_length()
            if top not in basis:
                basis[top] = mask
                break
            mask ^= basis[top]
    return "".join(out)


def fountain_decode(seq: str) -> bytes:
    length, at = unpack(seq)
    size, at = unpack(seq, at)
    n = max(1, -(-length // size))
    rows: dict[int, tuple[int, int]] = {}
    while at < len(seq) and len(rows) < n:
        packet, at = unpack(seq, at)
        digits = quattro_decode(seq[at : at + 4 * size])
        at += 4 * size
        mask, value = _mask(packet, n), int(digits, 4)
        while mask:
            top = mask.bit_length()
            if top not in rows:
                rows[top] = (mask, value)
                break
            mask, value = mask ^ rows[top][0], value ^ rows[top][1]
    if len(rows) < n:
        raise ValueError("too few packets")
    symbols: dict[int, int] = {}
    for top in sorted(rows):
        mask, value = rows[top]
        for i in range(top - 1):
            if mask >> i & 1:
                value ^= symbols[i]
        symbols[top - 1] = value
    return b"".join(symbols[i].to_bytes(size, "big") for i in range(n))[:length]


DELIMITER, ESCAPE = "CCTTCA", "GACATC"


def filler(n: int, gc_needed: float, seed: int) -> str:
    """n bases with about the GC share, from a seeded generator."""
    rand = np.random.default_rng(seed)
    gc = rand.random(n) < min(1.0, max(0.0, gc_needed))
    pick = rand.random(n) < 0.5
    return "".join(np.where(gc, np.where(pick, "G", "C"), np.where(pick, "A", "T")).tolist())


def pad(seq: str, target: int, delimiter: str = DELIMITER, escape: str = ESCAPE) -> str:
    """seq filled up to target bases; the first base tells how: A not at all, C by the delimiter, G or T by more."""
    if len(seq) >= target - 1:
        return "A" + seq
    seq += delimiter
    rest = target - 1 - len(seq)
    if rest <= 0:
        return "C" + seq
    gc = sum(map(seq.count, "GC"))
    fill = filler(rest, (0.5 * (len(seq) + rest) - gc) / rest, strand_seed(seq) + rest & 0xFFFFFFFF)
    while delimiter in fill:
        fill = fill.replace(delimiter, escape, 1)
    seq += fill
    while seq.rfind(delimiter) > len(seq) - rest - len(delimiter):  # the filler's start completes a delimiter
        at = seq.rfind(delimiter)
        seq = seq[:at] + delimiter[:-1] + ("A" if delimiter[-1] != "A" else "T") + seq[at + len(delimiter) :]
    share = sum(map(seq.count, "GC")) / len(seq)
    return ("T" if share > 0.55 else "G") + seq


def unpad(seq: str, delimiter: str = DELIMITER) -> str:
    head, body = seq[:1], seq[1:]
    if head == "A":
        return body
    return body[: -len(delimiter)] if head == "C" else body[: body.rindex(delimiter)]


SEGMENT_DELIMITER, SEGMENT_ESCAPE = "AC", "AG"


def segments(seq: str, target: int, gc_fix: int) -> list[str]:
    """seq in parts that fit target bases with header and delimiter, each padded."""
    size = target - 1 - len(SEGMENT_DELIMITER) - gc_fix
    return [pad(seq[i : i + size], target, SEGMENT_DELIMITER, SEGMENT_ESCAPE) for i in range(0, max(1, len(seq)), size)]


def strand_error(seq: str) -> float:
    """GC and run errors of a strand, normalised: the score by which a permutation is chosen."""
    n, g = len(seq), sum(map(seq.count, "GC"))
    off = abs(2 * g - n)
    gc = 0.4 if 5 * g == 3 * n else 0.0 if 10 * off <= 2 * n else 0.4 if 20 * off <= 6 * n else 0.8 if 10 * off <= 4 * n else 1.0
    long_, run = [], 1
    for a, b in zip(seq, seq[1:] + "-", strict=False):
        if a == b:
            run += 1
        else:
            if run > 6:
                long_.append(1 - 1 / (1 + np.exp(run - 6)))
            run = 1
    e = float(np.exp(-0.5))
    return float((1 + e) / (1 + np.exp(-3 * (gc + (float(np.mean(long_)) if long_ else 0.0)) + 0.5)) - e)


def best_permutation(seq: str, count: int) -> str:
    """The packed number and strand of the permutation with the least error; the first of equals."""
    if count == 0 or len(seq) < 2:
        return pack(0, "HALF_BYTE") + seq
    kind, seed = packed_type(count), strand_seed(seq)
    tried = (pack(i, kind) + permute(seq, seed + i) for i in range(count))
    return min(tried, key=strand_error)


def undo_permutation(seq: str) -> str:
    i, at = unpack(seq)
    body = seq[at:]
    return permute(body, strand_seed(body) + i, back=True) if len(body) > 1 else body


def barcode(number: int, size: int, permutations: int = 8, parity: int = 0) -> str:
    """An address of size bases: the number's digits encoded, padded, permuted, guarded and cut."""
    room = size - sum(map(len, [pack(0, packed_type(permutations))])) - (12 if parity else 0) - 4 * parity
    seq = best_permutation(pad(text_encode(str(number), "rotating4"), room), permutations)
    return (ecc_encode(seq, parity) if parity else seq)[:size]
