"""Codecs between text or numbers and strands: Catalyst expressions where a step needs no long state, Arrow batches elsewhere."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from helicase.functions import kernel
from helicase.functions import seq as q


def _mapped(fn: Callable, kind: str) -> Callable:
    """fn over a column in Arrow batches; nulls stay."""

    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else fn(x)).astype(object)

    return run


def encode_text(text, codec: str) -> Column:
    return _mapped(lambda x: kernel.text_encode(x, codec), "string")(q._col(text))


def decode_text(seq, codec: str) -> Column:
    return _mapped(lambda x: kernel.text_decode(x, codec), "string")(q._col(seq))


def huffman_digits(text, base: int) -> Column:
    """Code words of the text's UTF-8 bytes, joined."""
    codes = F.array(*[F.lit(c) for c in kernel.huffman(base)])
    pairs = F.regexp_extract_all(F.hex(F.encode(q._col(text), "UTF-8")), F.lit(".."), F.lit(0))
    return F.array_join(F.transform(pairs, lambda x: F.element_at(codes, F.conv(x, 16, 10).cast("int") + 1)), "")


def naive4(text) -> Column:
    return F.translate(huffman_digits(text, 4), "0123", kernel.BITS)


def _fold(digits: Column, table: dict[str, str], state: int) -> Column:
    cases = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    step = lambda acc, d: F.concat(acc, F.substring(F.element_at(cases, F.right(acc, F.lit(state))), d.cast("int") + 1, F.lit(1)))
    return F.aggregate(F.filter(F.split(digits, ""), lambda d: d != ""), F.lit(""), step)


def rotate3(digits) -> Column:
    """Base-3 digits so that no base repeats. For short strands: the fold copies its result each step."""
    return _fold(q._col(digits), kernel.ROTATION_3, 1)


def rotate3_digits(seq) -> Column:
    """Inverse of rotate3; each digit needs its own and the previous base only."""
    e = q._col(seq)
    table = F.create_map(*[F.lit(x) for kv in kernel.ROTATION_3.items() for x in kv])
    before = F.split(F.concat(F.lit("A"), F.substring(e, F.lit(1), F.length(e) - 1)), "")
    digits = F.zip_with(before, F.split(e, ""), lambda p, c: F.instr(F.element_at(table, p), c) - 1)
    return F.when(F.length(e) == 0, F.lit("")).otherwise(F.array_join(digits, ""))


def quattro(digits) -> Column:
    """Base-4 digits by the two-base rotation. For short strands, such as packed numbers."""
    return _fold(q._col(digits), kernel.QUATTRO, 2)


def pack(n, kind: str) -> Column:
    """A number as a typed strand; negative ones as two's complement of the type."""
    sign, size = kernel.PACKED[kind]
    bits = F.right(F.lpad(F.bin(q._col(n).cast("long")), 64, "0"), F.lit(2 * size))
    digits = F.concat(*[F.conv(F.substring(bits, 2 * i + 1, 2), 2, 10) for i in range(size)])
    return F.concat(F.lit(sign), quattro(digits))


def packed_kind(n) -> Column:
    v = q._col(n)
    return F.when(v < 0, "INT_64").when(v < 16, "HALF_BYTE").when(v < 256, "BYTE").when(v < 65536, "SHORT").when(v < 1 << 32, "INT_32").otherwise("INT_64")


def pack_minimal(n) -> Column:
    return _mapped(lambda x: kernel.pack(int(x), kernel.packed_type(int(x))), "string")(q._col(n).cast("long").cast("string"))


def packed_size(seq) -> Column:
    """Bases of the packed number at the strand's start."""
    s = q._col(seq)
    return F.when(s.startswith("A"), 3).when(s.startswith("C"), 5).when(s.startswith("T"), 9).when(s.startswith("GA"), 18).when(s.startswith("GT"), 34)


def unpack_all(seq, signed: bool = False) -> Column:
    wrap = lambda n: n - (1 << 64) if n >= 1 << 63 else n
    return _mapped(lambda x: [wrap(n) for n in kernel.unpack_all(x, signed)], "array<long>")(q._col(seq))


def utf16_strand(text) -> Column:
    """UTF-16BE bytes at two bits a base."""
    out = F.lower(F.hex(F.encode(q._col(text), "UTF-16BE")))
    for nibble in range(16):
        out = F.replace(out, F.lit(f"{nibble:x}"), F.lit(q.TRANSPORT[nibble >> 2] + q.TRANSPORT[nibble & 3]))
    return out


def utf16_text(seq) -> Column:
    """Inverse of utf16_strand."""
    digits = F.translate(q._col(seq), q.TRANSPORT, "0123")
    bytes_ = F.transform(F.regexp_extract_all(digits, F.lit(".{4}"), F.lit(0)), lambda x: F.lpad(F.conv(x, 4, 16), 2, "0"))
    return F.decode(F.unhex(F.array_join(bytes_, "")), "UTF-16BE")


def signed_kind(n) -> Column:
    """The narrowest type that holds a number in two's complement."""
    v = q._col(n)
    out = F.lit("INT_64")
    for kind, bits in (("INT_32", 32), ("SHORT", 16), ("BYTE", 8), ("HALF_BYTE", 4)):
        out = F.when(v.between(-(1 << bits - 1), (1 << bits - 1) - 1), kind).otherwise(out)
    return out


def pack_signed(n) -> Column:
    """A number by its narrowest signed type."""
    v, out = q._col(n), pack(n, "INT_64")
    for kind in ("INT_32", "SHORT", "BYTE", "HALF_BYTE"):
        out = F.when(signed_kind(v) == kind, pack(v, kind)).otherwise(out)
    return out


def zero_permutation(seq) -> Column:
    """A payload without permutations: three bases that draw its GC content to a half, and the strand."""
    s = q._col(seq)
    return F.concat(F.when(2 * q.gc_count(s) > F.length(s), "TAT").otherwise("GCG"), s)


def undo_zero_permutation(payload) -> Column:
    p = q._col(payload)
    return F.substring(p, F.lit(4), F.length(p))


def byte_counts(df, text: str) -> tuple[int, ...]:
    """How often each byte occurs in a column of texts: 256 numbers, summed before they reach the driver."""
    pairs = df.select(F.explode(F.regexp_extract_all(F.hex(F.encode(q._col(text), "UTF-8")), F.lit(".."), F.lit(0))).alias("b"))
    out = [0] * 256
    for b, n in pairs.groupBy("b").count().collect():
        out[int(b, 16)] = n
    return tuple(out)


def huffman_encode(text, base: int, freq: tuple[int, ...]) -> Column:
    """Digits of the Huffman code of given byte frequencies."""
    codes = F.array(*[F.lit(c) for c in kernel.huffman(base, freq)])
    pairs = F.regexp_extract_all(F.hex(F.encode(q._col(text), "UTF-8")), F.lit(".."), F.lit(0))
    return F.array_join(F.transform(pairs, lambda x: F.element_at(codes, F.conv(x, 16, 10).cast("int") + 1)), "")


def huffman_decode(digits, base: int, freq: tuple[int, ...]) -> Column:
    return _mapped(lambda x: kernel.huffman_decode(x, base, freq).decode(), "string")(q._col(digits))


def permuted(seq, seed, back: bool = False) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or pd.isna(y) else kernel.permute(x, int(y), back) for x, y in zip(s, k, strict=True)], dtype=object)

    return run(q._col(seq), q._lit(seed).cast("long"))


def best_permutation(seq, count: int) -> Column:
    return _mapped(lambda x: kernel.best_permutation(x, count), "string")(q._col(seq))


def undo_permutation(seq) -> Column:
    return _mapped(kernel.undo_permutation, "string")(q._col(seq))


def ecc_encode(seq, parity: int = 2) -> Column:
    return _mapped(lambda x: kernel.ecc_encode(x, parity), "string")(q._col(seq))


def ecc_decode(seq, parity: int = 2) -> Column:
    return _mapped(lambda x: kernel.ecc_decode(x, parity), "string")(q._col(seq))


def pad(seq, target: int) -> Column:
    return _mapped(lambda x: kernel.pad(x, target), "string")(q._col(seq))


def unpad(seq, delimiter: str = kernel.DELIMITER) -> Column:
    """Inverse of pad: the first base tells what to strip."""
    s = q._col(seq)
    body = F.substring(s, F.lit(2), F.length(s))
    return (
        F.when(F.substring(s, 1, 1) == "A", body)
        .when(F.substring(s, 1, 1) == "C", F.substring(body, F.lit(1), F.length(body) - len(delimiter)))
        .otherwise(F.substring(body, F.lit(1), q.last_index_of(body, delimiter)))
    )


def segments(seq, target: int, gc_fix: int) -> Column:
    return _mapped(lambda x: kernel.segments(x, target, gc_fix), "array<string>")(q._col(seq))


def barcode(number, size: int, permutations: int = 8, parity: int = 0) -> Column:
    return _mapped(lambda x: kernel.barcode(int(x), size, permutations, parity), "string")(q._col(number).cast("string"))


def sig_hash(values) -> Column:
    return _mapped(lambda x: kernel.sig_hash([int(v) for v in x]), "long")(q._col(values))


class Codec:
    """A pair of column functions; codecs compose."""

    def __init__(self, encode: Callable, decode: Callable) -> None:
        self.encode, self.decode = encode, decode

    def then(self, other: Codec) -> Codec:
        return Codec(lambda x: other.encode(self.encode(x)), lambda x: self.decode(other.decode(x)))

    def reverse(self) -> Codec:
        return Codec(self.decode, self.encode)

    def each(self) -> Codec:
        """Over the elements of an array; for codecs of Catalyst expressions."""
        return Codec(lambda a: F.transform(a, self.encode), lambda a: F.transform(a, self.decode))


class Asymmetric:
    """A codec whose decoded values are of another kind than what was encoded."""

    def __init__(self, encode: Callable, decode: Callable) -> None:
        self.encode, self.decode = encode, decode

    def then(self, other: Codec) -> Asymmetric:
        """Encodes on with a codec that goes both ways."""
        return Asymmetric(lambda x: other.encode(self.encode(x)), lambda x: self.decode(other.decode(x)))

    def decoded(self, fn: Callable) -> Asymmetric:
        """Decodes on with a function."""
        return Asymmetric(self.encode, lambda x: fn(self.decode(x)))


IDENTITY = Codec(lambda x: x, lambda x: x)
TWO_BIT = Codec(q.encode_2bit, q.decode_2bit)
COMPLEMENT = Codec(q.complement, q.complement)


def named(codec: str) -> Codec:
    """The text codec of that name."""
    return TWO_BIT if codec == "two_bit" else Codec(lambda x: encode_text(x, codec), lambda x: decode_text(x, codec))
