"""Bit strings (text of 0 and 1): numbers, slices, byte padding, and values tagged with their type."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from helicase.functions import seq as q

# The three-bit tag of each type.
TAGS = {"BYTE": "000", "SHORT": "001", "INT": "010", "LONG": "011", "FLOAT": "100", "DOUBLE": "101", "STRING_8": "110", "STRING_16": "111"}
WIDTHS = {"BYTE": 8, "SHORT": 16, "INT": 32, "LONG": 64}
_TYPE = {v: k for k, v in TAGS.items()}
_FORMAT = {"BYTE": ">b", "SHORT": ">h", "INT": ">i", "LONG": ">q", "FLOAT": ">f", "DOUBLE": ">d"}


def of_number(n, width: int) -> Column:
    """The last width bits of a number's two's complement."""
    return F.right(F.lpad(F.bin(q._col(n).cast("long")), 64, "0"), F.lit(width))


def of_text(text) -> Column:
    """UTF-8 bytes, most significant bit first."""
    return F.array_join(F.transform(F.regexp_extract_all(F.hex(F.encode(q._col(text), "UTF-8")), F.lit(".."), F.lit(0)), lambda x: F.lpad(F.conv(x, 16, 2), 8, "0")), "")


def to_number(bits) -> Column:
    """Unsigned value of up to 63 bits."""
    return F.conv(q._col(bits), 2, 10).cast("long")


def slice_(bits, i: int, j: int) -> Column:
    """Bits from i to before j."""
    return F.substring(q._col(bits), i + 1, j - i)


def set_bit(bits, i: int, value: bool) -> Column:
    return F.overlay(q._col(bits), F.lit("1" if value else "0"), F.lit(i + 1), F.lit(1))


def to_bytes(bits) -> Column:
    """Whole bytes; bits that are no multiple of eight are an error."""
    b = q._col(bits)
    whole = F.array_join(F.transform(F.regexp_extract_all(b, F.lit(".{8}"), F.lit(0)), lambda x: F.lpad(F.conv(x, 2, 16), 2, "0")), "")
    return F.unhex(F.when(F.length(b) % 8 == 0, whole).when(b.isNotNull(), F.raise_error(F.lit("no whole bytes")).cast("string")))


def flip(bits, i: int) -> Column:
    b = q._col(bits)
    return F.overlay(b, F.when(F.substring(b, i + 1, 1) == "1", "0").otherwise("1"), F.lit(i + 1), F.lit(1))


def padded(bits) -> Column:
    """Eight bits that say how many zeros follow, the bits, and 1 to 8 zeros up to whole bytes."""
    b = q._col(bits)
    n = F.lit(8) - F.length(b) % 8
    return F.concat(of_number(n, 8), b, F.repeat(F.lit("0"), n))


def unpadded(bits) -> Column:
    b = q._col(bits)
    return F.substring(b, F.lit(9), F.length(b) - 8 - to_number(F.substring(b, 1, 8)).cast("int"))


def pack_integer(n, kind: str) -> Column:
    return F.concat(F.lit(TAGS[kind]), of_number(n, WIDTHS[kind]))


def pack_minimal(n) -> Column:
    """An integer by its narrowest type."""
    v = q._col(n)
    out = pack_integer(v, "LONG")
    for kind in ("INT", "SHORT", "BYTE"):
        edge = 1 << (WIDTHS[kind] - 1)
        out = F.when(v.between(-edge, edge - 1), pack_integer(v, kind)).otherwise(out)
    return out


def pack_text(text) -> Column:
    """A text with its length in bytes: eight bits up to 255, else sixteen."""
    t = q._col(text)
    n = F.octet_length(t)
    return (
        F.when(n < 256, F.concat(F.lit(TAGS["STRING_8"]), of_number(n, 8), of_text(t)))
        .when(n < 65536, F.concat(F.lit(TAGS["STRING_16"]), of_number(n, 16), of_text(t)))
        .otherwise(F.raise_error(F.lit("a text of more than 65535 bytes")).cast("string"))
    )


def pack_real(x, kind: str = "DOUBLE") -> Column:
    form, tag = _FORMAT[kind], TAGS[kind]

    @F.pandas_udf(StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if pd.isna(v) else tag + "".join(f"{b:08b}" for b in struct.pack(form, v))).astype(object)

    return run(q._col(x).cast("double"))


def _unpack(bits: str) -> list[str]:
    out, at = [], 0
    raw = lambda i, n: int(bits[i : i + n], 2).to_bytes(n // 8, "big") if n else b""
    while at + 3 <= len(bits):
        kind = _TYPE[bits[at : at + 3]]
        at += 3
        if kind.startswith("STRING"):
            head = 8 if kind == "STRING_8" else 16
            n = int(bits[at : at + head], 2) * 8
            out.append(raw(at + head, n).decode())
            at += head + n
        else:
            size = struct.calcsize(_FORMAT[kind]) * 8
            out.append(repr(struct.unpack(_FORMAT[kind], raw(at, size))[0]))
            at += size
    return out


def unpack_all(bits) -> Column:
    """The values in a row of tagged ones, as texts."""

    @F.pandas_udf(ArrayType(StringType()))
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else _unpack(b)).astype(object)

    return run(q._col(bits))
