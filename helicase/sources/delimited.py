"""Headered delimited text, as lines with their cells: a regular expression parts cells, nothing quotes, trailing empty cells vanish."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts no line: stands for a separator where lines are read or written whole.
NEVER = "\x01"


def cells(line, delimiter: str) -> Column:
    """The line's cells, without empty ones at its end."""
    return F.split(F.regexp_replace(F.col(line) if isinstance(line, str) else line, f"(?:{delimiter})+$", ""), delimiter)


def header(line: str, delimiter: str = ",") -> list[str]:
    """The names in a header line, in order; they must differ."""
    names = re.split(delimiter, line)
    if len(set(names)) < len(names):
        raise ValueError(f"column names repeat: {names}")
    return names


def read(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """A column of strings for each name of the header, and ``line``. Each file starts with the header: its first line
    goes, equal ones further down are rows. Blank lines are none."""
    first = spark.read.text(path).first()
    if first is None:
        raise ValueError(f"{path} has no header")
    lines = spark.read.options(header=True, sep=NEVER, quote="", escape="", comment="").schema("value string").csv(path)
    return parse(lines, header(first[0], delimiter), delimiter)


def parse(lines: DataFrame, names: list[str], delimiter: str = ",") -> DataFrame:
    """(line, names...) of lines (value); a missing cell is null."""
    d = lines.select(F.col("value").alias("line"), cells("value", delimiter).alias("__cells"))
    return d.select("line", *[F.get("__cells", F.lit(i)).alias(n) for i, n in enumerate(names)])


def one(rows: DataFrame) -> DataFrame:
    """A single row, or none if there is no more."""
    return rows.limit(1)


def at(line, i: int, delimiter: str = ",") -> Column:
    """A line's cell by its place; null where the line has fewer."""
    if i < 0:
        raise IndexError(i)
    return F.get(cells(line, delimiter), F.lit(i))


def project(rows: DataFrame, names: list[str]) -> DataFrame:
    """The named columns; a name that isn't in the header is an error."""
    if unknown := [n for n in names if n not in rows.columns]:
        raise KeyError(f"no columns {unknown}")
    return rows.select(*[F.col(f"`{n}`") for n in names])


def render(df: DataFrame, names: list[str]) -> Column:
    """A line as ``name: cell`` pairs."""
    return F.concat_ws(", ", *[F.concat(F.lit(f"{n}: "), F.coalesce(F.col(n), F.lit(""))) for n in names])


def joined(names: list[str], delimiter: str = ",") -> Column:
    """A line of cells; nothing quotes, so a cell with the delimiter or a line's end is an error."""
    bad = F.lit(False)
    for n in names:
        bad = bad | F.coalesce(F.col(f"`{n}`").cast("string").contains(delimiter) | F.col(f"`{n}`").cast("string").rlike("[\r\n]"), F.lit(False))
    line = F.concat_ws(delimiter, *[F.coalesce(F.col(f"`{n}`").cast("string"), F.lit("")) for n in names])
    return F.when(bad, F.raise_error(F.lit("a cell holds the delimiter or a line's end")).cast("string")).otherwise(line)


def write(df: DataFrame, path: str, delimiter: str = ",", mode: str = "append") -> None:
    """Files that ``read`` reads back: a header each, then a line a row."""
    names = df.columns
    line = df.select(joined(names, delimiter).alias(delimiter.join(names)))
    line.write.mode(mode).options(header=True, sep=NEVER, quote="\x00", escape="\x00", quoteAll=False, emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
