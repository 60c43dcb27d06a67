"""Line-first quality rules, native: rules judge lines, failed lines go, a document that loses too much text is rejected.

Defined cases: a null or empty text has no words and is rejected (fewer than ``min_words``); equal rows get equal
results, each its own row; an empty table gives an empty table; every input column is kept, and a column named like
the output column is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helicase.llm import _common as c

SYMBOLS = "#*$%&|<>"
SENTENCE_MARK = "[.!?:;…。！？]"
BOILERPLATE = (
    "licensed under|all rights reserved|copyright|terms of (use|service)|privacy policy|use cookies|"
    "cookie policy|click here|sign up|subscribe|log in|enable javascript|lorem ipsum"
)
#: Their first two letters: tested before the phrases themselves are tried.
BOILERPLATE_STARTS = "".join("[" + "".join(sorted({x[i].lower() + x[i].upper() for x in BOILERPLATE.split("|")})) + "]" for i in (0, 1))


@dataclass(frozen=True)
class LineRules:
    """Thresholds of the line rules and of the verdict on a document."""

    nav_bars: int = 2  #: a line with so many '|' is navigation
    shout_words: int = 3  #: so many words without a lower-case letter shout
    unmarked_words: int = 10  #: so many words without one sentence mark are no prose
    boilerplate_words: int = 30  #: a stock phrase condemns lines up to so many words
    max_lost_percent: int = 50  #: of a document's word characters
    min_words: int = 50
    max_repeat_percent: int = 50  #: of words inside repeated 3-word windows


def _without(line: Column, text: str) -> Column:
    """Bytes that go when text is cut out of line."""
    return F.octet_length(line) - F.octet_length(F.replace(line, F.lit(text), F.lit("")))


def _measured(line: Column) -> Column:
    """What more than one rule asks of a line, so that it is counted once."""
    return F.struct(line.alias("l"), F.regexp_count(line, F.lit(c.WORD)).alias("n"))


def line_fails(line: Column, words: Column, r: LineRules) -> Column:
    """True for a line that is navigation, symbols, shouting, unpunctuated or boilerplate. words: how many it has."""
    return (
        (_without(line, "|") >= r.nav_bars)
        | (F.regexp_count(line, F.lit(f"[{SYMBOLS}]")) > words)
        | (3 * _without(line, "!!") > 2 * F.greatest(words, F.lit(1)))
        | ((words >= r.shout_words) & ~line.rlike(r"\p{Ll}") & line.rlike(r"\p{Lu}"))
        | ((words >= r.unmarked_words) & ~line.rlike(SENTENCE_MARK))
        | ((words <= r.boilerplate_words) & line.rlike(f"(?={BOILERPLATE_STARTS})(?i:{BOILERPLATE})"))
    )


def _with_repeat_words(d: DataFrame, windows: str, out: str) -> DataFrame:
    """d with ``out``, the words inside 3-word windows found twice or more. windows: the hashes of all, in order; where
    they all differ, as in most texts, the answer is 0. Else equal neighbours of the sorted windows give the positions,
    whose union is summed. Windows of one text are told apart by 64-bit hashes."""
    placed, starts = F.col("__q_placed"), F.col("__q_starts")
    same = lambda x, other: x["h"] == F.get(placed, other)["h"]
    found = F.transform(F.filter(placed, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["p"])
    news = F.transform(starts, lambda p, i: F.least(F.lit(3), p - F.coalesce(F.get(starts, i - 1), F.lit(-3))))
    some = F.size(F.array_distinct(F.col(windows))) < F.size(windows)
    all_placed = F.transform(F.col(windows), lambda h, i: F.struct(h.alias("h"), i.alias("p")))
    d = d.withColumn("__q_placed", F.sort_array(F.when(some, all_placed).otherwise(F.array().cast("array<struct<h:bigint,p:int>>"))))
    d = d.withColumn("__q_starts", F.sort_array(found))
    return d.withColumn(out, F.aggregate(news, F.lit(0), lambda a, x: a + x).cast("long")).drop("__q_placed", "__q_starts")


def clean_lines(df: DataFrame, text_col: str = "text", out: str = "quality", rules: LineRules = LineRules()) -> DataFrame:
    """df with a struct column ``out``: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_chars,
    base_failed, kept, text (the lines that passed, in order)."""
    keep = [x for x in df.columns if x != out]
    t, words, lines, windows, bad = ("__q_text", "__q_words", "__q_lines", "__q_windows", "__q_bad")
    d = df.select(*[F.col(f"`{x}`") for x in keep], F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias(t))
    d = d.withColumns({words: c.word_array(F.col(t)), lines: F.transform(F.split(t, "\n"), _measured)})
    n, w = F.size(words), F.col(words)
    window = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    d = d.withColumns({
        windows: F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), window)).otherwise(F.array().cast("array<bigint>")),
        bad: F.transform(lines, lambda x: line_fails(x["l"], x["n"], rules)),
    })
    worded = F.transform(F.filter(lines, lambda x: x["n"] > 0), lambda x: x["l"])
    solid = lambda x: F.length(F.regexp_replace(x, f"[{c.SPACE_CLASS}]+", "")).cast("long")
    lost = F.aggregate(
        F.zip_with(lines, bad, lambda x, b: F.when(b, solid(x["l"])).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a + x
    )
    passed = F.array_join(F.filter(F.zip_with(lines, bad, lambda x, b: F.when(~b, x["l"])), lambda x: x.isNotNull()), "\n")
    d = d.withColumns({
        "__q_n": n.cast("long"),
        "__q_chars": F.length(F.array_join(words, "")).cast("long"),
        "__q_symbols": F.regexp_count(F.col(t), F.lit(f"[{SYMBOLS}]")).cast("long"),
        "__q_dups": (F.size(worded) - F.size(F.array_distinct(worded))).cast("long"),
        "__q_lost": lost,
        "__q_passed": passed,
    })
    d = _with_repeat_words(d, windows, "__q_repeat")
    failed = (F.col("__q_n") < rules.min_words) | (100 * F.col("__q_repeat") > rules.max_repeat_percent * F.col("__q_n"))
    verdict = ~failed & (100 * F.col("__q_lost") <= rules.max_lost_percent * F.col("__q_chars"))
    named = {"n_words": "__q_n", "word_chars": "__q_chars", "n_symbols": "__q_symbols", "n_dup_lines": "__q_dups", "n_repeat_words": "__q_repeat", "lost_chars": "__q_lost", "text": "__q_passed"}
    result = F.struct(*[F.col(v).alias(k) for k, v in named.items()], failed.alias("base_failed"), verdict.alias("kept"))
    # generated, not projected: a filter on the verdict must not be pushed below, where it would repeat the whole work
    return d.select(*[F.col(f"`{x}`") for x in keep], F.explode(F.array(result)).alias(out))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = clean_lines(c.table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_chars", "base_failed", "kept")
    return d.select("doc_id", *[F.col(f"quality.{x}").alias(x) for x in names])


#: Rows of (rid, doc_id, t, w): the words of each whole text.
_LINE_SQL = rf"""
  (length(l) - length(replace(l, '|', '')) >= 2
   OR length(l) - length(translate(l, '{SYMBOLS}', '')) > lw
   OR 3 * (length(l) - length(replace(l, '!!', ''))) > 2 * greatest(lw, 1)
   OR (lw >= 3 AND NOT regexp_matches(l, '\p{{Ll}}') AND regexp_matches(l, '\p{{Lu}}'))
   OR (lw >= 10 AND NOT regexp_matches(l, '{SENTENCE_MARK}'))
   OR (lw <= 30 AND regexp_matches(l, '(?i)({BOILERPLATE})')))
"""


def quality_sql(source: str = "documents") -> str:
    """DuckDB SQL for the rows of clean_lines over ``source``: its columns, the measures, kept and cleaned."""
    solid = r"length(regexp_replace({}, '[\x20\x09-\x0D]+', '', 'g'))"
    return rf"""
WITH q_d AS (SELECT row_number() OVER () AS rid, s.* FROM {source} s),
q_w AS (SELECT rid, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{c.WORD}') AS w FROM q_d),
q_win AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k
          FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM q_w WHERE len(w) >= 3)),
q_rep AS (SELECT rid, i FROM q_win SEMI JOIN (SELECT rid, k FROM q_win GROUP BY ALL HAVING count(*) > 1) r USING (rid, k)),
q_cov AS (SELECT rid, count(DISTINCT i + j) AS n FROM q_rep, (VALUES (0), (1), (2)) o(j) GROUP BY rid),
q_l0 AS (SELECT rid, generate_subscripts(ls, 1) AS pos, unnest(ls) AS l FROM (SELECT rid, string_split(t, chr(10)) AS ls FROM q_w)),
q_l1 AS (SELECT *, len(regexp_extract_all(l, '{c.WORD}')) AS lw FROM q_l0),
q_l2 AS (SELECT *, {_LINE_SQL} AS bad FROM q_l1),
q_l AS (SELECT rid, count(*) FILTER (lw > 0) - count(DISTINCT l) FILTER (lw > 0) AS dups,
               coalesce(sum({solid.format("l")}) FILTER (bad), 0)::BIGINT AS lost,
               coalesce(string_agg(l, chr(10) ORDER BY pos) FILTER (NOT bad), '') AS cleaned FROM q_l2 GROUP BY rid),
q_m AS (SELECT rid, len(w)::BIGINT AS n_words, {solid.format("t")}::BIGINT AS word_chars,
               (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols, dups::BIGINT AS n_dup_lines,
               coalesce(n, 0)::BIGINT AS n_repeat_words, lost AS lost_chars, cleaned
        FROM q_w JOIN q_l USING (rid) LEFT JOIN q_cov USING (rid)),
quality AS (SELECT q_d.* EXCLUDE (rid), q_m.* EXCLUDE (rid),
                   n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
                   NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * lost_chars <= 50 * word_chars AS kept
            FROM q_d JOIN q_m USING (rid))
"""


OP10_SQL = quality_sql() + (
    "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_chars, base_failed, kept FROM quality"
)
