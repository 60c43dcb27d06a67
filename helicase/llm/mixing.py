"""Mixing sources to target weights, native: capped water-filling over sources, seeded whole and fractional repetitions.

Each source's share of the budget follows its weight; a source stops at ``max_epochs`` times its size and what it can't
use goes to the others by weight. With the sources sorted by cap / weight this has a closed form: the saturated sources
are a prefix, and one level holds for the rest, so one window over a row per source replaces rounds of redistribution.

A source's target is made of whole repetitions of all its documents and a rest. The rest takes whole documents in the
order of a seeded hash, by hash bucket, and in the one bucket where it ends a part of each document. Sums by
(source, bucket) are aggregated before the shuffle, and documents are joined on (source, bucket), so that a source with
a third of all rows is spread over all buckets.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; a null key is hashed like
an empty one; equal rows take equal numbers of words; an empty table gives an empty table; input columns are kept but
those named like an output column (size, source_size, target, taken, epochs, partial), which are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from helicase.llm import _common as c

OUT = ("size", "source_size", "target", "taken", "epochs", "partial")
BUCKET_HEX = 3  #: 4096 buckets a source


def mix_sources(
    df: DataFrame,
    key_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (1, 2, 3),
    max_epochs: int = 3,
    seed: int = 17,
) -> DataFrame:
    """df with size, source_size, target, taken, epochs (whole repetitions) and partial (words of one more, fractional one)."""
    keep = [x for x in df.columns if x not in OUT]
    col = lambda x: F.col(f"`{x}`")
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(col(key_col).cast("string"), F.lit(""))))
    d = df.select(
        *[col(x) for x in keep],
        c.word_count(col(text_col)).alias("__m_size"),
        col(source_col).isNull().alias("__m_null"),
        F.coalesce(col(source_col), F.lit("")).alias("__m_src"),
        digest.alias("__m_md5"),
    ).withColumn("__m_bucket", F.substring("__m_md5", 1, BUCKET_HEX))
    src = ["__m_null", "__m_src"]
    buckets = d.groupBy(*src, "__m_bucket").agg(F.sum("__m_size").alias("__m_b"))

    totals = buckets.groupBy(*src).agg(F.sum("__m_b").alias("__m_total"))
    ranked = totals.withColumn("__m_rn", F.row_number().over(W.orderBy(*src)))
    ranked = ranked.withColumns({
        "__m_w": F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.col("__m_rn") - 1) % len(weights) + 1).cast("int")).cast("long"),
        "__m_cap": F.col("__m_total") * max_epochs,
    })
    by_fill = W.orderBy(F.col("__m_cap") / F.col("__m_w"), "__m_rn")
    everything = W.partitionBy()
    level = ranked.withColumns({
        "__m_rank": F.row_number().over(by_fill),
        "__m_full": F.coalesce(F.sum("__m_cap").over(by_fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        "__m_rest_w": F.sum("__m_w").over(by_fill.rowsBetween(0, W.unboundedFollowing)),
        "__m_budget": F.sum("__m_total").over(everything),
    }).withColumn("__m_level", (F.col("__m_budget") - F.col("__m_full")).cast("double") / F.col("__m_rest_w"))
    open_ = F.col("__m_cap") > F.col("__m_level") * F.col("__m_w")
    level = level.withColumn("__m_open", F.min(F.when(open_, F.struct("__m_rank", "__m_level"))).over(everything))
    target = F.when(F.col("__m_open").isNull() | (F.col("__m_rank") < F.col("__m_open.__m_rank")), F.col("__m_cap").cast("double")).otherwise(
        F.col("__m_open.__m_level") * F.col("__m_w")
    )
    targets = level.select(*src, "__m_total", target.alias("__m_target"))

    whole = F.when(F.col("__m_total") > 0, F.least(F.floor(F.col("__m_target") / F.col("__m_total")), F.lit(max_epochs))).otherwise(F.lit(0)).cast("long")
    plan = (
        buckets.withColumn("__m_cum", F.sum("__m_b").over(W.partitionBy(*src).orderBy("__m_bucket").rowsBetween(W.unboundedPreceding, 0)))
        .join(targets, src)
        .withColumn("__m_whole", whole)
        .withColumn("__m_rest", F.col("__m_target") - (F.col("__m_whole") * F.col("__m_total")).cast("double"))
    )
    before = F.col("__m_cum") - F.col("__m_b")
    share = (
        F.when(F.col("__m_cum") <= F.col("__m_rest"), F.lit(1.0))
        .when(before >= F.col("__m_rest"), F.lit(0.0))
        .otherwise((F.col("__m_rest") - before) / F.col("__m_b"))
    )
    plan = plan.select(*src, "__m_bucket", "__m_total", "__m_target", "__m_whole", share.alias("__m_share"))
    dither = F.conv(F.substring("__m_md5", 9, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    part = (
        F.when(F.col("__m_share") >= 1.0, F.col("__m_size"))
        .when(F.col("__m_share") <= 0.0, F.lit(0).cast("long"))
        .otherwise(F.floor(F.col("__m_size") * F.col("__m_share") + dither))
    )
    return (
        d.join(plan, [*src, "__m_bucket"])
        .withColumn("__m_part", part)
        .select(
            *[col(x) for x in keep],
            F.col("__m_size").alias("size"),
            F.col("__m_total").alias("source_size"),
            F.col("__m_target").alias("target"),
            (F.col("__m_whole") * F.col("__m_size") + F.col("__m_part")).cast("long").alias("taken"),
            F.col("__m_whole").alias("epochs"),
            F.col("__m_part").cast("long").alias("partial"),
        )
    )


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(c.table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "source", *OUT)


def mixing_sql(source: str = "documents", seed: int = 17) -> str:
    """DuckDB SQL: CTEs up to ``mixed``, the rows of mix_sources over ``source``."""
    return rf"""
m_d AS (SELECT s.*, len(regexp_extract_all(coalesce(text, ''), '{c.WORD}'))::BIGINT AS size, s.source IS NULL AS nul,
               coalesce(s.source, '') AS src, md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM {source} s),
m_b AS (SELECT nul, src, substr(h, 1, {BUCKET_HEX}) AS bucket, sum(size)::BIGINT AS b FROM m_d GROUP BY ALL),
m_t AS (SELECT nul, src, sum(b)::BIGINT AS total, row_number() OVER (ORDER BY nul, src) AS rn FROM m_b GROUP BY nul, src),
m_r AS (SELECT *, 1 + (rn - 1) % 3 AS w, 3 * total AS cap FROM m_t),
m_f AS (SELECT *, row_number() OVER f AS rk, coalesce(sum(cap) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS used,
               sum(w) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS rest_w, (sum(total) OVER ())::BIGINT AS budget
        FROM m_r WINDOW f AS (ORDER BY cap::DOUBLE / w, rn)),
m_l AS (SELECT *, (budget - used)::DOUBLE / rest_w AS lev FROM m_f),
m_o AS (SELECT min(rk) AS rk0, arg_min(lev, rk) AS lev0 FROM m_l WHERE cap > lev * w),
m_g AS (SELECT nul, src, total, CASE WHEN rk0 IS NULL OR rk < rk0 THEN cap::DOUBLE ELSE lev0 * w END AS target FROM m_l, m_o),
m_c AS (SELECT nul, src, bucket, b, (sum(b) OVER (PARTITION BY nul, src ORDER BY bucket ROWS UNBOUNDED PRECEDING))::BIGINT AS cum FROM m_b),
m_p AS (SELECT *, target - (epochs * total)::DOUBLE AS rest
        FROM (SELECT *, CASE WHEN total > 0 THEN least(floor(target / total), 3)::BIGINT ELSE 0 END AS epochs FROM m_c JOIN m_g USING (nul, src))),
m_s AS (SELECT nul, src, bucket, total, target, epochs,
               CASE WHEN cum <= rest THEN 1.0::DOUBLE WHEN cum - b >= rest THEN 0.0::DOUBLE ELSE (rest - (cum - b)) / b END AS share FROM m_p),
m_x AS (SELECT m_d.*, total, m_s.target, epochs, CASE WHEN share >= 1 THEN size WHEN share <= 0 THEN 0
               ELSE floor(size * share + ('0x' || substr(h, 9, 8))::BIGINT / 4294967296.0::DOUBLE)::BIGINT END AS part
        FROM m_d JOIN m_s ON m_d.nul = m_s.nul AND m_d.src = m_s.src AND substr(h, 1, {BUCKET_HEX}) = bucket),
mixed AS (SELECT doc_id, source, size, total AS source_size, target, (epochs * size + part)::BIGINT AS taken, epochs::BIGINT AS epochs, part::BIGINT AS partial FROM m_x)
"""


OP9_SQL = "WITH " + mixing_sql() + "SELECT * FROM mixed"
