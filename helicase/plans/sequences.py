"""Queries of the scalar functions: construction, statistics, distances, rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helicase.functions import distance, rules
from helicase.functions import seq as q
from helicase.plans.base import query, sql_encode, sql_strands, strands, table

RUNS_SQL = "regexp_extract_all(seq, '(A+|C+|G+|T+)')"
GC_SQL = "(length(seq) - length(translate(seq, 'GC', '')))"


def _one(name: str, which: str, expr, sql: str, out: str = "v", where: str | None = None) -> None:
    """A query (id, out) of one expression over a strand relation."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = strands(spark, sf_dir, which)
        d = d.where(where) if where else d
        return d.select("id", expr(F.col("seq")).alias(out))

    query(f"WITH {sql_strands(which)} SELECT id, {sql} AS {out} FROM s" + (f" WHERE {where}" if where else ""), name)(run)


_one("seq_encode2bit", "doc", lambda s: s, "seq")
_one("seq_complement", "doc", q.complement, "translate(seq, 'ACGT', 'TGCA')")
_one("seq_reverse", "doc", q.reverse, "reverse(seq)")
_one("seq_reverse_complement", "doc", q.reverse_complement, "reverse(translate(seq, 'ACGT', 'TGCA'))")
_one("seq_ordinals", "doc", q.ordinals, "translate(seq, 'ATCG', '0123')")
_one("seq_is_strand", "doc", q.is_strand, "regexp_matches(seq, '^[ACGT]*$')")
_one("seq_insert", "doc", lambda s: q.insert(s, 5, "GATTACA"), "substr(seq, 1, 5) || 'GATTACA' || substr(seq, 6)", where="length(seq) >= 5")
_one("seq_set_base", "doc", lambda s: q.set_base(s, 3, "G"), "substr(seq, 1, 3) || 'G' || substr(seq, 5)", where="length(seq) > 3")
_one("seq_base_at", "doc", lambda s: q.base_at(s, 7), "substr(seq, 8, 1)")
_one("seq_swap", "doc", lambda s: q.swap(s, 1, 6), "substr(seq, 1, 1) || substr(seq, 7, 1) || substr(seq, 3, 4) || substr(seq, 2, 1) || substr(seq, 8)", where="length(seq) > 6")
_one("seq_sub_sequence", "doc", lambda s: q.sub_sequence(s, 10, 90), "substr(seq, 11, 80)")
_one("seq_join", "cust", lambda s: q.join(s, q.complement(s)), "seq || translate(seq, 'ACGT', 'TGCA')")
_one("seq_split_every", "doc", lambda s: q.split_every(s, 150), "[substr(seq, (i * 150 + 1)::BIGINT, 150) for i in range(0, ((length(seq) + 149) // 150)::BIGINT)]")
_one("seq_replace_first", "doc", lambda s: q.replace_first(s, "TATA", "CGCG"), "CASE WHEN instr(seq, 'TATA') = 0 THEN seq ELSE substr(seq, 1, instr(seq, 'TATA') - 1) || 'CGCG' || substr(seq, instr(seq, 'TATA') + 4) END")
_one("seq_contains", "doc", lambda s: q.contains(s, "GATTACA"), "contains(seq, 'GATTACA')")
_one("seq_last_index", "doc", lambda s: q.last_index_of(s, "TACA"), "CASE WHEN instr(reverse(seq), 'ACAT') = 0 THEN -1 ELSE length(seq) - 4 - instr(reverse(seq), 'ACAT') + 1 END")
_one("seq_address_payload", "doc", lambda s: F.to_json(q.split_oligo(s, 80)), "'{\"address\":\"' || substr(seq, 1, 80) || '\",\"payload\":\"' || substr(seq, 81) || '\"}'")
_one("seq_gc_count", "doc", q.gc_count, GC_SQL)
_one("seq_gc_content", "doc", lambda s: F.round(q.gc_content(s), 9), f"round({GC_SQL} / length(seq), 9)", where="length(seq) > 0")
_one("seq_longest_homopolymer", "doc", q.longest_homopolymer, f"greatest(1, coalesce(list_max([length(x) for x in {RUNS_SQL}]), 1))")
_one("seq_homopolymer_at", "doc", lambda s: q.homopolymer_at(s, 4), "length(regexp_extract(substr(seq, 5), '^(A+|C+|G+|T+)', 1))")
_one("seq_count_matches", "doc", lambda s: q.count_matches(s, "AT"), "len(regexp_extract_all(substr(seq, 1, length(seq) - 1), 'AT'))", where="length(seq) > 0")
_one("seq_count_consecutive", "doc", lambda s: q.count_consecutive(s, "AT"), "coalesce(list_max([length(x) for x in regexp_extract_all(substr(seq, 1, length(seq) - 1), '(?:AT)+')]), 0) // 2", where="length(seq) > 0")
_one("seq_run_starts", "cust", lambda s: q.long_run_starts(s, 2), f"[x[1] for x in list_zip([list_sum([length(y) for y in {RUNS_SQL}[1:i]])::INTEGER for i in range(0, len({RUNS_SQL}))], [length(z) for z in {RUNS_SQL}]) if x[2] > 2]")
_one("seq_run_total", "doc", lambda s: F.size(q.runs(s)), f"len({RUNS_SQL})")
_one("kmer_base4", "cust", lambda s: q.kmer_codes(s, 12), "[list_sum([(instr('ACGT', substr(seq, i + j, 1)) - 1) * (4 ** j)::BIGINT for j in range(0, 12)])::BIGINT for i in range(1, length(seq) - 10)]")
_one("kmer_list", "cust", lambda s: q.kmers(s, 5), "[substr(seq, i, 5) for i in range(1, length(seq) - 3)]")
_one("seq_seed", "cust", q.seed, " * ".join(f"greatest(1, length(seq) - length(replace(seq, '{b}', '')))" for b in "ACGT"))
_one("rule_gc", "doc", rules.gc_error, f"CASE WHEN 5 * {GC_SQL} = 3 * length(seq) THEN 0.4 WHEN 10 * abs(2 * {GC_SQL} - length(seq)) <= 2 * length(seq) THEN 0.0 WHEN 20 * abs(2 * {GC_SQL} - length(seq)) <= 6 * length(seq) THEN 0.4 WHEN 10 * abs(2 * {GC_SQL} - length(seq)) <= 4 * length(seq) THEN 0.8 ELSE 1.0 END::DOUBLE", where="length(seq) > 0")
_one(
    "rule_gc_window", "cust", lambda s: F.round(rules.gc_window_error(s), 6),
    "round(least(1.0, 5 * pow((SELECT list_max(w) - list_min(w) FROM (SELECT [(k - length(translate(substr(seq, i + 1, k), 'GC', ''))) / k for i in range(0, length(seq) - k + 1)] AS w FROM (SELECT least(length(seq), greatest(length(seq) // 4, 10)) AS k))), 2)), 6)",
    where="length(seq) > 0",
)
HP_SQL = f"coalesce(list_avg([1 - 1 / (1 + exp(length(x) - 6)) for x in {RUNS_SQL} if length(x) > 6]), 0.0)"
_one("rule_hp", "doc", lambda s: F.round(rules.hp_error(s), 6), f"round({HP_SQL}, 6)")


def _satellite_sql(units: list[str]) -> str:
    count = lambda u: f"coalesce(list_max([length(x) // {len(u)} for x in regexp_extract_all(substr(seq, 1, length(seq) - 1), '(?:{u})+')]), 0)"
    return "round(" + " + ".join(f"list_sum([CASE WHEN {count(u)} > 5 + 5 * j THEN 0.001 * j ELSE 0 END for j in range(1, 20)])::DOUBLE" for u in units) + ", 6)"


_one("rule_satellites_2", "cust", lambda s: F.round(rules.satellites_2(F.concat(s, F.repeat(F.lit("AT"), 30), s)), 6), _satellite_sql(rules.DIMERS).replace("seq", "(seq || repeat('AT', 30) || seq)"))
_one("rule_satellites_3", "cust", lambda s: F.round(rules.satellites_3(F.concat(s, F.repeat(F.lit("GAT"), 40))), 6), _satellite_sql(rules.TRIMERS).replace("seq", "(seq || repeat('GAT', 40))"))
REPEAT_SQL = "(1 + len([i for i in range(1, length(seq) - 7) if instr(substr(seq, i + 1, length(seq) - i - 1), substr(seq, i, 9)) > 0]))"
_one("rule_repeats", "cust", lambda s: F.round(rules.repeat_error(s), 6), f"round(CASE WHEN {REPEAT_SQL} <= 1 THEN 0 WHEN {REPEAT_SQL} * 9.0 / length(seq) > 0.44 THEN 1 ELSE 0.5 * {REPEAT_SQL} * 9.0 / length(seq) END, 6)::DOUBLE")
_one("rule_repeats_strict", "item", lambda s: rules.repeat_error(s, 20, True), "CASE WHEN len([i for i in range(1, length(seq) - 18) if instr(substr(seq, i + 1, length(seq) - i - 1), substr(seq, i, 20)) > 0]) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE", where="length(seq) >= 20")

_QUALITY = rules.Rules({"gc": rules.gc_error, "hp": rules.hp_error})
_GC_RULE = f"CASE WHEN 5 * gc = 3 * n THEN 0.4 WHEN 10 * abs(2 * gc - n) <= 2 * n THEN 0.0 WHEN 20 * abs(2 * gc - n) <= 6 * n THEN 0.4 WHEN 10 * abs(2 * gc - n) <= 4 * n THEN 0.8 ELSE 1.0 END"


@query(
    f"""WITH {sql_strands("doc")}, m AS (SELECT id, length(seq) AS n, {GC_SQL} AS gc, greatest(1, coalesce(list_max([length(x) for x in {RUNS_SQL}]), 1)) AS longest, {HP_SQL} AS hp FROM s WHERE length(seq) > 0),
    e AS (SELECT *, (1 + exp(-0.5)) / (1 + exp(-3 * ({_GC_RULE} + hp) + 0.5)) - exp(-0.5) AS err FROM m)
    SELECT id, n AS bases, round(gc / n, 6) AS gc, longest AS longest_run, round(err, 6) AS error FROM e WHERE err <= 0.7"""
)
def seq_strand_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as strands, with GC content, longest run and rule error, those of error 0.7 at most."""
    d = strands(spark, sf_dir, "doc").where("length(seq) > 0").withColumn("err", _QUALITY.error("seq"))
    return d.where("err <= 0.7").select(
        "id", F.length("seq").alias("bases"), F.round(q.gc_content("seq"), 6).alias("gc"), q.longest_homopolymer("seq").alias("longest_run"), F.round("err", 6).alias("error")
    )


@query(f"WITH {sql_strands('cust')} SELECT id FROM s WHERE (1 + exp(-0.5)) / (1 + exp(-3 * ({_GC_RULE.replace('gc', GC_SQL).replace(' n ', ' length(seq) ').replace('- n)', '- length(seq))').replace('* n', '* length(seq)')} + {HP_SQL}) + 0.5)) - exp(-0.5) <= 0.6")
def rule_within_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strands within an error limit, cheap rules first."""
    return _QUALITY.within(strands(spark, sf_dir, "cust"), "seq", 0.6).select("id")


@query(f"SELECT p_partkey AS id, {sql_encode('p_name')} AS seq, p_name AS back FROM part")
def seq_decode2bit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strands(spark, sf_dir, "part").select("id", "seq", q.decode_2bit("seq").alias("back"))


@query(f"WITH {sql_strands('doc')} SELECT id, b AS base, length(seq) - length(replace(seq, b, '')) AS n FROM s, (VALUES ('A'), ('C'), ('G'), ('T')) v(b) WHERE contains(seq, b)")
def seq_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strands(spark, sf_dir, "doc").select("id", F.explode(q.histogram("seq")).alias("base", "n"))


@query(f"WITH {sql_strands('item')} SELECT id, i AS pos, round((50 - length(translate(substr(seq, i + 1, 50), 'GC', ''))) / 50, 6) AS gc FROM (SELECT id, seq, unnest(range(0, greatest(length(seq) - 50, 0) + 1)) AS i FROM s WHERE length(seq) >= 50)")
def seq_gc_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = strands(spark, sf_dir, "item").where("length(seq) >= 50")
    return d.select("id", F.posexplode(q.gc_windows("seq", 50)).alias("pos", "gc")).withColumn("gc", F.round("gc", 6)).withColumn("pos", F.col("pos").cast("long"))


@query(f"WITH {sql_strands('cust')} SELECT substr(seq, i, 4) AS kmer, count(*) AS n FROM (SELECT seq, unnest(range(1, length(seq) - 2)) AS i FROM s) GROUP BY ALL")
def kmer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strands(spark, sf_dir, "cust").select(F.explode(q.kmers("seq", 4)).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("n"))


@query(f"WITH {sql_strands('part')} SELECT seq[1:12] AS head, string_agg(seq, '' ORDER BY id) AS joined FROM s GROUP BY ALL")
def seq_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered concatenation of strands by their first twelve bases."""
    d = strands(spark, sf_dir, "part").groupBy(F.substring("seq", 1, 12).alias("head"))
    return d.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "seq"))), lambda x: x["seq"]), "").alias("joined"))


def pairs(spark: SparkSession, sf_dir: str, which: str = "cust") -> DataFrame:
    """Each strand with the one of the next id."""
    a = strands(spark, sf_dir, which)
    b = a.select((F.col("id") - 1).alias("id"), F.col("seq").alias("b"))
    return a.withColumnRenamed("seq", "a").join(b, "id")


def _pair_sql(which: str) -> str:
    return f"WITH {sql_strands(which)}, p AS (SELECT x.id, x.seq AS a, y.seq AS b FROM s x JOIN s y ON y.id = x.id + 1)"


def _kmer_sql(col: str, k: int) -> str:
    return f"[substr({col}, i, {k}) for i in range(1, length({col}) - {k - 2})]"


def _pair(name: str, expr, sql: str, which: str = "cust") -> None:
    query(f"{_pair_sql(which)} SELECT id, {sql} AS v FROM p", name)(lambda spark, sf_dir: pairs(spark, sf_dir, which).select("id", expr("a", "b").alias("v")))


_pair("dist_hamming", lambda a, b: F.round(distance.hamming(a, F.concat(b, F.lit("AC"))), 6), "round((hamming(a, b) + 2) / (length(a) + 2), 6)")
_pair("dist_edit_count", distance.edit_count, "levenshtein(a, b)", "item")
_pair("dist_edit", lambda a, b: F.round(distance.edit(a, b), 6), "round(levenshtein(a, b) / greatest(length(a), length(b)), 6)", "item")
_pair("dist_jaccard", lambda a, b: F.round(distance.jaccard(a, b, 6), 6), f"round(1 - len(list_intersect({_kmer_sql('a', 6)}, {_kmer_sql('b', 6)})) / len(list_distinct(list_concat({_kmer_sql('a', 6)}, {_kmer_sql('b', 6)}))), 6)")
query(
    f"""{_pair_sql("cust")}, k AS (SELECT id, 0 AS side, unnest({_kmer_sql("a", 4)}) AS m FROM p UNION ALL SELECT id, 1, unnest({_kmer_sql("b", 4)}) FROM p),
    n AS (SELECT id, m, count(*) FILTER (side = 0) AS x, count(*) FILTER (side = 1) AS y FROM k GROUP BY id, m)
    SELECT id, round(1 - sum(least(x, y)) / sum(greatest(x, y)), 6) AS v FROM n GROUP BY id""",
    "dist_weighted_jaccard",
)(lambda spark, sf_dir: pairs(spark, sf_dir).select("id", F.round(distance.weighted_jaccard("a", "b", 4), 6).alias("v")))
query(None, "dist_lcs")(lambda spark, sf_dir: pairs(spark, sf_dir, "item").select("id", distance.lcs("a", "b").alias("v")))


@query(None)
def seq_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), q.random_strand(60, 0.5, 42).alias("seq"))
