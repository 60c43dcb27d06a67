"""Queries of codecs, packed numbers, the similarity index, containers, addresses, collections and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helicase.functions import bits, codecs, distance, kernel, minhash, util
from helicase.functions import seq as q
from helicase.operators import addressing, collections, container, lsh, oligos, stored
from helicase.plans import sequences
from helicase.plans.base import encoded, query, sql_encode, sql_strands, strands, table, texts
from helicase.shipping import spread
from helicase.sources import delimited, records
from helicase.tables import checkpoint, scratch

LSH = minhash.Lsh(k=5, r=6, b=3)


def _sql_map(table_: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in table_.items()) + "}"


def _sql_fold(digits: str, table_: dict[str, str], state: int) -> str:
    return f"list_reduce(list_prepend('', string_split({digits}, '')), lambda acc, d: acc || substr({_sql_map(table_)}[right(acc, {state})], d::INTEGER + 1, 1))"


def _sql_huffman(text: str, base: int) -> str:
    codes = "[" + ", ".join(f"'{c}'" for c in kernel.huffman(base)) + "]"
    h = f"hex(encode({text}))"
    return f"array_to_string([{codes}[('0x' || substr({h}, (2 * i + 1)::BIGINT, 2))::INTEGER + 1] for i in range(0, (length({h}) // 2)::BIGINT)], '')"


def _named(name: str, fn, sql: str | None = None) -> None:
    query(sql, name)(fn)


_named("codec_huffman3", lambda s, d: table(s, d, "part").select("p_partkey", codecs.huffman_digits("p_name", 3).alias("digits")), f"SELECT p_partkey, {_sql_huffman('p_name', 3)} AS digits FROM part")
_named("codec_naive4", lambda s, d: spread(table(s, d, "documents").select("doc_id", "text")).select("doc_id", codecs.naive4("text").alias("seq")), f"SELECT doc_id, translate({_sql_huffman('text', 4)}, '0123', 'ATCG') AS seq FROM documents")
_named("codec_rotating3", lambda s, d: table(s, d, "part").select("p_partkey", codecs.encode_text("p_name", "rotating3").alias("seq")), f"SELECT p_partkey, {_sql_fold(_sql_huffman('p_name', 3), kernel.ROTATION_3, 1)} AS seq FROM part")
_named("codec_rotating3_digits", lambda s, d: table(s, d, "part").select("p_partkey", codecs.rotate3_digits(codecs.encode_text("p_name", "rotating3")).alias("digits")), f"SELECT p_partkey, {_sql_huffman('p_name', 3)} AS digits FROM part")
_named("codec_rotating4", lambda s, d: table(s, d, "part").select("p_partkey", codecs.encode_text("p_name", "rotating4").alias("seq")), f"SELECT p_partkey, {_sql_fold(_sql_huffman('p_name', 4), kernel.QUATTRO, 2)} AS seq FROM part")
_named("codec_utf16", lambda s, d: table(s, d, "customer").select("c_custkey", codecs.utf16_strand("c_name").alias("seq")), f"SELECT c_custkey, {sql_encode('c_name').replace('hex(encode(c_name))', chr(39) + '00' + chr(39) + ' || array_to_string([substr(hex(encode(c_name)), 2 * i + 1, 2) for i in range(0, length(c_name))], ' + chr(39) + '00' + chr(39) + ')')} AS seq FROM customer")
_BITS2 = _sql_huffman("text", 2)
_PAIRS = "array_to_string([CASE substr(b, (2 * i + 1)::BIGINT, 2) WHEN '00' THEN 'A' WHEN '01' THEN 'T' WHEN '10' THEN 'C' ELSE 'G' END for i in range(0, length(b) // 2)], '')"
_SEQ_SQL = {
    "rotating3": f"SELECT item_id, {_sql_fold(_sql_huffman('text', 3), kernel.ROTATION_3, 1)} AS seq, text FROM benchmark",
    "rotating4": f"SELECT item_id, {_sql_fold(_sql_huffman('text', 4), kernel.QUATTRO, 2)} AS seq, text FROM benchmark",
    "naive4": f"SELECT item_id, translate({_sql_huffman('text', 4)}, '0123', 'ATCG') AS seq, text FROM benchmark",
    "bin": f"SELECT item_id, CASE WHEN length(b) % 2 = 0 THEN 'A' WHEN right(b, 1) = '0' THEN 'G' ELSE 'C' END || {_PAIRS} AS seq, text FROM (SELECT item_id, text, {_BITS2} AS b FROM benchmark)",
}
for _codec in kernel.CODECS:
    if _codec in _SEQ_SQL:
        _named(f"codec_round_trip_{_codec}", lambda s, d, k=_codec: table(s, d, "benchmark").select("item_id", codecs.encode_text("text", k).alias("seq")).select("item_id", "seq", codecs.decode_text("seq", k).alias("text")), _SEQ_SQL[_codec])
    else:  # packets are drawn: the strands are tested for what they must be
        _named(
            f"codec_round_trip_{_codec}",
            lambda s, d, k=_codec: table(s, d, "benchmark").select("item_id", codecs.encode_text("text", k).alias("seq")).select("item_id", (q.is_strand("seq") & (q.longest_homopolymer("seq") <= 12)).alias("sound"), codecs.decode_text("seq", k).alias("text")),
            "SELECT item_id, true AS sound, text FROM benchmark",
        )
_named("codec_round_trip_ecc", lambda s, d: strands(s, d, "item").select("id", codecs.ecc_encode("seq", 4).alias("code")).select("id", F.length("code").alias("bases"), codecs.ecc_decode(q.set_base("code", 20, q.complement(q.base_at("code", 20))), 4).alias("seq")), f"WITH {sql_strands('item')} SELECT id, length(seq) + 4 + 16 * ceil((length(seq) // 4 + 1) / 251)::INTEGER AS bases, seq FROM s")
_named("codec_round_trip_pad", lambda s, d: strands(s, d, "cust").select("id", codecs.pad("seq", 120).alias("p")).select("id", F.length("p").alias("bases"), codecs.unpad("p").alias("seq")), f"WITH {sql_strands('cust')} SELECT id, 120 AS bases, seq FROM s")
_named("codec_round_trip_permutation", lambda s, d: strands(s, d, "cust").select("id", codecs.best_permutation("seq", 4).alias("p")).select("id", F.length("p").alias("bases"), q.gc_count(F.substring("p", F.lit(4), F.length("p"))).alias("gc"), codecs.undo_permutation("p").alias("seq")), f"WITH {sql_strands('cust')} SELECT id, length(seq) + 3 AS bases, length(seq) - length(translate(seq, 'GC', '')) AS gc, seq FROM s")
_named("codec_segments", lambda s, d: strands(s, d, "cust").select("id", F.posexplode(codecs.segments("seq", 40, 4)).alias("seg", "part")).select("id", "seg", F.length("part").alias("bases")), f"WITH {sql_strands('cust')} SELECT id, seg::INTEGER AS seg, 40 AS bases FROM (SELECT id, unnest(range(0, (length(seq) + 32) // 33)) AS seg FROM s)")
_named("seq_permute", lambda s, d: strands(s, d, "cust").select("id", "seq", codecs.permuted("seq", q.seed("seq")).alias("p")).select("id", (F.col("p") != F.col("seq")).alias("moved"), codecs.permuted("p", q.seed("p"), True).alias("seq")), f"WITH {sql_strands('cust')} SELECT id, true AS moved, seq FROM s")

for _kind, (_sign, _size) in kernel.PACKED.items():
    _digits = f"array_to_string([((p_partkey % {4 ** min(_size, 15)}) // (4 ** i)::BIGINT) % 4 for i in range({_size - 1}, -1, -1)], '')" if _size <= 16 else f"repeat('0', 16) || array_to_string([(p_partkey // (4 ** i)::BIGINT) % 4 for i in range(15, -1, -1)], '')"
    _named(
        f"pack_{_kind.lower()}",
        lambda s, d, k=_kind, n=4 ** min(_size, 15) if _size <= 16 else 1 << 62: table(s, d, "part").select("p_partkey", codecs.pack(F.col("p_partkey") % n, k).alias("seq")),
        f"SELECT p_partkey, '{_sign}' || {_sql_fold(_digits, kernel.QUATTRO, 2)} AS seq FROM part",
    )
_KIND = "CASE WHEN n < 0 THEN 'INT_64' WHEN n < 16 THEN 'HALF_BYTE' WHEN n < 256 THEN 'BYTE' WHEN n < 65536 THEN 'SHORT' WHEN n < 4294967296 THEN 'INT_32' ELSE 'INT_64' END"
_named("pack_kind", lambda s, d: table(s, d, "orders").select("o_orderkey", codecs.packed_kind(F.col("o_orderkey") * 97).alias("kind")), f"SELECT o_orderkey, {_KIND} AS kind FROM (SELECT o_orderkey, o_orderkey * 97 AS n FROM orders)")
_SIZE = "CASE WHEN {0} < 16 THEN 3 WHEN {0} < 256 THEN 5 WHEN {0} < 65536 THEN 9 WHEN {0} < 4294967296 THEN 18 ELSE 34 END"
_named("pack_unpack", lambda s, d: table(s, d, "orders").select("o_orderkey", F.concat(codecs.pack_minimal("o_orderkey"), codecs.pack_minimal("o_custkey")).alias("p")).select("o_orderkey", F.length("p").alias("bases"), codecs.unpack_all("p").alias("n")), f"SELECT o_orderkey, {_SIZE.format('o_orderkey')} + {_SIZE.format('o_custkey')} AS bases, [o_orderkey, o_custkey] AS n FROM orders")
_named("pack_size", lambda s, d: table(s, d, "orders").select("o_orderkey", codecs.packed_size(codecs.pack_minimal("o_orderkey")).alias("bases")), f"SELECT o_orderkey, CASE {_KIND} WHEN 'HALF_BYTE' THEN 3 WHEN 'BYTE' THEN 5 WHEN 'SHORT' THEN 9 WHEN 'INT_32' THEN 18 ELSE 34 END AS bases FROM (SELECT o_orderkey, o_orderkey AS n FROM orders)")

# --- similarity index
_CODES = f"list_distinct([list_sum([(instr('ACGT', substr(seq, i + j, 1)) - 1) * (4 ** j)::BIGINT for j in range(0, {LSH.k})])::BIGINT for i in range(1, length(seq) - {LSH.k - 2})])"
_SIG = "[" + ", ".join(f"list_min([(({a} * x + {b}) % {LSH.p}) % {LSH.m} for x in codes])" for a, b in LSH.functions) + "]"
_INDEX = f"c AS (SELECT id, {_CODES} AS codes FROM s WHERE length(seq) >= {LSH.k}), g AS (SELECT id, codes, {_SIG} AS sig FROM c), x AS (SELECT id, b AS band, sig[(2 * b + 1):(2 * b + 2)] AS sig FROM (SELECT id, sig, unnest(range(0, 3)) AS b FROM g))"
_PROBES = "pr AS (SELECT * FROM x WHERE id % 100 = 0)"


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.index(strands(spark, sf_dir, "cust"), "id", "seq", LSH)


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stated set of searches: every hundredth strand."""
    return strands(spark, sf_dir, "cust").where("id % 100 = 0")


_WITH = f"WITH {sql_strands('cust')}, {_INDEX}, {_PROBES}"
_named("minhash_signature", lambda s, d: strands(s, d, "cust").select("id", minhash.signature("seq", LSH).alias("sig")), f"{_WITH} SELECT id, sig FROM g")
_named("lsh_index", lambda s, d: _index(s, d).select(F.col("band").cast("long"), "sig", "key"), f"{_WITH} SELECT band, sig, id AS key FROM x")
_named("lsh_buckets", lambda s, d: _index(s, d).groupBy("band", "sig").agg(F.count("*").alias("n")).withColumn("band", F.col("band").cast("long")), f"{_WITH} SELECT band, sig, count(*) AS n FROM x GROUP BY ALL")
_named("lsh_candidates", lambda s, d: lsh.candidates(_index(s, d), minhash.index(_probes(s, d), "id", "seq", LSH)), f"{_WITH} SELECT DISTINCT pr.id AS probe, x.id AS key FROM pr JOIN x USING (band, sig)")
_named("lsh_candidates_band", lambda s, d: lsh.candidates(_index(s, d), minhash.index(_probes(s, d), "id", "seq", LSH), 1), f"{_WITH} SELECT DISTINCT pr.id AS probe, x.id AS key FROM pr JOIN x USING (band, sig) WHERE band = 1")
_PARTS_PROBE = f"WITH {sql_strands('cust')}, {_INDEX}, s2 AS (SELECT p_partkey AS id, {sql_encode('p_name')} AS seq FROM part), c2 AS (SELECT id, {_CODES} AS codes FROM s2 WHERE length(seq) >= {LSH.k}), g2 AS (SELECT id, {_SIG} AS sig FROM c2), x2 AS (SELECT id, b AS band, sig[(2 * b + 1):(2 * b + 2)] AS sig FROM (SELECT id, sig, unnest(range(0, 3)) AS b FROM g2)), h AS (SELECT x2.id, x2.band, count(x.id) > 0 AS hit FROM x2 LEFT JOIN x USING (band, sig) GROUP BY ALL)"
_named("lsh_query_or", lambda s, d: lsh.query(_index(s, d), minhash.index(strands(s, d, "part"), "id", "seq", LSH)), f"{_PARTS_PROBE} SELECT id AS probe, bool_or(hit) AS found FROM h GROUP BY id")
_named("lsh_query_and", lambda s, d: lsh.query(_index(s, d), minhash.index(strands(s, d, "part"), "id", "seq", LSH), True), f"{_PARTS_PROBE} SELECT id AS probe, bool_and(hit) AS found FROM h GROUP BY id")
_named("lsh_query_exact", lambda s, d: (lambda p: lsh.query_exact(_index(s, d), strands(s, d, "cust"), p.unionByName(p.select((-F.col("id") - 1).alias("id"), F.concat("seq", F.lit("A")).alias("seq"))), LSH))(_probes(s, d)), f"{_WITH} SELECT id AS probe, true AS found FROM s WHERE id % 100 = 0 UNION ALL SELECT -id - 1, false FROM s WHERE id % 100 = 0")
_named("lsh_remove", lambda s, d: lsh.remove(_index(s, d), table(s, d, "orders").select(F.col("o_custkey").alias("key")).distinct()).select("key").distinct(), f"{_WITH} SELECT DISTINCT id AS key FROM x WHERE id NOT IN (SELECT o_custkey FROM orders)")
_named(
    "lsh_least_distance",
    lambda s, d: lsh.least_distance(_index(s, d), strands(s, d, "cust"), _probes(s, d), LSH).withColumn("distance", F.round("distance", 6)),
    f"{_WITH}, k AS (SELECT DISTINCT pr.id AS probe, x.id AS key FROM pr JOIN x USING (band, sig) WHERE pr.id <> x.id), dd AS (SELECT probe, min(1 - len(list_intersect(a.codes, b.codes)) / len(list_distinct(list_concat(a.codes, b.codes)))) AS v FROM k JOIN c a ON a.id = probe JOIN c b ON b.id = key GROUP BY probe) SELECT s.id AS probe, round(coalesce(v, 1.0), 6)::DOUBLE AS distance FROM s LEFT JOIN dd ON probe = s.id WHERE s.id % 100 = 0",
)
_FPP = 0.01
_HASHES = minhash.Bloom.sized(1000, _FPP).functions


def _sql_positions(x: str) -> str:
    """Bits of x in the filter of b.bits bits."""
    return "[" + ", ".join(f"(({x} & 2147483647)::HUGEINT * {a} + ({x} >> 31)::HUGEINT * {c} + {b}) % b.bits" for a, b, c in _HASHES) + "]"


def _sql_bits(source: str) -> str:
    return f"b AS (SELECT ceil(-n * ln({_FPP}) / (ln(2.0) * ln(2.0)))::BIGINT AS bits FROM (SELECT count(*) AS n FROM {source}))"


def _customer_filter(spark: SparkSession, sf_dir: str) -> tuple[minhash.Bloom, DataFrame]:
    keys = table(spark, sf_dir, "customer").select("c_custkey")
    bloom = minhash.Bloom.sized(keys.count(), _FPP)
    return bloom, bloom.build(keys, "c_custkey")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that are there, and others far off."""
    return table(spark, sf_dir, "customer").select(F.explode(F.array(F.col("c_custkey"), F.col("c_custkey") * 1_000_003 + (1 << 40))).alias("key"))


_FILTER = f"{_sql_bits('customer')}, f AS (SELECT DISTINCT unnest({_sql_positions('c_custkey')}) AS bit FROM customer, b)"
_named("bloom_contains", lambda s, d: (lambda bf: bf[0].might_contain(_asked(s, d), "key", bf[1], "key"))(_customer_filter(s, d)), f"WITH {_FILTER}, k AS (SELECT unnest([c_custkey, c_custkey * 1000003 + 1099511627776]) AS key FROM customer), p AS (SELECT key, unnest({_sql_positions('key')}) AS bit FROM k, b) SELECT key, count(f.bit) = count(*) AS maybe FROM p LEFT JOIN f USING (bit) GROUP BY key")
_named("bloom_bits_set", lambda s, d: _customer_filter(s, d)[1], f"WITH {_FILTER} SELECT bit::BIGINT AS bit FROM f")
_named("bloom_sizes", lambda s, d: table(s, d, "nation").select("n_nationkey", minhash.bloom_bits_column((F.col("n_nationkey") + 1) * 1000, 0.01).alias("bits")), "SELECT n_nationkey, ceil(-(n_nationkey + 1) * 1000 * ln(0.01) / (ln(2.0) * ln(2.0)))::BIGINT AS bits FROM nation")
_named("bloom_fpp", lambda s, d: table(s, d, "nation").select("n_nationkey", F.round(minhash.bloom_fpp_column(7, F.lit(100_000), (F.col("n_nationkey") + 1) * 1000), 9).alias("fpp")), "SELECT n_nationkey, round(pow(1 - exp(-7 * (n_nationkey + 1) * 1000 / 100000), 7), 9) AS fpp FROM nation")
_BAND_KEY = "list_reduce(list_prepend(0::BIGINT, sig), lambda a, x: a * " + str(LSH.m) + " + x)"
_BAND_BITS = f"{_sql_bits('x')}, f AS (SELECT DISTINCT band, unnest({_sql_positions(_BAND_KEY)}) AS bit FROM x, b), h AS (SELECT id, p.band, count(f.bit) = count(*) AS hit FROM (SELECT id, band, unnest({_sql_positions(_BAND_KEY)}) AS bit FROM x2, b) p LEFT JOIN f ON f.band = p.band AND f.bit = p.bit GROUP BY ALL)"


def _bloom_lsh(spark: SparkSession, sf_dir: str, every: bool) -> DataFrame:
    """Equal names have equal strands: each is encoded, hashed and asked for once."""
    names, asked = texts(spark, sf_dir, "cust"), texts(spark, sf_dir, "part")
    bloom = minhash.Bloom.sized(names.where(F.octet_length("text") * 4 >= LSH.k).count() * LSH.b, _FPP)
    index = lambda t: minhash.index(encoded(t.select("text").distinct(), "text"), "id", "seq", LSH)
    hits = lsh.bloom_hits(lsh.bloom_store(index(names), LSH, bloom), index(asked), LSH, bloom)
    return lsh.hits_of(asked.join(hits.withColumnRenamed("probe", "text"), "text").withColumnRenamed("id", "probe"), LSH, every)


_BLOOM_PROBE = _PARTS_PROBE[: _PARTS_PROBE.index(", h AS")] + f", {_BAND_BITS}"
_named("lsh_bloom_or", lambda s, d: _bloom_lsh(s, d, False), f"{_BLOOM_PROBE} SELECT id AS probe, bool_or(hit) AS found FROM h GROUP BY id")
_named("lsh_bloom_and", lambda s, d: _bloom_lsh(s, d, True), f"{_BLOOM_PROBE} SELECT id AS probe, bool_and(hit) AS found FROM h GROUP BY id")
_named(
    "lsh_least_distance_where",
    lambda s, d: lsh.least_distance(_index(s, d), strands(s, d, "cust"), _probes(s, d), LSH, among=F.col("key") % 7 == 3).withColumn("distance", F.round("distance", 6)),
    f"{_WITH}, k AS (SELECT DISTINCT pr.id AS probe, x.id AS key FROM pr JOIN x USING (band, sig) WHERE pr.id <> x.id AND x.id % 7 = 3), dd AS (SELECT probe, min(1 - len(list_intersect(a.codes, b.codes)) / len(list_distinct(list_concat(a.codes, b.codes)))) AS v FROM k JOIN c a ON a.id = probe JOIN c b ON b.id = key GROUP BY probe) SELECT s.id AS probe, round(coalesce(v, 1.0), 6)::DOUBLE AS distance FROM s LEFT JOIN dd ON probe = s.id WHERE s.id % 100 = 0",
)
_M64, _H63 = "18446744073709551616::HUGEINT", "9223372036854775808::HUGEINT"


def _sql_wrap(x: str) -> str:
    return f"(((({x}) % {_M64}) + {_M64} + {_H63}) % {_M64} - {_H63})::BIGINT"


def _sql_sig_hash(values: list[str]) -> str:
    """CTEs h0, h1, ... over g (r_regionkey), the last one with the hash as h."""
    steps = ["h0 AS (SELECT r_regionkey, 2166136261::BIGINT AS h FROM region)"]
    add = lambda x: steps.append(f"h{len(steps)} AS (SELECT r_regionkey, {x} AS h FROM h{len(steps) - 1})")
    for v in values:
        add(_sql_wrap(f"xor(h, ({v})::BIGINT)::HUGEINT * 16777619"))
    for shift, right in ((13, 7), (3, 17), (5, 0)):
        add(_sql_wrap(f"h::HUGEINT + {_sql_wrap(f'h::HUGEINT * {1 << shift}')}::HUGEINT"))
        if right:
            add(f"xor(h, ((h::HUGEINT - ((h::HUGEINT % {1 << right}) + {1 << right}) % {1 << right}) // {1 << right})::BIGINT)")
    return f"WITH {', '.join(steps)} SELECT r_regionkey, h FROM h{len(steps) - 1}"


_named("sig_hash", lambda s, d: table(s, d, "region").select("r_regionkey", codecs.sig_hash(F.array(F.col("r_regionkey").cast("long"), F.lit(2), F.col("r_regionkey") * 77 + 5, F.lit(4)).cast("array<long>")).alias("h")), _sql_sig_hash(["r_regionkey", "2", "r_regionkey * 77 + 5", "4"]))


# --- containers
def _customers(spark: SparkSession, sf_dir: str) -> container.Table:
    return container.Table(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("value")))


def _ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.max("o_orderpriority").alias("value"))


_ORDERED = "o AS (SELECT o_custkey AS key, max(o_orderpriority) AS value FROM orders GROUP BY 1)"
_named("container_put", lambda s, d: _customers(s, d).put(_ordered(s, d)).rows, f"WITH {_ORDERED} SELECT c_custkey AS key, c_name AS value FROM customer WHERE c_custkey NOT IN (SELECT key FROM o) UNION ALL SELECT * FROM o")
_named("container_get", lambda s, d: _customers(s, d).get(table(s, d, "supplier").select((F.col("s_suppkey") * 20).alias("key"))), "SELECT s_suppkey * 20 AS key, c_name AS value FROM supplier LEFT JOIN customer ON c_custkey = s_suppkey * 20")
_named("container_remove", lambda s, d: _customers(s, d).remove(_ordered(s, d)).rows, f"WITH {_ORDERED} SELECT c_custkey AS key, c_name AS value FROM customer WHERE c_custkey NOT IN (SELECT key FROM o)")
_named("container_removed", lambda s, d: _customers(s, d).removed(table(s, d, "supplier").select((F.col("s_suppkey") * 20).alias("key"))), "SELECT s_suppkey * 20 AS key, c_custkey IS NOT NULL AS removed FROM supplier LEFT JOIN customer ON c_custkey = s_suppkey * 20")
_named("container_contains", lambda s, d: _customers(s, d).contains(table(s, d, "supplier").select((F.col("s_suppkey") * 20).alias("key"))), "SELECT s_suppkey * 20 AS key FROM supplier WHERE s_suppkey * 20 IN (SELECT c_custkey FROM customer)")
_named("container_size", lambda s, d: _customers(s, d).size(), "SELECT count(*) AS size FROM customer")
_named("container_keys", lambda s, d: _customers(s, d).keys(), "SELECT c_custkey AS key FROM customer")
_named("container_values", lambda s, d: _customers(s, d).values(), "SELECT c_name AS value FROM customer")
_named("container_discard", lambda s, d: _customers(s, d).discard().rows, "SELECT c_custkey AS key, c_name AS value FROM customer WHERE false")
_named("container_mapped", lambda s, d: _customers(s, d).discard().mapped(q.encode_2bit, q.decode_2bit).put(_customers(s, d).rows).inner.rows, f"SELECT c_custkey AS key, {sql_encode('c_name')} AS value FROM customer")
_named("container_dense_ids", lambda s, d: container.with_dense_ids(table(s, d, "customer").select("c_name"), ["c_name"]), "SELECT c_name, row_number() OVER (ORDER BY c_name) - 1 AS id FROM customer")


# --- strand storage
LAYOUT = oligos.Layout(address=80, payload=150, permutations=4)


def _store(spark: SparkSession, sf_dir: str) -> oligos.Store:
    return oligos.put(strands(spark, sf_dir, "item"), LAYOUT)


def _stored(spark: SparkSession, sf_dir: str) -> oligos.Store:
    """The store with its tables written once, for queries that read them several times."""
    return oligos.written(_store(spark, sf_dir))


_ROOM = LAYOUT.room
_named("store_objects", lambda s, d: _store(s, d).objects, f"WITH {sql_strands('item')} SELECT id, greatest(1, ceil((length(seq) + 43) / {_ROOM}))::INTEGER AS n_segments, length(seq)::INTEGER AS length FROM s")
_named("store_round_trip", lambda s, d: (lambda st: oligos.get(st, strands(s, d, "item").select("id")).join(oligos.addressed(st, strands(s, d, "item").select("id")).groupBy("id").agg(F.count("*").cast("int").alias("segments"), F.max(F.length("payload")).alias("bases")), "id"))(_stored(s, d)), f"WITH {sql_strands('item')} SELECT id, greatest(1, ceil((length(seq) + 43) / {_ROOM}))::INTEGER AS segments, 150 AS bases, seq FROM s")
_named("store_oligos", lambda s, d: oligos.joined(_store(s, d)).select("routed", F.length("oligo").alias("bases")), f"WITH {sql_strands('item')}, n AS (SELECT sum(greatest(1, ceil((length(seq) + 43) / {_ROOM})))::BIGINT AS n FROM s) SELECT unnest(range(0, n)) AS routed, 230 AS bases FROM n")
_named("store_remove", lambda s, d: oligos.remove(_stored(s, d), table(s, d, "region").select(F.col("r_regionkey").cast("long").alias("id"))).oligos.agg(F.count("*").alias("n")), f"WITH {sql_strands('item')} SELECT sum(greatest(1, ceil((length(seq) + 43) / {_ROOM})))::BIGINT AS n FROM s WHERE id NOT IN (SELECT r_regionkey FROM region)")


# --- addresses
def _addresses(spark: SparkSession, sf_dir: str) -> addressing.Addresses:
    nations = table(spark, sf_dir, "nation")
    return addressing.Addresses(
        nations.select(F.col("n_nationkey").alias("original"), F.col("n_regionkey").alias("routed")), table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("routed"), q.encode_2bit("r_name").alias("barcode"))
    )


_ADDR = f"r AS (SELECT n_nationkey AS original, n_regionkey AS routed FROM nation), t AS (SELECT r_regionkey AS routed, {sql_encode('r_name')} AS barcode FROM region)"
_named("address_translate", lambda s, d: _addresses(s, d).route_and_translate(table(s, d, "customer").select(F.col("c_nationkey").alias("original"))), f"WITH {_ADDR} SELECT c_nationkey AS original, routed, barcode FROM customer LEFT JOIN r ON original = c_nationkey LEFT JOIN t USING (routed)")
_named("address_missing", lambda s, d: _addresses(s, d).missing(table(s, d, "part").select(F.col("p_size").alias("original")).distinct()), "SELECT DISTINCT p_size AS original FROM part WHERE p_size NOT IN (SELECT n_nationkey FROM nation)")
_named("address_reroute", lambda s, d: _addresses(s, d).reroute(table(s, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("original"), F.lit(0).alias("routed"))).routing, "SELECT n_nationkey AS original, CASE WHEN n_regionkey = 1 THEN 0 ELSE n_regionkey END AS routed FROM nation")
_named("address_remove", lambda s, d: _addresses(s, d).remove(table(s, d, "nation").where("n_regionkey = 2").select(F.col("n_nationkey").alias("original"))).translation.select("routed"), "SELECT r_regionkey AS routed FROM region WHERE r_regionkey <> 2")
_named("address_barcodes", lambda s, d: addressing.assign_barcodes(s, 100))


# --- collections
def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collections.put_array(table(spark, sf_dir, "lineitem").withColumn("v", F.col("l_partkey").cast("string")), "l_orderkey", ["l_linenumber", "l_partkey"], "v")


_LINES = "a AS (SELECT l_orderkey AS collection_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1)::INTEGER AS pos, l_partkey::VARCHAR AS value FROM lineitem)"
_named("array_put", _lines, f"WITH {_LINES} SELECT * FROM a")
_named("array_get", lambda s, d: collections.get(_lines(s, d), 2), f"WITH {_LINES} SELECT * FROM a WHERE pos = 2")
_named("array_length", lambda s, d: collections.length(_lines(s, d)), f"WITH {_LINES} SELECT collection_id, max(pos) + 1 AS length FROM a GROUP BY 1")
_named("array_slice", lambda s, d: collections.slice_(_lines(s, d), 1, 3), f"WITH {_LINES} SELECT * FROM a WHERE pos BETWEEN 1 AND 2")
_named("array_reversed_slice", lambda s, d: collections.reversed_slice(_lines(s, d), 3, 0), f"WITH {_LINES} SELECT *, row_number() OVER (PARTITION BY collection_id ORDER BY pos DESC)::INTEGER AS rank FROM a WHERE pos BETWEEN 1 AND 3")
_named("array_decoded", lambda s, d: collections.decoded(_lines(s, d)), f"WITH {_LINES} SELECT collection_id, list(value ORDER BY pos) AS items FROM a GROUP BY 1")
_MORE = "m AS (SELECT o_orderkey AS collection_id, o_orderpriority AS value FROM orders)"
_named("list_append", lambda s, d: collections.append(_lines(s, d), table(s, d, "orders").select(F.col("o_orderkey").alias("collection_id"), F.lit(0).alias("ord"), F.col("o_orderpriority").alias("value"))), f"WITH {_LINES}, {_MORE}, n AS (SELECT collection_id, max(pos) AS last FROM a GROUP BY 1) SELECT * FROM a UNION ALL SELECT m.collection_id, coalesce(last, -1) + 1, m.value FROM m LEFT JOIN n USING (collection_id)")
_named("list_insert", lambda s, d: collections.insert(_lines(s, d), 1, table(s, d, "orders").select(F.col("o_orderkey").alias("collection_id"), F.col("o_orderpriority").alias("value"))), f"WITH {_LINES}, {_MORE}, n AS (SELECT collection_id, max(pos) + 1 AS len FROM a GROUP BY 1) SELECT a.collection_id, CASE WHEN m.value IS NOT NULL AND pos >= 1 THEN pos + 1 ELSE pos END AS pos, a.value FROM a LEFT JOIN m USING (collection_id) UNION ALL SELECT m.collection_id, least(1, coalesce(len, 0)), m.value FROM m LEFT JOIN n USING (collection_id)")
_named("list_chain", lambda s, d: collections.chained(_lines(s, d), "value"), f"WITH {_LINES} SELECT collection_id, value AS node, lead(value) OVER (PARTITION BY collection_id ORDER BY pos) AS next, pos = 0 AS head, value FROM a")
_named("list_walk", lambda s, d: collections.walk(collections.chained(table(s, d, "customer").select(F.col("c_nationkey").alias("collection_id"), "c_custkey", F.col("c_name").alias("value")).withColumn("pos", F.expr("row_number() over (partition by collection_id order by c_custkey) - 1")), "c_custkey")), "SELECT c_nationkey AS collection_id, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1)::INTEGER AS pos, c_name AS value FROM customer")


# --- sources and utilities
def _csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    line = F.concat_ws(",", F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority", F.lit(""))
    return delimited.parse(o.select(line.alias("value")), ["key", "status", "priority", "rest"])


_named("csv_cells", lambda s, d: _csv(s, d), "SELECT o_orderkey || ',' || o_orderstatus || ',' || o_orderpriority || ',' AS line, o_orderkey::VARCHAR AS key, o_orderstatus AS status, o_orderpriority AS priority, NULL::VARCHAR AS rest FROM orders")
_named("csv_render", lambda s, d: (lambda t: t.select("key", delimited.render(t, ["status", "priority"]).alias("line")))(_csv(s, d)), "SELECT o_orderkey::VARCHAR AS key, 'status: ' || o_orderstatus || ', priority: ' || o_orderpriority AS line FROM orders")
_named("util_zip", lambda s, d: table(s, d, "nation").select("n_nationkey", F.transform(util.zip_outer(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.split("n_name", "")), lambda z: F.concat(F.coalesce(z["x"], F.lit("-")), F.coalesce(z["y"], F.lit("-")))).alias("z")), "SELECT n_nationkey, [coalesce(z[1], '-') || coalesce(z[2], '-') for z in list_zip(['a', 'b', 'c'], string_split(n_name, ''))] AS z FROM nation")
_named("util_enumerate", lambda s, d: table(s, d, "region").select("r_regionkey", util.enumerated(F.split("r_name", "")).alias("i", "ch")), "SELECT r_regionkey, (generate_subscripts(x, 1) - 1)::INTEGER AS i, unnest(x) AS ch FROM (SELECT r_regionkey, string_split(r_name, '') AS x FROM region)")
_named("util_parse_number", lambda s, d: table(s, d, "customer").select("c_custkey", util.parse_number("c_name").alias("n"), util.parse_number("c_mktsegment").alias("none")), r"SELECT c_custkey, regexp_extract(c_name, '(\d+)', 1)::BIGINT AS n, NULL::BIGINT AS none FROM customer")
_named("util_shuffle", lambda s, d: table(s, d, "nation").select("n_nationkey", F.array_sort(util.shuffled(F.split("n_name", ""), 3)).alias("chars")), "SELECT n_nationkey, list_sort(string_split(n_name, '')) AS chars FROM nation")
_named("store_referenced", lambda s, d: oligos.referenced(_stored(s, d), strands(s, d, "item").select("id")).select("id", "size", F.forall("oligos", lambda x: F.length(x) == 230).alias("whole")), f"WITH {sql_strands('item')} SELECT id, greatest(1, ceil((length(seq) + 43) / {_ROOM}))::INTEGER AS size, true AS whole FROM s")
_named("store_raw_oligos", lambda s, d: (lambda st: oligos.assemble_raw(oligos.addressed(st, strands(s, d, "item").select("id")).select("id", "seg", F.concat("address", "payload").alias("oligo")), LAYOUT))(_stored(s, d)), f"WITH {sql_strands('item')} SELECT id, seq FROM s")
_named("store_header", lambda s, d: (lambda st: oligos.addressed(st, strands(s, d, "item").select("id")).where("seg = 0").select("id", codecs.unpack_all(F.substring(codecs.unpad(codecs.undo_permutation("payload"), kernel.SEGMENT_DELIMITER), 35, 9)).alias("more")))(_stored(s, d)), f"WITH {sql_strands('item')} SELECT id, [greatest(1, ceil((length(seq) + 43) / {_ROOM}))::BIGINT - 1] AS more FROM s")
_named("bitmap_count", lambda s, d: minhash.bitmap(table(s, d, "orders").select((F.col("o_custkey") + 1).alias("k")), "k").agg(F.sum(F.bitmap_count("bits")).alias("n")), "SELECT count(DISTINCT o_custkey) AS n FROM orders")
_named("container_next_id", lambda s, d: container.next_id(table(s, d, "customer"), "c_custkey"), "SELECT max(c_custkey) + 1 AS next FROM customer")
_named("container_reserve", lambda s, d: container.reserve(table(s, d, "customer"), 5, "c_custkey"), "SELECT unnest(range(n, n + 5)) AS id FROM (SELECT max(c_custkey) + 1 AS n FROM customer)")
_named("container_put_repeats", lambda s, d: _customers(s, d).put(table(s, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("value"))).rows, f"WITH {_ORDERED} SELECT c_custkey AS key, c_name AS value FROM customer WHERE c_custkey NOT IN (SELECT key FROM o) UNION ALL SELECT * FROM o")
_named("container_ids_with_gaps", lambda s, d: container.by_every_id(_customers(s, d).rows), "SELECT r.id, c_name AS value FROM (SELECT unnest(range(0, (SELECT max(c_custkey) + 1 FROM customer))) AS id) r LEFT JOIN customer ON c_custkey = r.id")
_named("array_absent", lambda s, d: collections.absent(table(s, d, "orders").select(F.col("o_orderkey").alias("collection_id")), _lines(s, d)), "SELECT o_orderkey AS collection_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
_named("list_next_ids", lambda s, d: collections.chained(_lines(s, d), "pos").where("next IS NULL").select("collection_id", F.col("node").alias("tail")), f"WITH {_LINES} SELECT collection_id, max(pos) AS tail FROM a GROUP BY 1")
_named("address_identity", lambda s, d: addressing.identity(table(s, d, "nation").select(F.col("n_nationkey").alias("original"))), "SELECT n_nationkey AS original, n_nationkey AS routed FROM nation")
_named("codec_composed", lambda s, d: table(s, d, "part").select("p_partkey", codecs.TWO_BIT.then(codecs.COMPLEMENT).encode(F.col("p_name")).alias("seq"), codecs.TWO_BIT.then(codecs.COMPLEMENT).reverse().encode(codecs.TWO_BIT.then(codecs.COMPLEMENT).encode(F.col("p_name"))).alias("back")), f"SELECT p_partkey, translate({sql_encode('p_name')}, 'ACGT', 'TGCA') AS seq, p_name AS back FROM part")


# --- files, records, addresses on write, further codecs and tools
def _csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders, and a row that equals the header, written as files and read again."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    rows = rows.unionByName(rows.sparkSession.createDataFrame([("key", "status", "priority")], rows.schema))
    path = scratch(spark)
    delimited.write(rows, path)
    return delimited.project(delimited.read(spark, path), ["line", "key", "status", "priority"])


_CSV = "SELECT o_orderkey::VARCHAR AS key, o_orderstatus AS status, o_orderpriority AS priority FROM orders UNION ALL SELECT 'key', 'status', 'priority'"
_named("csv_round_trip", _csv_round_trip, f"SELECT key || ',' || status || ',' || priority AS line, * FROM ({_CSV})")
_named("csv_at", lambda s, d: _csv(s, d).select("key", delimited.at("line", 1).alias("second"), delimited.at("line", 7).alias("eighth")), "SELECT o_orderkey::VARCHAR AS key, o_orderstatus AS second, NULL::VARCHAR AS eighth FROM orders")
_named("csv_one", lambda s, d: delimited.one(_csv(s, d)).agg(F.count("*").alias("n")), "SELECT 1::BIGINT AS n")

_PRICED = records.LONG.fuse(records.DOUBLE)
_named(
    "record_fused",
    lambda s, d: table(s, d, "orders").select("o_orderkey", _PRICED.encode()(F.struct(F.col("o_orderkey").alias("a"), F.col("o_totalprice").alias("b"))).alias("r")).select(
        "o_orderkey", F.hex(F.substring("r", 1, 8)).alias("head"), F.length("r").alias("bytes"), _PRICED.decode()(F.col("r"))["b"].alias("price")
    ),
    "SELECT o_orderkey, printf('%016X', o_orderkey) AS head, 16 AS bytes, o_totalprice AS price FROM orders",
)
_THREE = records.INT.repeated(3)
_named(
    "record_array",
    lambda s, d: table(s, d, "nation").select("n_nationkey", _THREE.encode()(F.array("n_nationkey", "n_regionkey", F.lit(70000))).alias("r")).select("n_nationkey", F.hex("r").alias("bytes"), _THREE.decode()(F.col("r")).alias("v")),
    "SELECT n_nationkey, printf('%08X%08X%08X', n_nationkey, n_regionkey, 70000) AS bytes, [n_nationkey, n_regionkey, 70000] AS v FROM nation",
)


def _record_store(spark: SparkSession, sf_dir: str) -> records.RecordStore:
    """Nations by their keys, those of region 1 replaced."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_regionkey").alias("value"))
    return records.RecordStore.open(spark, records.INT).put(nations).put(nations.where("value = 1").withColumn("value", F.lit(-7)))


_named("record_store_get", lambda s, d: _record_store(s, d).get(table(s, d, "supplier").select((F.col("s_suppkey") * 3).alias("key"))), "SELECT s_suppkey * 3 AS key, CASE n_regionkey WHEN 1 THEN -7 ELSE n_regionkey END AS value FROM supplier LEFT JOIN nation ON n_nationkey = s_suppkey * 3")
_named("record_store_size", lambda s, d: _record_store(s, d).size(), "SELECT count(*) AS size FROM nation")


def _originals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_size").alias("original")).distinct()


_COMPUTED = f"WITH {_ADDR}, o AS (SELECT DISTINCT p_size AS original FROM part WHERE p_size NOT IN (SELECT original FROM r)), n AS (SELECT original, 5 + row_number() OVER (ORDER BY original) - 1 AS routed FROM o)"
_named(
    "address_compute", lambda s, d: (lambda a: a.route_and_translate(_originals(s, d).unionByName(a.routing.select("original")).distinct()).select("original", F.col("routed").cast("long").alias("routed"), F.length("barcode").alias("bases")))(_addresses(s, d).compute(_originals(s, d))),
    f"{_COMPUTED} SELECT original, routed::BIGINT AS routed, length(barcode)::INTEGER AS bases FROM r JOIN t USING (routed) UNION ALL SELECT original, routed, 80 FROM n",
)
_named("address_put", lambda s, d: _addresses(s, d).put(table(s, d, "region").select(F.col("r_regionkey").alias("original"), (F.col("r_regionkey") + 90).alias("routed"), F.lit("ACGT").alias("barcode"))).route_and_translate(table(s, d, "nation").select(F.col("n_nationkey").alias("original"))), f"WITH {_ADDR} SELECT n_nationkey AS original, CASE WHEN n_nationkey < 5 THEN n_nationkey + 90 ELSE n_regionkey END AS routed, CASE WHEN n_nationkey < 5 THEN 'ACGT' ELSE barcode END AS barcode FROM nation LEFT JOIN t ON routed = n_regionkey")


def _managed(spark: SparkSession, sf_dir: str) -> addressing.Managed:
    """Region names under their barcodes."""
    names = table(spark, sf_dir, "region").select(q.encode_2bit("r_name").alias("key"), F.col("r_name").alias("value")).where("value <> 'ASIA'")
    return addressing.Managed(container.Table(names), _addresses(spark, sf_dir))


_named("address_managed_get", lambda s, d: _managed(s, d).get(table(s, d, "customer").select(F.col("c_nationkey").alias("original"))), "SELECT c_nationkey AS original, nullif(r_name, 'ASIA') AS value FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey")
_named("address_managed_put", lambda s, d: _managed(s, d).put(table(s, d, "nation").where("n_nationkey = 0").select(F.col("n_nationkey").alias("original"), F.lit("new").alias("value"))).get(table(s, d, "nation").select(F.col("n_nationkey").alias("original"))), "SELECT n_nationkey AS original, CASE WHEN n_regionkey = (SELECT n_regionkey FROM nation WHERE n_nationkey = 0) THEN 'new' ELSE nullif(r_name, 'ASIA') END AS value FROM nation JOIN region ON r_regionkey = n_regionkey")
_named("address_managed_keys", lambda s, d: _managed(s, d).keys(), "SELECT n_nationkey AS original FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name <> 'ASIA'")

_named("codec_utf16_decode", lambda s, d: spread(table(s, d, "documents").select("doc_id", "text")).select("doc_id", codecs.utf16_text(codecs.utf16_strand("text")).alias("text"), F.length(codecs.utf16_strand("text")).alias("bases")), "SELECT doc_id, text, (8 * length(text))::INTEGER AS bases FROM documents")
_named("codec_zero_permutation", lambda s, d: strands(s, d, "doc").select("id", codecs.zero_permutation("seq").alias("payload"), codecs.undo_zero_permutation(codecs.zero_permutation("seq")).alias("back")), f"WITH {sql_strands('doc')} SELECT id, CASE WHEN 2 * (length(seq) - length(translate(seq, 'GC', ''))) > length(seq) THEN 'TAT' ELSE 'GCG' END || seq AS payload, seq AS back FROM s")
_COUNTED = codecs.Asymmetric(q.encode_2bit, q.decode_2bit).then(codecs.COMPLEMENT).decoded(F.length)
_named("codec_asymmetric", lambda s, d: table(s, d, "part").select("p_partkey", _COUNTED.encode(F.col("p_name")).alias("seq"), _COUNTED.decode(_COUNTED.encode(F.col("p_name"))).alias("n")), f"SELECT p_partkey, translate({sql_encode('p_name')}, 'ACGT', 'TGCA') AS seq, length(p_name)::INTEGER AS n FROM part")
_named("codec_each", lambda s, d: table(s, d, "part").select("p_partkey", codecs.TWO_BIT.each().encode(F.array("p_name", "p_brand")).alias("seqs")), f"SELECT p_partkey, [{sql_encode('p_name')}, {sql_encode('p_brand')}] AS seqs FROM part")


def _huffman_of_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' names by the binary Huffman code of their own bytes; its total length is the least there is."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    freq = codecs.byte_counts(parts, "p_name")
    d = parts.select("p_partkey", codecs.huffman_encode("p_name", 2, freq).alias("digits"))
    return d.select("p_partkey", codecs.huffman_decode("digits", 2, freq).alias("back"), (F.length("digits") < 8 * F.length(F.hex("digits"))).alias("short"))


_named("codec_huffman_of_data", _huffman_of_data, "SELECT p_partkey, p_name AS back, true AS short FROM part")
_SIGNED = "o_orderkey * (CASE o_custkey % 2 WHEN 0 THEN 1 ELSE -1 END) % 70000"
_named(
    "pack_signed", lambda s, d: table(s, d, "orders").select("o_orderkey", F.expr(_SIGNED).alias("v")).select("o_orderkey", codecs.signed_kind("v").alias("kind"), F.length(codecs.pack_signed("v")).alias("bases"), codecs.unpack_all(codecs.pack_signed("v"), True).alias("back")),
    f"SELECT o_orderkey, CASE WHEN v BETWEEN -8 AND 7 THEN 'HALF_BYTE' WHEN v BETWEEN -128 AND 127 THEN 'BYTE' WHEN v BETWEEN -32768 AND 32767 THEN 'SHORT' ELSE 'INT_32' END AS kind, CASE WHEN v BETWEEN -8 AND 7 THEN 3 WHEN v BETWEEN -128 AND 127 THEN 5 WHEN v BETWEEN -32768 AND 32767 THEN 9 ELSE 18 END AS bases, [v] AS back FROM (SELECT o_orderkey, {_SIGNED} AS v FROM orders)",
)
_named("dist_edit_within", lambda s, d: sequences.pairs(s, d, "item").select("id", distance.edit_within("a", "b", 700).alias("v")), f"{sequences._pair_sql('item')} SELECT id, CASE WHEN levenshtein(a, b) <= 700 THEN levenshtein(a, b) ELSE -1 END::INTEGER AS v FROM p")
_B32 = "lpad(bin(o_orderkey), 32, '0')"
_named("bits_slice_set", lambda s, d: table(s, d, "orders").select("o_orderkey", bits.slice_(bits.of_number("o_orderkey", 32), 20, 30).alias("part"), bits.set_bit(bits.of_number("o_orderkey", 32), 5, True).alias("set")), f"SELECT o_orderkey, substr({_B32}, 21, 10) AS part, substr({_B32}, 1, 5) || '1' || substr({_B32}, 7) AS set FROM orders")
_named("bits_to_bytes", lambda s, d: table(s, d, "orders").select("o_orderkey", F.hex(bits.to_bytes(bits.of_number("o_orderkey", 32))).alias("bytes")), "SELECT o_orderkey, printf('%08X', o_orderkey) AS bytes FROM orders")
_named("util_hash", lambda s, d: table(s, d, "nation").select("n_nationkey", util.content_hash("n_nationkey", "n_name").alias("h")), "SELECT n_nationkey, md5(n_nationkey || '|' || n_name) AS h FROM nation")
_named("util_fallback", lambda s, d: table(s, d, "customer").select("c_custkey", util.try_or(F.col("c_mktsegment").try_cast("int"), F.lit(-1)).alias("tried"), util.unless(F.col("c_acctbal"), lambda x: x >= 0, F.lit(0.0)).alias("balance"), util.or_fail(F.col("c_name"), "no name").alias("name")), "SELECT c_custkey, -1 AS tried, CASE WHEN c_acctbal >= 0 THEN c_acctbal ELSE 0.0 END::DOUBLE AS balance, c_name AS name FROM customer")
_named("util_bytes", lambda s, d: table(s, d, "nation").select("n_nationkey", F.hex(util.bytes_of(F.array("n_nationkey", "n_regionkey", F.lit(-1)))).alias("bytes")), "SELECT n_nationkey, printf('%02X%02XFF', n_nationkey, n_regionkey) AS bytes FROM nation")
_named("util_clock_seed", lambda s, d: table(s, d, "events").select("event_id", util.clock_seed(F.col("ts").cast("timestamp")).alias("seed")), "SELECT event_id, epoch_us(ts) // 1000 AS seed FROM events")
_named("util_two_way", lambda s, d: (lambda m: m.put(table(s, d, "region").select((F.col("r_regionkey") + 100).alias("left"), F.col("r_name").alias("right"))).back(table(s, d, "nation").select(F.col("n_name").alias("right")).unionByName(table(s, d, "region").select(F.col("r_name").alias("right")))))(util.TwoWay(table(s, d, "nation").select(F.col("n_nationkey").alias("left"), F.col("n_name").alias("right")))), "SELECT n_name AS right, n_nationkey AS left FROM nation UNION ALL SELECT r_name, r_regionkey + 100 FROM region")
_named("util_spread", lambda s, d: util.spread_over(table(s, d, "nation"), True, 3).select(F.spark_partition_id().alias("p")).distinct().agg((F.count("*") <= 3).alias("few")), "SELECT true AS few")


# --- arrays and lists inside the store: nations by region, and a region without any
def _nation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = collections.put_array(table(spark, sf_dir, "nation").where("n_regionkey <> 4").select(F.col("n_regionkey").cast("long").alias("r"), "n_nationkey", "n_name"), "r", ["n_nationkey"], "n_name")
    return rows.select("collection_id", "pos", "value")


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("collection_id"))


def _lists(spark: SparkSession, sf_dir: str) -> stored.Collections:
    return stored.put_lists(_nation_rows(spark, sf_dir), _regions(spark, sf_dir), LAYOUT)


def _arrays(spark: SparkSession, sf_dir: str) -> stored.Collections:
    return stored.put_arrays(_nation_rows(spark, sf_dir), _regions(spark, sf_dir), LAYOUT)


def _region_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("collection_id"), F.lit(0).alias("ord"), F.col("r_name").alias("value"))


_NATIONS = "n AS (SELECT n_regionkey::BIGINT AS collection_id, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::INTEGER AS pos, n_name AS value FROM nation WHERE n_regionkey <> 4), c AS (SELECT r_regionkey::BIGINT AS collection_id, r_name, (SELECT count(*) FROM n WHERE n.collection_id = r_regionkey)::INTEGER AS len FROM region)"
_SEGMENTS = f"greatest(1, ceil(({{0}} + 43) / {_ROOM}))"
_named("store_array", lambda s, d: stored.get_arrays(_arrays(s, d), _regions(s, d)), f"WITH {_NATIONS} SELECT * FROM n")
_named("store_array_oligos", lambda s, d: stored.array_oligos(_arrays(s, d), _regions(s, d)).groupBy("collection_id").agg(F.count("*").alias("oligos")), f"WITH {_NATIONS} SELECT c.collection_id, (1 + (SELECT coalesce(sum({_SEGMENTS.format('4 * length(value)')}), 0) FROM n WHERE n.collection_id = c.collection_id))::BIGINT AS oligos FROM c")
_named("store_list", lambda s, d: stored.get_lists(_lists(s, d), _regions(s, d)), f"WITH {_NATIONS} SELECT * FROM n")
_named("store_list_oligos", lambda s, d: stored.list_oligos(_lists(s, d), _regions(s, d)).groupBy("collection_id").agg(F.count("*").alias("oligos")), f"WITH {_NATIONS} SELECT c.collection_id, (1 + (SELECT coalesce(sum({_SEGMENTS.format('34 + 4 * length(value)')}), 0) FROM n WHERE n.collection_id = c.collection_id))::BIGINT AS oligos FROM c")
_named("store_list_append", lambda s, d: stored.get_lists(stored.append(_lists(s, d), _region_names(s, d)), _regions(s, d)), f"WITH {_NATIONS} SELECT * FROM n UNION ALL SELECT collection_id, len, r_name FROM c")
_named("store_list_insert", lambda s, d: stored.get_lists(stored.insert(_lists(s, d), 1, _region_names(s, d).drop("ord")), _regions(s, d)), f"WITH {_NATIONS} SELECT collection_id, CASE WHEN pos >= 1 THEN pos + 1 ELSE pos END AS pos, value FROM n UNION ALL SELECT collection_id, least(1, len), r_name FROM c")


# --- similarity of whole documents: near copies are what the index is for. SQL over all k-mers of all texts takes too
# long, so these are tested against brute force on a small table.
DOC_LSH = minhash.Lsh(k=12, r=16, b=4)


def document_index(strands_: DataFrame) -> DataFrame:
    return minhash.index(strands_, "id", "seq", DOC_LSH)


def document_candidates(strands_: DataFrame) -> DataFrame:
    """(probe, key) of every hundredth document against all: those that share a bucket."""
    index = checkpoint(document_index(strands_))
    return lsh.candidates(index, index.where("key % 100 = 0")).where("probe <> key")


def document_distances(strands_: DataFrame) -> DataFrame:
    """(probe, key, distance) of ``document_candidates``; seq may be binary, see ``lsh.near``."""
    return lsh.near(strands_, F.col("id") % 100 == 0, DOC_LSH).withColumn("distance", F.round("distance", 9))


_named("lsh_document_index", lambda s, d: document_index(strands(s, d, "doc")))
_named("lsh_document_candidates", lambda s, d: document_candidates(strands(s, d, "doc")))
_named("lsh_document_distances", lambda s, d: document_distances(spread(texts(s, d, "doc")).select("id", F.encode("text", "UTF-8").alias("seq"))))
