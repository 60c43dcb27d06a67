"""Queries of bit strings, draws and distance-coded payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from helicase.functions import bits, codecs, draws, minhash
from helicase.functions import seq as q
from helicase.operators import payloads
from helicase.plans.base import query, sql_strands, strands, table

_LONG = "'011' || lpad(bin({0}), 64, '0')"
query(f"SELECT o_orderkey, {_LONG.format('o_orderkey')} AS b FROM orders", "bits_pack_long")(lambda s, d: table(s, d, "orders").select("o_orderkey", bits.pack_integer("o_orderkey", "LONG").alias("b")))
query(
    f"SELECT o_orderkey, CASE WHEN n < 128 THEN '000' || lpad(bin(n), 8, '0') WHEN n < 32768 THEN '001' || lpad(bin(n), 16, '0') WHEN n < 2147483648 THEN '010' || lpad(bin(n), 32, '0') ELSE {_LONG.format('n')} END AS b FROM (SELECT o_orderkey, o_orderkey * o_custkey AS n FROM orders)",
    "bits_pack_minimal",
)(lambda s, d: table(s, d, "orders").select("o_orderkey", bits.pack_minimal(F.col("o_orderkey") * F.col("o_custkey")).alias("b")))
_TEXT = "array_to_string([lpad(bin(('0x' || substr(hex(encode({0})), 2 * i + 1, 2))::INTEGER), 8, '0') for i in range(0, strlen({0}))], '')"
query(f"SELECT c_custkey, '110' || lpad(bin(strlen(c_name)), 8, '0') || {_TEXT.format('c_name')} AS b FROM customer", "bits_pack_text")(lambda s, d: table(s, d, "customer").select("c_custkey", bits.pack_text("c_name").alias("b")))
_MINIMAL = f"CASE WHEN {{0}} < 128 THEN '000' || lpad(bin({{0}}), 8, '0') WHEN {{0}} < 32768 THEN '001' || lpad(bin({{0}}), 16, '0') WHEN {{0}} < 2147483648 THEN '010' || lpad(bin({{0}}), 32, '0') ELSE {_LONG} END"
query(
    f"SELECT o_orderkey, {_MINIMAL.format('o_orderkey')} || '110' || lpad(bin(strlen(o_orderpriority)), 8, '0') || {_TEXT.format('o_orderpriority')} AS b, [o_orderkey::VARCHAR, o_orderpriority] AS v FROM orders", "bits_unpack"
)(lambda s, d: table(s, d, "orders").select("o_orderkey", F.concat(bits.pack_minimal("o_orderkey"), bits.pack_text("o_orderpriority")).alias("b")).select("o_orderkey", "b", bits.unpack_all("b").alias("v")))
query("SELECT s_suppkey, '101' AS tag, 67 AS bits, s_acctbal AS back FROM supplier", "bits_pack_real")(
    lambda s, d: table(s, d, "supplier").select("s_suppkey", "s_acctbal", bits.pack_real("s_acctbal").alias("b")).select("s_suppkey", F.substring("b", 1, 3).alias("tag"), F.length("b").alias("bits"), F.get(bits.unpack_all("b"), F.lit(0)).cast("double").alias("back"))
)
query("SELECT o_orderkey, lpad(bin(8 - length(b) % 8), 8, '0') || b || repeat('0', (8 - length(b) % 8)::BIGINT) AS padded, b AS back FROM (SELECT o_orderkey, bin(o_orderkey) AS b FROM orders)", "bits_padding")(
    lambda s, d: table(s, d, "orders").select("o_orderkey", bits.padded(F.bin("o_orderkey")).alias("padded"), bits.unpadded(bits.padded(F.bin("o_orderkey"))).alias("back"))
)
query("SELECT p_partkey, p_partkey AS n, overlay FROM (SELECT p_partkey, substr(lpad(bin(p_partkey), 32, '0'), 1, 3) || CASE substr(lpad(bin(p_partkey), 32, '0'), 4, 1) WHEN '1' THEN '0' ELSE '1' END || substr(lpad(bin(p_partkey), 32, '0'), 5) AS overlay FROM part)", "bits_flip")(
    lambda s, d: table(s, d, "part").select("p_partkey", bits.to_number(bits.of_number("p_partkey", 32)).alias("n"), bits.flip(bits.of_number("p_partkey", 32), 3).alias("overlay"))
)
query(None, "util_draws")(
    lambda s, d: table(s, d, "nation").select(
        "n_nationkey", draws.choose(1, 6, 1).alias("die"), draws.uniform(-1, 1, 2).alias("u"), draws.gaussian(3).alias("g"), draws.power_law(-2.5, 100.0, 4).alias("p"), draws.pick(F.array(F.lit("A"), F.lit("C")), 5).alias("base")
    )
)


@query(f"WITH {sql_strands('cust')} SELECT id, length(seq) + 3 AS bases, seq AS back FROM s", "payload_choose")
def payload_choose(spark, sf_dir):
    """Customers' payloads chosen against the parts' strands, and undone again."""
    lsh = minhash.Lsh(k=4, r=4, b=2)
    stored = strands(spark, sf_dir, "part")
    new = strands(spark, sf_dir, "cust").select("id", codecs.barcode("id", 60, 2).alias("address"), "seq")
    chosen = payloads.choose(new, minhash.index(stored, "id", "seq", lsh), stored.groupBy("seq").agg(F.min("id").alias("id")), lsh, count=4)
    return chosen.select("id", F.length("payload").alias("bases"), codecs.undo_permutation("payload").alias("back"))


query(f"WITH {sql_strands('doc')} SELECT id, substr(seq, 11) || substr(seq, 1, 10) AS seq FROM s", "seq_window_join")(
    lambda s, d: strands(s, d, "doc").select("id", q.join(q.sub_sequence("seq", 10, F.length("seq")), q.window("seq", 0, 10)).alias("seq"))
)
