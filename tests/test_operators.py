"""Containers, stores, addresses, sources and ingest on small fixtures."""

import struct

import pytest
from pyspark.sql import functions as F

from helicase.functions import distance, minhash, rules
from helicase.functions import seq as q
from helicase.operators import addressing, collections, container, oligos
from helicase.sources import config, delimited, records
from helicase.streaming import ingest


def one(spark, expr, **columns):
    df = spark.createDataFrame([tuple(columns.values())], list(columns))
    return df.select(expr.alias("v")).first()["v"]


def test_golden_distances(spark):
    assert round(one(spark, distance.hamming("a", "b"), a="ACGT", b="AGGTA"), 6) == 0.4
    assert round(one(spark, distance.jaccard("a", "b", 3), a="ACGTACGT", b="ACGTTCGT"), 9) == 0.714285714
    assert one(spark, distance.lcs("a", "b"), a="GGACGT", b="TTACGT") == 4
    assert one(spark, distance.edit("a", "b"), a="", b="") is None


def test_golden_sequences(spark):
    assert one(spark, q.base4("a"), a="GTA") == 14
    assert one(spark, q.seed("a"), a="ACGTACGTAA") == 32
    assert [one(spark, q.count_matches("a", "AT"), a=x) for x in ("ATATAT", "AT")] == [2, 0]
    assert one(spark, q.count_consecutive("a", "AT"), a="ATATATC") == 3
    assert one(spark, q.longest_homopolymer("a"), a="") == 1
    assert one(spark, q.kmers("a", 5), a="ACG") == []
    assert one(spark, q.split_every("a", 3), a="ACGTA") == ["ACG", "TA"]
    assert one(spark, q.long_run_starts("a", 2), a="AAACCGGGG") == [0, 5]


def test_bad_strands_raise(spark):
    with pytest.raises(Exception, match="not a base string"):
        one(spark, q.checked("a"), a="ACGX")


@pytest.mark.parametrize(("x", "want"), [(0.0, 0.0), (0.4, 0.466933489), (0.8, 0.790976763), (1.0, 0.878131509), (2.0, 0.993461251), (4.0, 0.999983668)])
def test_normalised_error(spark, x, want):
    assert one(spark, rules.normalized(F.col("x")), x=x) == pytest.approx(want, abs=1e-6)  # the golden values are single precision


def test_rules_registry():
    r = rules.Rules()
    r.put(rules.gc_error, "gc")
    assert list(r) == ["gc"]
    assert r.remove("gc") is rules.gc_error
    with pytest.raises(TypeError):
        rules.BASIC.put(rules.gc_error)


def test_primes():
    assert [minhash.Lsh(k=k).p for k in (4, 5, 6, 9)] == [257, 1031, 4099, 262147]
    with pytest.raises(ValueError, match="multiple"):
        minhash.Lsh(r=5, b=2)


def test_container(spark):
    t = container.Table(spark.createDataFrame([(1, "a"), (2, "b")], "key long, value string"))
    t = t.put(spark.createDataFrame([(2, "B"), (3, "c")], "key long, value string"))
    assert {tuple(r) for r in t.rows.collect()} == {(1, "a"), (2, "B"), (3, "c")}
    ask = spark.createDataFrame([(2,), (9,)], "key long")
    assert {tuple(r) for r in t.get(ask).collect()} == {(2, "B"), (9, None)}
    assert {tuple(r) for r in t.removed(ask).collect()} == {(2, True), (9, False)}
    assert t.remove(ask).size().first()[0] == 2
    view = t.discard().mapped(q.encode_2bit, q.decode_2bit).put(t.rows)
    assert view.get(ask.where("key = 2")).first()["value"] == "B"


def test_store_round_trip_and_removal(spark):
    layout = oligos.Layout(address=40, payload=90, permutations=2, gc_fix=4)
    values = spark.createDataFrame([(0, "ACGT" * 30), (1, ""), (2, "GATTACA")], "id long, seq string")
    store = oligos.put(values, layout)
    got = {r["id"]: r["seq"] for r in oligos.get(store, spark.createDataFrame([(0,), (1,), (2,), (7,)], "id long")).collect()}
    assert got == {0: "ACGT" * 30, 1: "", 2: "GATTACA", 7: None}
    n = store.oligos.count()
    segments = store.objects.where("id = 0").first()["n_segments"]
    assert segments > 1
    assert oligos.remove(store, spark.createDataFrame([(0,)], "id long")).oligos.count() == n - segments
    with pytest.raises(ValueError, match="too short"):
        oligos.Layout(payload=40)


def test_barcodes_keep_their_distance(spark):
    got = addressing.assign_barcodes(spark, 40, lsh=minhash.Lsh(k=5, r=5), least=0.3)
    rows = got.orderBy("original").collect()
    assert [r["original"] for r in rows] == list(range(40))
    assert all(len(r["barcode"]) == 80 for r in rows)
    assert addressing.near_pairs(got.select(F.col("original").alias("id"), F.col("barcode").alias("seq")), minhash.Lsh(k=5, r=5), 0.3).count() == 0


def test_lists(spark):
    rows = spark.createDataFrame([(1, 0, "hello world 1"), (1, 1, "hello world 2"), (1, 2, "hello world 3")], "collection_id long, pos int, value string")
    rows = collections.append(rows, spark.createDataFrame([(1, 0, "hello world 4")], "collection_id long, ord int, value string"))
    rows = collections.insert(rows, 0, spark.createDataFrame([(1, "hello new element!")], "collection_id long, value string"))
    assert collections.decoded(rows).first()["items"] == ["hello new element!", "hello world 1", "hello world 2", "hello world 3", "hello world 4"]
    with pytest.raises(ValueError, match="below 0"):
        collections.insert(rows, -1, rows)


def test_delimited(spark, tmp_path):
    (tmp_path / "t.csv").write_text("Year,a,b\n1990,x,y\n1991,z,\n")
    got = [tuple(r) for r in delimited.read(spark, str(tmp_path / "t.csv")).orderBy("Year").collect()]
    assert got == [("1990,x,y", "1990", "x", "y"), ("1991,z,", "1991", "z", None)]
    (tmp_path / "u.csv").write_text("a,a\n1,2\n")
    with pytest.raises(ValueError, match="repeat"):
        delimited.read(spark, str(tmp_path / "u.csv"))


def test_records(spark, tmp_path):
    (tmp_path / "r.bin").write_bytes(b"".join(struct.pack(">q", i * i) for i in range(5)))
    got = records.read(spark, str(tmp_path / "r.bin"), records.LONG)
    assert [r[0] for r in got.orderBy("key").select(records.LONG.decode()("data")).collect()] == [0, 1, 4, 9, 16]
    three = records.INT.repeated(3)
    df = spark.createDataFrame([([1, 2, 3],)], "v array<int>")
    assert df.select(three.decode()(three.encode()("v"))).first()[0] == [1, 2, 3]
    (tmp_path / "s.bin").write_bytes(b"12345")
    with pytest.raises(Exception, match="whole number"):
        records.read(spark, str(tmp_path / "s.bin"), records.LONG).collect()


def test_config():
    assert config.parse('# a comment\n{\n  "a": 1,\n # more\n "b": [2]\n}') == {"a": 1, "b": [2]}
    assert config.lsh_kind({"type": "bf"}) == config.lsh_kind({"type": "bloom"}) == "bloom"


def test_online_ingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"k": 1, "v": "hello world"}\n{"k": 2, "v": "hello"}\n')
    for i in range(2):
        stream = spark.readStream.schema("k long, v string").json(str(tmp_path / "in"))
        ingest.start(stream, "k", "v", str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
        (tmp_path / "in" / f"b{i}.json").write_text('{"k": %d, "v": "more"}\n' % (3 + i))
    back = spark.read.parquet(str(tmp_path / "out/strands")).select("id", q.decode_2bit("seq").alias("v"))
    assert {tuple(r) for r in back.select("id", "v").collect()} == {(1, "hello world"), (2, "hello"), (3, "more")}
    assert spark.read.parquet(str(tmp_path / "out/index")).count() > 0


def test_a_file_row_that_equals_the_header_stays(spark, tmp_path):
    for i, rows in enumerate((["a,b", "1,2", "a,b", "3,"], ["a,b", "5,6"])):
        (tmp_path / f"f{i}.csv").write_text("\n".join(rows) + "\n")
    got = delimited.read(spark, str(tmp_path))
    assert sorted(r["line"] for r in got.collect()) == ["1,2", "3,", "5,6", "a,b"]
    assert got.columns == ["line", "a", "b"]
    with pytest.raises(KeyError):
        delimited.project(got, ["c"])
    with pytest.raises(ValueError, match="repeat"):
        delimited.header("a,b,a")


def test_written_lines_are_read_back(spark, tmp_path):
    rows = [("k", 'say "x" \\ y', " b "), ("", "'", None)]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    delimited.write(df, str(tmp_path / "out"), ";")
    got = delimited.read(spark, str(tmp_path / "out"), ";").select("a", "b", "c")
    assert sorted(tuple(x or "" for x in r) for r in got.collect()) == sorted(tuple(x or "" for x in r) for r in rows)
    with pytest.raises(Exception, match="delimiter"):
        delimited.write(df, str(tmp_path / "bad"), "'")


def test_chains_of_any_length(spark):
    n = 300
    chain = spark.createDataFrame([(1, i, i + 1 if i < n - 1 else None, i == 0, f"v{i}") for i in range(n)] + [(2, 7, None, True, "only")], "collection_id long, node long, next long, head boolean, value string")
    got = sorted((r["collection_id"], r["pos"], r["value"]) for r in collections.walk(chain).collect())
    assert got == [(1, i, f"v{i}") for i in range(n)] + [(2, 0, "only")]
    ring = spark.createDataFrame([(1, 0, 1, True, "a"), (1, 1, 0, False, "b")], chain.schema)
    with pytest.raises(ValueError, match="itself"):
        collections.walk(ring)


def test_records_of_all_kinds(spark):
    fused = records.INT.fuse(records.DOUBLE)
    df = spark.createDataFrame([(1, 2.5), (-7, -0.0), (None, 1.0)], "a int, b double").select(F.struct("a", "b").alias("v"))
    got = df.select(fused.encode()(F.col("v")).alias("r")).select("r", fused.decode()(F.col("r")).alias("v")).collect()
    assert [r["r"] and bytes(r["r"]) for r in got] == [struct.pack(">id", 1, 2.5), struct.pack(">id", -7, -0.0), None]
    assert [(r["v"]["a"], r["v"]["b"]) for r in got[:2]] == [(1, 2.5), (-7, -0.0)]
    store = records.RecordStore.open(spark, records.LONG).put(spark.createDataFrame([(0, 10), (1, 20)], "key long, value long"))
    assert {tuple(r) for r in store.put(spark.createDataFrame([(1, 5), (2, 6)], "key long, value long")).get(spark.range(4).withColumnRenamed("id", "key")).collect()} == {(0, 10), (1, 5), (2, 6), (3, None)}
    with pytest.raises(IndexError):
        store.put(spark.createDataFrame([(9, 1)], "key long, value long"))
    with pytest.raises(NotImplementedError):
        store.remove(spark.range(1))


def test_barcodes_are_far_from_each_other(spark):
    """All pairs of the accepted ones, with complements; and why each rejected one was."""
    lsh = addressing.NEAR
    judged = addressing.candidates(spark, 150).collect()
    kmers = lambda s: {s[i : i + lsh.k] for i in range(len(s) - lsh.k + 1)}
    turned = str.maketrans("ACGT", "TGCA")
    far = lambda x, y: 1 - len(kmers(x) & kmers(y)) / len(kmers(x) | kmers(y))
    good = [r["seq"] for r in sorted(judged) if r["accepted"]]
    near = sum(min(far(x, y), far(x, y.translate(turned))) < 0.3 for i, x in enumerate(good) for y in good[:i])
    assert near == 0
    for r in judged:
        if not r["accepted"]:
            assert any(min(far(r["seq"], o["seq"]), far(r["seq"], o["seq"].translate(turned))) < 0.3 for o in judged if o["accepted"] and o["id"] < r["id"])
    made = addressing.assign_barcodes(spark, 100)
    assert made.count() == 100
    assert made.where(F.length("barcode") != 80).count() == 0
    assert addressing.bad_count(addressing.candidates(spark, 150)).first()["size"] == len(good)


def test_repeated_entries_are_put_once(spark):
    t = container.Table(spark.createDataFrame([(1, "a")], "key long, value string")).put(spark.createDataFrame([(2, "x"), (2, "y")], "key long, value string"))
    assert {tuple(r) for r in t.rows.collect()} == {(1, "a"), (2, "y")}


def test_dense_ids_over_many_partitions(spark):
    got = container.with_dense_ids(spark.range(1000).select((F.col("id") * 7 % 1000).alias("v")).repartition(13), ["v"], 5).collect()
    assert sorted((r["v"], r["id"]) for r in got) == [(i, i + 5) for i in range(1000)]
    assert container.with_dense_ids(spark.range(0), ["id"], name="n").count() == 0


def test_byte_frequencies_and_their_code():
    from helicase.functions import kernel

    freq = kernel.frequencies(["97=5", "98=2", "-61=1", ""])
    assert (freq[97], freq[98], freq[195], sum(freq)) == (5, 2, 1, 8)
    for bad in ("x", "300=1", "97=-1"):
        with pytest.raises(ValueError, match="."):
            kernel.frequencies([bad])
    codes = kernel.huffman(2, freq)
    assert len(codes[97]) < len(codes[98]) <= len(codes[195])
    assert kernel.huffman_decode(kernel.huffman_encode(b"abba\xc3", 2, freq), 2, freq) == b"abba\xc3"


def test_packets_are_all_screened():
    from helicase.functions import kernel

    data = bytes(range(256)) * 9 + b"\0" * 700
    strand = kernel.fountain_encode(data)
    assert kernel.fountain_decode(strand) == data
    assert kernel.longest_run(strand) <= 12


def test_lists_in_the_store(spark):
    """The list of three, appended to, inserted into at its start, in its middle and at its end, all by its oligos; an empty one; an array."""
    from helicase.operators import stored

    layout = oligos.Layout(address=80, payload=170, permutations=2)
    rows = spark.createDataFrame([(1, 0, "hello world 1"), (1, 1, "hello world 2"), (1, 2, "hello world 3")], "collection_id long, pos int, value string")
    keys = spark.createDataFrame([(1,), (2,)], "collection_id long")
    arrays = stored.put_arrays(rows, keys, layout)
    assert sorted(tuple(r) for r in stored.get_arrays(arrays, keys).collect()) == [(1, i, f"hello world {i + 1}") for i in range(3)]
    lists = stored.put_lists(rows, keys, layout)
    one = lambda k, v: spark.createDataFrame([(k, v)], "collection_id long, value string")
    lists = stored.append(lists, one(1, "hello world 4").withColumn("ord", F.lit(0)))
    lists = stored.insert(lists, 0, one(1, "hello new element!"))
    lists = stored.insert(lists, 2, one(1, "middle"))
    lists = stored.insert(lists, 99, one(2, "first"))
    lists = stored.append(lists, spark.createDataFrame([(2, 1, "third"), (2, 0, "second"), (1, 0, "last")], "collection_id long, ord int, value string"))
    got = {k: [v for _, _, v in sorted(tuple(r) for r in stored.get_lists(lists, keys).collect() if r["collection_id"] == k)] for k in (1, 2)}
    assert got == {1: ["hello new element!", "hello world 1", "middle", "hello world 2", "hello world 3", "hello world 4", "last"], 2: ["first", "second", "third"]}
