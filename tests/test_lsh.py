"""The similarity index on many equal strands: work follows the buckets, not the rows in them."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from helicase.functions import minhash
from helicase.operators import lsh, nearest

LSH = minhash.Lsh(k=5, r=6, b=3)


def ranks(s, k=5):
    return {sum("ACGT".index(b) << 2 * j for j, b in enumerate(s[i : i + k])) for i in range(len(s) - k + 1)}


def minima(s):
    return [min((a * x + b) % LSH.p % LSH.m for x in ranks(s)) for a, b in LSH.functions]


def buckets(s):
    sig = minima(s)
    return {(b, *sig[2 * b : 2 * b + 2]) for b in range(3)}


def test_minima_of_a_batch(monkeypatch):
    rnd = random.Random(3)
    rows = [None, "", "ACGT", "ACGTA", *("".join(rnd.choice("ACGT") for _ in range(rnd.randint(0, 90))) for _ in range(60)), "AAAAAA", None]
    for group in (1, 200, 1 << 19):  # strands hashed one by one, some together, all together
        monkeypatch.setattr(minhash, "GROUP", group)
        got = minhash.minima(rows, LSH)
        assert [g if g is None else g.tolist() for g in got] == [minima(s) if s is not None and len(s) >= 5 else None for s in rows]


def counted(spark):
    """A filter's class whose values are counted as they are hashed."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def tick(x):
        seen.add(1)
        return x

    class Counted(minhash.Bloom):
        def positions(self, x):
            return F.transform(F.array(tick(x)), super().positions)[0]

    return seen, Counted.sized(100, 0.01)


@pytest.mark.parametrize("every", [True, False])
def test_a_filter_is_asked_once_for_a_bucket(spark, every):
    entries = ["ACGTACCTGATTACAT", "TTGACCATGACCAGTA"]
    asked = [*entries, "GGGGGGGGGGGGG", entries[0][:9] + "GGGGGGG"]
    index = minhash.index(spark.createDataFrame([(i, entries[i % 2]) for i in range(300)], "id long, seq string"), "id", "seq", LSH)
    probes = minhash.index(spark.createDataFrame([(i, asked[i % 4]) for i in range(400)], "id long, seq string"), "id", "seq", LSH)
    seen, bloom = counted(spark)
    got = {r["probe"]: r["found"] for r in lsh.bloom_query(lsh.bloom_store(index, LSH, bloom), probes, LSH, bloom, every).collect()}
    assert seen.value <= 100  # 2 and 4 strands in 3 bands, not 300 and 400
    there = set().union(*map(buckets, entries))
    assert got == {i: (all if every else any)(x in there for x in buckets(asked[i % 4])) for i in range(400)}


@pytest.fixture(scope="module")
def many():
    """Strands in few buckets: copies, strands apart, short and empty ones."""
    rnd = random.Random(5)
    draw = lambda n: "".join(rnd.choice("ACGT") for _ in range(n))
    base = [draw(40) for _ in range(6)]
    rows = [(i, base[i % 6] if i % 3 else base[i % 6][:30] + draw(10)) for i in range(240)]
    return [*rows, (240, ""), (241, "ACG"), (250, ""), (260, "ACG"), (242, None)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, seq string").repartition(3)


@pytest.mark.parametrize("band", [None, 1])
def test_pairs_of_candidates_are_not_gathered_again(spark, many, band):
    index = minhash.index(frame(spark, many), "id", "seq", LSH)
    index = lsh.remove(lsh.insert(index, index.where("key < 20")), spark.createDataFrame([(7,), (30,)], "key long"))
    probes = minhash.index(frame(spark, [x for x in many if x[0] % 10 == 0]), "id", "seq", LSH)
    df = lsh.candidates(index, probes, band)
    held = {i: {x for x in buckets(s) if band in (None, x[0])} for i, s in many if s and len(s) >= 5}
    want = sorted((p, k) for p in held if p % 10 == 0 for k in held if k not in (7, 30) and held[p] & held[k])
    assert sorted(tuple(r) for r in df.collect()) == want
    plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    top = [x.strip(" +-:") for x in plan[:3]]
    assert not any(x.startswith("Aggregate") for x in top), top


@pytest.mark.parametrize("band", [None, 1])
def test_pairs_of_a_large_class_are_dealt_out(spark, many, monkeypatch, band):
    monkeypatch.setattr(lsh, "PROBES", 16)
    monkeypatch.setattr(lsh, "ENTRIES", 32)
    rows = [(1000 + i, many[0][1]) for i in range(1500)] + many
    index, probes = minhash.index(frame(spark, rows), "id", "seq", LSH), minhash.index(frame(spark, [x for x in rows if x[0] % 10 == 0]), "id", "seq", LSH)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = lsh.candidates(index, probes, band).withColumn("at", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    held = {i: {x for x in buckets(s) if band in (None, x[0])} for i, s in rows if s and len(s) >= 5}
    assert sorted((r["probe"], r["key"]) for r in got) == sorted((p, k) for p in held if p % 10 == 0 for k in held if held[p] & held[k])
    assert 4 * max(Counter(r["at"] for r in got).values()) < len(got)


def most_rows(df):
    """The rows of a frame, and the most rows that any step of its plan gave."""
    rows, seen = df.collect(), [0]

    def walk(p):
        kind = p.getClass().getSimpleName()
        n = p.metrics().get("numOutputRows")
        seen.append(n.get().value() if n.isDefined() else 0)
        if kind == "AdaptiveSparkPlanExec":
            return walk(p.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(p.plan())
        kids = p.children()
        for i in range(kids.size()):
            walk(kids.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return rows, max(seen)


def test_an_equal_strand_is_found_without_pairs(spark, many):
    rows = [(i, s) for j in range(8) for i, s in ((1000 * j + i, s) for i, s in many)]
    index = lsh.remove(minhash.index(frame(spark, rows), "id", "seq", LSH), spark.range(1, 8000, 6).withColumnRenamed("id", "key"))
    asked = [x for x in rows if x[0] % 10 == 0] + [(-1 - i, s + "A") for i, s in rows if i % 10 == 0] + [(9001, many[1][1]), (9002, many[4][1])]
    got, most = most_rows(lsh.query_exact(index, frame(spark, rows), frame(spark, asked), LSH))
    held = {s for i, s in rows if s and len(s) >= 5 and i % 6 != 1}
    assert sorted(map(tuple, got)) == sorted((i, s in held) for i, s in asked)
    assert {s in held for i, s in asked if i > 9000} == {True}
    assert most <= 6 * len(rows)  # three bands, and not the pairs, which are near a million


def test_least_of_blocks(monkeypatch):
    rnd = random.Random(6)
    for k in (4, 7):
        draw = lambda: "".join(rnd.choice("ACGT") for _ in range(rnd.choice([0, k, 12, 40])))  # noqa: B023, E731
        p, e = [draw() for _ in range(23)], [draw() for _ in range(41)]
        low, high, own = [*range(40), 3], [*range(30), *range(60, 70), 3], [i if i % 5 else None for i in range(23)]
        want = []
        for i, s in enumerate(p):
            far = [1 - len(a & b) / len(a | b) for j, t in enumerate(e) if not (low[j] == high[j] == own[i]) and ((a := ranks(s, k)) | (b := ranks(t, k)))]
            want.append(min(far) if far else None)
        for cells in (1, 500, 1 << 20):
            monkeypatch.setattr(nearest, "CELLS", cells)
            got = nearest.least_of([nearest.packed(s, k) for s in p], own, [nearest.packed(s, k) for s in e], low, high, k)
            assert [None if g != g else g for g in got.tolist()] == want


@pytest.mark.parametrize("exclusive", [True, False])
def test_least_distance_without_pairs(spark, many, exclusive):
    rows = [(1000 * j + i, s) for j in range(4) for i, s in many] + [(5000, "ACGTTGCAACGGT" * 2), (5010, "ACGTTGCAACGGTTT")]
    index = lsh.remove(minhash.index(frame(spark, rows), "id", "seq", LSH), spark.range(1, 4000, 6).withColumnRenamed("id", "key"))
    asked = [x for x in rows if x[0] % 10 == 0]
    got, most = most_rows(lsh.least_distance(index, frame(spark, rows), frame(spark, asked), LSH, exclusive))
    held = {i: (ranks(s), buckets(s)) for i, s in rows if s and len(s) >= 5}
    want = {}
    for i, s in asked:
        far = [1 - len(held[i][0] & x) / len(held[i][0] | x) for k, (x, b) in held.items() if i in held and (i != k or not exclusive) and not (k < 4000 and k % 6 == 1) and b & held[i][1]]
        want[i] = min(far, default=1.0)
    assert dict(map(tuple, got)) == want
    assert len({x for x in want.values()}) > 1
    assert most <= 6 * len(rows)


def test_a_condition_on_keys_costs_no_pairs(spark, many):
    rows = [(1000 * j + i, s) for j in range(4) for i, s in many]
    index, strands, asked = minhash.index(frame(spark, rows), "id", "seq", LSH), frame(spark, rows), frame(spark, [x for x in rows if x[0] % 10 == 0])
    got, most = most_rows(lsh.least_distance(index, strands, asked, LSH, among=F.col("key") % 7 == 3))
    assert most <= 6 * len(rows)
    assert sorted(map(tuple, got)) == sorted(map(tuple, lsh.least_distance(index, strands, asked, LSH, keep=F.col("key") % 7 == 3).collect()))
    both = lsh.least_distance(index, strands, asked, LSH, keep=(F.col("key") + F.col("probe")) % 7 == 3, among=F.col("key") > 500).collect()
    held = {i: (ranks(s), buckets(s)) for i, s in rows if s and len(s) >= 5}
    assert {r["probe"]: r["distance"] for r in both} == {i: min((1 - len(held[i][0] & x) / len(held[i][0] | x) for k, (x, b) in held.items() if i in held and k != i and k > 500 and (k + i) % 7 == 3 and b & held[i][1]), default=1.0) for i, s in rows if i % 10 == 0}


def test_payloads_meet_each_stored_strand_once(spark):
    from helicase.operators import payloads

    rnd = random.Random(9)
    draw = lambda n: "".join(rnd.choice("ACGT") for _ in range(n))
    small, base = minhash.Lsh(k=4, r=4, b=2), [draw(30), draw(50)]
    stored = frame(spark, [(i, base[i % 2]) for i in range(400)])
    new = spark.createDataFrame([(i, draw(20), draw(40)) for i in range(30)], "id long, address string, seq string")
    df = payloads.choose(new, minhash.index(stored, "id", "seq", small), stored.groupBy("seq").agg(F.min("id").alias("id")), small, count=4, error_weight=0.0, chunk=50)
    got, most = most_rows(df)

    def held(s):
        x = ranks(s, 4)
        sig = [min((a * c + b) % small.p % small.m for c in x) for a, b in small.functions]
        return x, {(b, *sig[2 * b : 2 * b + 2]) for b in range(2)}

    def far(s):
        both = [held(x) for x in (s, s.translate(str.maketrans("ACGT", "TGCA"))) if len(x) >= 4]
        return min((1 - len(x & y) / len(x | y) for x, b in both for y, c in map(held, base) if b & c), default=1.0)

    score = {}
    for r in payloads.permutations(new, 4).collect():
        oligo = r["address"] + r["payload"]
        total = sum(far(oligo[i : i + 50]) for i in range(0, len(oligo), 50))
        score.setdefault(r["id"], []).append((round(total, 9), -r["number"], r["payload"]))
    assert {r["id"]: r["payload"] for r in got} == {i: max(x)[2] for i, x in score.items()}
    assert most <= 30 * 4 * 2 * 2 * 2 + 400 * 2  # permutations, parts, strands and complements, bands; the index


def test_strands_of_pairs_travel_once(spark):
    from helicase.operators import pairs

    rnd = random.Random(4)
    draw = lambda n: "".join(rnd.choice("ACGT") for _ in range(n))
    assert all(pairs.unpack(pairs.pack(s)) == s for s in ["", *(draw(n) for n in range(1, 14))])
    base = draw(400)
    rows = [(i, base[: 200 + i] + draw(i % 7)) for i in range(120)] + [(200, base), (210, base), (220, "ACG"), (230, "")]
    met = [(p, k) for p, _ in rows if p % 10 == 0 for k, _ in rows if p != k]
    df = lsh.distances(spark.createDataFrame(met, "probe long, key long"), frame(spark, rows), 12)
    got, most = most_rows(df.where("distance IS NULL OR distance >= 0"))
    held = {i: ranks(s, 12) for i, s in rows}
    assert {(r["probe"], r["key"]): r["distance"] for r in got} == {(p, k): 1 - len(held[p] & held[k]) / len(held[p] | held[k]) if held[p] | held[k] else None for p, k in met}
    joins = [x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "FlatMapCoGroups" in x]
    assert joins  # strands meet in blocks, not in a row for each pair


def rows_of(df, kind):
    """The rows of a frame, and those that Python gave in steps of one kind."""
    rows, seen = df.collect(), []

    def walk(p):
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(p.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(p.plan())
        if name == kind:
            seen.append(p.metrics().get("pythonNumRowsReceived").get().value())
        kids = p.children()
        for i in range(kids.size()):
            walk(kids.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return rows, seen


@pytest.mark.parametrize("name", ["lsh_bloom_or", "lsh_bloom_and"])
def test_equal_names_are_hashed_once(spark, tmp_path, name):
    import duckdb

    from helicase.plans import catalog

    entries, asked = ["red anvil", "small widget", "x", "", None], ["red anvil", "red apple", "small widget", "tiny gear", "zz top zz", "q", "", None]
    # a few ids stand for two names: a band counts where it has both
    spark.createDataFrame([(i, entries[i % 5]) for i in range(900)], "c_custkey long, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(i % 790, asked[i * 7 % 8]) for i in range(800)], "p_partkey long, p_name string").repartition(3).write.parquet(f"{tmp_path}/part.parquet")
    got, hashed = rows_of(catalog.QUERIES[name](spark, str(tmp_path)), "ArrowEvalPythonExec")
    assert hashed and sum(hashed) <= len(entries) + len(asked)
    con = duckdb.connect()
    for t in ("customer", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(catalog.ORACLE_SQL[name]).fetchall()
    assert sorted(map(tuple, got)) == sorted(want)
    assert {x for _, x in want} == {True, False}
