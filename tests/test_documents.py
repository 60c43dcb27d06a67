"""The similarity index over long strands against brute force, and its recall of near copies."""

import random

import pytest
from pyspark.sql import functions as F

from helicase.functions import minhash
from helicase.plans import storage


@pytest.fixture(scope="module")
def strands():
    """Strands apart, copies with a few changed bases, empty and short ones."""
    rnd = random.Random(8)
    draw = lambda n: "".join(rnd.choice("ACGT") for _ in range(n))
    rows = [(100 * i, draw(rnd.randint(300, 2000))) for i in range(12)]
    for i, s in rows[:8]:
        for j in range(6):
            copy = list(s)
            for _ in range(j):
                copy[rnd.randrange(len(copy))] = "A"
            rows.append((i + 1 + j, "".join(copy)))
    return [*rows, (1300, ""), (1400, "ACGT"), (1401, None), (1500, rows[0][1]), (1600, draw(50_000))]


def codes(s):
    return {sum("ACGT".index(b) << 2 * j for j, b in enumerate(s[i : i + 12])) for i in range(len(s or "") - 11)}


def test_long_and_short_forms_agree(spark, strands):
    lsh = storage.DOC_LSH
    df = spark.createDataFrame([x for x in strands if len(x[1] or "") < 3000], "id long, seq string")
    both = df.select("id", minhash.signature("seq", lsh).alias("a"), minhash.signature_of_long("seq", lsh).alias("b"))
    assert both.where(~F.col("a").eqNullSafe(F.col("b"))).count() == 0


def test_candidates_and_distances_against_brute_force(spark, strands):
    lsh = storage.DOC_LSH
    df = spark.createDataFrame(strands, "id long, seq string").repartition(4)
    sets = {i: codes(s) for i, s in strands}
    p, m = lsh.p, lsh.m
    sig = {i: [min((a * x + b) % p % m for x in c) for a, b in lsh.functions] for i, c in sets.items() if c}
    bands = {i: {(b, tuple(s[4 * b : 4 * b + 4])) for b in range(4)} for i, s in sig.items()}
    want = {(i, k) for i in bands if i % 100 == 0 for k in bands if i != k and bands[i] & bands[k]}
    assert {tuple(r) for r in storage.document_candidates(df).collect()} == want
    got = {(r["probe"], r["key"]): r["distance"] for r in storage.document_distances(df).collect()}
    assert got == {(p, k): pytest.approx(1 - len(sets[p] & sets[k]) / len(sets[p] | sets[k]), abs=1e-8) for p, k in want}
    near = {(p, k) for p in sets if p % 100 == 0 for k in sets if p != k and sets[p] and sets[k] and len(sets[p] & sets[k]) >= 0.8 * len(sets[p] | sets[k])}
    assert len(near) > 30
    assert len(near & want) >= 0.9 * len(near)


def test_strands_are_made_once_for_distances(spark, strands):
    """They were made for the index, for entries and for probes, which took most of the time."""
    seen = spark.sparkContext.accumulator(0)

    def count(frames):
        for x in frames:
            seen.add(len(x))
            yield x

    df = spark.createDataFrame(strands, "id long, seq string").mapInPandas(count, "id long, seq string")
    assert storage.document_distances(df).count() > 30
    assert seen.value == len(strands)


@pytest.mark.parametrize("bounds", [{}, {"MET": 3, "ROWS": 5, "BITMAPS": 1}, {"BLOCK_BYTES": 700, "ENTRIES": 4}])
def test_distances_in_blocks_of_any_size(spark, strands, monkeypatch, bounds):
    """Copies among probes and entries, small blocks, slices and batches, and k-mers left out of the bitmaps."""
    from helicase.operators import pairs

    for name, value in bounds.items():
        monkeypatch.setattr(pairs, name, value)
    rows = [*strands, (1700, strands[0][1]), (1701, strands[0][1]), (1800, "A" * 12), (1801, "A" * 40)]
    df = spark.createDataFrame(rows, "id long, seq string").repartition(3)
    sets = {i: codes(s) for i, s in rows}
    want = {tuple(r) for r in storage.document_candidates(df).collect()}
    assert {(0, 1500), (1500, 1700), (1700, 1701), (1800, 1801)} <= want
    got = storage.document_distances(df).collect()
    assert len(got) == len(want)
    assert {(r["probe"], r["key"]): r["distance"] for r in got} == {(p, k): pytest.approx(1 - len(sets[p] & sets[k]) / len(sets[p] | sets[k]), abs=1e-8) for p, k in want}


def test_distances_of_bytes_are_those_of_their_bases(spark):
    from helicase.functions import seq as q

    rnd = random.Random(3)
    words = ["data", "Straße", "naïve", "语言", "🙂", "of", "x\u0000y", "\n"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 60))) for _ in range(300)]
    rows = [(10 * i, t) for i, t in enumerate([*texts, "", None, "ab", "abc", "abc"])]
    df = spark.createDataFrame(rows, "id long, text string")
    plain = storage.document_distances(df.select("id", F.encode("text", "UTF-8").alias("seq")))
    bases = storage.document_distances(df.select("id", q.encode_2bit("text").alias("seq")))
    got = sorted(tuple(r) for r in plain.collect())
    assert len(got) > 200
    assert got == sorted(tuple(r) for r in bases.collect())


@pytest.mark.parametrize("k", [1, 5, 12, 13, 15])
def test_packed_ranks_and_their_minima(monkeypatch, k):
    """Two long strands at once, as numbers that doubles hold and as others."""
    from helicase.operators import pairs

    rnd = random.Random(k)
    lsh = minhash.Lsh(k=k, r=6, b=3)
    monkeypatch.setattr(pairs, "HASHED", 2000)
    kept = pairs._Minima(lsh)
    for n in (0, k - 1, k, k + 1, 20, 21, 22, 23, 700, 9000, 23):
        s = "".join(rnd.choice("ACGT") for _ in range(n))
        ranks = pairs.ranks_of(pairs.pack(s), k)
        assert sorted(ranks.tolist()) == sorted(minhash.ranks_of(s, k).tolist())
        if len(ranks):
            want = [min((a * int(x) + b) % lsh.p % lsh.m for x in ranks) for a, b in lsh.functions]
            assert minhash.least(minhash.codes_of(s, k), lsh).tolist() == want
            assert kept.of(pairs._distinct(ranks)).tolist() == want
