"""The pipeline's stages, one after the other, against brute force; and on odd rows."""

import random
import re
from collections import Counter, defaultdict

import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F
from test_llm import brute_components, brute_hits, brute_quality

from helicase.llm import decontaminate, pii
from helicase.llm._common import checkpoint

WORD = re.compile(r"[^\x20\x09-\x0D]+")
STOCK = re.compile(
    "licensed under|all rights reserved|copyright|terms of (use|service)|privacy policy|use cookies|cookie policy|click here|sign up|subscribe|log in|enable javascript|lorem ipsum", re.I | re.A
)


def line_fails(line):
    n = len(WORD.findall(line))
    return (
        line.count("|") >= 2 or sum(ch in "#*$%&|<>" for ch in line) > n or 6 * line.count("!!") > 2 * max(n, 1)
        or n >= 3 and not any(ch.islower() for ch in line) and any(ch.isupper() for ch in line)
        or n >= 10 and not re.search("[.!?:;…。！？]", line) or n <= 30 and bool(STOCK.search(line))
    )


def cleaned(text):
    """The lines that pass, or None for a document that is rejected."""
    text = text or ""
    n, chars, _, _, repeats = brute_quality(text)
    lines = text.split("\n")
    lost = sum(len(w) for x in lines if line_fails(x) for w in WORD.findall(x))
    return None if n < 50 or 100 * repeats > 50 * n or 100 * lost > 50 * chars else "\n".join(x for x in lines if not line_fails(x))


def mixed(rows):
    """Target words of each source."""
    size = defaultdict(int)
    for _, text, source in rows:
        size[source] += len(WORD.findall(text or ""))
    order = sorted(s for s in size if s is not None) + [None] * (None in size)
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    target, open_, left = {}, set(order), sum(size.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 3 * size[s]}
        if not full:
            return target | share
        for s in full:
            target[s] = 3 * size[s]
            left -= target[s]
        open_ -= full
    return target


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents clean, copied, contaminated, with personal data and junk; and odd rows."""
    rnd = random.Random(12)
    vocabulary = ["".join(rnd.choice("abdegilmnorstu") for _ in range(rnd.randint(2, 9))) for _ in range(3000)]
    prose = lambda lines: "\n".join(" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(8, 16))) + "." for _ in range(lines))
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(12, 30)))) for i in range(6)] + [(6, None), (7, "")]
    rows = []
    add = lambda text, source, n=None: rows.append((len(rows) if n is None else n, text, "en", source, None))
    for i in range(40):
        add(prose(rnd.randint(8, 20)), f"s{i % 4}" if i % 5 else None)
    for i in range(12):
        words = rows[i % 3][1].split(" ")
        words[rnd.randrange(len(words))] = "changed"
        add(" ".join(words), "s1")
    for i, (_, text) in enumerate(items[:6]):
        add(f"{prose(4)}\n{text}.\n{prose(4)}", f"s{i % 4}")
    for i in range(6):
        add(f"{prose(6)}\nMail u{i}@mail{i}.example.com or +1 (20{i}) 555-010{i}, from 8.8.{i}.8.\n{prose(3)}", "s2")
    add(f"{prose(8)}\nHome | About | Contact\nCopyright by all of us", "s3")
    add("\n".join(f"{w} | {w} | {w}" for w in vocabulary[:60]), "s3")
    add(None, "s0")
    add("", None)
    add(prose(3000), "s0")
    for _ in range(3):
        add(rows[0][1], "s1", 0)
        add(rows[1][1], "s1", -1)
    rows += [(None, t, l, s, n) for _, t, l, s, n in rows[2:4]] + [(None, prose(9), None, None, None)] * 2
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, items


def test_stages_against_brute_force(spark, tables):
    path, items = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = [[(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]]
    for _, stage in cp.STAGES[:4]:
        docs = checkpoint(stage(spark, docs, path))
        rows = docs.collect()
        assert docs.columns == list(cp.COLUMNS)
        assert all(r["n_chars"] == len(r["text"]) for r in rows)
        seen.append([(r["doc_id"], r["text"], r["source"]) for r in rows])
    start, quality, joined, clean, private = seen
    assert Counter(quality) == Counter((i, cleaned(t), s) for i, t, s in start if cleaned(t) is not None)
    assert 0 < len(quality) < len(start)

    order = sorted(range(len(quality)), key=lambda n: (quality[n][0] is None, quality[n][0] or 0))
    group = brute_components([(n, quality[at][1]) for n, at in enumerate(order)])
    want = {}
    for n, at in enumerate(order):
        want.setdefault(group[n][1], quality[at])
    assert len(joined) == len(want) < len(quality)
    assert Counter(i for i, _, _ in joined) == Counter(i for i, _, _ in want.values())
    assert {x[:2] for x in joined} <= {x[:2] for x in quality}

    left, cut = Counter(), 0
    for i, t, _ in joined:
        hit = brute_hits(t, items)[1]
        n = len(decontaminate.words_of(t.encode()))
        cut += hit > 0
        if n > hit:
            left[(i, n - hit)] += 1
    assert cut >= 5
    assert left == Counter((i, len(decontaminate.words_of(t.encode()))) for i, t, _ in clean)
    assert all(brute_hits(t, [x for x in items if x[1]])[1] == 0 for _, t, _ in clean)

    s = pii.Surrogates(pii.DEMO_KEY)
    assert Counter(private) == Counter((i, s.rewrite(t)[0], x) for i, t, x in clean)
    changed = Counter(clean) - Counter(private)
    assert len(changed) == 6
    assert not any(re.search(r"@mail\d\.example|555-010\d|8\.8\.\d\.8", t) for _, t, _ in private if any(t.startswith(u[:40]) for _, u, _ in changed))

    out = cp.STAGES[4][1](spark, docs, path).collect()
    assert all(r["taken"] > 0 for r in out)
    target, taken = mixed(private), Counter()
    for r in out:
        assert r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    count = Counter(x for _, _, x in private)
    for x, want in target.items():
        assert taken[x] == pytest.approx(want, abs=count[x] + 2)


def test_run(spark, tables):
    path, _ = tables
    out = cp.run(spark, path).collect()
    assert out
    assert Counter(r["doc_id"] for r in out) == Counter(r["doc_id"] for r in cp.run(spark, path).collect())


def test_empty_tables(spark, tables, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{tables[0]}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    assert cp.decontamination_stage(spark, docs.where("text IS NOT NULL"), str(tmp_path)).count() == docs.where("text IS NOT NULL").count()


@pytest.mark.parametrize("stage", [f for _, f in cp.STAGES])
def test_stages_take_extra_columns_with_their_own_names(spark, tables, stage):
    path, _ = tables
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(9)
    for x in ("quality", "spans", "items", "entities", "__row", "size", "taken", "key"):
        docs = docs.withColumn(x, F.lit("clash"))
    assert stage(spark, docs, path).count() >= 0
