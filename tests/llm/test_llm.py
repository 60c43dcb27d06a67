"""The corpus operators against brute force, on small fixtures with nulls, empty and long texts, ties, repeats and clashing names."""

import gzip
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from helicase.llm import decontaminate, fm_index, fpe, html_text, mixing, ngram_join, phrase_dedup, pii, quality, token_counts, url_filter, warc

tokenizers = pytest.importorskip("tokenizers")
DOCS = "doc_id long, text string, source string"


def prose(rnd, n, words=60):
    return " ".join(f"w{rnd.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Copies exact and near, shared passages, repeats, nulls, empty and short texts, a long one."""
    rnd = random.Random(5)
    texts = [prose(rnd, rnd.randint(20, 120), 4000) for _ in range(30)]
    base = texts[0].split()
    for i in range(25):
        copy = list(base)
        for _ in range(rnd.randint(0, 3)):
            copy[rnd.randrange(len(copy))] = f"n{rnd.randrange(99)}"
        texts.append(" ".join(copy))
    passage = prose(rnd, 40, 4000)
    texts += [f"{prose(rnd, 10, 4000)} {passage} {prose(rnd, 30, 4000)}" for _ in range(6)]
    texts += [texts[3], texts[3], texts[5].upper(), None, "", "   \n", "one two", "one two", "ONE two", "a " * 300, prose(rnd, 5000, 9000)]
    return [(i, t, f"s{i % 3}" if i % 7 else None) for i, t in enumerate(texts)]


@pytest.fixture
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS).repartition(5)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCS)


def shingles(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def brute_components(rows):
    sets = {i: shingles(t) for i, t, *_ in rows}
    label = {i: i for i in sets}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_ngram_join(docs, corpus):
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_classes(docs).collect()}
    assert got == brute_components(corpus)


def test_ngram_join_of_a_chain_and_a_dense_group(spark):
    """Neighbours link, far ones don't; and copies that differ pairwise but meet in their centre."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[i * 4 : i * 4 + 100])) for i in range(40)]
    rnd = random.Random(2)
    base = [f"b{i}" for i in range(100)]
    for i in range(60):
        copy = list(base)
        for j in rnd.sample(range(100), 2):
            copy[j] = f"c{rnd.randrange(20)}"
        rows.append((100 + i, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_classes(df).collect()}
    assert got == brute_components(rows)


def test_ngram_join_edges(spark, empty):
    assert ngram_join.jaccard_classes(empty).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (None, None), (7, "x y")], "doc_id long, text string")
    got = Counter((r["id"], r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_classes(df).collect())
    assert got == Counter([(None, 2, 4), (4, 2, 4), (4, 2, 4), (None, 0, None), (7, 1, 7)])
    clash = df.withColumn("key", F.lit(1)).withColumn("n", F.lit(2)).withColumn("id", F.lit("x"))
    kept = ngram_join.keep_one(clash.withColumn("__row", F.lit(0)))
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter([(4, "a b c d e f"), (None, None), (7, "x y")])
    assert kept.columns == ["doc_id", "text", "key", "n", "id"]


def brute_repeats(rows, k=13):
    words = {i: (t or "").split() for i, t, *_ in rows}
    owner = {}
    for i in sorted(words):
        for p in range(len(words[i]) - k + 1):
            owner.setdefault(tuple(words[i][p : p + k]), i)
    out = {}
    for i, ws in words.items():
        gone = {p + j for p in range(len(ws) - k + 1) if owner[tuple(ws[p : p + k])] < i for j in range(k)}
        out[i] = (len(ws), len(gone), " ".join(w for p, w in enumerate(ws) if p not in gone))
    return out


def test_phrase_dedup(docs, corpus):
    got = {r["id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in phrase_dedup.remove_repeats(docs).collect()}
    assert got == brute_repeats(corpus)


def test_phrase_dedup_edges(spark, empty):
    assert phrase_dedup.remove_repeats(empty).count() == 0
    text = " ".join("abcdefghijklmno")
    df = spark.createDataFrame([(3, text), (3, text), (None, text), (1, None), (9, "x " * 40), (8, "x " * 30)], "doc_id long, text string")
    got = Counter((r["id"], r["n_removed"]) for r in phrase_dedup.remove_repeats(df).collect())
    assert got == Counter([(3, 0), (3, 0), (None, 15), (1, 0), (9, 40), (8, 0)])


@pytest.mark.parametrize("fan", [4])
def test_exchanges_of_many_levels(spark, monkeypatch, docs, corpus, fan):
    """Fragments and shards in levels of a few."""
    from helicase.llm import _windows

    monkeypatch.setattr(_windows, "FAN", fan)
    monkeypatch.setattr(phrase_dedup, "SHARD_BYTES", 5 << 20)
    monkeypatch.setattr(ngram_join, "FRAGMENT_BYTES", 5 << 20)
    got = {r["id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in phrase_dedup.remove_repeats(docs).collect()}
    assert got == brute_repeats(corpus)
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_classes(docs).collect()}
    assert got == brute_components(corpus)


def test_packing_in_portions_gives_the_same_hashes():
    from helicase.llm import _windows as win

    rnd = np.random.default_rng(4)
    parts = [(rnd.integers(0, 1 << 63, n).astype(np.uint64), np.array([10 * i, 10 * i + 1]), np.array([n // 3, n - n // 3])) for i, n in enumerate((0, 5, 400, 37, 900))]
    want = sorted((int(d), int(x)) for h, ids, counts in parts for d, x in zip(np.repeat(ids, counts), h, strict=True))
    for most in (1, 300, 1 << 20):
        got = []
        for f, ids, counts, h in win.unpack(win.packed(parts, 50, 8, 1, most), 8):
            assert (win.fragment_of(h, 50) == f).all()
            got += [(int(d), int(x)) for d, x in zip(np.repeat(ids, counts), h, strict=True)]
        assert sorted(got) == want


def test_shards_agree_with_the_column(spark):
    ids = np.array([0, 5, 123456789012, phrase_dedup.NULLS + 7])
    df = spark.createDataFrame([(int(i),) for i in ids], "i long")
    assert [r[0] for r in df.select(phrase_dedup.shard_column(F.col("i"), 7)).collect()] == phrase_dedup.shard_of(ids, 7).tolist()


@pytest.mark.parametrize("seed", range(6))
def test_fm_index(seed):
    rnd = random.Random(seed)
    text = np.array([rnd.randint(1, 5) for _ in range(rnd.randint(1, 400))])
    index = fm_index.FMIndex(text, 5, sample=rnd.choice((1, 4, 9)))
    for _ in range(40):
        p = [rnd.randint(1, 5) for _ in range(rnd.randint(1, 6))]
        rows = np.zeros((1, 8), np.int64)
        rows[0, 8 - len(p) :] = p
        low, high = index.search(rows, np.array([len(p)]))
        found = sorted(index.locate(np.arange(low[0], high[0])).tolist())
        assert found == [i for i in range(len(text) - len(p) + 1) if text[i : i + len(p)].tolist() == p]


def brute_hits(text, items, k=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    words, hit, names = split(text), set(), set()
    for name, t in items:
        ws = split(t)
        for w in [ws[i : i + k] for i in range(max(1, len(ws) - k + 1))] if ws else []:
            for p in range(len(words) - len(w) + 1):
                if words[p : p + len(w)] == w:
                    hit |= set(range(p, p + len(w)))
                    names.add(str(name))
    return len(words), len(hit), sorted(names)


@pytest.mark.parametrize("block", [20, 1 << 20])
def test_decontamination(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    rnd = random.Random(1)
    items = [(i, prose(rnd, rnd.choice((3, 12, 25)))) for i in range(8)] + [(8, ""), (9, None), (10, "Été à Köln, no 7!"), (11, "Été à Köln, no 7!")]
    texts = [prose(rnd, 40) for _ in range(10)] + [f"{prose(rnd, 5)}. {t} {prose(rnd, 5)}" for _, t in items] + [None, "", items[1][1], "x ÉTÉ... été à köln NO 7"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("items", F.lit(0)).withColumn("n_words", F.lit("x"))
    out = decontaminate.find_contamination(df, spark.createDataFrame(items, "item_id long, text string"))
    got = {r["doc_id"]: (r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), r["items"]) for r in out.collect()}
    assert got == {i: brute_hits(t, items) for i, t in enumerate(texts)}
    cleaned = decontaminate.find_contamination(df, spark.createDataFrame(items, "item_id long, text string"), then="clean")
    left = {r["doc_id"]: r["text"] for r in cleaned.collect()}
    for i, t in enumerate(texts):
        assert (left[i] is None) == (t is None)
        assert len(decontaminate.words_of((left[i] or "").encode())) == got[i][0] - got[i][1]


def test_decontamination_without_benchmark(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_contamination(docs, none).where(F.size("items") > 0).count() == 0


@pytest.fixture(scope="module")
def library():
    public = pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.json")
    return path, tokenizers.Tokenizer.from_file(path)


def test_token_counts(library):
    path, tok = library
    rnd = random.Random(9)
    alphabet = " \n\t\u3000'stmdrevlLES01½!#<>|ß世😀\r\x0b\x1c\x85"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(3000)]
    texts += ["", "<|endoftext|>", "a<|endoftext|> b", "'re we're 'RE", "x" * 3000, " " * 700, "世界" * 900, "12345 " * 50]
    want = [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert token_counts.counter(path).counts(texts).tolist() == want


def test_boundary_scan_composes():
    """Chunks by their state maps give what one run of the automaton gives."""
    b = token_counts.Boundaries()
    rnd = np.random.default_rng(3)
    classes = rnd.integers(0, token_counts.CLASSES, 5000).astype(np.uint8)
    state, marks = token_counts.START, []
    for cls in classes:
        marks.append(b.marks[cls, state])
        state = b.next[cls, state]
    want = [bool(m & 1) for m in marks]
    for i, m in enumerate(marks[1:]):
        want[i] |= bool(m & 2)
    assert b.scan(classes).tolist() == want


def test_token_counts_query_shape(spark, library, docs, empty):
    d = token_counts.count_tokens(docs.withColumn("n_tokens", F.lit("x")), library[0])
    assert d.columns == ["doc_id", "source", "n_bytes", "n_tokens"]
    assert d.where("n_bytes = 0 AND n_tokens <> 0").count() == 0
    assert token_counts.count_tokens(empty, library[0]).count() == 0


def test_surrogates_are_bijective_and_keep_shape():
    seen = {fpe.moved(x, 1000, b"k", b"t") for x in range(1000)}
    assert seen == set(range(1000))
    assert all(fpe.moved(x, 1000, b"k", b"t") != x for x in range(1000))
    a = fpe.replaced("Ab-12 é世", b"k", "t")
    assert a != "Ab-12 é世"
    assert [c.isalpha() for c in a] == [c.isalpha() for c in "Ab-12 é世"]
    assert a[0].isupper()
    assert a[2] == "-"


def test_pii_types():
    s = pii.Surrogates(b"key")
    card, other = "4149601755386017", "9807915762804490"
    text = f'Mr. John Smith, a.b@mail8.example.com / A.B@Mail8.Example.com, +1 (499) 555-6503 or 499-555-6503, {card}, {other}, 8.8.8.8, 192.168.1.7, token = "1eb9c654e721b4f812088970e66a6345cee33dd6", DE89 3704 0044 0532 0130 00, 123-45-6789, v4.0. Smith left.'
    new, spans = s.rewrite(text)
    for secret in ("John", "Smith", "a.b@mail8", "A.B@Mail8", "555-6503", card, "8.8.8.8", "168.1.7", "1eb9c654", "3704 0044", "123-45-6789"):
        assert secret not in new
    assert other in new
    assert "v4.0." in new
    assert Counter(x["type"] for x in spans) == Counter(name=3, email=2, phone=2, card=1, ip=2, secret=1, iban=1, ssn=1)
    by = defaultdict(set)
    for x in spans:
        by[x["entity"]].add(x["surrogate"])
        assert new[x["start"] : x["end"]]
    assert all(len(v) == 1 for v in by.values())
    assert len(set.union(*by.values())) == len(by)
    number = next(x["surrogate"] for x in spans if x["type"] == "card")
    assert number[0] == "4"
    assert pii.check_digit(number[:-1]) == number[-1]
    assert pii.iban_valid(next(x["surrogate"] for x in spans if x["type"] == "iban"))
    given = next(x["surrogate"] for x in spans if x["type"] == "name")
    assert pii.LEXICON[given][0] == ("latin", "m")
    assert s.rewrite(text) == (new, spans)
    assert pii.Surrogates(b"another").rewrite(text)[0] != new


@pytest.mark.parametrize("text", ["", "Plain prose, with 12 numbers like 4.0 and 2024-01-05.", "order 1234567890123456", "e.g. a@b"])
def test_clean_texts_stay(text):
    assert pii.Surrogates(b"k").rewrite(text) == (text, [])


def test_pii_collisions(spark):
    rnd = random.Random(4)
    texts = [f"mail u{i}.{rnd.randrange(99)}@mail{i % 9}.example.com call +1 ({200 + i}) 555-{rnd.randrange(9999):04d}, Frau Anna K{chr(97 + i % 26)}{'aeiou'[i % 5]}nz" for i in range(200)]
    df = spark.createDataFrame([*enumerate(texts), (500, None), (501, "")], "doc_id long, text string").withColumn("entities", F.lit(1))
    out = pii.pseudonymize(df, b"key")
    assert pii.collisions(out).count() == 0
    assert out.where("text IS NULL").count() == 1
    assert out.where(F.size("entities") > 0).count() == 200
    assert out.columns == ["doc_id", "text", "entities"]


def test_mixing(spark, docs, corpus, empty):
    d = mixing.mix_sources(docs.withColumn("size", F.lit("clash"))).collect()
    size = {i: len((t or "").split()) for i, t, _ in corpus}
    by = defaultdict(list)
    for i, _, s in corpus:
        by[s].append(i)
    order = sorted([s for s in by if s is not None]) + [None]
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    total = {s: sum(size[i] for i in ids) for s, ids in by.items()}
    target, open_, left = {}, set(order), sum(total.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 3 * total[s]}
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 3 * total[s]
            left -= target[s]
        open_ -= full
    taken = Counter()
    for r in d:
        assert r["size"] == size[r["doc_id"]]
        assert r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        assert r["taken"] == r["epochs"] * r["size"] + r["partial"]
        taken[r["source"]] += r["taken"]
    for s in order:
        assert taken[s] == pytest.approx(target[s], abs=len(by[s]) + 2)
    assert sorted(map(tuple, d), key=str) == sorted(map(tuple, mixing.mix_sources(docs.withColumn("size", F.lit(0))).collect()), key=str)
    assert mixing.mix_sources(empty).count() == 0
    nothing = mixing.mix_sources(spark.createDataFrame([(1, None, "a"), (None, "", None)], DOCS))
    assert {r["taken"] for r in nothing.collect()} == {0}


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, corpus, empty):
    rnd = random.Random(7)
    clean = "\n".join(" ".join(prose(rnd, 9, 500).split()) + "." for _ in range(12))
    extra = [
        (1000, clean, "a"),
        (1001, clean + "\nHome | About | Contact\nCopyright 2020 all rights reserved.", "a"),
        (1002, "\n".join(f"{w} | {w}x | {w}y | z{w}" for w in prose(rnd, 40, 9999).split()), "a"),
        (1003, " ".join(w + "***" for w in prose(rnd, 80, 9999).split()), "a"),
        (1004, prose(rnd, 90, 9999).upper() + ".", "a"),
        (1005, prose(rnd, 90, 9999), "a"),
        (1006, "same line here.\n" * 40, "a"),
    ]
    rows = corpus + extra
    df = spark.createDataFrame(rows, DOCS)
    out = {r["doc_id"]: r["quality"] for r in quality.clean_lines(df.withColumn("quality", F.lit(0))).collect()}
    for i, t, _ in rows:
        q = out[i]
        assert (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"]) == brute_quality(t), i
        assert q["base_failed"] == (q["n_words"] < 50 or 100 * q["n_repeat_words"] > 50 * q["n_words"])
        assert not (q["base_failed"] and q["kept"])
    assert [out[i]["kept"] for i in range(1000, 1007)] == [True, True, False, False, False, False, False]
    assert out[1001]["text"] == clean
    assert quality.clean_lines(empty).count() == 0


def test_url_rules(spark):
    urls = [
        "http://A.Example.NET/en/x", "http://example.net/de/", "https://foo.net", "https://foo.net/", "http://example.com/de/1?q#f", "http://notexample.com/de/1",
        "http://x.org/fr/", "http://x.org/en/", "nothing", None, "http://net/a", "http://u:p@B.com:80/p?x://y", "//a.net/en/",
    ]
    df = spark.createDataFrame([(i, u, "<p>") for i, u in enumerate(urls)], "page_id long, url string, html string").withColumn("rule", F.lit(3))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(df, steps=2).collect()}
    assert got == {
        0: ("a.example.net", "/en/x", "example.net/en/", "allow"), 1: ("example.net", "/de/", "net/", "block"), 2: ("foo.net", "", None, "allow"), 3: ("foo.net", "/", "net/", "block"),
        4: ("example.com", "/de/1", "example.com/de/", "block"), 5: ("notexample.com", "/de/1", None, "allow"), 6: ("x.org", "/fr/", "org/fr/", "allow"), 7: ("x.org", "/en/", None, "allow"),
        8: ("", "", None, "allow"), 9: ("", "", None, "allow"), 10: ("net", "/a", "net/", "block"), 11: ("u:p@b.com:80", "/p", None, "allow"), 12: ("", "", None, "allow"),
    }


def test_propagation_against_power_iteration(spark):
    rnd = random.Random(3)
    hosts = [f"h{i}" for i in range(12)]
    edges = {(rnd.choice(hosts), rnd.choice(hosts)) for _ in range(30)}
    edges = sorted((a, b) for a, b in edges if a != b)
    seeds = {"h0": 0.5, "h3": 0.5}
    got = url_filter.propagate(
        spark.createDataFrame([("trust", a, b, 1) for a, b in edges], "walk string, src string, dst string, w long"),
        spark.createDataFrame([("trust", h, s) for h, s in seeds.items()], "walk string, host string, seed double"), steps=6,
    )
    rank = dict(seeds)
    for _ in range(6):
        new, moved = defaultdict(float), 0.0
        for h, v in rank.items():
            out = [b for a, b in edges if a == h]
            for b in out:
                new[b] += 0.85 * v / len(out)
                moved += 0.85 * v / len(out)
        for h, s in seeds.items():
            new[h] += s * (1 - moved)
        rank = new
    have = {r["host"]: r["rank"] for r in got.collect()}
    assert set(have) == set(rank)
    assert all(have[h] == pytest.approx(v) for h, v in rank.items())


def test_distrust_reaches_who_links_to_blocked(spark):
    pages = [(0, "http://bad.net/a", ""), (1, "http://friend.com/a", "<a href='http://bad.net/a'>x</a>"), (2, "http://fine.com/", "<a href='http://other.com/'>y</a>"), (3, "http://other.com/", None)]
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {0: "block", 1: "block", 2: "allow", 3: "allow"}


def test_html_extraction():
    tree = html_text.trained()
    page = """<html><head><title>t</title><style>x</style></head><body><header><a href=/>Home</a></header><nav><ul><li><a href=/a>A</a></ul></nav>
      <div class="cookie-notice">We use cookies</div><article><h1>A &amp; B</h1><p>First   para<b>graph</b>.<br>Second line.<p>One.
      <div class="ad">Buy now</div><form><label>Mail</label><input></form><script>var a = "</p>";</script><p>Last&nbsp;one</p></article>
      <div id="comments"><p>Great post, I agree with every word of it.</p></div><aside>More</aside><footer>&copy; x</footer></body></html>"""
    assert html_text.main_text(page, tree) == "A & B\nFirst paragraph. Second line.\nOne.\nLast one"
    assert html_text.main_text("", tree) == ""
    assert html_text.main_text("<nav>x</nav>", tree) == ""


def test_html_tree_on_held_out_pages():
    tree = html_text.trained()
    right = total = 0
    for page, labels in html_text.labelled_pages(150, seed=77):
        got = tree.predict(html_text.features(html_text.parsed(page)))
        right += int((got == np.array(labels)).sum())
        total += len(labels)
    assert right / total >= 0.98


def test_html_frame(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "plain words"), (3, "plain words")], "page_id long, html string").withColumn("text", F.lit(1))
    assert sorted((r["page_id"], r["text"]) for r in html_text.extract_text(df).collect())[:2] == [(1, ""), (2, "")]


def test_warc_files_and_revisits(spark, tmp_path):
    http = lambda status, head, body=b"": f"HTTP/1.1 {status} X\r\n{head}\r\n\r\n".encode() + body
    rec = [
        warc.write_record("response", "http://www.a.com/x/", "2024-01-01T00:00:00Z", "<1>", http(200, 'ETag: "e1"\r\nContent-Type: text/html\r\nCache-Control: no', b"body one")),
        warc.write_record("response", "http://a.com/x?utm_source=z", "2024-01-03T00:00:00Z", "<2>", http(200, 'ETag: "e2"', b"body two")),
        warc.write_record("revisit", "https://A.com/x#f", "2024-01-02T00:00:00Z", "<3>", http(304, 'ETag: W/"e1"\r\nCache-Control: max-age=5\r\nContent-Type: x/y')),
        warc.write_record("revisit", "http://a.com/x", "2024-01-04T00:00:00Z", "<4>", http(304, 'ETag: "e1"')),
        warc.write_record("revisit", "http://a.com/x", "2023-01-04T00:00:00Z", "<5>", http(304, "Date: d")),
        warc.write_record("revisit", "http://b.com/", "2024-01-04T00:00:00Z", "<6>", http(304, "Date: d")),
    ]
    (tmp_path / "a.warc").write_bytes(b"".join(rec[:3]))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in rec[3:]))
    records = warc.read_warc(spark, str(tmp_path))
    assert records.where("type = 'response'").orderBy("record_id").select("body").first()[0] == b"body one"
    out = {r["record_id"]: r for r in warc.resolve_revisits(records).collect()}
    assert {k: (r["outcome"], r["resolved_id"]) for k, r in out.items()} == {
        "<3>": ("resolved", "<1>"), "<4>": ("validator-mismatch", None), "<5>": ("no-earlier-response", None), "<6>": ("no-earlier-response", None),
    }
    assert out["<3>"]["headers"] == {"etag": 'W/"e1"', "cache-control": "max-age=5", "content-type": "text/html"}
    assert out["<3>"]["status"] == 200


def test_as_of_join_against_brute_force(spark):
    rnd = random.Random(8)
    rows = []
    for i in range(400):
        kind = rnd.choice(("response", "revisit"))
        rows.append((f"r{i:03d}", kind, rnd.choice(["http://a.com/", "http://b.com/", "http://hot.com/", "http://hot.com/", None]), rnd.randrange(40) * 900 if rnd.random() > 0.05 else None, 200 if kind == "response" else 304))
    df = spark.createDataFrame(rows, "record_id string, type string, url string, t long, status int").select("record_id", "type", "url", F.timestamp_seconds("t").alias("ts"), "status", F.lit(None).cast("map<string,string>").alias("headers"))
    got = {r["record_id"]: r["resolved_id"] for r in warc.resolve_revisits(df).collect()}
    want = {}
    for i, kind, url, t, _ in rows:
        if kind == "revisit":
            earlier = [(u, j) for j, k, v, u, _ in rows if k == "response" and url is not None and v == url and t is not None and u is not None and u < t]
            want[i] = max(earlier)[1] if earlier else None
    assert got == want


def test_digests(spark, sf_dir):
    from helicase.llm import queries

    row = queries.QUERIES["op6_phrase_dedup"](spark, sf_dir).orderBy("doc_id").first()
    text = spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.col("doc_id") == row["doc_id"]).first()["text"]
    if row["n_removed"] == 0:
        assert row["kept_sha256"] == hashlib.sha256(" ".join(text.split()).encode()).hexdigest()
