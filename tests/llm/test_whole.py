"""Corpus operators do the whole job: what earlier versions cut."""

import random

import pytest

from helicase.llm import html_text, ngram_join, url_filter

ARTICLE = "<h1>A title here</h1><p>First paragraph with quite a few words in it.</p><p>Second one, as long as the first or longer.</p>"
SIDE = "<div class='sidebar'><p>Short notes beside</p></div>"
TEXT = "A title here\nFirst paragraph with quite a few words in it.\nSecond one, as long as the first or longer."


@pytest.mark.parametrize("name", ["content-sidebar-wrap", "content-with-sidebar", "main no-sidebar", "post comment-enabled", "sidebar-left"])
@pytest.mark.parametrize("inner", ["<article>{}</article>", "<main>{}</main>", "<div class='post-body'>{}</div>", "<article class='post comment-enabled'>{}</article>"])
def test_article_in_a_layout_wrapper_stays(name, inner):
    page = f"<body><nav><ul><li><a href=/>Home</a></ul></nav><div class='{name}'>{inner.format(ARTICLE)}{SIDE}</div><div id='comments'><p>I agree with it.</p></div><footer>x</footer></body>"
    assert html_text.main_text(page, html_text.trained()) == TEXT


def test_boilerplate_around_and_in_articles_goes():
    page = f"<article>{ARTICLE}<div class='ad'><p>{'buy now ' * 40}</p></div></article><div class='related'><article><p>A teaser of another page</p></article></div><div id='comments'>{'<article class=comment-body><p>I agree with every word of it.</p></article>' * 9}</div>"
    assert html_text.main_text(page, html_text.trained()) == TEXT


@pytest.mark.parametrize("cut", [
    "<datalist><option value=a><option value=b></datalist>", "<select><option>One<option>Two</select>", "<select><optgroup label=x><option>One<option>Two</optgroup></select>", "<div><button>Buy</div>",
    "<button>Buy", "<svg><path d='M0 0'>", "<option>One<option>Two", "<canvas>", "<noscript><div><p>Turn it on</p></div></noscript>", "<object><p>Old plugin</p><object>x</object></object>",
    "<button>Buy<script>var s = '</button>'</script>", "<template><article><p>Empty</p></article></template>",
])
@pytest.mark.parametrize("where", ["<body>{}<article>{}{}</article></body>", "<article>{1}{0}{2}</article><select><option>x</option></select><button>y</button>"])
def test_elements_that_are_not_shown_end_with_their_container(cut, where):
    title, rest = ARTICLE[:21], ARTICLE[21:]
    page = where.format(cut, title, rest)
    assert html_text.main_text(page, html_text.trained()) == TEXT


def test_hidden_elements_in_a_line_leave_it_whole():
    page = "<article><p>Words before <button>Buy</button>and after <svg><title>t</title><a>z</a></svg>it.</p><p>Plain.<style>p {}</style></p><script>never ends <p>x"
    assert [b.text for b in html_text.blocks(page)] == ["Words before and after it.", "Plain."]


@pytest.mark.parametrize("block", [16])
def test_links_of_a_group_are_all_counted(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", block)
    monkeypatch.setattr(ngram_join, "COLUMNS", 64)
    rnd = random.Random(2)
    base = [f"b{i}" for i in range(100)]
    rows = [(i, " ".join(f"w{j}" for j in range(i * 4, i * 4 + 100))) for i in range(20)]
    for i in range(100, 160):
        copy = list(base)
        for j in rnd.sample(range(100), 1):
            copy[j] = f"c{rnd.randrange(20)}"
        rows.append((i, " ".join(copy)))
    rows += [(500, rows[0][1]), (501, rows[30][1]), (502, ""), (503, "x y")]
    sets = {i: frozenset(tuple(t.split()[p : p + 5]) for p in range(max(1, len(t.split()) - 4))) if t else frozenset() for i, t in rows}
    want = {i: sum(100 * len(s & o) >= 80 * len(s | o) for o in set(sets.values()) if o and s and o != s) for i, s in sets.items()}
    got = {r["id"]: r["n_links"] for r in ngram_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), links=True).collect()}
    assert got == want
    assert sum(want.values()) > 1000


def test_distrust_goes_as_far_as_links_do(spark):
    pages = [(i, f"http://bad{i}.net/", "") for i in range(100)]
    pages.append((100, "http://a1.com/", "".join(f"<a href='http://bad{i}.net/'>x</a>" for i in range(100))))
    pages += [(99 + i, f"http://a{i}.com/", f"<a href='http://a{i - 1}.com/'>x</a>") for i in range(2, 13)]
    got = {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    # mass that reaches the end of the chain returns to the seeds
    seed = 1 / sum(0.85**i for i in range(13))
    assert got[111]["verdict"] == "block"
    assert got[111]["distrust"] == pytest.approx(100 * seed * 0.85**12, abs=2e-3)
    assert got[0]["distrust"] == pytest.approx(seed, abs=2e-3)
