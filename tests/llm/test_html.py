"""Main text against an independent parser, on held-out layouts, on odd markup, and in linear time."""

import random
import re
import time
from html.parser import HTMLParser

import numpy as np
import pyarrow.parquet as pq
import pytest

from helicase.llm import html_text

ARTICLE = "<h1>A title here</h1><p>First paragraph with quite a few words in it.</p><p>Second one, as long as the first or longer.</p>"
TEXT = "A title here\nFirst paragraph with quite a few words in it.\nSecond one, as long as the first or longer."


class ArticleText(HTMLParser):
    """The blocks inside article elements, as the standard library reads them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.out, self.parts = 0, [], []

    def flush(self):
        text = re.sub(r"\s+", " ", "".join(self.parts)).strip()
        if text:
            self.out.append(text)
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag in html_text.BLOCKS:
            self.flush()
        self.parts.append(" " if tag == "br" else "")
        self.open += tag == "article"

    def handle_endtag(self, tag):
        if tag in html_text.BLOCKS:
            self.flush()
        self.open -= tag == "article"

    def handle_data(self, data):
        if self.open:
            self.parts.append(data)


def test_pages_of_the_tables(sf_dir):
    """On these, the main text is what lies in the article."""
    tree = html_text.trained()
    for html in pq.read_table(f"{sf_dir}/pages.parquet", columns=["html"])["html"].to_pylist():
        p = ArticleText()
        p.feed(html)
        p.close()
        p.flush()
        assert html_text.main_text(html, tree) == "\n".join(p.out)


def test_query_against_the_standard_parser(spark, sf_dir):
    from helicase.llm import queries

    got = {r["page_id"]: r for r in queries.QUERIES["op7_html_text"](spark, sf_dir).collect()}
    rows = pq.read_table(f"{sf_dir}/pages.parquet").to_pylist()
    assert len(got) == len(rows)
    for r in rows:
        p = ArticleText()
        p.feed(r["html"])
        p.close()
        p.flush()
        out = got[r["page_id"]]
        assert (out["url"], out["text"], out["n_chars"]) == (r["url"], "\n".join(p.out), len("\n".join(p.out)))


def layouts(n, seed):
    """Pages of other layouts than the labelled table's, without articles, names or other tags with a meaning: tables, columns, bare bodies."""
    rnd = random.Random(seed)
    vocabulary = "harbour winter the of and letters engine slowly a stone market seven boats river to with glass carried against morning field iron it were opened road".split()
    say = lambda a, b: " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(a, b)))
    for _ in range(n):
        marks = []

        def put(markup, *labels, marks=marks):
            marks.extend(labels)
            return markup

        links = lambda k, put=put: "".join(put(f"<td><a href=x>{say(1, 2)}</a></td>", False) for _ in range(k))
        prose = lambda k, put=put: "".join(put(f"<p>{say(25, 110)}.</p>", True) if rnd.random() < 0.8 else put(f"<h2>{say(2, 6)}</h2>", True) for _ in range(k))
        kind = rnd.choice(("table", "columns", "bare"))
        if kind == "table":
            body = "<table><tr>" + links(rnd.randint(3, 7)) + "</tr></table><table><tr><td>" + put(f"<h1>{say(3, 8)}</h1>", True) + prose(rnd.randint(3, 9)) + "</td><td>"
            body += "".join(put(f"<p><a href=y>{say(2, 6)}</a></p>", False) for _ in range(rnd.randint(2, 6))) + "</td></tr></table>" + put(f"<center>{say(3, 9)}</center>", False)
        elif kind == "columns":
            body = "<div><div>" + "".join(put(f"<p><a href=y>{say(1, 4)}</a></p>", False) for _ in range(rnd.randint(3, 9))) + "</div><div>" + put(f"<h1>{say(3, 8)}</h1>", True)
            body += prose(rnd.randint(3, 9)) + "</div></div><div>" + put(f"<p>{say(2, 6)} <a href=z>{say(2, 4)}</a></p>", False) + "</div>"
        else:
            body = "<ul>" + "".join(put(f"<li><a href=y>{say(1, 3)}</a></li>", False) for _ in range(rnd.randint(3, 8))) + "</ul>" + put(f"<h1>{say(3, 8)}</h1>", True) + prose(rnd.randint(3, 9))
            body += "<div>" + put(f"<a href=y>{say(1, 3)}</a> {say(1, 4)}", False) + "</div>"
        yield f"<html><body>{body}</body></html>", marks


def test_held_out_layouts_without_names_or_articles():
    tree, right, n = html_text.trained(), 0, 0
    for html, labels in layouts(300, 5):
        page = html_text.parsed(html)
        assert len(page.blocks) == len(labels)
        right += int((tree.predict(html_text.features(page)) == np.array(labels)).sum())
        n += len(labels)
    assert right >= 0.95 * n


def test_held_out_pages_of_the_labelled_kind():
    tree, right, n = html_text.trained(), 0, 0
    for html, labels in html_text.labelled_pages(200, seed=12):
        right += int((tree.predict(html_text.features(html_text.parsed(html))) == np.array(labels)).sum())
        n += len(labels)
    assert right >= 0.98 * n


def test_the_tree_asks_for_words_and_link_densities_first():
    tree = html_text.trained()

    def upper(node, depth):
        what = tree.nodes[node]
        if depth < html_text.SHALLOW_DEPTH and not isinstance(what, bool):
            yield what[0]
            yield from upper(what[2], depth + 1)
            yield from upper(what[3], depth + 1)

    asked = set(upper(0, 0))
    assert max(asked) < html_text.SHALLOW
    assert {"link_density", "link_density_before", "link_density_after", "words_after"} <= {html_text.FEATURES[f] for f in asked}


FRAME = "<body><ul><li><a href=/>Home</a><li><a href=/a>About us</a></ul>{}<footer>Some words below</footer></body>"


@pytest.mark.parametrize(("page", "text"), [
    (f"<article class='post tags-science'>{ARTICLE}</article>", TEXT),
    (f"<article>{ARTICLE}<div class='social-history'><h2>Social history</h2><p>A part of the article on how people lived then.</p></div></article>", TEXT + "\nSocial history\nA part of the article on how people lived then."),
    ("<article><h1>It</h1><p title=it's>first paragraph has words</p><p>it's second</p></article>", "It\nfirst paragraph has words\nit's second"),
    (f"<article>{ARTICLE[:21]}<button>Buy{ARTICLE[21:]}</article>", TEXT),
    (f"<article>{ARTICLE}<!-- > <p>not shown</p> --><p>After &lt;it&gt; &amp; so&nbsp;on</p></article>", TEXT + "\nAfter <it> & so on"),
    (f"<article><!--> --->{ARTICLE[:21]}<p data-x=\"a > b\">First paragraph with quite a few words in it.</p>{ARTICLE[21 + 52:]}</article>", None),
])
def test_odd_markup(page, text):
    got = html_text.main_text(FRAME.format(page), html_text.trained())
    if text is None:
        assert "First paragraph with quite a few words in it." in got.split("\n")
    else:
        assert got == text


@pytest.mark.parametrize("unit", ["<a ", "<a href='", "<!", "<", "</", "<head>", "<div>", "</div>", "<div class=ad>x", "<button>", "<select>", "<p title=\"> \" x", "<svg><p>", "x</p></li>"])
def test_time_is_linear(unit):
    def took(n):
        began = time.perf_counter()
        html_text.parsed(unit * n)
        return time.perf_counter() - began

    took(2000)
    assert took(32000) < max(1.5, 20 * took(4000))


def test_edges(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "Only words, no tags at all", None), (3, "Only words, no tags at all", None), (None, "<p>" + "long text " * 200_000, "c")], "page_id long, html string, text string")
    got = sorted((r["page_id"] or 0, len(r["text"])) for r in html_text.extract_text(df).collect())
    assert got == [(0, 1_999_999), (1, 0), (2, 0), (3, 26), (3, 26)]
    assert html_text.extract_text(df.limit(0)).count() == 0
