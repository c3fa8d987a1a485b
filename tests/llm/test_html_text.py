import html
import re

import numpy as np
import pytest

from chainframes.llm import html_text as H
from chainframes.llm.queries import QUERIES

TREE = H.learn_tree(*H.labelled_blocks())


def text(page):
    blocks = H.blocks_of(page)
    return "\n".join(b.text for b, keep in zip(blocks, TREE.predict(H.features(blocks)), strict=True) if keep) if blocks else ""


LONG = "This is a paragraph of ordinary length that says one thing or another about the matter at hand."


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""),
        ("", ""),
        (" \n ", ""),
        ("<html><head><title>No</title></head><body></body></html>", ""),
        ("<article><h1>T&eacute;st &amp; more</h1><p>One.<p>Two</article>", "Tést & more\nOne.\nTwo"),
        ("<article><p>a<b>b</b>c <i>d</i>\n\t e&nbsp;f</p></article>", "abc d e f"),
        ("<article><p>x &lt;b&gt; &#65; &#x42; &am &amp</p></article>", "x <b> A B &am &"),
        ("<article><p>one<br>two</p><p></p><p>three</p></article>", "one two\nthree"),
        ("<article><p>in</p><script>var t='</p></article>';</script><style>p{}</style><!-- <p>no</p> --><p>on</p></article>", "in\non"),
        ("<article><p>in</p><div class='comments'><p>no</p></div><aside>no</aside><form><p>no</p></form><p>on</p></article>", "in\non"),
        ("<article><p>in</p><p class=\"ad-slot\">no</p><p title=\"a > b\">on</p></article><footer>no", "in\non"),
        ("<nav><ul><li><a href=x>Home</a></ul><article><p>Yes.</p></article>", "Yes."),
        (f"<div id=nav><a>Home</a></div><p>{LONG}</p><p>{LONG}</p><div><a href=x>More of this</a></div>", f"{LONG}\n{LONG}"),
        ("<article><p>a</div><p>b</p></article><div>no</div>", "a\nb"),
        ("<ARTICLE><P>Big</P></ARTICLE><FOOTER>no</FOOTER>", "Big"),
        ("<article><p>cut off <b", "cut off <b"),
        ("<article><ul><li>x<li><a href=y>y</a></ul><table><tr><td>1<td>2</table></article>", "x\ny\n1\n2"),
    ],
)
def test_pages(page, want):
    assert text(page) == want


def test_the_tree_fits_its_table_and_keeps_to_articles():
    x, y = H.labelled_blocks()
    assert (TREE.predict(x) == y).mean() > 0.99 and 300 < len(x) < 2000
    rng = np.random.default_rng(0)
    n = 5000
    body = np.column_stack([rng.integers(1, 80, n), rng.random(n), rng.integers(0, 80, n), rng.random(n), rng.integers(0, 80, n), rng.random(n)]).astype(float)

    def kept(near, tagged, named, inside, has):
        rest = np.tile([near, tagged, named, inside, has, 0], (n, 1)).astype(float)
        return TREE.predict(np.hstack([body, rest])).mean()

    assert kept(1, 0, 0, 1, 1) == 1 and kept(0, 0, 0, 0, 1) == 0 and kept(-1, 1, 1, 0, 0) == 0 and kept(-1, 0, 1, 1, 1) == 0


def test_a_tree_learns_more_than_one_split():
    rng = np.random.default_rng(1)
    x = rng.random((500, 3))
    y = (x[:, 0] > 0.3) & (x[:, 2] < 0.6)
    tree = H.learn_tree(x, y, depth=4)
    assert (tree.predict(x) == y).mean() > 0.98
    assert H.learn_tree(x, np.zeros(500, bool)).predict(x).sum() == 0


def test_every_page_against_its_article(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    out = QUERIES["op12_extract"](spark, sf).collect()
    assert len(out) == len(pages)
    for r in out:
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id].html, re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]+>", "", s)).split()) for s in re.split(r"</?(?:p|h1|br)[^>]*>", article))
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_nulls_repeats_extra_columns_and_long_pages(spark):
    long = "<article>" + "<p>word <a href=x>link</a></p>" * 50_000 + "</article>"
    rows = [(1, None, None, "x"), (1, "u", "<p>", "x"), (None, "u", "<article>a</article>", "x"), (None, "u", "<article>a</article>", "x"), (2, "u", long, "x"), (3, "u", "<" * 200_000, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string").selectExpr("*", "1 AS n_chars")
    got = H.extract_text(df).collect()
    assert H.extract_text(df).columns == ["page_id", "url", "text", "n_chars"]
    assert [(r.page_id, r.url, r.text) for r in got if (r.page_id or 0) < 2] == [(1, None, ""), (1, "u", ""), (None, "u", "a"), (None, "u", "a")]
    assert [r.n_chars for r in got if r.page_id == 2] == [50_000 * 10 - 1]
    assert H.extract_text(df.limit(0)).count() == 0
