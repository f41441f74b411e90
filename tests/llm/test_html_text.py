from __future__ import annotations

import re
from html import unescape

import pytest

from basketry.llm.html_text import block_features, default_chain, extract_text, leaf_blocks, main_text
from basketry.llm.html_training import labelled_pages
from tests.conftest import rows

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def chain():
    return default_chain()


def test_held_out_pages(chain):
    right = total = 0
    for html, labels in labelled_pages(150, seed=99):
        blocks = leaf_blocks(html)
        found = chain.label(blocks)
        assert found == chain.decode(block_features(blocks))
        right += sum(labels[b.text] == main for b, main in zip(blocks, found, strict=True))
        total += len(blocks)
    assert total > 2000 and right / total > 0.98


def test_blocks_and_references():
    html = "<body><!-- <p>no</p> --><script>var t='</p><p>no</p>';</script><p>a&amp;b\n &eacute;&nbsp; c<br>d<p>e <b>f</b>g<li>h<li>i<td>j"
    assert [b.text for b in leaf_blocks(html)] == ["a&b é c d", "e fg", "h", "i", "j"]
    assert [b.tags[-1] for b in leaf_blocks(html)] == ["p", "p", "li", "li", "td"]


@pytest.mark.parametrize("html", ["", "   ", "<", "<p", "<p class='", "</div></div>", "<script>never closed", "<!-- open", "&#xD800;<p>&#0;"])
def test_broken_markup(chain, html):
    assert isinstance(main_text(html, chain), str)


def test_viterbi_is_the_best_path(chain):
    from itertools import product

    html, _ = labelled_pages(1, seed=3)[0]
    features = block_features(leaf_blocks(html))[:9]

    def score(path):
        emitted = sum(chain.weights.get(n, 0.0) for names, main in zip(features, path, strict=True) if main for n in names)
        return emitted + sum(chain.moves[a][b] for a, b in zip(path, path[1:], strict=False))

    best = max(product([0, 1], repeat=len(features)), key=score)
    assert [bool(x) for x in best] == chain.decode(features)


def test_given_pages(spark, chain):
    """All pages of the table: the blocks of the article, which these pages mark."""
    found = extract_text(spark.read.parquet(f"{SF}/pages.parquet"), chain)
    texts = {r.page_id: r for r in found.collect()}
    for page in spark.read.parquet(f"{SF}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)</article>", page.html, re.S).group(1)
        blocks = (" ".join(unescape(re.sub(r"</?b>|<br>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        expected = "\n".join(b for b in blocks if b)
        row = texts[page.page_id]
        assert (row.url, row.text, row.n_chars) == (page.url, expected, len(expected))


def test_notices_comments_forms_go(chain):
    html = (
        "<header class=site-header><a href=/>Site name</a></header><div class='cookie-banner'><p>We use cookies here.</p></div>"
        "<div class='article-body'><h1>A river story</h1><p>The river rose in the night, and the village moved up the hill.</p>"
        "<p>All was quiet by morning. Nobody spoke of it.</p></div><aside class=sidebar><h3>Related</h3><ul><li><a href=x>Other</a></ul></aside>"
        "<section id=comments><h3>Comments</h3><div class=comment><p>I disagree with this story, it was never like that.</p></div></section>"
        "<form><label>Email</label><button>Subscribe</button></form><footer>&copy; 2024 Site. All rights reserved.</footer>"
    )
    assert main_text(html, chain).split("\n") == [
        "A river story",
        "The river rose in the night, and the village moved up the hill.",
        "All was quiet by morning. Nobody spoke of it.",
    ]


def test_edges(spark, chain, clashing):
    page = "<article><p>" + "long words of an article, again. " * 3000 + "</p></article>"
    pages = spark.createDataFrame([(1, None, None), (None, "u", ""), (2, "v", page), (2, "v", page)], "page_id bigint, url string, html string")
    found = rows(extract_text(clashing(pages), chain), "page_id", "url", "n_chars")
    assert found == [(None, "u", 0), (1, None, 0), (2, "v", 33 * 3000 - 1), (2, "v", 33 * 3000 - 1)]
    assert extract_text(pages.limit(0), chain).count() == 0


def test_cues_of_all_words():
    """Cues late in a long block count; a word now and then in a long article does not."""
    cues = lambda text: {f for f in block_features(leaf_blocks(f"<p>{text}</p>"))[0] if f.startswith("cue ")}
    assert cues("word " * 70 + "consent to cookies, consent. " * 2) == {"cue consent", "cue cookies"}
    assert cues("word " * 59 + "consent") == {"cue consent"}
    assert cues("consent " + "word " * 400) == set()


RIVER = ["A river story", "The river rose in the night, and the village moved up the hill.", "All was quiet by morning. Nobody spoke of it."]
STORY = f"<h1>{RIVER[0]}</h1><p>{RIVER[1]}</p><p>{RIVER[2]}</p>"
# Layouts that no rule of the training pages makes.
LAYOUTS = {
    "a blog with comments in main": (
        f"<main><article class='post hentry'><header class=entry-header><h1 class=entry-title>{RIVER[0]}</h1></header><div class=entry-content><p>{RIVER[1]}</p><p>{RIVER[2]}</p></div>"
        "<footer class=entry-footer>Posted in News. Tagged rivers</footer></article><div id=comments class=comments-area><h2 class=comments-title>2 thoughts on rivers</h2>"
        "<ol class=comment-list><li class=comment><article class=comment-body><footer class=comment-meta><div class=comment-author><b class=fn>Bob</b> <span class=says>says:</span></div>"
        "</footer><div class=comment-content><p>I was there that night, and the water was not high at all.</p></div></article></li></ol></div></main>"
    ),
    "hidden text": f"<article>{STORY}<div hidden><p>This paragraph is hidden from every reader of the page.</p></div><p style='display:none'>So is this one, by its style.</p></article>",
    "a script with a slash": f"<script/>var x = 1;</script><article>{STORY}</article>",
    "a news page with threads": (
        f"<div class=page><div id=header><a href=/>Daily</a></div><div class=story-body>{STORY}</div><div class=discussion-thread><div class='thread-comment user-comment'>"
        "<span class=author>Eve wrote:</span><p>The mayor should have warned us, as in the year before.</p></div></div><div id=footer>Daily, all rights reserved.</div></div>"
    ),
    "a page builder": (
        f"<div class='elementor-widget'><ul class=nav-menu><li><a href=a>Start</a><li><a href=b>Shop</a></ul></div><section class='post-content widget-theme'>{STORY}</section>"
        "<div class='cookie-notice-container' role=dialog>We use cookies. <button>OK</button></div><div class='related-posts'><h4>You may also like</h4><a href=c>A hill story</a></div>"
    ),
    "tables for layout": f"<table><tr><td class=menu><a href=a>Home</a><br><a href=b>News</a></td><td class=content>{STORY}</td></tr></table><p class=copyright>© 1999 Village</p>",
    "an article that holds its comments": (
        f"<article id=post-9>{STORY}<p class=post-meta>Filed under Water, Villages</p><section class=comments><h3>3 Comments</h3><div class='comment odd'><cite>Ann says:</cite>"
        "<p>A fine story. My grandfather told it the same way.</p></div></section></article>"
    ),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(chain, name):
    assert main_text(f"<!DOCTYPE html><html><body>{LAYOUTS[name]}</body></html>", chain).split("\n") == RIVER


def test_deep_pages_take_time_in_proportion(chain):
    from time import process_time

    def seconds(n):
        page = "<div class=c>x" * n
        start = process_time()
        assert main_text(page, chain) is not None
        return process_time() - start

    seconds(500)
    small, large = min(seconds(4000) for _ in range(2)), min(seconds(16000) for _ in range(2))
    assert large < 9 * small + 0.2
    nested = "<p><table>" + "<div id=a>y" * 8000
    start = process_time()
    leaf_blocks(nested)
    assert process_time() - start < 3
