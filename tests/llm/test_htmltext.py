"""The block classifier: its features, its tree, and whole pages against their marked articles."""

import html
import re

import numpy as np

from cairn.llm import htmltext, labelled_pages

TABLE = htmltext.labelled_table([labelled_pages.filled(p) for p in labelled_pages.TRAINING])


def test_features_by_hand():
    page = "<ul><li><a href='x'>one two</a></li><li><a>three</a></li></ul><p>a b c <a>d</a></p><div></div><p>e</p>"
    words, linked = [2, 1, 4, 1], [2, 1, 1, 0]
    want = []
    for i in range(4):
        row = []
        for j in (i, i - 1, i + 1):
            row += [words[j], linked[j] / words[j]] if 0 <= j < 4 else [0, 0]
        want.append([*row, htmltext.NO_ARTICLE])
    assert htmltext.features(htmltext.blocks(page)).tolist() == want


def test_tree_decides_by_words_and_links():
    nodes = htmltext.train(TABLE)
    used = {htmltext.FEATURES[int(n[0])] for n in nodes if n[0] >= 0}
    assert {"words", "link_density", "prev_link_density", "next_words", "next_link_density"} <= used
    held = htmltext.labelled_table([labelled_pages.filled(p) for p in labelled_pages.HELD_OUT])
    right = htmltext.classify(nodes, held[:, :-1]) == held[:, -1]
    assert len(held) > 50 and right.mean() > 0.97
    # All rows at once and one at a time give the same.
    for x, label in zip(TABLE[:, :-1], htmltext.classify(nodes, TABLE[:, :-1])):
        at = 0
        while nodes[at][0] >= 0:
            at = nodes[at][2] if x[nodes[at][0]] <= nodes[at][1] else nodes[at][3]
        assert nodes[at][4] == label


def test_whole_pages_against_their_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = {}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]+>", "", x)).split()) for x in re.split("</?(?:p|h1)>", article)]
        want[r.page_id] = "\n".join(x for x in parts if x)
    got = htmltext.extract(pages).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)
    nodes = htmltext.train(TABLE)
    found = [htmltext.blocks(r.html) for r in pages.collect()]
    kept = np.concatenate([htmltext.classify(nodes, htmltext.features(f)) for f in found])
    other = np.concatenate([[b[3] for b in f] for f in found])
    assert not (kept & other).any()  # containers' names decide nothing here


def test_very_long_page_and_elements_that_stay():
    nodes = htmltext.train(TABLE)
    page = "<h1>Title of it</h1>" + "<p>some words of a paragraph that goes on for a while here</p>" * 50_000 + "<p>" + "last words " * 40 + "</p>"
    assert htmltext.main_text(page, nodes).count("\n") == 50_001
    page = "<h1>Title of it</h1><p>let <math>x</math> be <noscript>shown</noscript> and <object>drawn</object> here</p><p>" + "more words " * 30 + "</p>"
    assert "let x be shown and drawn here" in htmltext.main_text(page, nodes)


def test_ordinary_articles_keep_their_text():
    nodes = htmltext.train(TABLE)
    text = lambda page: htmltext.main_text(page, nodes)
    assert text("<article><h1>Note</h1><p>It rained today.</p><p>We stayed home.</p></article>") == "Note\nIt rained today.\nWe stayed home."
    long = " ".join(["word"] * 40)
    page = f"<div>My site</div><article><h1>Title</h1><p class='related-work'>{long}</p><h2>Sources</h2><ul><li><a href='/a'>First source</a></li><li><a href='/b'>Second source</a></li></ul><p>The end.</p></article><p>Leave a reply below and tell us what you think of this.</p>"
    assert text(page) == f"Title\n{long}\nSources\nFirst source\nSecond source\nThe end."
    page = f"<main><h1>Title</h1><p>{long}</p><div class='related-posts'><p>{long}</p></div><div id='comments'><p>{long}</p></div><form><p>{long}</p></form><p>So it was.</p></main>"
    assert text(page) == f"Title\n{long}\nSo it was."
    # Without an article the words and links around a block decide.
    page = f"<ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li></ul><h1>A title of five words</h1><p>{long}</p><p>{long} {long}</p><div>Foot line of some words</div>"
    assert text(page) == f"A title of five words\n{long}\n{long} {long}"
