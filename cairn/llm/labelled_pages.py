"""Small labelled pages for the block classifier.

{n} stands for n words.  A block that starts with § is main text, one that
starts with ~ is of a kind that words and links can't tell (comments, boxes
inside an article), so it is a neighbour but no example.  All else is not
main text.  TRAINING makes the labelled table; HELD_OUT measures the tree.
"""

from __future__ import annotations

import re


def links(*words: int) -> str:
    return "<ul>" + "".join(f"<li><a href='/x'>{{{n}}}</a></li>" for n in words) + "</ul>"


def paragraphs(*words: int) -> str:
    return "".join(f"<p>§{{{n}}}</p>" for n in words)


def filled(page: str) -> str:
    return re.sub(r"\{(\d+)\}", lambda m: " ".join(["word"] * int(m[1])), page)


TRAINING = [
    # menu, advert, article, foot line
    f"<nav>{links(1, 1, 1, 1, 1, 1)}</nav><div>{{9}}</div><article><h1>§{{10}}</h1>{paragraphs(10, 26, 55, 3, 1, 97)}</article><footer>{{13}}</footer>",
    f"<nav>{links(1, 1, 1, 1)}</nav><div>{{4}}</div><article><h1>§{{1}}</h1>{paragraphs(1, 4, 140, 9, 30, 2)}</article><footer>{{7}}</footer>",
    f"<nav>{links(1, 2, 1, 1, 1)}</nav><div>{{13}}</div><article><h1>§{{24}}</h1>{paragraphs(24, 7, 60, 210, 12, 5)}</article><footer>{{16}}</footer>",
    f"<nav>{links(2, 1, 3)}</nav><div>{{22}}</div><article><h1>§{{14}}</h1>{paragraphs(12, 80, 2, 45)}</article><footer>{{30}}</footer>",
    f"<nav>{links(1, 1, 1, 1)}</nav><div>{{6}}</div><article><h1>§{{3}}</h1>{paragraphs(2200)}</article><footer>{{9}}</footer>",
    f"<nav>{links(1, 1)}</nav><div>{{11}}</div><article><h1>§{{8}}</h1>{paragraphs(6)}</article><footer>{{14}}</footer>",
    # the same with many short paragraphs next to long ones
    f"<nav>{links(1, 1, 1, 1, 1)}</nav><div>{{10}}</div><article><h1>§{{9}}</h1>{paragraphs(9, 1, 40, 1, 2, 1, 75, 2, 1, 150, 3, 33, 1, 5)}</article><footer>{{12}}</footer>",
    f"<nav>{links(1, 1, 1, 1)}</nav><div>{{7}}</div><article><h1>§{{1}}</h1>{paragraphs(1, 3, 1, 90, 4, 260, 1, 62, 5, 5, 1, 118, 2, 47, 3, 1)}</article><footer>{{10}}</footer>",
    f"<div>{{8}}</div><h2>§{{4}}</h2>{paragraphs(54, 2, 38, 1, 4, 83, 3, 71, 5, 2, 1, 66, 4, 95)}<footer>{{9}}</footer>",
    # site name, menu, heading at once, foot lines
    f"<header><div>{{2}}</div>{links(1, 1, 2, 1)}</header><h1>§{{7}}</h1>{paragraphs(62, 48, 90, 34)}<footer>{{12}} {{5}}</footer>",
    f"<div>{{3}}</div>{links(1, 1, 1)}<h1>§{{5}}</h1>{paragraphs(40, 71, 120)}<div>{{6}}</div>",
    f"{links(1, 2, 1, 4)}<h2>§{{9}}</h2>{paragraphs(85, 33, 51)}{links(1, 1, 2)}<div>{{8}}</div>",
    # related links and bread crumbs
    f"<div><a href='/'>{{1}}</a> <a href='/a'>{{2}}</a> {{1}}</div><h1>§{{8}}</h1>{paragraphs(70, 44, 29, 66)}<h3>{{2}}</h3>{links(8, 6, 9)}<footer>{{10}}</footer>",
    f"{links(1, 1, 1)}<div>{{7}}</div><h1>§{{12}}</h1>{paragraphs(15, 38, 77)}<div>{{3}} <a href='/t'>{{4}}</a></div>{links(7, 9)}<footer>{{11}} <a href='/i'>{{2}}</a></footer>",
    # links in the text
    f"<nav>{links(1, 1, 1)}</nav><div>{{8}}</div><h1>§{{6}}</h1><p>§{{30}} <a href='/x'>{{4}}</a> {{20}}</p><p>§{{12}} <a href='/y'>{{3}}</a></p>{paragraphs(25, 60)}<footer>{{15}}</footer>",
    # text and nothing else
    f"<h1>§{{6}}</h1>{paragraphs(65, 110, 82)}",
    paragraphs(180, 95),
    f"{paragraphs(75, 8, 64, 90)}<div>{{9}}</div>",
    f"<h1>§{{5}}</h1>{paragraphs(120, 66)}",
    f"<h2>§{{8}}</h2>{paragraphs(45, 74, 240)}",
    f"{paragraphs(52, 105)}",
    # text that ends before a list of links
    f"<h1>§{{7}}</h1>{paragraphs(84, 57, 46)}{links(6, 8, 5)}",
    f"<h1>§{{11}}</h1>{paragraphs(40, 92, 63)}{links(9, 4)}<footer>{{10}}</footer>",
    f"{links(1, 1)}<h1>§{{6}}</h1>{paragraphs(72, 38, 80)}{links(2, 3, 1)}<div>{{6}}</div>",
    f"{links(1, 1, 2)}<div>{{3}}</div>{links(4, 5)}<h1>§{{9}}</h1>{paragraphs(66, 49)}<div>{{2}}</div>{links(7)}<footer>{{8}}</footer>",
    # short notes and lists in an article, boxes and words around it
    f"<div>{{2}}</div><nav>{links(1, 1)}</nav><article><h1>§{{1}}</h1>{paragraphs(3, 3)}</article><div>{{4}}</div><footer>{{6}}</footer>",
    f"<div>{{3}}</div><article><h2>§{{2}}</h2>{paragraphs(4)}</article><p>{{8}}</p>{links(1, 2, 1)}",
    f"<article><h1>§{{3}}</h1>{paragraphs(20, 5)}<ul><li>§<a href='/s'>{{4}}</a></li><li>§<a href='/t'>{{6}}</a></li></ul></article><p>{{30}}</p><p>{{12}}</p>",
    f"<p>{{25}}</p>{links(1, 1, 1)}<main><h1>§{{4}}</h1>{paragraphs(2, 60)}<ol><li>§{{3}}</li><li>§{{9}}</li></ol></main><div>{{14}}</div><p>{{40}}</p>",
    f"<div>{{1}}</div><div><p>{{6}}</p></div><article><p>§<a href='/a'>{{5}}</a></p>{paragraphs(8, 1)}</article><div>{{3}} <a href='/m'>{{2}}</a></div>",
    *[f"<nav>{links(1, 2)}</nav><article><h1>§{{{a}}}</h1>{paragraphs(*rest)}</article>{after}" for a, rest, after in (
        (2, (6, 4), "<div>{5}</div>"), (1, (9,), ""), (4, (12, 3, 5), "<p>{20}</p><footer>{6}</footer>"), (3, (40, 2), ""), (5, (7, 22, 8), "<div>{2}</div>"), (2, (3, 1, 2), "<footer>{9}</footer>"),
        (6, (15,), "<p>{18}</p>"), (1, (5, 30, 4), ""), (3, (70, 6), "<footer>{4} <a href='/i'>{1}</a></footer>"), (2, (11, 1), ""), (7, (25, 9), "<div>{7}</div>"), (4, (2,), ""),
    )],
    f"<nav>{links(1, 1)}</nav><article><h1>§{{4}}</h1>{paragraphs(35)}<ul><li>§<a href='/1'>{{3}}</a></li><li>§<a href='/2'>{{2}}</a></li><li>§<a href='/3'>{{5}}</a></li></ul>{paragraphs(4)}</article><footer>{{8}}</footer>",
    f"<article><h1>§{{2}}</h1><p>§<a href='/1'>{{2}}</a></p><p>§<a href='/2'>{{7}}</a> {{2}}</p>{paragraphs(14)}<ul><li>§<a href='/3'>{{1}}</a></li><li>§<a href='/4'>{{1}}</a></li></ul></article>{links(1, 1, 4)}",
    *[f"<article><h1>§{{{a}}}</h1>{paragraphs(b)}<h2>§{{{c}}}</h2><ul><li>§<a href='/1'>{{{d}}}</a></li><li>§<a href='/2'>{{4}}</a></li></ul></article>{after}" for a, b, c, d, after in (
        (3, 60, 1, 5, "<footer>{7}</footer>"), (6, 12, 2, 1, ""), (2, 33, 3, 8, "<p>{11}</p>"), (5, 90, 1, 3, ""), (4, 8, 4, 2, "<div>{3}</div>"),
    )],
    # boxes between paragraphs
    f"<nav>{links(1, 1)}</nav><div>{{10}}</div><h1>§{{9}}</h1>{paragraphs(50, 31)}<aside>~{{14}}</aside>{paragraphs(44, 58)}<footer>{{12}}</footer>",
    f"<nav>{links(1, 1, 1)}</nav><div>{{5}}</div><h1>§{{7}}</h1>{paragraphs(36, 90, 22)}<section id='comments'><p>~{{25}}</p><p>~{{60}}</p></section><footer>{{13}}</footer>",
]

HELD_OUT = [
    f"<div>{{4}}</div><article><h1>§{{2}}</h1>{paragraphs(5, 2, 7)}</article><p>{{16}}</p><footer>{{3}}</footer>",
    f"<header><div>{{2}}</div></header><main>{paragraphs(90, 12)}<ul><li>§<a href='/q'>{{3}}</a></li></ul></main><div>{{50}}</div>",
    f"<nav>{links(1, 1, 1, 2)}</nav><div>{{8}}</div><article><h1>§{{11}}</h1>{paragraphs(11, 43, 5, 160, 18)}</article><footer>{{11}}</footer>",
    f"<nav>{links(1, 1, 1, 1, 1)}</nav><div>{{12}}</div><article><h1>§{{2}}</h1>{paragraphs(2, 1, 37, 400, 6, 9)}</article><footer>{{15}}</footer>",
    f"<header><p>{{4}}</p>{links(1, 1, 1)}</header><h1>§{{6}}</h1>{paragraphs(58, 39, 101)}<footer>{{18}}</footer>",
    f"{links(1, 3, 2)}<h1>§{{10}}</h1>{paragraphs(77, 52, 27, 69)}{links(5, 7, 6, 8)}<footer>{{9}}</footer>",
    f"<h1>§{{4}}</h1>{paragraphs(88, 54, 130)}",
    f"<div><a href='/'>{{1}}</a> <a href='/b'>{{1}}</a></div><h1>§{{9}}</h1><p>§{{40}} <a href='/z'>{{5}}</a> {{22}}</p>{paragraphs(35, 61)}<div>{{10}}</div>",
]
