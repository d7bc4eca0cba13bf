"""Operator 10: whole texts across wrappers and articles, long and deep pages, ties."""

import time

from ascribe.llm import html

LONG = "One long paragraph, with a comma, and then some more words to read."


def test_wrapper_rows_keep_every_part():
    row = "<div class=row><div class=col><div><p>{}</p><p>{}</p></div></div></div>"
    parts = [f"{LONG} {k}" for k in range(4)]
    page = "<nav><a href=x>menu</a></nav>" + row.format(*parts[:2]) + row.format(*parts[2:]) + "<div class=footer>foot</div>"
    assert html.main_text(page) == "\n".join(parts)
    # a list of links beside the wrapper stops the climb
    links = "<div>" + "<a href=x>another page of this site</a> " * 5 + "</div>"
    assert html.main_text(f"<div><div><div><p>{LONG}</p><p>{LONG}</p></div></div></div>{links}") == f"{LONG}\n{LONG}"


def test_articles_side_by_side_are_kept():
    page = f"<main><article><p>{LONG} 1</p></article><article><p>{LONG} 2</p></article></main>"
    assert html.main_text(page) == f"{LONG} 1\n{LONG} 2"
    card = "<article><p><a href=x>Read the next story, now, here</a></p></article>"
    assert html.main_text(f"<article><p>{LONG}</p></article>{card}") == LONG


def test_equal_scores_go_to_the_first():
    root = html.parse(f"<section><p>{LONG}</p></section><section><p>{LONG}</p></section>")
    html.settle(root)
    assert html.text_of(root) == f"{LONG}\n{LONG}"


def test_deep_and_broken_pages_take_linear_time():
    begin = time.process_time()
    assert html.main_text("<div>x" * 8000).count("x") == 8000
    html.main_text("<span>" * 20_000 + "</b>" * 20_000 + "<p>" * 2000)
    assert html.main_text("<div>" * 30_000 + f"<p>{LONG}</p>") == LONG
    text = " ".join(f"word{k}," for k in range(300_000))
    assert html.main_text(f"<body><div><p>{text}</p></div></body>") == text
    assert time.process_time() - begin < 15
