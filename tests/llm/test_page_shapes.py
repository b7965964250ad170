"""Pages of any shape in time that grows with their length, and articles inside forms, headers and sidebars."""

import time

import pytest

from attestra.llm.main_text import main_text

ARTICLE = "<p>%s</p><p>%s</p>" % ("One long paragraph, with commas, and many words. " * 5, "Another long one, also here, goes on. " * 6)
TEXT = "%s\n%s" % (("One long paragraph, with commas, and many words. " * 5).strip(), ("Another long one, also here, goes on. " * 6).strip())

SHAPES = {
    "tags that never end": "<a " * 350_000, "ends without a beginning": "<div>" * 90_000 + "</p>" * 90_000, "open inline tags": "<span>" * 75_000 + "<p>x" * 75_000,
    "inline ends out of their block": "<b><div>" + "<span>" * 75_000 + "</b>" * 75_000, "items far below their list": "<ul><li><ul>" + "<div>" * 75_000 + "<li>" * 75_000,
    "declarations": "<!" * 500_000, "ends inside quotes": '<a x=">" ' * 110_000, "cells": "<table><tr><td>" * 30_000 + "<td>" * 60_000, "closing marks": "</" * 500_000,
    "boxes in boxes": "<div class=ad>" * 40_000 + "x" * 30_000, "many names": "".join(f"<x{i}>" for i in range(60_000)) + "".join(f"</y{i}>" for i in range(60_000)), "headers": "<header>" * 90_000 + ARTICLE,
}


@pytest.mark.parametrize("shape", SHAPES)
def test_a_megabyte_of(shape):
    began = time.process_time()
    main_text(SHAPES[shape])
    assert time.process_time() - began < 10


@pytest.mark.parametrize("tag", ["form id=aspnetForm", "header", "aside", "div class=comments", "form><form"])
def test_a_box_that_holds_the_page(tag):
    name = tag.split()[0].split(">")[0]
    page = f"<body><{tag}><div class=top><a href=x>home</a></div><div>{ARTICLE}<label>Name</label><input><button>Go</button><select><option>a</select></div></{name}></body>"
    assert main_text(page) == TEXT


@pytest.mark.parametrize("tag", ["form", "header", "aside", "div class=sidebar"])
def test_a_box_beside_the_article(tag):
    box = f"<{tag}><p>Some text that is not of the article, though it is long enough to be a paragraph of one, or two.</p></{tag.split()[0]}>"
    assert main_text(f"<body>{box}<div>{ARTICLE}</div>{box}</body>") == TEXT
    assert main_text(f"<body><article>{box}{ARTICLE}</article></body>") == TEXT


def test_quotes_that_hide_the_end():
    assert main_text(f'<div title=">{ARTICLE}</div>') == main_text(f"<div>{ARTICLE}</div>")
    assert main_text(f'<p x="a>b">{ARTICLE}') == TEXT
