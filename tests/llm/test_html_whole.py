"""No article text is lost on pages without an article element, or in wrappers."""

from __future__ import annotations

import random

import pytest

from spanforge.llm.html_extract import block_sums, extract, lines, main_text, stretches

LONG, TAIL = "long text " * 100, "closing section " * 13
STORY = f"<p>{LONG}</p><p>Second.</p><p>{TAIL}</p>"
WANT = "\n".join((LONG.strip(), "Second.", TAIL.strip()))


def test_far_and_light_stretches_stay():
    gap = "".join(f"<div class='advert'>Buy {i}</div>" for i in range(6))
    assert main_text(f"<p>{LONG}</p>{gap}<p>{TAIL}</p>") == f"{LONG.strip()}\n{TAIL.strip()}"
    items = [f"item {i} of a short list" for i in range(12)]
    assert main_text(f"<p>{LONG}</p><ul>{''.join(f'<li>{x}' for x in items)}</ul><p>{TAIL}</p>") == "\n".join([LONG.strip(), *items, TAIL.strip()])
    verse = [f"line {i}" for i in range(20)]
    assert main_text(f"<p>{LONG}</p>{''.join(f'<p>{x}</p>' for x in verse)}<p>{TAIL}</p>").split("\n")[1:-1] == verse


@pytest.mark.parametrize("opened", ["<div class='content has-sidebar'>", "<div class='no-sidebar'>", "<div id='page_with_comments'>", "<form>", "<div class='layout-sidebar'>", "<form><div class='header-page'>"])
def test_wrappers_hold_the_article(opened):
    menu, aside = "<nav>Home</nav><div class='comments'>Reader " + "says " * 900 + "</div>", "<div class='sidebar'>Aside</div>"
    for story in (STORY, f"<article>{STORY}</article>"):
        assert main_text(f"<body>{menu}{opened}{story}{aside}</body>") == WANT


def test_other_parts_stay_out():
    for part in ("<aside>{}</aside>", "<div class='comments-area'>{}</div>", "<div class='site-footer'>{}</div>", "<div class='related'><article>{}</article></div>", "<form>{}</form>", "<div hidden>{}</div>"):
        assert main_text(STORY + part.format("Other words " * 20)) == WANT


def test_a_small_article_element_does_not_hide_the_text():
    card = "<article>A teaser card</article>"
    assert main_text(card + STORY) == "A teaser card\n" + WANT and main_text(f"<main>{STORY}</main><p>{TAIL}</p>") == WANT


LINKS = "<ul>" + "".join(f"<li><a href='/{i}'>Another page {i}</a></li>" for i in range(8)) + "</ul>"


@pytest.mark.parametrize("page", ["<body>{0}{1}{0}</body>", "<body><article>{0}{1}{0}</article></body>", "<body><main>{0}{1}{0}</main><footer>x</footer></body>", "<div>{0}</div><div>{1}</div><div>{0}</div>"])
def test_windows_cut_what_no_mark_tells(page):
    """Lists of links before the first surge and after the last dive are cut, with and without semantic tags; those within stay."""
    middle = STORY + "<p><a href='/x'>A line that is a link</a></p>" + STORY
    want = f"{WANT}\nA line that is a link\n{WANT}"
    assert main_text(page.format(LINKS, middle)) == want
    unmarked = "\n".join(text for text, other, _, _ in lines(page.format(LINKS, middle)) if not other)
    assert unmarked.count("Another page") == 16 and want in unmarked  # without the windows all of it would stay


def test_light_lines_far_from_the_text_are_cut():
    assert main_text(f"<div>Home</div><div>12 May</div><div>Tools</div><div>Print</div>{STORY}") == "Tools\nPrint\n" + WANT  # the window of the first surge holds two of them
    assert main_text("<p>one</p><p>two</p>") == "one\ntwo" and main_text(LINKS).startswith("Another page 0")


def test_sums_and_points_equal_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        weights, window = [rng.choice((0, 0, 5, 40, 200)) for _ in range(rng.randrange(12))], rng.randrange(1, 5)
        sums = block_sums(weights, window)
        assert sums == [sum(weights[i : i + window]) for i in range(len(weights))]
        inside = {i for a, b in stretches(sums, 60) for i in range(a, b)}
        assert inside == {i for i, x in enumerate(sums) if x >= 60}


def test_tables(spark):
    kind = "page_id bigint, url string, html string, text string, n_chars string, lines int"
    assert extract(spark.createDataFrame([], kind)).collect() == []
    big = "<article>" + "<p>A long page of words, again.</p>" * 100_000 + "</article>"
    rows = [(1, "u", big, "x", "y", 1), (2, None, None, None, None, None), (3, "u", "", "x", "y", 1), (None, "u", "<p>Text", "x", "y", 2), (1, "u", big, "x", "y", 1)]
    got = sorted(map(tuple, extract(spark.createDataFrame(rows, kind)).collect()), key=lambda r: (r[0] or 0, r[3]))
    text = "\n".join(["A long page of words, again."] * 100_000)
    assert got == [(None, "u", "Text", 4), (1, "u", text, len(text)), (1, "u", text, len(text)), (2, None, "", 0), (3, "u", "", 0)]
