"""Hosts of mixed templates, attributes, and the time of crafted pages."""

import random
import time

import pytest

from tessera.llm.html_extract import extract, extract_pages

SCHEMA = "page_id long, url string, html string"
LONG = "<p>the story goes on with quite a few words, as stories do</p>" * 3
STORY = " ".join(["the story goes on with quite a few words, as stories do"] * 3)


def texts(spark, pages):
    rows = [(k, "http://one.example/p", page) for k, page in enumerate(pages)]
    got = extract_pages(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(got) == len(rows)
    return [r.text for r in sorted(got, key=lambda r: r.page_id)]


def test_a_page_with_a_second_main_container(spark):
    pages = [f"<body><div class=a>{LONG}</div>"] * 9 + [f"<body><div class=a>{LONG}</div><div class=b>{LONG}</div>"]
    assert texts(spark, pages) == [STORY] * 9 + [f"{STORY} {STORY}"]


def test_a_page_with_a_lead_line_on_the_winning_path(spark):
    pages = [f"<body><div class=a>{LONG}</div>"] * 9 + [f"<body><div class=a>Lead line.</div><div class=story>{LONG}</div>"]
    assert texts(spark, pages) == [STORY] * 9 + [f"Lead line. {STORY}"]


def test_a_small_box_beside_the_winning_path_stays_out(spark):
    pages = [f"<body><div class=a>{LONG}</div>"] * 9 + [f"<body><div class=a>{LONG}</div><div class=box>small</div>"]
    assert texts(spark, pages) == [STORY] * 10


def test_mixed_templates_lose_nothing(spark):
    """Hosts whose pages hold one to three containers of like weight, in any mix, and pages that repeat."""
    r = random.Random(8)
    pages, want = [], []
    for _ in range(60):
        parts = [(f"c{r.randrange(4)}", " ".join(r.choice("abcdef") * r.randint(2, 6) for _ in range(r.randint(20, 30)))) for _ in range(r.randint(1, 3))]
        page = "<body><nav>menu</nav>" + "".join(f"<div class={c}><p>{t}</p></div><div class=ad>buy</div>" for c, t in parts) + "<footer>f</footer>"
        for _ in range(r.choice([1, 1, 4])):
            pages.append(page)
            want.append(" ".join(t for _, t in parts))
    assert texts(spark, pages) == want


@pytest.mark.parametrize(
    "page, text",
    [
        ("<p data-role='sidebar'>one</p><p data-id=ad>two</p><p title='class=ad'>three</p>", "one two three"),
        ("<p title=it's>... don't stop.</p><p>more", "... don't stop. more"),
        ('<p title="a > b">in</p>', "in"),
        ('<p title="unclosed>text</p><p>more', "text more"),
        ("<p class = 'ad'>buy</p><p>in</p>", "in"),
        ("<div/class=ad>buy</div><p>in", "in"),
        ("<p CLASS=AD>buy</p><p alt='x'class=\"ad\">buy</p><p>in", "in"),
        ("<p data-x=class=ad>in", "in"),
        ("<p =class>in", "in"),
    ],
)
def test_attributes(page, text):
    assert extract(page, None) == text


@pytest.mark.parametrize("part", ['<div class="sidebar"><article>', '<div class="sidebar">', '<div class="comments"><article class=ad>', "<article>", '<p a="', "<p =", "<", "<a href='"])
def test_time_of_crafted_pages(part):
    start = time.perf_counter()
    extract(part * 20_000 + "x", None)
    assert time.perf_counter() - start < 20  # far above what it takes, far below what squares take


def test_wrappers_within_wrappers():
    for depth in (1, 2, 7, 40):
        assert extract('<div class="sidebar">' * depth + LONG, None) == STORY
        assert extract('<div class="widget"><div class="page sidebar">' * depth + f"<article>{LONG}</article>", None) == STORY
    assert extract(f'<div class="sidebar"><div class="comments">{LONG}</div><p>own words of the page</p></div>', None) == "own words of the page"


def test_null_and_empty_pages(spark):
    rows = [(None, None, None), (1, None, ""), (1, "u", LONG), (1, "u", LONG)]
    got = extract_pages(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in got) == sorted([(0, "", "", 0), (1, "", "", 0), (1, "u", STORY, len(STORY)), (1, "u", STORY, len(STORY))])
