"""Pages whose attributes and element names only look like those that hide or frame a text."""

import time

import pytest

from docweave.llm.html import _marks, blocks_of, extract_pages, main_text, train_tree

LONG = "One sentence follows another here, and the paragraph goes on for quite a while so that it reads as running text."


@pytest.mark.parametrize(
    "page",
    [
        f'<article><div style="overflow:hidden"><p>{LONG}</p></div></article>',
        f'<article><p style="visibility: hidden-ish">{LONG}</p></article>',
        f'<article><a href="/hidden-gems"><h2>{LONG}</h2></a></article>',
        f'<article><a href=/hidden/ title="a hidden gem"><p>{LONG}</p></a></article>',
        f'<article><div data-id="nav-3" data-class="ad" data-hidden="x"><p>{LONG}</p></div></article>',
        f'<article><svg class="i"/><p>{LONG}</p></article>',
        f'<article><svg title="a > b" /><math/><p>{LONG}</p></article>',
        f"<article><title-bar></title-bar><select-box></select-box><p>{LONG}</p></article>",
    ],
)
def test_nothing_else_is_dropped(page):
    assert main_text(page, train_tree()) == LONG


@pytest.mark.parametrize("name", "navy-box sidewalk-history search-for-meaning share-prices legal-history related-work footnote tagebuch".split())
def test_names_that_only_begin_like_the_frame(name):
    for mark in (f"class='{name}'", f"id={name}"):
        assert main_text(f"<article><div {mark}><p>{LONG}</p></div></article>", train_tree()) == LONG


@pytest.mark.parametrize("name", "nav-3 comment-list cookie-notice share-buttons related_links site-footer ad top-ad-slot newsletter-form sidebar".split())
def test_names_of_the_frame(name):
    assert main_text(f"<article><p>{LONG}</p><div class='x {name}'><p>b {LONG}</p></div></article>", train_tree()) == LONG


def test_links_before_a_paragraph():
    first = "See <a href='/x'>the long linked title of it</a>"
    page = f"<article><p>{first}</p><p>{LONG}</p></article>"
    assert main_text(page, train_tree()) == f"See the long linked title of it\n{LONG}"


def test_quotes_only_hold_values():
    page = f"<article><p title=don't>{LONG}</p><p>it's {LONG}</p><p title='a > b' alt = \"it's >\">{LONG}</p></article>"
    assert main_text(page, train_tree()) == f"{LONG}\nit's {LONG}\n{LONG}"
    assert main_text(f"<article><p title=don't>{LONG}</p></article>", train_tree()) == LONG
    assert main_text(f"<article><p>{LONG}</p><svg a=b c='>'><text>no</text></svg><p>{LONG}</p></article>", train_tree()) == f"{LONG}\n{LONG}"


def test_controls_inside_a_sentence_belong_to_it():
    assert [b["text"] for b in blocks_of("<p>a <button>b</button> <label>c</label> d</p><button>e</button><p>f</p>")] == ["a b c d", "e", "f"]
    assert main_text(f"<article><p>{LONG}</p><button>Share</button></article>", train_tree()) == LONG


def test_unclosed_elements_take_no_time():
    start = time.process_time()
    assert len(blocks_of("<b>x</i>" * 100_000)) == 1
    assert len(blocks_of("<svg a=b " * 2_000 + "<p>x")) <= 1
    assert time.process_time() - start < 5


def test_page_rows(spark):
    rows = [(1, "u", f"<article><p>{LONG}</p></article>", "x"), (1, "u", f"<article><p>{LONG}</p></article>", "x"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(map(tuple, extract_pages(df).collect()), key=str)
    assert got == [(1, "u", LONG, len(LONG)), (1, "u", LONG, len(LONG)), (None, None, "", 0)]
    assert extract_pages(df.where("false")).collect() == []


def test_hidden_parts_still_go():
    for mark in ("hidden", "HIDDEN", "hidden=''", 'class="x"hidden', "hidden/", 'aria-hidden="true"', "aria-hidden = true"):
        assert [b["text"] for b in blocks_of(f"<p>a</p><p {mark}>b</p><p>c</p>")][:2] == ["a", "c" if mark != "hidden/" else "b"], mark
    for part in ("<svg viewBox='0'><title>b</title><path/></svg>", "<script>b</script>", "<STYLE type=x>b</STYLE>", "<select><option>b</select>"):
        assert " ".join(b["text"] for b in blocks_of(f"<p>a</p>{part}<p>c</p>")) == "a c", part


def test_attributes_are_read_one_by_one():
    assert _marks("div", ' id="nav-3"')[0] and _marks("div", " class='x sidebar'")[0] and _marks("div", " role=navigation")[0]
    assert not any(_marks("div", """ data-id="nav-3" title='class="nav" hidden' x-role=navigation"""))
