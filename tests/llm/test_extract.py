"""Names, links and formulas of pages: what is article text stays."""

import pytest

from vellumine.llm import extract

STORY = "The story of the river and the town is one that was told to all of us by the people of it. And more"
OTHER = "This is what the people of the town have to say about it, and it is not for the last time that they do"


@pytest.mark.parametrize(
    "page",
    [
        "<article class='post comments-open'><p>{}</p></article>", "<main class='content has-widget'><p>{}</p></main>",
        "<div class='elementor-widget'><article><p>{}</p></article></div>", "<div id='page' class='with-menu'><article><p>{}</p></article></div>",
        "<div class='nav-open'><div class='x-widget'><article><p>{}</p></article></div></div>", "<div class='nav-open'><p>{}</p></div>",
    ],
)
def test_parts_of_names_do_not_hide_the_text(page):
    rest = f"<div class='comments'><p>{OTHER}</p></div><div class='site-footer'>all rights</div><div class='menu'><a>one</a></div>"
    assert extract.main_text(page.format(STORY) + rest) == STORY


def test_marked_containers_stay_out():
    page = f"<div><p>{STORY}</p><p>{STORY}</p></div><div class='comment-list'><p>{OTHER}</p></div><div class='comments'><article><p>{OTHER}</p></article></div>"
    assert extract.main_text(page) == f"{STORY}\n{STORY}"


def test_links_and_formulas_of_an_article_stay():
    page = f"<article><p>{STORY}</p><ul><li><a>A linked reference</a></li></ul><p>so <math><mi>x</mi></math> holds</p></article><p><a>next page</a></p>"
    assert extract.main_text(page) == f"{STORY}\nA linked reference\nso x holds"


NAMES = "ads advert banner nav menu breadcrumb sidebar aside footer cookie notice popup newsletter subscribe share related widget search tags trending".split()


@pytest.mark.parametrize("name", NAMES)
def test_no_name_hides_the_only_article(name):
    """On it, above it, or round the page's only text; other blocks of such names stay out."""
    rest = f"<div class='comments'><p>{OTHER}</p></div><div class='related'><p>{OTHER[:60]}</p></div><div class='share'>Share this</div>"
    for page in (f"<article class='post {name}'><p>{STORY}</p></article>", f"<div class='{name}'><article><p>{STORY}</p></article></div>", f"<main id='{name}'><p>{STORY}</p></main>"):
        assert extract.main_text(page) == STORY
        assert extract.main_text(f"{page}{rest}".replace(OTHER, OTHER[:90])) == STORY
    assert extract.main_text(f"<div class='{name}'><p>{STORY}</p></div><div class='other'>Next page</div>").startswith(STORY)


def test_names_still_mark_beside_an_article():
    page = f"<article><p>{STORY}</p></article><div class='widget'><article><p>{OTHER}</p></article></div><div class='comments'><article class='comment'><p>{OTHER} {OTHER}</p></article></div>"
    assert extract.main_text(page) == STORY
    assert extract.main_text(f"<div class='comments'><p>{OTHER}</p><p>{OTHER}</p></div><div class='x'><a>next</a></div>") == ""
