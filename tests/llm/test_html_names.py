import pytest

from tidegraph.llm.html import page_lines

BODY = "The text of the article is here."


@pytest.mark.parametrize("name", ["layout no-sidebar", "has-sidebar", "content-with-sidebar", "nav-open", "search-results", "social-post", "banner-title"])
def test_names_that_only_hold_a_furniture_word(name):
    assert page_lines(f'<div class="{name}"><article><p>{BODY}</p></article></div>') == (True, [BODY])
    assert page_lines(f'<div class="{name}"><p>{BODY}</p></div>') == (False, [BODY])


def test_parts_of_an_article_with_such_names():
    assert page_lines(f'<article><h1 class="banner-title">Head</h1><p class="share-price">{BODY}</p></article>') == (True, ["Head", BODY])


@pytest.mark.parametrize("name", ["ad", "cookie-banner", "site-nav", "main_menu", "comments", "comment-12", "x sidebar"])
def test_furniture_is_still_dropped(name):
    assert page_lines(f'<article><p>{BODY}</p><div class="{name}">Buy</div></article><div class="{name}">Buy</div>') == (True, [BODY])


def test_what_holds_the_article_is_kept():
    assert page_lines(f'<div class="sidebar"><main><p>{BODY}</p></main></div>') == (True, [BODY])
    assert page_lines(f'<form><div class="search"><article><p>{BODY}</p></article></div></form>') == (True, [BODY])
    assert page_lines(f'<p>{BODY}</p><div class="related"><article>Teaser</article></div>') == (False, [BODY])
    assert page_lines(f'<article>{BODY}</article><div class="comments"><article>Longer than it, by far and away.</article></div>') == (True, [BODY])
