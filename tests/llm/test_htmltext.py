"""Main text of pages whose wrappers only look like side parts."""

from __future__ import annotations

import pytest

from flowquarry.llm.htmltext import main_text

LONG = "This paragraph of the article is long enough to be a surge all by itself, as it has over eighty characters."


@pytest.mark.parametrize("begin", ["div class='overflow-hidden'", "div aria-hidden='false'", "div title='hidden gems'", "div class='content no-sidebar'", "div class='has-comments'", "div id=sidebar-wrapper", "form", "div class='notice'", "div hidden=until-found"])
def test_wrappers_keep_their_article(begin):
    end = begin.split()[0]
    assert main_text(f"<body><{begin}><article><p>First.</p><p>Second.</p></article></{end}><div class=comments><p>nice</p></div></body>") == "First. Second."
    assert main_text(f"<body><{begin}><p>{LONG}</p></{end}><footer>(c)</footer></body>") == LONG


@pytest.mark.parametrize("begin", ["article data-comments='3'", "article class='comments-open'", "article class='overflow-hidden'", "main title='hidden'"])
def test_articles_stay(begin):
    assert main_text(f"<{begin}><p>Text.</p></{begin.split()[0]}>") == "Text."


@pytest.mark.parametrize("name", ["class=comments", "class='site-nav'", "id=related-posts", "hidden", "class=hidden", "aria-hidden=true", "style='display: none'", "class='cookie-notice'", "role=search"])
def test_side_parts_go(name):
    assert main_text(f"<article><p>Text.</p><div {name}><p>other</p></div></article>") == "Text."
    assert main_text("<article><p>Text.</p><article class='comment'><p>nice</p></article></article>") == "Text."


def test_all_containers_and_short_blocks():
    assert main_text("<article>One.</article><aside>ad</aside><article>Two, longer.</article><div class=comments><article>nice</article></div>") == "One. Two, longer."
    assert main_text(f"<article>One.</article><p>{LONG}</p><footer>(c)</footer>") == f"One. {LONG}"
    advert = "<div class=advert>buy</div>"
    assert main_text(f"<p>{LONG}</p>{advert}<h2>Short heading</h2>{advert}<p>A short line.</p>{advert}<p>{LONG}</p>{advert}<p>far</p>") == f"{LONG} Short heading A short line. {LONG}"
