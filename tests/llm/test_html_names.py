"""Names of elements: what they say, and what they only seem to say."""

import pytest

from kbloom.llm import html_extract as h

BODY = "<p>This is the body of it.</p>"
KEPT = [
    f'<article data-comments="12">{BODY}</article>',
    f'<article class="post comments-open">{BODY}</article>',
    f'<article class="commentary">{BODY}</article>',
    f'<div class="post comments-open"><article>{BODY}</article></div>',
    f'<main><div class="social-sciences">{BODY}</div></main>',
    f'<div class="related-content"><article>{BODY}</article></div>',
    f'<article class="promo">{BODY}</article>',
    f'<div id="newsletter"><main>{BODY}</main></div>',
    f'<article title="related adverts">{BODY}</article>',
]
DROPPED = ["<div class='related-posts'><article>More</article></div>", "<div class='comments'><article>More</article></div>", "<article class='comment'>More</article>", "<ul class='comment-list'><li>More</ul>", "<div id='cookie-consent'>More</div>", "<div class='social-share-buttons'>More</div>", "<article class='promo'>More</article>"]


def text(page):
    return [t for t, s in h.lines(page) if s not in (h.GONE, h.DOUBT)]


@pytest.mark.parametrize("page", KEPT)
def test_an_article_is_kept_whatever_its_names_resemble(page):
    assert text(f"<body><nav>Menu</nav>{page}<footer>Foot</footer></body>") == ["This is the body of it."]


@pytest.mark.parametrize("extra", DROPPED)
def test_furniture_beside_an_article_goes(extra):
    assert text(f"<body><article>{BODY}</article>{extra}</body>") == ["This is the body of it."]


def test_two_articles_are_kept():
    assert text(f"<article>{BODY}</article><article class='unrelated'><p>Second.</p></article>") == ["This is the body of it.", "Second."]


def test_comments_alone_are_no_article():
    page = f"<div>{BODY}</div><div class='comments'><article>me too</article></div>"
    assert text(page) == ["This is the body of it."]
