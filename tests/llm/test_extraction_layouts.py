"""Main text of pages in layouts and under names that the labelled pages do not have."""

import pytest

from quillspark.llm.extraction import learn, main_text


def prose(n, word="river"):
    return "<p>" + " ".join(f"{word}{i}" for i in range(n)) + ".</p>"


TEXT = "\n".join(prose(n, w)[3:-4] for n, w in ((40, "river"), (30, "sea")))
BODY = prose(40) + prose(30, "sea")


@pytest.mark.parametrize(
    "wrap",
    [
        "has-sidebar", "no-sidebar", "with-sidebar content", "social-justice", "notice-board", "legal-guide", "menu-planning", "search-engine-history", "no-ads", "nav-open",
        "sidebar-layout", "widgets-enabled", "hidden-gems", "footer-offset", "modal-verbs", "container", "box", "list", "main", "wrapper",
    ],
)
@pytest.mark.parametrize(
    "page",
    [
        "<body><nav><a>kk</a></nav><div class='{w}'><h1>T</h1>{b}</div><footer>kk kk</footer></body>",
        "<body><div class='{w}'><div class='sidebar'><a>kk</a> kk</div><div><h1>T</h1>{b}</div></div></body>",
        "<body><div class='{w}'><h1>T</h1>{b}<div id='comments'><p>kk kk kk kk</p><p>kk kk kk kk</p></div></div></body>",
        "<body><div class='{w}'><article><header><h1>T</h1></header>{b}</article></div><aside>kk kk kk kk kk kk</aside></body>",
    ],
)
def test_a_mark_does_not_remove_the_article(wrap, page):
    assert main_text(page.format(w=wrap, b=BODY)) == "T\n" + TEXT


@pytest.mark.parametrize("side", ["header-banner", "ad-container", "article-comments", "search-bar", "social-share", "cookie-consent", "related-articles", "gdpr-notice", "user-comment", "sharing-bar", "footer-menu", "commentSection"])
@pytest.mark.parametrize("inner", ["<a href=x>kk</a> <a>kk</a> <a>kk</a>", "<p>kk kk kk kk kk</p>", "kk kk kk"])
@pytest.mark.parametrize(
    "page",
    [
        "<body><div id='wrap'>{s}<div class='content'><h1>T</h1>{b}</div></div></body>",
        "<body><h1>T</h1>{b}{s}</body>",
        "<body><article><h1>T</h1>{a}{s}{c}</article></body>",
        "<body>{s}<main><h1>T</h1>{b}</main></body>",
    ],
)
def test_side_elements_go(side, inner, page):
    odd = f"<div class='{side}'>{inner}</div>"
    assert main_text(page.format(s=odd, b=BODY, a=prose(40), c=prose(30, "sea"))) == "T\n" + TEXT


def test_comments_longer_than_the_article():
    page = f"<div><h1>T</h1>{BODY}</div><div id='comments'>{'<p>kk kk kk kk kk kk</p>' * 60}</div>"
    assert main_text(page) == "T\n" + TEXT


def test_weights_come_from_the_labelled_pages():
    text = "{{<p>a b c d e f g h i j</p>}}"
    w = learn([f"<div class='zebra' x-side>buy <a>now</a></div><div>{text}</div>", f"<div class='plain'>{text}</div>"] * 20)
    assert main_text(f"<div><p>a b c d e f g h</p></div><div class='zebra'>one two</div>{'<p>x y z a b c</p>' * 3}", w).count("one") == 0
    assert "one two" in main_text("<p>a b c d e f g h</p><p class='sidebar'>one two</p><p>x y z a b c</p>", w)


def test_elements_that_nest_wrongly():
    assert main_text("<div class='ad'><p>kk</div>" + BODY + "</p></div></section>") == TEXT
    assert main_text("<nav>" * 3000 + "<p>a</p>" + "</nav>" * 2999 + BODY) in (TEXT, "")
