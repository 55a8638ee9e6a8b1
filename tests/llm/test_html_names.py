"""Names of wrappers do not take the article out; articles in parts stay whole."""

import pytest

from trajmill.llm import htmltext

TEXT = "A paragraph with quite a few words in it, so that it is dense enough for an article."


@pytest.mark.parametrize("wrap", ["div class='layout has-sidebar'", "div id='content-widget'", "section class='page no-sidebar'"])
@pytest.mark.parametrize("inner", ["article", "div"])
def test_wrapper(wrap, inner):
    side = "<div class='sidebar'><p>Short side text.</p></div>"
    assert htmltext.main_text(f"<body><{wrap}><{inner}><p>{TEXT}</p></{inner}>{side}</{wrap.split()[0]}></body>") == TEXT


def test_parts():
    parts = [f"{TEXT} Part {i}." for i in range(3)]
    assert htmltext.main_text("<body><main>" + "".join(f"<article><p>{p}</p></article>" for p in parts) + "</main></body>") == "\n".join(parts)


POST = "<h1>Title</h1>" + "".join(f"<p>The post's paragraph {i} says a few things about bread, rye and the oven that bakes them.</p>" for i in range(8))
THREAD = "".join(f'<li class="comment"><article class="comment-body"><h1>reader {i}</h1><p>First! What a lovely post number {i}, and so much more to say about it.</p></article></li>' for i in range(12))


@pytest.mark.parametrize("page", [
    f'<article class="post">{POST}</article><div id="comments"><h2>Comments</h2><ol class="comment-list">{THREAD}</ol></div>',
    f'<main><article>{POST}<section class="comments-area"><ol>{THREAD}</ol></section></article></main>',
    f'<div class="entry-content">{POST.replace("h1", "h2")}</div><div id="respond"><p>Leave a reply</p></div><div class="site"><h1>Blog</h1></div><ol class="commentlist">{THREAD}</ol>',
])
def test_threads_whose_comments_are_articles(page):
    text = htmltext.main_text(f"<html><body>{page}</body></html>")
    assert "paragraph 7 says" in text and "paragraph 0 says" in text and "lovely post" not in text and "Leave a reply" not in text


def test_a_wrapper_named_for_comments_keeps_the_article():
    text = htmltext.main_text(f'<html><body><div class="post has-comments comments"><article>{POST}</article></div></body></html>')
    assert "paragraph 7 says" in text and "paragraph 0 says" in text
