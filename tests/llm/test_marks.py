"""Which marks drop text of a page, and which do not."""

import pytest

from factorweave.llm import wrapper_induction as W


def text(body):
    page = f"<html><head><title>t</title></head><body>{body}</body></html>".encode()
    root, tree = W.read(page)
    return W.main_text(root, tree, W.Wrapper(tree, [])).split("\n")


KEPT = "This is the first paragraph of a story, long enough to be the content of the page.", "And this is another one, which goes on for a while as well."
STORY = "".join(f"<p>{t}</p>" for t in KEPT)


@pytest.mark.parametrize("extra", ['<p class="ad-hoc">', '<p class="editor-comment">', '<div class="menu-plan">', '<p><a href="/x">', '<div class="has-sidebar">', '<p class="shadow">', '<p data-x="hidden">', '<p class="unhidden">', '<p style="display:block">'])
def test_text_that_a_mark_does_not_drop(extra):
    assert text(f"<div>{STORY}{extra}Words that belong to the story itself.</p></div>") == [*KEPT, "Words that belong to the story itself."]


@pytest.mark.parametrize(
    "extra",
    ['<div class="ad">', '<div class="ad-slot-3">', '<div class="main-menu">', '<section class="comments">', '<div class="user-comments">', '<div class="cookie-consent">', '<section class="discussion">', '<div class="user-responses">', '<div hidden>', '<div class="x" hidden="">',
     '<p style="color:red; display: none">', '<div class="ad-300x250">', '<nav>', '<div class="newsletter-signup">'],
)
def test_text_that_a_mark_drops(extra):
    tag = extra[1:].split()[0].rstrip(">")
    assert text(f"<div>{STORY}</div>{extra}Words of something else on the page.</{tag}>") == list(KEPT)


def test_labels_and_hidden_words_inside_a_sentence():
    assert text("<p>Choose <label for=x>the blue one</label> now.</p>" + STORY) == ["Choose the blue one now.", *KEPT]
    assert text("<p>Seen <span hidden>unseen</span>here.</p>" + STORY) == ["Seen here.", *KEPT]
    assert text("<p>Seen <span style='display:none'>un<b>se</b>en</span>here.</p>" + STORY) == ["Seen here.", *KEPT]
    assert text(STORY + "<form><label>Name</label><input></form>") == list(KEPT)


def test_an_article_keeps_its_discussion():
    assert text(f"<article><h1>Title</h1>{STORY}<section class='discussion'><p>What follows from it.</p></section></article>") == ["Title", *KEPT, "What follows from it."]


def test_lists_of_links_are_menus():
    assert text(STORY + "<ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul>") == list(KEPT)
