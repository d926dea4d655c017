import itertools
import random

import pytest

from duologue.llm import maincontent as m

LONG = "The committee met on Tuesday to discuss the new budget, and after a long debate it voted to put off the decision until May. "


def test_cut_is_least():
    rng = random.Random(1)
    for _ in range(40):
        n = rng.randint(1, 9)
        odds = [rng.uniform(-4, 4) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 3)) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.5]
        cost = lambda keep: sum(max(0, x) for x, k in zip(odds, keep, strict=True) if not k) + sum(
            max(0, -x) for x, k in zip(odds, keep, strict=True) if k) + sum(c for a, b, c in edges if keep[a] != keep[b])
        got = m.min_cut(odds, edges)
        assert cost(got) == pytest.approx(min(cost(k) for k in itertools.product((False, True), repeat=n)))


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var x = '</p>';</script></head><body>{body}</body></html>"


def test_everything_around_the_article_goes():
    text = m.main_text(page(
        '<header class="site-header"><a href="/">Site</a> The daily paper of the town since long ago</header>'
        '<nav><ul><li><a href=a>Home</a><li><a href=b>News</a></ul></nav><div class="cookie-notice">We use cookies to make this site better for '
        f'you and for all our partners. <button>OK</button></div><article><h1>Budget &amp; votes</h1><p>{LONG}<b>bold</b>er<br>line</p><p>Short.</p>'
        f'<div class="advert">Buy now and save a lot of money on every order you make today, only here.</div><p>{LONG}</p>'
        '<section id="comments"><p>I do not agree with this at all, it is the worst thing I have read for years and years.</p></section></article>'
        f'<aside class="sidebar"><p>{LONG}</p></aside><form><p>Your name and address please, so that we can write to you</p></form>'
        f"<footer>&copy; 2020 the paper, all of its parts</footer><!-- <p>{LONG}</p> -->"))
    body = " ".join(LONG.split())
    assert text == f"Budget & votes\n{body} bolder line\nShort.\n{body}"


def test_page_without_article_element():
    text = m.main_text(page(f'<div id="menu"><a href=a>One</a> <a href=b>Two</a></div><div id="page"><p>{LONG}<p>{LONG}<p>Yes.<p>{LONG}</div>'
                            '<div class="footer"><a href=c>About us</a></div>'))
    body = " ".join(LONG.split())
    assert text == f"{body}\n{body}\nYes.\n{body}"


def test_broken_and_empty_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p"), (3, "u", f"<article><p><b>{LONG}<br><p>{LONG} &am"), (4, "u", "<div>" * 3000 + LONG),
            (5, "u", f"<article><p>{LONG * 2000}"), (5, "u", f"<article><p>{LONG * 2000}"), (6, "u", '<p title="x>' + LONG)]
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string").repartition(2)
    got = {r.page_id: r for r in m.extract(df).collect()}
    body = " ".join(LONG.split())
    assert got[1].text == got[2].text == got[None].text == "" and got[1].n_chars == 0
    assert got[3].text == f"{body}\n{body} &am" and got[4].text == body
    assert got[5].n_chars == len(LONG) * 2000 - 1
    assert m.extract(df).count() == 8 and m.extract(df.where("false")).count() == 0


@pytest.mark.parametrize("odd", ["<video-card></video-card>", "<button-row>", "<svg/>", '<svg width="1" />', "<math/>", "<div><button>Menu</div>",
                                 "<div><select><option>One</div>", "<div><object data=x></div>", "<div><svg><path d=z></div>",
                                 "<svg><title/><g/></svg>", "<p>One <button>OK<button>No</button> two</p>",
                                 "<object><object>x</object>hidden</object>", "<template><article><p>hidden</p></article></template>"])
def test_nothing_after_is_lost(odd):
    text = m.main_text(page(f"<article><p>{LONG}</p>{odd}<p>{LONG}</p></article><footer>The end of it all</footer>"))
    body = " ".join(LONG.split())
    assert text.split("\n")[0] == text.split("\n")[-1] == body and text.count(body) == 2
    assert not any(x in text for x in ("Menu", "hidden", "OK", "No", "The end", "x</"))


def test_raw_text_to_the_end_of_the_page():
    assert m.main_text(f"<article><p>{LONG}</p><script>var a = '<p>{LONG}</p>'") == " ".join(LONG.split())


def test_end_tags_pair_up_in_deep_pages():
    text = m.main_text(page(f"<article>{'<div>' * 600}<p>{LONG}</p>{'</div>' * 600}<p>{LONG}</p></article><footer>The end of it all</footer>"))
    assert text.count(" ".join(LONG.split())) == 2
    blocks = m.blocks_of(f"<div class=menu>{'<div>' * 600}a{'</div>' * 600}<p>b</p></div><p>c</p>")
    assert [b.out or b.doubt > 0 for b in blocks] == [True, True, False]
    assert len({len(b.path) for b in blocks[1:]}) == 2


@pytest.mark.parametrize("open_, close", [
    ('<article aria-hidden="false">', "</article>"), ('<article data-class="ad">', "</article>"), ('<div class="page has-sidebar"><article>', "</article></div>"),
    ('<main class="search-story">', "</main>"), ('<article id="notice-of-award">', "</article>"), ("<article class='share'>", "</article>"),
    ('<div class="popup"><main>', "</main></div>"), ('<div class="widget">', "</div>"), ("<article data-note='it is' it's>", "</article>")])
def test_names_do_not_hide_the_article(open_, close):
    text = m.main_text(page(f"<nav><a href=/>Home</a></nav>{open_}<p>{LONG}</p><p>{LONG}</p><p>{LONG}</p>{close}<footer>The end of it all</footer>"))
    assert text == "\n".join([" ".join(LONG.split())] * 3)


@pytest.mark.parametrize("tag", ['<p title="a hidden gem">', '<p data-id="search-12">', '<p data-x="id=login">', '<p class="share-price">', "<p don't>", '<p data-a=\'x "y\' b="hidden">',
                                 "<p title=it's>", '<p =">', "<p class = 'x' id= y >"])
def test_attributes_are_read_in_order(tag):
    text = m.main_text(page(f"<article><p>{LONG}</p>{tag}{LONG}</p><p>it's {LONG}</p></article>"))
    body = " ".join(LONG.split())
    assert text == f"{body}\n{body}\nit's {body}"


@pytest.mark.parametrize("tag", ['<div class="ad">', '<div id="site-footer">', '<ul class="x related-posts">', '<div class="comments-area">', '<p class=advert>', "<div hidden>",
                                 '<div style="a:b; display:none">', '<div role="complementary">', '<article class="comment">', '<div class="ad-slot-2">', '<div aria-label="Cookie notice">'])
def test_named_parts_go(tag):
    end = "</" + tag[1:].split()[0].rstrip(">") + ">"
    text = m.main_text(page(f"<article><p>{LONG}</p>{tag}Something else altogether that is long enough to look like text of the page{end}<p>{LONG}</p></article>"))
    assert text == "\n".join([" ".join(LONG.split())] * 2)
