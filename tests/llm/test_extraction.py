import html
import os
import random
import re

import pytest

from calspark.llm import extraction

BLOG = """<!doctype html><html><head><title>T</title><style>p{{}}</style></head><body class="has-sidebar"><header class="site-header"><h1>Site</h1></header><div id="cookie-notice">We use cookies</div>
<div class="layout"><div class="sidebar">links <a href=x>a</a></div><main><article class="post post-{n}"><header><h1>Big  Title {n}</h1><div class="byline-share">by X</div></header><div class="share-buttons"><a>tweet</a></div>
<div class="entry-content"><p>First paragraph, number {n}, with some text &amp; an entity &#8212; and more words here.</p><form><input><label>Sign up</label></form><p>Second<br>line of text, long enough to be scored.<ul><li>one<li>two <b>bold</ul>
<div class="ad-slot">Buy now</div><blockquote>quoted <i>text</i></blockquote></div></article><section id="comments"><div class="comment"><p>Great post, thanks a lot for this very long comment, I enjoyed it, really, so much.</p></div></section></main></div><footer>foot</footer></body></html>"""
WANT = "Big Title {n}\n\nby X\n\nFirst paragraph, number {n}, with some text & an entity — and more words here.\n\nSecond line of text, long enough to be scored.\n\none\n\ntwo bold\n\nquoted text"


def test_blog_template():
    text, path = extraction.extract(BLOG.format(n=12), None)
    assert text.replace("by X\n\n", "") == WANT.format(n=12).replace("by X\n\n", "")
    assert path.endswith("article.post") and "comments" not in text


@pytest.mark.parametrize("page,want", [
    (None, ""), ("", ""), ("plain text", "plain text"), ("<p>a<b", "a"), ("<div hidden>x</div><p>y &lt; z &nbsp; w</p>", "y < z w"), ("<p>one<p>two", "one\n\ntwo"),
    ("<script>var a='<p>no</p>'</script><p>yes", "yes"), ("<!-- <p>no</p> --><p>yes</p>", "yes"), ("<nav>n</nav>", ""), ("a<br>b", "a b"), ("<textarea>t</textarea><p>x", "x"), ("<p>&amp;amp; &copy</p>", "&amp; ©"),
    ("<article><h1>H</h1><p>x</article><aside>s</aside>", "H\n\nx"), ('<div class="content"><p>text, text</p><div class="newsletter-box">n</div></div>', "text, text"), ("<p title='>'>q</p>", "q"),
    ("<SCRIPT>no</SCRIPT><P>Up</P>", "Up"), ('<article><div class="entry-header"><h1>T</h1><span>by me</span></div><p>x</p><ins class="adsbygoogle">ad</ins><div class="commentlist"><p>c</p></div></article>', "T\n\nx"),
    ('<article class="commentary"><p>opinion</p><div role="note">aside</div></article>', "opinion\n\naside"), ('<div role="main"><p>m</p><div role="alert">a</div></div>', "m"), ("<pre>a\n  b</pre>", "a b"), ("<p>a<!-- unclosed <p>b", "a"), ("<script>never closed <p>x", ""),
])
def test_small_pages(page, want):
    assert extraction.extract(page or "", None)[0] == want


STORY = "The story itself, told at length, with all its commas, and more of it."


@pytest.mark.parametrize("page,want", [
    (f"<html><head><title>T</title></head><body><form id=aspnetForm method=post><input type=hidden><nav>n</nav><label>Find</label><select><option>o</select><div><h1>H</h1><p>{STORY}</p></div></form></body></html>", f"H\n\n{STORY}"),
    (f"<form role=form><main><p>{STORY}</p><form><label>Mail</label>join</form></main><button>b</button></form>", STORY),
    (f"<form><article><p>{STORY}</article></form><p><a href=x>{STORY} {STORY}</a></p>", STORY),
    (f'<p>{STORY}</p><form><label>Mail</label>join</form>', STORY),
    (f'<form class="comment-form"><p>{STORY}</p></form>', ""),
    (f"<html><head><title>T</title><meta name=x><style>p{{}}</style><body><p>{STORY}</p></body></html>", STORY),
    (f"<head><title>T</title><script>no</script><div><p>{STORY}</p></div>", STORY),
    (f"<head><title>T</title>{STORY}", STORY),
    (f"<head><title>T</title><header>h</header><p>{STORY}</p><nav>n</nav>", STORY),
    (f"<head><title>T</title><svg>s</svg>plain <b>{STORY}</b>", f"plain {STORY}"),
])
def test_forms_around_the_page_and_heads_without_end(page, want):
    assert extraction.extract(page, None)[0] == want


def generated(r):
    blocks = [" ".join("".join(r.choices("abcdeäß&<", k=r.randint(1, 8))) for _ in range(r.randint(3, 40))) for _ in range(r.randint(1, 8))]
    body = "".join(f"<p>{html.escape(b)}</p>" if r.random() < 0.8 else f"<p><b>{html.escape(b)}<br>" for b in blocks)
    page = f'<html><body><nav><ul><li><a href="/x">x</a></li></ul></nav><div class="ad">{"buy this now, " * r.randint(1, 9)}</div><article><h1>{html.escape(blocks[0][:20])}</h1>{body}</article><footer>&copy; f</footer></body></html>'
    want = [blocks[0][:20], *blocks]
    return page, "\n\n".join(x for x in (" ".join(w.split()) for w in want) if x)


def test_query_over_hosts_nulls_repeats_and_empty(spark):
    r = random.Random(0)
    rows, want = [], {}
    for n in range(60):
        page, text = generated(r)
        rows.append((n, f"http://{'hot' if n % 3 else 'h' + str(n)}.example.com/{n}?q", page))
        want[n] = text
    rows += [(100, None, rows[0][2]), (101, "http://hot.example.com/z", None), (102, "not a url", ""), (0, rows[0][1], rows[0][2])]
    want |= {100: want[0], 101: "", 102: ""}
    pages = spark.createDataFrame([(*x, "extra") for x in rows], "page_id long, url string, html string, host string").repartition(4)
    got = extraction.main_texts(pages).collect()
    assert len(got) == len(rows)
    for x in got:
        assert x.text == want[x.page_id] and x.n_chars == len(x.text)
    assert extraction.main_texts(pages.limit(0)).count() == 0


def test_hosts_vote(spark):
    odd = '<body><div class="teaser"><p>' + "Teaser text, with commas, and words, for every page. " * 3 + '</p></div><div class="story-42"><p>Short, but the story of it.</p></div></body>'
    usual = '<body><div class="teaser"><p>tease</p></div><div class="story-{n}"><p>' + "The story itself, told at length, with all its commas. " * 9 + "</p></div></body>"
    pages = spark.createDataFrame([(n, "http://a.b/x", usual.format(n=n)) for n in range(9)] + [(9, "http://a.b/y", odd)], "page_id long, url string, html string")
    winner = extraction.host_paths(pages).collect()
    assert [(w.host, w.winner) for w in winner] == [("a.b", "div.story-#")]


def test_same_as_a_plain_reading_of_the_template():
    for n in range(3):
        page = BLOG.format(n=n)
        inside = page[page.index("<article") :].split("</article>")[0]
        text, _ = extraction.extract(page, extraction.votes(page)[0][0])
        assert all(" ".join(html.unescape(re.sub(r"<br>", " ", p)).split()) in text for p in re.findall(r"<p>(.*?)(?:</p>|<ul>)", inside))


PROSE = "The story itself, told at length, with all its commas, and words, and more of it than of anything else."
SIDE = "<div class=sidebar><p>Short side note, here.</p></div>"


@pytest.mark.parametrize("page,want", [
    (f'<body><div class="site has-sidebar"><article><h1>H</h1><p>{PROSE}</p></article>{SIDE}</div>', f"H\n\n{PROSE}"),
    (f'<body><div class="layout comments-open"><div class="entry"><p>{PROSE}</p></div>{SIDE}</div>', PROSE),
    (f'<body><div class="page sidebar"><div><h1>H</h1><p>{PROSE}</p></div>{SIDE}</div>', f"H\n\n{PROSE}"),
    (f'<body><div id="social-wrapper"><p>{PROSE}</p></div><div class="footer">f</div>', PROSE),
    (f'<article><h1>H</h1><p>{PROSE}</p><section id="discussion"><h2>Discussion</h2><p>{PROSE}</p></section></article>', f"H\n\n{PROSE}\n\nDiscussion\n\n{PROSE}"),
    (f'<article><p>{PROSE}</p><section id="related-work"><h2 id=related>Related work</h2><p>{PROSE} <a href=x>one</a></p></section></article>', f"{PROSE}\n\nRelated work\n\n{PROSE} one"),
    (f'<article><p>{PROSE}</p><section id="related"><ul><li><a href=x>{PROSE}</a></ul></section></article>', PROSE),
    (f'<article><p>{PROSE}</p><section id="discussion"><h2>2 remarks</h2><div class="comment"><p>{PROSE}</p></div></section></article>', PROSE),
    (f'<article><p>{PROSE}</p></article><section id="comments"><article><p>{PROSE} {PROSE} {PROSE}</p></article></section>', PROSE),
    (f'<div class="post"><p>{PROSE}</p></div><div id="comments"><p>{PROSE}</p><p>{PROSE}</p><p>{PROSE}</p></div>', PROSE),
    (f"<article><p>{PROSE} <math><mi>a</mi><mo>=</mo><mi>b</mi><annotation>tex</annotation></math> holds.</p></article>", f"{PROSE} a=b holds."),
    (f'<article><p>{PROSE}</p><pre><span class="comment"># why</span> x = 1</pre></article>', f"{PROSE}\n\n# why x = 1"),
    (f'<body class="nav-open"><div class="no-sidebar"><p>{PROSE}</p></div><div class="sidebar">{PROSE}</div>', PROSE),
    (f'<div class="hidden"><article><h1>H</h1></article></div><article><p>{PROSE}</p></article>', PROSE),
])
def test_names_do_not_hide_the_article(page, want):
    assert extraction.extract(page, None)[0] == want


def test_very_long_and_very_deep_pages():
    long = "<article>" + f"<p>{PROSE}</p>" * 20_000 + "</article>"
    assert extraction.extract(long, None)[0].count(PROSE) == 20_000
    deep = "<div>" * 5_000 + f"<p>{PROSE}" + "</div>" * 5_000
    assert extraction.extract(deep, None)[0] == PROSE


def plain(html_text):
    """The text of pages in the one form that the driver's tables have, by a line of patterns."""
    inside = re.search(r"<article>(.*?)</article>", html_text, re.S)[1]
    inside = re.sub(r"<br>", " ", re.sub(r"</?(?:p|h1|ul|li)>", "\n\n", inside))
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in inside.split("\n\n")]
    return "\n\n".join(b for b in blocks if b)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the driver's tables")
def test_whole_query_against_a_plain_reading(spark):
    pages = {x.page_id: x.html for x in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    got = extraction.op6_html_extraction(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(pages) and all(x.text == plain(pages[x.page_id]) and x.n_chars == len(x.text) for x in got)
