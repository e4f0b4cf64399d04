"""Byte-level BPE against the public tokenizer library; main text of pages."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from examlens.llm import bpe_tree, html_density
from examlens.llm import queries as q

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return bpe_tree.read_ranks(PATH)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def check(coder, library, text):
    ids = np.frombuffer(coder.encode(text), "<u4")
    assert ids.tolist() == library.encode_ordinary(text), text[:200]
    assert coder.decode(ids) == text.encode()


@pytest.mark.parametrize("leaf", [(1, 1), (3, 2), (16, 8), (2048, 48)])
def test_tree_equals_the_library(ranks, library, monkeypatch, leaf):
    monkeypatch.setattr(bpe_tree, "LEAF_CHARS", leaf[0])
    monkeypatch.setattr(bpe_tree, "LEAF_BYTES", leaf[1])
    coder = bpe_tree.Coder(ranks, public_tokenizers.PATTERN)
    rng = random.Random(leaf[0])
    parts = ["a", "b", "e", "th", "er", " ", "  ", "\n", "'", "s", "re", "ll", "1", "23", "!", "é", "ß", "日本", "\t", "'re", "😀", "　", "́"]
    for _ in range(3000):
        check(coder, library, "".join(rng.choice(parts[: rng.choice([3, 8, 23])]) for _ in range(rng.randrange(60))))


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 4000, " " * 3000, "é" * 3000, "can'" + "re" * 2000, "x \n" * 3000, "<|endoftext|>", "\x00\x7f"])
def test_long_runs(ranks, library, text):
    check(bpe_tree.Coder(ranks, public_tokenizers.PATTERN), library, text)


def test_queue_and_scan_merge_alike(ranks):
    coder = bpe_tree.Coder(ranks, public_tokenizers.PATTERN)
    rng = random.Random(9)
    for _ in range(400):
        piece = bytes(rng.choice(b"aethrs \xc3\xa9") for _ in range(rng.randrange(1, 120)))
        assert coder._merged_by_queue(piece) == coder.merged(piece)


def test_full_caches_change_nothing(ranks, library, monkeypatch):
    monkeypatch.setattr(bpe_tree, "CACHE", 3)
    check(bpe_tree.Coder(ranks, public_tokenizers.PATTERN), library, "many different words in this short text, many words")


def test_documents(docs, rows, no_docs, ranks, library):
    got = bpe_tree.encode(docs, ranks, public_tokenizers.PATTERN, digests=True).collect()
    want = []
    for r in rows:
        ids = library.encode_ordinary(r[1] or "")
        raw = np.array(ids, "<u4").tobytes()
        want.append((r[0] or -1, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert sorted((r[0] or -1, *r[1:]) for r in got) == sorted(want)
    plain = bpe_tree.encode(docs, ranks, public_tokenizers.PATTERN).collect()
    assert sorted((r.doc_id or -1, r.ids) for r in plain) == sorted((r[0] or -1, library.encode_ordinary(r[1] or "")) for r in rows)
    assert bpe_tree.encode(no_docs, ranks, public_tokenizers.PATTERN).count() == 0


ARTICLE = "<h1>A title &amp; more</h1><p>First  paragraph,\n with <b>bold</b> and <a href='/x'>a link</a>.</p><p>Short.<p>Third &eacute; one<br>broken.</p>"
TEXT = "A title & more\nFirst paragraph, with bold and a link.\nShort.\nThird é one broken."
PAGES = {
    "plain": f"<html><body><article>{ARTICLE}</article></body></html>",
    "around": "<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var x='</p>'</script></head><body><header><h1>Site</h1></header>"
    "<nav><ul><li><a href=/>Home</a><li><a href=/b>B</a></ul></nav><div class='cookie-notice'>We use cookies</div><!-- <p>no</p> -->"
    f"<div class=\"ad\">Buy</div><main>{ARTICLE}<form><input value=x>Send</form><noscript>js</noscript></main>"
    "<aside><p>Side</p></aside><section id=comments><p>I liked it</p></section><footer>&copy;</footer>",
    "unclosed": f"<body><div id=sidebar><p>side</div><div class=post>{ARTICLE}",
}


@pytest.mark.parametrize("name", PAGES)
def test_main_text(name):
    assert html_density.main_text(PAGES[name]) == TEXT


def test_densest_subtree_without_an_article():
    lines = "".join(f"<p>{'A sentence of the story that goes on. ' * 4}</p>" for _ in range(5))
    links = "".join(f"<div><a href=/{i}>Some other story number {i}</a></div>" for i in range(30))
    got = html_density.main_text(f"<body><div class=a>{links}</div><div class=b>{lines}</div><div>tail</div></body>")
    assert got.count("A sentence of the story") == 20 and "other story" not in got and "tail" not in got


@pytest.mark.parametrize(
    "html, text",
    [
        ("", ""),
        ("no markup  at all", "no markup at all"),
        ("<p>a<p>b", "a\nb"),
        ("<ul><li>a<li>b</ul>", "a\nb"),
        ("</p></div>x", "x"),
        ("<script>alert(1)", ""),
        ("<b>x</b>y <i>z", "xy z"),
        ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
        ("&lt;p&gt; &#x41;&#66;", "<p> AB"),
    ],
)
def test_odd_pages(html, text):
    assert html_density.main_text(html) == text


def test_deep_and_broken_pages_stay_fast():
    for html in ("<div>" * 30_000 + "x", "<p>a <b>" * 30_000, "</x><" * 30_000, "<a '" * 20_000):
        html_density.main_text(html)


def test_pages(spark):
    rows = [(1, "u", PAGES["around"]), (2, None, None), (3, "u", ""), (None, "u", PAGES["plain"]), (1, "u", PAGES["around"])]
    frame = spark.createDataFrame([(*r, "clash", 5) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = html_density.extract(frame).collect()
    want = [(1, "u", TEXT, len(TEXT)), (2, None, "", 0), (3, "u", "", 0), (None, "u", TEXT, len(TEXT)), (1, "u", TEXT, len(TEXT))]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert html_density.extract(frame.limit(0)).count() == 0


def brute_article(html):
    """The generator's pages keep their article in one element."""
    import re
    from html import unescape

    inner = html[html.index("<article>") + 9 : html.index("</article>")]
    blocks = (" ".join(unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?(?:h1|p)>", inner))
    return "\n".join(x for x in blocks if x)


def test_all_pages(spark, small_dir):
    pages = {r.page_id: r.html for r in q.table(spark, small_dir, "pages").collect()}
    got = q.op8(spark, small_dir).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == brute_article(pages[r.page_id]) and r.n_chars == len(r.text)


def test_article_text_is_not_noise_by_its_attributes():
    """Names inside other attributes' values, and headings, paragraphs and sections named by common words."""
    body = "A long paragraph of real article text that goes on for a while and holds no link at all. " * 3
    page = f"""<html><body><main><p>{body}</p>
        <p data-hidden="false">first kept</p><p title="the hidden room">second kept</p>
        <p>A sentence with enough plain words around its two links, so that they are not most of it: <a href="/tours/hidden-gems.html">third kept</a> and <a href="/x?id=search">fourth kept</a></p>
        <h2 id="related-work">fifth kept</h2><p class="notice">sixth kept</p>
        <section id="social-impact"><p>seventh kept. {body}</p></section>
        <div class="related"><a href="/a">gone one</a> <a href="/b">gone two</a></div>
        <p hidden>gone three</p><div class="ad">gone four</div></main></body></html>"""
    text = html_density.main_text(page)
    for word in ("first", "second", "third", "fourth", "fifth", "sixth", "seventh"):
        assert f"{word} kept" in text
    assert "gone" not in text


BODY = "A long paragraph of real article text that goes on for a while and holds no link at all. " * 3
GOES = [
    '<section class="comments"><h3>gone</h3><p>gone Nice post, thanks Bob!</p></section>',
    '<div id="comments">gone</div>',
    '<p class="comment">gone</p>',
    '<article class="comment"><p>gone</p></article>',
    '<ul class="commentList"><li>gone</li></ul>',
    '<div class="newsletter">gone</div>',
    '<div id="ad-1">gone BUY SHOES NOW</div>',
    '<div class="cookie-notice">gone</div>',
    '<div class="share-buttons"><a href=/s>gone</a></div>',
    '<div role="complementary">gone</div>',
    '<span class="ad">gone</span>',
]
STAYS = [
    f'<p class="notice">stays {BODY}</p>',
    '<h2 id="related-work">stays</h2>',
    f'<section id="social-impact"><p>stays {BODY}</p></section>',
    f'<div class="search-methods"><p>stays {BODY}</p></div>',
    f'<svg class="i"/><p>stays {BODY}</p>',
    f"<p><a href=x title=it's>stays</a> {BODY}</p><p>don't {BODY}</p>",
]


@pytest.mark.parametrize("element", ["article", "main", "div"])
def test_notices_and_comments_go_and_prose_stays(element):
    """The same inside and outside of an article element, one block at a time and all together."""
    for blocks in [*[[b] for b in GOES + STAYS], GOES + STAYS]:
        inner = "".join(f"{b}<p>between {BODY}</p>" for b in blocks)
        text = html_density.main_text(f"<body><{element}><h1>Title</h1><p>first {BODY}</p>{inner}</{element}></body>")
        assert "gone" not in text and "Bob" not in text, blocks
        assert text.count("stays") == sum(b.count("stays") for b in blocks), blocks
        assert text.startswith("Title\nfirst") and text.count("between") == len(blocks)


def test_a_marked_block_around_the_page_stays():
    page = f'<body><div class="widget"><h1>Title</h1><p>{BODY}</p></div><div class="widget"><p>gone</p></div></body>'
    assert html_density.main_text(page) == f"Title\n{BODY.strip()}"
