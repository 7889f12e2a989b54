import html as h
import time
from collections import Counter

import pytest

from fieldloom.llm.html_blocks import scan
from fieldloom.llm.html_extract import extract, main_text, surge_and_dive


def page(article, before="", after="", close=True):
    return (
        '<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>T</title><style>p{margin:0}</style><script>var t="</p>";track(1);</script></head><body>'
        f'<nav><ul><li><a href="/x">menu entry</a></li></ul></nav>{before}<div class="ad">Buy this now, it is very good and cheap for everyone.</div><article>{article}</article>{after}<footer>&copy; site</footer>'
        + ("</body></html>" if close else "")
    )


@pytest.mark.parametrize("close", [True, False])
def test_article_only(close):
    text, *_ = extract(page("<h1>Head &amp; more</h1><p><b>one\n  two<br>three<p>f&uuml;nf &lt;6&gt; &#8364;</p>", close=close))
    assert text == "Head & more one two three fünf <6> €"


def test_boilerplate_kinds():
    before = '<header>site head</header><aside>side words</aside><div id="cookie-notice">We use cookies on this site, please accept them all.</div><form><p>Your mail</p></form>'
    after = '<section class="comments"><p>A reader wrote a very long comment here, which is not the article.</p></section><div role="complementary">more</div>'
    assert extract(page("<p>kept</p><!-- <p>no</p> --><div class='ad'>advert</div><p>short</p><noscript>n</noscript>", before, after))[0] == "kept short"


def test_without_an_article_mark():
    body = "".join(f"<p>Paragraph {i} has words enough to be a block of text that counts as dense.</p>" for i in range(4))
    html = f'<body><div class="menu"><a href="a">A</a><a href="b">B</a></div><h1>Title here</h1>{body}<p><a href="x">linked list of other pages</a></p><div class="sidebar">s</div></body>'
    text = extract(html)[0]
    assert text.startswith("Title here Paragraph 0") and text.endswith("counts as dense.") and "linked" not in text


def test_odd_pages(spark):
    cases = [None, "", "plain text", "<p>", "<<<>>>", "a < b", "<article></article>", "<script>x", "<p>" * 300 + "deep", "<article>" + "<p>w</p>" * 5000 + "</article>"]
    frame = spark.createDataFrame([(i, None if i % 2 else f"u{i}", c, "x") for i, c in enumerate(cases)] + [(None, "u", "<p>a</p>", "x")], "page_id long, url string, html string, n_chars string")
    found = {r["page_id"]: r for r in main_text(frame).collect()}
    assert found[0]["text"] == found[1]["text"] == "" and found[2]["text"] == "plain text" and found[None]["text"] == "a"
    assert found[9]["n_chars"] == 9999 and all(r["n_chars"] == len(r["text"]) for r in found.values())
    assert main_text(frame.limit(0)).count() == 0


def test_surge_and_dive():
    assert surge_and_dive([0, 0, 5, 0, 90, 80, 0, 100, 0, 0, 0], 60) == (2, 10)
    assert surge_and_dive([0, 0, 0], 1) == (0, 0)
    assert surge_and_dive([3], 60) == (0, 1)


def test_whole_template_against_a_plain_reading(spark, sf):
    import re

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in main_text(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        blocks = [" ".join(h.unescape(re.sub(r"<[^>]+>", lambda m: " " if m[0] == "<br>" else "", b)).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert got[r["page_id"]] == " ".join(b for b in blocks if b)


def test_lines_decide_without_marks(spark, sf):
    """With marks, classes, ids and roles stripped, lines alone find the articles of the whole table."""
    import re

    total = found = kept = 0
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        whole = extract(r["html"])[0].split()
        bare = re.sub(r"</?(?:article|main)>", "", re.sub(r' (?:class|id|role|itemprop)="[^"]*"', "", r["html"]))
        text = extract(bare)[0].split()
        both = sum((Counter(whole) & Counter(text)).values())
        total, found, kept = total + len(whole), found + both, kept + len(text)
    assert found >= 0.99 * total and found >= 0.95 * kept


def test_the_core_chooses_among_marked_elements():
    long = "".join(f"<p>Paragraph {i} of the story has words enough to be dense text.</p>" for i in range(5))
    teasers = "".join(f"<article><h3>Other story {i}</h3></article>" for i in range(4))
    assert extract(f"<main><article><h1>A</h1>{long}<p>z</p></article></main>{teasers}")[0].startswith("A Paragraph 0")
    assert "Other" not in extract(f"<main><article><h1>A</h1>{long}</article>{teasers}</main>")[0]
    two = f"<main><article><h1>A</h1>{long}</article><article><h1>B</h1>{long}</article></main>"
    assert {"A", "B"} < set(extract(two)[0].split())
    # a core that stands outside every mark is kept as it is
    assert extract(f"<article>teaser</article>{long}")[0].endswith("Paragraph 4 of the story has words enough to be dense text.")


def test_unquoted_and_open_attributes():
    text = "<p title=it's>First paragraph.</p><p class='x' data-a=\"b>c\">Second one.</p>"
    assert extract(f"<article>{text}</article>")[0] == "First paragraph. Second one."
    assert extract("<p>a</p><p x=1 / y>b</p><p/>c<a href=http://x/y/>d</a>")[0] == "a b cd"
    assert extract('<p>a</p><a href="never closed>b')[0] == "a"
    assert extract("<p>kept</p><a b ")[0] == "kept"
    assert extract("<p>1 < 2 <3 </ x </>")[0] == "1 < 2 <3 </ x </>"


@pytest.mark.parametrize("piece", ["<a b ", "<div>", "<span>", "</b>", "<b><div></b>", "<p><b>", "<a b='", '<a b="', "<li>", "<!--", "<table><tr>", "<article>", "&", "<", "<figure><img src=x>"])
def test_time_is_linear(piece):
    def seconds(n):
        html = "<b><div>" + piece * n
        began = time.perf_counter()
        extract(html)
        return time.perf_counter() - began

    seconds(2_000)
    small, large = (min(seconds(n) for _ in range(3)) for n in (4_000, 32_000))
    assert large < 30 * max(small, 0.002)


def test_media_keep_their_place_and_caption():
    p = scan('<p>one</p><figure><img src="a.png" data-digest="d1"><figcaption>cap &amp; tion</figcaption></figure><p>two<img src=b.png alt=x>three</p>')
    assert [(m.source, m.after_blocks, m.caption) for m in p.media] == [("a.png", 1, "cap & tion"), ("b.png", 3, "")]
