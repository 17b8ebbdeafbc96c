"""Main texts of pages whose articles are known, host by host."""

import html as H
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from glossa.llm import html_consensus as h

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda".split()
CHROME = '<nav class="top"><a href="/">Home</a> <a href="/x">All our pages</a></nav><div class="cookie-notice"><p>We use cookies, lots of them.</p></div>'
LAST = '<div id="comments"><p>A reader says a lot of things about this article, really a lot.</p></div><aside><p>Aside.</p></aside><form><p>Sign up</p><input></form><footer><p>&copy; all</p></footer></body></html>'


def article(draw):
    return [" ".join(draw.choices(WORDS, k=draw.randrange(4, 40))) + " &amp; co." for _ in range(draw.randrange(1, 6))]


def page(kind, paragraphs, k, note):
    """A page by template; `note` is chatter outside the article in a container of no telling name."""
    body = f"<h1>Title {k}</h1>" + "".join(f"<p>{p[:5]}<b>{p[5:9]}</b>{p[9:]}" for p in paragraphs)
    chatter = f'<div class="x{k}"><p>{note}</p></div>'
    inner = {
        "article": f'<article class="post-{k}">{body}<div class="ad">Buy this now</div></article>',
        "div": f'<div class="wrap"><div class="story s{k}">{body}<ul class="share"><li>Share it</li></ul></div></div>',
        "table": f"<table><tr><td class=side><p>x</p><td class=text>{body}</table>",
    }[kind]
    return f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>if (a<b) '</p>'</script></head><body>{CHROME}{chatter}{inner}<!-- <p>no</p> -->{LAST}"


def expected(k, paragraphs):
    return "\n\n".join([f"Title {k}", *(H.unescape(p) for p in paragraphs)])


@pytest.fixture(scope="module")
def planted():
    draw, rows = random.Random(3), []
    for k in range(240):
        kind, host = (("article", "a.example.com"), ("div", "b.example.org:80"), ("table", "c.example.net"), ("div", "a.example.com"))[k % 4]
        paragraphs = article(draw)
        # on every fifth page the chatter is longer than the article: the page alone would be wrong
        note = "chatter " * (len(" ".join(paragraphs)) // 2 if k % 20 < 4 else 3)
        rows.append((k, f"http://{host}/p/{k}?q=1", page(kind, paragraphs, k, note), expected(k, paragraphs)))
    return rows


@pytest.mark.parametrize("most_hosts", [500_000, 0])
def test_planted_articles(spark, planted, most_hosts):
    df = spark.createDataFrame([r[:3] for r in planted], "page_id long, url string, html string").repartition(5)
    df = df.withColumns({c: F.lit("x") for c in ("host", "paths", "salt", "text", "id", "agreed")})
    got = h.main_texts(df, most_hosts=most_hosts, salts=4).collect()
    assert {r.page_id: r.text for r in got} == {r[0]: r[3] for r in planted} and all(r.n_chars == len(r.text) and r.agreed for r in got)


def test_votes_overrule_a_page(planted):
    """Without its host, a page with long chatter names the wrong container: the vote is what mends it."""
    wrong = [r for r in planted if h.extract(r[2], [])[0] != r[3]]
    assert len(wrong) > 20


def test_given_pages(spark, sf):
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    want = {}
    for r in rows:
        inside = re.search(r"<article>(.*)</article>", r.html, re.S).group(1).replace("<br>", " ")
        parts = (" ".join(H.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inside))
        want[r.page_id, r.url] = "\n\n".join(p for p in parts if p)
    got = h.main_texts(spark.read.parquet(f"{sf}/pages.parquet")).collect()
    assert {(r.page_id, r.url): r.text for r in got} == want


@pytest.mark.parametrize(
    "html,text",
    [
        ("", ""), ("plain  text\n here", "plain text here"), ("<p>a<p>b", "a\n\nb"), ("<nav>only menu</nav>", ""), ("x &lt; y &amp &eacute;&#33;", "x < y & é!"), ("a < b and c > d", "a < b and c > d"),
        ("<p>kept <!-- gone", "kept"), ("<p>kept<script>gone", "kept"), ("<p>kept<a href='x", "kept"), ("<p>a<br>b<wbr>c<i>d</i>e", "a bcde"), ("<form><p>All in a form</p></form>", "All in a form"),
        ("<article><header><h1>T</h1></header><p>One</p><form>f</form></article><header>H</header>", "T\n\nOne"), ("<div hidden>no</div><p style='display: none'>no</p><p>yes</p>", "yes"),
        ("<main><section><p>" + "a " * 30 + "</p></section><section><p>b</p></section></main>", "a " * 29 + "a\n\nb"), ("<p>t<!-->u</p>", "tu"), ("<div class='comments'><article><p>c</p></article></div><p>m</p>", "m"),
        ("<table><tr><td>1<td>2<tr><th>3</table>", "1\n\n2\n\n3"), ("<P CLASS=ad>no<P>yes</DIV></p>", "yes"), ("<p>a  b</p>", "a b"), ("<noscript><p>no</p></noscript><p>yes", "yes"),
    ],
)
def test_odd_markup(html, text):
    assert h.extract(html, [])[0] == text


def test_hosts(spark):
    urls = ["HTTP://User:pw@WWW.Ex-1.com:8080/a", "https://[::1]:9/x", "//no", "", None, "mailto:a@b", "http://a?b"]
    assert [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(h.host_of(F.col("u"))).collect()] == ["www.ex-1.com", "[::1]", None, None, None, None, "a"]


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(None, "http://a/", None), (1, None, "<p>x</p>"), (1, None, "<p>x</p>"), (2, "http://a/", "")]
    got = h.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(((r.page_id, r.url, r.text, r.n_chars) for r in got), key=repr) == sorted([(None, "http://a/", "", 0), (1, None, "x", 1), (1, None, "x", 1), (2, "http://a/", "", 0)], key=repr)
    assert h.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_long_and_hostile_pages_stay_linear():
    began = time.time()
    for html in ('<a "' * 200_000, "<a '<b \"" * 100_000 + ">", "<!-- " * 200_000, "<div>" * 50_000 + "text", "<p>word " * 200_000, "<svg>" * 50_000, "</div>" * 100_000):
        h.extract(html, [])
    assert time.time() - began < 30
