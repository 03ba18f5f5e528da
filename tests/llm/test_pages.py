"""Main text of pages and WARC archives."""

import base64
import hashlib
import html
import io
import re
import time
from collections import Counter

import pytest

from voicegrid.llm import html_region as H, warc as W
from voicegrid.llm.queries import op3_html_region, op9_warc_ranges

PAGE_SCHEMA = "page_id long, url string, html string, text string, digest string, path string, start long"
PAGES = [
    (1, "http://a/1", "<p>same</p>"), (2, None, "<p>same</p>"), (3, "http://a/ 3", None), (4, "u", ""), (4, "u", ""),
    (None, "n", "<p>alone &amp; unnamed"), (None, "n", "<p>same</p>"), (5, "long", "<article>" + "<p>word word" * 30_000 + "</article>"),
    (6, "cut", "<div class='x' <p>broken <!-- never closed"), (7, "script", "<script>var a = '<p>no</p>';</script><p>yes it is</p>"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "t", "d", "p", 1) for p in PAGES], PAGE_SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def no_pages(spark):
    return spark.createDataFrame([], PAGE_SCHEMA)


def article_text(source):
    inner = re.search(r"<article[^>]*>(.*?)</article>", source, re.DOTALL)[1]
    blocks = re.split(r"</?(?:p|h1|h2|h3|ul|li|div|blockquote)\b[^>]*>", inner)
    texts = [html.unescape(re.sub(r"<[^>]*>", lambda m: " " if m[0] == "<br>" else "", b)).split() for b in blocks]
    return "\n".join(" ".join(t) for t in texts if t)


def test_pages_give_their_articles(spark):
    sources = {r["page_id"]: r for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    rows = op3_html_region(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(sources)
    for row in rows:
        assert row["text"] == article_text(sources[row["page_id"]]["html"]) and row["n_chars"] == len(row["text"])


BODY = "<h1>Title &lt;x&gt;</h1><div class=body><p>First <b>bold</b> paragraph with some words and more words.<p>Second one<br>line &nbsp; two.{}<p>Third with a <a href=x>link</a> inside.</div>"
AROUND = "<body class='has-sidebar'><header><h1>Site</h1></header><ul class=menu><li><a href=/>Home</a></ul><div id=cookieNotice>We use cookies</div>{}<section id=comments><p>A reader says hi in a rather long comment with many words.</p></section><div class='ad'>Buy now</div><footer>&copy; 2020</footer></body>"
EXPECTED = "Title <x>\nFirst bold paragraph with some words and more words.\nSecond one line two.\nThird with a link inside."


@pytest.mark.parametrize("holder", ["<div id=content>{}</div>", "<article>{}</article>", "<main>{}</main>"])
@pytest.mark.parametrize("inside", ["", "<aside>See also this</aside>", "<form><input>Sign up<button>Go</button></form>", "<script>x='<p>'</script>", "<div class='social-share'>Share me</div>", "<nav><a>top</a></nav>"])
def test_boilerplate_is_left_out(holder, inside):
    source = AROUND.format(holder.format(BODY.format(inside)))
    assert H.main_text(source, H.DEFAULT_WEIGHTS) == EXPECTED


WRAPPED = "<article><h1>Head</h1>" + "<p>Some words of an article that goes on for a while, and then ends.</p>" * 6 + "</article>"
WRAPPED_TEXT = "\n".join(["Head"] + ["Some words of an article that goes on for a while, and then ends."] * 6)


@pytest.mark.parametrize("source", [
    "<div class='layout has-sidebar'>{}</div>", "<form id='aspnetForm'><div>{}</div></form>", "<section class='social-science'>{}</section>",
    "<div id='content-with-sidebar'><div class=banner-wrap>{}</div><div class=sidebar><p>Other things here</p></div></div>", "<!-->{}", "<!--->{}",
    "<!-- a -- b -->{}<!-- open", "<div role=form>{}</div><div class=comments><article class=comment><p>I liked it a lot, thank you</p></article></div>",
])
def test_wrappers_keep_their_article(source):
    assert H.main_text("<body>" + source.format(WRAPPED) + "</body>", H.DEFAULT_WEIGHTS) == WRAPPED_TEXT
    plain = WRAPPED.replace("<article>", "<div>").replace("</article>", "</div>")
    assert H.main_text("<body>" + source.format(plain) + "</body>", H.DEFAULT_WEIGHTS) == WRAPPED_TEXT


def test_link_paragraphs_stay_and_menus_go():
    body = "<div><p>Plain words to begin with, and some more of them.</p><p><a href=x>A paragraph that is a link</a></p><p>And words to end with, after the link.</p><ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul></div>"
    text = H.main_text(f"<body>{body}</body>", H.DEFAULT_WEIGHTS)
    assert text.split("\n") == ["Plain words to begin with, and some more of them.", "A paragraph that is a link", "And words to end with, after the link."]


def test_long_comments_stay_out():
    comments = "<div class=comments>" + "<p>A reader goes on and on about nothing in particular here.</p>" * 60 + "</div>"
    assert H.main_text(f"<body>{WRAPPED}{comments}</body>", H.DEFAULT_WEIGHTS) == WRAPPED_TEXT
    plain = WRAPPED.replace("article>", "div>")
    assert H.main_text(f"<body>{plain}{comments}</body>", H.DEFAULT_WEIGHTS) == WRAPPED_TEXT


@pytest.mark.parametrize("source", [
    "<div>" * 100_000 + WRAPPED, "<div>" * 50_000 + WRAPPED + "</span>" * 50_000, "<b>" * 50_000 + "<p>x y z" * 50_000, "<div class=nav>" * 50_000 + WRAPPED,
    "<table><tr><td>" * 30_000 + WRAPPED + "</p>" * 30_000, "<li><b>w" * 60_000, ("<div><p>one two three</p>" * 30_000),
])
def test_deep_pages_take_linear_time(source):
    began = time.process_time()
    weights = H.DEFAULT_WEIGHTS
    H.feature_counts(H.Page(source))
    H.main_text(source, weights)
    assert time.process_time() - began < 20


def test_region_is_the_best_sum():
    page = H.Page("<p>a b c</p><li>x</li><li>y</li><li>z</li><p>d e f g</p>")
    weights = {"word": 1.0, "tag": -1.0}
    scores = [n * (weights["word"] if f.startswith("word") else weights["tag"]) for f, n, _ in page.row]
    best = max(sum(scores[a:b]) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1))
    low, high = H.best_region(page, weights)
    assert sum(scores[low:high]) == best


def test_awkward_pages(pages, no_pages):
    weights = H.learn_weights(pages)
    rows = H.extract(pages, weights).collect()
    assert Counter(r["page_id"] for r in rows) == Counter(p[0] for p in PAGES)
    by_url = {r["url"]: r["text"] for r in rows}
    assert by_url["u"] == "" and by_url["http://a/ 3"] == "" and by_url["script"] == "yes it is"
    assert by_url["long"].count("\n") == 29_999
    assert H.extract(no_pages, H.learn_weights(no_pages)).count() == 0


def digest(source):
    return base64.b32encode(hashlib.sha1((source or "").encode()).digest()).decode()


def test_archive_query_equals_plain_rules(spark):
    sources = {r["page_id"]: r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    first = {}
    for page, source in sorted(sources.items()):
        first.setdefault(source, page)
    expected = [
        (p, len(s.encode()), digest(s), "response" if first[s] == p else "revisit", None if first[s] == p else first[s])
        for p, s in sorted(sources.items())
    ]
    assert sorted(map(tuple, op9_warc_ranges(spark, "/root/testdata/sf0.01").collect())) == expected


@pytest.mark.parametrize("split", [97, 4_096, 1 << 30])
def test_every_record_is_read_once_at_any_split(pages, split):
    archives = W.write_archives(pages, archive_bytes=2_000)
    rows = W.read_archives(archives, payload=True, split_bytes=max(split, 97)).collect()
    assert Counter(r["page_id"] for r in rows) == Counter(p[0] for p in PAGES)
    kinds = Counter((r["page_id"], r["record_type"], r["refers_to"], r["payload_digest"]) for r in rows)
    assert kinds[1, "response", None, digest("<p>same</p>")] == 1
    assert kinds[2, "revisit", 1, digest("<p>same</p>")] == 1 and kinds[None, "revisit", 1, digest("<p>same</p>")] == 1
    assert kinds[3, "response", None, digest("")] == 1 and kinds[4, "revisit", 3, digest("")] == 2
    assert all(r["payload_digest"] == r["stated_digest"] for r in rows)
    assert {r["payload"].decode() for r in rows if r["page_id"] == 5} == {PAGES[7][2]}


def test_small_payloads_stay_responses(pages, no_pages):
    rows = W.read_archives(W.write_archives(pages, min_bytes=5)).collect()
    assert {r["record_type"] for r in rows if r["page_id"] in (3, 4)} == {"response"}
    assert {r["record_type"] for r in rows if r["page_id"] == 2} == {"revisit"}
    assert W.read_archives(W.write_archives(no_pages)).count() == 0


def test_ranges_own_what_begins_inside_and_skip_false_starts():
    members = [W.build_record(k, "u", b"body %d " % k * 200, None, False) for k in range(6)]
    data = members[0] + W.MAGIC + b"\x00no member" + b"".join(members[1:3]) + members[3][:60] + b"".join(members[4:])
    whole = [W.parse_record(r)["page_id"] for r in W.records_in(io.BytesIO(data), 0, len(data))]
    assert whole == [0, 1, 2, 4, 5]
    for step in (1, 7, 50, 333):
        parts = [W.parse_record(r)["page_id"] for a in range(0, len(data), step) for r in W.records_in(io.BytesIO(data), a, min(a + step, len(data)))]
        assert parts == whole
