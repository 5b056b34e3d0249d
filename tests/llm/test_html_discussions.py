"""Readers' comments of any number, sections that articles share, and all pages of the tables against a plain cut."""

import html
import random
import re

import pytest

from quarrylight.llm import html_extract, queries
from quarrylight.llm.common import table

DIR = "/root/testdata/sf0.01"
WRAPS = ['<div class="comments">{}</div>', '<section id="comments">{}</section>', '<ol class="comment-list">{}</ol>', '<div id="disqus_thread">{}</div>', '<div class="post-comments-area">{}</div>']
FRAMES = ["<body><nav>n</nav><article><h1>{h}</h1>{text}{talk}</article><footer>f</footer></body>", '<body><main><h1>{h}</h1><div class="entry">{text}</div>{talk}</main></body>', '<body><div class="wrap"><h1>{h}</h1><div class="entry">{text}</div>{talk}</div><footer>f</footer></body>']


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(2, 9))) for _ in range(n))


def extracted(spark, rows):
    frame = spark.createDataFrame([(i, "https://h.example/x", page) for i, page in enumerate(rows)], "page_id long, url string, html string")
    return {r["page_id"]: r["text"] for r in html_extract.main_text(frame).collect()}


@pytest.mark.parametrize("frame", range(len(FRAMES)))
@pytest.mark.parametrize("paragraphs, comments", [(2, 12), (8, 3)])
def test_comments_go_however_many(spark, frame, paragraphs, comments):
    rng = random.Random(frame)
    for wrap in WRAPS:
        rows, want = [], []
        for _ in range(5):
            head, body = words(rng, 4), [words(rng, 20) for _ in range(paragraphs)]
            tag = "li" if wrap.startswith("<ol") else "div"
            talk = wrap.format("".join(f"<{tag}><p>{words(rng, 25)}</p></{tag}>" for _ in range(comments)))
            rows.append(FRAMES[frame].format(h=head, text="".join(f"<p>{x}</p>" for x in body), talk=talk))
            want.append("\n".join([head, *body]))
        got = extracted(spark, rows)
        assert [got[i] for i in range(5)] == want, wrap


def test_an_article_under_comment_words_stays(spark):
    """Where all text stands under such words, they mean nothing."""
    rng = random.Random(1)
    texts = [[words(rng, 3), words(rng, 20), words(rng, 30)] for _ in range(5)]
    got = extracted(spark, [f'<body><article><h1>{h}</h1><div class="comment-content"><p>{a}</p><p>{b}</p></div></article></body>' for h, a, b in texts])
    assert [got[i] for i in range(5)] == ["\n".join(t) for t in texts]


@pytest.mark.parametrize("place", ["first", "middle", "last"])
def test_sections_that_articles_share_stay(spark, place):
    rng = random.Random(2)
    rows, want = [], []
    shared = "<section><h2>Method</h2><p>We ask a thousand people every year.</p></section>"
    for _ in range(7):
        head, a, b = words(rng, 4), words(rng, 20), words(rng, 30)
        at = ["first", "middle", "last"].index(place)
        parts = [f"<p>{a}</p>", f"<p>{b}</p>"]
        parts.insert(at, shared)
        lines = [a, b]
        lines.insert(at, "Method\nWe ask a thousand people every year.")
        rows.append(f"<body><nav>x</nav><article><h1>{head}</h1>{''.join(parts)}</article><footer>Same</footer></body>")
        want.append("\n".join([head, *lines]))
    got = extracted(spark, rows)
    assert [got[i] for i in range(7)] == want


def plain(page):
    """The article of the tables' pages, cut by hand: blocks end at block tags and line breaks inside paragraphs are spaces."""
    body = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)[1]
    body = re.sub(r"<!--.*?-->", "", body, flags=re.S)
    body = re.sub(r"</?(?:p|h[1-6]|div|ul|ol|li|blockquote|pre|table|tr|td|section|figure)\b[^>]*>", "\n", re.sub(r"[\r\n]", " ", body))
    lines = [" ".join(html.unescape(re.sub(r"<[^>]*>", lambda m: " " if m[0].startswith("<br") else "", line)).split()) for line in body.split("\n")]
    return "\n".join(x for x in lines if x)


def test_all_pages_of_the_tables(spark):
    pages = table(spark, DIR, "pages").collect()
    got = {r["page_id"]: r for r in queries.op5_html_extraction(spark, DIR).collect()}
    assert got.keys() == {r["page_id"] for r in pages}
    for r in pages:
        assert got[r["page_id"]]["text"] == (plain(r["html"]) if r["html"] else ""), r["page_id"]
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"]) and got[r["page_id"]]["url"] == r["url"]


def test_a_wrapper_knows_all_pages_of_its_host(spark):
    """What is the same on most pages and differs on a few is text, and partitions and their order do not matter."""
    rng = random.Random(5)
    rows, want = [], []
    for i in range(120):
        head, a, b = words(rng, 4), words(rng, 20), words(rng, 30)
        last = f"Written on day {i} of the year by nobody" if i % 40 == 7 else "Written on some day of the year by nobody"
        rows.append(f"<body><article><h1>{head}</h1><p>{a}</p><p>{b}</p><section><p>{last}</p></section></article></body>")
        want.append("\n".join([head, a, b, last]))
    got = extracted(spark, rows)
    assert [got[i] for i in range(120)] == want
    frame = spark.createDataFrame([(i, "https://h.example/x", page) for i, page in enumerate(rows)], "page_id long, url string, html string")
    one, other = (html_extract.infer_wrappers(f).collect() for f in (frame.coalesce(1), frame.orderBy(frame.page_id.desc()).repartition(7)))
    assert one == other
