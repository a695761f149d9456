import gzip
import hashlib
import random

import pytest

from lumisift.llm import html, warc
from lumisift.session import fresh_dir


def pages_frame(spark, rows):
    return spark.createDataFrame([(*r, r[0], "x") for r in rows], "page_id bigint, url string, html string, id bigint, payload string")


PAGES = [(3, "http://a/b c\r\nWARC/1.1: x", "é" * 80), (1, None, "é" * 80), (2, "http://b/ü", "é" * 80), (4, "u", "short"), (5, "u", "short"),
         (6, None, None), (7, "u", ""), (None, "u", "z" * 200), (8, "u", "z" * 200), (8, "u", "z" * 200), (9, "u", "long " * 50_000)]


def want(rows):
    first = {}
    for page, _, text in rows:
        if page is not None and text and len(text.encode()) >= 100:
            first[text] = min(first.get(text, page), page)
    out = []
    for page, _, text in rows:
        raw = (text or "").encode()
        revisit = (text or "") in first and page != first[text]
        out.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first[text] if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("split", [1 << 20, 701, 64])
def test_round_trip_at_any_cut(spark, split):
    got = warc.round_trip(pages_frame(spark, PAGES), split_bytes=split)
    assert sorted(map(tuple, got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str) == want(PAGES)


def test_no_pages(spark):
    assert warc.round_trip(pages_frame(spark, [])).collect() == []


def test_urls_and_payloads_come_back(spark):
    files = warc.write_warc(warc.plan_records(pages_frame(spark, PAGES)), fresh_dir(spark, "warc"))
    got = {r.page_id: r for r in warc.read_warc(spark, files, 100).collect()}
    assert got[4].payload == b"short" and got[1].payload == ("é" * 80).encode() and got[2].payload is None and got[1].url is None
    assert got[2].url == "http://b/%C3%BC" and got[6].payload == b""


def test_magic_bytes_inside_a_member_and_damage(spark, tmp_path):
    def member(page, payload, level=6):
        return gzip.compress(warc.record(page, "u", payload, hashlib.sha256(payload).hexdigest(), "response", None, "now"), level)

    # Stored, not compressed: the payload's false members are in the file as they are.
    false = gzip.compress(b"no record") + warc.MAGIC * 5 + gzip.compress(b"WARC/1.1\r\nno field\r\n\r\n")
    data = member(1, false, 0) + b"\x1f\x8b\x08 damaged" + member(2, b"two") + member(3, random.Random(1).randbytes(5000))[:-9] + member(4, b"four")
    (tmp_path / "x.warc.gz").write_bytes(data)
    files = spark.createDataFrame([(f"file:{tmp_path}/x.warc.gz", len(data))], "path string, size bigint")
    for split in (10_000, 50, 7):
        got = {r.page_id: bytes(r.payload) for r in warc.read_warc(spark, files, split).collect()}
        assert got == {1: false, 2: b"two", 4: b"four"}


ARTICLE = "<article><h1>Head &amp; more</h1><p>First <b>bold</b>word\n of a line &lt;x&gt;.<br>Next</p><p>Short.</p><ul><li>one<li>two</ul></article>"
TEXT = "Head & more First boldword of a line <x>. Next Short. one two"


@pytest.mark.parametrize("page", [
    ARTICLE,
    f"<html><head><title>No</title><style>p{{}}</style><script>var a='<p>no</p>';</script></head><body><header>Site</header><nav><ul><li><a href=x>no</a></ul></nav>"
    f"<div class='ad'>Buy this long advert text now and again and again.</div>{ARTICLE}<!-- no --><footer>&copy; no</footer></body></html>",
    f"<body><div id='cookie-notice'><p>We use cookies, a long notice of many words to be passed over.</p></div><div class='sidebar'>side</div><main>{ARTICLE}</main>"
    f"<section class='comments'><article class='comment'><p>A reader says a lot of things here, at length.</p></article></section>",
    f"<body><form><label>Name</label><input><textarea>no</textarea><button>Go</button></form><div><div>{ARTICLE}</div></div><aside>no</aside><footer>x<p>y",
    ARTICLE.replace("</article>", "<p>") + "<foo",
])
def test_article_of_a_page(page):
    assert html.main_text(page) == TEXT


def test_page_without_an_article_element():
    long = "This is the body of the text, and it goes on for quite some words, as texts do. " * 3
    links = "".join(f"<a href=x{i}>link {i}</a> " for i in range(12))
    got = html.main_text(f"<body><div>{links}</div><div><p>{long}</p><p>Brief.</p><p>{long}</p></div><div>{links}</div></body>")
    assert got == " ".join(f"{long} Brief. {long}".split())


@pytest.mark.parametrize("page", [
    f"<html><head><title>No</title><meta charset=utf-8><body>{ARTICLE}</body></html>",
    f"<head><title>No</title>{ARTICLE}",
    f"<body><div class='site has-sidebar'>{ARTICLE}</div></body>",
    f"<body class='x'><div class='no-comments with-social'><div class=sidebar>side</div>{ARTICLE}</div></body>",
    f"<body><form id=page><div class='ad'>Buy.</div>{ARTICLE}<section class='comments'><article>A reader says a lot.</article></section></form></body>",
    f"<body><div class='widget'>{ARTICLE}</div><div class='ad'>Buy.</div></body>",
])
def test_whole_articles_are_not_skipped(page):
    assert html.main_text(page) == TEXT


def test_marks_that_hold_all_text_do_not_empty_a_page():
    text = words(300)
    assert html.main_text(f"<body><div class=widget>{text}</div><div class=promo>{text}</div></body>") == f"{text} {text}"


def words(n):
    return ("word " * n)[:n - 1] + "."


@pytest.mark.parametrize("top", ["", "<nav><ul><li><a href=x>no</a><li><a href=y>no</a></ul></nav>"])
@pytest.mark.parametrize("sizes", [(900, 700), (900, 3000), (250, 4000)])
def test_sibling_sections_are_kept(top, sizes):
    a, b, c = words(sizes[0]), words(80), words(sizes[1])
    head = "<html><head><title>T</title><meta charset=x><style>p{}</style><script>x</script></head>"
    page = f"{head}<body>{top}<div><section><p>{a}</p></section><section><h2>A heading of 20 chars</h2><p>{b}</p></section><section><p>{c}</p></section></div></body></html>"
    assert html.main_text(page) == f"{a} A heading of 20 chars {b} {c}"


@pytest.mark.parametrize("sizes", [(900, 60, 300, 2500, 40, 700), (60, 900, 150, 45, 80)])
def test_a_division_per_paragraph(sizes):
    texts = [words(n) for n in sizes]
    assert html.main_text("<body><div id=x>" + "".join(f"<div><p>{t}</p></div>" for t in texts) + "</div></body>") == " ".join(texts)


def test_rows_that_hold_little(spark):
    pages = pages_frame(spark, [(1, None, None), (2, "u", ""), (None, "v", "<p>x"), (None, "v", "<p>x"), (4, "w", "plain &am"), (5, "w", "<nav>a</nav>"),
                                (6, "w", "<p>" + "many words " * 100_000)])
    got = sorted([(r.page_id, r.url, r.text[:9], r.n_chars) for r in html.extract_main_text(pages).collect()], key=str)
    assert got == sorted([(1, None, "", 0), (2, "u", "", 0), (None, "v", "x", 1), (None, "v", "x", 1), (4, "w", "plain &am", 9), (5, "w", "", 0),
                          (6, "w", "many word", 1_099_999)], key=str)
    assert html.extract_main_text(pages_frame(spark, [])).collect() == []
