"""WARC archives and main-text extraction."""

import gzip

import pytest
from texts import clash

from regrove.llm import html_text, warc
from regrove.session import scratch_path

PAGE = """<!DOCTYPE html><html><head><title>T&amp;T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><a href="/">Home</a></header><nav><ul><li><a>One</a><li><a>Two</a></ul></nav><div class="cookie-notice">We use cookies, lots of them.</div>
<!-- <p>hidden</p> --><article><header><h1>Title &lt;1&gt;</h1></header><p>First <b>bold</b>text&nbsp;here.<br>Next   line.<p title="a>b">Second &eacute; para</p>
<aside>Related things</aside><form><p>Sign up</p></form></article><section id="comments"><article><p>A reader's comment, rather long, with commas, and more.</p></article></section>
<div class="sidebar"><p>Side text, quite long, with commas, and more of it.</p></div><footer>&copy; us</footer></body></html>"""


def test_article_without_the_rest():
    assert html_text.main_text(PAGE)[0] == "Title <1> First boldtext here. Next line. Second é para"


def test_paths_decide_where_no_article_is_marked():
    paragraphs = "".join(f"<p>Paragraph {i} has some length, commas, and a full stop. It goes on, and on.</p>" for i in range(5))
    page = f"<body><div><ul><li><a>Menu a</a></li><li><a>Menu b</a></li></ul></div><div>{paragraphs}</div><div class='ad'>Buy, buy, buy this thing now, it is cheap.</div></body>"
    text = html_text.main_text(page)[0]
    assert text.startswith("Paragraph 0") and text.count("Paragraph") == 5 and "Menu" not in text and "Buy" not in text


BODY = "".join(f"<p>Paragraph {i} goes on, and on, with commas, for {'quite some length ' * 20}until it stops.</p>" for i in range(5))


@pytest.mark.parametrize("wrap", ["<div>{}</div>", "<div class='text'>{}</div>", "{}", "<div id='content'><div>{}</div></div>", "<table><tr><td>{}</td></tr></table>"])
def test_short_headings_lists_and_tables_of_the_body_stay(wrap):
    body = BODY.replace("<p>Paragraph 3", "<h2>Short title</h2><ul><li>one</li><li>two</li></ul><dl><dt>term</dt><dd>it</dd></dl><table><tr><th>h</th><td>7</td></tr></table><p>Paragraph 3")
    page = f"<body><div><ul><li><a>Menu a</a></li><li><a>Menu b</a></li></ul></div>{wrap.format(body)}<div class='ad'>Buy.</div></body>"
    text = html_text.main_text(page)[0]
    assert text.count("Paragraph") == 5 and " Short title one two term it h 7 Paragraph 3" in text and "Menu" not in text and "Buy" not in text


CARD = "<article class='card'><h3>Other story</h3><p>A teaser, short.</p></article>"


@pytest.mark.parametrize("page", ["<body><div id=content>{}</div>%s</body>" % CARD, "<body>%s<div>{}</div>%s</body>" % (CARD, CARD), "<main>{}%s</main>" % CARD])
def test_teaser_articles_are_no_content(page):
    text = html_text.main_text(page.format(BODY))[0]
    assert text.startswith("Paragraph 0") and text.count("Paragraph") == 5 and "teaser" not in text and "Other" not in text


def test_link_lists_inside_main_go_and_linked_headings_stay():
    links = "<ul>" + "".join(f"<li><a href=/{i}>Topic {i}</a></li>" for i in range(9)) + "</ul>"
    text = html_text.main_text(f"<main>{links}<div><h2><a href=#x>Head</a></h2>{BODY}<ul><li>short <a href=y>item</a></li></ul></div></main>")[0]
    assert text.startswith("Head Paragraph 0") and text.endswith(" short item") and "Topic" not in text
    assert "Topic 8" in html_text.main_text(f"<article>{BODY}<h2>References</h2>{links}</article>")[0]


def test_articles_outweigh_loose_text_and_short_ones_stay_whole():
    assert html_text.main_text(f"<body><h1>Site</h1><div>Some tagline, with marks. And more.</div><article><h1>T</h1>{BODY}<p>End</p></article></body>")[0].endswith("End")
    page = "<body><div class='x'>We are a shop.</div><article><h1>T</h1><p>Short text, of a few words, but the only one there is here.</p><p>x</p></article></body>"
    assert "T Short text" in html_text.main_text(page)[0] and html_text.main_text(page)[0].endswith(" x")
    posts = "".join(f"<article class=post><h2>Post {i}</h2><p>{'Words, and more words. ' * (1 + 20 * (i % 2))}</p></article>" for i in range(4))
    assert html_text.main_text(f"<main>{posts}</main>")[0].count("Post") == 4


LINES = "<p>Two or three sentences, of the kind that authors write. They go on for a while, and stop.</p>"


@pytest.mark.parametrize("part", [
    f"<section id='related-work'><h2>Kept</h2>{LINES}</section>", "<h2 id='search'>Kept</h2>", "<h2 id='legal'><a href='#legal'>Kept</a></h2>", "<h3 id=comments>Kept</h3>",
    f"<section id='copyright'><p>Kept</p>{LINES}</section>", f"<div class='side note'><p>Kept</p>{BODY}</div>", f"<section id='discussion'><h2>Kept</h2>{LINES}</section>",
    "<p id=notice>Kept</p>", f"<div class='legal text'><h2>Kept</h2>{BODY}</div>",
])
def test_anchors_inside_an_article_lose_nothing(part):
    text = html_text.main_text(f"<body><article><h1>T</h1>{BODY}{part}<p>End.</p></article></body>")[0]
    assert " Kept" in text and text.endswith("End.") and (LINES not in part or "sentences" in text)


@pytest.mark.parametrize("part", [
    f"<div class='ad'>{BODY}</div>", f"<div id='comments'>{BODY}</div>", "<div id='related'><a href=x>Another story, and more</a> <a href=y>One more</a></div>", "<div class='share'>Tell all</div>",
    "<ul class='social'><li><a href=x>Here</a><li><a href=y>There</a></ul>", "<div class='sidebar'><p>See this.</p></div>", "<div id='ad-slot'>Buy.</div>", "<nav id=toc>x</nav>",
])
def test_boilerplate_inside_an_article_goes(part):
    assert html_text.main_text(f"<article>{BODY}{part}<p>End.</p></article>")[0] == html_text.main_text(f"<article>{BODY}<p>End.</p></article>")[0]


def test_parts_in_divs_of_their_own_stay():
    page = f"<body><h1>Title</h1><div><div><h2>Part</h2></div>{BODY.replace('<p>', '<div><p>').replace('</p>', '</p></div>')}</div><div class='x'>Tiny.</div></body>"
    text = html_text.main_text(page)[0]
    assert text.startswith("Title Part Paragraph 0") and text.count("Paragraph") == 5 and "Tiny" not in text


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("plain  text", "plain text"), ("<p>a</p><p", "a"), ("<nav>x</nav>", ""), ("<p>a &am b &amp c</p>", "a &am b & c"),
    ("<script>never ends", ""), ("</div></p>x", "x"), ("<article><p>don't <a href=x'y>go</a> <</p></article>", "don't go <"), ("<article>" + "<div>" * 3000 + "deep", "deep"),
])
def test_odd_pages(page, text):
    assert html_text.main_text(page)[0] == text


@pytest.mark.parametrize("page", ["<div>x " * 100_000, "<x>y " * 100_000, "<a>" * 100_000 + "t", "<div>" * 100_000 + "</p>" * 100_000, "<p><b>" * 100_000 + "z", "<svg/>" * 100_000])
def test_deep_nesting_takes_linear_time(page):
    import time

    began = time.perf_counter()
    html_text.main_text(page)
    assert time.perf_counter() - began < 5


def brute_scores(found):
    """Ratios per path (its names, as the elements around a block have them), by the formula, block by block."""
    same = lambda a, b: (a["names"], a["state"]) == (b["names"], b["state"])
    marks = lambda t: sum(c in ".,;:!?…。、，；：！？" for c in t)
    ratio = []
    for b in found:
        own = [x for x in found if same(x, b)]
        length, n = sum(len(x["text"]) for x in own), len(own)
        ratio.append(length / n * (1 + sum(marks(x["text"]) for x in own) / n) * (1 - min(1.0, sum(x["link"] for x in own) / length)))
    out = []
    for i, b in enumerate(found):
        near = 0.25 * ratio[max(i - 1, 0)] + 0.5 * ratio[i] + 0.25 * ratio[min(i + 1, len(found) - 1)]
        out.append((near * ratio[i]) ** 0.5 * {-1: 0.0, 0: 1.0, 1: html_text.ARTICLE}[b["state"]])
    return out


def test_path_ratios_match_brute_force(spark, sf):
    for row in spark.read.parquet(f"{sf}/pages.parquet").select("html").collect():
        found, elements = html_text.page_blocks(row["html"])
        for b in found:
            names, e = [], b["element"]
            while e > 0:
                names.append(elements[e].name)
                e = elements[e].parent
            b["names"] = tuple(names)
        assert html_text.scores(found) == pytest.approx(brute_scores(found))


def pages(spark, rows):
    return clash(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3))


def test_extraction_keeps_every_row(spark):
    rows = [(1, "u", PAGE), (None, None, None), (2, "u", ""), (2, "u", ""), (3, "u", "<p>" + "long " * 50_000)]
    got = {(r["page_id"], r["n_chars"]) for r in html_text.extract_text(pages(spark, rows)).collect()}
    assert got == {(1, 55), (None, 0), (2, 0), (3, 249_999)}
    assert html_text.extract_text(pages(spark, rows).limit(0)).count() == 0


def test_archives_come_back(spark):
    hostile = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n\n"
    rows = [(4, "http://a.b/x y\r\nWARC-Type: z", PAGE), (2, "http://a.b/", PAGE), (9, None, hostile), (None, "u", hostile), (7, "u", None), (8, "u", ""), (2, "http://a.b/", PAGE), (5, "u", "é漢" * 10_000)]
    path = scratch_path(spark, "warc-test")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path)
    records = warc.read_archives(spark, path).cache()
    assert records.groupBy("kind").count().where("kind in ('request', 'metadata')").agg({"count": "sum"}).first()[0] == 2 * len(rows)
    captures = [r.asDict(True) for r in warc.assemble(records).collect()]
    assert len(captures) == len(rows) and all(len(c["requests"]) == len(c["metadata"]) == 1 for c in captures)
    ids = {c["record_id"]: c for c in captures}
    full = sorted(((c["page_id"] or "", (ids[c["response"]["refers_to"]] if c["response"]["refers_to"] else c)["response"]["payload"].decode()) for c in captures))
    assert full == sorted(("" if i is None else str(i), h or "") for i, _, h in rows)
    kinds = sorted((c["page_id"] or "", c["response"]["kind"], ids[c["response"]["refers_to"]]["page_id"] if c["response"]["refers_to"] else None) for c in captures)
    assert kinds == sorted([("2", "response", None), ("2", "revisit", "2"), ("4", "revisit", "2"), ("9", "response", None), ("", "revisit", "9"), ("7", "response", None), ("8", "revisit", "7"), ("5", "response", None)])
    assert {c["response"]["payload_bytes"] for c in captures if c["page_id"] in ("7", "8")} == {0}


def test_smaller_payloads_are_all_responses(spark):
    path = scratch_path(spark, "warc-test")
    warc.write_archives(spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string").coalesce(1), path, min_bytes=3)
    assert sorted(r["kind"] for r in warc.read_archives(spark, path).where("kind in ('response', 'revisit')").collect()) == ["response"] * 3 + ["revisit"]


def test_empty_archives(spark):
    path = scratch_path(spark, "warc-test")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.assemble(warc.read_archives(spark, path)).count() == 0


def test_parser_refuses_what_is_no_record(spark):
    good = b"WARC/1.1\r\nWARC-Type: metadata\r\nWARC-Record-ID: <u>\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    assert len(list(warc.parse(good * 2))) == 2
    for bad in (good[:-1], good[3:], good.replace(b": 2", b": 1")):
        with pytest.raises(ValueError):
            list(warc.parse(bad))
    assert gzip.decompress(gzip.compress(good)) == good


def test_two_hop_concurrency(spark):
    rows = [("r", "response", None, "u", None, 1, "d", None, None), ("q", "request", "r", "u", None, None, None, None, None), ("m", "metadata", "q", "u", None, None, None, "7", None),
            ("lost", "request", "gone", "u", None, None, None, None, None)]
    got = {r["record_id"]: r for r in warc.assemble(spark.createDataFrame(rows, warc.RECORDS)).collect()}
    assert got["r"]["page_id"] == "7" and got["r"]["requests"][0]["record_id"] == "q" and got["gone"]["response"] is None
