"""Archives read back by lookup, and the main text of pages."""

import base64
import gzip
import hashlib
import html
import os
import random
import re
from collections import Counter

import pytest

from ledgerloom.llm import warc
from ledgerloom.llm.common import read
from ledgerloom.llm.html_text import extract_pages, main_text
from ledgerloom.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"
PAGES = "page_id long, url string, html string"


def awkward_pages(spark):
    return spark.createDataFrame(
        [
            (1, None, None),
            (None, "http://a.b/", ""),
            (2, "http://a.b/", "x"),
            (2, "http://a.b/", "x"),
            (None, None, "x"),
            (3, "not a [url", "x\r\n\r\ny"),
            (3, "http://[::1", "é"),
            (4, "HTTP://WWW.A.B:80/Path?q=1#f\r\nWARC-Type: x", "z" * 300_000),
            (5, "http://same.org/", "x"),
            *[(10 + i, "http://same.org/", f"page {i % 7}") for i in range(40)],
        ],
        PAGES,
    )


def expected(rows):
    first = {}
    for r in rows:
        body = r["html"] or ""
        ids = first.setdefault(body, [])
        if r["page_id"] is not None:
            ids.append(r["page_id"])
    out = []
    for r in rows:
        raw = (r["html"] or "").encode()
        least = min(first[r["html"] or ""], default=None)
        later = r["page_id"] != least
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out.append((r["page_id"], len(raw), digest, "revisit" if later else "response", least if later else None))
    return Counter(out)


def found(df):
    return Counter(map(tuple, df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()))


def test_query_of_archives(spark):
    rows = read(spark, FOLDER, "pages").collect()
    assert found(QUERIES["op6_warc"](spark, FOLDER)) == expected(rows)


def test_archives_of_awkward_pages(spark, tmp_path, monkeypatch):
    pages = awkward_pages(spark).selectExpr("*", "page_id AS revisit", "url AS key")
    folder = f"file://{tmp_path}/archives"
    assert found(warc.archive_pages(pages, folder)) == expected(awkward_pages(spark).collect())
    # the files are ordinary archives: every record is a gzip member that starts with the version
    names = [n for n in os.listdir(tmp_path / "archives") if n.endswith(".warc.gz")]
    raw = b"".join(gzip.decompress((tmp_path / "archives" / n).read_bytes()) for n in names)
    assert len(re.findall(rb"(?m)^WARC/1\.1\r$", raw)) == pages.count()
    assert not re.search(rb"\r\nWARC-Type: x", raw)
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_smaller_payloads_are_no_revisits(spark):
    pages = spark.createDataFrame([(1, "u", "aa"), (2, "v", "aa"), (3, "w", "bbbb"), (4, "x", "bbbb")], PAGES)
    kinds = {r.page_id: r.record_type for r in warc.archive_pages(pages, least_bytes=3).collect()}
    assert kinds == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_lookup_finds_every_capture_across_blocks(spark, tmp_path):
    entries = [(f"org,x{i % 5})/", i // 3, f"f{i % 4}", i, 1) for i in range(200)]
    df = spark.createDataFrame(entries, warc.ENTRY_SCHEMA)
    folder = f"file://{tmp_path}/index"
    directory = warc.write_index(df, folder, 3, block_entries=7)
    assert sum(len(r["keys"]) for r in directory.collect()) >= 200 / 7
    wanted = spark.createDataFrame([(f"http://x{k}.org/", p) for k in range(6) for p in range(70)], "url string, page_id long")
    got = Counter(map(tuple, warc.find_entries(directory, wanted, folder).collect()))
    assert got == Counter(entries)


@pytest.mark.parametrize(("files", "ranges"), [(40, 3), (2, 30), (1, 1)])
def test_lookup_over_many_index_files_and_ranges(spark, tmp_path, files, ranges):
    """Ranges of wanted keys with many files, and ranges in which no file starts."""
    entries = [(f"com,x)/{i % 97:03d}", i, f"f{i % 3}", i, 1) for i in range(600)]
    entries += [("com,x)/hot", i, "f", i, 1) for i in range(300)]
    df = spark.createDataFrame(entries, warc.ENTRY_SCHEMA)
    folder = str(tmp_path / "index")
    directory = warc.write_index(df, folder, files, block_entries=5)
    asked = [(f"http://x.com/{key.rpartition('/')[2]}", page) for key, page, *_ in entries]
    asked += [("http://a.com/before", 1), ("http://z.org/after", 1), ("http://x.com/hot", 10**6), (None, None)]
    wanted = spark.createDataFrame(asked, "url string, page_id long").repartition(ranges)
    got = Counter(map(tuple, warc.find_entries(directory, wanted, folder).collect()))
    assert got == Counter(entries)
    assert warc.find_entries(directory.limit(0), wanted, folder).count() == 0


def test_lookup_finds_keys_that_start_with_other_keys(spark, tmp_path):
    rng = random.Random(5)
    paths = ["doc", "doc (2)", "doc - copy", "doc 0", "doc 9", "doc\x01", "doc\x00", "doc\x00\x01", "doc  ", "docs"]
    urls = [f"http://x.com/{p}-end" if p.endswith(" ") else f"http://x.com/{p}" for p in paths]
    pairs = [(u, p) for u in urls for p in [None, -7, -1, *rng.sample(range(2**40), 30)]]
    entries = [(warc.url_key(u), p, f"f{i % 4}", i, 1) for i, (u, p) in enumerate(pairs)]
    folder = f"file://{tmp_path}/index"
    directory = warc.write_index(spark.createDataFrame(entries, warc.ENTRY_SCHEMA), folder, 5, block_entries=7)
    wanted = spark.createDataFrame(pairs, "url string, page_id long")
    got = Counter(map(tuple, warc.find_entries(directory, wanted, folder).collect()))
    assert got == Counter(entries)


def test_pages_of_neighbouring_urls_all_come_back(spark, tmp_path):
    urls = ["http://x.com/doc", "http://x.com/doc (2)", "http://x.com/doc - copy"]
    pages = spark.createDataFrame([(3 * i + k, u, f"page {i} {k}") for i in range(40) for k, u in enumerate(urls)], PAGES)
    got = warc.archive_pages(pages, f"file://{tmp_path}/archives").select("page_id", "html").collect()
    assert sorted(map(tuple, got)) == sorted((r.page_id, r.html) for r in pages.collect())


def test_url_keys():
    assert warc.url_key("https://www.Example.org:443/A?b=1#c") == "org,example,www)/a?b=1"
    assert warc.url_key("http://example.org:8080") == "org,example:8080)/"
    assert warc.url_key(None) == "" and warc.url_key("http://[bad") == "http://[bad"
    assert warc.sort_key("k", -5) < warc.sort_key("k", 3) < warc.sort_key("k", 20)


def test_damage_is_seen():
    raw = warc.record(1, "u", b"payload", None, False)
    with pytest.raises(ValueError, match="damaged"):
        warc.read_one(raw.replace(b"payload", b"pAyload"))


ARTICLE = (
    "<p>The first paragraph of the text is long enough to be seen as an article, and it has the stop words that it needs.</p>"
    "<p>Short one.</p><p>And the second paragraph of the article is in the same place, with a <a href=x>link</a> &amp; more&nbsp; of\n the words.</p>"
)
TEXT = (
    "The first paragraph of the text is long enough to be seen as an article, and it has the stop words that it needs.\n"
    "Short one.\nAnd the second paragraph of the article is in the same place, with a link & more of the words."
)
FRAME = "I think that this is the best of all the articles that I have read, and it is as long as the text is."


@pytest.mark.parametrize(
    "page",
    [
        f"<article>{ARTICLE}</article>",
        f"<body><div id=content>{ARTICLE}</div></body>",
        f"<nav><ul><li><a href=/>Home</a></ul>{FRAME}</nav><main>{ARTICLE}</main>",
        f"<header>{FRAME}</header><article>{ARTICLE}</article><footer>{FRAME}</footer>",
        f"<nav>{FRAME}<article>{ARTICLE}",
        f"<div class='page-sidebar'><p>{FRAME}</p></div><div>{ARTICLE}</div><div id='comments'><p>{FRAME}</p></div>",
        f"<div class=cookieNotice>{FRAME}</div><article>{ARTICLE}<div class='ad'>{FRAME}</div></article>",
        f"<form><p>{FRAME}</p><input></form><section>{ARTICLE}</section><script>var a = '<p>{FRAME}</p>';</script>",
        f"<head><title>{FRAME}</title><style>p > a {{}}</style></head><!-- <p>{FRAME}</p> --><article>{ARTICLE}</article>",
        f"<article>{ARTICLE}</article><p hidden>{FRAME}</p><div style='display: none'>{FRAME}</div>",
        f"<p><a href=1>Much more that is to be read</a> | <a href=2>and of the rest of it all that is here</a></p><div>{ARTICLE}</div>",
        f"<article title=\"a > b\">{ARTICLE}</article>",
    ],
)
def test_main_text(page):
    assert main_text(page) == TEXT


@pytest.mark.parametrize(
    "page",
    [
        f"<html class='no-sidebar'><body class='right-sidebar'><article>{ARTICLE}</article></body></html>",
        f"<body class='no-sidebar'><div id=content>{ARTICLE}</div></body>",
        f"<div class='container has-sidebar'><div>{ARTICLE}</div></div>",
        f"<div class='sidebar-layout'><main><div class='social'><article>{ARTICLE}</article></div></main><p>{FRAME}</p></div>",
        f"<article class='post comments-open'>{ARTICLE}</article>",
        f"<article>{ARTICLE}<div class='comments'><article><p>{FRAME}</p></article></div></article>",
        f"<div style='display:none'><article><p>{FRAME}</p></article></div><article>{ARTICLE}</article>",
    ],
)
def test_hint_words_of_wrappers_and_states(page):
    assert main_text(page) == TEXT


def test_captions_and_formulas_are_text():
    caption = "<figure><img src=x><figcaption>A caption of the figure, with <math><mi>x</mi><mo>=</mo><mn>2</mn></math>.</figcaption></figure>"
    assert main_text(f"<article>{ARTICLE}{caption}</article>") == f"{TEXT}\nA caption of the figure, with x=2."


def test_short_blocks_follow_their_neighbours():
    bad = "".join("<p>" + "zzz qqq xxx " * 30 + "</p>" for _ in range(2))
    assert main_text(f"<div>{ARTICLE}<h2>Next</h2>{ARTICLE}{bad}<p>Tiny</p>{bad}</div>") == f"{TEXT}\nNext\n{TEXT}"
    assert main_text("<article><p>Tiny</p></article>") == "Tiny"
    assert main_text("<p>Tiny</p>") == ""


@pytest.mark.parametrize("page", ["", "<", "<p", "<<p>>", "<script>", "</div></p>", "<a " * 20_000, '<p a="' * 20_000, "<div>" * 5_000 + "x", "<" * 20_000])
def test_broken_pages_do_not_fail(page):
    assert isinstance(main_text(page), str)


def test_pages_of_the_query(spark):
    """Every article of the given pages, and nothing else."""
    pages = {r.page_id: r for r in read(spark, FOLDER, "pages").collect()}
    rows = QUERIES["op10_html_text"](spark, FOLDER).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", pages[r.page_id].html or "", re.S)
        blocks = re.split(r"</?(?:p|h1)>", article[1]) if article else []
        want = "\n".join(t for b in blocks if (t := " ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split())))
        assert (r.text, r.n_chars, r.url) == (want, len(want), pages[r.page_id].url)


def test_pages_edges(spark):
    pages = awkward_pages(spark).selectExpr("*", "url AS text", "page_id AS n_chars")
    rows = extract_pages(pages).collect()
    assert len(rows) == pages.count() and all(r.n_chars == len(r.text) for r in rows)
    assert extract_pages(pages.limit(0)).count() == 0


def test_extraction_of_random_markup():
    rng = random.Random(4)
    parts = ["<p>", "</p>", "<div class=nav>", "</div>", "<a href=x>", "</a>", "text of the page. ", "&amp;", "<br/>", "<!--", "-->", "<script>", "</script>", "<", ">", '"']
    for _ in range(300):
        main_text("".join(rng.choice(parts) for _ in range(60)))


ONE = "The first paragraph of the article is here and it is long enough to be read as text of its own by anyone."
TWO = "The second paragraph of it follows at once, and it is as long as the first one was, or longer than that."
BODY = f"<article><p>{ONE}</p><p>{TWO}</p></article>"


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>t</title><meta charset=x>{BODY}</html>",
        f"<html><head><title>t</title><body>{BODY}</html>",
        f"<body><svg width='1' />{BODY}",
        f"<body><svg><title>a</title><svg></svg><path></svg>{BODY}",
        f"<body><svg><path>{BODY}",
        f"<body><button>Menu{BODY}<button>x</button>",
        f"<body><button><div>Menu</div></button>{BODY}",
        f"<body><select><option>a<option>b{BODY}",
        f"<body><iframe src='a>b'>{BODY}",
        f"<body>{BODY}<section class='comments'><article><p>{TWO} Said a reader.</p></article></section>",
        f"<body>{BODY}<aside><article><p>{TWO} Related.</p></article></aside>",
        f"<body><div class='has-sidebar sidebar'>{BODY}</div>",
        f"<body><noscript><p>On.</p></noscript>{BODY}<template><p>{TWO}</p></template>",
    ],
)
def test_articles_are_not_lost(page):
    assert main_text(page) == f"{ONE}\n{TWO}"


def test_lists_and_links_inside_an_article():
    mixed = f"<ul><li><a href=x>linked item</a></li><li>plain item</li></ul><p><a href=y>{TWO}</a></p>"
    assert main_text(f"<article><p>{ONE}</p>{mixed}<p>{ONE}</p></article>") == f"{ONE}\nlinked item\nplain item\n{TWO}\n{ONE}"
    menu = "<ul><li><a href=x>one</a></li><li><a href=y>two</a></li></ul>"
    assert main_text(f"<article><p>{ONE}</p>{menu}<p>{TWO}</p></article>") == f"{ONE}\n{TWO}"


@pytest.mark.parametrize(
    "text",
    [
        "Это первый абзац статьи, и он достаточно длинный, чтобы его можно было прочитать как самостоятельный текст.",
        "これは記事の最初の段落であり、それ自体がひとつの文章として読めるほど十分に長いものです。次の段落もすぐに続きます。",
        ("Pierwszy akapit tego artykułu jest tutaj i wystarczająco długi, żeby czytać go jako samodzielny tekst. " * 3).strip(),
    ],
)
def test_pages_beyond_the_stop_words(text):
    menu = "<nav><a href=x>Меню メニュー</a></nav><div><a href=y>Дальше</a></div>"
    assert main_text(f"<body>{menu}<div><p>{text}</p><p>{text}</p></div></body>") == f"{text}\n{text}"
