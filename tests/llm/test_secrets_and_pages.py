import random
import re
import string
import time

import pytest

from fundaflow.llm import pages, queries, secrets
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, Text string, spans int, `x.y` int"
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 32]
    return sorted(out)


def awkward(rng, n):
    parts = ["password", "Token", "API_KEY", "apikey", "secret", "=", ":", " ", '"', "'", "abcdefgh", "x.y=z", "😀", "é", "\n", "AKIA", "ABCD1234EFGH", "0123456789abcdef", "deadbeef", "short", "==", "-"]
    return "".join(rng.choice(parts) for _ in range(n))


def test_base_spans_equal_brute_force(spark):
    rng = random.Random(1)
    texts = [awkward(rng, rng.choice([0, 5, 30, 200])) for _ in range(150)] + ["token=abcdefgh " * 3000, "token=abc secret=password:abcdefgh"]
    rows = [(i, t, "c", 1, 1) for i, t in enumerate(texts)]
    got = {r.doc_id: r.spans for r in secrets.secret_spans(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, t in enumerate(texts):
        assert [tuple(s) for s in got[i] if s.kind < 3] == base(t)
        assert [tuple(s) for s in got[i]] == sorted(tuple(s) for s in got[i])


def test_battery_tells_random_strings_from_words(spark):
    rng = random.Random(2)
    draw = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    random_ones = [draw(string.ascii_letters + string.digits + "+/", 44) for _ in range(60)] + [draw("0123456789abcdef", 40) for _ in range(60)]
    syllables = ["tion", "the", "ing", "ent", "and", "heit", "schaft", "ous", "ion", "re", "con"]
    plain = ["".join(rng.choice(syllables) for _ in range(9)) for _ in range(300)] + ["1234567890" * 3, "a" * 40, "ab" * 20, string.ascii_lowercase, "0" * 30, "2024-01-01-report-final-version", "some_function_name_that_is_long", "AAAAAAAAAAAAAAAAAAAAAAAA"]
    rows = [(i, f"see {s} here", "c", 1, 1) for i, s in enumerate([*random_ones, *plain])]
    got = {r.doc_id: any(s.kind == 3 for s in r.spans) for r in secrets.secret_spans(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sum(got[i] for i in range(len(random_ones))) >= 110
    assert not any(got[i] for i in range(len(random_ones), len(rows)))


def test_thresholds_follow_the_corpus(spark):
    """A string that is a discovery on its own is none among thousands of candidates; a longer random one is in both."""
    few = spark.createDataFrame([("see abcde1fghij2klmno3pq",)], "text string")
    others = spark.range(3000).select(F.lit("thetionandingentheitre").alias("text"))
    assert secrets.discovery_bin(few) < secrets.BINS == secrets.discovery_bin(few.union(others))
    strong = spark.createDataFrame([("see qX7pL9vR2kT4mZ8wB3nYc5Hd1Js6",)], "text string")
    assert secrets.discovery_bin(strong) == secrets.discovery_bin(strong.union(others)) < secrets.BINS
    assert secrets.discovery_bin(few.limit(0)) == secrets.BINS


def test_masking_and_cases(spark):
    key = "AKIA" + "ABCD1234EFGH5678"
    rows = [(1, None, "c", 1, 1), (2, "", "c", 1, 1), (3, f"a {key} b", "c", 1, 1), (3, f"a {key} b", "c", 1, 1), (None, "password=abcdefgh9 x", "c", 1, 1), (5, "clean text", "c", 1, 1)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = sorted((str(r[0]), r[1], r[2]) for r in secrets.masked(frame).collect())
    assert got == sorted([("1", None, "c"), ("2", "", "c"), ("3", "a [SECRET] b", "c"), ("3", "a [SECRET] b", "c"), ("None", "[SECRET] x", "c"), ("5", "clean text", "c")], key=lambda x: (x[0], str(x[1])))
    assert secrets.masked(frame).columns == frame.columns
    spans = {str(r.doc_id): r.spans for r in secrets.digests(secrets.secret_spans(frame)).collect()}
    assert spans["1"] == spans["2"] == spans["5"] == "" and spans["3"].startswith("access:2:22")
    assert secrets.secret_spans(frame.limit(0)).count() == 0


def test_secret_query_is_native(spark):
    plan = queries.QUERIES["op10_secret_scans"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


PAGES = "page_id long, url string, html string, Html string, text int"
SHELL = (
    '<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{{}}</style><script>var a="</p><p>x";</script></head><body><header class="top">Site</header>'
    '<nav><ul><li><a href="/a">Home</a><li>Two</ul></nav><div id="cookie-notice">We use cookies</div><div class="ad">Buy {n}</div>{main}'
    '<aside>Side {n}</aside><form>Name <input></form><footer>&copy; {n}</footer>'
)


def frame_of(spark, rows):
    return spark.createDataFrame([(*r, "c", 1) for r in rows], PAGES)


def test_articles(spark):
    main = '<article><h1>Head &amp; tail</h1><p><b>One\n two<br>three<br><p>Caf&eacute; &#x41;&lt;b&gt; &am<ul><li>x<li>y <i>z</i></ul><!-- no --><table><tr><td>a<td>b</table><div class="comments"><p>bad</p></div><p>a < b</article>'
    rows = [(1, "http://h.x/1", SHELL.format(n=1, main=main)), (2, None, None), (3, "no url", ""), (4, "http://h.x/4", "<article>only text"), (None, "http://h.x/5", "<p>no article &amp; <script>x</script>end")]
    got = {r.page_id: r for r in pages.main_text(frame_of(spark, rows)).collect()}
    assert got[1].text == "Head & tail\nOne two three\nCafé A<b> &am\nx\ny z\na b\na < b"
    assert (got[2].text, got[2].n_chars, got[3].text) == ("", 0, "")
    assert got[4].text == "only text" and got[None].text == "no article & end"
    assert got[1].n_chars == len(got[1].text)
    assert pages.main_text(frame_of(spark, rows).limit(0)).count() == 0


def test_style_tree_finds_what_names_do_not_tell(spark):
    """An unnamed box with the same content on all pages of a host goes; the same box on a host of its own kind stays."""
    box = '<div class="box x{n}"><span>Follow us everywhere</span></div>'
    rows = [(i, f"http://one.x/{i}", f"<body><div class='body'><p>text {i} of page</p><p>again {i * 7}</p></div>{box.format(n=i)}") for i in range(40)]
    rows += [(100 + i, f"http://two{i}.x/", f"<body><div class='body'><p>text {i}</p></div>{box.format(n=i)}") for i in range(3)]
    got = {r.page_id: r.text for r in pages.main_text(frame_of(spark, rows)).collect()}
    assert all(got[i] == f"text {i} of page\nagain {i * 7}" for i in range(40))
    assert all("Follow us" in got[100 + i] for i in range(3))


def test_copies_of_articles_keep_their_text(spark, monkeypatch):
    rows = [(i, "http://same.x/a", SHELL.format(n=0, main="<article><p>The same article</p><div class='share-x9'>Pass it on</div><section><p>end</section></article>")) for i in range(60)]
    for sent in (pages.MOST_SENT, -1):  # low nodes in the closure, or joined by host
        monkeypatch.setattr(pages, "MOST_SENT", sent)
        assert {r.text for r in pages.main_text(frame_of(spark, rows)).collect()} == {"The same article\nend"}


def test_a_host_of_mostly_copies_keeps_the_text(spark):
    """40 pages, 36 of them copies or copies but for a line; 4 of their own."""
    for wrap in ('<article><div class="entry-content">{}</div></article>', '<div class="body">{}</div>'):
        for line in ("", "<i>read {} times</i>"):
            rows = [(i, f"http://copies.x/{i}", "<body>" + wrap.format(f"<p>{'The same story. ' * 9 if i < 36 else f'Story of page {i}. ' * 9}</p>") + line.format(i)) for i in range(40)]
            got = {r.page_id: r.text for r in pages.main_text(frame_of(spark, rows)).collect()}
            for i in range(40):
                assert ("The same story. " * 9 if i < 36 else f"Story of page {i}. " * 9).strip() in got[i]


def test_plain_nodes_of_an_article_are_judged(spark):
    """A sentence that the host's articles share goes from a bare paragraph; so does a promotion that is an article of its own."""
    rows = [(i, f"http://n.x/{i}", f"<body><article><h1>Head {i}</h1><p>{f'Text {i}. ' * 9}</p><p>Follow us everywhere</p></article><div><article><p>Buy our book</p></article></div>") for i in range(30)]
    got = {r.page_id: r.text for r in pages.main_text(frame_of(spark, rows)).collect()}
    assert all(got[i] == f"Head {i}\n{(f'Text {i}. ' * 9).strip()}" for i in range(30))
    page = pages.Page(SHELL.format(n=1, main="<article><p>One</p><p>Two</p></article>"))
    judged = {b[0] for b in page.branches()}
    assert all(p in judged for p, tag in zip(page.path, page.tag, strict=True) if tag in ("nav", "footer", "aside", "article", "p"))


def test_rare_boxes_and_small_hosts_are_judged(spark, monkeypatch):
    """A box of one section of a large host goes, and a box that many hosts of few pages share; a large host's own text that those share stays."""
    box, body = "<div class='box'><span>Follow us</span></div>", "<body><div class='body'><p>text {} of page, {}</p></div>"
    rows = [(i, f"http://large.x/{i}", body.format(i, "long " * 9) + (box if i < 12 else "")) for i in range(400)]
    rows += [(1000 + i, f"http://few{i // 2}.x/{i}", body.format(i, "long " * 9) + "<i class='by'>Powered by x</i>") for i in range(20)]
    rows += [(2000 + i, f"http://other.x/{i}", body.format(i, "long " * 9) + ("<i class='by'>Powered by x</i>" if i == 0 else "")) for i in range(20)]
    for sent in (pages.MOST_SENT, -1):
        monkeypatch.setattr(pages, "MOST_SENT", sent)
        got = {r.page_id: r.text for r in pages.main_text(frame_of(spark, rows)).collect()}
        assert not any("Follow us" in got[i] for i in range(400)) and not any("Powered" in got[1000 + i] for i in range(20))
        assert "Powered" in got[2000] and all(t.startswith("text ") for t in got.values()) and len(got) == len(rows)


def test_names_of_wrappers_never_drop_the_page():
    text = "<p>The whole text of the page, long enough.</p>"
    inner = f"<article>{text}</article>"
    for page in (
        f'<body class="has-sidebar">{inner}', f'<body class="single comments-open">{inner}', f'<html class="nav-open"><body>{inner}', f'<body><main class="with-sidebar">{inner}</main>',
        f'<body><div class="content with-sidebar">{inner}</div>', f'<body><article class="post related">{text}</article>', f"<body><form>{inner}</form>", f"<form><body>{inner}</form>",
        f'<body><article class="related">{text}</article>', f'<body><article><div class="content with-sidebar">{text}</div></article>', f'<body class="comments-open"><div>{text}</div>',
        f'<body><div class="content with-sidebar">{text}</div>', f"<body><form>{text}</form>", f'<body style="display:none"><div id="page-with-nav">{text}</div>', f"<html><head><body>{inner}",
    ):
        for more in ("", '<div class="sidebar">Side</div><aside><article>Other</article></aside><div class="comments"><article>Me too</article></div><footer>F</footer>'):
            assert pages.Page(page + more).text() == "The whole text of the page, long enough.", page + more
    several = "".join(f'<article class="post tag-social"><p>post {i}</p></article>' for i in range(3))
    assert pages.Page(f'<body class="nav-open"><div class="list">{several}</div>').text() == "post 0\npost 1\npost 2"
    assert pages.Page(f'<body><div id="post">Short.</div><div id="comments"><p>{"Long comment. " * 9}</p></div>').text() == "Short."


def test_broken_markup_never_fails():
    rng = random.Random(7)
    parts = ["<", ">", "</", "<p", "<p>", "</p>", "<article>", "</article>", "<a href='", '"', "'", "<!--", "-->", "<script>", "</script>", "x", " ", "&", "&amp;", "<td>", "</table>", "<br/>", "<li>", "=", "<div class=\"ad"]
    for _ in range(300):
        page = pages.Page("".join(rng.choice(parts) for _ in range(rng.randint(0, 120))))
        page.text()
        page.branches()
    assert pages.Page("<div>" * 3000 + "deep").text() == "deep"


def test_names_that_tell_of_something_else_drop_no_text_of_an_article():
    names = ["related-work", "alert-levels", "search-results", "share-prices", "notice-period", "menu-of-the-day", "nav-theory"]
    for name in names:
        page = pages.Page(f'<body><article><h1>T</h1><p>First part.</p><section class="{name}"><p>Genuine prose.</p></section></article></body>')
        assert page.text() == "T\nFirst part.\nGenuine prose.", name
    for name in ("related", "share-buttons", "ad-slot", "comment-list", "newsletter_box", "cookieNotice", "related-posts"):
        page = pages.Page(f'<body><article><h1>T</h1><p>First part.</p><div class="{name}"><p>Not the text.</p></div></article></body>')
        assert page.text() == "T\nFirst part.", name


@pytest.mark.parametrize("piece", ["<div>", "<b>", "<div><p>x", "<b>x</i>", "<section class='a b'>"])
def test_deep_pages_take_time_in_proportion(piece):
    page = "<body>" + piece * 20_000 + "end"
    began = time.process_time()
    p = pages.Page(page)
    assert p.text().endswith("end")
    assert len(p.branches()) > 0
    assert time.process_time() - began < 4


def test_rolling_hashes_tell_spans_apart():
    rng = random.Random(3)
    values = [rng.randrange(4) for _ in range(60)]
    rolling = pages._Rolling(values)
    spans = [(lo, hi) for lo in range(60) for hi in range(lo, 61)]
    assert len({rolling.span(*s) for s in spans}) == len({tuple(values[lo:hi]) for lo, hi in spans})
