import html
import re

from tessera.llm import html_extract as h

from .helpers import rows


def _plain(page):
    """The article of the generated pages, read with patterns."""
    article = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)[1]
    blocks = [re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", " ", b))).strip() for b in re.split(r"</?(?:p|h1)>", article)]
    return "\n\n".join(b for b in blocks if b)


def test_query_rows(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    want = {r.page_id: _plain(r.html) for r in pages.collect()}
    for r in h.extract(pages).collect():
        assert r.text == want[r.page_id]
        assert r.n_chars == len(r.text)


def test_boilerplate_goes():
    page = """<html><head><title>T</title><script>if (a<b) "<p>no</p>"</script></head><body><header>Top</header><nav><ul><li>x</li></ul></nav>
    <div class="cookie-notice">We use cookies</div><main><h1>Title &amp; more</h1><p>First   line<br>second<p>Next <b>bold</b> &eacute;&#33;
    <aside>aside</aside><form><input>send</form><ul><li>one<li>two</ul><div id="comments"><p>I disagree</p></div><!-- no --></main><footer>end</footer></body></html>"""
    assert h.main_text(page) == "Title & more\n\nFirst line second\n\nNext bold é!\n\none\n\ntwo"


def test_page_without_article_drops_template_text(spark):
    rows_ = [(i, "http://h.example/x", f"<body><div><p>Same on all</p></div><section><p>Story number {i}</p></section></body>") for i in range(4)]
    rows_ += [(9, None, None), (10, "http://h2.example/", ""), (11, "http://h2.example/", "plain text < 5 & more"), (11, "http://h2.example/", "plain text < 5 & more")]
    pages = spark.createDataFrame(rows_, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in rows(h.extract(pages))}
    assert got == {**{i: f"Story number {i}" for i in range(4)}, 9: "", 10: "", 11: "plain text < 5 & more"}
    assert h.extract(pages.limit(0)).count() == 0
    assert h.extract(pages).count() == 8


def test_role_words_count_among_many_words():
    many = "box bg col flex grid item"
    page = f"<body><article><p>Story</p><div class='{many} sidebar'>Links</div><p class='{many} text share'>Tell a friend</p><p class='{many} text'>End</p></article></body>"
    assert h.main_text(page) == "Story\n\nEnd"


def test_copies_of_a_page_keep_their_text(spark):
    copy = "<body><div class='post'><p>One story</p><p>in two parts</p></div></body>"
    rows_ = [(i, f"http://h.example/x?{i}", copy) for i in range(4)]
    rows_ += [(10 + i, "http://h.example/y", f"<body><div><p>Same on all</p></div><section><p>Story number {i}</p></section></body>") for i in range(3)]
    pages = spark.createDataFrame(rows_, "page_id long, url string, html string").repartition(3)
    got = {r["page_id"]: r["text"] for r in rows(h.extract(pages))}
    assert got == {**{i: "One story\n\nin two parts" for i in range(4)}, **{10 + i: f"Story number {i}" for i in range(3)}}


def test_wrappers_fold_and_align():
    def stream(n, note):
        return ["body", "h1", "#", "/h1", *(["div.note", "#", "/div"] if note else []), *["p", "#", "/p"] * n, "/body"]

    w = h.folded(stream(3, False))
    assert h.written(w) == "<body><h1>#</h1>(<p>#</p>)+</body>"
    w = h.aligned(w, h.folded(stream(1, True)))
    assert h.written(w) == "<body><h1>#</h1>(<div.note>#</div>)?(<p>#</p>)+</body>"
    assert h.aligned(w, h.folded(stream(5, True))) == w


def test_wrappers_per_host(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = rows(h.infer(pages))
    hosts = {re.match(r"https?://([^/?#]*)", r.url)[1].lower() for r in pages.collect()}
    assert {r["host"] for r in got} == hosts
    assert sum(r["n_pages"] for r in got) == pages.count()


def test_long_and_broken_pages():
    assert h.main_text("<p>" * 3000 + "x") == "x"
    assert h.main_text("<article><p>a" + " b" * 100_000).startswith("a b")
    assert h.main_text("<div title='a>b'>in</div><p>cut <b") == "in\n\ncut"
    assert h.main_text("<" * 200_000 + "<a x='" * 100_000 + "<!--") == "<" * 200_000


def test_no_markup_leaks_and_names_are_a_prior():
    assert h.main_text('<article><p>Hello</p><div class="a') == "Hello"
    assert h.main_text('<article><a href="x>link</a></article>') == "link"
    assert h.main_text('<div class="article-alert"><p>main text</p></div>') == "main text"
    assert h.main_text('<div class="related-work"><p>older results</p></div>') == "older results"
    assert h.main_text('<article><section class="share price"><p>rose</p></section></article>') == "rose"
    assert h.main_text('<body><p>x</p><img alt="a < b">y<div class="related-posts">more</div><div class="cookie-notice">c</div></body>') == "x\n\ny"
    assert h.main_text('<div data-x="<p>hidden</p>">seen</div> 1 < 2 <3') == "seen\n\n1 < 2 <3"
    assert h.main_text("<p>a</p ><script>if (a</b) x</script ><p>b") == "a\n\nb"


def _by_hand(pages):
    """Texts of pages without an article: paragraphs less those that all different pages of a host share (every paragraph has one path here)."""
    hosts = {}
    for i, url, page in pages:
        hosts.setdefault(url.split("/")[2], {})[i] = re.findall(r"<p>(.*?)</p>", page)
    out = {}
    for held in hosts.values():
        different = {tuple(v) for v in held.values()}
        shared = set.intersection(*map(set, different)) if len(different) >= 3 else set()
        out.update({i: "\n\n".join(p for p in v if p not in shared) for i, v in held.items()})
    return out


def test_slots_that_vary_are_text(spark):
    import random

    draw = random.Random(4)
    pages = []
    for k in range(60):
        host = draw.choice(("a.example", "b.example", "c.example"))
        own = [f"story {k} part {n}" for n in range(draw.randint(1, 5))]
        body = ["Welcome to the site", *own, "All rights reserved"] if host != "c.example" else own
        pages.append((k, f"http://{host}/{k}", "<html><body><div class='page'>" + "".join(f"<p>{p}</p>" for p in body) + "</div></body></html>"))
    pages += [(100 + k, f"http://d.example/{k}", "<div><p>only two</p><p>pages here</p></div>") for k in range(2)]
    docs = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)
    assert {r.page_id: r.text for r in h.extract(docs).collect()} == _by_hand(pages)


def test_the_wrapper_tells_slots_apart(spark):
    pages = [(k, f"http://h.example/{k}", f"<body><div><p>Fixed line</p></div><h1>T {k}</h1><div><p>{'Fixed line' if k == 1 else f'story {k}'}</p></div></body>") for k in range(5)]
    docs = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in h.extract(docs).collect()}
    assert got == {k: f"T {k}\n\n" + ("Fixed line" if k == 1 else f"story {k}") for k in range(5)}


def test_readers_fill_the_slots_of_their_wrapper():
    items = ("body", ("?", ("h1", "#", "/h1")), ("+", ("p", "#", "/p")), "#", "/body")
    by = h.Reader(items)
    state, filled = -1, []
    for symbol in ["body", "p", "#", "/p", "hr", "p", "#", "/p", "#", "/body"]:
        state, at = by.read(state, symbol)
        filled.append(at)
    assert filled == [0, 4, 5, 6, -1, 4, 5, 6, 7, 8]
    assert h.reader(None).read(-1, "p") == (-1, -1)


def test_clashing_columns_and_nulls(spark):
    from pyspark.sql import functions as F

    pages = spark.createDataFrame([(1, "http://h.example/1", "<article>A</article>"), (None, None, None), (2, "no address", "<p>B")], "page_id long, url string, html string")
    more = pages.withColumns({c: F.lit("x") for c in ("host", "items", "template", "text", "n_chars", "wrapper", "slots")})
    got = {(r.page_id, r.url, r.text, r.n_chars) for r in h.extract(more).collect()}
    assert got == {(1, "http://h.example/1", "A", 1), (None, None, "", 0), (2, "no address", "B", 1)}
