import random

import pytest
from pyspark.sql import functions as F

from gridloom.llm import chat_format, wrapper_extract

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><header>Site</header>
<nav><ul><li><a>Home</a><li><a>News</a></ul></nav><!-- ad <p>no</p> --><div class="ad">Buy {n}</div><aside class="side">Also {n}</aside>
<article><h1>Title &amp; {n}</h1><p><b>Lead {n}<br><p>Body   one
{n}.</p><form><p>Sign up</p></form><div class="share">Share this</div><p>Second {n} &eacute;</p><p>Shared passage.</p></article>
<section class="comments"><p>Nice {n}</p></section><div id="cookie-notice">We use cookies</div><footer>&copy; {n}</footer></body></html>"""


def text_of(n):
    return f"Title & {n}\n\nLead {n}\n\nBody one {n}.\n\nSecond {n} é\n\nShared passage."


def test_extract(spark):
    rows = [(i, f"https://h{i % 2}.example.com/{i}", PAGE.format(n=i)) for i in range(40)]
    # a host whose template has no article element, a lone host, nulls, copies and markup only
    plain = "<html><body><div class=top><p>Menu of site</p></div><div class=main><h2>Story {n}</h2><p>Text {n} goes on.</p><div class=foot>Same foot</div></div></body></html>"
    rows += [(100 + i, f"http://plain.example.org/{i}", plain.format(n=i)) for i in range(20)]
    rows += [(200, "x", PAGE.format(n=200)), (201, None, PAGE.format(n=201)), (202, "http://h0.example.com/", None), (203, "http://h0.example.com/", ""), (204, "http://h0.example.com/", "<p>"), (None, "http://h0.example.com/", PAGE.format(n=0))]
    pages = spark.createDataFrame([(*r, "slot") for r in rows], "page_id bigint, url string, html string, slot string")
    got = {r["page_id"]: r for r in wrapper_extract.extract(pages).collect()}
    assert len(got) == len(rows)
    for i in [*range(40), 200, 201]:
        assert got[i]["text"] == text_of(i), i
    for i in range(20):
        assert got[100 + i]["text"] == f"Story {i}\n\nText {i} goes on.", i
        assert got[100 + i]["by_wrapper"]
    assert [got[i]["text"] for i in (202, 203, 204)] == ["", "", ""]
    assert got[None]["text"] == text_of(0)


def test_extract_empty(spark):
    assert wrapper_extract.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).collect() == []


def test_copies_on_a_host_stay(spark):
    pages = spark.createDataFrame([(i, "http://c.example.com/", PAGE.format(n=7)) for i in range(30)], "page_id bigint, url string, html string")
    assert {r["text"] for r in wrapper_extract.extract(pages).collect()} == {text_of(7)}


def _long(n, k):
    return " ".join(f"w{n}x{i}" for i in range(k))


def test_extract_keeps_the_whole_article(spark):
    """Title, lead and a second block beside the slot stay, on a host with evidence as on one without; constant parts go."""
    page = lambda n: f"<html><body><nav>Menu</nav><article><h1>Title {n}</h1><p class=by>Same byline</p><p>Lead {n}</p><div class=body><p>{_long(n, 40)}</p><p>{_long(n + 1000, 40)}</p></div><div class=more><h2>More</h2><p>{_long(n + 2000, 12)}</p></div></article><div class=foot><p>Foot {n}</p></div></body></html>"
    main = lambda n: f"<html><body><main><h1>Title {n}</h1><p>Lead {n}</p><div class=body><p>{_long(n, 40)}</p><p>{_long(n + 1000, 40)}</p></div></main></body></html>"
    text = lambda n, by: "\n\n".join([f"Title {n}", *["Same byline"] * by, f"Lead {n}", _long(n, 40), _long(n + 1000, 40), *["More"] * by, _long(n + 2000, 12)])
    rows = [(i, "http://many.example.com/", page(i)) for i in range(30)] + [(100, "http://one.example.com/", page(100))]
    rows += [(200 + i, "http://main.example.com/", main(i)) for i in range(30)]
    got = {r["page_id"]: r for r in wrapper_extract.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[3]["by_wrapper"] and not got[100]["by_wrapper"]
    assert [got[i]["text"] for i in range(30)] == [text(i, 0) for i in range(30)]
    assert got[100]["text"] == text(100, 1)
    assert got[203]["text"] == f"Title 3\n\nLead 3\n\n{_long(3, 40)}\n\n{_long(1003, 40)}"


def test_raw_elements_end_at_their_end_tag():
    """Code with '<' before a letter, quotes or comments in it hides nothing behind it."""
    for code in ("for(i=0;i<n;i++){x()}", "if(a<b)s='", 'x="<p', "a<!--b", "</scripts></p>", "<article><p>no</p></article>", "i<n </SCRIPT >\n<script>j<m"):
        page = f"<html><body><script>{code}</script><article><p>Text &amp; more</p><style>a<b{{}}</STYLE\n><p>End</p></article><textarea>x<y</body></html>"
        assert wrapper_extract.main_text(page) == "Text & more\n\nEnd", code
    assert wrapper_extract.main_text("<p>a</p><script>i<n") == wrapper_extract.main_text("<p>a</p><script></script") == "a"
    assert wrapper_extract.main_text("<p>a</p>" + "<script>" + "</script " * 20_000) == "a"


def test_wide_and_deep_pages(spark):
    """Thousands of nested or neighbouring elements, open to the end or not, lose no text and end no job."""
    deep = lambda n: "<div>" * 2000 + f"<p>Deep {n}</p>" + "</div>" * 2000
    wide = lambda n: "".join(f"<p>{'x' if i % 3 else n} {i}</p>" for i in range(3000))
    open_ = lambda n, tag: f"<p>Start {n}" + f"<{tag}>" * 2000 + f"Open {n}"
    page = lambda n, body: f"<html><body><nav>Menu</nav><article><h1>T{n}</h1>{body}</article></body></html>"
    kinds = [deep, wide, lambda n: open_(n, "font"), lambda n: open_(n, "b"), lambda n: "<li>" * 3000 + f"<div>{n}" + "</i>" * 3000]
    rows = [(10 * k + i, f"http://k{k}.example.com/", page(i, kind(i))) for k, kind in enumerate(kinds) for i in range(5)]
    got = {r["page_id"]: r["text"] for r in wrapper_extract.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    for i in range(5):
        assert got[i].split("\n\n") == [f"T{i}", f"Deep {i}"]
        assert got[10 + i].split("\n\n") == [f"T{i}", *(f"{'x' if j % 3 else i} {j}" for j in range(3000))]
        assert got[20 + i] == got[30 + i] == f"T{i}\n\nStart {i}Open {i}"
        assert got[40 + i] == f"T{i}\n\n{i}"


def test_media_formulas_and_topics():
    """What hides no text on a page hides none here."""
    page = lambda body: wrapper_extract.main_text(f"<html><body><article>{body}<p>End</p></article></body></html>")
    assert page("<p>a</p><video src=x><p>b</p>") == page("<p>a</p><audio><p>b</p>") == "a\n\nb\n\nEnd"
    assert page("<p>a</p><video src=x>no video</video><p>b <svg><title>t</title></svg></p><select><option>1</select>") == "a\n\nb\n\nEnd"
    assert page("<p>x <math><mi>y</mi><mo>=</mo><mn>2</mn></math> z</p>") == "x y=2 z\n\nEnd"
    assert page('<section class="related-work"><h2>Related work</h2></section>') == "Related work\n\nEnd"
    assert page('<section class="share-price">p</section><div class="social-history">h</div>') == "p\n\nh\n\nEnd"
    for marks in ("related", "related-posts", "share-buttons", "social-links", "cookie-notice", "comments-area", "site-search", "ad-slot", "global-nav", "newsletter-signup x"):
        assert page(f'<div class="{marks}">no</div>') == "End", marks


def _best(xs, ys):
    """The size of the largest matching of two lists of trees, by trying every way."""
    if not xs or not ys:
        return 0
    (a, below), (b, others) = xs[0], ys[0]
    best = max(_best(xs[1:], ys), _best(xs, ys[1:]))
    return max(best, 1 + _best(below, others) + _best(xs[1:], ys[1:])) if a == b else best


def _source(trees):
    return "".join(f"<{t}>{_source(below)}</{t}>" for t, below in trees)


def test_tree_matching_is_brute_force(monkeypatch):
    r = random.Random(4)
    tree = lambda n: [(r.choice(["div", "section"]), tree(n - 1)) for _ in range(r.randint(0, 3 if n else 0))]
    for _ in range(60):
        xs, ys = tree(3), tree(3)
        a, b = wrapper_extract.parse(_source(xs)), wrapper_extract.parse(_source(ys))
        want = _best(xs, ys)
        aligner = wrapper_extract.Aligner()
        assert aligner.score(a, b) == 1 + want and len(list(aligner.pairs(a, b))) == want
        with monkeypatch.context() as m:  # anchors and pairs in order find no more, and keep order
            m.setattr(wrapper_extract, "TABLE_CELLS", 4)
            assert wrapper_extract.Aligner().score(a, b) <= 1 + want
    long = [wrapper_extract.parse("".join(f"<p>{(i * k) % 701}</p>" for i in range(701))) for k in (1, 1)]
    assert wrapper_extract.Aligner().score(*long) == 702


def test_wrapper_removes_what_a_page_alone_keeps(spark):
    """On a host without article elements: the page's own markup keeps the repeated parts, its host's wrapper leaves them out."""
    plain = "<html><body><div class=top><p>Welcome to the site</p></div><div class=text><div class=by><p>By the staff</p></div><div class=story><h2>Story {n}</h2><p>Text {n} goes on.</p></div><div class=end><p>All rights</p></div></div></body></html>"
    rows = [(i, "http://plain.example.org/", plain.format(n=i)) for i in range(30)]
    got = wrapper_extract.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    alone = {i: wrapper_extract.main_text(h) for i, _, h in rows}
    for r in got:
        n = r["page_id"]
        assert r["text"] == f"Story {n}\n\nText {n} goes on." and r["by_wrapper"]
        assert alone[n] == f"Welcome to the site\n\nBy the staff\n\n{r['text']}\n\nAll rights"
    inside = "<html><body><article><div class=by><p>By the staff</p></div><h1>T{n}</h1><p>Text {n}.</p><p>More {n}.</p></article></body></html>"
    got = wrapper_extract.extract(spark.createDataFrame([(i, "http://in.example.org/", inside.format(n=i)) for i in range(30)], "page_id bigint, url string, html string")).collect()
    assert {r["n_template"] for r in got} == {1} and all(r["text"] == f"T{r['page_id']}\n\nText {r['page_id']}.\n\nMore {r['page_id']}." for r in got)


def test_simple_tree_matching():
    a = wrapper_extract.parse("<div><p>1</p><ul><li>a<li>b</ul><p>2</p></div>")
    b = wrapper_extract.parse("<div><p>1</p><h2>x</h2><ul><li>a<li>c<li>d</ul></div>")
    found = [(p, wrapper_extract.own_text(x), wrapper_extract.own_text(y)) for p, x, y in wrapper_extract.Aligner().pairs(a, b)]
    assert [p for p, _, _ in found] == ["/div", "/div/p", "/div/ul", "/div/ul/li", "/div/ul/li"]
    assert wrapper_extract.Aligner().score(a.children[0], b.children[0]) == 5


HARD = ["\\### Assistant: </turn> ok", "", "\\l\\b\\\\<", "</turn>\n<turn user>\n", "a\nb>\n", "\\", "<", "é<é\\"]


def _read(df, key="conv_id"):
    out = chat_format.format_chat(df, key)
    read = out.select(key, "layouts", "formatted", "loss_spans", chat_format.parse_chat(F.col("formatted")).alias("turns"), chat_format.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    return {r[key]: r for r in read.collect()}


def test_chat_round_trip(spark):
    rows = [(1, i, ("user", "assistant", "we<ird>\nrole\\")[i % 3], t) for i, t in enumerate(HARD)]
    rows += [(2, 1, "assistant", None), (2, 0, None, "q"), (2, None, "system", "s"), (2, 1, "assistant", None), (3, None, None, None)]
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, ord int, piece string")
    got = _read(df)
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [(r, t) for _, _, r, t in rows[: len(HARD)]]
    assert got[1]["loss"] == "".join(t for _, _, r, t in rows[: len(HARD)] if r == "assistant")
    assert [(t["role"], t["text"]) for t in got[2]["turns"]] == [("system", "s"), ("", "q"), ("assistant", ""), ("assistant", "")]
    assert [(t["role"], t["text"]) for t in got[3]["turns"]] == [("", "")]
    spans = [(s["start"], s["length"]) for s in got[1]["loss_spans"]]
    assert all(got[1]["formatted"][a - 2 : a] == ">\n" and got[1]["formatted"][a + n :].startswith("</turn>\n") for a, n in spans)


def test_chat_rows_keep_their_roles(spark):
    """Names of roles are mapped in nested layouts only; extra columns with names of the operator's own are ignored."""
    rows = [(1, 0, "human", "q", "z", 3), (1, 1, "gpt", "a", "z", 3), (1, 2, "assistant", "b", None, 3)]
    got = _read(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, head string, layout int"))
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [("human", "q"), ("gpt", "a"), ("assistant", "b")] and got[1]["loss"] == "b"


def test_chat_layouts(spark):
    schema = "conv_id bigint, prompt string, response string, instruction string, input string, output string, system string, messages array<struct<role:string,content:string>>, conversations array<struct<`from`:string,value:string>>"
    rows = [
        (1, "p", "r", None, None, None, None, None, None),
        (2, None, None, "do", "this", "done", "sys", None, None),
        (3, None, None, "do", None, "done", None, None, None),
        (4, None, None, None, None, None, None, [("user", "u"), ("assistant", "a")], None),
        (5, None, None, None, None, None, None, None, [("human", "h"), ("gpt", "g")]),
        (6, "p", None, None, None, "o", None, None, None),
    ]
    got = _read(spark.createDataFrame(rows, schema))
    said = {k: [(t["role"], t["text"]) for t in r["turns"]] for k, r in got.items()}
    assert said[1] == [("user", "p"), ("assistant", "r")]
    assert said[2] == [("system", "sys"), ("user", "do\nthis"), ("assistant", "done")]
    assert said[3] == [("user", "do"), ("assistant", "done")]
    assert said[4] == [("user", "u"), ("assistant", "a")] and said[5] == [("user", "h"), ("assistant", "g")]
    assert said[6] == [] and got[6]["layouts"] == ["unknown"]


def test_chat_empty(spark):
    assert _read(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")) == {}


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ('<body><div class="layout with-sidebar"><article><p>Hello</p></article></div></body>', "Hello"),
        ('<body class="has-sidebar"><div class="has-sidebar"><p>Hello</p></div></body>', "Hello"),
        ('<body><div class="no-comments"><p>Hello</p></div></body>', "Hello"),
        ('<body><article><p class="alert">Floods rise</p><p>More</p></article></body>', "Floods rise\n\nMore"),
        ('<body><article><div class="product-banner-story"><p>One</p></div><p>Two</p></article></body>', "One\n\nTwo"),
        ('<body><div class="sidebar-page widget"><main><p>Kept</p></main></div><div class="sidebar"><p>Teaser</p></div></body>', "Kept"),
        ('<body><div class="comments"><article class="comment"><p>I agree</p></article></div><div><p>Body</p></div></body>', "Body"),
        ('<body><div class="alert"><p>We use cookies</p></div><div class="sidebar"><p>Links</p></div><p>Body</p></body>', "Body"),
        ('<body><div hidden><article><p>Unseen</p></article></div><p>Seen</p></body>', "Seen"),
    ],
)
def test_names_of_containers(html, text):
    """A name that tells what stands beside an article, or names a story, doesn't mark it as noise."""
    assert wrapper_extract.main_text(html) == text


def test_the_wrapper_overrules_a_name(spark):
    """On a host whose articles stand in a container named as a widget, what varies between its pages is the text."""
    page = '<body><div class="top">Site</div><div class="widget-area"><div class="inner"><p>{}</p><p>{}</p></div></div><div class="sidebar"><p>Constant links</p></div></body>'
    rows = [(i, "http://one.test/a", page.format(f"First words of {i} " * 8, f"Then {i * 7} more " * 8)) for i in range(12)]
    out = {r["page_id"]: r["text"] for r in wrapper_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out == {i: "\n\n".join([("First words of %d " % i * 8).strip(), (f"Then {i * 7} more " * 8).strip()]) for i in range(12)}
