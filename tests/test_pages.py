import html as stdlib
import random
from html.parser import HTMLParser

import pytest

import __spark_entry__ as entry
from lakeloom.operators import pages


def kinds(page):
    return [(t.kind, t.value) for t in pages.tokens_of(page)]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("a<b title='x > y' c=\"</b>\">d</b>", [("text", "a"), ("start", "b"), ("text", "d"), ("end", "b")]),
        ("<p>1 < 2 &lt; 3 &amp;&copy &#65;&#x42;</p>", [("start", "p"), ("text", "1 "), ("text", "<"), ("text", " 2 < 3 &© AB"), ("end", "p")]),
        ("x<!-- <p>no</p> -- > -->y<!-->z<!--->w<!-- open", [("text", "x"), ("text", "y"), ("text", "z"), ("text", "w")]),
        ("<script>if (a</b) '</p>' &amp; </SCRIPT >t", [("start", "script"), ("text", "if (a</b) '</p>' &amp; "), ("end", "script"), ("text", "t")]),
        ("a<script>never closed <p>x", [("text", "a"), ("start", "script"), ("text", "never closed <p>x")]),
        ("<title>a <b> &amp; c</title><br/>", [("start", "title"), ("text", "a <b> & c"), ("end", "title"), ("start", "br")]),
        ("<!DOCTYPE html><?php x ?></ >a</>b<p", [("text", "a"), ("text", "b")]),
        ("a <", [("text", "a "), ("text", "<")]),
        ("", []),
    ],
)
def test_tokens(page, want):
    assert kinds(page) == want


def test_attributes_are_read_in_their_states():
    (token,) = pages.tokens_of("<A HREF='a>b' x = 1/2 checked data-y=\"&quot;q&quot;\" href=later / z>")
    assert token.attributes == {"href": "a>b", "x": "1/2", "checked": "", "data-y": '"q"', "z": ""}


class Plain(HTMLParser):
    """The library's parser, text and tags alone."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out = []

    def handle_starttag(self, tag, attrs):
        self.out.append(("start", tag))

    handle_startendtag = handle_starttag

    def handle_endtag(self, tag):
        self.out.append(("end", tag))

    def handle_data(self, data):
        self.out.append(("text", data))


def joined(tokens):
    out = []
    for kind, value in tokens:
        if kind == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + value)
        else:
            out.append((kind, value))
    return out


def test_well_formed_pages_have_the_tokens_of_the_librarys_parser(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()
    rng = random.Random(1)
    made = []
    for _ in range(300):
        parts = []
        for _ in range(rng.randint(1, 12)):
            tag = rng.choice(["p", "b", "div", "a", "li"])
            parts.append(rng.choice([f"<{tag} class='a>b' id=\"x'y\">t &lt;x&gt; é</{tag}>", "<!-- c > d -->", "&amp;", f"<{tag}>", "plain text\n", "<script>var a='<p>';</script>", "<br/>"]))
        made.append("".join(parts))
    for page in [r.html for r in rows] + made:
        plain = Plain()
        plain.feed(page)
        plain.close()
        assert joined(kinds(page)) == joined(plain.out)


def test_blocks_and_the_main_one():
    page = """<head><title> The  title </title><style>p{}</style><body><nav><ul><li><a href=1>one</a></li><li><a href=2>two words</a></li></ul></nav>
    <div>short ad</div><article><h1>Head &amp; line</h1><p>First <b>bold</b><i>italic</i> words that are long enough to be counted as text.
    <p>A second paragraph, with a <a href=x>link in it</a>, goes on for a while as well, so that it counts.<br>A third line of text after a break, which is long too.</article>
    <template><p>not shown at all</template><footer>&copy; 2024 us</footer>"""
    title, blocks = pages.blocks_of(page)
    assert title == "The title"
    assert [b.text for b in blocks][:4] == ["one", "two words", "short ad", "Head & line"] and blocks[-1].text == "© 2024 us"
    assert [b.linked for b in blocks][:3] == ["one", "two words", ""]
    main = [b.text for b in pages.main_of(blocks)]
    assert main[0].startswith("First bolditalic words") and main[-1].startswith("A third line") and len(main) == 3
    assert pages.main_of(blocks[:3]) == [] and pages.main_of([]) == []


def test_the_main_block_has_the_greatest_sum():
    rng = random.Random(2)
    for _ in range(200):
        blocks = [pages.Block(" ".join(["w"] * rng.randint(1, 30)), " ".join(["w"] * rng.randint(0, 8))) for _ in range(rng.randint(0, 12))]
        gains = [b.gain for b in blocks]
        spans = [(sum(gains[a:b]), -a, -b) for a in range(len(blocks)) for b in range(a + 1, len(blocks) + 1)]
        best = max(spans, default=(0, 0, 0))
        assert sum(b.gain for b in pages.main_of(blocks)) == max(0, best[0])


def test_texts_of_a_table(spark, monkeypatch):
    monkeypatch.setattr(pages, "HELD", 10)
    rows = [(1, "<p>a<p>b", "old"), (2, None, "x"), (3, "", "y"), (4, "<p>" + "word " * 50_000, "z"), (5, "a &lt; b", None)]
    out = pages.page_texts(spark.createDataFrame(rows, "k long, h string, text string"), html_col="h")
    assert out.columns == ["k", "title", "text", "main_text"]
    got = {r.k: (r.title, r.text, r.main_text) for r in out.collect()}
    assert got[1] == ("", "a\nb", "") and got[2] == (None, None, None) and got[3] == ("", "", "") and got[5] == ("", "a < b", "")
    assert got[4][1] == got[4][2] == ("word " * 50_000).strip()
    assert pages.page_texts(spark.createDataFrame([], "k long, html string")).count() == 0


def test_every_page_gives_its_article(spark):
    """The made pages have their article between navigation and footer."""
    sf = "/root/testdata/sf0.01"
    raw = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    found = entry.queries()["page_main_text"](spark, sf).collect()
    assert len(found) == len(raw)
    long = kept = 0
    for r in found:
        article = raw[r.page_id].partition("<article>")[2].partition("</article>")[0]
        words = len(article.split())
        nav = raw[r.page_id].partition("<footer>")[2].partition("</footer>")[0]
        assert stdlib.unescape(nav).strip() not in r.main_text.split("\n")
        if words > 200:
            long += 1
            kept += len(r.main_text.split()) > 0.8 * words
        assert "<" not in r.text or "&lt;" in raw[r.page_id]
    print(f"articles kept {kept} of {long}")
    assert long > 50 and kept >= 0.95 * long
