import pytest

from rillworks.llm import pages

LONG = "This is a sentence of the article, with commas, stops and more. It goes on for a while; then it ends."
NAV = "".join(f'<li><a href="/{i}">Section {i}</a></li>' for i in range(9))


def page(body, head="<title>T</title><style>p{}</style><script>var a='</p><p>no';</script>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


CASES = {
    "semantic": (page(f"<nav><ul>{NAV}</ul></nav><div class='ad'>Buy this now, it is good. Really.</div><article><h1>A title</h1><p>{LONG}</p><p>Short.</p></article><footer>&copy; x, y.</footer>"), ["A title", LONG, "Short."]),
    "unclosed": (page(f"<article><h1>T</h1><p><b>{LONG}<br><p>{LONG}</article><footer>end, of. page</footer>"), ["T", LONG, LONG]),
    "divs only": (page(f"<div id='top-menu'><ul>{NAV}</ul></div><div class='wrap'><div class='post'><p>{LONG}</p><p>{LONG}</p><ul><li>One item.</li></ul></div><div class='sidebar'><p>{LONG}</p></div></div><div id=footer>Foot, er.</div>"), [LONG, LONG, "One item."]),
    "comments and forms": (page(f"<main><p>{LONG}</p><form><p>Mail, please.</p><input></form><section class='comments'><p>{LONG} said a reader</p></section></main>"), [LONG]),
    "entities and space": (page(f"<article><p>a &amp;amp; b&nbsp;&lt;c&gt; \n\t d &#233; {LONG}</p></article>"), ["a &amp; b <c> d é " + LONG]),
    "cut off": (f"<html><body><article><p>{LONG}</p><p>{LONG} and th<b cla", [LONG, LONG + " and th"]),
    "inline tags don't break": (page(f"<article><p>one <b>two</b><i>three</i> <a href='x'>four</a> {LONG}</p></article>"), ["one twothree four " + LONG]),
    "comment with tags": (page(f"<!-- <p>no, not this.</p> --><article><p>{LONG}</p></article>"), [LONG]),
    "script with a less-than": (page(f"<script>for(var i=0;i<n;i++)f(i)</script><article><p>{LONG}</p><script>if(a<b){{x='</scripty>'}}</SCRIPT ><p>{LONG}</p></article>"), [LONG, LONG]),
    "names on a wrapper": (page(f"<div class='container has-sidebar'><div class='content share-enabled'><p>{LONG}</p><p>{LONG}</p></div><div class='sidebar'><p>Side, text.</p></div></div>"), [LONG, LONG]),
    "names around an article": (page(f"<div class='col-side-8 share'><article><p>{LONG}</p><div class='share'>Tell a friend, now.</div></article></div>"), [LONG]),
    "hidden is a property": (page(f"<div style='overflow:hidden' data-x='hidden'><p>{LONG}</p><p hidden>no, no.</p><p style='color:red; display: none'>no, no.</p><p aria-hidden='true'>no, no.</p></div>"), [LONG]),
    "unclosed controls": (page(f"<article><div><p>{LONG}</p><button>Go<svg><p>x</div><p>{LONG}</p><p>a <svg><path d='M0'/></svg>b <select><option>one<option>two</select>c, {LONG}</p></article>"), [LONG, LONG, "a b c, " + LONG]),
    "form around the page": (page(f"<form action='x'><div><p>{LONG}</p><p>{LONG}</p></div></form>"), [LONG, LONG]),
    "many comments": (page(f"<div class='post'><p>{LONG}</p><p>{LONG}</p></div><div class='comments'>" + f"<p>{LONG} said one.</p>" * 9 + "</div>"), [LONG, LONG]),
    "stray tags": (page(f"</div></p></button></article><article></section><p>{LONG}</span></p></b></article></div><footer>f, g.</footer>"), [LONG]),
    "cookie notice": (page(f"<div class='cookie-notice'><p>{LONG}</p></div><article><p>{LONG}</p><aside><p>{LONG}</p></aside></article>"), [LONG]),
}


@pytest.mark.parametrize("name", CASES)
def test_main_text(name):
    html, want = CASES[name]
    assert pages.main_text(html) == "\n\n".join(want)


def test_ratios_prefer_long_punctuated_paths():
    found = pages.blocks(page(f"<div><span>x</span></div><div>y</div><section><p>{LONG}</p><p>{LONG}</p></section>"))
    fused = pages.ratios(found)
    assert min(fused[i] for i, b in enumerate(found) if b.path.endswith("/p")) > max(fused[i] for i, b in enumerate(found) if b.path.endswith("/div"))


def test_nulls_empty_pages_clashing_columns_and_long_pages(spark):
    long = page("<article>" + f"<p>{LONG}</p>" * 5000 + "</article>")
    rows = [(1, "u", None, 5), (2, None, "", 6), (3, "u", "<html><body><nav>x</nav></body></html>", 7), (None, "u", long, 8), (4, "u", "plain words only", 9), (4, "u", "plain words only", 9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = pages.extract(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = sorted(((r["page_id"] or 0, r["n_chars"], len(r["text"])) for r in got.collect()))
    assert found == sorted([(1, 0, 0), (2, 0, 0), (3, 0, 0), (0, n := 5000 * len(LONG) + 4999 * 2, n), (4, 16, 16), (4, 16, 16)])
    assert pages.extract(df.limit(0)).count() == 0
    clash = pages.extract(df.withColumnRenamed("url", "_html"))
    assert clash.columns == ["page_id", "_html", "text", "n_chars"] and {r["_html"] for r in clash.collect()} == {"u", None}


def test_given_pages_keep_every_paragraph(spark):
    """The given pages hold their article in one element; all its paragraphs and nothing else must come out."""
    import html as h
    import re

    for r in pages.extract(spark.read.parquet("/root/testdata/sf0.001/pages.parquet").selectExpr("page_id", "html", "html AS raw")).collect():
        inner = re.search(r"<article>(.*?)(?:</article>|<footer|\Z)", r["raw"], re.S)[1]
        parts = [" ".join(h.unescape(re.sub(r"<[^>]*>?", " ", p)).split()) for p in re.split(r"</?p>|</?h1>", inner)]
        assert r["text"] == "\n\n".join(p for p in parts if p)
