import re
from html import unescape

from sitemetry.llm import html_text

SCHEMA = "page_id long, url string, html string, text string, n_chars long"

PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style><script>var a="</p>";</script></head><body class="has-sidebar">
<header><h2>Site name</h2><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">All the topics</a></li></ul></nav></header>
<div class="cookie-notice"><p>We use cookies on this site for many purposes of our own.</p></div><div class="ad">Buy two of these things now.</div>
<article><h1>The  title</h1><p>First <b>bold</b>
line&nbsp;with &eacute;t&#233; &lt;tag&gt;.<br>Next<p>Second <a href="x">with a link</a> inside.<aside>Related things</aside><form><input>Your name</form><p>{}</p></article>
<section id="comments"><p>I liked this article a lot and more so than others here.</p></section><div class="sidebar"><p>Most read posts of this very week are here</p></div><footer>&copy; us and others</footer></body></html>"""
WANT = "The title\nFirst bold line with été <tag>. Next\nSecond with a link inside.\n{}"


def table(spark, pages):
    return spark.createDataFrame([(i, f"u{i}", p, "old", -1) for i, p in enumerate(pages)], SCHEMA)


def test_article_without_the_rest(spark):
    pages = [PAGE.replace("{}", f"Paragraph {i} has words of its own.") for i in range(40)]
    pages += [None, "", "   ", "only plain words", "<p>", "<a href='x", PAGE[: PAGE.index("Second")], "<p>" + "long word " * 50_000, pages[0], "<!-- never closed " + PAGE]
    got = {r["page_id"]: r for r in html_text.extract(table(spark, pages)).collect()}
    for i in range(40):
        assert got[i]["text"] == WANT.replace("{}", f"Paragraph {i} has words of its own.")
    assert [got[i]["text"] for i in (40, 41, 42, 43, 44, 45)] == ["", "", "", "only plain words", "", ""]
    assert got[46]["text"] == "The title\nFirst bold line with été <tag>. Next"
    assert got[47]["n_chars"] == len("long word " * 50_000) - 1
    assert got[48]["text"] == got[0]["text"] and got[49]["text"] == ""
    assert all(r["n_chars"] == len(r["text"]) and r["url"] == f"u{i}" for i, r in got.items())


def test_page_without_article_element(spark):
    pages = [PAGE.replace("{}", f"Paragraph {i} has words of its own.") for i in range(40)]
    other = '<body><ul class="menu"><li><a href=1>One</a></li></ul><div id="main"><div class="post"><h1>Real title</h1><p>Words of the post.</p><ul><li>one item</li><li>two</li></ul></div></div><div class="footer"><p>About us</p></div>'
    got = {r["page_id"]: r["text"] for r in html_text.extract(table(spark, [*pages, other])).collect()}
    assert got[40] == "Real title\nWords of the post.\none item\ntwo"


def test_empty_table(spark):
    assert html_text.extract(table(spark, ["x"]).limit(0)).count() == 0


def test_given_pages_against_a_plain_cut(spark):
    """The table's pages mark their article, so a plain cut at the mark gives the right text."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()}
    for row in pages.collect():
        _, _, rest = row["html"].partition("<article>")
        inner = re.sub(r"</?b>", "", rest.partition("</article>")[0]).replace("<br>", " ")
        blocks = (re.sub(r"\s+", " ", unescape(b)).strip() for b in re.split(r"<[^>]*>", inner))
        assert got[row["page_id"]] == "\n".join(b for b in blocks if b)


def test_left_out_words_never_draw_the_stretch(spark):
    banner = "<div class='banner'>" + "many words of a banner here " * 5 + "</div>"
    pages = [f"<article>{banner}<p>Kept {i} text.</p></article>" for i in range(40)] + [f"<html><body>{banner}</body></html>"]
    got = {r["page_id"]: r["text"] for r in html_text.extract(table(spark, pages)).collect()}
    assert got == {**{i: f"Kept {i} text." for i in range(40)}, 40: ""}


def test_weights_come_from_rare_labelled_pages(spark, monkeypatch):
    monkeypatch.setattr(html_text, "SAMPLE_PAGES", 30)
    labelled = [PAGE.replace("{}", f"Paragraph {i} has words of its own.") for i in range(20)]
    alone = html_text.learn_weights(table(spark, labelled))
    assert alone and html_text.learn_weights(table(spark, [*labelled, *(f"<p>plain page {i}</p>" for i in range(2000))])) == alone


def test_references_end_at_tags_and_class_names_mark_as_a_whole(spark):
    page = "<article><p>AT&<b>amp;</b> T</p><div class='social-science'>Kept words here.</div><div class='cookieNotice-wrapper'>Gone</div><div class='post share-links'>Gone too</div><p class='ad-hoc study'>Kept too.</p></article>"
    got = html_text.extract(table(spark, [page])).first()["text"]
    assert got == "AT&amp; T\nKept words here.\nKept too."


def whole(page, mark="article"):
    """The text of a page by weights learned from pages of another kind."""
    weights = {"word content p False": 4.0, "word p False": 4.0, "word page p False": 2.0, "word h2 False": 1.0, "tag td": -0.3, "tag tr": -0.3, "tag span": -0.3, "tag b": -0.3}
    return html_text.main_text(page.replace("<article", f"<{mark}").replace("</article", f"</{mark}"), weights)


LONG = "<p>" + "Many words of a long paragraph in the article. " * 12 + "</p>"


def test_sections_named_like_furniture_stay_in_an_article():
    for name in ("discussion", "reviews", "share", "related", "notice", "disclaimer", "respond", "menu", "navigation"):
        page = f"<article><h1>Title</h1>{LONG}<section id='{name}'><h2>Its heading</h2><p>Prose of the section with a <a href=x>link</a> in it.</p></section>{LONG}</article>"
        assert "Its heading\nProse of the section with a link in it." in whole(page), name
        bare = f"<article><h1>Title</h1>{LONG}<div class='{name}-links'><p>Prose of the section in it.</p></div>{LONG}</article>"
        assert "Prose" not in whole(bare), name
        linked = f"<article><h1>Title</h1>{LONG}<div id='{name}'><h3>More</h3><ul><li><a href=x>Another article here</a></li><li><a href=y>And one more</a></li></ul></div>{LONG}</article>"
        assert "Another" not in whole(linked) and "More" not in whole(linked), name
    comments = f"<article>{LONG}<section id='comments'><h2>Comments</h2><p>I liked this a lot.</p></section></article><div id='discussion'><h2>Discussion</h2><p>So did I.</p></div>"
    assert "liked" not in whole(comments) and "So did" not in whole(comments)
    nested = "<article>" + "<div class='share'>" * 3_000 + "words" + "</div>" * 3_000 + LONG + "</article>"
    assert whole(nested) == whole(f"<article>{LONG}</article>")


def test_formulas_stay():
    page = f"<article>{LONG}<p>With <math><semantics><mi>E</mi><annotation encoding='application/x-tex'>E_x</annotation></semantics></math> as energy.</p></article>"
    assert whole(page).endswith("With E as energy.")


def test_short_first_and_last_parts_stay():
    rows = "".join(f"<tr><td><span><b>k{i}</b></span></td></tr>" for i in range(8))
    want = "\n".join(f"k{i}" for i in range(8))
    for mark in ("article", "main", "div"):
        page = f"<body><nav><a href=x>Home</a></nav><article><table>{rows}</table>{LONG}<table>{rows}</table></article><footer>us</footer></body>"
        got = whole(page, mark)
        assert got.startswith(want) and got.endswith(want) and "Home" not in got and "us" not in got.split("\n"), mark


def test_given_pages_without_their_mark(spark):
    """Weights learned from pages that mark their article find it on pages that don't."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").collect()
    want = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame([(r["page_id"], r["url"], r["html"], "", 0) for r in pages], SCHEMA)).collect()}
    bare = [(r["page_id"], r["url"], re.sub(r"<(/?)article>", r"<\1div>", r["html"]) if i % 2 else r["html"], "", 0) for i, r in enumerate(pages)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(bare, SCHEMA)).collect()}
    same = [got[r["page_id"]] == want[r["page_id"]] for i, r in enumerate(pages) if i % 2]
    assert sum(same) >= 0.9 * len(same)
