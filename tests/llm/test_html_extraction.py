import html
import re

import pytest
from pyspark.sql import functions as F

from stepguard.llm.html_extraction import PART_MARKED, main_text, name_weight, page_text, smoothed
from stepguard.llm.queries import QUERIES

PROSE = "A long paragraph of the article with many words in it, so that its ratio is high. " * 3


def text(page: str) -> str:
    return page_text(page)[0]


def test_menus_scripts_and_footers_go():
    page = (
        "<html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head><body>"
        "<nav><a href=x>Home</a></nav><div class='ad'>Buy &amp; save</div><header>Site</header>"
        f"<article><h1>Head</h1><p>{PROSE}<p>Ti.<br>After</p></article>"
        f"<div id=comments><p>{PROSE}</p></div><aside>{PROSE}</aside><form>{PROSE}<input></form>"
        "<footer>&copy; me</footer></body></html>"
    )
    assert text(page) == f"Head {PROSE.strip()} Ti. After"


def test_references_white_space_and_inline_tags():
    page = "<body><p>a&amp;b &lt;x&gt; &#233;&eacute;\n\t two<b>bold</b>er <i>x</i></p></body>"
    assert text(page) == "a&b <x> éé twobolder x"


def test_a_page_without_article_keeps_its_content_region():
    page = f"<body><div><ul><li><a>One</a></li><li><a>Two</a></li></ul></div><div><p>{PROSE}</p><p>Ti.</p></div></body>"
    assert text(page) == f"{PROSE.strip()} Ti."


def test_broken_and_empty_pages():
    assert [text(p) for p in ("", "   ", "<", "<![x[", "<!--", "<p", "&", "<br><br>")] .count(None) == 0
    assert text("") == "" and text("<div></div>") == "" and text("plain words") == "plain words"
    assert text("<article><p><b>open <p>never closed").split() == ["open", "never", "closed"]
    assert text("<div><span class=ad>x<span>y</span>z</span>kept</div>") == "kept"


def test_smoothing_keeps_constants():
    import numpy as np

    assert np.allclose(smoothed(np.full(7, 3.0)), 3.0)


def test_long_page_nulls_and_empty_table(spark):
    pages = spark.createDataFrame([(1, f"<p>{'word ' * 100_000}</p>"), (2, None), (2, None)], "id long, html string")
    got = {r.id: r.f.text for r in pages.select("id", main_text(F.col("html")).alias("f")).collect()}
    assert len(got[1]) == 499_999 and got[2] == ""
    assert pages.limit(0).select(main_text(F.col("html"))).count() == 0


def test_query_against_the_articles_of_the_pages(spark, folder):
    source = {r.page_id: r.html for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    rows = QUERIES["op1_html_extraction"](spark, folder).collect()
    assert len(rows) == len(source)
    for row in rows:
        page = source[row.page_id]
        article = page[page.index("<article>") + 9 : page.index("</article>")]
        blocks = re.split(r"<(?:/?p|/?h1|br)>", article)
        wanted = " ".join(" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks)
        assert row.text == " ".join(wanted.split())
        assert row.n_chars == len(row.text)


def test_story_in_a_div_beside_comment_articles():
    posts = "".join(f"<article class='comment'><p>{PROSE}</p></article>" for _ in range(3))
    page = f"<body><main><div><p>{PROSE}</p><p>Ti.</p></div><section>{posts}</section></main></body>"
    assert text(page) == f"{PROSE.strip()} Ti."


def test_regions_outside_an_article_and_other_articles_are_judged_by_their_lines():
    card = "<article><a href=x><b><i><u>Go</u></i></b></a></article>"
    story = f"<article><p>{PROSE}</p><div><p>Ti.</p></div></article>"
    page = f"<body>{card * 4}<div><p>{PROSE}</p></div>{story}{card * 4}</body>"
    assert text(page) == f"{PROSE.strip()} {PROSE.strip()} Ti."


LONG = "A story of many words that is told here at some length, so that its ratio is high, with no tags in between. " * 2


@pytest.mark.parametrize(
    "page,lost",
    [
        ("<article><p class=ad>Buy<p>{}</article>", "Buy"),
        ("<article><ul><li class=ad>Buy<li>{}</ul></article>", "Buy"),
        ("<article><ul><li class=ad>Buy</ul><p>{}</article>", "Buy"),
        ("<article><ul><li class=ad>Buy<ul><li>more</ul><li>{}</ul></article>", "more"),
        ("<article><dl><dt class=ad>Buy<dd>{}</dl></article>", "Buy"),
        ("<article><table><tr><td class=ad>Buy<td>{}</table></article>", "Buy"),
        ("<article><table><tr class=ad><td>Buy<tr><td>{}</table></article>", "Buy"),
        ("<article><div><p class=ad>Buy</div><p>{}</article>", "Buy"),
        ("<article><form><select><option>Buy<option>x</select></form><p>{}</article>", "Buy"),
    ],
)
def test_end_tags_left_out(page, lost):
    text, _, _ = page_text("<html><body>" + page.format(LONG) + "</body></html>")
    assert LONG.strip() in text and lost not in text


def test_partly_marked_names_take_from_a_vote_alone():
    page = f"<article><h1 class='article-header'>Head</h1><p class='share-price'>{PROSE}</p><p id='research search'>Ti.</p></article>"
    assert text(page) == f"Head {PROSE.strip()} Ti."
    assert name_weight("p", "share-price") == name_weight("div", "share-price") == PART_MARKED
    assert name_weight("div", "site-footer") == name_weight("div", "col sidebar") == name_weight("p", "ad") == 0
    assert name_weight("p", "search") == name_weight("div", "story lead") == 1


def test_marked_boxes_in_an_article_go():
    boxes = ("comment-thread", "user_comments", "ad", "share-bar", "related-links", "newsletter-box")
    page = "".join(f"<div class='{name}'><p>{PROSE}</p><p>{name}</p></div><p>{i}</p>" for i, name in enumerate(boxes))
    assert text(f"<article><p>{PROSE}</p>{page}</article>") == f"{PROSE.strip()} 0 1 2 3 4 5"


def test_a_main_without_article_is_one_region():
    assert text(f"<body><main><div>One.</div><div>{PROSE}</div><div>Two.</div></main></body>") == f"One. {PROSE.strip()} Two."
    page = f"<body><main><div><a href=x>Up</a></div><article><p>{PROSE}</p><div>Ti.</div></article></main></body>"
    assert text(page) == f"{PROSE.strip()} Ti."


def test_ratios_alone_choose_the_region_on_most_pages(spark, folder):
    """All names and elements weigh the same; only text that isn't shown gives no lines."""
    pages = [r.html for r in spark.read.parquet(f"{folder}/pages.parquet").collect()]
    same = sum(page_text(page, weighted=False)[0] == page_text(page)[0] for page in pages if page)
    assert same >= 0.85 * len(pages)


def test_a_page_of_surroundings_alone_is_empty():
    assert text(f"<body><nav>{PROSE}</nav><div class=ad>{PROSE}</div><footer>{PROSE}</footer></body>") == ""
