"""Minimum-cut extraction: the cut against brute force, pages, edge rows."""

import itertools
import random

import pytest

from waymark.llm.html_extract import blocks_of, main_text, minimum_cut, with_main_text


def test_cut_is_the_cheapest_labelling():
    rng = random.Random(1)
    for _ in range(150):
        n = rng.randrange(1, 9)
        content, boiler = ([rng.randrange(12) for _ in range(n)] for _ in range(2))
        arcs = [(i, j, rng.randrange(1, 8)) for i, j in itertools.combinations(range(n), 2) if rng.random() < 0.5]

        def cost(labels):
            own = sum(content[i] if x else boiler[i] for i, x in enumerate(labels))
            return own + sum(c for i, j, c in arcs if labels[i] != labels[j])

        got = minimum_cut(content, boiler, arcs)
        assert cost(got) == min(cost(x) for x in itertools.product([False, True], repeat=n))


LONG = "The council met on Tuesday to discuss the new bridge, and after two hours it agreed on a plan for the river."
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>
<header class="site-header"><h2>Daily News</h2></header><nav><ul><li><a href="/a">Home</a><li><a href="/b">World</a></ul></nav>
<div class="cookie-notice">We use cookies to improve your experience on our site, please accept them all today.</div>
<div id="mainContent"><h1>Bridge &amp; river</h1><p>{LONG}<br>Second&nbsp;line.<p><b>{LONG}
  </b> more</p><aside class="sidebar"><p>{LONG}</p></aside><form><label>Mail</label><input><button>Send</button></form></div>
<section class="comments"><p>I do not agree with any of this, and I have lived here for forty years, so listen to me.</p></section>
<footer>&copy; 2020 Daily News. All rights reserved, in all countries and languages.</footer>"""


def test_article_without_its_surroundings():
    want = ["Bridge & river", f"{LONG} Second line.", f"{LONG} more"]
    assert main_text(PAGE) == "\n".join(want)


def test_plain_article():
    page = f"<body><nav><a href='/'>x</a></nav><!-- ad --><div class='ad'>Buy now</div><article><h1>Title</h1><p>{LONG}</p><p>Of.</p></article><footer>f</footer>"
    assert main_text(page) == f"Title\n{LONG}\nOf."


def test_broken_pages():
    assert main_text(None) == main_text("") == main_text("<!-- open <p>x</p>") == main_text("<script>x") == ""
    assert main_text("<p>1 < 2 &lt; 3 <unclosed " + LONG) == "1 < 2 < 3"
    deep = "<div>" * 3000 + f"<p>{LONG}</p>"
    assert main_text(deep) == LONG
    many = "<article>" + f"<p>{LONG}</p>" * 20000 + "</article>"
    assert main_text(many).count("\n") == 19999


def test_pages_table(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "x"), (None, "u", "", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text2 string")
    got = with_main_text(df)
    assert got.columns == [*df.columns, "text"]
    assert [r["text"] for r in got.orderBy("page_id").collect()] == ["", main_text(PAGE), main_text(PAGE), ""]
    assert with_main_text(df.limit(0)).count() == 0


def test_class_names_that_speak_of_the_text():
    inner = f"<h1>Title</h1><p>{LONG}</p><p>{LONG}</p>"
    want = f"Title\n{LONG}\n{LONG}"
    for page in (
        f'<body><article class="post tag-city tag-2020 tag-top">{inner}</article></body>',
        f'<body><article class="comments sidebar" id="more">{inner}</article></body>',
        f'<body class="single no-sidebar sidebar">{inner}</body>',
        f'<body><div class="content has-comments">{inner}</div></body>',
        f'<body><div class="layout with-sidebar">{inner}</div></body>',
        f'<body><div class="overlay"><article>{inner}</article></div></body>',
        f'<body><nav><ul><li><a href="/">Home</a></ul><main class="skip">{inner}</main></body>',
        f'<body><div class="sidebar"><div role="main">{inner}</div></div></body>',
        f'<body><div data-hidden="false" title="the hidden valley" data-class="sidebar">{inner}</div></body>',
        f"<body><div title='class=\"ad\" hidden' data-x=a/hidden>{inner}</div></body>",
    ):
        assert main_text(page) == want, page


def test_class_names_of_what_stands_beside():
    for name in ("sidebar", "cookie-notice", "site-footer", "comment-list", "post-comments", "relatedPosts", "ad-300", "widget_area", "tag-cloud"):
        assert main_text(f'<article><p>{LONG}</p></article><div class="x {name}"><p>{LONG}</p></div>') == LONG, name
    comment = f'<ol class="comment-list"><li class="comment"><article class="comment-body"><p>{LONG} No.</p></article></ol>'
    assert main_text(f"<article><p>{LONG}</p></article>{comment}") == LONG
    assert main_text(f"<article><p>{LONG}</p></article><div hidden><p>{LONG}</p></div>") == LONG


def test_elements_without_end_tags():
    article = f"<article><h1>Title</h1><p>{LONG}</p></article>"
    want = f"Title\n{LONG}"
    lists = "<datalist id=x><option value=a><option value=b>B</datalist>", "<select><option>A<optgroup><option>B</select>", "<select><option>A"
    media = "<button>", "<object data=x>", "<video src=x>", "<canvas>", "<noscript>", "<iframe src=x>", "<button/>", "<option>A"
    for before in (*lists, *media):
        assert main_text(f"<body>{before}{article}") == want, before
        assert main_text(f"<body>{article.replace('<p>', before + '<p>')}") == want, before
    assert main_text(f"<body><video><p>{LONG} No.</p>{article}<video><p>{LONG} No.</p></video>").endswith(want)
    assert main_text(f"<body><object><div><p>{LONG} No.</div></object><select><option>{LONG}</option></select>{article}") == want
    assert main_text(f"<div><button><b>{LONG} No.</b></div></button>{article}") == want


def test_text_around_embedded_elements_is_one_block():
    math = "<math><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation>x^{2}</annotation></semantics></math>"
    page = f"<article><p>{LONG} <svg><g><path/><text>no</text></g></svg><a href='/'><button>b</button>link</a> and {math} hold.</p><p>{LONG}</p></article>"
    assert main_text(page) == f"{LONG} link and x=2 hold.\n{LONG}"


def test_implied_ends():
    page = f"<article><table><tr><td>{LONG}<td><p>{LONG}<tr><th>{LONG}</table><dl><dt>{LONG}<dd>{LONG}<dt>{LONG}</dl></article>"
    blocks = blocks_of(page)
    assert [b.tag for b in blocks] == ["td", "p", "th", "dt", "dd", "dt"]
    assert blocks[0].text == LONG and main_text(page).count(LONG) == 6


def test_deep_elements_have_their_own_labels():
    page = "<div>" * 600 + f"<article><p>{LONG}</p><nav><p>{LONG} No.</p></nav><p>{LONG}</p></article>"
    assert main_text(page) == f"{LONG}\n{LONG}"


STORY = "The council met on Monday and agreed on the plan for the new library, which will open in the spring of next year."


@pytest.mark.parametrize(
    "before,after",
    [('<form id="aspnetForm" action="./">', "</form>"), ('<div class="more">', "</div>"), ('<div class="hidden lg:block">', "</div>"), ("<!--><!--->", "")],
)
def test_wrappers_do_not_empty_a_page(before, after):
    page = f"<body>{before}<h1>News</h1><p>{STORY}</p><p>{STORY} Again.</p>{after}<div class='footer'>Imprint</div></body>"
    assert main_text(page).endswith(f"{STORY}\n{STORY} Again.")


def test_forms_beside_the_text_go():
    form = "<form><p>Subscribe to our letter and get the news of the week by e-mail, every Friday, for free.</p><input></form>"
    page = f"<body><h1>News</h1><p>{STORY}</p><p>{STORY} Again.</p>{form}</body>"
    assert "Subscribe" not in main_text(page) and "Again" in main_text(page)
    inside = f"<body><form id='aspnetForm'><div class='search-form'>Search this site</div><p>{STORY}</p><p>{STORY} Again.</p></form></body>"
    assert main_text(inside) == f"{STORY}\n{STORY} Again."


def test_comments_end_where_they_should():
    assert main_text(f"<p>{STORY}</p><!--><p>{STORY} Two.</p>--><p>{STORY} Three.</p>").count(STORY) == 3
