"""Main text of hand-made pages and of the given ones."""

import re
from html import unescape

from platen.llm import html_main

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a = "</p><p>no</p>";</script></head><body>
<header><div class="logo">Site</div></header><nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>
<div id="cookie-notice">We use cookies, please agree to everything we do.</div>
<div class="page"><aside>About the author and some more words here</aside>
<article><header><h1>Title &amp; more</h1></header><p>First <b>bold</b>
 text, with a <a href="x">link</a>.<p>Second&nbsp;one<br>goes on.</p><ul><li>item one<li>item two</ul>
<form><input><button>Send</button></form><div class="ad">Buy this now</div></article>
<section class="comments"><h2>Comments</h2><p>I liked it very much, thank you for writing this piece of text.</p></section></div>
<footer>&copy; someone</footer></body></html>"""


def test_hand_made_page():
    assert html_main.main_text(PAGE).split("\n\n") == [
        "Title & more", "First bold text, with a link.", "Second one goes on.", "item one", "item two",
    ]


def test_without_article_element():
    body = "".join(f"<p>{'some words of the story go here, and on they go. ' * 5}{i}</p>" for i in range(4))
    links = "".join(f'<li><a href="/{i}">Another story {i}</a></li>' for i in range(9))
    page = f'<body><div><ul>{links}</ul></div><div id="main-text">{body}</div><div class="sidebar"><p>{"x y " * 50}</p></div></body>'
    blocks = html_main.main_text(page).split("\n\n")
    assert len(blocks) == 4 and all(b.startswith("some words") for b in blocks)


def test_page_named_after_its_sidebar():
    page = '<body class="x"><div class="has-sidebar"><article><p>Kept text of the article.</p></article><div class="sidebar"><p>not this</p></div></div></body>'
    assert html_main.main_text(page) == "Kept text of the article."


STORY = "".join(f"<p>{f'Sentence {i} of the story goes on here, and on. ' * (4 + i % 3)}</p>" for i in range(5))


def test_unnamed_blocks_beside_the_article():
    comment = "A long reader comment that goes on about the story. " * 5
    page = f"""<body><div class="top"><p>Welcome to our site</p></div><div class="w"><div class="b1"><h1>The title</h1><div class="t">{STORY}</div></div>
<table><tr><td>Call us at any time</td></tr></table><div class="box3">{comment}</div></div><div class="bottom"><p>(c) 2024 All rights reserved</p></div></body>"""
    blocks = html_main.main_text(page).split("\n\n")
    assert blocks[0] == "The title" and len(blocks) == 6 and all(b.startswith("Sentence") for b in blocks[1:])


def test_parts_of_one_article():
    lead = "Lead words that open the story. " * 6
    page = f"""<body><div class="a"><h1>Title</h1><p>{lead}</p><div class="sec">{STORY}</div><div class="sec"><h2>More</h2><p>{lead}</p></div>
{lead}</div><div class="b"><p>Printed in Ghent</p></div></body>"""
    blocks = html_main.main_text(page).split("\n\n")
    assert [b.split()[0] for b in blocks] == ["Title", "Lead", *["Sentence"] * 5, "More", "Lead", "Lead"]


def test_names_are_evidence_only():
    story = html_main.main_text(STORY)
    for name in ("content has-sidebar", "page with-nav", "sidebar", "menu", "page share"):
        assert html_main.main_text(f'<body><div class="{name}">{STORY}</div><div class="b"><p>Printed in Ghent</p></div></body>') == story, name
    for outer in ("main", "article"):
        assert html_main.main_text(f'<body><{outer}><div class="page share">{STORY}</div></{outer}></body>') == story, outer
    for name in ('section id="related-work"', 'div class="social-history"', 'div class="notice-text"'):
        page = f'<body><div>{STORY}<{name}><p>More of it.</p></{name.split()[0]}></div></body>'
        assert html_main.main_text(page) == f"{story}\n\nMore of it.", name
    for name in ("related-posts", "side-bar", "ad-slot-3", "cookie-notice", "navbar", "share"):
        assert html_main.main_text(f'<body><div>{STORY}<div class="{name}"><p>More of it.</p></div></div></body>') == story, name
    thread = "<p>I liked it, and I will say why at some length here.</p>" * 6
    page = f'<body><div class="sidebar"><div>{STORY}</div><div class="comments">{thread}</div></div></body>'
    assert html_main.main_text(page) == story


def test_a_form_around_the_page_is_its_container():
    story = html_main.main_text(STORY)
    inside = f'<div class="head"><input name="q"><button>Search</button></div><div>{STORY}</div><select><option>One</option></select>'
    assert html_main.main_text(f'<body><form id="form1">{inside}</form></body>') == story
    assert html_main.main_text(f'<body><form id="form1"><article>{STORY}</article></form><ul>{"<li><a>beside it</a></li>" * 300}</ul></body>') == story
    ask = "<form><p>Leave your address and we will write to you every week about all there is.</p><input></form>"
    assert html_main.main_text(f"<body><div>{STORY}</div>{ask}</body>") == story
    assert html_main.main_text(f'<body><form><div>{STORY}</div><form role="search"><label>Find</label><input></form></form></body>').startswith(story)


def test_link_rich_paragraphs_stay():
    names = [f"A long title of work number {i} that is cited" for i in range(6)]
    cited = "".join(f'<p>See <a href="/{i}">{n}</a> now.</p>' for i, n in enumerate(names))
    page = f"<body><article><h1>References</h1>{cited}</article></body>"
    assert html_main.main_text(page).split("\n\n") == ["References", *[f"See {n} now." for n in names]]
    menu = "".join(f'<li><a href="/{i}">Story {i}</a></li>' for i in range(8))
    assert html_main.main_text(f"<body><article>{STORY}<ul>{menu}</ul></article></body>") == html_main.main_text(STORY)


def test_short_article_against_a_longer_line_of_rights():
    rights = "(c) 2024 All rights reserved by the owners of this site, their partners, and whoever else may hold them."
    page = f"<body><div><p>Short article that says little.</p></div><div><p>{rights}</p></div></body>"
    assert html_main.main_text(page) == "Short article that says little."
    assert html_main.main_text(f"<body><p>{rights}</p></body>") == rights
    assert html_main.main_text(f"<body><article>{STORY}<p>{rights}</p></article></body>").endswith(rights)
    assert html_main.main_text(f"<body><div>{STORY}<p>{rights}</p></div><div class='b'><p>Printed in Ghent</p></div></body>").endswith(rights)
    law = "Copyright law changed in many lands. " * 12
    assert html_main.main_text(f"<body><div><p>{law}</p></div></body>") == law.strip()


def test_page_made_of_tables():
    page = f'''<body><table><tr><td><a href="/a">Home</a> <a href="/b">News</a></td></tr><tr><td>{STORY}</td></tr>
<tr><td>Call us at any time</td></tr></table></body>'''
    assert html_main.main_text(page) == html_main.main_text(STORY)


def test_odd_pages():
    for page in (None, "", "<", "<p", "<!-- only", "</p></div>", "<script>x"):
        assert html_main.main_text(page) == "" or "<" in page
    assert html_main.main_text("plain text") == "plain text"
    deep = "<div>" * 20_000 + "deep" + "</div>" * 20_000
    assert html_main.main_text(deep) == "deep"
    assert html_main.main_text("<p>a &am <b>b</p><p>c &#39;d&quot;</p>") == "a &am b\n\nc 'd\""


def test_given_pages(spark, sf_dir):
    """The given pages hold one article each: headings and paragraphs, nothing else."""
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    got = {r.page_id: r for r in html_main.extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).collect()}
    assert len(got) == len(rows)
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]*>", " " if "<br" in p else "", p))).strip() for p in re.split(r"</?(?:h1|p)>", inner)]
        assert got[r.page_id].text == "\n\n".join(p for p in parts if p), r.page_id
        assert got[r.page_id].n_chars == len(got[r.page_id].text)


def test_odd_rows(spark):
    df = spark.createDataFrame(
        [(1, None, None, 0), (None, "u", "<p>a</p>", 1), (None, "u", "<p>a</p>", 1)], "page_id long, url string, html string, text int"
    )
    got = sorted((str(r.page_id), str(r.url), r.text, r.n_chars) for r in html_main.extract(df).collect())
    assert got == [("1", "None", "", 0), ("None", "u", "a", 1), ("None", "u", "a", 1)]
    assert html_main.extract(df.limit(0)).count() == 0
