"""Text functions on small cases with known answers."""

import pytest
from pyspark.sql import functions as F

from platen.functions import markup, tabular, text as txt


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "s string").select(fn(F.col("s")).alias("v")).first()[0]


@pytest.mark.parametrize(
    "raw,want",
    [
        ("AT&amp;T &lt;x&gt;", "AT&T <x>"), ("&AMP;&#8364;&#x20AC;", "&€€"), ("&bogus; &#9999999; & ;", "&bogus; &#9999999; & ;"),
        ("&amp;lt;", "&lt;"), ("&#xD800;", "�"), ("&#xFEFF;a", "﻿a"), ("", ""), ("&nbsp;", " "),
    ],
)
def test_entities(spark, raw, want):
    assert one(spark, raw, txt.decode_entities) == want


def test_trim_is_wide(spark):
    assert one(spark, " ﻿\t a b 　\n", txt.trim_ws) == "a b"


def test_text_to_markdown(spark):
    assert one(spark, "Title\n\nbody one.\n  two ", txt.text_to_markdown) == "## Title\n\nbody one.\ntwo\n"


def test_summary(spark):
    assert one(spark, "Hi. This is long enough. Another one here! third one yes.", txt.lead_summary) == "This is long enough. Another one here!\n"
    assert one(spark, "short", txt.lead_summary) == "short\n"


def test_wrap(spark):
    import textwrap

    words = "lorem ipsum dolor " * 40
    lines = one(spark, words.strip() + "\n" + "x" * 120 + "\n\nend", txt.wrap_lines)
    assert lines == textwrap.wrap(words, 92) + ["x" * 120, "", "end"]
    assert one(spark, "a  b " * 30 + "\t" + "c" * 20, txt.wrap_lines) == one(spark, "a  b " * 30 + "\t" + "c" * 20, lambda c: txt.wrap_lines(c))
    mixed = "short " + "w" * 130 + " tail words" * 12
    assert one(spark, mixed, txt.wrap_lines) == textwrap.wrap(mixed, 92, break_long_words=False)


def test_long_texts_are_wrapped_in_linear_time(spark):
    df = spark.range(1).select(F.repeat(F.lit("lorem ipsum "), 500_000).alias("s"))
    assert df.select(F.size(txt.wrap_lines(F.rtrim(F.col("s"))))).first()[0] > 60_000


def test_crafted_markup_stays_a_row(spark):
    assert md_of(spark, "\0PRE99999999999\0<p>x</p>") == "x\n"


MD = "\n".join(
    ["### Ferry notes", "Boats leave *hourly*", "from `pier <2>`.", "", "* bread", "+ milk", "still milk", "2) pay **now**", "",
     "|port|depth|", "|:--|--:|", "| Elb & Co | [map](/charts) |", "", "```sh", "ls -l | wc", "```", "Ask [them](ftp://x.test)"]
)
HTML = (
    "<h3>Ferry notes</h3>\n<p>Boats leave <em>hourly</em> from <code>pier &lt;2&gt;</code>.</p>\n<ul>\n<li>bread</li>\n<li>milk</li>\n"
    "<p>still milk</p>\n</ul>\n<ol>\n<li>pay <strong>now</strong></li>\n</ol>\n<table><thead>\n"
    "<tr><th>port</th><th>depth</th></tr>\n</thead><tbody>\n"
    '<tr><td>Elb &amp; Co</td><td><a href="/charts">map</a></td></tr>\n</tbody></table>\n'
    '<pre><code>ls -l | wc</code></pre>\n<p>Ask <a href="#">them</a></p>'
)


def test_markdown_to_html(spark):
    assert one(spark, MD, markup.markdown_to_html) == HTML
    assert one(spark, "", markup.markdown_to_html) == ""
    assert one(spark, "```\nopen", markup.markdown_to_html) == "<pre><code>open</code></pre>"
    assert one(spark, "| a |\n```\nx\n```\n| b |", markup.markdown_to_html).count("<table>") == 1


def md_of(spark, html):
    df = spark.createDataFrame([(html,)], "h string")
    return markup.with_markdown(df, "h", "md").first().md


def test_html_to_markdown(spark):
    assert md_of(spark, "<h2>A &amp; b</h2><p>x <b>y</b><br>z</p>") == "## A & b\n\nx **y** z\n"
    assert md_of(spark, "<ol><li>a</li><li>b</li></ol><blockquote>q\nr</blockquote>") == "1. a\n2. b\n\n> q\n> r\n"
    assert md_of(spark, "<table><tr><th>a|b</th><td>c</td></tr></table><p>after</p>") == "after\n\n| a/b | c |\n| --- | --- |\n"
    assert md_of(spark, "<pre><code>l1\nl2\n</code></pre>") == "```\nl1\nl2\n```\n"
    assert md_of(spark, "<script>x</script><div>left</div>") == "left\n"


def test_html_to_text(spark):
    assert one(spark, "<script>a<b</script><p>x&nbsp;y</p>\n\n\n\n<i>z</i>", markup.html_to_text) == "x y \n\n z\n"
    styled = "<style>p{}</style>k"
    assert one(spark, styled, markup.html_to_text) == "p{} k\n"
    assert one(spark, styled, lambda c: markup.html_to_text(c, drop_style=True)) == "k\n"


@pytest.mark.parametrize(
    "csv,rows",
    [
        ('a,b\r\n"x ""q"" y",2\n\n" "\n', [["a", "b"], ['x "q" y', "2"]]),
        ('"\nmid"q,"z,3\r"open', [["\nmidq", "z,3\ropen"]]), ("a,", [["a", ""]]), ("", []), ('""""', [['"']]), ("a\rb", [["a"], ["b"]]),
    ],
)
def test_csv(spark, csv, rows):
    assert one(spark, csv, tabular.parse_csv) == rows


def test_csv_write_then_read(spark):
    source = 'a,"b ""x""",c\r\nd,"e\nf",\r\n'
    assert one(spark, source, lambda c: tabular.render_csv(tabular.parse_csv(c))) == source


def test_base64(spark):
    assert bytes(one(spark, "data:text/plain;base64, aGk=\n", txt.base64_bytes)) == b"hi"
    assert bytes(one(spark, "aGk", txt.base64_bytes)) == b"hi"
    for bad in ("%%%", "a", "aGk==", "a=Gk"):
        assert one(spark, bad, txt.base64_bytes) is None


@pytest.mark.parametrize("value,ok", [("1", 1), ("1e5", 1), ("", 0), (" ", 0), ("0x1F", 1), ("1d", 0), ("1e999", 0), ("-.5", 1), ("Infinity", 0)])
def test_numbers(spark, value, ok):
    assert one(spark, value, txt.is_numeric_cell) is bool(ok)


@pytest.mark.parametrize("letters,index", [("A", 0), ("Z", 25), ("AA", 26), ("BC", 54), ("ZZ", 701), ("AAA", 702), ("XFD", 16383), ("ZZZ", 18277), ("AAAA", 18278), ("ABCDEF", 12850895)])
def test_letters(spark, letters, index):
    assert one(spark, letters, txt.column_index) == index
    df = spark.createDataFrame([(index,)], "i int")
    assert df.select(txt.column_letters(F.col("i"))).first()[0] == letters
    assert one(spark, "A" * 14, txt.column_index) is None


def test_long_inputs_do_not_exhaust_the_stack(spark):
    big = '"' + "x," * 200_000 + '"\n' + "- item\ntext\n" * 5_000
    df = spark.createDataFrame([(big,)], "s string")
    row = df.select(F.size(tabular.parse_csv(F.col("s"))).alias("n"), F.length(markup.markdown_to_html(F.col("s"))).alias("h")).first()
    assert row.n == 10_001 and row.h > 400_000


def test_contained_words_are_counted_with_repeats(spark):
    from platen.functions.text import count_contained

    many = [f"w{i:03}" for i in range(60)]
    given = [
        (["a", "b", "b", "lost", "lost", "art"], "a b part"), (many * 3 + ["x"] * 4, "x " + " ".join(many[::4])),
        ([], "a"), (["a"], ""), (["*b*", "b"] * 2, "b\tc"),
    ]
    df = spark.createDataFrame(given, "words array<string>, text string")
    counted = df.select("words", "text", count_contained(F.col("words"), F.col("text")).alias("n"))
    assert [r.n for r in counted.collect()] == [sum(w in text for w in words) for words, text in given]
    long = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(3000)), lambda i: F.concat(F.lit("word"), i.cast("string"))).alias("words"))
    n = long.select(count_contained(F.col("words"), F.array_join(F.reverse("words"), " "))).first()[0]
    assert n == 3000
