"""Plain-text functions: whitespace, entities, wrapping, lead summary, numbers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .lang import let, lookup, regexp_map

# Whitespace is the wide Unicode set (no-break space and byte-order mark
# included), for trimming as well as for \s in patterns.
SPACE = r"\t-\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
WS = f"[{SPACE}]"
NOT_WS = f"[^{SPACE}]"

# Named entities and the characters they stand for.
NAMED_ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": chr(0xA0),
    "ensp": chr(0x2002), "emsp": chr(0x2003), "copy": "©", "reg": "®", "trade": "™",
    "hellip": "…", "mdash": "—", "ndash": "–", "lsquo": "‘", "rsquo": "’",
    "ldquo": "“", "rdquo": "”", "bull": "•", "middot": "·", "deg": "°",
    "plusmn": "±", "times": "×", "divide": "÷", "laquo": "«", "raquo": "»",
    "sect": "§", "para": "¶", "euro": "€", "pound": "£", "yen": "¥", "cent": "¢",
}
ENTITY = r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
MAX_CODE_POINT = 0x10FFFF


SPACE_CHARS = "".join(
    chr(c)
    for first, last in [(0x09, 0x0D), (0x20, 0x20), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
                        (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000), (0xFEFF, 0xFEFF)]
    for c in range(first, last + 1)
)


def trim_ws(s: Column) -> Column:
    """Strip wide whitespace at both ends (``trim`` alone only strips spaces)."""
    return F.trim(s, F.lit(SPACE_CHARS))


def trim_end(s: Column) -> Column:
    return F.rtrim(s, F.lit(SPACE_CHARS))


def is_blank(s: Column) -> Column:
    return ~s.rlike(NOT_WS)


def collapse_ws(s: Column) -> Column:
    return trim_ws(F.regexp_replace(s, f"{WS}+", " "))


def code_point(cp: Column) -> Column:
    """Character for a code point; NULL beyond Unicode, U+FFFD for lone surrogates."""
    return (
        F.when(cp > MAX_CODE_POINT, F.lit(None).cast("string"))
        .when(cp.between(0xD800, 0xDFFF), "�")
        .when(cp == 0xFEFF, chr(0xFEFF))  # the decoder would swallow it as a byte-order mark
        .otherwise(F.decode(F.unhex(F.lpad(F.hex(cp), 8, "0")), "UTF-32"))
    )


def _entity_value(body: Column) -> Column:
    hexadecimal = F.conv(F.substr(body, F.lit(3)), 16, 10).cast("bigint")
    decimal = F.substr(body, F.lit(2)).try_cast("bigint")
    value = (
        F.when(body.rlike("^#[xX]"), code_point(hexadecimal))
        .when(body.startswith("#"), code_point(decimal))
        .otherwise(lookup(NAMED_ENTITIES, F.lower(body)))
    )
    return F.coalesce(value, F.concat(F.lit("&"), body, F.lit(";")))


def decode_entities(s: Column) -> Column:
    """One decoding pass; names are case-insensitive, unknown references stay as they are."""
    return regexp_map(s, ENTITY, _entity_value)


def escape_markup(s: Column) -> Column:
    s = F.replace(s, F.lit("&"), F.lit("&amp;"))
    s = F.replace(s, F.lit("<"), F.lit("&lt;"))
    return F.replace(s, F.lit(">"), F.lit("&gt;"))


def unix_lines(s: Column) -> Column:
    return F.replace(s, F.lit("\r\n"), F.lit("\n"))


def utf8_text(content: Column) -> Column:
    """Bytes as text: invalid sequences become U+FFFD and one leading mark is dropped."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), r"^\x{feff}", "")


def count_contained(words: Column, text: Column) -> Column:
    """How many of the words, repeats counted, stand somewhere in the text.

    A word that is a token of the text needs no search; of the others each distinct one searches the
    text once. Repeats of few lost words are counted by comparing, of many after sorting.
    """

    def tagged(values: Column, is_word: bool) -> Column:
        return F.transform(values, lambda x: F.struct(x.alias("x"), F.lit(is_word).alias("word")))

    def repeats(lost: Column) -> Column:
        few = F.size(F.filter(words, lambda w: F.array_contains(lost, w)))
        start = F.struct(F.lit(None).cast("string").alias("x"), F.lit(0).alias("n"))

        def put(acc: Column, e: Column) -> Column:
            # A lost word sorts before its repeats, so it is the last one seen when they come.
            hit = (e["word"] & acc["x"].eqNullSafe(e["x"])).cast("int")
            return F.struct(F.when(e["word"], acc["x"]).otherwise(e["x"]).alias("x"), (acc["n"] + hit).alias("n"))

        both = F.array_sort(F.concat(tagged(words, True), tagged(lost, False)))
        many = F.aggregate(both, start, put, lambda acc: acc["n"])
        return F.when(F.size(lost) == 0, 0).when(F.size(lost) <= 16, few).otherwise(many)

    missing = F.array_except(words, F.split(text, "[ \t\n\f\r]+", -1))
    lost = F.filter(missing, lambda w: ~F.contains(text, w))
    return F.size(words) - let(lost, repeats)


def latin1_bytes(s: Column) -> Column:
    """Text as Latin-1 bytes, ``?`` for characters outside the range."""
    return F.encode(F.regexp_replace(s, r"[^\x00-\xff]", "?"), "ISO-8859-1")


def latin1_text(content: Column) -> Column:
    return F.decode(content, "ISO-8859-1")


def base64_bytes(b64: Column) -> Column:
    """Decode base64 after dropping a ``data:`` prefix and whitespace; NULL if invalid.

    Unpadded input is accepted, as browsers do; any other length or alphabet is not.
    """
    clean = F.regexp_replace(F.regexp_replace(b64, "^data:[^,]*,", ""), f"{WS}+", "")

    def decoded(s: Column) -> Column:
        core = F.regexp_replace(s, "={1,2}\\z", "")
        padded = F.rpad(core, (F.ceil(F.length(core) / 4) * 4).cast("int"), F.lit("="))
        whole = ~s.endswith("=") | (F.length(s) % 4 == 0)
        ok = core.rlike("^[A-Za-z0-9+/]*\\z") & (F.length(core) % 4 != 1) & whole
        return F.when(ok, F.try_to_binary(padded, F.lit("base64")))

    return let(clean, decoded)


def text_to_markdown(text: Column) -> Column:
    """Blank-line separated blocks; a short capitalised line without end punctuation is a heading."""

    def block(b: Column) -> Column:
        heading = (
            ~F.contains(b, F.lit("\n"))
            & (F.length(b) < 70)
            & b.rlike("[A-Z]")
            & ~b.rlike(r"[.!?,;:]\z")
        )
        body = F.array_join(F.transform(F.split(b, "\n", -1), trim_ws), "\n")
        return F.when(heading, F.concat(F.lit("## "), trim_ws(b))).otherwise(body)

    blocks = F.transform(F.split(unix_lines(text), r"\n{2,}", -1), block)
    return F.concat(F.array_join(blocks, "\n\n"), F.lit("\n"))


def lead_summary(text: Column, sentences: int = 2, longer_than: int = 12, otherwise: int = 160) -> Column:
    """The first ``sentences`` sentences of more than ``longer_than`` characters, else the first ``otherwise`` characters."""

    def summary(s: Column) -> Column:
        found = F.transform(F.split(s, f"(?<=[.!?]){WS}+|\\n+", -1), trim_ws)
        lead = F.array_join(F.slice(F.filter(found, lambda x: F.length(x) > longer_than), 1, sentences), " ")
        return F.concat(let(lead, lambda x: F.when(x == "", F.left(s, F.lit(otherwise))).otherwise(x)), F.lit("\n"))

    return let(text, summary)


# Fixed values of the page writer: columns per line and lines per page.
WRAP_WIDTH = 92
LINES_PER_PAGE = 45


def wrap_lines(text: Column, width: int = WRAP_WIDTH) -> Column:
    """Greedy wrap on spaces, as an array of lines; a word longer than the width stays whole.

    A line of plainly spaced words is cut by one pattern, in time linear in its length; only lines
    with other white space, or more than one blank in a row, are folded word by word.
    """

    def fold(raw: Column) -> Column:
        start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("line"))

        def put(acc: Column, word: Column) -> Column:
            done, line = acc["done"], acc["line"]

            def state(lines: Column, current: Column) -> Column:
                return F.struct(lines.alias("done"), current.alias("line"))

            joined = F.concat(line, F.lit(" "), word)
            return (
                F.when(line == "", state(done, word))
                .when(F.length(trim_ws(joined)) > width, state(F.array_append(done, line), word))
                .otherwise(state(done, joined))
            )

        return F.aggregate(
            F.split(raw, " ", -1), start, put, lambda acc: F.array_append(acc["done"], acc["line"])
        )

    def wrap(raw: Column) -> Column:
        odd = raw.rlike(rf"^ | \z|  |(?! ){WS}")
        cut = F.regexp_extract_all(raw, F.lit(rf"(?s)(.{{1,{width}}}|[^ ]{{{width + 1},}}+)(?: |\z)"), F.lit(1))
        return F.when(F.length(raw) <= width, F.array(raw)).when(odd, fold(raw)).otherwise(cut)

    return F.flatten(F.transform(F.split(unix_lines(text), "\n", -1), wrap))


def page_estimate(lines: Column) -> Column:
    """Pages a plain-text export needs, at least one."""
    return F.greatest(F.lit(1), F.ceil(F.size(lines) / LINES_PER_PAGE).cast("int"))


NUMBER = (
    r"^(?:[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
    r"|0[xX][0-9a-fA-F]+|0[bB][01]+|0[oO][0-7]+)\z"
)


def is_numeric_cell(v: Column) -> Column:
    """True for text a spreadsheet stores as a number; blanks and overflowing exponents are text."""

    def check(s: Column) -> Column:
        value = F.abs(s.try_cast("double"))
        finite = F.coalesce(value < F.lit(float("inf")), F.lit(True))
        return s.rlike(NUMBER) & finite

    return let(trim_ws(v), check)


MAX_LETTERS = 13  # more do not fit a 64-bit number


def column_index(letters: Column) -> Column:
    """Spreadsheet column letters to a 0-based index (A → 0, BC → 54); NULL if the number does not fit 64 bits."""
    digits = F.transform(F.split(letters, ""), lambda c: (F.ascii(c) - 64).cast("bigint"))
    index = F.aggregate(digits, F.lit(0).cast("bigint"), lambda a, d: a * 26 + d) - 1
    return F.when(F.length(letters) <= MAX_LETTERS, index)


def column_letters(index: Column) -> Column:
    """0-based column index to letters, as many as it takes."""

    def letter(n: Column) -> Column:
        return F.char(n.cast("int") + 65)

    def more(s: Column, _: Column) -> Column:
        rest = s["n"] - 1
        step = F.struct(F.floor(rest / 26).alias("n"), F.concat(letter(rest % 26), s["out"]).alias("out"))
        return F.when(s["n"] > 0, step).otherwise(s)

    start = F.struct((index + 1).cast("bigint").alias("n"), F.lit("").alias("out"))
    long = F.aggregate(F.sequence(F.lit(1), F.lit(MAX_LETTERS)), start, more, lambda s: s["out"])
    short = F.concat(letter(F.floor(index / 26) - 1), letter(index % 26))
    return F.when(index < 26, letter(index)).when(index < 702, short).otherwise(long)
