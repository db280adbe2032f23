"""Secret scans with multipart credential linking.

Strong patterns are reported wherever they match. Weak candidates (an account name, a token-like
string, an endpoint) are common in clean text, so they are reported only where complementary parts
meet: a token-like string beside an identifier or an endpoint, an identifier or an endpoint beside
a token-like or strong secret. Parts are intervals on the text of a document, and two of them meet
where the end of one and the start of the other are at most ``scope`` characters apart. So the join
is one of points: starts and ends fall into cells of ``scope`` characters, the end of a secret is
looked up among starts in its own and the next cell, its start among ends in its own and the one
before, and pairs too far apart are dropped. The length of a part does not matter.

Places are found without Python: the text is cut at the matches of a pattern, and a running sum of
the lengths of gaps and matches is the place of each match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .rows import content_key, fresh, keep, numbered, pick

# Patterns of the base kinds, in their order. Of a kind with a value, its length decides.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = ["assign", "access", "hex"]
# (kind, pattern, group whose length is tested or 0 for the match, least length). Long runs are
# asked for in the pattern where a shorter one could not have hidden another match.
PATTERNS = [
    ("assign", ASSIGN, 2, 8),
    ("access", r"AKIA[A-Z0-9]{12,}+", 0, 16),
    ("hex", r"[0-9a-f]{32,}+", 0, 32),
    ("weak_id", r"""(?i:client|account|access|user|login|tenant|app)[_-]?(?i:id|name|key_id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]+)""", 1, 3),
    ("weak_secret", r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{24,}+={0,2}", 0, 24),
    ("weak_endpoint", r"""https?://[^\s"'<>]+""", 0, 12),
]
KINDS = [p[0] for p in PATTERNS]
ROLES = {"assign": "secret", "hex": "secret", "weak_secret": "secret", "access": "id", "weak_id": "id", "weak_endpoint": "endpoint"}


def _matches(text: Column, kind: int, pattern: str, group: int) -> Column:
    """All matches of one pattern: which, gap before it, its length, the tested length, mixed letters and digits."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.split(text, pattern, -1)
    found = F.transform(
        F.arrays_zip(F.slice(gaps, F.lit(1), F.size(whole)).alias("g"), whole.alias("m"), value.alias("v")),
        lambda z, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("i"), F.length(z["g"]).alias("gap"), F.length(z["m"]).alias("long"),
            F.length(z["v"]).alias("tested"), (z["m"].rlike("[0-9]") & z["m"].rlike("[A-Za-z]")).alias("mixed"),
        ),
    )
    none = F.array().cast("array<struct<kind:int,i:int,gap:int,long:int,tested:int,mixed:boolean>>")
    return F.when(text.rlike(pattern), found).otherwise(none)


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 256) -> DataFrame:
    """One row per row of ``docs``: doc_id, key (of id and text), found (array of start, kind_no, end, kind).

    ``found`` holds the strong spans and the linked weak ones in order of start, then kind; places
    are code points, the end is exclusive. A NULL text is empty; a NULL id keeps its row; repeated
    rows give repeated results; an empty table gives none. Texts are read once; what goes on is
    the places of matches. Parts of one cell are bounded by the scope, so no pairing explodes.
    """
    text = F.col("text")
    parts = F.concat(*[_matches(text, n, pattern, group) for n, (_, pattern, group, _) in enumerate(PATTERNS)])
    seen = keep(
        numbered(pick(docs, doc_id=id_col, text=text_col))
        .withColumn("key", content_key(F.col("doc_id"), text)).withColumn("text", F.coalesce(text, F.lit("")))
        .select("row", "doc_id", "key", parts.alias("parts"))
    )
    least = F.get(F.array(*[F.lit(p[3]) for p in PATTERNS]), F.col("kind"))
    along = Window.partitionBy("row", "kind").orderBy("i")
    placed = keep(
        seen.where(F.size("parts") > 0).select("row", F.explode("parts").alias("p")).select("row", "p.*")
        .withColumn("end", F.sum(F.col("gap") + F.col("long")).over(along).cast("int"))
        .withColumn("start", F.col("end") - F.col("long"))
        .where((F.col("tested") >= least) & ((F.col("kind") != KINDS.index("weak_secret")) | F.col("mixed")))
        .select("row", "kind", "start", "end")
    )
    strong = placed.where(F.col("kind") < len(BASE))
    linked = _linked(placed, scope)
    per_row = strong.union(linked).groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("start", F.col("kind").alias("kind_no"), "end"))).alias("found")
    )
    name = F.array(*[F.lit(k) for k in KINDS])
    found = F.transform(
        F.coalesce("found", F.array().cast("array<struct<start:int,kind_no:int,end:int>>")),
        lambda s: F.struct(s["start"].alias("start"), s["kind_no"].alias("kind_no"), s["end"].alias("end"), F.get(name, s["kind_no"]).alias("kind")),
    )
    return seen.select("row", "doc_id", "key").join(per_row, "row", "left").select("doc_id", "key", found.alias("found"))


def _linked(placed: DataFrame, scope: int) -> DataFrame:
    """The weak parts that meet a complementary part within ``scope`` characters."""
    role = F.get(F.array(*[F.lit(ROLES[k]) for k in KINDS]), F.col("kind"))
    parts = placed.withColumn("role", role).withColumn("weak", F.col("kind") >= len(BASE))
    strong = parts.where("not weak").select("row", F.col("start").alias("s_start"), F.col("end").alias("s_end"))
    first, last = F.floor(F.col("start") / scope), F.floor(F.col("end") / scope)
    place = lambda after, cell: F.struct(F.lit(after).alias("after"), cell.alias("cell"))
    # Whether the other part comes after the secret, and the cell of the other's near edge.
    one = parts.where("role = 'secret'").withColumn(
        "p", F.explode(F.array(place(True, last), place(True, last + 1), place(False, first), place(False, first - 1)))
    ).select("row", "p.*", "kind", "start", "end")
    other = parts.where("role <> 'secret'").withColumn("p", F.explode(F.array(place(True, first), place(False, last)))).select(
        "row", "p.*", F.col("kind").alias("o_kind"), F.col("start").alias("o_start"), F.col("end").alias("o_end")
    )
    gap = F.when(F.col("after"), F.col("o_start") - F.col("end")).otherwise(F.col("start") - F.col("o_end"))
    met = one.join(other, ["row", "after", "cell"]).where((gap >= 0) & (gap <= scope))
    both = met.select("row", F.explode(F.array(
        F.struct("kind", "start", "end"), F.struct(F.col("o_kind").alias("kind"), F.col("o_start").alias("start"), F.col("o_end").alias("end"))
    )).alias("e")).select("row", "e.*").where(F.col("kind") >= len(BASE)).distinct()
    # What a strong span already covers is not reported again.
    return both.join(strong, (both["row"] == strong["row"]) & (F.col("s_start") < F.col("end")) & (F.col("start") < F.col("s_end")), "left_anti")


def joined(found: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def base_only(found: Column) -> Column:
    return F.filter(found, lambda s: s["kind_no"] < len(BASE))


STRIDE = 1024


def _stretch(pieces: Column, a: Column, b: Column) -> Column:
    """Characters a to b (exclusive) of a text held in pieces of ``STRIDE`` characters: no more than these are walked."""
    first = F.floor(a / STRIDE).cast("int")
    last = F.floor((b - 1) / STRIDE).cast("int")
    return F.when(b > a, F.substring(F.array_join(F.slice(pieces, first + 1, last - first + 1), ""), a - first * STRIDE + 1, b - a)).otherwise("")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every reported span replaced by ``mark``; rows and columns stay, clean texts and NULL are untouched.

    Spans that overlap or touch nothing between them share a mark only if they overlap. The work is
    linear in the text and its spans. A NULL id keeps its row, repeated rows are all redacted, an empty
    table gives none.
    """
    key, gaps, end, pieces = fresh(docs, "_key", "_gaps", "_end", "_pieces")
    along = Window.partitionBy("key").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    # Overlapping spans are cut from the furthest end so far.
    each = (
        spans(docs, id_col, text_col).where(F.size("found") > 0).dropDuplicates(["key"])
        .select("key", F.posexplode("found").alias("at", "s")).select("key", "at", "s.start", "s.end")
        .withColumn("from", F.coalesce(F.max("end").over(along), F.lit(0)))
    )
    cuts = each.groupBy("key").agg(
        F.sort_array(F.collect_list(F.when(F.col("start") >= F.col("from"), F.struct(F.col("from").alias("a"), F.col("start").alias("b"))))).alias(gaps),
        F.max("end").alias(end),
    ).withColumnRenamed("key", key)
    text = F.col(text_col)
    whole = docs.withColumn(key, content_key(F.col(id_col), text)).join(cuts, key, "left")
    whole = whole.withColumn(pieces, F.when(F.col(gaps).isNotNull(), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{STRIDE}}}"), F.lit(0))))
    kept = F.transform(gaps, lambda g: F.concat(_stretch(F.col(pieces), g["a"], g["b"]), F.lit(mark)))
    clean = F.concat(F.array_join(kept, ""), _stretch(F.col(pieces), F.col(end), F.length(text)))
    return whole.withColumn(text_col, F.when(F.col(gaps).isNull(), text).otherwise(clean)).select(docs.columns)
