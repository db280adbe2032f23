"""Running a conversion chain over a corpus, and tables of finished runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import markup, packages, tabular, text as txt
from ..functions.sniff import STRIDE_BUDGET, png_dims, sniff, stride_bytes
from ..sources.archives import pack_members, read_members
from .catalog import BY_ID
from .evidence import measure, notes, output_mismatch
from .reading_order import is_visible, line_of
from .traps import clean_notes, merge_notes

FILES = "array<struct<name:string,bytes:bigint,data:binary>>"
NOTES = "map<string,string>"
LOG = (
    "array<struct<step:int,tool_id:string,mode:string,ok:boolean,bytes_in:bigint,bytes_out:bigint,"
    f"magic:string,magic_type:string,notes:{NOTES},error:string>>"
)
# What a step executor leaves behind for the driver loop to pick up.
RESULT = {
    "_content": "binary", "_text": "string", "_files": FILES, "_type": "string",
    "_declared": "string", "_notes": NOTES, "_error": "string", "_bytes_out": "bigint",
}
# The signature a step insists on, and the name it is reported under.
REQUIRED_MAGIC = {
    "pdf-text": "pdf", "pdf-rasterize": "pdf", "docx-text": "zip", "xlsx-csv": "zip", "zip-unpack": "zip",
    "png-decode": "png", "png-resize": "png", "png-quality": "png",
}
GATE_LABEL = {
    "pdf-text": "pdf → text", "pdf-rasterize": "pdf → png", "docx-text": "docx → text", "xlsx-csv": "xlsx → csv",
    "zip-unpack": "zip → files", "png-decode": "png → rgba", "png-resize": "png → png (resize)",
    "png-quality": "png → png (quality)",
}

Step = Callable[[DataFrame, dict], DataFrame]
STEP: dict[str, Step] = {}


def step(tool: str) -> Callable[[Step], Step]:
    """Register an executor: it reads ``content``, ``text``, ``files`` and ``_go``, and sets result columns."""

    def register(fn: Step) -> Step:
        STEP[tool] = fn
        return fn

    return register


def _note(key: str, when: Column, value: str | Column) -> Column:
    return notes((key, when, F.lit(value) if isinstance(value, str) else value))


def _given(df: DataFrame) -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


@step("html-text")
def _html_text(df: DataFrame, params: dict) -> DataFrame:
    return df.withColumn("_text", markup.html_to_text(_given(df)))


@step("html-md")
def _html_md(df: DataFrame, params: dict) -> DataFrame:
    return markup.with_markdown(df.withColumn("_html", _given(df)), "_html", "_text").drop("_html")


@step("md-html")
def _md_html(df: DataFrame, params: dict) -> DataFrame:
    return df.withColumn("_text", markup.markdown_to_html(_given(df)))


@step("text-md")
def _text_md(df: DataFrame, params: dict) -> DataFrame:
    return df.withColumn("_text", txt.text_to_markdown(_given(df)))


@step("csv-md")
def _csv_md(df: DataFrame, params: dict) -> DataFrame:
    table = df.withColumn("_table", tabular.csv_to_markdown(_given(df)))
    return table.withColumns(
        {
            "_text": F.col("_table.md"),
            "_notes": _note("emptyResult", F.col("_table.n_rows") == 0, "the table text holds no rows"),
        }
    ).drop("_table")


@step("summarize")
def _summarize(df: DataFrame, params: dict) -> DataFrame:
    return df.withColumns(
        {
            "_text": txt.lead_summary(_given(df)),
            "_notes": _note("emptyResult", txt.is_blank(_given(df)), "nothing to summarise: the input is blank"),
        }
    )


def _part(name: str) -> Column:
    found = F.filter(F.col("_package.members"), lambda m: m["name"] == name)
    return txt.utf8_text(F.get(found, F.lit(0))["data"])


@step("docx-text")
def _docx_text(df: DataFrame, params: dict) -> DataFrame:
    opened = df.withColumn("_package", read_members(F.when(F.col("_go"), F.col("content")), r"^word/document\.xml$"))
    parsed = opened.withColumn("_word", packages.word_text(_part(packages.WORD_PART)))
    missing = F.concat(
        F.lit("package without a word/document.xml part (first members: "),
        F.array_join(F.slice("_package.names", 1, 6), ", "), F.lit(")"),
    )
    return parsed.withColumns(
        {
            "_text": F.col("_word.text"),
            "_notes": _note("emptyResult", txt.is_blank(F.col("_word.text")) & (F.size("_package.members") > 0), "the word part holds no text"),
            "_error": F.coalesce("_package.error", F.when(F.size("_package.members") == 0, missing)),
        }
    ).drop("_package", "_word")


@step("xlsx-csv")
def _xlsx_csv(df: DataFrame, params: dict) -> DataFrame:
    opened = df.withColumn("_package", read_members(F.when(F.col("_go"), F.col("content")), packages.SHEET_OR_SHARED))
    sheets = F.array_sort(F.filter("_package.names", lambda n: n.rlike(packages.SHEET_PART)))
    chosen = F.when(F.array_contains(sheets, packages.FIRST_SHEET), packages.FIRST_SHEET).otherwise(F.get(sheets, F.lit(0)))
    sheet = F.get(F.filter("_package.members", lambda m: m["name"] == F.col("_sheet")), F.lit(0))["data"]
    empty = F.array().cast("array<string>")
    parsed = (
        opened.withColumn("_sheet", chosen)
        .withColumn("_shared", F.coalesce(packages.shared_strings(_part(packages.SHARED_PART)), empty))
        .withColumn("_rows", packages.sheet_rows(txt.utf8_text(sheet), F.col("_shared")))
        .withColumn("_grid", packages.sheet_csv(F.col("_rows")))
    )
    errors = F.concat(F.col("_grid.errors_found").cast("string"), F.lit(" cell(s) hold an error value"))
    return parsed.withColumns(
        {
            "_text": F.col("_grid.csv"),
            "_notes": notes(
                ("emptyResult", F.col("_grid.n_rows") == 0, F.lit("the sheet part holds no rows")),
                ("cellErrors", F.col("_grid.errors_found") > 0, errors),
            ),
            "_error": F.coalesce(
                "_package.error",
                F.when(F.col("_package.names").isNotNull() & F.col("_sheet").isNull(), "package without a worksheet part"),
            ),
        }
    ).drop("_package", "_sheet", "_shared", "_rows", "_grid")


@step("zip-unpack")
def _zip_unpack(df: DataFrame, params: dict) -> DataFrame:
    opened = df.withColumn("_package", read_members(F.when(F.col("_go"), F.col("content")), ""))
    sized = F.transform(
        "_package.members",
        lambda m: F.struct(m["name"].alias("name"), F.octet_length(m["data"]).cast("bigint").alias("bytes"), m["data"].alias("data")),
    )
    return opened.withColumns({"_files": sized, "_error": F.col("_package.error")}).drop("_package")


def _pack(df: DataFrame, members: Column) -> DataFrame:
    """Archive bytes of ``members``.

    The members are a column of their own, mentioned twice, so that the Python
    step is handed a finished column and not the expression that builds it.
    """
    ready = F.col("_go") & (F.size("_members") > 0)
    built = df.withColumn("_members", members)
    return built.withColumn("_content", pack_members(F.when(ready, F.col("_members")))).drop("_members")


@step("zip-pack")
def _zip_pack(df: DataFrame, params: dict) -> DataFrame:
    single = F.array(F.struct(F.lit("part-1.bin").alias("name"), F.coalesce("content", F.lit(b"")).alias("data")))
    parts = F.transform("files", lambda f: F.struct(f["name"].alias("name"), f["data"].alias("data")))
    members = F.when(F.coalesce(F.size("files"), F.lit(0)) > 0, parts).otherwise(single)
    return _pack(df, members)


@step("text-docx")
def _text_docx(df: DataFrame, params: dict) -> DataFrame:
    return _pack(df, packages.word_members(_given(df)))


@step("csv-xlsx")
def _csv_xlsx(df: DataFrame, params: dict) -> DataFrame:
    grid = df.withColumn("_grid", tabular.parse_csv(_given(df)))
    return _pack(grid, packages.sheet_members(F.col("_grid"))).drop("_grid")


@step("pdf-text")
def _pdf_text(df: DataFrame, params: dict) -> DataFrame:
    """Text of placed runs, for documents that carry them as ``runs`` next to their bytes."""
    if "runs" not in df.columns:
        return df.withColumn("_error", F.lit("no executor for pdf-text without placed runs"))

    def placed(r: Column) -> Column:
        return F.struct(r["page"].alias("page"), line_of(r["y"]).alias("line"), r["x"].alias("x"), r["seq"].alias("seq"), r["text"].alias("text"))

    def streamed(r: Column) -> Column:
        return F.struct(r["page"].alias("page"), r["seq"].alias("seq"), r["text"].alias("text"))

    def texts(column: str) -> Column:
        return F.transform(column, lambda r: r["text"])

    ordered = df.withColumns(
        {
            "_visual": F.array_sort(F.transform("runs", placed)),
            "_stream": F.array_sort(F.transform("runs", streamed)),
            "_inked": F.exists("runs", lambda r: (F.trim(r["text"]) != "") & is_visible(r["x"], r["y"])),
        }
    )
    found = F.coalesce(F.size("_visual"), F.lit(0))
    unseen = F.concat(found.cast("string"), F.lit(" text run(s), none of them visible on a page"))
    return ordered.withColumns(
        {
            "_text": F.coalesce(F.array_join(texts("_visual"), "\n"), F.lit("")),
            "_notes": notes(
                ("emptyResult", found == 0, F.lit("the document carries no text runs")),
                ("inkParadox", (found > 0) & ~F.col("_inked"), unseen),
                ("orderDiffers", texts("_visual") != texts("_stream"), F.lit("stored order is not the order on the page")),
            ),
        }
    ).drop("_visual", "_stream", "_inked")


@step("png-decode")
def _png_decode(df: DataFrame, params: dict) -> DataFrame:
    """Header only: the pixel buffer is sized, never allocated."""
    sized = df.withColumn("_stride", stride_bytes(png_dims(F.col("content"))))
    warning = F.concat(
        F.lit("decoding needs "), F.col("_stride").cast("string"), F.lit(" bytes for a file of "),
        F.octet_length("content").cast("string"),
    )
    return sized.withColumns(
        {
            "_bytes_out": F.col("_stride"),
            "_notes": _note("strideWarn", F.col("_stride") > STRIDE_BUDGET, warning),
        }
    ).drop("_stride")


# ------------------------------------------------------------------- the run


def _run_step(df: DataFrame, number: int, tool: str, params: dict) -> DataFrame:
    definition = BY_ID.get(tool)
    alive = F.col("ok")
    content = F.col("content")
    bytes_in = F.coalesce(F.octet_length("content"), F.octet_length("text"), F.lit(0)).cast("bigint")

    wants = REQUIRED_MAGIC.get(tool)
    seen = sniff(F.coalesce(content, F.lit(b"")))
    df = df.withColumn("_seen", seen if wants else F.lit(None).cast("struct<type:string,magic:string,confident:boolean>"))
    passed = F.col("_seen.type") == wants if wants else F.lit(True)
    df = df.withColumn("_go", alive & passed)

    df = df.withColumns({c: F.lit(None).cast(t) for c, t in RESULT.items()})
    if definition is None:
        df = df.withColumn("_error", F.lit("unknown transform"))
    elif tool in STEP:
        df = STEP[tool](df, params)
    else:
        df = df.withColumn("_error", F.lit(f"no executor for {tool}"))

    empty = F.expr(f"cast(map() as {NOTES})")
    if wants:
        refused = F.concat(F.lit(f"{GATE_LABEL[tool]} wants {wants.upper()}, found "), F.col("_seen.magic"))
        declared = F.coalesce("declared_type", "type", F.lit(wants))
        mismatch = F.concat(F.lit("declared "), declared, F.lit(', signature "'), F.col("_seen.magic"), F.lit('"'))
        df = df.withColumn("_error", F.when(~passed, refused).otherwise(F.col("_error"))).withColumn(
            "_notes",
            F.when(~passed, F.create_map(F.lit("magicMismatch"), mismatch)).otherwise(F.coalesce("_notes", empty)),
        )

    produced = definition.out_type if definition else None
    df = df.withColumn("_type", F.coalesce("_type", F.lit(produced)))
    # The partition id keeps the optimizer from pushing a later filter through the
    # steps, which would paste every step's expressions into the filter.
    df = df.withColumn("_good", alive & F.col("_error").isNull() & (F.spark_partition_id() >= 0))
    good = F.col("_good")
    wrong = output_mismatch(F.col("_content"), F.col("_type"))
    fresh = F.when(wrong.isNotNull() & good, F.create_map(F.lit("magicMismatch"), wrong)).otherwise(empty)
    checked = merge_notes(fresh, F.coalesce("_notes", empty))
    df = df.withColumn("_notes", checked).withColumn("_magic", F.when(good & F.col("_content").isNotNull(), sniff(F.col("_content"))))

    size_out = F.coalesce(
        F.octet_length("_content").cast("bigint"), F.octet_length("_text").cast("bigint"), F.col("_bytes_out"),
        F.aggregate("_files", F.lit(0).cast("bigint"), lambda a, f: a + f["bytes"]), F.lit(0).cast("bigint"),
    )
    record = F.struct(
        F.lit(number).alias("step"), F.lit(tool).alias("tool_id"),
        F.lit(definition.mode if definition else None).cast("string").alias("mode"), good.alias("ok"),
        F.when(good, bytes_in).alias("bytes_in"), F.when(good, size_out).alias("bytes_out"),
        F.col("_magic.magic").alias("magic"), F.col("_magic.type").alias("magic_type"),
        F.col("_notes").alias("notes"), F.col("_error").alias("error"),
    )

    def kept(new: str, old: str) -> Column:
        return F.when(F.col("_good"), F.col(new)).otherwise(F.col(old))

    return (
        df.withColumn("log", F.when(alive, F.array_append("log", record)).otherwise(F.col("log")))
        .withColumn("notes", F.when(alive, merge_notes(F.col("notes"), F.col("_notes"))).otherwise(F.col("notes")))
        .withColumn("declared_type", F.when(F.col("_good"), F.coalesce("_declared", "_type")).otherwise(F.col("declared_type")))
        .withColumns({c: kept(f"_{c}", c) for c in ("content", "text", "files", "type")})
        .withColumn("ok", F.col("_good"))
        .drop("_seen", "_go", "_good", "_magic", *RESULT)
    )


def run_chain(docs: DataFrame, steps: list[str | tuple[str, dict]], input_type: str | None = None) -> DataFrame:
    """Apply the steps to every document, stopping per document at its first failure.

    ``docs`` carries ``content``, ``text``, ``type`` and optionally ``files``. The
    result keeps the last good state (after a failure that is the failing step's
    input), the merged ``notes`` and the step ``log``. Every step is a projection,
    so the whole chain is one pass over the corpus without a shuffle.
    """
    start = {
        "declared_type": F.coalesce(F.lit(input_type), F.col("type")),
        "ok": F.lit(True),
        "notes": F.expr(f"cast(map() as {NOTES})"),
        "log": F.expr(f"cast(array() as {LOG})"),
    }
    if "files" not in docs.columns:
        start["files"] = F.lit(None).cast(FILES)
    df = docs.withColumns(start)
    for number, spec in enumerate(steps, start=1):
        tool, params = (spec, {}) if isinstance(spec, str) else spec
        df = _run_step(df, number, tool, params)
    return df.withColumn("ok", F.col("ok") & (F.size("log") == len(steps)))


def step_log(results: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per executed step."""
    return results.select(key, F.explode_outer("log").alias("r")).select(key, "r.*")


def run_evidence(results: DataFrame) -> DataFrame:
    """Add ``claimed`` and ``measured``.

    Claims are the notes of the run, overridden by the caller's own where a ``claims`` map is
    given. What the artifact bytes prove is measured for every artifact that has bytes.
    """
    said = F.col("notes")
    if "claims" in results.columns:
        said = merge_notes(said, F.coalesce("claims", F.expr(f"cast(map() as {NOTES})")))
    proved = measure(F.col("content"), F.coalesce("declared_type", "type"))
    return results.withColumns(
        {"claimed": clean_notes(said), "measured": F.coalesce(proved, F.expr(f"cast(map() as {NOTES})"))}
    )


# ------------------------------------------------------------ tables of runs


def fail_stop(log: DataFrame, key: str = "run_id") -> DataFrame:
    """Drop the steps after each run's first failure; the failed step itself stays.

    Only the position of the first failure per run is aggregated; the join back
    touches the failing runs.
    """
    first = log.filter(~F.col("ok")).groupBy(key).agg(F.min("step").alias("_stop"))
    return log.join(first, key, "left").filter(F.col("_stop").isNull() | (F.col("step") <= F.col("_stop"))).drop("_stop")


def run_success(log: DataFrame, expected: DataFrame, key: str = "run_id") -> DataFrame:
    """A run succeeds when no step failed and every expected step was recorded."""
    seen = log.groupBy(key).agg(F.bool_and("ok").alias("_all_ok"), F.count(F.lit(1)).alias("n_recorded"))
    return expected.join(seen, key, "left").withColumn(
        "ok", F.coalesce(F.col("_all_ok") & (F.col("n_recorded") == F.col("n_steps")), F.lit(False))
    ).drop("_all_ok")


def accumulate_notes(noted: DataFrame, key: str = "run_id") -> DataFrame:
    """Last writer wins per run and note key; input and output are long ``(key, step, note, note_value)`` rows.

    Ties on the step fall to the greater value, so the result does not depend on
    the order rows arrive in.
    """
    return noted.filter("note is not null").groupBy(key, "note").agg(
        F.max_by("note_value", F.struct("step", "note_value")).alias("note_value"), F.max("step").alias("step")
    )


def latest_per_chain(runs: DataFrame, key: str = "chain_id") -> DataFrame:
    """The newest run of every chain (run id breaks ties)."""
    rest = [c for c in runs.columns if c != key]
    newest = F.max_by(F.struct(*rest), F.struct("at", "run_id"))
    return runs.groupBy(key).agg(newest.alias("_r")).select(key, "_r.*")


def history(runs: DataFrame, limit: int = 5) -> DataFrame:
    """The newest runs first; ``limit`` rows of them."""
    if limit < 1:
        raise ValueError("limit must be at least 1")
    return runs.orderBy(F.col("at").desc(), F.col("run_id").desc()).limit(limit)


def retain(runs: DataFrame, keep: int = 60, key: str = "chain_id") -> DataFrame:
    """The newest ``keep`` runs of every history; the rank limit is applied before the shuffle too."""
    newest = Window.partitionBy(key).orderBy(F.col("at").desc(), F.col("run_id").desc())
    return runs.withColumn("recency", F.row_number().over(newest)).filter(F.col("recency") <= keep)


def append_runs(runs: DataFrame, path: str) -> None:
    """Run-history sink."""
    runs.write.mode("append").parquet(path)


def verdict_diff(both: DataFrame, key: str = "chain_id") -> DataFrame:
    """Hits that appeared and went between ``before`` and ``after``, two verdicts (hits, score) in one row."""

    def ids(side: str) -> Column:
        return F.transform(F.col(f"{side}.hits"), lambda h: F.concat_ws(":", h["trap_id"], h["basis"]))

    return both.select(
        key,
        F.array_except(ids("after"), ids("before")).alias("appeared"),
        F.array_except(ids("before"), ids("after")).alias("resolved"),
        (F.col("after.score") - F.col("before.score")).alias("score_delta"),
    )


def with_previous(rows: DataFrame, key: str, order: tuple[str, ...], values: tuple[str, ...], band: Column, out: str = "previous") -> DataFrame:
    """Add ``out``, a struct of ``values`` of the row before in the order of its ``key``; NULL for the first one.

    ``band`` is a coarse prefix of the order, such as a month. Inside a band the row before is looked up
    in a window over the band; a band hands its last row to the next one that has rows. So a key that holds
    a third of all rows is spread over its bands. ``order`` must tell the rows of a key apart. Rows of a
    NULL key or NULL band follow each other like those of any other.
    """
    rest = F.struct(*values)
    banded = rows.withColumn("_band", band)
    inside = Window.partitionBy(key, "_band").orderBy(*order)
    last = banded.groupBy(F.col(key).alias("_k"), F.col("_band").alias("_b")).agg(F.max_by(rest, F.struct(*order)).alias("_last"))
    handed = last.withColumn("_handed", F.lag("_last").over(Window.partitionBy("_k").orderBy("_b"))).drop("_last")
    placed = banded.withColumns({"_own": F.lag(rest).over(inside), "_first": F.row_number().over(inside) == 1})
    met = placed.join(handed, F.col(key).eqNullSafe(F.col("_k")) & F.col("_band").eqNullSafe(F.col("_b")))
    return met.select(*rows.columns, F.when(F.col("_first"), F.col("_handed")).otherwise(F.col("_own")).alias(out))


def changes_by_run(verdicts: DataFrame, band: Column, key: str = "chain_id") -> DataFrame:
    """What each run changed: verdicts (chain_id, run_id, at, hits as strings, score) against the run before.

    Gives (chain_id, run_id, previous_run, appeared, resolved, score_delta); of a first run all hits appear
    and the delta is NULL.
    """
    paired = with_previous(verdicts, key, ("at", "run_id"), ("run_id", "hits", "score"), band)
    before = F.coalesce("previous.hits", F.array().cast("array<string>"))
    return paired.select(
        key, "run_id", F.col("previous.run_id").alias("previous_run"), F.array_except("hits", before).alias("appeared"),
        F.array_except(before, F.col("hits")).alias("resolved"), (F.col("score") - F.col("previous.score")).alias("score_delta"),
    )


def step_records(steps: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """Chain steps next to what their last run recorded at the same position (1-based in the log)."""
    recorded = log.select(key, (F.col("step") - 1).alias("idx"), "ok", "note")
    return steps.join(recorded, [key, "idx"], "left")
