"""Known verdicts, validations, routes, proposals and error envelopes."""

import pytest
from pyspark.sql import functions as F

from platen.functions.sniff import sniff
from platen.operators import catalog, definitions, evidence, intake, routing, traps, validate

PNG = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (120).to_bytes(4, "big") + (90).to_bytes(4, "big")
STEPS = "array<struct<tool_id:string,params:map<string,string>>>"
CHAIN = f"chain_id int, steps {STEPS}, input_type string, output_type string"


def chain(spark, steps, source=None, goal=None, **extra):
    spec = [(s, {}) if isinstance(s, str) else s for s in steps]
    df = spark.createDataFrame([(1, spec, source, goal)], CHAIN)
    for name, notes in extra.items():
        entries = [x for kv in notes.items() for x in (F.lit(kv[0]), F.lit(kv[1]))]
        df = df.withColumn(name, F.create_map(*entries) if entries else F.expr("cast(map() as map<string,string>)"))
    return df


def verdict(df, mode="clamp"):
    row = traps.score_chains(df, mode).first()
    return row.score, {h.trap_id: h.basis for h in row.hits}, row


@pytest.mark.parametrize(
    "steps,source,goal,notes,score,hits",
    [
        (["pdf-rasterize", "ocr", "png-tables"], "scan", "csv-of-tables", {}, 10, {"T01": "plan", "T09": "plan", "T12": "plan"}),
        (["docx-text", "text-md"], "docx", "md", {}, 100, {}),
        (["docx-text", "text-md"], "docx", "md", {"claimed": {"magicMismatch": "true"}}, 70, {"T13": "claimed"}),
        (["rename-avif"], "png", "png", {}, 70, {"T02": "plan", "T03": "plan"}),
        (["pdf-rasterize", "ocr"], "pdf", "txt", {}, 70, {"T01": "plan"}),
        (["pdf-text"], "pdf", "txt", {"measured": {"magicMismatch": "x"}}, 70, {"T13": "measured"}),
        ([("docx-pdf-soffice", {"empty": "true"})], "docx", "pdf", {"measured": {"emptyOutput": "x"}}, 70, {"T04": "plan"}),
        ([("png-resize", {"w": "8000", "h": "3000"})], "png", "png", {}, 85, {"T08": "plan"}),
        ([("png-resize", {"w": "wide", "h": "3000"})], "png", "png", {}, 100, {}),
        ([("text-pdf", {"font": " Helvetica "})], "txt", "pdf", {}, 100, {}),
        ([("text-pdf", {"font": "Latin Modern"})], "txt", "pdf", {}, 85, {"T10": "plan"}),
        (["ocr", "pdf-rasterize"], "png", "csv", {}, 85, {"T14": "plan"}),
        (["ocr"], "png", "csv", {"claimed": {"emptyResult": "true"}}, 70, {"T09": "claimed"}),
        (["not-a-tool"], None, None, {}, 70, {"T12": "plan"}),
    ],
)
def test_known_verdicts(spark, steps, source, goal, notes, score, hits):
    got_score, got_hits, row = verdict(chain(spark, steps, source, goal, **notes))
    assert (got_score, got_hits) == (score, hits)
    assert row.penalty == sum(h.weight for h in row.hits)
    assert row.stars == int(got_score / 10 + 0.5) / 2


def test_raw_mode_goes_below_zero(spark):
    every = {k: "true" for k in set(traps.NOTE_KEYS.values())}
    df = chain(spark, ["office-text", ("text-pdf", {"font": "x", "quality": "1"})], "scan", "pdf", claimed=every)
    clamped, raw = verdict(df)[0], verdict(df, "raw")[0]
    assert clamped == 0 and raw < 0


def test_array_and_long_form_agree_on_order(spark):
    rows = [(1, 0, "ocr"), (1, 1, "pdf-rasterize"), (2, 0, "pdf-rasterize"), (2, 1, "docx-text"), (2, 2, "ocr")]
    long = spark.createDataFrame(rows, "chain_id int, idx int, tool_id string").withColumn(
        "params", F.expr("cast(map() as map<string,string>)")
    )
    got = {r.chain_id: [h.trap_id for h in r.hits] for r in traps.score_steps(long).collect()}
    assert "T01" not in got[1] and "T01" in got[2]


def test_measured_basis_only_where_bytes_can_prove_it(spark):
    for content, declared in [(b"", "pdf"), (PNG, "pdf")]:
        df = spark.createDataFrame([(content, declared)], "content binary, declared_type string")
        row = evidence.with_measurement(df).first()
        assert set(row.measured) <= {"emptyOutput", "magicMismatch"} and row.measured
    row = evidence.with_measurement(spark.createDataFrame([(PNG, "PNG")], "content binary, declared_type string")).first()
    assert row.measured == {}


def test_large_artifact_is_measured(spark):
    df = spark.range(1).select(F.expr("cast(repeat('x', 900000) as binary)").alias("content"), F.lit("png").alias("declared_type"))
    row = evidence.with_measurement(df).first()
    assert row.seen.type == "text" and set(row.measured) == {"magicMismatch"}


def test_success_flags_are_audited(spark):
    rows = [(True, b"", "pdf", 0), (True, PNG, "pdf", 2), (False, b"", "pdf", 2), (None, PNG, "pdf", 1), (True, PNG, "png", None)]
    df = spark.createDataFrame(rows, "success boolean, content binary, declared_type string, errors_found int")
    got = [set(r.notes) for r in evidence.success_audit(df).collect()]
    assert got == [{"emptyOutput"}, {"magicMismatch", "cellErrors"}, set(), set(), set()]


def test_types_of_the_caller_win(spark):
    raw = ['[{"toolId":"my-reader","in":"pdf","out":"txt"}]', '["ocr",{"toolId":"my-tables","in":"txt","out":"csv-of-tables"}]', '["my-reader"]']
    parsed = definitions.normalise_steps(spark.createDataFrame(list(enumerate(raw)), "id int, raw string"))
    none = F.lit(None).cast("string")
    rows = traps.score_chains(parsed.withColumns({"input_type": none, "output_type": none})).orderBy("id").collect()
    assert [(r.score, [h.trap_id for h in r.hits]) for r in rows] == [(100, []), (70, ["T09"]), (70, ["T12"])]
    assert rows[1].hits[0].lesson
    long = parsed.select("id", F.posexplode("steps").alias("idx", "s")).select("id", "idx", "s.*")
    assert [r.score for r in traps.score_steps(long, key="id").orderBy("id").collect()] == [100, 70, 70]


def check(spark, steps, source, goal):
    return validate.validate_chains(chain(spark, steps, source, goal)).first()


def test_missing_connector_names_the_fix(spark):
    row = check(spark, ["pdf-rasterize", "pdf-text", "summarize"], "pdf", "txt")
    assert not row.ok and row.errors[0].kind == "missing-connector" and row.errors[0].fix == "put ocr → … before step 2" and row.errors[0].bridge == "ocr → …"
    assert [w.kind for w in row.warnings] == ["simulated"]
    row = check(spark, ["text-md", "text-docx"], "txt", "docx")
    assert row.errors[0].fix == "put md-html → … before step 2"


def test_sound_chain_and_warnings(spark):
    row = check(spark, ["pdf-text", "summarize"], "pdf", "txt")
    assert row.ok and row.chain == ["pdf", "txt", "txt"] and row.ends_at == "txt"


def test_unknown_and_empty(spark):
    assert check(spark, ["not-a-real-transform"], "txt", "txt").errors[0].kind == "unknown-tool"
    assert [e.kind for e in check(spark, [], "txt", "md").errors] == ["empty", "goal-mismatch"]


def test_routes(spark):
    pairs = [("docx", "md"), ("png", "xlsx"), ("txt", "txt"), ("csv", "html")]
    requests = spark.createDataFrame(pairs, "from_type string, to_type string")
    got = {(r.from_type, r.to_type): r for r in routing.plan_routes(requests, catalog.routes(spark)).collect()}
    assert got["docx", "md"].steps == ["docx-text", "text-md"] and got["docx", "md"].types == ["docx", "txt", "md"]
    assert not got["png", "xlsx"].found and got["txt", "txt"].steps == []
    assert got["csv", "html"].steps == ["csv-md", "md-html"]


def test_proposals(spark):
    goals = spark.createDataFrame([("summarize the scanned pdf",), ("get the tables out of a spreadsheet as csv",)], "goal string")
    rows = traps.score_chains(routing.propose_chains(goals)).collect()
    gaps = {r.goal: r.self_score - r.score for r in rows}
    assert gaps["summarize the scanned pdf"] == 83 and gaps["get the tables out of a spreadsheet as csv"] <= 8


def test_unmatched_goals_follow_the_given_types(spark):
    rows = [("x", "docx", "md"), ("x", None, None), ("x", "pdf", "csv"), ("make the worst", "docx", "md")]
    got = routing.propose_chains(spark.createDataFrame(rows, "goal string, input_type string, output_type string")).collect()
    assert [[s.tool_id for s in r.steps] for r in got] == [
        ["docx-text", "text-md"], ["pdf-text", "summarize"], ["xlsx-csv"], ["pdf-rasterize", "ocr", "png-tables"]
    ]
    assert (got[2].input_type, got[3].input_type) == ("pdf", "scan")


def test_catalogue_size():
    assert len(catalog.TRANSFORMS) == 26 and sum(t.mode == "real" for t in catalog.TRANSFORMS) == 19
    assert len(catalog.TRAPS) == 15 and set(traps.PLAN) == {t.id for t in catalog.TRAPS}


def test_step_list_errors(spark):
    raw = ['"pdf-text"', "[null]", "[]", '["Bad Id!"]', '[{"toolId":"ocr","params":[1]}]', '["pdf-text"]', None]
    rows = definitions.normalise_steps(spark.createDataFrame([(r,) for r in raw], "raw string")).collect()
    assert [r.error.code if r.error else None for r in rows] == ["invalid_param"] * 5 + [None, "invalid_param"]
    assert rows[5].steps[0].in_type == "pdf" and rows[0].steps is None


def test_upload_errors_in_order(spark):
    rows = [
        ("x", None, None, None), ("x", "%%%not-base64%%%", None, None), ("bad name!", None, "hi", None),
        ("x", None, "", None), ("x", None, "hi", "martian"), ("py-text", None, "Uploaded text", None), ("z", "UEsDBA==", None, "pdf"),
    ]
    got = intake.check_uploads(spark.createDataFrame(rows, "name string, b64 string, text string, type string")).collect()
    assert [g.error.code if g.error else None for g in got] == ["invalid_param"] * 5 + [None, None]
    assert got[5].declared_type == "txt" and got[5].mismatch is False
    assert got[6].sniffed.type == "zip" and got[6].mismatch is True


def test_history_limit(spark):
    df = spark.createDataFrame([("0",), ("61",), ("2.5",), ("5",), (None,)], "n string")
    codes = [r[0] for r in df.select(definitions.check_history_limit(F.col("n"), 60)["code"]).collect()]
    assert codes == ["invalid_param"] * 3 + [None, None]
    codes = [r[0] for r in df.select(definitions.check_history_limit(F.col("n"))["code"]).collect()]
    assert codes == ["invalid_param", None, "invalid_param", None, None]


@pytest.mark.parametrize(
    "content,kind",
    [
        (PNG, "png"), (b"PK\x03\x04x", "zip"), (b"PKPK", "zip"), (b"PK\x05\x06" + b"\0" * 18, "unknown"), (b"%PDF-1.7", "pdf"),
        (b"\xff\xd8\xff\xe0", "jpeg"), (b"GIF89a", "gif"), (b"\0\0\0\x20ftypavif", "avif"), (b"\xa0 <!DocType html>", "xml-or-html"),
        (b"plain text\n", "text"), (b"", "unknown"), (bytes(range(128, 256)), "unknown"),
    ],
)
def test_sniff(spark, content, kind):
    df = spark.createDataFrame([(bytearray(content),)], "c binary")
    assert df.select(sniff(F.col("c"))["type"]).first()[0] == kind


def test_sniff_empty_archive_option(spark):
    df = spark.createDataFrame([(bytearray(b"PK\x05\x06" + b"\0" * 18),)], "c binary")
    assert df.select(sniff(F.col("c"), detect_empty_archive=True)["type"]).first()[0] == "zip"


def test_exposure_keeps_listed_patterns(spark):
    steps = spark.createDataFrame([(1, 0, "ocr"), (1, 1, "nothing")], "chain_id int, idx int, tool_id string")
    rows = definitions.trap_exposure(steps, catalog.transforms(spark), catalog.traps(spark)).collect()
    assert sorted(r.trap_id for r in rows) == ["T01", "T09"]


def test_edits(spark):
    df = chain(spark, ["pdf-text", "summarize"], "pdf", "txt")
    front = df.withColumn("steps", definitions.insert_step(F.col("steps"), F.lit("pdf-rasterize"), F.lit(0)))
    assert [s.tool_id for s in front.first().steps] == ["pdf-rasterize", "pdf-text", "summarize"]
    far = df.withColumn("steps", definitions.insert_step(F.col("steps"), F.lit("text-md"), F.lit(99)))
    row = definitions.follow_last_step(far).first()
    assert row.steps[-1].tool_id == "text-md" and row.output_type == "md"
    gone = front.withColumn("steps", definitions.remove_step(F.col("steps"), F.lit(0)))
    assert validate.validate_chains(gone).first().ok
