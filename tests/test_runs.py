"""Corpus runs, run tables, the event feed and skewed inputs."""

import random

from pyspark.sql import functions as F

from platen.operators import intake, reading_order, runs, traps
from platen.session import shared_folder
from platen.sources import views
from platen.streaming import step_events

PNG = b"\x89PNG\r\n\x1a\n"


def text_docs(spark, *texts):
    df = spark.createDataFrame([(i, "txt", t) for i, t in enumerate(texts)], "doc_id int, type string, text string")
    return df.withColumn("content", F.encode("text", "UTF-8"))


def test_failure_stops_one_document_only(spark):
    given = text_docs(spark, "<p>a</p>", "")
    rows = {r.doc_id: r for r in runs.run_chain(given, ["summarize", "nope", "text-md"], "txt").collect()}
    for r in rows.values():
        assert not r.ok and [s.ok for s in r.log] == [True, False] and r.log[1].error == "unknown transform"
    assert rows[1].notes == {"emptyResult": "nothing to summarise: the input is blank"}
    assert rows[0].text == "<p>a</p>\n"


def test_failed_run_keeps_the_failing_steps_input(spark):
    docs = spark.createDataFrame([(1, "pdf", bytearray(PNG))], "doc_id int, declared_type string, content binary")
    result = runs.run_evidence(runs.run_chain(intake.load_documents(docs), ["pdf-text"], "pdf"))
    row = result.first()
    assert not row.ok and "magicMismatch" in row.claimed and "magicMismatch" in row.measured


def test_caller_claims_override_run_notes(spark):
    big = bytearray(PNG + b"x" * 400_000)
    docs = spark.createDataFrame([(1, "pdf", big)], "doc_id int, declared_type string, content binary")
    done = runs.run_chain(intake.load_documents(docs), ["pdf-text"])
    given = F.create_map(F.lit("magicMismatch"), F.lit("mine"), F.lit("cellErrors"), F.lit("2"), F.lit("off"), F.lit("false"))
    row = runs.run_evidence(done.withColumn("claims", given)).first()
    assert row.claimed == {"magicMismatch": "mine", "cellErrors": "2"} and set(row.measured) == {"magicMismatch"}


def test_simulated_steps_have_no_executor(spark):
    for tool in ("rename-avif", "xlsx-recalc", "office-text", "png-tables", "ocr"):
        row = runs.run_chain(text_docs(spark, "x"), [tool], "txt").first()
        assert not row.ok and row.log[0].error == f"no executor for {tool}"


def test_long_chain_plans_quickly_and_filters(spark):
    result = runs.run_chain(text_docs(spark, "# T\n\nbody *x*"), ["md-html", "html-md", "text-docx", "docx-text", "text-md"], "txt")
    assert result.filter("ok").count() == 1
    assert [r.ok for r in runs.step_log(result).orderBy("step").collect()] == [True] * 5


def test_stride_warning_and_recalc(spark):
    header = PNG + b"\0\0\0\rIHDR" + (9000).to_bytes(4, "big") + (9000).to_bytes(4, "big")
    docs = spark.createDataFrame([(1, "png", bytearray(header))], "doc_id int, declared_type string, content binary")
    row = runs.run_chain(intake.load_documents(docs), ["png-decode"], "png").first()
    assert row.log[0].bytes_out == 9000 * 9000 * 4 and "strideWarn" in row.notes


def test_clean_notes(spark):
    df = spark.range(1).select(
        F.create_map(F.lit("a" * 50), F.lit("v" * 200), F.lit("off"), F.lit("false"), F.lit("e"), F.lit(""), F.lit("a" * 41), F.lit("later")).alias("n")
    )
    assert df.select(traps.clean_notes(F.col("n"))).first()[0] == {"a" * 50: "v" * 200, "a" * 41: "later"}


def test_upsert_keeps_the_latest(spark):
    rows = [("a", 1, "old"), ("a", 3, "new"), ("b", 2, "only"), ("a", 2, "mid")]
    got = intake.latest_by_name(spark.createDataFrame(rows, "name string, seq int, body string")).collect()
    assert {r.name: r.body for r in got} == {"a": "new", "b": "only"}


def test_files_are_scanned_with_their_names(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿hé\n".encode())
    (tmp_path / "b.PNG").write_bytes(PNG)
    (tmp_path / "c").write_bytes(b"<html>")
    rows = {r.name: r for r in intake.load_documents(intake.scan_files(spark, str(tmp_path))).collect()}
    assert rows["a.txt"].text == "hé\n" and rows["b.PNG"].type == "png" and rows["c"].type == "html"


# ------------------------------------------------------------------ reading order


def brute_order(rows):
    pages = {}
    for doc, page, seq, x, y, text in rows:
        pages.setdefault((doc, page), []).append((seq, x, y, text))
    out = {}
    for key, runs_ in pages.items():
        visual = sorted(runs_, key=lambda r: (-int(r[2] // 1 if r[2] % 1 < 0.5 else r[2] // 1 + 1), r[1], r[0]))
        out[key] = ([r[3] for r in visual], [r[3] for r in sorted(runs_)])
    return out


def test_reading_order_on_a_hot_page(spark):
    """One page holds most runs; positions must match a plain sort."""
    rng = random.Random(7)
    rows = []
    for seq in range(4000):
        doc = 1 if seq % 3 else 2 + seq % 40
        rows.append((doc, 1, seq, float(rng.randrange(0, 600)), rng.randrange(0, 1584) / 2, f"t{rng.randrange(50)}"))
    df = spark.createDataFrame(rows, "doc_id int, page int, seq int, x double, y double, text string")
    want = brute_order(rows)
    got = {(r.doc_id, r.page): r.text.split("\n") for r in reading_order.page_text(reading_order.reading_positions(df)).collect()}
    assert got == {k: v[0] for k, v in want.items()}
    flags = {(r.doc_id, r.page): r.order_differs for r in reading_order.order_differs(df).collect()}
    assert flags == {k: v[0] != v[1] for k, v in want.items()}


def test_runs_without_coordinates_stay(spark):
    rows = [(1, 1, 0, None, 700.0, "a"), (1, 1, 1, 10.0, None, "b"), (1, 1, 2, 10.0, 700.0, "c"), (None, 1, 0, 1.0, 1.0, "d"), (1, 1, None, 5.0, 700.0, "e")]
    df = spark.createDataFrame(rows, "doc_id int, page int, seq int, x double, y double, text string")
    got = {r.text: r.visual_pos for r in reading_order.reading_positions(df).collect()}
    assert got == {"e": 0, "c": 1, "a": 2, "b": 3, "d": 0}
    assert sorted(r.stream_pos for r in reading_order.stream_positions(df).collect()) == [0, 0, 1, 2, 3]
    assert reading_order.order_differs(df).count() == 2


def test_hidden_text_is_found(spark):
    df = spark.createDataFrame([(1, 1, 0, 4800.0, 4600.0, "hidden"), (2, 1, 0, 54.0, 700.0, "seen")], "doc_id int, page int, seq int, x double, y double, text string")
    got = {r.doc_id: r.ink_paradox for r in reading_order.off_page_audit(df).collect()}
    assert got == {1: True, 2: False}


# ------------------------------------------------------------------------- skew


def test_hot_chain_is_judged_from_partial_aggregates(spark):
    """A third of all steps in one chain: same facts, no collected list in the plan."""
    hot = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("chain_id"), F.col("id").alias("idx"),
        F.when(F.col("id") == 29_997, "ocr").when(F.col("id") == 3, "pdf-rasterize").otherwise("text-md").alias("tool_id"),
        F.expr("cast(map() as map<string,string>)").alias("params"),
    )
    scored = traps.score_steps(hot)
    row = scored.filter("chain_id = 0").first()
    assert row.n_steps == 10_000 and [h.trap_id for h in row.hits] == ["T01", "T03", "T15"]
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "SortAggregate" not in plan and "partial_" in plan


def test_retention_limits_before_the_shuffle(spark, sf_dir):
    plan = runs.retain(views.runs(spark, sf_dir), 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_scoring_reads_only_the_needed_columns(spark, sf_dir):
    plan = traps.score_steps(views.steps(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,event_type:string,value:double>" in plan
    assert plan.count("Exchange hashpartitioning") == 1


def test_one_scan_where_one_is_enough(spark, sf_dir):
    from platen.plans import QUERIES

    for name, scans in (("trap_scores", 1), ("score_gap_by_origin", 1), ("verdict_changes", 1), ("step_list_parsing", 1), ("silent_empties", 1)):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet") == scans, name
        assert plan.count("Exchange ") <= 3, name


def test_run_tables(spark):
    log = spark.createDataFrame(
        [(1, 1, True, "a", "x"), (1, 2, False, "a", "y"), (1, 3, True, None, None), (2, 1, True, "b", "z")],
        "run_id int, step int, ok boolean, note string, note_value string",
    )
    kept = runs.fail_stop(log).collect()
    assert sorted((r.run_id, r.step) for r in kept) == [(1, 1), (1, 2), (2, 1)]
    expected = spark.createDataFrame([(1, 3), (2, 1), (3, 1), (2, 2)], "run_id int, n_steps int")
    ok = {(r.run_id, r.n_steps): r.ok for r in runs.run_success(log, expected).collect()}
    assert ok == {(1, 3): False, (2, 1): True, (3, 1): False, (2, 2): False}
    merged = {(r.run_id, r.note): r.note_value for r in runs.accumulate_notes(log).collect()}
    assert merged == {(1, "a"): "y", (2, "b"): "z"}


def test_run_sink_appends(spark, sf_dir):
    path = f"{shared_folder(spark)}/runs-test"
    some = views.runs(spark, sf_dir).limit(10)
    runs.append_runs(some, path)
    runs.append_runs(some, path)
    assert spark.read.parquet(path).count() == 20


# ----------------------------------------------------------------------- stream


def test_feed_resumes_without_repeating(spark, tmp_path, sf_dir):
    events = views.table(spark, sf_dir, "events")
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    events.filter("event_id < 300").coalesce(1).write.parquet(source)
    drain = lambda: step_events.drain(step_events.phase_events(step_events.read_events(spark, source, events.schema)), out, mark)
    drain()
    drain()
    assert spark.read.parquet(out).count() == 300
    events.filter("event_id >= 300").coalesce(1).write.mode("append").parquet(source)
    drain()
    assert spark.read.parquet(out).count() == events.count()
