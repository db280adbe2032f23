"""Operators on groups of any size: files in ranges, long chains, documents by lines, crowded pages, stored tables."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from platen.functions.markup import markdown_to_html
from platen.operators import markdown_lines, reading_order, runs, step_tables, stored, validate
from platen.operators.catalog import TRANSFORMS
from platen.operators.ranges import rank_within
from platen.session import shared_folder
from platen.sources import csv_files, csv_split


@pytest.fixture
def small_ranges(spark):
    """Byte ranges of 1500 bytes."""
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = [spark.conf.get(n) for n in names]
    for n, v in zip(names, ("1500", "1")):
        spark.conf.set(n, v)
    yield
    for n, v in zip(names, before):
        spark.conf.set(n, v)


@pytest.fixture
def as_dealt(spark):
    """Partitions as they are dealt: small ones are not put together, small sides not broadcast."""
    wanted = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {n: spark.conf.get(n) for n in wanted}
    for n, v in wanted.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def file_of(tmp_path, text, name="a.csv"):
    path = tmp_path / name
    path.write_bytes(text.encode())
    return str(path)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


# ------------------------------------------------------------------------- files


def test_ranges_equal_the_whole_file_reader(spark, tmp_path, small_ranges):
    rng = random.Random(7)
    cells = ["plain", 'say ""hi""', "two\nlines", "a,b", "\n\n", 'é😀 ""', "x" * 700, "many\n" * 60, ""]
    lines = ["id,note,rest"]
    for i in range(400):
        note = rng.choice(cells)
        lines.append(f'{i},"{note}",{i % 7}' if note else f"{i},,{i % 7}")
    path = file_of(tmp_path, "\r\n".join(lines) + "\r\n")
    assert spark.read.text(path).rdd.getNumPartitions() > 20
    got, want = csv_split.scan_csv(spark, path), csv_files.read_csv(spark, path)
    assert got.columns == want.columns
    assert rows_of(got) == rows_of(want)


def test_records_know_where_they_began(spark, tmp_path, small_ranges):
    path = file_of(tmp_path, 'a,"' + "long\n" * 200 + '"\nb,c\n')
    got = csv_split.csv_records(spark, path).orderBy("block", "pos").collect()
    assert [(r.block == 0 and r.pos == 0, r.record[:6]) for r in got] == [(True, 'a,"lon'), (False, "b,c")]
    assert got[0].record.count("\n") == 200


def test_odd_files(spark, tmp_path, small_ranges):
    assert csv_split.csv_records(spark, file_of(tmp_path, "")).collect() == []
    open_quote = csv_split.scan_csv(spark, file_of(tmp_path, 'h\n1\n"' + "x\n" * 300, "open.csv"))
    assert [len(r.h) for r in open_quote.orderBy(F.length("h")).collect()] == [1, 599]
    marked = csv_split.scan_csv(spark, file_of(tmp_path, "\ufeffk,v\r\n1,2\r\n\r\n3\r4,5,6\n", "mark.csv"))
    assert marked.columns == ["k", "v"]
    assert rows_of(csv_split.scan_csv(spark, file_of(tmp_path, 'k\r\n"a\r\nb"\r\n', "crlf.csv"))) == [("a\r\nb",)]
    assert rows_of(marked) == sorted([("1", "2"), ("3", None), ("4", "5")])
    assert rows_of(csv_split.scan_csv(spark, file_of(tmp_path, "1,2\n", "plain.csv"), columns=["a", "b", "c"])) == [("1", "2", None)]
    with pytest.raises(ValueError):
        csv_split.scan_csv(spark, file_of(tmp_path, "", "empty.csv"))


def test_several_files_and_a_header_of_two_lines(spark, tmp_path, small_ranges):
    for n in "ab":
        file_of(tmp_path, '"two\nlines",v\n' + "".join(f'{n}{i},"x\ny"\n' for i in range(60)), f"{n}.csv")
    got = csv_split.scan_csv(spark, str(tmp_path))
    assert got.columns == ["two\nlines", "v"]
    assert rows_of(got) == sorted((f"{n}{i}", "x\ny") for n in "ab" for i in range(60))


# ------------------------------------------------------------------------ chains


def random_chains(n, seed=3):
    rng = random.Random(seed)
    ids = [t.id for t in TRANSFORMS] + ["no-such-tool"]
    chains, steps = [], []
    for c in range(n):
        chains.append((c, rng.choice([None, "", "pdf", "md", "txt"]), rng.choice([None, "", "txt", "png"])))
        steps += [(c, i, rng.choice(ids)) for i in range(rng.choice([0, 1, 3, 40]))]
    return chains, steps


@pytest.mark.parametrize("band", [1, 4, 4096])
def test_a_step_table_gives_the_errors_of_arrays(spark, band):
    chains, steps = random_chains(60)
    table = spark.createDataFrame(steps, "chain_id long, idx int, tool_id string")
    attributes = spark.createDataFrame(chains, "chain_id long, input_type string, output_type string")
    arrays = spark.createDataFrame(
        [(c, a, b, [(t, {}) for x, _, t in sorted(steps) if x == c]) for c, a, b in chains],
        "chain_id long, input_type string, output_type string, steps array<struct<tool_id:string,params:map<string,string>>>",
    )
    checked = validate.validate_chains(arrays)
    want = checked.select("chain_id", F.explode("errors").alias("e")).select("chain_id", "e.*")
    assert rows_of(step_tables.validate_steps(table, attributes, band)) == rows_of(want)
    states = checked.select("chain_id", "ends_at", "goal", F.size("errors"), F.size("warnings"), "ok")
    assert rows_of(step_tables.chain_states(table, attributes, band)) == rows_of(states)
    warnings = checked.select("chain_id", F.explode("warnings").alias("w")).select("chain_id", "w.step", "w.message")
    assert rows_of(step_tables.simulated_steps(table)) == rows_of(warnings)


def test_steps_without_a_place_and_chains_without_a_row(spark):
    table = spark.createDataFrame(
        [(1, 0, "pdf-text"), (1, None, "md-html"), (None, 0, "md-html"), (2, 0, "text-md"), (2, 1, None)], "chain_id long, idx int, tool_id string"
    )
    chains = spark.createDataFrame([(1, "pdf", None)], "chain_id long, input_type string, output_type string")
    got = rows_of(step_tables.typed_steps(table, chains).select("chain_id", "idx", "current"))
    assert got == sorted([(1, 0, "pdf"), (2, 0, None), (2, 1, "md")], key=str)
    assert [r.kind for r in step_tables.validate_steps(table, chains).collect()] == ["unknown-tool"]
    none = table.limit(0)
    assert [r.kind for r in step_tables.validate_steps(none, chains).collect()] == ["empty"]


def test_a_long_chain_is_many_groups(spark, as_dealt):
    n = 20_000
    tools = F.when(F.col("id") % 1000 == 7, "pdf-text").otherwise("no-such-tool")
    table = spark.range(n).select(F.lit(1).cast("long").alias("chain_id"), F.col("id").cast("int").alias("idx"), tools.alias("tool_id"))
    chains = spark.createDataFrame([(1, "pdf", None)], "chain_id long, input_type string, output_type string")
    typed = step_tables.typed_steps(table, chains, band=64)
    spread = typed.groupBy(F.spark_partition_id().alias("p")).count()
    assert spread.count() > 1 and spread.agg(F.max("count")).first()[0] < n
    assert {(r.current, r["count"]) for r in typed.groupBy("current").count().collect()} == {("pdf", 8), ("txt", n - 8)}


# -------------------------------------------------------------------------- runs


@pytest.mark.parametrize("width", [1, 10, 10_000])
def test_each_run_meets_the_one_before(spark, width):
    rng = random.Random(width)
    rows = [(rng.choice([0, 0, 1, None]), i, rng.randrange(300), [h for h in "abc" if rng.random() < 0.5], rng.randrange(100)) for i in range(500)]
    verdicts = spark.createDataFrame(rows, "chain_id long, run_id long, at int, hits array<string>, score int")
    got = {r.run_id: r for r in runs.changes_by_run(verdicts, F.floor(F.col("at") / width)).collect()}
    assert len(got) == len(rows)
    for chain in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == chain), key=lambda r: (r[2], r[1]))
        for before, now in zip([None, *mine], mine):
            old = before[3] if before else []
            assert got[now[1]].previous_run == (before and before[1])
            assert got[now[1]].appeared == [h for h in now[3] if h not in old] and got[now[1]].resolved == [h for h in old if h not in now[3]]
            assert got[now[1]].score_delta == (now[4] - before[4] if before else None)


# ---------------------------------------------------------------------- markdown

LINES = ["# head", "text", "more text", "- item", "1. item", "| a | b |", "|---|---|", "```", "", "  ", "* x", "> quoted", "#nohead", "```js", "| only", "##  "]


def line_rows(spark, docs):
    rows = [(d, i, x) for d, lines in docs.items() for i, x in enumerate(lines)]
    return spark.createDataFrame(rows, "doc_id long, line int, text string")


@pytest.mark.parametrize("band", [2, 5, 256])
def test_blocks_rendered_alone_are_the_document(spark, band):
    rng = random.Random(band)
    docs = {d: [rng.choice(LINES) for _ in range(rng.choice([1, 2, 7, 60]))] for d in range(40)}
    lines = line_rows(spark, docs)
    blocks = markdown_lines.markdown_blocks(lines, band).cache()
    assert blocks.count() == sum(map(len, docs.values()))
    got = {}
    for r in sorted(markdown_lines.block_html(lines, blocks).collect(), key=lambda r: r.block):
        got.setdefault(r.doc_id, []).extend([r.html] * bool(r.html))
    whole = spark.createDataFrame([(d, "\n".join(x)) for d, x in docs.items()], "doc_id long, md string")
    want = {r.doc_id: r.html for r in whole.select("doc_id", markdown_to_html(F.col("md")).alias("html")).collect()}
    assert {d: "\n".join(x) for d, x in got.items() if x} == {d: h for d, h in want.items() if h}
    blocks.unpersist()


def test_state_passes_over_many_bands(spark):
    docs = {1: ["```"] + ["- x"] * 500 + ["```", "- y", "z", "", "z"], 2: [None, "a"]}
    got = {(r.doc_id, r.line): (r.block, r.kind) for r in markdown_lines.markdown_blocks(line_rows(spark, docs), band=3).collect()}
    assert all(got[1, i] == (0, "code") for i in range(502))
    assert [got[1, i] for i in range(502, 506)] == [(1, "list"), (1, "list"), (None, None), (2, "paragraph")]
    assert got[2, 0] == (None, None) and got[2, 1] == (0, "paragraph")


def test_no_lines(spark):
    assert markdown_lines.markdown_blocks(line_rows(spark, {})).collect() == []


# ------------------------------------------------------------------------- pages


def test_ranks_of_a_hot_group_with_ties_and_nulls(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else rng.choice([None, "a", "b"]), rng.choice([None, 1, 2, 2, 3]), i % 5) for i in range(3000)]
    got = rank_within(spark.createDataFrame(rows, "k string, v int, extra int"), ["k"], [F.asc_nulls_last("v")], "place").collect()
    assert len(got) == len(rows)
    for key in {r.k for r in got}:
        mine = sorted((r for r in got if r.k == key), key=lambda r: r.place)
        assert [r.place for r in mine] == list(range(len(mine)))
        order = [9 if r.v is None else r.v for r in mine]
        assert order == sorted(order)


def test_one_position_holds_all_runs_of_a_page(spark, as_dealt):
    placed = spark.range(5000).select(
        F.lit(1).alias("doc_id"), F.lit(1).alias("page"), (F.lit(5000) - F.col("id")).alias("seq"), F.lit(1.0).alias("x"), F.lit(2.0).alias("y"),
        F.col("id").cast("string").alias("text"),
    )
    got = reading_order.reading_positions(placed)
    assert got.where("visual_pos <> seq - 1").count() == 0
    assert got.groupBy(F.spark_partition_id().alias("p")).count().count() > 1
    assert reading_order.order_differs(placed).collect()[0].order_differs is False


# ----------------------------------------------------------------- stored tables


def table_of(spark, **more):
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    return stored.NewestRows(spark, path, "name string, at long, text string", ["name"], ["at"], **more).create()


def test_upserts_touch_their_buckets_only(spark):
    t = table_of(spark, buckets=16)
    first = spark.createDataFrame([(f"n{i}", 1, f"t{i}") for i in range(50)] + [(None, 1, None)], "name string, at long, text string")
    assert t.merge(first) > 1
    files = {r[0] for r in spark.read.parquet(t.path).select(F.input_file_name()).distinct().collect()}
    newer = spark.createDataFrame([("n7", 3, "new"), ("n7", 2, "between"), ("n8", 0, "older")], "name string, at long, text string")
    assert t.merge(newer) in (1, 2)
    kept = {r[0] for r in spark.read.parquet(t.path).select(F.input_file_name()).distinct().collect()}
    assert len(files & kept) >= len(files) - 2
    got = {r.name: r.text for r in t.rows().collect()}
    assert len(got) == 51 and got["n7"] == "new" and got["n8"] == "t8" and got[None] is None
    before = rows_of(t.rows())
    t.merge(newer)
    assert rows_of(t.rows()) == before
    assert t.merge(newer.limit(0)) == 0


def test_history_in_batches_is_that_of_one(spark):
    rng = random.Random(5)
    rows = [(rng.choice("aab"), i, f"r{i}") for i in range(400)]
    rng.shuffle(rows)
    t = table_of(spark, keep=25, buckets=4)
    for at in range(0, 400, 90):
        t.merge(spark.createDataFrame(rows[at : at + 90], "name string, at long, text string"))
    t.merge(spark.createDataFrame(rows[:90], "name string, at long, text string"))
    want = [r for n in "ab" for r in sorted((x for x in rows if x[0] == n), key=lambda x: -x[1])[:25]]
    assert rows_of(t.rows()) == sorted(want, key=str)


def test_an_empty_table_has_no_rows(spark):
    assert table_of(spark).rows().collect() == []


@pytest.mark.parametrize("name", ["given_type_scores", "given_type_scores_long"])
def test_requests_are_parsed_once_and_by_many_tasks(spark, sf_dir, name):
    """A filter on the error stays above the parser, which stands above the dealing of rows."""
    from platen.plans import QUERIES

    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if line.strip(" :+-").startswith("Filter")]
    assert filters and not any("from_json" in line or "get_json_object" in line for line in filters)
    assert "RepartitionByExpression" in plan
