"""The pipeline stage by stage against the operators' own rules."""

import brute
import corpus_pipeline
import pytest
from pyspark.sql import functions as F

COLUMNS = list(corpus_pipeline.DOCUMENT)
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def tables(spark, sf_dir, tmp_path_factory):
    """The documents before and after each stage."""
    out = [spark.read.parquet(f"{sf_dir}/documents.parquet")]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, out[-1], sf_dir).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_columns(tables):
    assert all(t.columns == COLUMNS for t in tables[:-1])


def test_quality_drops_only_rejected(tables):
    before, after = ({r.doc_id: r.text for r in t.collect()} for t in tables[:2])
    gone = set(before) - set(after)
    failed = {i for i, t in before.items() if brute.quality_base(t)[-1]}
    assert failed <= gone and len(gone) < 0.35 * len(before) and all(after[i] == before[i] for i in after)


def test_one_of_each_group_stays(tables):
    before = [(r.doc_id, r.text) for r in tables[1].collect()]
    want = {d for d, _, c in brute.near_components(before) if d == c}
    assert sorted(r.doc_id for r in tables[2].collect()) == sorted(want)


def test_secrets_are_gone(tables):
    before, after = ({r.doc_id: r.text for r in t.collect()} for t in tables[2:4])
    assert set(before) == set(after)
    for i, text in after.items():
        assert brute.secrets_base(text)[-1] == ""
        assert (text == before[i]) or "[SECRET]" in text


def test_sources_come_near_their_targets(tables):
    size = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    before, after = ({r.source: r.n for r in t.groupBy("source").agg(F.sum(size).alias("n")).collect()} for t in tables[3:5])
    for source, target in brute.targets(before).items():
        assert abs(after.get(source, 0) - target) <= 0.15 * target + 20


def test_packing_holds_all(tables):
    tok = brute.tokenizer("byte_bpe_50k.json")
    rows = tables[5].collect()
    want = sum(len(tok.encode(r.text, add_special_tokens=False)) + 1 for r in tables[4].collect())
    assert sum(r.length for r in rows) == want
    used = {}
    for r in rows:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert max(used.values()) <= 2048 and len(used) <= -(-want // 2048) + 1


def test_stages_take_odd_rows(spark, sf_dir, odd_docs):
    docs = odd_docs
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).count()
    none = docs.limit(0)
    assert [stage(spark, none, sf_dir).count() for _, stage in corpus_pipeline.STAGES] == [0] * 5


def test_run(spark, sf_dir, tables):
    assert corpus_pipeline.run(spark, sf_dir).count() == tables[5].count()
