"""Every operator against a plain restatement, on the smallest tables and on odd rows."""

import math
import random
from collections import Counter, defaultdict

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from platen.llm import license_scan, line_crf, mix, pack, preference, queries, secrets, simhash, tokens, topk


def rows_of(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def docs_of(spark, sf_dir):
    return [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


def both(spark, sf_dir, odd_docs, odd_rows):
    """(table, its rows) of the given and of the odd documents."""
    return [(spark.read.parquet(f"{sf_dir}/documents.parquet"), docs_of(spark, sf_dir)), (odd_docs, odd_rows)]


def test_license_scan(spark, sf_dir, odd_docs, odd_rows):
    for df, rows in both(spark, sf_dir, odd_docs, odd_rows):
        got = rows_of(license_scan.scan(df), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
        assert Counter(got) == Counter((i, *brute.license_base(t)) for i, t, _ in rows)
    labels = dict(rows_of(license_scan.scan(odd_docs).where("doc_id > 12 or doc_id = 1"), "doc_id", "labels"))
    assert labels == {1: "mit", 13: "apache,cc-by-nc", 14: "gpl"}
    assert license_scan.scan(odd_docs.limit(0)).count() == 0


def test_license_notice_with_inserted_word(spark):
    text = "licensed under the gnu general and public license version 3"
    got = license_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), coverage=0.6).first()
    assert (got.n_base, got.labels) == (0, "gpl") and 0.6 <= got.score < 1


def test_top_k(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    got = rows_of(topk.top_k(table), "query_id", "rank", "vec_id", "score")
    assert sorted(got, key=str) == brute.top5(rows)


@pytest.mark.parametrize("blocks", [3, 10_000])
def test_top_k_odd_rows(spark, blocks):
    rng = random.Random(5)
    rows = [(i % 160, [rng.choice([0.0, 0.25, -0.5, 1.0]) for _ in range(4)], 1) for i in range(400)]
    rows += [(None, [1.0, 1.0, 1.0, 1.0], 2), (50, None, 2), (50, [None, 1.0, 1.0, 1.0], 2), (100, [math.inf] * 4, 2), (100, [math.nan] * 4, 2), (50, [], 2), (0, [1.0, 2.0], 2), (7, [3.0, -2.0], 2)]
    rows += [(150, [1e6, -1e6, 1e5, 1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, row int")
    got = rows_of(topk.top_k(df, group_rows=3, block_rows=blocks), "query_id", "rank", "vec_id", "score")
    assert sorted(got, key=str) == brute.top5([r[:2] for r in rows])
    assert topk.top_k(df.limit(0)).count() == 0


def mixed_rows(df, **settings):
    return mix.mix(df, **settings).select("doc_id", "size", "source", "source_size", "target", "taken").collect()


@pytest.mark.parametrize("buckets,fill", [(65_536, 64), (4, 3)])
def test_mix(spark, sf_dir, odd_docs, odd_rows, buckets, fill):
    for df, rows in both(spark, sf_dir, odd_docs, odd_rows):
        sizes = defaultdict(int)
        for _, t, s in rows:
            sizes[s] += len(brute.WORD.findall(t or ""))
        want = brute.targets(sizes)
        got = mixed_rows(df, buckets=buckets, fill_from=fill)
        assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len(brute.WORD.findall(t or ""))) for i, t, _ in rows)
        taken = defaultdict(int)
        for r in got:
            assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-6)
            assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
            taken[r.source] += r.taken
        for s, target in want.items():
            # Off by less than the smallest document that could be taken once more, or once less.
            once = int(target // sizes[s]) if sizes[s] else 0
            free = [r.size for r in got if r.source == s and r.size]
            if fill == 64 and once < 3:
                assert abs(target - taken[s]) <= max(min(free, default=0), 1) or len(free) > 1 and abs(target - taken[s]) <= 0.05 * target
        # The number of ranges is a matter of speed alone.
        assert sorted(map(str, mixed_rows(df, buckets=7, fill_from=fill))) == sorted(map(str, got))
    assert mix.mix(odd_docs.limit(0)).count() == 0


def test_mix_goes_on_past_a_long_document(spark):
    """A document over the target overflows early, and the next 64 are far from filling what is open."""
    sizes = [(i, "a", 5 + i % 11) for i in range(6000)] + [(6000, "a", 40_000)] + [(7000 + i, "b", 2000) for i in range(100)]
    df = spark.createDataFrame([(i, s, "w " * n) for i, s, n in sizes], "doc_id long, source string, text string")
    for seed in ("mix", "s1"):
        got = mix.mix(df, weights=(1, 9), seed=seed).collect()
        a = [r for r in got if r.source == "a"]
        assert len(got) == len(sizes) and all(r.copies in (0, 1) for r in a)
        assert abs(sum(r.taken for r in a) - a[0].target) <= 5, seed


def test_mixed_repeats_rows(spark, odd_docs):
    want = Counter()
    for r in mix.mix(odd_docs).collect():
        want[r.doc_id] += r.copies
    got = Counter(r.doc_id for r in mix.mixed(odd_docs).collect())
    assert got == +want


def test_simhash(spark, sf_dir, odd_docs, odd_rows):
    for df, rows in both(spark, sf_dir, odd_docs, odd_rows):
        got = rows_of(simhash.near_duplicates(df), "doc_id", "fingerprint", "component_id")
        assert Counter(got) == Counter(brute.near_components([r[:2] for r in rows]))
    assert simhash.near_duplicates(odd_docs.limit(0)).count() == 0


@pytest.mark.parametrize("bucket_rows", [32_768, 16])
def test_simhash_links(spark, bucket_rows):
    """Chains, balls and loners among random fingerprints, with buckets cut and whole."""
    rng = random.Random(3)
    fps = set()
    for _ in range(40):
        at = rng.getrandbits(64)
        for _ in range(25):
            fps.add(at)
            for b in rng.sample(range(64), rng.randint(1, 6)):
                at ^= 1 << b
    centre = rng.getrandbits(64)
    fps |= {centre ^ (1 << i) ^ (1 << j) for i in range(20) for j in range(20)}
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    links = simhash.links(df, bucket_rows=bucket_rows).collect()
    root = {r.node: r.root for r in simhash.components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(fps):
        for y in fps[:i]:
            if bin((x ^ y) & (2**64 - 1)).count("1") <= 4:
                a, b = find(x), find(y)
                parent[max(a, b)] = min(a, b)
    assert {f: root.get(f, f) for f in fps} == {f: find(f) for f in fps}


def test_simhash_keeps_one(spark, odd_docs):
    left = simhash.without_near_duplicates(odd_docs)
    assert left.columns == odd_docs.columns
    got = rows_of(left, "doc_id", "text")
    fps = {brute.fingerprint(t) for _, t in got}
    assert len(fps) == len(got) and 5 in {i for i, _ in got} and 6 not in {i for i, _ in got}


def test_quality(spark, sf_dir, odd_docs, odd_rows):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for df, rows in both(spark, sf_dir, odd_docs, odd_rows):
        got = line_crf.quality(df, labels).collect()
        assert Counter(tuple(r[c] for c in names) for r in got) == Counter((i, *brute.quality_base(t)) for i, t, _ in rows)
        assert all(not r.kept for r in got if r.base_failed)
    assert line_crf.quality(odd_docs.limit(0), labels).count() == 0
    assert line_crf.quality(odd_docs, labels.limit(0)).where("kept").count() > 0


def test_quality_against_labels(spark):
    """Held out: the sample is the documents' first labels by hash; all labels of a larger table are judged."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = line_crf.quality(docs, labels, sample_docs=150).join(labels, "doc_id").collect()
    good = [r for r in got if r.quality == 1 and not r.base_failed]
    assert sum(r.kept for r in good) >= 0.98 * len(good)
    bad = [r for r in got if r.quality == 0]
    assert sum(not r.kept for r in bad) >= 0.8 * len(bad)


def test_viterbi_is_the_best_sequence():
    rng = np.random.default_rng(1)
    field = line_crf.Field(rng.normal(size=(len(line_crf.FEATURES), 2)), rng.normal(size=(2, 2)))
    for n in (1, 2, 5, 8):
        x = rng.normal(size=(n, len(line_crf.FEATURES)))
        s = x @ field.weights

        def value(seq):
            return sum(s[t, a] for t, a in enumerate(seq)) + sum(field.moves[a, b] for a, b in zip(seq, seq[1:]))

        best = max(range(2**n), key=lambda k: value([k >> t & 1 for t in range(n)]))
        assert field.boilerplate(x).tolist() == [bool(best >> t & 1) for t in range(n)]


def test_secrets(spark, sf_dir, odd_docs, odd_rows):
    for df, rows in both(spark, sf_dir, odd_docs, odd_rows):
        df.createOrReplaceTempView("secret_docs")
        got = []
        for r in secrets.spans(df).collect():
            base = [s for s in r.found if s.kind in secrets.BASE]
            assert [(s.start, s.kind_no) for s in r.found] == sorted((s.start, s.kind_no) for s in r.found)
            got.append((r.doc_id, ",".join(f"{s.kind}:{s.start}:{s.end}" for s in base)))
        assert Counter(got) == Counter((i, brute.secrets_base(t)[-1]) for i, t, _ in rows)
    assert secrets.spans(odd_docs.limit(0)).count() == 0


def test_secrets_are_linked(spark):
    weak = "A9b8C7d6E5f4G3h2I1j0K9l8M7"
    far = " word" * 200
    rows = [
        (1, f"client_id: shop42 and key {weak} at https://api.example.com/v1/pay"), (2, f"key {weak} alone"),
        (3, f"client_id: shop42{far} {weak}"), (4, f"client_id: shop42{far} https://api.example.com/v1/pay"), (5, "see https://example.com/a/b"),
    ]
    got = {r.doc_id: {s.kind for s in r.found} for r in secrets.spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: {"weak_id", "weak_secret", "weak_endpoint"}, 2: set(), 3: set(), 4: set(), 5: set()}


def test_links_of_long_parts(spark):
    """Parts of 1 to 1000 characters, 0 to 300 apart, against all pairs."""
    rng = random.Random(7)
    rows = [(0, 4, 250, 300), (0, 3, 520, 540)]
    for row in range(1, 400):
        at = rng.randrange(600)
        for _ in range(rng.randrange(2, 5)):
            long = rng.randrange(1, 1001)
            rows.append((row, rng.choice((0, 1, 3, 4, 5)), at, at + long))
            at += long + rng.randrange(301)
    want = set()
    for a in rows:
        for b in rows:
            if a[0] == b[0] and a[1] in (0, 4) and b[1] in (1, 3, 5) and 0 <= max(b[2] - a[3], a[2] - b[3]) <= 256:
                want |= {x for x in (a, b) if x[1] >= 3}
    got = secrets._linked(spark.createDataFrame(rows, "row long, kind int, start int, end int"), 256)
    assert sorted(tuple(r) for r in got.select("row", "kind", "start", "end").collect()) == sorted(want)


def test_redact(spark, odd_docs):
    got = dict(rows_of(secrets.redact(odd_docs.where("doc_id in (1, 8, 12)")), "doc_id", "text"))
    assert got[1] == brute_text(odd_docs, 1)
    assert got[8] == "[SECRET] [SECRET]" and got[12] == "[SECRET]: abcdefghijkl passwd = \"short\" [SECRET]'" or "hunter" not in got[12]
    assert rows_of(secrets.redact(odd_docs), "doc_id").__len__() == odd_docs.count()


def brute_text(df, i):
    return df.where(F.col("doc_id") == i).first().text


def test_token_counts(spark, sf_dir, odd_docs, odd_rows):
    tok = brute.tokenizer(queries.WORD_VOCABULARY)
    for chunk, overlap in ((32_768, 1024), (64, 8)):
        for df, rows in both(spark, sf_dir, odd_docs, odd_rows):
            got = rows_of(
                tokens.token_counts(df, public_tokenizers.path(queries.WORD_VOCABULARY), chunk=chunk, overlap=overlap),
                "doc_id", "n_bytes", "n_tokens", "over_limit",
            )
            n = [len(tok.encode(t or "", add_special_tokens=False)) for _, t, _ in rows]
            assert Counter(got) == Counter((i, len((t or "").encode()), k, k > 2048) for (i, t, _), k in zip(rows, n))


def test_resynchronised_counts_of_random_texts():
    counter = tokens.Counter(public_tokenizers.path(queries.WORD_VOCABULARY), 60, 10)
    tok = brute.tokenizer(queries.WORD_VOCABULARY)
    rng = random.Random(2)
    alphabet = ["a", "B", "é", "é", "́", " ", "\n", "'", "'s", "'ll", "1", "!", "字", "😀", "ß", "<|endoftext|>", " ", "word", "İ"]
    for _ in range(400):
        some = rng.sample(alphabet, rng.randint(2, len(alphabet)))
        text = "".join(rng.choice(some) for _ in range(rng.randint(0, 300)))
        assert counter.counts([text]) == [len(tok.encode(text, add_special_tokens=False))], repr(text)


def test_packing(spark, sf_dir):
    tok = brute.tokenizer(queries.BYTE_VOCABULARY)
    names = ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    rows = rows_of(queries.op9_best_fit_packing(spark, sf_dir), *names)
    n = brute.check_packing(rows, {i: t for i, t, _ in docs_of(spark, sf_dir)}, tok)
    assert n <= math.ceil(sum(r[3] for r in rows) / 2048) + 1


def test_packing_odd_rows(spark, odd_docs, odd_rows):
    tok = brute.tokenizer(queries.BYTE_VOCABULARY)
    seen, docs = {}, []
    for i, t, _ in odd_rows:  # ids of their own, so that repeated rows can be told apart
        docs.append((len(docs), t))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    names = ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    brute.check_packing(rows_of(queries.packed(df), *names), dict(docs), tok)
    assert queries.packed(odd_docs).count() == queries.packed(df).count()
    assert queries.packed(odd_docs.limit(0)).count() == 0
    assert not seen


def test_encoder_gives_the_ids_of_tokenizers():
    tok = brute.tokenizer(queries.BYTE_VOCABULARY)
    encoder = pack.Encoder(public_tokenizers.path(queries.BYTE_VOCABULARY), public_tokenizers.PATTERN)
    same = lambda t: encoder.encode(t).tolist() == tok.encode(t, add_special_tokens=False).ids
    rng = random.Random(4)
    alphabet = ["a", "B", "é", "\u0301", " ", "  ", "\n", "\t", "'", "'s", "1", "!", "字", "<|endoftext|>", "\u00a0", "\x1c", "\x85", "\u2003"]
    for _ in range(500):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
        assert same(text), repr(text)
    for c in map(chr, range(pack.SETTLED + 40)):
        assert same(f"a{c}b {c}{c} 1{c}2\n{c} {c}'s!{c}") and same(c * 3), repr(c)


def test_pieces_carry_their_ids(spark):
    df = spark.createDataFrame([(1, "some words " * 30), (None, None)], "doc_id long, text string")
    got = pack.pieces(df, public_tokenizers.path(queries.BYTE_VOCABULARY), public_tokenizers.PATTERN, tokens=16).orderBy("row", "piece").collect()
    ids = [np.frombuffer(r.ids, "<u4") for r in got]
    assert np.concatenate(ids[:-1]).tolist() == brute.tokenizer(queries.BYTE_VOCABULARY).encode("some words " * 30).ids + [0]
    assert ids[-1].tolist() == [0] and all(len(i) == r.length for i, r in zip(ids, got))


@pytest.mark.parametrize("rule", ["dot", "norm"])
def test_bins_hold_every_capacity(spark, rule):
    rng = random.Random(6)
    items = spark.createDataFrame([(i, 0, rng.randint(1, 90)) for i in range(700)], "row long, piece int, length long")
    got = pack.pack(items, tokens=100, documents=5, attention=9000.0, rule=rule, shard=200).collect()
    assert sorted((r.row, r.length) for r in got) == sorted((r.row, r.length) for r in items.collect())
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        assert len(b) <= 5 and sum(n for _, n in b) <= 100 and sum(n * n for _, n in b) <= 9000
        assert sorted(b)[0][0] == 0
    total = sum(r.length for r in got)
    assert len(bins) <= 1.15 * max(total / 100, sum(r.length**2 for r in got) / 9000, 700 / 5)


def test_preferences(spark):
    turn = lambda r, t: {"role": r, "text": t}
    a, b, c = turn("user", "hi"), turn("assistant", "yes<|end|>"), turn("assistant", "no")
    rows = [(1, [a, b], [a, c], 0), (2, [a, b], [a, b], 0), (3, [b], [c, a], 0), (4, None, [a], 0), (None, [a, b, a], [a, b], 0)]
    df = spark.createDataFrame(rows, "pair_id long, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>, prompt int")
    got = {r.pair_id: r for r in preference.preferences(df).collect()}
    said = lambda t: f"<|turn|>{t['role']}\n{t['text'].replace('<|', '< |')}<|end|>\n"
    assert (got[1].prompt, got[1].chosen, got[1].rejected) == (said(a), said(b), said(c))
    s, e = map(int, got[1].chosen_mask.split(":"))
    assert got[1].chosen[s:e] == "yes< |end|><|end|>"
    assert (got[2].n_common, got[2].chosen, got[2].rejected, got[2].chosen_mask) == (2, "", "", "")
    assert (got[3].n_common, got[3].prompt, got[3].n_rejected) == (0, "", 2)
    assert (got[4].chosen, got[4].rejected) == ("", said(a)) and (got[None].n_common, got[None].chosen) == (2, said(a))


def test_conversation_rows(spark):
    rows = [(0, 0, "user", "q", 1), (0, 1, "assistant", "r0", 1), (1, 0, "user", None, 1), (1, 1, "assistant", "r1", 1), (None, 0, None, None, 1), (4, None, "user", "x", 1), (4, 2, "user", "y", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns int")
    got = {r.pair_id: r for r in preference.preferences(preference.with_other_replies(preference.conversations(df))).collect()}
    assert set(got) == {0, 1, 4, None}
    assert "r0" in got[0].chosen and "r1" in got[0].rejected and got[0].n_common == 1 and got[4].chosen == got[4].rejected == ""
    assert preference.conversations(df.limit(0)).count() == 0
