"""Line dedup, Merkle manifest and token alignment against plain restatements."""

import hashlib
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from platen.llm import align, line_runs, merkle, queries

BLANKS = " \t\n\x0b\x0c\r"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def same(got, want):
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


# ------------------------------------------------------------------ line dedup


def brute_lines(rows, min_docs, min_chars=1):
    key = lambda line: line.strip(BLANKS).translate(UPPER)
    n = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")})
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or n[key(x)] < min_docs]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("min_docs, batches", [(2, 1), (2, 9), (3, 5)])
def test_lines_of_odd_documents(odd_docs, odd_rows, min_docs, batches):
    got = line_runs.dedup(odd_docs, min_docs=min_docs, batches=batches, fanout=2)
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept"]
    same(got.collect(), brute_lines([(i, t) for i, t, _ in odd_rows], min_docs))


def test_shared_lines_go_everywhere(spark):
    rows = [(i, f"own {i}\n  The Same LINE \t\nthe same line\n\n{'x' * (i % 3)}") for i in range(40)] + [(None, "THE SAME LINE"), (7, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_runs.dedup(docs).collect()
    same(got, brute_lines(rows, 10))
    assert {r.n_dropped for r in got if r.n_lines == 5} == {2, 3}


def test_a_line_counts_once_for_a_document(spark):
    docs = spark.createDataFrame([(1, "a\n" * 30), (2, "b")], "doc_id long, text string")
    assert {r.n_dropped for r in line_runs.dedup(docs).collect()} == {0}


def test_no_documents_no_lines(spark):
    assert line_runs.dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_runs_are_compacted_and_known_lines_not_added(spark):
    runs = line_runs.LineRuns(spark, min_docs=3, fanout=3, buckets=4)
    batch = lambda *texts: line_runs.document_counts(spark.createDataFrame([(t,) for t in texts], "text string"))
    runs.add(batch("a", "a", "a", "b"))
    runs.add(batch("a", "b"))
    assert spark.table(runs.levels[0][1]).count() == 1  # "a" is known to be frequent
    runs.add(batch("c"))
    assert [len(x) for x in runs.levels] == [0, 1]
    runs.add(batch("b", "c"))
    assert runs.frequent().count() == 2
    names = runs.runs
    runs.close()
    assert not any(spark.catalog.tableExists(n) for n in names)


def test_runs_are_not_shuffled_by_a_batch(spark):
    runs = line_runs.LineRuns(spark, buckets=4)
    counts = line_runs.document_counts(spark.createDataFrame([("a\nb",)], "text string"))
    runs.add(counts)
    full = spark.table(runs.runs[0]).where("n >= 10").select("h1", "h2")
    plan = counts.repartition(4, "h1", "h2").join(full.hint("merge"), ["h1", "h2"], "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") - plan.count("REPARTITION_BY_NUM") <= 1  # that of the counts alone
    runs.close()


# --------------------------------------------------------------- Merkle manifest


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def brute_manifest(rows):
    def tree(hashes):
        levels = [hashes]
        while len(levels[-1]) > 1:
            levels.append([digest(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
        return levels

    def climb(levels, place, folded, proof):
        for level in levels[:-1]:
            first = place // 3 * 3
            run = list(level[first : first + 3])
            run[place - first] = folded
            proof += [x for i, x in enumerate(run) if i != place - first]
            folded, place = digest(*run), place // 3
        return folded

    by = defaultdict(list)
    for r in rows:
        by[r[1]].append((r[0], digest(*map(field, r)), r))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        by[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = {s: tree([x[1] for x in by[s]]) for s in sources}
    over = tree([trees[s][-1][0] for s in sources])
    out = []
    for n, s in enumerate(sources):
        for place, (doc_id, leaf, r) in enumerate(by[s]):
            hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 and r[4] is not None
            proof = []
            folded = climb(trees[s], place, digest(*map(field, r[:4]), field(r[4].replace("\n", ""))) if hit else leaf, proof)
            folded = climb(over, n, folded, proof)
            out.append((doc_id, leaf, trees[s][-1][0], over[-1][0], digest(*proof), folded, folded == over[-1][0]))
    return out


def manifest_of(spark, rows):
    return merkle.manifest(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")).collect()


@pytest.mark.parametrize("rows", [
    [],
    [(1, None, None, None, None)],
    [(i, "one", "en", i, "a\nb") for i in range(4)],
    [(None, "b", None, None, "q\n"), (1, "a", "x", 3, "a\nb"), (2, "b", "x", 3, "a\nb"), (2, "b", "x", 3, "a\nb"), (2, "b", "y", 3, "")],
    [(i, f"s{i}" if i % 3 else None, "en", i, "t\n") for i in range(700)],
    [(i % 1500, "hot" if i % 9 else "ü", "en", i, f"t\n{i % 7}") for i in range(2500)],
], ids=["none", "one row", "one source", "nulls and repeats", "many sources", "hot source"])
def test_manifest(spark, rows):
    same(manifest_of(spark, rows), brute_manifest(rows))


def test_manifest_ignores_other_columns(odd_docs):
    rows = [tuple(r) for r in odd_docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    same(merkle.manifest(odd_docs).collect(), brute_manifest(rows))


def test_only_changed_texts_fail(spark):
    got = {r.doc_id: r.verified for r in manifest_of(spark, [(i, "a", "en", 3, "x\ny" if i < 50 else "xy") for i in range(100)])}
    assert got == {i: not (i < 50 and zlib.crc32(str(i).encode()) % 2 == 0) for i in range(100)}


def test_row_limit_of_recursion_is_put_back(spark):
    before = spark.conf.get("spark.sql.cteRecursionRowLimit", None)
    manifest_of(spark, [(i, "a", "en", 3, "x") for i in range(5)])
    assert spark.conf.get("spark.sql.cteRecursionRowLimit", None) == before


# ---------------------------------------------------------------- token alignment


@pytest.fixture(scope="module")
def vocabularies():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def brute_alignment(rows, vocabularies):
    a, b = vocabularies
    byte_of = {}
    other = 256
    for x in range(256):
        if chr(x).isprintable() and not chr(x).isspace() and x != 0xAD:
            byte_of[chr(x)] = x
        else:
            byte_of[chr(other)], other = x, other + 1
    a_bytes = lambda i: bytes(byte_of[c] for c in a.id_to_token(i))

    def b_bytes(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    docs, counts = [], Counter()
    for i, text in rows:
        groups, links, na, nb = [], [], 0, 0
        if text:
            x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            p, q = [a_bytes(t) for t in x], [b_bytes(t) for t in y]
            if b"".join(p) == b"".join(q) == (" " + text).encode():
                na, nb = len(x), len(y)
                ends = lambda parts: [sum(map(len, parts[: k + 1])) for k in range(len(parts))]
                ea, eb = ends(p), ends(q)
                at = {e: k for k, e in enumerate(eb)}
                last_a = last_b = 0
                for k, e in enumerate(ea):
                    if e in at:
                        groups.append(",".join(map(str, x[last_a : k + 1])) + "|" + ",".join(map(str, y[last_b : at[e] + 1])))
                        links.append((x[k], y[at[e]]))
                        last_a, last_b = k + 1, at[e] + 1
        counts.update(links)
        docs.append((i, na, nb, links, ";".join(groups)))
    best = defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [
        (i, na, nb, len(links), len(links), sum(counts[z] == best[z[1]] for z in links), sum(counts[z] for z in links), groups)
        for i, na, nb, links, groups in docs
    ], counts


ODD_TEXTS = ["", None, " ", "▁ under ▁", "<|endoftext|> <s> </s> <unk> <0x41>", "tab\tand\r\nline", "no-break space ​", "ﬁ ŉ é é 😀😀",
             "\x00 zero", "日本語 のテキスト", "x" * 3000, "a  b   c    d", "  lead", "trail  ", "don't I'LL we've"]


def args():
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize("chunk", [1 << 20, 30])
def test_alignment(spark, vocabularies, monkeypatch, chunk):
    monkeypatch.setattr(align, "CHUNK", chunk)
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS * 2)] + [(None, "the same words again and again"), (3, "the same words again and again")] * 3
    docs = spark.createDataFrame([(i, t, 1, "n") for i, t in rows], "doc_id long, text string, chunk int, pair string")
    got, pairs = align.align(docs, *args())
    want, counts = brute_alignment(rows, vocabularies)
    same(got.collect(), want)
    same(pairs.select("a", "b", "n").collect(), [(*k, n) for k, n in counts.items()])


def test_alignment_of_real_documents(spark, sf_dir, vocabularies):
    docs = queries.table(spark, sf_dir, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect() if len(r.text or "") < 4000]
    got, _ = align.align(docs.where(F.coalesce(F.length("text"), F.lit(0)) < 4000), *args(), groups="sha256")
    want, _ = brute_alignment(rows, vocabularies)
    same(got.collect(), [(*w[:-1], hashlib.sha256(w[-1].encode()).hexdigest() if w[-1] else "") for w in want])


def test_nothing_to_align(spark):
    got, pairs = align.align(spark.createDataFrame([], "doc_id long, text string"), *args())
    assert got.collect() == [] and pairs.collect() == []
    got, pairs = align.align(spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string"), *args())
    same(got.collect(), [(1, 0, 0, 0, 0, 0, 0, ""), (None, 0, 0, 0, 0, 0, 0, "")])
