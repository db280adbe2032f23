"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import align, html_main, license_scan, line_crf, line_runs, merkle, mix, pack, preference, secrets, simhash, tokens, topk

WORD_VOCABULARY = "word_bpe_49k.json"
BYTE_VOCABULARY = "byte_bpe_50k.json"
PIECE_MODEL = "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_crf.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.col("found")
    base = secrets.base_only(found)
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return secrets.spans(table(spark, sf_dir, "documents")).select(
        "doc_id", *[count(k) for k in secrets.BASE],
        F.sha2(secrets.joined(base).cast("binary"), 256).alias("base_sha256"), secrets.joined(found).alias("spans"),
    )


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_VOCABULARY))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(table(spark, sf_dir, "pages"))


def packed(docs: DataFrame) -> DataFrame:
    cut = pack.pieces(docs, public_tokenizers.path(BYTE_VOCABULARY), public_tokenizers.PATTERN, ids=False)
    return pack.pack(cut).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op10_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = preference.conversations(table(spark, sf_dir, "conversations"))
    return preference.preferences(preference.with_other_replies(convs))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_runs.dedup(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path
    aligned, _ = align.align(
        table(spark, sf_dir, "documents"), path(BYTE_VOCABULARY), public_tokenizers.PATTERN, path(PIECE_MODEL), groups="sha256"
    )
    return aligned.withColumnRenamed("groups", "groups_sha256")


QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_exact_top_k, op3_source_mix, op4_simhash, op5_line_quality, op6_secret_scan,
        op7_token_counts, op8_main_text, op9_best_fit_packing, op10_preference_pairs,
        op11_line_dedup, op12_merkle_manifest, op13_token_alignment,
    )
}

ORACLES = {
    "op3_source_mix": r"""
        WITH RECURSIVE docs AS (
            SELECT row_number() OVER () AS r, doc_id, source,
                   len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
        ), sums AS (
            SELECT source, sum(size)::BIGINT AS source_size, 3.0::DOUBLE * sum(size)::DOUBLE AS cap,
                   ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w
            FROM docs GROUP BY source
        ), levels AS (
            SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER f, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER f, 0)) AS level
            FROM sums WINDOW f AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), targets AS (
            SELECT source AS s, source_size,
                   least(cap, coalesce((SELECT level FROM levels WHERE level <= cap / w ORDER BY cap / w, source NULLS LAST LIMIT 1) * w, cap)) AS target
            FROM levels
        ), plan AS (
            SELECT *, greatest(target - whole * source_size, 0) AS need, coalesce(greatest(target - whole * source_size, 0) / nullif(source_size, 0), 0) AS part
            FROM (SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0)::INTEGER AS whole FROM targets)
        ), drawn AS (
            SELECT *, (('0x' || substr(md5(concat_ws('|', 'mix', coalesce(doc_id::VARCHAR, ''), coalesce(source, ''), size::VARCHAR)), 1, 13))::BIGINT + 0.5) / 4503599627370496.0::DOUBLE AS u
            FROM docs JOIN plan ON s IS NOT DISTINCT FROM source
        ), ranked AS (
            SELECT *, row_number() OVER o AS rn, sum(size) OVER o AS upto
            FROM (SELECT *, u * (1 - part) / (u * (1 - part) + part * (1 - u)) AS v FROM drawn)
            WINDOW o AS (PARTITION BY source ORDER BY v, doc_id NULLS LAST, size, r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
        ), heads AS (
            SELECT source AS h, coalesce(max(rn) FILTER (upto <= need), 0) AS head, coalesce(max(upto) FILTER (upto <= need), 0) AS used, max(need) AS need
            FROM ranked GROUP BY source
        ), fill AS (
            SELECT h, head, 0 AS k, (need - used)::DOUBLE AS missing, false AS taken, 0::BIGINT AS size FROM heads
            UNION ALL
            SELECT f.h, head, f.k + 1, CASE WHEN c.size > 0 AND c.size <= missing THEN missing - c.size ELSE missing END, c.size > 0 AND c.size <= missing, c.size
            FROM fill f JOIN ranked c ON c.source IS NOT DISTINCT FROM f.h AND c.rn = head + k + 1
        ), ends AS (
            SELECT h, head, arg_max(missing, k) AS missing, min((size, k)) FILTER (k > 0 AND NOT taken AND size > 0) AS least FROM fill GROUP BY ALL
        ), picked AS (
            SELECT h, head + k AS rn FROM fill WHERE taken
            UNION ALL SELECT h, head + least[2] FROM ends WHERE least[1] < 2 * missing
        )
        SELECT doc_id, size, source_size, target, source, whole + (rn <= head OR p IS NOT NULL)::INTEGER AS copies,
               ((whole + (rn <= head OR p IS NOT NULL)::INTEGER) * size)::BIGINT AS taken
        FROM ranked JOIN heads ON h IS NOT DISTINCT FROM source
        LEFT JOIN (SELECT h AS ph, rn AS p FROM picked) ON ph IS NOT DISTINCT FROM source AND p = rn
    """,
    "op2_exact_top_k": """
        WITH v AS (
            SELECT row_number() OVER () AS r, vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0
              AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), s AS (
            SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
            FROM v q JOIN v c ON q.r <> c.r AND len(q.v) = len(c.v)
            WHERE q.vec_id % 50 = 0
        ), o AS (
            SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST)::INTEGER AS rank FROM s
        )
        SELECT query_id, rank, vec_id, score FROM o WHERE rank <= 5
    """,
    "op10_preference_pairs": """
        WITH conv AS (
            SELECT conv_id, list(struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) ORDER BY turn, role, text) AS t
            FROM conversations GROUP BY conv_id
        ), own AS (
            SELECT conv_id, t, len(t) - nullif(list_position(list_reverse([x.role FOR x IN t]), 'assistant'), 0) + 1 AS at
            FROM conv
        ), pair AS (
            SELECT a.conv_id AS pair_id, a.t AS c,
                   CASE WHEN a.at IS NULL THEN a.t
                        WHEN b.at IS NULL THEN a.t[:a.at - 1] || a.t[a.at + 1:]
                        ELSE a.t[:a.at - 1] || [struct_pack(role := 'assistant', text := b.t[b.at].text)] || a.t[a.at + 1:] END AS r
            FROM own a LEFT JOIN own b ON b.conv_id <> a.conv_id AND b.conv_id // 2 = a.conv_id // 2
        ), sides AS (
            SELECT pair_id, s, unnest(CASE WHEN s = 1 THEN c ELSE r END) AS turn,
                   unnest(range(1, 1 + CASE WHEN s = 1 THEN len(c) ELSE len(r) END)) AS i
            FROM (SELECT pair_id, c, r, s FROM pair, (VALUES (1), (2)) v(s))
        ), said AS (
            SELECT pair_id, s, i, turn.role AS role,
                   '<|turn|>' || replace(turn.role, '<|', '< |') || chr(10) || replace(turn.text, '<|', '< |') || '<|end|>' || chr(10) AS line
            FROM sides
        ), differ AS (
            SELECT pair_id, min(i) FILTER (WHERE n = 1 OR n_turns = 2) AS first_other, max(i) AS longest
            FROM (SELECT pair_id, i, count(*) AS n, count(DISTINCT turn) AS n_turns FROM sides GROUP BY ALL) GROUP BY pair_id
        ), common AS (
            SELECT pair_id, c, r, coalesce(first_other, longest + 1, 1) - 1 AS n FROM pair LEFT JOIN differ USING (pair_id)
        ), laid AS (
            SELECT said.*, n, i > n AS own,
                   sum(CASE WHEN i > n THEN length(line) ELSE 0 END) OVER (PARTITION BY pair_id, s ORDER BY i) AS stop
            FROM said JOIN common USING (pair_id)
        ), glued AS (
            SELECT pair_id,
                   string_agg(line, '' ORDER BY i) FILTER (s = 1 AND NOT own) AS prompt,
                   string_agg(line, '' ORDER BY i) FILTER (s = 1 AND own) AS chosen,
                   string_agg(line, '' ORDER BY i) FILTER (s = 2 AND own) AS rejected,
                   string_agg(((stop - length(line) + 18)::BIGINT) || ':' || ((stop - 1)::BIGINT), ',' ORDER BY i)
                       FILTER (s = 1 AND own AND role = 'assistant') AS chosen_mask,
                   string_agg(((stop - length(line) + 18)::BIGINT) || ':' || ((stop - 1)::BIGINT), ',' ORDER BY i)
                       FILTER (s = 2 AND own AND role = 'assistant') AS rejected_mask
            FROM laid GROUP BY pair_id
        )
        SELECT pair_id, n::INTEGER AS n_common, coalesce(prompt, '') AS prompt, coalesce(chosen, '') AS chosen,
               coalesce(rejected, '') AS rejected, coalesce(chosen_mask, '') AS chosen_mask, coalesce(rejected_mask, '') AS rejected_mask,
               (len(c) - n)::INTEGER AS n_chosen, (len(r) - n)::INTEGER AS n_rejected
        FROM common LEFT JOIN glued USING (pair_id)
    """,
    "op11_line_dedup": r"""
        WITH docs AS (
            SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
        ), places AS (
            SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i,
                   trim(translate(unnest(lines), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                        concat(chr(32), chr(9), chr(10), chr(11), chr(12), chr(13))) AS key
            FROM docs
        ), frequent AS (
            SELECT key FROM places WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10
        )
        SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (f.key IS NULL), '')) AS kept_sha256
        FROM places LEFT JOIN frequent f USING (key) GROUP BY r, doc_id
    """,
    "op12_merkle_manifest": r"""
        WITH RECURSIVE parts AS (
            SELECT row_number() OVER () AS r, doc_id, source,
                   concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
                          coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head,
                   text, replace(text, chr(10), '') AS flat,
                   xor(list_reduce(list_concat([4294967295::BIGINT], flatten([[ord(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0] FOR c IN string_split(doc_id::VARCHAR, '')])),
                       lambda c, b: xor(xor(c, b) >> 1, (xor(c, b) & 1) * 3988292384)), 4294967295) AS crc
            FROM documents
        ), leaves AS (
            SELECT r, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
                   CASE WHEN crc % 2 = 0 THEN sha256(head || coalesce(strlen(flat) || ':' || flat, '-')) END AS tampered
            FROM parts
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS pos,
                   dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree
            FROM leaves
        ), own(tree, k, h) AS (
            SELECT tree, 0, list(leaf ORDER BY pos) FROM placed GROUP BY tree
            UNION ALL
            SELECT tree, k + 1, [sha256(array_to_string(h[3 * i + 1:3 * i + 3], '')) FOR i IN range((len(h) + 2) // 3)] FROM own WHERE len(h) > 1
        ), subroots AS (SELECT tree, max(k) AS height, arg_max(h, k)[1] AS subroot FROM own GROUP BY tree),
        over(k, h) AS (
            SELECT 0, list(subroot ORDER BY tree) FROM subroots
            UNION ALL
            SELECT k + 1, [sha256(array_to_string(h[3 * i + 1:3 * i + 3], '')) FOR i IN range((len(h) + 2) // 3)] FROM over WHERE len(h) > 1
        ), lines AS (
            SELECT tree, k, height, h FROM own JOIN subroots USING (tree) WHERE k < height
            UNION ALL
            SELECT tree, height + k, height, h FROM over, subroots WHERE k < (SELECT max(k) FROM over)
        ), climb(r, tree, k, pos, folded, proof) AS (
            SELECT r, tree, 0, pos, coalesce(tampered, leaf), '' FROM placed
            UNION ALL
            SELECT r, tree, k + 1, p // 3,
                   sha256(array_to_string([CASE WHEN i = p THEN folded ELSE h[i + 1] END FOR i IN range(p // 3 * 3, least(len(h), p // 3 * 3 + 3))], '')),
                   proof || array_to_string([h[i + 1] FOR i IN range(p // 3 * 3, least(len(h), p // 3 * 3 + 3)) IF i <> p], '')
            FROM (
                SELECT c.r, c.tree, c.k, CASE WHEN c.k = height THEN c.tree ELSE c.pos END AS p, folded, proof, h
                FROM climb c JOIN lines l ON l.tree = c.tree AND l.k = c.k
            )
        ), ends AS (SELECT r, arg_max(folded, k) AS folded_root, arg_max(proof, k) AS proof FROM climb GROUP BY r)
        SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded_root, folded_root = root AS verified
        FROM placed JOIN subroots USING (tree) JOIN ends USING (r), (SELECT arg_max(h, k)[1] AS root FROM over)
    """,
}
