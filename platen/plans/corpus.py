"""Queries on documents as bytes: intake, sniffing, measurement, runs over the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.lang import lookup
from ..functions.sniff import SNIFF_TO_TYPE, intake_mismatch, printable_ratio, sniff
from ..functions.text import base64_bytes, latin1_bytes, latin1_text, utf8_text
from ..operators import evidence, intake, runs, traps
from ..operators.definitions import DOCUMENT_TYPES
from ..sources import views
from . import sql
from .chains import hits_text
from .registry import query

_SNIFF_MAP = "MAP {" + ", ".join(f"{sql.q(k)}: {sql.q(v)}" for k, v in SNIFF_TO_TYPE.items()) + "}"
_WANT_INTAKE = "CASE declared_type WHEN 'docx' THEN 'zip' WHEN 'png' THEN 'png' WHEN 'pdf' THEN 'pdf' WHEN 'zip' THEN 'zip' WHEN 'xlsx' THEN 'zip' END"
_WANT = "CASE declared_type WHEN 'docx' THEN 'zip' WHEN 'png' THEN 'png' WHEN 'pdf' THEN 'pdf' WHEN 'zip' THEN 'zip' WHEN 'avif' THEN 'avif' END"


@query(
    "magic_sniff",
    f"WITH {sql.SNIFFED} SELECT doc_id, kind AS type, magic, kind NOT IN ('text', 'unknown') AS confident, round(ratio, 9) AS ratio FROM seen",
)
def magic_sniff(spark: SparkSession, d: str) -> DataFrame:
    seen = views.artifacts(spark, d).withColumn("s", sniff(F.col("content")))
    return seen.select("doc_id", "s.type", "s.magic", "s.confident", F.round(printable_ratio(F.col("content")), 9).alias("ratio"))


@query(
    "mislabel_counts",
    f"""WITH {sql.SNIFFED}
    SELECT declared_type, kind AS sniffed, count(*) AS n_docs,
           count(*) FILTER (coalesce({_WANT_INTAKE} <> kind, false)) AS n_mismatch
    FROM seen GROUP BY ALL""",
)
def mislabel_counts(spark: SparkSession, d: str) -> DataFrame:
    seen = views.artifacts(spark, d).select("declared_type", sniff(F.col("content"))["type"].alias("sniffed"))
    wrong = intake_mismatch(F.col("declared_type"), F.col("sniffed"))
    return seen.groupBy("declared_type", "sniffed").agg(
        F.count(F.lit(1)).alias("n_docs"), F.count_if(wrong).alias("n_mismatch")
    )


_PREFIX_TEXT = """[chr(65533) || 'PNG' || chr(13) || chr(10) || chr(26) || chr(10), 'PK' || chr(3) || chr(4), '%PDF-1.7', repeat(chr(65533), 4),
  'GIF89a', repeat(chr(0), 3) || ' ftypavif' || repeat(chr(0), 2), '', '<?xml ']"""


@query(
    "document_scan",
    f"""WITH {sql.ARTIFACTS}
    SELECT a.doc_id, declared_type AS type, CASE WHEN declared_type IN ('txt', 'html') THEN
      CASE WHEN hx = '' THEN '' ELSE {_PREFIX_TEXT}[1 + a.doc_id % 8] || text END END AS text
    FROM artifacts a JOIN documents USING (doc_id)""",
)
def document_scan(spark: SparkSession, d: str) -> DataFrame:
    """Artifacts as typed documents; the text types carry their decoded bytes, invalid ones replaced."""
    return intake.load_documents(views.artifacts(spark, d)).select("doc_id", "type", "text")


@query(
    "gate_refusals",
    f"""WITH {sql.SNIFFED}
    SELECT doc_id, CASE WHEN kind <> 'zip' THEN 'ZIP wanted, found ' || magic END AS zip_error,
           CASE WHEN kind <> 'pdf' THEN 'signature "' || magic || '"' END AS pdf_note FROM seen""",
)
def gate_refusals(spark: SparkSession, d: str) -> DataFrame:
    return views.artifacts(spark, d).select(
        "doc_id",
        evidence.gate(F.col("content"), "zip")["error"].alias("zip_error"),
        evidence.gate(F.col("content"), "pdf")["note"].alias("pdf_note"),
    )


@query(
    "output_checks",
    f"""WITH {sql.SNIFFED}
    SELECT doc_id, CASE WHEN {_WANT_INTAKE} <> kind THEN 'expected ' || upper({_WANT_INTAKE}) || ' magic, got "' || magic || '"' END AS note
    FROM seen""",
)
def output_checks(spark: SparkSession, d: str) -> DataFrame:
    return views.artifacts(spark, d).select(
        "doc_id", evidence.output_mismatch(F.col("content"), F.col("declared_type")).alias("note")
    )


@query(
    "artifact_measurement",
    f"""WITH {sql.SNIFFED}
    SELECT doc_id, n_bytes,
      CASE WHEN n_bytes = 0 THEN 'measured: no bytes' END AS empty_output,
      CASE WHEN n_bytes > 0 AND {_WANT} <> kind THEN 'declared ' || declared_type || ', signature "' || magic || '" (measured)' END AS magic_mismatch
    FROM (SELECT * REPLACE (CASE WHEN doc_id % 100 = 7 AND n_bytes > 0 THEN n_bytes + 700000 ELSE n_bytes END AS n_bytes) FROM seen)""",
)
def artifact_measurement(spark: SparkSession, d: str) -> DataFrame:
    """Every hundredth artifact is 700 KB longer: size makes no difference."""
    tail = F.encode(F.repeat(F.lit("x"), 700_000), "UTF-8")
    long = (F.col("doc_id") % 100 == 7) & (F.octet_length("content") > 0)
    artifacts = views.artifacts(spark, d).withColumn("content", F.when(long, F.concat("content", tail)).otherwise(F.col("content")))
    measured = evidence.with_measurement(artifacts)
    return measured.select(
        "doc_id", F.octet_length("content").alias("n_bytes"),
        F.try_element_at("measured", F.lit("emptyOutput")).alias("empty_output"),
        F.try_element_at("measured", F.lit("magicMismatch")).alias("magic_mismatch"),
    )


@query(
    "image_headers",
    """WITH h AS (SELECT doc_id, doc_id % 13 <> 12 AS whole, 1 + doc_id * 37 % 9000 AS w, 1 + doc_id * 101 % 9000 AS h FROM documents)
    SELECT doc_id, CASE WHEN whole THEN w END AS width, CASE WHEN whole THEN h END AS height,
      CASE WHEN whole THEN w * h * 4 END AS stride_bytes,
      CASE WHEN whole THEN round(w * h * 4 / 24.0, 4) ELSE 0.0 END AS inflation,
      whole AND w * h * 4 > 67108864 AS stride_warn FROM h""",
)
def image_headers(spark: SparkSession, d: str) -> DataFrame:
    audited = evidence.header_audit(views.image_headers(spark, d))
    return audited.select(
        "doc_id", "dims.width", "dims.height", "stride_bytes", F.round("inflation", 4).alias("inflation"), "stride_warn"
    )


@query(
    "document_sizes",
    f"""WITH {sql.SNIFFED}
    SELECT doc_id, n_bytes AS bytes, magic FROM seen
    UNION ALL SELECT -1 - doc_id, strlen(text), 'text' FROM documents""",
)
def document_sizes(spark: SparkSession, d: str) -> DataFrame:
    stored = views.artifacts(spark, d).select("doc_id", "content", F.lit(None).cast("string").alias("text"))
    typed = views.table(spark, d, "documents").select(
        (-1 - F.col("doc_id")).alias("doc_id"), F.lit(None).cast("binary").alias("content"), "text"
    )
    return intake.document_sizes(stored.unionByName(typed)).select("doc_id", "bytes", "magic")


@query(
    "artifact_summaries",
    f"""WITH {sql.SNIFFED}
    SELECT doc_id, declared_type AS type, n_bytes AS bytes, magic, kind AS magic_type, n_bytes = 0 AS empty,
      CASE WHEN kind = 'png' AND n_bytes >= 24 THEN CAST('0x' || substr(hx, 33, 8) AS BIGINT) END AS width,
      declared_type <> 'txt' AS goal_type_mismatch FROM seen""",
)
def artifact_summaries(spark: SparkSession, d: str) -> DataFrame:
    docs = views.artifacts(spark, d).select(
        "doc_id", F.col("declared_type").alias("type"), "content", F.lit(None).cast("string").alias("text")
    )
    summary = intake.artifact_summary(docs, F.lit("txt"))
    return summary.select("doc_id", "type", "bytes", "magic", "magic_type", "empty", "dims.width", "goal_type_mismatch")


@query(
    "text_previews",
    "SELECT doc_id, left(text, 240) AS preview, length(text) AS chars FROM documents",
)
def text_previews(spark: SparkSession, d: str) -> DataFrame:
    docs = views.table(spark, d, "documents").select(
        "doc_id", F.lit("txt").alias("type"), F.lit(None).cast("binary").alias("content"), "text"
    )
    return intake.artifact_summary(docs).select("doc_id", "preview", "chars")


# ------------------------------------------------------------------- uploads

_UPLOAD_SQL = """requests AS (
  SELECT doc_id,
    CASE doc_id % 10 WHEN 0 THEN 'bad name!' WHEN 1 THEN repeat('n', 41) ELSE 'doc-' || doc_id % 37 END AS name,
    CASE WHEN doc_id % 10 = 2 THEN '%%%not-base64%%%' WHEN doc_id % 3 = 0 THEN 'data:x;base64,' || base64(encode(text)) END AS b64,
    CASE WHEN doc_id % 3 <> 0 AND doc_id % 10 <> 2 OR doc_id % 10 = 3 THEN CASE WHEN doc_id % 10 = 4 THEN '' ELSE text END END AS text,
    CASE doc_id % 7 WHEN 0 THEN 'docx' WHEN 1 THEN 'martian' WHEN 2 THEN 'txt' END AS type, text AS body
  FROM documents),
checked AS (
  SELECT *, CASE WHEN NOT regexp_full_match(name, '[A-Za-z0-9._-]{1,40}') THEN 'a name has 1 to 40 characters out of A-Z a-z 0-9 . _ -'
    WHEN (b64 IS NOT NULL) = (text IS NOT NULL) THEN 'content is wanted once, as base64 or as text'
    WHEN b64 LIKE '\\%%' ESCAPE '\\' THEN 'the base64 content cannot be decoded'
    WHEN text = '' THEN 'the document holds no bytes'
    WHEN type = 'martian' THEN 'unknown type; known are TYPES' END AS error
  FROM requests)""".replace("TYPES", " | ".join(DOCUMENT_TYPES))


def upload_requests(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    text = F.col("body")
    return (
        views.table(spark, d, "documents")
        .withColumnRenamed("text", "body")
        .select(
            "doc_id",
            F.when(i % 10 == 0, "bad name!").when(i % 10 == 1, "n" * 41)
            .otherwise(F.concat(F.lit("doc-"), (i % 37).cast("string"))).alias("name"),
            F.when(i % 10 == 2, "%%%not-base64%%%")
            .when(i % 3 == 0, F.concat(F.lit("data:x;base64,"), F.base64(F.encode(text, "UTF-8")))).alias("b64"),
            F.when(((i % 3 != 0) & (i % 10 != 2)) | (i % 10 == 3), F.when(i % 10 == 4, "").otherwise(text)).alias("text"),
            F.when(i % 7 == 0, "docx").when(i % 7 == 1, "martian").when(i % 7 == 2, "txt").alias("type"),
        )
    )


@query(
    "upload_quarantine",
    f"""WITH {_UPLOAD_SQL}
    SELECT doc_id, CASE WHEN error IS NOT NULL THEN 'invalid_param' END AS code, error AS message,
      CASE WHEN error IS NULL THEN strlen(body) END AS bytes,
      CASE WHEN error IS NULL AND type IS NOT NULL THEN type END AS given_type,
      CASE WHEN error IS NULL THEN coalesce(type, 'x') = 'docx' END AS mismatch
    FROM checked""",
)
def upload_quarantine(spark: SparkSession, d: str) -> DataFrame:
    checked = intake.check_uploads(upload_requests(spark, d))
    return checked.select(
        "doc_id", F.col("error.code").alias("code"), F.col("error.message").alias("message"),
        F.octet_length("content").alias("bytes"),
        F.when(F.col("error").isNull(), F.col("type")).alias("given_type"), "mismatch",
    )


@query(
    "upload_upserts",
    f"""WITH {_UPLOAD_SQL}
    SELECT name, max(doc_id) AS doc_id, strlen(max_by(body, doc_id)) AS bytes FROM checked WHERE error IS NULL GROUP BY name""",
)
def upload_upserts(spark: SparkSession, d: str) -> DataFrame:
    accepted, _ = intake.split_quarantine(intake.check_uploads(upload_requests(spark, d)))
    sized = accepted.select("name", "doc_id", F.octet_length("content").alias("bytes"))
    return intake.latest_by_name(sized, "name", "doc_id").select("name", "doc_id", "bytes")


@query(
    "declared_defaults",
    f"""WITH {sql.SNIFFED}
    SELECT doc_id, {_SNIFF_MAP}[kind] AS type FROM seen""",
)
def declared_defaults(spark: SparkSession, d: str) -> DataFrame:
    kind = sniff(F.col("content"))["type"]
    return views.artifacts(spark, d).select("doc_id", F.coalesce(lookup(SNIFF_TO_TYPE, kind), F.lit("unknown")).alias("type"))


@query(
    "codec_round_trips",
    f"""SELECT doc_id, base64(encode(text)) AS b64, {sql.replace_all('text', '[^' + chr(92) + 'x00-' + chr(92) + 'x{ff}]', '?')} AS latin1,
      md5(text) AS digest FROM documents""",
)
def codec_round_trips(spark: SparkSession, d: str) -> DataFrame:
    encoded = F.base64(F.encode("text", "UTF-8"))
    back = utf8_text(base64_bytes(F.concat(F.lit("data:text/plain;base64, "), F.unbase64(F.base64(F.encode(encoded, "UTF-8"))).cast("string"))))
    return views.table(spark, d, "documents").select(
        "doc_id", F.regexp_replace(encoded, r"\s+", "").alias("b64"), latin1_text(latin1_bytes(F.col("text"))).alias("latin1"),
        F.md5(F.encode(back, "UTF-8")).alias("digest"),
    )


@query(
    "setting_effects",
    """WITH outputs AS (
      SELECT doc_id, text AS body FROM documents
      UNION ALL SELECT doc_id, CASE lang WHEN 'en' THEN text WHEN 'fr' THEN replace(text, 'e', 'i') ELSE text || '.' END FROM documents)
    SELECT doc_id AS artifact_id, count(*) AS n_settings, min(strlen(body)) = max(strlen(body)) AS same_length,
           min(md5(body)) = max(md5(body)) AS same_bytes
    FROM outputs GROUP BY doc_id""",
)
def setting_effects(spark: SparkSession, d: str) -> DataFrame:
    """Two outputs per artifact; whether the second differs depends on the language."""
    docs = views.table(spark, d, "documents")
    second = (
        F.when(F.col("lang") == "en", F.col("text"))
        .when(F.col("lang") == "fr", F.replace("text", F.lit("e"), F.lit("i")))
        .otherwise(F.concat("text", F.lit(".")))
    )
    both = docs.select(F.col("doc_id").alias("artifact_id"), F.explode(F.array("text", second)).alias("body"))
    return evidence.knob_effect(both.select("artifact_id", F.encode("body", "UTF-8").alias("content")))


# ----------------------------------------------------------------- corpus runs


def text_documents(spark: SparkSession, d: str) -> DataFrame:
    return views.table(spark, d, "documents").select(
        "doc_id", F.lit("txt").alias("type"), F.encode("text", "UTF-8").alias("content"), "text"
    )




@query(
    "corpus_run_log",
    f"""WITH marked AS (
      SELECT doc_id, text, {sql.replace_all('text', '([.!?])[' + chr(92) + 't-' + chr(92) + 'r ]+', chr(92) + '1' + chr(10))} AS cut FROM documents),
    lead AS (
      SELECT doc_id, text, array_to_string(list_filter(list_transform(string_split_regex(cut, '\\n+'),
        lambda s: {sql.trim('s')}), lambda s: length(s) > 12)[1:2], ' ') AS two FROM marked),
    summary AS (SELECT doc_id, text, CASE WHEN two = '' THEN left(text, 160) ELSE two END || chr(10) AS s FROM lead)
    SELECT doc_id, 1 AS step, 'summarize' AS tool_id, true AS ok, strlen(text) AS bytes_in, strlen(s) AS bytes_out, NULL AS error FROM summary
    UNION ALL SELECT doc_id, 2, 'docx-text', false, NULL, NULL,
      'docx → text wants ZIP, found no known signature' FROM summary""",
)
def corpus_run_log(spark: SparkSession, d: str) -> DataFrame:
    """Summarise, then a step that refuses text, then one that must not run any more."""
    results = runs.run_chain(text_documents(spark, d), ["summarize", "docx-text", "text-md"], "txt")
    return runs.step_log(results).select("doc_id", "step", "tool_id", "ok", "bytes_in", "bytes_out", "error")


@query(
    "corpus_run_verdicts",
    f"""WITH {sql.SNIFFED}, judged AS (
      SELECT *, CASE WHEN n_bytes = 0 THEN 'T04:measured' END AS t04, CASE WHEN doc_id % 6 = 0 THEN 'T05:claimed' END AS t05,
        CASE WHEN n_bytes > 0 AND {_WANT} <> kind THEN 'T13:measured' WHEN kind <> 'zip' THEN 'T13:claimed' END AS t13 FROM seen)
    SELECT doc_id, concat_ws(',', t04, t05, t13) AS hits,
      100 - CASE WHEN t04 IS NULL THEN 0 ELSE 30 END - CASE WHEN t05 IS NULL THEN 0 ELSE 15 END - CASE WHEN t13 IS NULL THEN 0 ELSE 30 END AS score,
      CASE WHEN kind <> 'zip' THEN CASE WHEN doc_id % 6 = 1 THEN 'seen by the caller' ELSE 'declared ' || declared_type || ', signature "' || magic || '"' END END AS note,
      CASE WHEN kind = 'zip' THEN 'no archive: its directory is missing' ELSE 'docx → text wants ZIP, found ' || magic END AS error,
      false AS ok FROM judged""",
)
def corpus_run_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Read all artifacts as word packages, and judge every run by its bytes, its notes and what the caller claims.

    None of them is one: most fail at the signature, those with the right one at the missing directory.
    """
    i = F.col("doc_id")
    docs = intake.load_documents(views.artifacts(spark, d).select("doc_id", "declared_type", "content"))
    done = runs.run_chain(docs, ["docx-text"])
    none = F.expr("cast(map() as map<string,string>)")
    claims = (
        F.when(i % 6 == 0, F.create_map(F.lit("cellErrors"), F.lit("2 cells")))
        .when((i % 6 == 1) & F.map_contains_key("notes", "magicMismatch"), F.create_map(F.lit("magicMismatch"), F.lit("seen by the caller")))
        .otherwise(none)
    )
    results = runs.run_evidence(done.withColumn("claims", claims))
    steps = F.array(F.struct(F.lit("docx-text").alias("tool_id"), none.alias("params")))
    judged = traps.score_chains(
        results.withColumns({"steps": steps, "input_type": F.lit("docx"), "output_type": F.lit("txt")})
    )
    return judged.select(
        "doc_id", hits_text().alias("hits"), "score", F.try_element_at("claimed", F.lit("magicMismatch")).alias("note"),
        F.get("log", F.lit(0))["error"].alias("error"), "ok",
    )


@query(
    "success_audits",
    f"""WITH {sql.SNIFFED}
    SELECT doc_id, doc_id % 4 <> 3 AND n_bytes = 0 AS empty_output, doc_id % 4 <> 3 AND n_bytes > 0 AND coalesce({_WANT} <> kind, false) AS mislabelled,
      CASE WHEN doc_id % 4 <> 3 AND doc_id % 5 > 0 THEN (doc_id % 5) || ' cell(s) with an error value under a success flag' END AS cell_errors FROM seen""",
)
def success_audits(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes that claim success beside what they left: nothing, the wrong bytes, cells with errors."""
    outcomes = views.artifacts(spark, d).withColumns(
        {"success": F.col("doc_id") % 4 != 3, "errors_found": (F.col("doc_id") % 5).cast("int")}
    )
    noted = lambda key: F.map_contains_key("notes", key)
    return evidence.success_audit(outcomes).select(
        "doc_id", noted("emptyOutput").alias("empty_output"), noted("magicMismatch").alias("mislabelled"),
        F.try_element_at("notes", F.lit("cellErrors")).alias("cell_errors"),
    )


@query(
    "silent_empties",
    f"""WITH {sql.SNIFFED}, given AS (
      SELECT doc_id, declared_type IN ('txt', 'html') AND n_bytes > 0 AS has_text FROM seen)
    SELECT doc_id, NOT has_text AS empty_summary, NOT has_text AS empty_table, true AS ok FROM given""",
)
def silent_empties(spark: SparkSession, d: str) -> DataFrame:
    """Steps that succeed on nothing: binary or empty artifacts summarised, then read as a table."""
    docs = intake.load_documents(views.artifacts(spark, d).select("doc_id", "declared_type", "content"))
    first = runs.run_chain(docs.withColumns({"_text": F.col("text"), "_content": F.col("content"), "_type": F.col("type")}).withColumnsRenamed(
        {"_text": "given_text", "_content": "given_content", "_type": "given_type"}), ["summarize"], "txt")
    noted = F.map_contains_key(F.get("log", F.lit(0))["notes"], "emptyResult")
    kept = first.select(
        "doc_id", "ok", noted.alias("empty_summary"), F.col("given_text").alias("text"), F.col("given_content").alias("content"),
        F.col("given_type").alias("type"),
    ).withColumnRenamed("ok", "summary_ok")
    second = runs.run_chain(kept, ["csv-md"], "csv")
    return second.select("doc_id", "empty_summary", noted.alias("empty_table"), F.col("summary_ok").alias("ok"))


@query(
    "evidence_cleaning",
    """SELECT event_id, CASE WHEN value > 50 THEN repeat('note ', CAST(floor(value) AS INTEGER)) END AS long_note, event_type AS other_note,
      event_type <> 'view' AS has_flag, 1 + (value > 50)::INT + (event_type <> 'view')::INT AS n_keys FROM events""",
)
def evidence_cleaning(spark: SparkSession, d: str) -> DataFrame:
    """Two notes whose long keys differ at the end only, a long value, a flag that may be false, and an empty one."""
    key = "k" * 45
    events = views.table(spark, d, "events")
    notes = F.create_map(
        F.lit(key), F.when(F.col("value") > 50, F.repeat(F.lit("note "), F.floor("value").cast("int"))),
        F.lit(key + "2"), F.col("event_type"),
        F.lit("flag"), F.when(F.col("event_type") == "view", "false").otherwise("true"),
        F.lit("blank"), F.lit(""),
    )
    cleaned = events.select("event_id", traps.clean_notes(notes).alias("n"))
    return cleaned.select(
        "event_id", F.try_element_at("n", F.lit(key)).alias("long_note"), F.try_element_at("n", F.lit(key + "2")).alias("other_note"),
        F.map_contains_key("n", "flag").alias("has_flag"), F.size("n").alias("n_keys"),
    )
