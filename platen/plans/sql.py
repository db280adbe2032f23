"""SQL text for the reference results: shared table expressions and scalar snippets."""

from __future__ import annotations

from itertools import count

from ..functions.text import ENTITY, NAMED_ENTITIES, WS
from ..operators.catalog import GOAL_TYPES, INPUTS, ROUTES, TRANSFORMS, TRAPS, WEIGHTS
from ..operators.traps import EXTENSION_DISPATCH, KNOWN_INPUTS, NOTE_KEYS, PACKAGE_TYPES, RASTER_TOOLS
from ..sources.views import CLAIM_KEYS, DECLARED_TYPES, EVENT_TYPES, INPUT_TYPES, ORIGINS, SIGNATURE_HEX, SLOTS

_names = count()


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strings(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def in_list(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def var() -> str:
    return f"v{next(_names)}"


def let(value: str, body) -> str:
    v = var()
    return f"list_transform([{value}], lambda {v}: {body(v)})[1]"


def trim(x: str) -> str:
    return f"regexp_replace({x}, {q(f'^{WS}+|{WS}+$')}, '', 'g')"


def replace_all(x: str, pattern: str, to: str, flags: str = "g") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(to)}, {q(flags)})"


def map_matches(x: str, pattern: str, body, group: int = 1) -> str:
    """Replace matches by an expression over one capture."""

    def build(s: str) -> str:
        v = var()
        return (
            f"array_to_string(list_transform(list_zip(string_split_regex({s}, {q(pattern)}), "
            f"regexp_extract_all({s}, {q(pattern)}, {group})), "
            f"lambda {v}: {v}[1] || CASE WHEN {v}[2] IS NULL THEN '' ELSE {body(f'{v}[2]')} END), '')"
        )

    return let(x, build)


def decode(x: str) -> str:
    named = "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in NAMED_ENTITIES.items()) + "}"

    def point(n: str, b: str) -> str:
        return (
            f"CASE WHEN {n} > 1114111 THEN '&' || {b} || ';' WHEN {n} BETWEEN 55296 AND 57343 THEN chr(65533) "
            f"ELSE chr(CAST({n} AS INTEGER)) END"
        )

    def body(b: str) -> str:
        return (
            f"CASE WHEN {b}[1:2] IN ('#x', '#X') THEN {point(f'CAST(concat(chr(48), chr(120), {b}[3:]) AS BIGINT)', b)} "
            f"WHEN {b}[1] = '#' THEN {point(f'CAST({b}[2:] AS BIGINT)', b)} "
            f"ELSE coalesce({named}[lower({b})], '&' || {b} || ';') END"
        )

    return map_matches(x, ENTITY, body)


def escape(x: str) -> str:
    return f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


# ---------------------------------------------------------------- chain tables

CATALOG = "cat(ord, id, label, in_type, out_type, mode) AS (VALUES " + ", ".join(
    f"({i}, {q(t.id)}, {q(t.label)}, {q(t.in_type)}, {q(t.out_type)}, {q(t.mode)})" for i, t in enumerate(TRANSFORMS)
) + ")"
LISTED = "listed(id, trap_id) AS (VALUES " + ", ".join(
    f"({q(t.id)}, {q(x)})" for t in TRANSFORMS for x in t.traps
) + ")"
TRAP_TABLE = "traps(trap_id, severity, weight, title) AS (VALUES " + ", ".join(
    f"({q(t.id)}, {q(t.severity)}, {WEIGHTS[t.severity]}, {q(t.title)})" for t in TRAPS
) + ")"
# The first transform that leads from one type to the other, else the first one that leads half the way.
CONNECTORS = """direct AS (
  SELECT in_type || '>' || out_type AS pair, min_by(id, ord) AS tool FROM cat GROUP BY 1
),
halfway AS (
  SELECT a.in_type || '>' || b.out_type AS pair, min_by(a.id, a.ord) || ' → …' AS tool
  FROM cat a JOIN cat b ON b.in_type = a.out_type GROUP BY 1
),
connectors AS (
  SELECT coalesce(d.pair, h.pair) AS pair, coalesce(d.tool, h.tool) AS tool FROM direct d FULL JOIN halfway h ON d.pair = h.pair
)"""
EDGES = "edges(ord, from_type, to_type, steps) AS (VALUES " + ", ".join(
    f"({i}, {q(a)}, {q(b)}, {q('>'.join(s))})" for i, (a, b, s) in enumerate(ROUTES)
) + ")"
DEFAULT_INPUTS = "inputs(ord, type, document) AS (VALUES " + ", ".join(
    f"({i}, {q(t)}, {q(d)})" for i, (t, d) in enumerate(INPUTS)
) + ")"

STEPS = f"""{CATALOG},
ev AS (
  SELECT *, event_id % 12 AS r, list_position({strings(EVENT_TYPES)}, event_type) - 1 AS kind,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events
),
raw_steps AS (
  SELECT event_id, event_type, ts, k, value,
         event_id // 12 * 4 + CASE WHEN r >= 6 THEN 3 WHEN r >= 3 THEN 2 WHEN r >= 1 THEN 1 ELSE 0 END AS chain_id,
         CAST(r - CASE WHEN r >= 6 THEN 6 WHEN r >= 3 THEN 3 WHEN r >= 1 THEN 1 ELSE 0 END AS INTEGER) AS idx,
         {strings(SLOTS)}[1 + (kind * 6 + CAST(round(value * 100) AS BIGINT)) % {len(SLOTS)}] AS tool_id
  FROM ev
),
steps AS (
  SELECT s.*, c.label, c.in_type, c.out_type, c.mode,
         CASE WHEN tool_id = 'png-resize' THEN CAST(floor(value * 20) AS BIGINT) END AS side,
         CASE WHEN tool_id = 'png-quality' THEN event_id % 100 END AS quality,
         CASE event_id % 7 WHEN 0 THEN 'Latin Modern' WHEN 1 THEN ' Helvetica ' END AS font,
         tool_id = 'docx-pdf-soffice' AND event_id % 2 = 0 AS empty
  FROM raw_steps s LEFT JOIN cat c ON s.tool_id = c.id
),
attrs AS (
  SELECT chain_id, k, ts AS created_at,
         CASE WHEN chain_id % 5 = 0 THEN {strings(INPUT_TYPES)}[1 + chain_id // 5 % 12] END AS input_type,
         CASE WHEN chain_id % 3 = 0 THEN {strings(GOAL_TYPES)}[1 + chain_id // 3 % 8] END AS output_type,
         {strings(ORIGINS)}[1 + chain_id % 3] AS origin,
         CAST(chain_id * 37 % 101 AS DOUBLE) AS self_score,
         chain_id % 10 = 0 AS m_magicMismatch, chain_id % 11 = 0 AS m_emptyOutput,
         {strings(CLAIM_KEYS)}[1 + k % 9] AS claim
  FROM raw_steps WHERE idx = 0
)"""


def _has(*tools: str) -> str:
    return f"bool_or(tool_id IN {in_list(tools)})"


def _before(a: str, b: str) -> str:
    return f"coalesce(min(idx) FILTER (tool_id = {q(a)}) < max(idx) FILTER (tool_id = {q(b)}), false)"


FACT_ROWS = f"""facts AS (
  SELECT chain_id, count(*) AS n_steps,
         {_before('pdf-rasterize', 'ocr')} AS raster_ocr, {_before('ocr', 'summarize')} AS ocr_summary,
         {_has(*EXTENSION_DISPATCH)} AS by_extension, {_has(*RASTER_TOOLS)} AS raster,
         {_has('rename-avif')} AS avif, {_has('docx-pdf-soffice')} AS soffice, {_has('xlsx-recalc')} AS recalc,
         {_has('png-quality')} AS png_quality, {_has('pdf-text')} AS pdf_text, {_has('summarize', 'md-html')} AS consumer,
         {_has('png-tables')} AS tables, {_has('ocr')} AS ocr, {_has('ocr', 'pdf-rasterize')} AS scanned,
         {_has('png-quality', 'ocr')} AS lossy,
         bool_or(quality IS NOT NULL) AS quality,
         coalesce(bool_or(side * side * 4 > 67108864), false) AS oversized,
         bool_or(font IS NOT NULL AND lower(replace(font, ' ', '')) <> 'helvetica') AS foreign_font,
         count(*) FILTER (out_type IN {in_list(PACKAGE_TYPES)}) AS packages,
         coalesce(bool_or(out_type = 'csv-of-tables'), false) AS makes_tables,
         first(in_type ORDER BY idx) AS first_in, last(out_type ORDER BY idx) AS last_out
  FROM steps GROUP BY chain_id
)"""

FACTS = f"""{STEPS},
{FACT_ROWS},
judged AS (
  SELECT f.*, a.* EXCLUDE (chain_id), coalesce(input_type, first_in) AS it, coalesce(output_type, last_out) AS ot
  FROM facts f JOIN attrs a USING (chain_id)
)"""

PLAN_SQL = {
    "T01": "raster_ocr",
    "T02": "by_extension",
    "T03": "(avif OR (it IS NOT DISTINCT FROM ot AND n_steps > 1 AND raster))",
    "T04": "soffice",
    "T05": "recalc",
    "T06": "(png_quality OR quality)",
    "T07": "(pdf_text AND consumer)",
    "T08": "oversized",
    "T09": "(tables OR ocr_summary OR (ocr AND makes_tables))",
    "T10": "foreign_font",
    "T11": "packages > 2",
    "T12": f"NOT coalesce(it IN {in_list(KNOWN_INPUTS)}, false)",
    "T13": "false",
    "T14": "(scanned AND coalesce(ot IN ('csv', 'csv-of-tables'), false))",
    "T15": "(lossy AND it IS NOT DISTINCT FROM ot)",
}


def verdict_sql(source: str, measured: bool = True, claimed: bool = True) -> str:
    """``basis``, ``scored`` and ``hits`` table expressions over a table of facts."""
    cases = []
    for t in TRAPS:
        parts = [f"WHEN {PLAN_SQL[t.id]} THEN 'plan'"]
        key = NOTE_KEYS.get(t.id)
        if key and measured and key in ("magicMismatch", "emptyOutput"):
            parts.append(f"WHEN m_{key} THEN 'measured'")
        if key and claimed:
            parts.append(f"WHEN claim = {q(key)} THEN 'claimed'")
        cases.append(f"CASE {' '.join(parts)} END AS b{t.id}")
    fired = {t.id: f"b{t.id}" for t in TRAPS}
    fired["T14"] = "CASE WHEN bT09 IS NULL THEN bT14 END"
    penalty = " + ".join(f"CASE WHEN {fired[t.id]} IS NOT NULL THEN {WEIGHTS[t.severity]} ELSE 0 END" for t in TRAPS)
    hits = ", ".join(f"{q(t.id + ':')} || ({fired[t.id]})" for t in TRAPS)
    return f"""basis AS (SELECT *, {', '.join(cases)} FROM {source}),
scored AS (
  SELECT *, {penalty} AS penalty, concat_ws(',', {hits}) AS hits FROM basis
),
verdict AS (
  SELECT *, greatest(0, 100 - penalty) AS score,
         greatest(0.0, least(5.0, floor(greatest(0, 100 - penalty) / 10.0 + 0.5) / 2)) AS stars
  FROM scored
)"""


VERDICT = f"{FACTS},\n{verdict_sql('judged')}"
HITS = """hits AS (
  SELECT chain_id, split_part(h, ':', 1) AS trap_id, split_part(h, ':', 2) AS basis
  FROM (SELECT chain_id, unnest(string_split(hits, ',')) AS h FROM verdict WHERE hits <> '')
)"""

# ------------------------------------------------------------------ artifacts

ARTIFACTS = f"""artifacts AS (
  SELECT doc_id, 'doc-' || doc_id AS name, {strings(DECLARED_TYPES)}[1 + doc_id % 7] AS declared_type,
         CASE WHEN doc_id % 50 = 49 THEN '' ELSE {strings(SIGNATURE_HEX)}[1 + doc_id % 8] || hex(encode(text)) END AS hx
  FROM documents
)"""

_LETTER = {c: f"({ord(c.upper()):02X}|{ord(c):02X})" for c in "xmlhtdocype"}
_PROLOG = (
    "^(09|0A|0B|0C|0D|20|A0)*3C(3F" + "".join(_LETTER[c] for c in "xml") + "|" + "".join(_LETTER[c] for c in "html")
    + "|21" + "".join(_LETTER[c] for c in "doctype") + ")"
)

SNIFFED = f"""{ARTIFACTS},
ratios AS (
  SELECT *, length(hx) // 2 AS n_bytes,
         CASE WHEN hx = '' THEN 0.0 ELSE CAST(len(list_filter(regexp_extract_all(left(hx, 1024), '..'),
           lambda b: b IN ('09', '0A', '0D') OR (b >= '20' AND b <= '7E'))) AS DOUBLE)
           / (least(length(hx), 1024) // 2) END AS ratio
  FROM artifacts
),
sniffed AS (
  SELECT *,
    CASE WHEN hx LIKE '89504E470D0A1A0A%' THEN 'png' WHEN hx LIKE '504B0304%' OR hx LIKE '504B504B%' THEN 'zip'
         WHEN hx LIKE '25504446%' THEN 'pdf' WHEN hx LIKE 'FFD8FF%' THEN 'jpeg' WHEN hx LIKE '47494638%' THEN 'gif'
         WHEN substr(hx, 9, 16) = '6674797061766966' THEN 'avif'
         WHEN regexp_matches(hx, {q(_PROLOG)}) THEN 'xml-or-html' WHEN ratio > 0.92 THEN 'text' ELSE 'unknown' END AS kind
  FROM ratios
),
seen AS (
  SELECT *, CASE kind WHEN 'png' THEN 'PNG' WHEN 'pdf' THEN 'PDF (%PDF)' WHEN 'jpeg' THEN 'JPEG' WHEN 'gif' THEN 'GIF'
      WHEN 'zip' THEN CASE WHEN hx LIKE '504B0304%' THEN 'ZIP (stored/deflate container)' ELSE 'ZIP (empty)' END
      WHEN 'avif' THEN 'AVIF (ftypavif)' WHEN 'xml-or-html' THEN 'markup prolog'
      WHEN 'text' THEN 'printable bytes only' ELSE 'no known signature' END AS magic
  FROM sniffed
)"""
