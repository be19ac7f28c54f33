"""SQL fragments shared by the oracle queries."""

from __future__ import annotations

import re

from casewright.catalog import adapters as A


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def any_of(values) -> str:
    return ", ".join(quoted(v) for v in values)


def ordered_days(name: str, condition: str | None = None) -> str:
    """Day and text of a group's rows in history order."""
    rule = f" FILTER (WHERE {condition})" if condition else ""
    return (
        "string_agg(strftime(CAST(day AS DATE), '%Y-%m-%d') || text, '|' ORDER BY day, note_seq)"
        f"{rule} AS {name}"
    )


def fill(template: str, **values: str) -> str:
    """The template as a SQL concatenation, with each {name} replaced by an expression."""
    pieces = re.split("(" + "|".join(rf"\{{{name}\}}" for name in values) + ")", template)
    parts = [f"({values[p[1:-1]]})" if p[1:-1] in values else quoted(p) for p in pieces if p]
    return "(" + " || ".join(parts) + ")"


_ITEM = "user_id AS patient_id, event_id AS note_seq, ts AS date, CAST(ts AS DATE) AS day, event_type AS title, props AS text"
_CODE = "json_extract_string(props, '$.k')"

FLAGS = f"""procs AS (SELECT user_id AS patient_id, ts AS date, event_id % 5 <> 0 AS in_system, {_CODE} AS code
  FROM events WHERE event_type = 'purchase'),
flags AS (SELECT patient_id,
  coalesce(bool_or(in_system AND code IN ({any_of(A.EVENT_CODES['surgery'])})), false) AS had_surgery,
  min(date) FILTER (WHERE in_system AND code IN ({any_of(A.EVENT_CODES['surgery'])})) AS first_surgery_date,
  coalesce(bool_or(in_system AND code IN ({any_of(A.EVENT_CODES['endoscopy'])})), false) AS had_endoscopy,
  min(date) FILTER (WHERE in_system AND code IN ({any_of(A.EVENT_CODES['endoscopy'])})) AS first_endoscopy_date
  FROM procs GROUP BY patient_id)"""

EVENT_SQL = f"""WITH {FLAGS},
notes AS (SELECT {_ITEM} FROM events WHERE event_type = 'view'),
reports AS (SELECT {_ITEM} FROM events WHERE event_type = 'error')"""


def phrase_no(chunk: str, phrases=A.DOC_PHRASES) -> str:
    """Priority of the first phrase found in a chunk."""
    tests = " ".join(f"WHEN regexp_matches({chunk}, {quoted(p.pattern)}, 'i') THEN {p.priority}" for p in phrases)
    return f"CASE {tests} END"


def phrase_text(number: str, chunk: str, phrases=A.DOC_PHRASES) -> tuple[str, str]:
    """(pattern, matched text) of a phrase number in a chunk."""
    pattern = " ".join(f"WHEN {p.priority} THEN {quoted(p.pattern)}" for p in phrases)
    matched = " ".join(
        f"WHEN {p.priority} THEN regexp_extract({chunk}, {quoted(p.pattern)}, 0, 'i')" for p in phrases
    )
    return f"CASE {number} {pattern} END", f"CASE {number} {matched} END"


BLANKS = "' ' || chr(9) || chr(10) || chr(13)"


def censored(texts: str, phrases=A.DOC_PHRASES, lines: str = "string_split(text, chr(10))", glue: str = "chr(10)", min_len: int = 500) -> str:
    """CTEs ending in cut(doc_id, original, text, pattern, matched, cut_chunk) for texts(doc_id, text)."""
    pattern, matched = phrase_text("b.no", "b.chunk", phrases)
    n_strong = sum(p.strength == "strong" for p in phrases)
    return f"""lines AS (SELECT doc_id, unnest({lines}) AS chunk, generate_subscripts({lines}, 1) - 1 AS pos FROM {texts}),
numbered AS (SELECT doc_id, chunk, pos, {phrase_no('chunk', phrases)} AS no FROM lines),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id
    ORDER BY CASE WHEN no <= {n_strong} THEN pos ELSE 2000000 - pos END) AS rn FROM numbered WHERE no IS NOT NULL),
cut AS (SELECT t.doc_id, t.text AS original,
  CASE WHEN length(trim(t.text, {BLANKS})) < {min_len} THEN ''
       WHEN b.pos IS NULL THEN t.text
       ELSE coalesce(array_to_string(list_slice({lines}, 1, b.pos), {glue}), '') END AS text,
  CASE WHEN length(trim(t.text, {BLANKS})) >= {min_len} THEN {pattern} END AS pattern,
  CASE WHEN length(trim(t.text, {BLANKS})) >= {min_len} THEN {matched} END AS matched,
  CASE WHEN length(trim(t.text, {BLANKS})) >= {min_len} THEN CAST(b.pos AS INTEGER) END AS cut_chunk
  FROM {texts} t LEFT JOIN best b ON t.doc_id = b.doc_id AND b.rn = 1)"""


REMOVED = f"CASE WHEN text <> original THEN ltrim(substr(original, length(text) + 1), {BLANKS}) END"
