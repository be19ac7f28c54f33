"""Parsing model answers and turning them into scores.

Every parser returns struct(decision, confidence, confidence_raw, reasoning,
parse_status, decision_valid, confidence_valid). parse_status is ok, no_response or
unparseable. Values are kept as given; the two flags say whether they are Yes/No and
a whole number from 1 to 10.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from casewright import vocab
from casewright.functions.text import let, strip_ws


def _null(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def _answer(decision: Column, raw: Column, reasoning: Column, status: Column) -> Column:
    confidence = raw.try_cast("double")
    whole = confidence.between(1, 10) & (confidence == F.floor(confidence))
    return F.struct(
        decision.alias("decision"),
        confidence.alias("confidence"),
        raw.alias("confidence_raw"),
        reasoning.alias("reasoning"),
        status.alias("parse_status"),
        F.coalesce(decision.isin("Yes", "No"), F.lit(False)).alias("decision_valid"),
        F.coalesce(whole, F.lit(False)).alias("confidence_valid"),
    )


def _missing(text: str | None) -> Column:
    reasoning = _null() if text is None else F.lit(text)
    return _answer(_null(), _null(), reasoning, F.lit("no_response"))


def _unfenced(c: Column) -> Column:
    text = strip_ws(c)
    return let(
        text,
        lambda t: F.when(
            t.startswith("```json"),
            strip_ws(F.replace(F.replace(t, F.lit("```json"), F.lit("")), F.lit("```"), F.lit(""))),
        )
        .when(t.startswith("```"), strip_ws(F.replace(t, F.lit("```"), F.lit(""))))
        .otherwise(t),
    )


def _json_entries(c: Column) -> Column:
    """Entries of the single JSON object in the text, else null.

    Wrapping the text in brackets makes trailing text, a second object, a bare value
    or an array fail, which a direct parse would accept.
    """
    wrapped = F.from_json(
        F.concat(F.lit("["), _unfenced(c), F.lit("]")), "array<map<string,string>>"
    )
    return let(wrapped, lambda a: F.when(F.size(a) == 1, F.map_entries(F.get(a, F.lit(0)))))


def _field(entries: Column, name: str, any_case: bool) -> Column:
    """The last entry of that name (null when absent; its value is null when explicit)."""
    named = F.filter(
        entries, lambda e: (F.lower(e["key"]) if any_case else e["key"]) == F.lit(name)
    )
    return F.try_element_at(named, F.lit(-1))


def _from_entries(entries: Column, any_case: bool) -> Column:
    reasoning = _field(entries, "reasoning", any_case)
    return _answer(
        _field(entries, "decision", any_case)["value"],
        _field(entries, "confidence", any_case)["value"],
        F.when(reasoning.isNull(), vocab.NO_REASONING).otherwise(reasoning["value"]),
        F.lit("ok"),
    )


def _unparseable() -> Column:
    return _answer(_null(), _null(), F.lit(vocab.UNPARSEABLE), F.lit("unparseable"))


def parse_json_answer(c: Column, no_response_text: str | None = None) -> Column:
    """Strip code fences and read the single JSON object.

    A missing reasoning key gets the default text, an explicit null stays null.
    """
    return (
        F.when(c.isNull() | (c == ""), _missing(no_response_text))
        .otherwise(
            let(
                _json_entries(c),
                lambda e: F.when(e.isNull(), _unparseable()).otherwise(_from_entries(e, False)),
            )
        )
    )


def _tagged(lines: Column, tag: str) -> Column:
    kept = F.filter(lines, lambda line: line.startswith(tag))
    return F.transform(kept, lambda line: strip_ws(F.replace(line, F.lit(tag), F.lit(""))))


def _from_lines(c: Column) -> Column:
    def parsed(lines):
        decisions = F.filter(_tagged(lines, "DECISION:"), lambda d: d.isin("Yes", "No"))
        numbers = F.transform(
            _tagged(lines, "CONFIDENCE:"),
            lambda v: strip_ws(F.get(F.split(v, ","), F.lit(0))).try_cast("int"),
        )
        scores = F.filter(numbers, lambda n: n.between(1, 10))
        reasons = _tagged(lines, "REASONING:")
        found = (
            (F.size(decisions) > 0) | (F.size(scores) > 0) | (F.size(reasons) > 0)
        )
        return _answer(
            F.try_element_at(decisions, F.lit(-1)),
            F.try_element_at(scores, F.lit(-1)).cast("string"),
            F.coalesce(F.try_element_at(reasons, F.lit(-1)), F.lit(vocab.UNPARSEABLE)),
            F.when(found, "ok").otherwise("unparseable"),
        )

    return let(F.transform(F.split(strip_ws(c), "\n"), strip_ws), parsed)


def parse_labelled_answer(c: Column, no_response_text: str | None = vocab.NO_RESPONSE) -> Column:
    """Read DECISION: / CONFIDENCE: / REASONING: lines.

    The last valid decision and confidence win, and the last reasoning line. Only
    Yes/No and whole numbers 1 to 10 (before a comma) count as valid.
    """
    return F.when(c.isNull() | (c == ""), _missing(no_response_text)).otherwise(_from_lines(c))


def parse_answer(c: Column, no_response_text: str | None = vocab.NO_RESPONSE) -> Column:
    """JSON first, with keys in any case, then labelled lines."""
    return F.when(c.isNull() | (c == ""), _missing(no_response_text)).otherwise(
        let(
            _json_entries(c),
            lambda e: F.when(e.isNull(), _from_lines(c)).otherwise(_from_entries(e, True)),
        )
    )


def confidence_score(c: Column, fill: float = 5, scale: float = 10) -> Column:
    """Confidence as a 0-1 score; a missing one counts as the middle."""
    return F.coalesce(c, F.lit(fill)) / F.lit(scale)


def path_safe(c: Column) -> Column:
    """Model name as a path segment: ``/``, ``:`` and ``@`` become underscores."""
    return F.translate(c, "/:@", "___")


def path_safe_name(name: str) -> str:
    return name.translate(str.maketrans("/:@", "___"))
