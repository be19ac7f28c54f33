"""Default vocabularies. Every operator takes them as parameters."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

# --------------------------------------------------------------------------
# Results depend on these lists, texts and limits being exact.
# --------------------------------------------------------------------------

NOTE_TYPES = [
    "Other Note", "Other", "Progress Note, Outpatient",
    "Operative/Procedure Report", "Consultation Note",
    "History and Physical", "Progress Note, Inpatient",
    "Progress/Discharge/Transfer Summary", "Discharge/Transfer Summary",
]

NOTE_TITLES = [
    "Procedure Note", "Health Plan Operations CM Note", "Airway",
    "OUTSIDE RECORDS", "PROC CT SCAN INFORMATION", "Operative Note",
    "Consult Follow-Up", "Interval H&P Note", "Unmapped External Note",
    "OUTSD CLINIC VISITS/CONSULTS/NOTES", "Surgical Procedure",
    "Tertiary Survey", "Admission H&P", "H&P Interval", "LARYNGOSCOPY ENT",
    "Pre-Op H&P", "SHC CT RESULT", "H&P Preop", "Procedures",
    "IN CLINIC VNA - CT - MAXILLOFACIAL AREA", "ORD CONSULT REQUEST",
    "IMAGE ONLY - ENT ENDOSCOPY", "Care Plan Note", "Clinic Support Note",
    "Clinic Visit", "Consults", "H&P", "NASAL ENDOSCOPY ENT",
    "Operative Report", "Progress Notes", "Sign Out Note",
]

REPORT_TYPES = ["CT"]

REPORT_TITLES = [
    "CT ENT SINUS WO IV CONTRAST", "CT SINUS LIMITED",
    "CT FACIAL BONES OR SINUS", "CT FACIAL SINUSES O CONTRAST",
]

CODE_SYSTEM = "CPT"

SURGERY_CODES = [
    "31253", "31254", "31255", "31256", "31257", "31259", "31267",
    "31276", "31287", "31288", "31240",
]

ENDOSCOPY_CODES = ["31231", "31237"]

AUTHOR_KEYWORDS = ["ent", "otolaryngology"]

SELECTED_TITLE = "Progress Notes"

STRONG_PHRASES = [
    r"surgical\s+intervention(?:\s+for\s+\w+\s+sinusitis)?",
    r"surgical\s+treatment(?:\s+of\s+\w+\s+sinusitis)?",
    r"proceed\s+with\s+surgical\s+intervention(?:\s+for\s+\w+\s+sinusitis)?",
    r"surgical\s+management(?:\s+of\s+(?:\w+\s+)*(?:sinusitis|crs))?",
    r"plan\s+for(?:\s+\w+)*\s+sinus\s+surgery",
    r"scheduled?\s+for(?:\s+\w+)*\s+sinus\s+surgery",
    r"candidate\s+for(?:\s+\w+)*\s+(?:nasal|sinus)\s+surgery",
    r"patient\s+(?:was\s+)?(?:agreed?|elected|opted)(?:\s+to\s+proceed)?(?:\s+with)?(?:\s+\w+)*\s+sinus\s+surgery",
    r"(?:plan|proceed|scheduled?|recommended?|candidate).{0,50}\b(?:FESS|ESS)\b",
    r"\b(?:FESS|ESS)\b\s+(?:is\s+)?(?:recommended|planned|scheduled|indicated)",
    r"(?:considering?|planning\s+for)\s+(?:FESS|ESS)",
]

WEAK_PHRASES = [
    r"surgical\s+planning",
    r"surgical.{0,20}(?:planning|plan|discussion)",
    r"^(?:assessment\s+and\s+plan|plan):",
    r"surgery.{0,20}(?:discussed?|discussion)",
    r"(?:sinus\s+)?surgery\s+was\s+discussed",
    r"consider\s+(?:endoscopic\s+)?surgery",
    r"patient\s+agrees?\s+(?:with\s+(?:the\s+)?plan)",
    r"we\s+(?:have\s+)?discussed\s+(?:sinus\s+)?surgery",
    r"consented?\s+(?:to|for)\s+(?:sinus\s+)?surgery",
    r"referred\s+to\s+ENT\s+for\s+(?:evaluation\s+and\s+)?surgery",
    r"\bESS\b",
    r"\bFESS\b",
    r"\bSEPT\b",
    r"\bESS/FESS\b",
    r"endoscopic\s+sinus\s+surgery",
    r"functional\s+endoscopic\s+sinus\s+surgery",
    r"\bseptoplasty\b",
    r"\bturbinate\s+reduction\b",
    r"\bturbinectomy\b",
    r"\bballoon\s*sinuplasty\b",
    r"\bpolypectomy\b",
]

# A word each phrase cannot match without, in the order of the phrases above.
STRONG_WORDS = [
    "surgical", "surgical", "surgical", "surgical", "surgery", "surgery", "surgery", "surgery",
    "ess", "ess", "ess",
]

WEAK_WORDS = [
    "surgical", "surgical", "plan",
    "surgery", "surgery", "surgery", "agree", "surgery", "surgery", "surgery",
    "ess", "ess", "sept", "ess", "surgery", "surgery",
    "septoplasty", "turbinate", "turbinectomy", "sinuplasty", "polypectomy",
]

SENTENCE_KEYWORDS = [
    "surgery", "fess", "ess", "operative", "operation", "surgical",
    "recommend proceeding with", "plan for", "schedule", "consent for",
]

INSUFFICIENT_PATTERNS = [
    "insufficient information",
    "insufficient data",
    "progress notes and radiology reports are missing",
]

NO_NOTE = "No progress notes available."
NO_REPORTS = "No radiology reports available."
NO_REASONING = "No reasoning provided"
UNPARSEABLE = "Failed to parse response"
NO_RESPONSE = "No response from API"

MIN_TEXT_CHARS = 500
CHUNK_WHITESPACE = 5
MAX_FALLBACK_NOTES = 5

CASE_RANGE_EDGES = [0, 5000, 10000, 15000, 20000]

EVAL_COLUMNS = ["llm_caseID", "confidence", "llm_surgery", "actual_surgery", "reasoning"]

# --------------------------------------------------------------------------
# End of fixed values.
# --------------------------------------------------------------------------


class Phrase(NamedTuple):
    """One censoring phrase; a lower priority number is tried first.

    ``word`` is lower-case text that every match contains. Looking for it is much cheaper
    than the pattern, which is tried only where the word occurs.
    """

    priority: int
    strength: str
    pattern: str
    word: str | None = None


def phrase_rows(
    strong: Sequence[str],
    weak: Sequence[str],
    strong_words: Sequence[str | None] | None = None,
    weak_words: Sequence[str | None] | None = None,
) -> list[Phrase]:
    """Strong phrases first, then weak ones, numbered in that order; words are optional."""
    tagged = list(zip(["strong"] * len(strong), strong, strong_words or [None] * len(strong), strict=True))
    tagged += zip(["weak"] * len(weak), weak, weak_words or [None] * len(weak), strict=True)
    return [Phrase(n, *row) for n, row in enumerate(tagged, start=1)]


PHRASES = phrase_rows(STRONG_PHRASES, WEAK_PHRASES, STRONG_WORDS, WEAK_WORDS)
