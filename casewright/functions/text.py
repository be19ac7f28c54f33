"""Text expressions: chunking, phrase search, outcome censoring, sentence censoring."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from casewright import vocab
from casewright.vocab import Phrase

# The characters a Unicode-aware strip() removes; Spark's trim removes blanks only.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
_WS_CLASS = r"[\s\x1c-\x1f]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``, inside one expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def compute_once(value: Column) -> Column:
    """A costly column in generator form, for use in ``select``.

    A filter on a plain column moves below it and computes the expression a second time;
    it cannot move below a generator.
    """
    return F.explode(F.array(value))


def strip_ws(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def lstrip_ws(c: Column) -> Column:
    return F.ltrim(c, F.lit(WHITESPACE))


def is_blank(c: Column) -> Column:
    """Null, empty or white space only."""
    return c.isNull() | ~c.rlike(r"(?U)[^\s\x1c-\x1f]")


def chunks(c: Column, min_ws: int = vocab.CHUNK_WHITESPACE, split_on: str | None = None) -> Column:
    """Split on runs of at least ``min_ws`` white-space characters (or on ``split_on``)."""
    return F.split(c, split_on or f"(?U){_WS_CLASS}{{{min_ws},}}")


def java_pattern(pattern: str, lowered: bool = False) -> str:
    """The pattern as Spark should run it.

    Case-insensitive and Unicode-aware, with ``.`` stopping at ``\\n`` only. Word
    runs written as a repeated group recurse once per word in the JVM's matcher and
    overflow its stack on long chunks; the single-class loop accepts the same texts.
    ``lowered`` gives the form to search lower-cased text with: without case folding the
    matcher skips ahead on literals, several times faster over long notes.
    """
    linear = pattern.replace(r"(?:\s+\w+)*\s+", r"\s(?:[\s\w]*\s)?")
    linear = linear.replace(r"(?:\w+\s+)*", r"(?:[\w\s]*\s)?")
    if not lowered:
        return "(?iUd)" + linear
    escape_or_capital = r"\\[pP]\{[^}]*\}|\\.|[A-Z]+"
    return "(?Ud)" + re.sub(
        escape_or_capital, lambda m: m[0] if m[0].startswith("\\") else m[0].lower(), linear
    )


def literals(phrases: Sequence[Phrase]) -> list[str]:
    """The distinct literal words of the phrases: the keys of their inverted index."""
    return sorted({p.word for p in phrases if p.word is not None})


def literals_found(low: Column, phrases: Sequence[Phrase]) -> Column:
    """Bits of the literal words that occur in a lower-cased text: each word is looked for once, whatever its phrases."""
    bits = [F.when(low.contains(word), F.lit(1 << n).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for n, word in enumerate(literals(phrases))]
    return reduce(Column.bitwiseOR, bits) if bits else F.lit(0).cast("bigint")


def _first_match(
    low: Column, phrases: Sequence[Phrase], result: Callable[[int, Phrase], Column], present: Column | None = None
) -> Column:
    """The result for the first phrase found in the lower-cased chunk, in priority order, else null.

    ``present`` has the bits of the literal words of a text that holds the chunk: phrases of
    other words are not even looked for.
    """
    ordered = sorted(phrases, key=lambda p: p.priority)
    number = {word: n for n, word in enumerate(literals(phrases))}

    def matches(phrase):
        hit = low.rlike(java_pattern(phrase.pattern, lowered=True))
        if phrase.word is None:
            return hit
        hit = low.contains(phrase.word) & hit
        return hit if present is None else (present.bitwiseAND(F.lit(1 << number[phrase.word]).cast("bigint")) != 0) & hit

    return F.coalesce(*[F.when(matches(p), result(n, p)) for n, p in enumerate(ordered)])


def first_phrase(chunk: Column, phrases: Sequence[Phrase] = vocab.PHRASES) -> Column:
    """struct(priority, strength, pattern, matched) of the first phrase found, else null."""

    def found(_, p):
        return F.struct(
            F.lit(p.priority).alias("priority"),
            F.lit(p.strength).alias("strength"),
            F.lit(p.pattern).alias("pattern"),
            F.regexp_substr(chunk, F.lit(java_pattern(p.pattern))).alias("matched"),
        )

    return let(F.lower(chunk), lambda low: let(literals_found(low, phrases), lambda bits: _first_match(low, phrases, found, bits)))


def censor_plan(
    c: Column,
    phrases: Sequence[Phrase] = vocab.PHRASES,
    *,
    min_len: int = vocab.MIN_TEXT_CHARS,
    min_ws: int = vocab.CHUNK_WHITESPACE,
    split_on: str | None = None,
    joiner: str | None = None,
) -> Column:
    """Cut a note from the chunk that reveals the plan to the end.

    Returns struct(text, pattern, matched, cut_chunk). A chunk belongs to its first
    phrase in priority order. The earliest strong chunk decides; without one, the
    latest weak chunk does. Texts under ``min_len`` characters become empty. Whole texts
    are searched: once for each literal word of the phrases (up to 62), and chunk by chunk only for the
    phrases of the words that the text has. A text with none of the words is not split at all.
    """
    ordered = sorted(phrases, key=lambda p: p.priority)
    strong = [n for n, p in enumerate(ordered) if p.strength == "strong"]
    names = F.array(*[F.lit(p.pattern) for p in ordered])
    searches = F.array(*[F.lit(java_pattern(p.pattern)) for p in ordered])
    glue = " " * min_ws if joiner is None else joiner

    def outcome(text, pattern=None, matched=None, cut=None):
        return F.struct(
            text.alias("text"),
            (F.lit(None).cast("string") if pattern is None else pattern).alias("pattern"),
            (F.lit(None).cast("string") if matched is None else matched).alias("matched"),
            (F.lit(None).cast("int") if cut is None else cut).alias("cut_chunk"),
        )

    indexed = len(literals(ordered)) <= 62
    always = any(p.word is None for p in ordered) or not indexed
    # a splitter without cased letters cuts a lower-cased text at the same places
    split_low = split_on is None or split_on.lower() == split_on.upper()

    def hits(text, low, present):
        parts = chunks(low if split_low else text, min_ws, split_on)
        searched = (lambda chunk: chunk) if split_low else F.lower
        labelled = F.transform(
            parts,
            lambda chunk, i: F.struct(
                i.alias("at"),
                let(searched(chunk), lambda c: _first_match(c, ordered, lambda n, _: F.lit(n), present)).alias("no"),
            ),
        )
        return F.filter(labelled, lambda h: h["no"].isNotNull())

    def deciding(found):
        earliest_strong = F.array_min(F.filter(found, lambda h: h["no"].isin(strong)))
        latest_weak = F.array_max(F.filter(found, lambda h: ~h["no"].isin(strong)))
        return F.coalesce(earliest_strong, latest_weak) if strong else latest_weak

    def cut(text, h):
        return let(
            chunks(text, min_ws, split_on),
            lambda parts: outcome(
                F.array_join(F.slice(parts, F.lit(1), h["at"]), glue),
                F.get(names, h["no"]),
                F.regexp_substr(F.get(parts, h["at"]), F.get(searches, h["no"])),
                h["at"],
            ),
        )

    def decided(text, low, present):
        return let(
            let(hits(text, low, present), deciding),
            lambda h: F.when(h.isNull(), outcome(text)).otherwise(cut(text, h)),
        )

    def dispatched(text, low):
        if not indexed:
            return decided(text, low, None)
        return let(
            literals_found(low, ordered),
            lambda present: decided(text, low, present) if always else F.when(present == 0, outcome(text)).otherwise(decided(text, low, present)),
        )

    searched = let(c, lambda text: let(F.lower(text), lambda low: dispatched(text, low)))
    return (
        F.when(c.isNull(), outcome(F.lit(None).cast("string")))
        .when(F.length(strip_ws(c)) < min_len, outcome(F.lit("")))
        .otherwise(searched)
    )


def removed_tail(original: Column, cleaned: Column) -> Column:
    """The original from the cleaned text's length on, left-stripped; null if unchanged.

    Re-joining uses fixed-width gaps, so wider gaps in the original make the tail
    start earlier than the cut.
    """
    tail = F.substring(original, F.length(cleaned) + F.lit(1), F.length(original))
    return F.when(cleaned != original, lstrip_ws(tail))


def censor_sentences(
    c: Column, keywords: Sequence[str] = vocab.SENTENCE_KEYWORDS, whole_word: bool = False
) -> Column:
    """Lower-case, drop sentences containing a keyword, rejoin with single blanks.

    Keywords are substrings unless ``whole_word`` is set.
    """

    def flagged(sentence):
        if whole_word:
            words = "|".join(rf"\Q{k}\E" for k in keywords)
            return sentence.rlike(rf"(?U)\b(?:{words})\b")
        hit = F.lit(False)
        for k in keywords:
            hit = hit | sentence.contains(k)
        return hit

    sentences = F.split(F.lower(c), rf"(?U)(?<=[.!?]){_WS_CLASS}+")
    return F.array_join(F.filter(sentences, lambda s: ~flagged(s)), " ")
