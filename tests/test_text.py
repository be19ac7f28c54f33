"""Chunking, phrase search and censoring on hand-made and generated texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from casewright import vocab
from casewright.functions import text as X

GAP = " " * 5
PAD = "quiet filler words " * 30  # over 500 characters, no phrase
STRONG = "proceed with surgical intervention"
WEAK = "septoplasty"


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"id int, t {kind}")


def apply(spark, values, build, kind="string"):
    df = column(spark, values, kind).select("id", build(F.col("t")).alias("r")).orderBy("id")
    return [r["r"] for r in df.collect()]


def censor(spark, values, **options):
    return apply(spark, values, lambda c: X.censor_plan(c, **options))


def python_phrase(chunk):
    """First phrase by the original patterns in Python."""
    for p in vocab.PHRASES:
        found = re.search(p.pattern, chunk, re.IGNORECASE)
        if found:
            return p.priority, found.group(0)
    return None


def test_chunks_split_on_five_or_more(spark):
    got = apply(spark, ["a    b", f"a{GAP}b", f"a{' ' * 9}b", "\xa0" * 5 + "x", f"x{GAP}", "a\n\n\t \x1cb"], X.chunks)
    assert got == [["a    b"], ["a", "b"], ["a", "b"], ["", "x"], ["x", ""], ["a", "b"]]


def test_strip_matches_python(spark):
    texts = [" \t\xa0a b　\n", "", " \x1f ", "x\x85"]
    assert apply(spark, texts, X.strip_ws) == [t.strip() for t in texts]


def test_blank(spark):
    got = apply(spark, [None, "", " \n\xa0\x1c", "x", " x"], X.is_blank)
    assert got == [True, True, True, False, False]


EXAMPLES = [
    "proceed with surgical intervention", "surgical intervention for chronic sinusitis", "Surgical  Treatment of acute sinusitis", "surgical management of crs",
    "surgical management of a b c sinusitis", "PLAN FOR her next sinus surgery", "schedule for sinus surgery",
    "candidate for nasal surgery", "patient was elected to proceed with sinus surgery", "plan to do FESS", "ess is planned",
    "considering essential oils", "planning for fess", "surgical planning", "surgical review, discussion", "plan: rest",
    "Assessment and plan: rest", "surgery was not discussed", "sinus surgery was discussed", "consider endoscopic surgery",
    "patient agrees with the plan", "we have discussed sinus surgery", "consented to surgery",
    "referred to ent for evaluation and surgery", "the ESS", "a fess b", "SEPT", "ESS/FESS", "endoscopic sinus surgery",
    "functional endoscopic sinus surgery", "septoplasty", "turbinate  reduction", "turbinectomy", "balloonsinuplasty",
    "polypectomy", "no plan: here", "assess", "lessons", "september", "surgeries", "plan for\nrest\nsinus\nsurgery",
]


def test_first_phrase_matches_python(spark):
    """Every phrase, and random mixtures of phrase fragments, against Python's matcher."""
    words = sorted({w for e in EXAMPLES for w in re.split(r"\s+", e)} | {"was", "the", "über", "naïve"})
    pick = random.Random(7)
    texts = EXAMPLES + [" ".join(pick.choices(words, k=pick.randint(1, 12))) for _ in range(1500)]
    texts += [pick.choice(EXAMPLES) + pick.choice([" ", "\n", "\xa0", ""]) + pick.choice(EXAMPLES) for _ in range(500)]
    got = apply(spark, texts, X.first_phrase)
    for text, hit in zip(texts, got):
        want = python_phrase(text)
        assert (hit and (hit["priority"], hit["matched"])) == want, text


def test_every_phrase_needs_its_word():
    hits = {}
    for e in EXAMPLES:
        for p in vocab.PHRASES:
            if re.search(p.pattern, e, re.IGNORECASE):
                assert p.word in e.lower()
                hits[p.pattern] = True
    assert len(hits) == len({p.pattern for p in vocab.PHRASES}) == 32


@pytest.mark.parametrize("tail", ["", " sinus surgery"])
def test_long_word_runs_do_not_overflow(spark, tail):
    chunk = "plan for" + " word" * 9000 + tail
    [row] = censor(spark, [PAD + GAP + chunk])
    assert row["text"] == (PAD.rstrip() if tail else PAD + GAP + chunk)
    assert (row["matched"] is not None) == bool(tail)


def test_length_limits(spark):
    texts = ["x" * 499, "  " + "x" * 499 + "  ", "x" * 500, None, "y" * 100_010, ""]
    rows = censor(spark, texts)
    assert [r["text"] if r["text"] is None else len(r["text"]) for r in rows] == [0, 0, 500, None, 100_010, 0]
    assert all(r["pattern"] is None for r in rows)
    late = "y" * 99_000 + GAP + "z" * 60_000 + STRONG
    assert censor(spark, [late])[0]["cut_chunk"] == 1


def test_which_chunk_decides(spark):
    def note(**at):
        parts = [PAD.strip()] + [f"chunk {i}" for i in range(1, 7)]
        for i, phrase in at.items():
            parts[int(i[1:])] += " " + phrase
        return GAP.join(parts)

    notes = {
        "earliest strong": (note(c2=STRONG, c5=STRONG), 2),
        "latest weak": (note(c1=WEAK, c4=WEAK), 4),
        "strong before weak": (note(c1=WEAK, c3=STRONG), 3),
        "strong despite later weak": (note(c2=STRONG, c5=WEAK), 2),
        "both in one chunk": (note(c3=f"{WEAK} {STRONG}", c5=WEAK), 3),
        "first chunk": (note(c0=STRONG), 0),
        "none": (note(), None),
    }
    rows = censor(spark, [n for n, _ in notes.values()])
    for (name, (original, cut)), row in zip(notes.items(), rows):
        assert row["cut_chunk"] == cut, name
        assert row["text"] == (original if cut is None else GAP.join(original.split(GAP)[:cut])), name
    assert rows[4]["matched"] == "surgical intervention"


def test_removed_tail_offset(spark):
    exact = f"aaa{GAP}bbb{GAP}ccc"
    wide = f"aaa{' ' * 9}bbb{GAP}ccc"
    df = spark.createDataFrame([(exact, f"aaa{GAP}bbb"), (wide, f"aaa{GAP}bbb"), ("same", "same"), (None, None)], "o string, c string")
    got = [r[0] for r in df.select(X.removed_tail(F.col("o"), F.col("c"))).collect()]
    # Wider gaps shrink on re-joining, so the tail starts inside the kept text.
    assert got == ["ccc", wide[len(f"aaa{GAP}bbb"):].lstrip(), None, None]


def test_censored_text_is_a_prefix_of_chunks(spark):
    pick = random.Random(3)
    notes = [
        GAP.join([PAD.strip()] + [pick.choice(EXAMPLES + ["calm"] * 20) for _ in range(pick.randint(1, 8))]) for _ in range(300)
    ]
    for note, row in zip(notes, censor(spark, notes)):
        parts = note.split(GAP)
        kept = row["text"].split(GAP)
        assert parts[: len(kept)] == kept
        classes = [python_phrase(p) for p in kept]
        assert not any(c and c[0] <= len(vocab.STRONG_PHRASES) for c in classes)


def test_sentences(spark):
    text = "Assess today. No plan.  Surgery next! All good? Yes."
    assert apply(spark, [text, None, ""], X.censor_sentences) == ["no plan. all good? yes.", None, ""]
    whole = apply(spark, [text], lambda c: X.censor_sentences(c, whole_word=True))
    assert whole == ["assess today. no plan. all good? yes."]
