"""Personal data by rules, and by contexts that the found data teach.

Four rules find the base entities. Each is a seed. A seed's shape (digits counted, letters as one
class), the words beside it, and both together are patterns. Every token with a digit or an at
sign, and every short row of such tokens, is a candidate and hangs on the same kinds of patterns.
Spark scores the graph of patterns and candidates in rounds: a pattern is worth the share of its distinct
candidates that are known, a candidate is worth its best pattern of high confidence, and
candidates so found count as known in the next round. What is known in the end and does not
overlap a base entity is added.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.llm.text import WORD
from casewright.session import materialize

# The four kinds in order, and their patterns.
KINDS = ("email", "ip", "card", "phone")
_AFTER_AT = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_WORD = re.compile(WORD)
_MARK = re.compile(r"[0-9@]")
_DIGITS = re.compile(r"[0-9]+")
_LETTERS = re.compile(r"[^\W\d_]+")
_EDGES = re.compile(r"[A-Za-z0-9+(].*[A-Za-z0-9)]|[A-Za-z0-9]", re.DOTALL)
_OUTER = re.compile(r"^[\W_]+|[\W_]+$")

ROW = 5  # tokens of the longest candidate
ROUNDS = 4
CONFIDENCE = 0.7  # least share of known candidates, at the lower bound, of a pattern that finds others
SUPPORT = 5  # known candidates that it needs
Z = 2.0  # deviations of the bound
SALTS = 16


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_entities(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the base entities, by start, then kind; places count code points."""
    found, before, at = [], 0, text.find("@")
    while at >= 0:  # a run of the characters before a sign matches from its first one or not at all
        start = at
        while start > before and text[start - 1] in _LOCAL:
            start -= 1
        hit = _AFTER_AT.match(text, at + 1) if start < at else None
        if hit:
            found.append((start, hit.end(), 0))
            before = hit.end()
        at = text.find("@", max(at + 1, before))
    for hit in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in hit[0].split(".")):
            found.append((hit.start(), hit.end(), 1))
    for hit in _CARD.finditer(text):
        digits = hit[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and _luhn(digits):
            found.append((hit.start(), hit.end(), 2))
    for hit in _PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in hit[0]) <= 15:
            found.append((hit.start(), hit.end(), 3))
    return sorted(found, key=lambda f: (f[0], f[2]))


def shape(value: str) -> str:
    """Digits as their number, letters as one class, other characters as they are."""
    return _LETTERS.sub("a", _DIGITS.sub(lambda m: f"<{len(m[0])}>", value))


def candidates(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, word before, word after) of rows of one to ``ROW`` tokens with a digit or an at sign.

    Marks at the outer edges don't count; the words beside are lower-cased, without outer marks,
    digits as their number.
    """
    tokens = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    marked = [bool(_MARK.search(text, a, b)) for a, b in tokens]

    def beside(i: int) -> str:
        if not 0 <= i < len(tokens):
            return ""
        word = text[slice(*tokens[i])]
        return _DIGITS.sub(lambda m: f"<{len(m[0])}>", _OUTER.sub("", word).lower())

    found = []
    for i, (a, _) in enumerate(tokens):
        for j in range(i, min(i + ROW, len(tokens))):
            if not marked[j] or not marked[i]:
                break
            hit = _EDGES.search(text, a, tokens[j][1])
            if hit:
                found.append((hit.start(), hit.end(), beside(i - 1), beside(j + 1)))
    return found


def _found(docs: DataFrame, names: Sequence[str], text: str) -> DataFrame:
    """``row``, ``base`` and ``cands``: what the rules and the candidate scan find in each text."""
    picked = docs.select(F.struct(*[F.col(c) for c in names]).alias("row"), F.col(text).alias("_text"))
    base = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("kind", pa.int32()), ("value", pa.string())]))
    cand = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("value", pa.string()), ("before", pa.string()), ("after", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("_text").cast(pa.binary())
            marked = pc.fill_null(pc.match_substring_regex(column, r"[0-9@]"), False).to_numpy(zero_copy_only=False)
            bases, cands = [], []
            for i in range(len(column)):
                if not marked[i]:
                    bases.append([])
                    cands.append([])
                    continue
                value = column[i].as_py().decode("utf-8", "replace")
                bases.append([{"s": s, "e": e, "kind": k, "value": value[s:e]} for s, e, k in base_entities(value)])
                cands.append([{"s": s, "e": e, "value": value[s:e], "before": b, "after": a} for s, e, b, a in candidates(value)])
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(bases, base), pa.array(cands, cand)], ["row", "base", "cands"])

    row_type = picked.schema["row"].dataType.simpleString()
    return picked.mapInArrow(
        run,
        f"row {row_type}, base array<struct<s:int,e:int,kind:int,value:string>>, "
        "cands array<struct<s:int,e:int,value:string,before:string,after:string>>",
    )


def _patterns(value: Column, before: Column, after: Column) -> Column:
    """The patterns of a candidate: its shape, its neighbours, and both together."""
    digits = F.regexp_replace(value, r"[0-9]+", "<9>")
    form = F.regexp_replace(digits, r"\p{L}+", "a")
    counted = F.concat(form, F.lit("/"), F.array_join(F.transform(F.regexp_extract_all(value, F.lit(r"[0-9]+"), F.lit(0)), lambda d: F.length(d).cast("string")), ","))
    return F.array(
        F.concat(F.lit("S|"), counted),
        F.concat(F.lit("B|"), before),
        F.concat(F.lit("A|"), after),
        F.concat(F.lit("BS|"), before, F.lit("|"), counted),
        F.concat(F.lit("AS|"), after, F.lit("|"), counted),
        F.concat(F.lit("BA|"), before, F.lit("|"), after),
    )


def lower_share(known: Column, n: Column) -> Column:
    """Wilson's lower bound of a share: a few cases prove little."""
    p, z = known / n, F.lit(Z * Z) / n
    return (p + z / 2 - Z * F.sqrt(p * (1 - p) / n + z / n / 4)) / (1 + z)


def score_candidates(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """``value``, ``kind`` of the candidates known in the end, seeds included.

    ``edges`` (pattern, value) are distinct; ``seeds`` (value, kind) too. A pattern's confidence for a
    kind is the lower bound of its share of values known to be of the kind; it finds values if that is at
    least ``confidence`` and it has at least ``support`` known ones. A value that patterns of several kinds
    find is of the most confident one (ties: the first kind). Seeds never change. Patterns
    such as a frequent word hold a large share of the edges: counts are aggregated before they are shuffled, and found
    patterns are copied for each salt of the values, so that no task has a pattern whole.
    """
    salted = materialize(edges.withColumn("salt", F.pmod(F.xxhash64("value"), F.lit(SALTS)).cast("int")))
    degree = materialize(salted.groupBy("pattern").agg(F.count("*").alias("n")))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    known = materialize(seeds.withColumn("seed", F.lit(True)))
    for _ in range(rounds):
        mass = salted.join(known, "value").groupBy("pattern", "kind").agg(F.count("*").alias("known")).filter(F.col("known") >= support)
        worth = mass.join(degree, "pattern").withColumn("conf", lower_share(F.col("known"), F.col("n"))).filter(F.col("conf") >= confidence)
        sure = worth.select("pattern", "kind", "conf", salts.alias("salt"))
        reached = salted.join(sure, ["pattern", "salt"]).groupBy("value").agg(F.max(F.struct("conf", (-F.col("kind")).alias("kind"))).alias("best"))
        reached = reached.select("value", (-F.col("best.kind")).alias("kind"), F.lit(False).alias("seed"))
        fresh = reached.join(seeds.select("value").distinct(), "value", "left_anti")
        before = known.count()
        known = materialize(seeds.withColumn("seed", F.lit(True)).unionByName(fresh))
        if known.count() == before:
            break
    return known.select("value", "kind")


def contextual_pii(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    carry: Sequence[str] = (),
    rounds: int = ROUNDS,
    confidence: float = CONFIDENCE,
    support: int = SUPPORT,
) -> DataFrame:
    """Per row: ``row`` (struct of the key and carried columns), ``base`` and ``added``: arrays of (s, e, kind).

    Places count code points, the end is exclusive; kinds are numbers into ``KINDS``. Base entities are
    those of the rules, leftmost and not overlapping within a kind, by start, then kind. Added ones
    are candidates with a known value of a kind, that overlap neither a base entity nor each other
    (leftmost first, of those the longest). Null and empty texts have none. Bytes that are not UTF-8 count as one
    replacement character each. Rows are told apart by a number of their own, so null, repeated and equal
    keys and identical rows each get their row back. A very long text is scanned whole, in one task, in time in
    proportion to its length. Candidates are scored over all rows; an empty table gives no rows. Columns
    not carried are ignored, whatever they are named.
    """
    names = list(dict.fromkeys([key, *carry]))
    found = materialize(_found(docs, names, text).withColumn("uid", F.monotonically_increasing_id()))
    some = found.filter(F.size("cands") > 0)
    seeds = found.select(F.explode("base").alias("b")).select("b.value", "b.kind").distinct()
    # a seed counts as a candidate where its tokens are just its characters; elsewhere its value is still known
    marks = materialize(
        some.select("uid", "base", F.explode("cands").alias("c")).select(
            "uid",
            "c.s",
            "c.e",
            "c.value",
            _patterns(F.col("c.value"), F.col("c.before"), F.col("c.after")).alias("patterns"),
            F.exists("base", lambda b: (b["s"] < F.col("c.e")) & (b["e"] > F.col("c.s"))).alias("taken"),
            F.exists("base", lambda b: (b["s"] == F.col("c.s")) & (b["e"] == F.col("c.e"))).alias("same"),
        )
    )
    # a candidate that only overlaps a base entity says nothing about its patterns
    edges = marks.filter(F.col("same") | ~F.col("taken")).select(F.explode("patterns").alias("pattern"), "value").distinct()
    known = score_candidates(edges, seeds, rounds, confidence, support)
    known = known.groupBy("value").agg(F.min("kind").alias("kind"))
    hits = marks.filter(~F.col("taken")).select("uid", "s", "e", "value").join(known, "value")
    listed = hits.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("s", (-F.col("e")).alias("e"), "kind"))).alias("h"))
    # leftmost first, the longest of those that start together; an overlap with the one before goes
    chosen = F.aggregate(
        "h",
        F.struct(F.array().cast("array<struct<s:int,e:int,kind:int>>").alias("kept"), F.lit(-1).alias("upto")),
        lambda acc, h: F.when(
            h["s"] >= acc["upto"],
            F.struct(
                F.concat(acc["kept"], F.array(F.struct(h["s"].alias("s"), (-h["e"]).alias("e"), h["kind"].alias("kind")))).alias("kept"),
                (-h["e"]).alias("upto"),
            ),
        ).otherwise(acc),
        lambda acc: acc["kept"],
    )
    added = listed.select("uid", chosen.alias("added"))
    base = F.transform("base", lambda b: F.struct(b["s"].alias("s"), b["e"].alias("e"), b["kind"].alias("kind")))
    none = F.array().cast("array<struct<s:int,e:int,kind:int>>")
    joined = found.select("uid", "row", base.alias("base")).join(added, "uid", "left")
    return joined.select("row", "base", F.coalesce("added", none).alias("added"))


def span_list(spans: Column) -> Column:
    """kind:start:end of spans by start, then kind, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    order = F.array_sort(F.transform(spans, lambda b: F.struct(b["s"].alias("s"), b["kind"].alias("kind"), b["e"].alias("e"))))
    return F.array_join(F.transform(order, lambda b: F.concat(F.get(kinds, b["kind"]), F.lit(":"), b["s"], F.lit(":"), b["e"])), ",")
