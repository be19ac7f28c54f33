"""Periodic runs, ranked lexical search and contextual personal data against brute force."""

import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from casewright.llm import contextual_pii as pii
from casewright.llm import lexical_search, periodic_runs, queries
from tests.llm.test_operators import SCHEMA, awkward, split


def brute_runs(words, least=24, repeats=3):
    found = {}
    for q in range(1, len(words) // repeats + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i > start and i + q - start >= max(least, repeats * q):
                found.setdefault((start, i + q), q)
            i += 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def test_find_runs():
    pick = random.Random(1)
    for _ in range(150):
        docs = []
        for _ in range(pick.randint(1, 8)):
            n, k = pick.choice([0, 1, 5, 30, 60, 200, 400]), pick.choice([1, 2, 2, 3, 30])
            words = [pick.randrange(k) for _ in range(n)]
            if n > 30 and pick.random() < 0.7:
                a = pick.randrange(n)
                p = pick.randint(1, max(1, (n - a) // 3))
                for i in range(a, pick.randint(a, n)):
                    words[i] = words[a + (i - a) % p]
            docs.append(words)
        docs += [list(range(50, 90)) + d for d in docs[:2]] + docs[:1]  # passages that texts share
        least, repeats = pick.choice([(24, 3), (24, 3), (6, 2), (1, 2)])
        ends = np.cumsum([len(d) for d in docs])
        first, last, period = periodic_runs.find_runs(np.array(sum(docs, []), np.int64), ends, least, repeats)
        begin = np.concatenate([[0], ends[:-1]])
        want = [(s + b, n, q) for d, b in zip(docs, begin) for s, n, q in brute_runs(d, least, repeats)]
        assert sorted(zip(first, last - first, period)) == sorted(want)


def test_difference_cover():
    every = {(a - b) % periodic_runs.SIZE for a in periodic_runs.COVER for b in periodic_runs.COVER}
    assert every == set(range(periodic_runs.SIZE))
    text = np.random.default_rng(3).integers(0, 2, 700)
    text = np.concatenate([text, text[:500], [2], np.arange(3, 4 + periodic_runs.SIZE)])
    lce = periodic_runs.Extensions(text)
    i, j = np.array(list(itertools.islice(itertools.permutations(range(0, 1190, 7), 2), 5000))).T
    got = lce.reach(i, j)
    for a, b, n in zip(i, j, got):
        assert (text[a : a + n] == text[b : b + n]).all() and text[a + n] != text[b + n]


def test_periodic_runs(spark):
    docs, rows = awkward(spark)
    loops = [(200 + i, " ".join([*"xyz", *(["a", "b", "c"][: 1 + i % 3] * 30), "end"]) + "\n tail", None, "s", 1, "r", "k", 3) for i in range(4)]
    loops.append((300, "the the\t" * 20_000, "en", "a", 1, None, None, None))
    frame = docs.unionByName(spark.createDataFrame(loops, SCHEMA))
    want = []
    for row in [*rows, *loops]:
        words = split(row[1])
        runs = [(0, 40_000, 1)] if row[0] == 300 else brute_runs(words) if len(words) < 20_000 else None
        gone = {p for s, n, q in runs or [] for p in range(s + q, s + n)}
        want.append((row[0], len(words), runs, " ".join(w for p, w in enumerate(words) if p not in gone)))
    got = [(r["row"]["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed_text"]) for r in periodic_runs.periodic_runs(frame).collect()]
    skipped = {w[0] for w in want if w[2] is None}
    assert sorted((g for g in got if g[0] not in skipped), key=repr) == sorted((w for w in want if w[2] is not None), key=repr)
    assert len(got) == len(want) and any(g[2] for g in got)
    assert periodic_runs.periodic_runs(docs.filter("false")).count() == 0


def test_planted_periods(spark):
    """The query's periodic texts, word by word."""
    texts = {i: " ".join(f"w{k}" for k in range(i % 90)) for i in range(300)}
    frame = spark.createDataFrame([*texts.items(), (None, "a b"), (5000, None)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["t"] for r in frame.select("doc_id", queries._with_periods("text", "doc_id").alias("t")).collect()}
    changed = 0
    for i, text in texts.items():
        words, h = split(text), zlib.crc32(str(i).encode())
        if h % 10 == 0 and words:
            a, n, g = h // 10 % len(words), len(words), h // 10
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
            changed += 1
        assert split(got[i]) == words
    assert changed > 10 and got[None] == "a b" and got[5000] is None


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


@pytest.mark.parametrize("most", [1 << 20, 40])
def test_lexical_top_k(spark, most):
    docs, rows = awkward(spark, n=80)
    hot = [(i, "w1 w2 Éa-w1 extra%d" % i, "en", "a", 1, "r", "k", 1) for i in range(500, 560)]  # one bag, many documents
    frame = docs.unionByName(spark.createDataFrame(hot, SCHEMA)).repartition(5)
    items = [(1, "w1 W2 w1 é"), (2, rows[3][1]), (3, rows[7][1]), (4, ""), (5, None), (6, "nowhere"), (2, rows[3][1]), (None, "w5 THE w9"), (7, "éa x")]
    got = lexical_search.lexical_top_k(frame, spark.createDataFrame(items, "item_id bigint, text string").withColumn("words", F.lit(1)), k=7, most=most)
    bags = [(r[0], collections.Counter(terms(r[1]))) for r in [*rows, *hot]]
    bags = [(d, b) for d, b in bags if b]
    total, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = collections.Counter(t for _, b in bags for t in b)
    want = []
    for item, text in dict.fromkeys(items):
        scores = []
        for d, b in bags:
            m = 100 - 75 + (75 * sum(b.values()) * total) // length
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * b[t]) // (1000 * b[t] + 8 * m)) for t in terms(text) if t in b)
            if s > 0:
                scores.append((-s, d is None, d))
        want += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:7])]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert lexical_search.lexical_top_k(docs.filter("false"), docs.select(F.col("doc_id").alias("item_id"), "text")).count() == 0
    assert lexical_search.lexical_top_k(docs, docs.select(F.col("doc_id").alias("item_id"), "text").filter("false")).count() == 0


RULES = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute_base(text):
    found = []
    for kind, rule in enumerate(RULES):
        for m in re.finditer(rule, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0
            if kind == 0 or kind == 1 and all(int(p) <= 255 for p in m[0].split(".")) or kind == 2 and 12 <= len(digits) <= 19 and luhn or kind == 3 and 9 <= len(digits) <= 15:
                found.append((m.start(), m.end(), kind))
    return sorted(found, key=lambda f: (f[0], f[2]))


def test_base_entities():
    pick = random.Random(2)
    parts = ["a", "1", "0", "22", "255", ".", "@", "-", " ", "+", "(", ")", "é", "4", "x.y", "a@b.c", "1.2.3.4", "+1 234 567 890", "4111111111111111"]
    for _ in range(20_000):
        text = "".join(pick.choices(parts, k=pick.randint(1, 25)))
        assert pii.base_entities(text) == brute_base(text), text
    for text in ("1" * 200_000, "a" * 200_000, "a." * 100_000 + "@", "1." * 100_000, "@" * 100_000):
        pii.base_entities(text)  # in time that grows with the length


def brute_known(edges, seeds, rounds, confidence, support):
    of = collections.defaultdict(set)
    for p, v in edges:
        of[p].add(v)
    known = set(seeds)
    for _ in range(rounds):
        best = {}
        for p, values in of.items():
            for kind in range(4):
                k, n = sum((v, kind) in known for v in values), len(values)
                share = k / n
                bound = (share + 2 / n - 2 * math.sqrt(share * (1 - share) / n + 1 / n / n)) / (1 + 4 / n)
                if k >= support and bound >= confidence:
                    for v in values:
                        best[v] = max(best.get(v, (0, 0)), (bound, -kind))
        fresh = {(v, -k) for v, (_, k) in best.items() if v not in {v for v, _ in seeds}}
        if len(set(seeds) | fresh) == len(known):
            return set(seeds) | fresh
        known = set(seeds) | fresh
    return known


def test_score_candidates(spark):
    pick = random.Random(5)
    for trial in range(3):
        values = [f"v{i}" for i in range(120)]
        seeds = {(v, pick.randrange(3)) for v in pick.sample(values, 60)}
        kind = dict(seeds)
        edges = {(f"p{(kind.get(v, 9) if pick.random() < 0.9 else 7)}{pick.randrange(3)}", v) for v in values for _ in range(3)}
        edges |= {(f"p{pick.randrange(3)}{pick.randrange(3)}", v) for v in values if v not in kind and pick.random() < 0.3}
        got = pii.score_candidates(spark.createDataFrame(list(edges), "pattern string, value string"), spark.createDataFrame(list(seeds), "value string, kind int"), 4, 0.4, 3)
        assert {tuple(r) for r in got.collect()} == brute_known(edges, seeds, 4, 0.4, 3) and got.count() > len(seeds)


def test_contextual_pii(spark):
    docs, rows = awkward(spark, n=40)
    texts = [f"Please call me at +1 (20{i % 10}) 555-01{i:02d} or write, room {i} says no{i}" for i in range(30)]
    texts += ["we call me at 020-7946-0958 or write", "both +1 (209) 555-0199 4111111111111111 here", "no +44 20 7946 0958, é mail é.x@y.org;", "a@b.co 999.1.1.1 +12"]
    texts += [texts[0]] * 3
    extra = [(1000 + i // 2, t, "en", "a", 1, "r", "k", 2) for i, t in enumerate(texts)] + [(None, texts[1], None, None, None, None, None, None)]
    frame = docs.unionByName(spark.createDataFrame(extra, SCHEMA)).repartition(4)
    got = pii.contextual_pii(frame, carry=["text"]).collect()
    assert len(got) == len(rows) + len(extra)
    added = {}
    for r in got:
        text = r["row"]["text"] or ""
        assert [tuple(x) for x in r["base"]] == brute_base(text)
        for x in r["added"]:
            assert all(x["e"] <= b["s"] or b["e"] <= x["s"] for b in r["base"])
            added.setdefault(text[x["s"] : x["e"]], set()).add(pii.KINDS[x["kind"]])
    assert added == {"020-7946-0958": {"phone"}, "+1 (209) 555-0199": {"phone"}}  # by its words; by its shape
    assert pii.contextual_pii(docs.filter("false")).count() == 0
    one = spark.range(1).select(F.expr("array(named_struct('s', 4, 'e', 9, 'kind', 3), named_struct('s', 4, 'e', 6, 'kind', 1))").alias("x")).select(pii.span_list(F.col("x"))).first()[0]
    assert one == "ip:4:6,phone:4:9"
