"""The training-data operators against brute force, on rows with every awkward case."""

import itertools
import math
import os
import random
import re
import time
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from casewright.llm import chunks, features, html_text, mixing, quality, quality_rules, queries, search, simhash, token_shards, tokenizer, toxicity
from casewright.llm.substring_dedup import substring_dedup

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, _key string, words int"
SPACES = re.compile(r"[\x20\x09-\x0D]+")


def split(text):
    return [w for w in SPACES.split(text or "") if w]


def awkward(spark, n=60, seed=1):
    """Copies, ties, nulls, an empty and a very long text, repeated rows, columns with clashing names."""
    pick = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["É x", "THE", "the"]
    passage = " ".join(pick.choices(vocab, k=30))
    rows = []
    for i in range(n):
        text = " ".join(pick.choices(vocab, k=pick.randint(1, 60)))
        if i % 7 == 0:
            text = text + "\n" + passage + " \t" + text
        if i % 11 == 0 and rows:
            text = rows[-1][1]
        rows.append((i, text, pick.choice(["en", "fr", None]), pick.choice(["b", "a", None, "é"]), 1, "r", "k", 5))
    rows += [(n, None, None, None, None, None, None, None), (n + 1, "", "en", "a", 0, "", "", 0), (n + 2, "  \n", "en", "a", 0, "", "", 0)]
    rows += [(n + 3, " ".join(pick.choices(vocab, k=30_000)), "en", "a", 0, "", "", 0), rows[0], rows[0], (None, passage, "en", "b", 1, "", "", 1)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3), rows


def key(row):
    return (row[0] is None, row[0] or 0, row[1] or "")


def test_substring_dedup(spark):
    docs, rows = awkward(spark)
    seen, want = set(), []
    for row in sorted(rows, key=key):
        words = split(row[1])
        gone = set()
        for i in range(len(words) - 19):
            window = tuple(words[i : i + 20])
            if window in seen:
                gone.update(range(i, i + 20))
            seen.add(window)
        want.append((row[0], len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    for size in (1 << 12, 8 << 20):
        got = [(r["row"]["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dedup(docs, chunk_bytes=size, group_bytes=1 << 14).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    spans = substring_dedup(docs).filter("n_removed > 0").first()
    assert sum(s["last"] - s["first"] for s in spans["removed"]) == spans["n_removed"]
    assert substring_dedup(docs.filter("false")).count() == 0


def brute_print(text):
    words = split("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_groups(spark):
    docs, rows = awkward(spark)
    prints = [brute_print(r[1]) for r in rows]
    group = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if bin(prints[i] ^ prints[j]).count("1") <= 4:
            a, b = group[i], group[j]
            group = [a if g == b else g for g in group]
    least = {g: min((r[0] for r, h in zip(rows, group) if h == g and r[0] is not None), default=None) for g in group}
    want = [(r[0], p, least[g]) for r, p, g in zip(rows, prints, group)]
    got = [(r["row"]["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.simhash_groups(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert simhash.simhash_groups(docs.filter("false")).count() == 0


def test_tiles_lose_no_link():
    pick = np.random.default_rng(3)
    base = pick.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = base[pick.integers(0, 40, 300)] ^ (np.uint64(1) << pick.integers(0, 64, 300).astype(np.uint64))
    prints = np.unique(np.concatenate([base, near]))
    a, b = simhash.tile_links(prints, prints, 4, block=16)
    assert len(a) < 2 * len(prints)  # each fingerprint is in both tiles

    def groups(links):
        parent = {p: p for p in prints.tolist()}
        find = lambda x: x if parent[x] == x else find(parent[x])
        for x, y in links:
            parent[find(x)] = find(y)
        return {frozenset(k for k in parent if find(k) == find(p)) for p in parent}

    every = [(x, y) for x, y in itertools.combinations(prints.tolist(), 2) if bin(x ^ y).count("1") <= 4]
    assert groups(zip(a.tolist(), b.tolist())) == groups(every)


def test_mixing_meets_targets(spark):
    docs, rows = awkward(spark, n=200, seed=5)
    got = mixing.mix_sources(docs, carry=["source"]).collect()
    again = mixing.mix_sources(docs.repartition(7), carry=["source"]).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again)) and len(got) == len(rows)
    sizes, taken, target = {}, {}, {}
    for r in got:
        s = r["row"]["source"]
        sizes[s] = sizes.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r["size"] * r["copies"]
        target[s] = r["target"]
        assert 0 <= r["copies"] <= 3
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    want, left, open_ = {}, sum(sizes.values()), set(order)
    while open_:  # share, cap, reshare the excess
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        want.update({s: 3 * sizes[s] for s in over} if over else share)
        left -= sum(3 * sizes[s] for s in over)
        open_ = open_ - over if over else set()
    for s in order:
        biggest = max(r["size"] for r in got if r["row"]["source"] == s)
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - target[s]) <= 3 * biggest
    assert mixing.mix_sources(docs.filter("false")).count() == 0


def test_tokenizer_equals_the_library(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer.PIECES)
    docs, rows = awkward(spark, n=20)
    extra = [" ", "a  b\n\n c", "　ｆ① \t x", "é́😀 😀x", "trail  ", "ab\x00c", "x" * 300]
    frame = docs.select("doc_id", "text").union(spark.createDataFrame([(500 + i, t) for i, t in enumerate(extra)], "doc_id bigint, text string"))
    for r in frame.join(tokenizer.sentencepiece_encode(frame).select("row.doc_id", "ids", "decoded"), "doc_id").collect():
        assert r["ids"] == model.encode(r["text"] or "") and r["decoded"] == (r["text"] or "")
    coded = tokenizer.sentencepiece_encode(frame, decoded=False).select("row.doc_id", "ids")
    texts = {r["row"]["doc_id"]: r["decoded"] for r in tokenizer.sentencepiece_decode(coded).collect()}
    assert texts[501] == extra[1] and texts[20] == ""


def test_best_sum_walk():
    pieces = tokenizer.load(tokenizer.PIECES)
    walk = object.__new__(tokenizer.Pieces)
    walk.score = {"a": -1.0, "b": -1.5, "ab": -1.7, "c": -2.0, "abc": -4.0, "bc": -1.0}
    walk.ids = {p: i for i, p in enumerate(walk.score)}
    walk.id_tuples = {p: (i,) for p, i in walk.ids.items()}
    walk.merges, walk.longest, walk.floor, walk.unknown, walk.byte_ids = False, 3, -10.0, 99, {}
    words = sorted("".join(w) for n in (1, 2, 3, 4) for w in itertools.product("abc", repeat=n))

    def best(word):
        ways = {"": 0.0}
        return max(
            (sum(walk.score[p] for p in parts) for k in range(len(word)) for cut in itertools.combinations(range(1, len(word)), k)
             for parts in [[word[a:b] for a, b in zip((0, *cut), (*cut, len(word)))]] if all(p in walk.score for p in parts)), default=ways[""]
        )

    back = {i: p for p, i in walk.ids.items()}
    for word, ids in zip(words, walk.encode_sorted(words)):
        assert sum(walk.score[back[i]] for i in ids) == pytest.approx(best(word))
    assert pieces.merges


def test_shards(spark, tmp_path):
    for n in (1, 2, 3, 10, 1000):
        assert sorted(token_shards.feistel(np.arange(n), n, 7)) == list(range(n))
    docs, rows = awkward(spark, n=20)
    packed = token_shards.pack_sequences(docs, length=64, chunk_bytes=1 << 16)
    shards = token_shards.training_shards(packed, per_shard=16)
    path = f"{tmp_path}/shards"
    token_shards.write_shards(shards.filter("shard < 3"), path)
    token_shards.write_shards(shards, path)  # goes on with the rest
    n = packed.count()
    slots = token_shards.read_slots(spark, path, 0, n).collect()
    assert [r["slot"] for r in slots] == list(range(n))
    assert sorted(bytes(r["tokens"]) for r in slots) == sorted(bytes(r["tokens"]) for r in packed.collect())
    coder = token_shards.coder(token_shards.RANKS)
    streams = {}
    for r in packed.orderBy("chunk", "seq").collect():
        streams.setdefault(r["chunk"], []).extend(np.frombuffer(r["tokens"], "<u2")[: r["n_tokens"]].tolist())
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    want = sorted(tuple(coder.encode_ordinary(r[1] or "")) for r in ordered)
    stream = [t for c in sorted(streams) for t in streams[c]]
    ends = [-1, *(i for i, t in enumerate(stream) if t == token_shards.END)]
    assert sorted(tuple(stream[a + 1 : b]) for a, b in zip(ends, ends[1:])) == want
    assert [r["slot"] for r in token_shards.read_slots(spark, path, 5, 20).collect()] == list(range(5, 25))
    assert token_shards.training_shards(token_shards.pack_sequences(docs.filter("false"))).count() == 0


def test_shards_query_writes_ranges(spark, tmp_path):
    back = queries.op4_token_shards(spark, "/root/testdata/sf0.001")
    path = os.path.dirname(back.inputFiles()[0])
    n = back.agg(F.sum("n_sequences")).first()[0]
    assert "/casewright/" in path and [r["slot"] for r in token_shards.read_slots(spark, path, 0, n).collect()] == list(range(n))
    docs, _ = awkward(spark, n=40)
    packed = token_shards.pack_sequences(docs, length=64, chunk_bytes=1 << 14)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        token_shards.write_shards(token_shards.training_shards(packed, per_shard=16), f"{tmp_path}/ranged")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    written = spark.read.parquet(f"{tmp_path}/ranged")
    runs = sorted((r["lo"], r["hi"]) for r in written.groupBy(F.input_file_name()).agg(F.min("shard").alias("lo"), F.max("shard").alias("hi")).collect())
    assert len(runs) > 2 and all(a[1] < b[0] for a, b in zip(runs, runs[1:]))


def test_stopped_shard_write_keeps_finished_tasks(spark, tmp_path):
    docs, _ = awkward(spark, n=40)
    shards = token_shards.training_shards(token_shards.pack_sequences(docs, length=64, chunk_bytes=1 << 14), per_shard=4)
    whole = {r["shard"]: bytes(r["payload"]) for r in shards.collect()}
    last = max(whole)

    def fail(batches):
        for batch in batches:
            if last in batch.column("shard").to_pylist():
                time.sleep(6)  # the other tasks are committed meanwhile
                raise ValueError("lost")
            yield batch

    path = f"{tmp_path}/stopped"
    with pytest.raises(Exception, match="lost"):
        token_shards.write_shards(shards.mapInArrow(fail, shards.schema), path)
    kept = {f for f in os.listdir(path) if f.endswith(".parquet")}
    there = {r["shard"] for r in spark.read.parquet(path).collect()}
    assert there and last not in there
    token_shards.write_shards(shards, path)
    back = spark.read.parquet(path).collect()
    assert len(back) == len(whole) and {r["shard"]: bytes(r["payload"]) for r in back} == whole
    assert kept <= set(os.listdir(path))
    # chunks are counted from the shuffle that packs them: nothing is encoded twice
    assert "ReusedExchange" in shards._jdf.queryExecution().executedPlan().toString()


def test_main_text():
    page = (
        "<html><head><title>t</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a></li></ul></nav>"
        "<!-- <p>no</p> --><div class='cookie-notice'>We use cookies. Accept them all, please.</div><article><h1>Big&nbsp;news</h1><p>One &amp; two\n three."
        "<p>A longer paragraph with a <a href=y>link</a> in it, and some words to read.<script>var p='</p>';</script>"
        "<form><input>Sign up<button>Go</button></form><div class=comments><p>First comment, written by a reader of the page.</p></div></article>"
        "<aside><p>Related things that you may like to read some day.</p></aside><footer>&copy; 2024 all of us</footer></bo"
    )
    assert html_text.main_text(page) == "Big news One & two three. A longer paragraph with a link in it, and some words to read."
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<") == ""
    assert html_text.main_text("<article><p>a &am") == "a &am"


def test_minimum_cut():
    pick = random.Random(4)
    for _ in range(60):
        n = pick.randint(1, 7)
        costs = [pick.uniform(-2, 2) for _ in range(n)]
        edges = [(a, b, pick.uniform(0, 2)) for a, b in itertools.combinations(range(n), 2) if pick.random() < 0.6]
        energy = lambda x: sum(abs(c) for c, y in zip(costs, x) if (c > 0) != y) + sum(w for a, b, w in edges if x[a] != x[b])
        assert energy(html_text.minimum_cut(costs, edges)) == pytest.approx(min(energy(x) for x in itertools.product([False, True], repeat=n)))


def test_search(spark):
    docs, rows = awkward(spark, n=80)
    got = search.bm25_top_k(docs, docs.filter("doc_id % 9 = 0"), k=5, shard_bytes=1 << 12, pairs_per_task=100)
    found = {}
    for r in got.orderBy("qid", "rank").collect():
        found.setdefault(r["qid"], []).append((r["doc_id"], r["score"]))
    bags = [(r[0], {}) for r in rows]
    for (_, bag), r in zip(bags, rows):
        for w in split(re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or "")):
            bag[w] = bag.get(w, 0) + 1
    mean = sum(sum(b.values()) for _, b in bags) / len(bags)
    df = {}
    for _, b in bags:
        for w in b:
            df[w] = df.get(w, 0) + 1
    for qid, bag in {d: b for d, b in bags if d is not None and d % 9 == 0 and b}.items():
        scores = []
        for d, b in bags:
            norm = 1.2 * (0.25 + 0.75 * sum(b.values()) / mean)
            s = sum(n * math.log1p((len(bags) - df[w] + 0.5) / (df[w] + 0.5)) * b[w] * 2.2 / (b[w] + norm) for w, n in bag.items() if w in b)
            if s > 0:
                scores.append((-round(s, 6), d is None, d))
        want = sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:5]
        assert [s for _, s in found[qid]] == pytest.approx([-s for s, _, _ in want], abs=2e-6)
        assert [d for d, _ in found[qid]] == [d for _, _, d in want]
    assert search.bm25_top_k(docs.filter("false"), docs.filter("false")).count() == 0


def test_shard_scores_from_one_copy_of_its_postings(spark, monkeypatch):
    """Exact scores of frequent and rare terms without a second copy of the postings by document, nor a second pass over the texts."""
    pick = random.Random(8)
    texts = [" ".join(f"w{int(pick.paretovariate(0.5)) % 900}" for _ in range(pick.randint(1, 60))) for _ in range(300)]
    index = search._shard_index(pa.table({"_key": pa.array(range(300)), "_text": texts, "shard": pa.array([0] * 300, pa.int32())}))
    mean = sum(len(t.split()) for t in texts) / 300
    shard = search.Shard(index, mean)
    assert 0 < (shard.column >= 0).sum() < len(shard.terms)
    assert sorted(n for n, x in vars(shard).items() if isinstance(x, np.ndarray) and x.shape == shard.docs.shape) == ["docs", "impact"]
    pairs = [(int(d) + lo, t, c) for lo, _, terms, doc, tf, _ in search.term_counts(pa.chunked_array([texts])) for t, d, c in zip(terms.tolist(), doc, tf.tolist())]
    place = {t: i for i, t in enumerate(shard.terms.tolist())}
    bags = [{} for _ in texts]
    for d, t, c in pairs:
        bags[d][place[t]] = c
    idf = np.random.default_rng(1).uniform(0.5, 6, len(shard.terms))
    asked = [(np.array(sorted(b)), np.array([b[t] for t in sorted(b)])) for b in bags]
    group = SimpleNamespace(qids=range(300), terms=shard.terms, queries=lambda at, upto: asked[at:upto])
    for (docs, scores), bag in zip(shard.top(group, idf, 7), bags):
        want = []
        for d, b in enumerate(bags):
            norm = 1.2 * (0.25 + 0.75 * len(texts[d].split()) / mean)
            s = sum(n * idf[t] * b[t] * 2.2 / (b[t] + norm) for t, n in bag.items() if t in b)
            want += [(-round(s, 6), d, s)] if s > 0 else []
        want = sorted(want)[:7]
        assert scores == pytest.approx([s for *_, s in want], abs=2e-6) and shard.keys.take(pa.array(docs)).to_pylist() == [d for _, d, _ in want]
    monkeypatch.delattr(search.F, "regexp_count")
    docs = spark.createDataFrame(list(enumerate(texts[:20])), "doc_id bigint, text string")
    assert search.bm25_top_k(docs, docs).count() > 0


def test_search_moves_neither_index_nor_queries_for_each_other(spark, monkeypatch):
    """Queries travel in packed groups of bounded size, some groups at a time; a shard's index is read whole where it lies."""
    docs, _ = awkward(spark, n=80)
    asked = docs.filter("doc_id % 3 = 0")
    got = search.bm25_top_k(docs, asked, k=5, shard_bytes=1 << 12, pairs_per_task=200, sent_bytes=1)
    plan = got._jdf.queryExecution().toString()
    assert "CoGroup" not in plan and "hashpartitioning(shard" not in plan
    assert plan.split("== Physical Plan ==")[1].count("MapInArrow") > 3  # one for each group sent
    rows = sorted(got.collect())
    assert len(rows) > 100 and rows == sorted(search.bm25_top_k(docs, asked, k=5).collect())
    assert search.bm25_top_k(docs, docs.filter("false")).count() == 0
    monkeypatch.setattr(search, "WHOLE", 0)  # as for shards too large for one row group
    assert rows == sorted(search.bm25_top_k(docs, asked, k=5, shard_bytes=1 << 12, pairs_per_task=200, sent_bytes=1 << 10).collect())


def test_query_groups_are_bounded(spark):
    """A task holds about a million pairs of a query and a term, however many there are."""
    pairs = F.expr("transform(sequence(1, 500), x -> struct(id * 7 + x * x as term, x as df, cast(x % 3 + 1 as int) as qtf))")
    weighed = spark.range(3000, numPartitions=4).select(F.col("id").alias("qid"), pairs.cast("array<struct<term:bigint,df:bigint,qtf:int>>").alias("terms"))
    sent = list(search.rounds(search.query_groups(weighed, search.PAIRS), search.SENT))
    groups = [search.Asked(packed) for packed in itertools.chain(*sent)]
    assert len(sent) == 1 and len(groups) == 2 and all(len(g.steps) < 1 << 20 for g in groups)
    assert sorted(q for g in groups for q in g.qids.to_pylist()) == list(range(3000))
    for g in groups:
        for qid, (numbers, counts) in list(zip(g.qids.to_pylist(), g.queries(0, len(g.qids))))[:20]:
            want = {qid * 7 + x * x: (x, x % 3 + 1) for x in range(1, 501)}
            assert {t: c for t, c in zip(g.terms[numbers].tolist(), counts.tolist())} == {t: c for t, (_, c) in want.items()}
    frame = spark.createDataFrame([(bytes(n),) for n in (3, 3, 9, 1, 2, 4)], "packed binary").coalesce(1)
    assert [[len(x) for x in r] for r in search.rounds(frame, 6)] == [[3, 3], [9], [1, 2], [4]]
    assert list(search.rounds(frame.limit(0), 6)) == [[]]


def test_index_of_a_shard_is_read_whole(spark):
    texts = [" ".join(f"w{(i * j) % 997}" for j in range(40)) for i in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    index = search.materialize(search.build_index(docs, "doc_id", "text", 1 << 14), by="shard", whole=True)
    shards = index.select("shard").distinct().count()
    assert shards > 4 and len(index.inputFiles()) == shards
    assert index.mapInArrow(lambda b: (t.select(["shard"]).slice(0, 1).to_batches()[0] for t in search.whole_shards(b)), "shard int").distinct().count() == shards
    rows = pa.table({"shard": pa.array([4, 4, 4, 2, 9, 9], pa.int32()), "slices": pa.array([3, 3, 3, 1, 2, 2], pa.int32()), "slice": range(6)})
    for cut in ([6], [1, 5], [2, 2, 2], [3, 1, 2], [4, 1, 1]):
        batches = [rows.slice(a, n).combine_chunks().to_batches()[0] for a, n in zip(itertools.accumulate([0, *cut]), cut)]
        assert [t["slice"].to_pylist() for t in search.whole_shards(iter(batches))] == [[0, 1, 2], [3], [4, 5]]
    for a, n in ((0, 2), (1, 5), (3, 2)):
        with pytest.raises(ValueError, match="several tasks"):
            list(search.whole_shards(iter(rows.slice(a, n).combine_chunks().to_batches())))


def test_base_metrics(spark):
    docs, rows = awkward(spark, n=30)
    rows_ = [(i, t) for i, t in enumerate([*(r[1] for r in rows), "a a a a a a a", "x\nx\n \nx", "#a $b <c> É"])]
    df = spark.createDataFrame(rows_, "i int, _text string")
    for r in quality_rules.base_metrics(df).collect():
        text = r["_text"] or ""
        words = split(text)
        where = {}
        for p in range(len(words) - 4):
            where.setdefault(tuple(words[p : p + 5]), []).append(p)
        covered = {p + k for ps in where.values() if len(ps) > 1 for p in ps for k in range(5)}
        lines = [x for x in text.split("\n") if split(x)]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(words) < 10 or 100 * len(covered) > 20 * len(words))


def test_cutoffs_keep_their_promise(spark):
    tail = spark.range(1).select(*[quality_rules.at_most(F.lit(k).cast("bigint"), F.lit(n).cast("bigint"), 0.1).alias(f"p{n}_{k}") for n, k in [(50, 0), (50, 3), (400, 25), (10, 5)]]).first()
    exact = lambda n, k: sum(math.comb(n, i) * 0.1**i * 0.9 ** (n - i) for i in range(k + 1))
    assert tail["p50_0"] == pytest.approx(exact(50, 0)) and tail["p50_3"] == pytest.approx(exact(50, 3)) and tail["p400_25"] == pytest.approx(exact(400, 25))
    assert tail["p10_5"] == 1.0
    pick = random.Random(2)
    rows = [("s", int(good), (pick.random() * 0.4 if good else pick.random())) for good in [True] * 900 + [False] * 300] + [("few", 1, 0.1)] * 20 + [("few", 0, 0.9)] * 20
    held = spark.createDataFrame(rows, "stratum string, y bigint, m double")
    got = {r["stratum"]: r["cut_m"] for r in quality_rules.choose_cutoffs(held, {"m": [0.1, 0.3, 0.35, 0.41, 0.6]}, limit=0.05, risk=0.05).collect()}
    assert got == {"s": 0.41}  # the strictest that rejects no good one; 20 rows prove nothing
    assert quality_rules.choose_cutoffs(held.filter("false"), {"m": [0.1]}).count() == 0


def test_classifiers_without_labels_or_rows(spark):
    docs, rows = awkward(spark, n=12)
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 1), (2, None, None)], "doc_id bigint, quality int, toxic int")
    for scores in (quality.quality_scores, toxicity.toxicity_scores):
        for some in (labels, labels.filter("false")):
            got = scores(docs, some).collect()
            assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
        assert scores(docs.filter("false"), labels).count() == 0
    judged = quality_rules.quality_rules(docs, labels).collect()
    assert len(judged) == len(rows) and all(not r["kept"] for r in judged if r["n_words"] < 10)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"  # the smaller tables hold six toxic texts to judge by
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    for scores, label in ((quality.quality_scores, "quality"), (toxicity.toxicity_scores, "toxic")):
        held = scores(docs, labels).filter("held_out").select("row.doc_id", "score").join(labels, "doc_id")
        pairs = [(r["score"], r[label]) for r in held.collect()]
        good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
        assert sum((a > b) + (a == b) / 2 for a in good for b in bad) / (len(good) * len(bad)) > 0.95, label


def test_model_parts():
    x = np.array([0, 1, 0, 2, 1, 2, 0, 1])
    ends = np.array([0, 2, 4, 6, 8])
    w = quality.dual_descent(x, np.ones(8), ends, np.array([1, 1, 0, 1]), np.ones(4) * 10, 3, epochs=200)
    assert w[0] > w[2] and w[:3] @ np.array([0, 1, 1]) + w[3] < 0 < w[:3] @ np.array([1, 1, 0]) + w[3]
    pattern = np.array([1, 3, 3, 1 << 15, 0])
    p = toxicity.fit_label_model(pattern, np.array([50, 20, 50, 800, 100]), np.array([1, 1, -1, 0, -1]))
    assert p[3] > 0.9 > 0.1 > p[1 << 15]
    assert toxicity.fit_label_model(pattern[:0], pattern[:0], pattern[:0]) == {}
    assert features.word_ids(["Idiot"]) == features.word_ids(["idiot"])


def test_tokenise_decodes_every_row(spark, monkeypatch):
    docs, rows = awkward(spark, n=20)
    docs = docs.union(docs.limit(1).withColumn("text", F.lit("\u2581a \u2581 b\u2581"))).select(*corpus_pipeline.COLUMNS)
    coded = corpus_pipeline.tokenise(spark, docs, "").collect()
    assert len(coded) == len(rows) + 1 and all(r["decodes"] and r["n_tokens"] == len(r["ids"]) for r in coded)
    encode = corpus_pipeline.sentencepiece_encode

    def wrong(*args, **kwargs):  # one row's ids are of another text
        made = encode(*args, **kwargs)
        return made.withColumn("decoded", F.when(F.col("row.doc_id") == 7, "x").otherwise(F.col("decoded")))

    monkeypatch.setattr(corpus_pipeline, "sentencepiece_encode", wrong)
    coded = corpus_pipeline.tokenise(spark, docs, "").collect()
    assert {r["doc_id"] for r in coded if not r["decodes"]} == {7} and len(coded) == len(rows) + 1


def test_near_dedup_keeps_one_of_each_group(spark):
    docs, rows = awkward(spark)
    prints = [brute_print(r[1]) for r in rows]
    group = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if bin(prints[i] ^ prints[j]).count("1") <= 4:
            a, b = group[i], group[j]
            group = [a if g == b else g for g in group]
    least = {min((r[0] is None, r[0] or 0) for r, h in zip(rows, group) if h == g) for g in set(group)}
    kept = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept) == sorted(least)
    texts = {(r[0], r[1]) for r in rows}
    assert all((r["doc_id"], r["text"]) in texts for r in kept)


def test_mix_and_quality_stages_row_by_row(spark, tmp_path):
    docs, rows = awkward(spark, n=80, seed=3)
    columns = docs.select(*corpus_pipeline.COLUMNS)
    mixed = corpus_pipeline.mix(spark, columns, "").collect()
    want = {}
    for r in mixing.mix_sources(docs, carry=corpus_pipeline.COLUMNS).collect():
        want[tuple(r["row"])] = want.get(tuple(r["row"]), 0) + r["copies"]
    got = {}
    for r in mixed:
        got[tuple(r)] = got.get(tuple(r), 0) + 1
    assert got == {k: n for k, n in want.items() if n}
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    kept = corpus_pipeline.quality_filter(spark, columns, str(tmp_path)).collect()
    scored = quality.quality_scores(columns, labels, carry=corpus_pipeline.COLUMNS).filter("score >= 0.5").collect()
    assert sorted(map(repr, kept)) == sorted(repr(r["row"]) for r in scored)


def test_mixing_cuts_identical_rows(spark):
    """Copies of one row are taken until the target is reached, not together or not at all."""
    rows = [(7, "a b c d", None, "a", 1)] * 900 + [(i, "x y", None, "b", i) for i in range(600)] + [(9, "p q r", None, "c", i % 3) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for carry in ([], ["n_chars"]):
        got = mixing.mix_sources(docs, carry=["source", *carry]).collect()
        again = mixing.mix_sources(docs.repartition(9), carry=["source", *carry]).collect()
        assert sorted(map(repr, got)) == sorted(map(repr, again))
        for source, size in (("a", 4), ("b", 2), ("c", 3)):
            of = [r for r in got if r["row"]["source"] == source]
            taken = sum(r["size"] * r["copies"] for r in of)
            assert 0 <= of[0]["target"] - taken < size, source


def test_bytes_that_are_not_text(spark):
    words = " ".join(f"w{i}" for i in range(25))
    docs = spark.createDataFrame([(1, words), (2, words), (3, "a")], "doc_id bigint, t string").selectExpr("doc_id", "concat(cast(unhex('ff') as string), ' ', t) as text")
    got = {r["doc_id"]: (r["n_removed"], r["h"]) for r in substring_dedup(docs).select("row.doc_id", "n_removed", F.hex(F.col("kept_text").cast("binary")).alias("h")).collect()}
    assert got[1] == (0, "FF20" + words.encode().hex().upper()) and got[2] == (26, "") and got[3] == (0, "FF2061")


def test_sample_sizes(spark):
    """The share of a bounded sample is right at every size of the table."""
    keys = spark.range(200_000).withColumnRenamed("id", "_key")
    for share in (0.9, 0.1, 0.01, 0.001):
        kept = keys.filter(features.hash_share("_key", share)).count()
        assert abs(kept - 200_000 * share) <= 5 * math.sqrt(200_000 * share) + 1
    for n in (10**6, 10**9, 10**12):  # the threshold is fine enough for any table
        assert int(features.SAMPLE / n * 2.0**63) / 2.0**63 * n == pytest.approx(features.SAMPLE)
    found = spark.createDataFrame([(i, [1, 2, 3]) for i in range(3000)], "_key bigint, ids array<int>")
    assert features.bounded_ids(found).count() == 3000 and abs(features.bounded_ids(found, 900).count() - 300) < 90


def test_main_text_of_pages(spark):
    article = "<article><h1>Big news</h1><p>One two three four. Five six seven eight nine ten eleven.</p></article>"
    text = "Big news One two three four. Five six seven eight nine ten eleven."
    for body in ("single has-sidebar", "home menu-open", "no-comments", "with-footer page"):
        assert html_text.main_text(f"<html class='no-js has-nav'><body class='{body}'>{article}<div class='site-footer'><p>All rights reserved by us, as they say.</p></div>") == text
    assert html_text.main_text("<div><h1>T</h1><p>One.</p></div>") == "T One."
    deep = "<div><p>" * 50_000 + "x y z." + "</span></b></ul>" * 50_000
    assert html_text.main_text(deep) == "x y z."
    schema = "page_id bigint, url string, html string, row string, text string, _html int"
    long = "<article>" + "<p>A sentence of some words, and more of them.</p>" * 20_000 + "</article>"
    rows = [(1, "u", article, "r", "t", 1), (1, "u", article, "r", "t", 1), (None, None, None, None, None, None), (2, "", "", "", "", 0), (3, "v", long, "r", "t", 1)]
    pages = spark.createDataFrame(rows, schema)
    got = [(r["row"]["page_id"], r["text"]) for r in html_text.extract_pages(pages).collect()]
    want = [(r[0], html_text.main_text(r[2])) for r in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr) and len(dict(want)[3].split()) == 9 * 20_000
    assert html_text.extract_pages(pages.filter("false")).count() == 0


def test_classifiers_with_clashing_columns(spark):
    docs, rows = awkward(spark, n=30)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(30)], "doc_id bigint, quality int, toxic int")
    odd = labels.withColumns({"text": F.lit("x"), "y": F.lit(3), "_key": F.lit("k"), "row": F.lit(1)})
    more = docs.withColumns({"y": F.lit(1), "ids": F.lit("i"), "votes": F.lit(2), "score": F.lit(0)})
    for scores in (quality.quality_scores, toxicity.toxicity_scores, quality_rules.quality_rules):
        plain, clashing = scores(docs, labels).collect(), scores(more, odd).collect()
        assert sorted(map(repr, plain)) == sorted(map(repr, clashing))


def test_dual_descent_reaches_the_optimum():
    """The hinge-loss model on 50 rows against a dense primal solver."""
    pick = np.random.default_rng(11)
    x = (pick.random((50, 8)) < 0.4) * pick.normal(size=8)
    y = (x @ pick.normal(size=8) + 0.3 * pick.normal(size=50) > 0).astype(int)
    cols = np.concatenate([np.flatnonzero(r) for r in x])
    ends = np.concatenate([[0], np.cumsum((x != 0).sum(axis=1))])
    values = np.concatenate([r[r != 0] for r in x])
    w = quality.dual_descent(cols, values, ends, y, np.ones(50), 8, epochs=4000)
    wide, sign = np.hstack([x, np.ones((50, 1))]), np.where(y == 1, 1.0, -1.0)
    energy = lambda v: v @ v / 2 + np.maximum(0, 1 - sign * (wide @ v)).sum()
    v, best = np.zeros(9), np.inf
    for step in range(1, 200_001):  # subgradients of a strongly convex function
        v = v - (v - ((sign * (wide @ v) < 1) * sign) @ wide) / step
        if step % 50 == 0:
            best = min(best, energy(v))
    assert energy(w) <= best + 1e-3 * max(1.0, best)


def test_pipeline_stages(spark, tmp_path):
    docs, rows = awkward(spark)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    columns = docs.select(*corpus_pipeline.COLUMNS)
    deduped = corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect()
    groups = simhash.simhash_groups(docs).select("root").distinct().count()
    assert len(deduped) == groups and len({r["doc_id"] for r in deduped}) == groups
    assert corpus_pipeline.passage_dedup(spark, docs, str(tmp_path)).count() == len(rows)
    for some in (columns, columns.filter("false")):
        some.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        out = corpus_pipeline.run(spark, str(tmp_path))
        assert out.columns == ["doc_id", "source", "ids", "n_tokens", "decodes"] and (out.count() > 0) == (some is columns)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "SimHash near-dedup", "substring dedup", "mixing", "sentencepiece"]


def test_chunks_keep_order_and_size():
    """Ranges follow (key, hash), whatever the sample; a key of many rows is spread, as are rows between sampled keys."""
    pick = np.random.default_rng(3)
    for every in (1, 10):
        for hot in (chunks.LAST, 17, 0):
            keys = np.concatenate([np.arange(20_000) * 3, np.full(20_000, hot)])
            hashes = pick.integers(-(1 << 63), 1 << 63, len(keys), np.int64)
            sizes = np.full(len(keys), 100)
            some = hashes % every == 0
            k, at, rows = np.unique(keys[some], return_inverse=True, return_counts=True)
            ranges = chunks.Ranges(k, np.bincount(at, sizes[some]).astype(np.int64), rows, every, 10_000)
            placed = ranges.place(keys, hashes)[np.lexsort((hashes, keys))]
            assert (np.diff(placed) >= 0).all() and placed[0] >= 0 and placed[-1] < ranges.n
            assert np.bincount(placed).max() * 100 <= 2 * 10_000 * (1 if every == 1 else 1.6)
            assert ranges.n <= 1.1 * sizes.sum() / 10_000 + 3  # and chunks are not smaller than they need to be
    k = np.arange(1000) * 1_000_000  # a sample of one row in a million: chunks lie between sampled keys
    ranges = chunks.Ranges(k, np.full(1000, 2000), np.ones(1000, np.int64), 1_000_000, 8 << 20)
    assert ranges.n > 200_000
    keys = np.sort(pick.integers(0, 999_000_000, 400_000))  # up to the last one
    assert np.bincount(ranges.place(keys, np.zeros(len(keys), np.int64)), minlength=ranges.n).max() < 20
    assert chunks.Ranges(*[np.zeros(0, np.int64)] * 3, 1, 1).place(np.array([-5, chunks.LAST]), np.zeros(2, np.int64)).tolist() == [0, 0]
    below = chunks.Ranges(np.array([100]), np.array([500]), np.array([5]), 1, 100)
    assert below.place(np.array([-7, 3]), np.array([(1 << 63) - 1, -(1 << 63)])).tolist() == [0, 0]


def test_hot_null_key_is_spread(spark):
    """Half of the rows have no id: several chunks, and the same result as in one."""
    pick = random.Random(5)
    vocab = [f"v{i}" for i in range(300)]
    passage = " ".join(pick.choices(vocab, k=25))
    texts = [" ".join(pick.choices(vocab, k=40)) + (" " + passage if i % 3 == 0 else "") for i in range(400)]
    docs = spark.createDataFrame([(None if i % 2 else i // 2, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(4)
    ranges = chunks.chunk_ranges(docs, "doc_id", "text", 4000)
    placed = docs.groupBy(chunks.chunk_of("doc_id", "text", ranges).alias("c")).agg(F.sum(F.length("text") + chunks.ROW_BYTES).alias("n"), F.count("*").alias("m")).collect()
    assert max(r["n"] for r in placed) < 2.5 * 4000 and len(placed) > 15
    far = spark.range(0, 40_000).select((F.col("id") * 7 - 5000).alias("doc_id"), F.lit("x" * 36).alias("text"))
    spread = far.groupBy(chunks.chunk_of("doc_id", "text", chunks.chunk_ranges(far, "doc_id", "text", 1000, sample=100))).count()
    assert spread.agg(F.max("count")).first()[0] < 60 and spread.count() > 3000  # 10 on average, sampled or not
    order = {r["text"]: r["h"] for r in docs.select("text", chunks.order_hash("text").alias("h")).collect()}
    seen, want = set(), []
    for doc, t in sorted(((None if i % 2 else i // 2, t) for i, t in enumerate(texts)), key=lambda r: (r[0] is None, r[0] or 0, order[r[1]])):
        words, gone = t.split(), set()
        for i in range(len(words) - 19):
            if (window := tuple(words[i : i + 20])) in seen:
                gone.update(range(i, i + 20))
            seen.add(window)
        want.append((doc, " ".join(w for i, w in enumerate(words) if i not in gone)))
    for size in (4000, 8 << 20):
        got = [(r["row"]["doc_id"], r["kept_text"]) for r in substring_dedup(docs, chunk_bytes=size, group_bytes=1 << 14).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    packed = token_shards.pack_sequences(docs, length=64, chunk_bytes=4000).collect()
    assert len({r["chunk"] for r in packed}) == len(placed)
    coder = token_shards.coder(token_shards.RANKS)
    assert sum(r["n_tokens"] for r in packed) == sum(len(coder.encode_ordinary(t)) + 1 for t in texts)
    best = [
        sorted((r["qid"], r["rank"], r["score"]) for r in search.bm25_top_k(docs, docs.filter("doc_id % 50 = 0"), k=3, shard_bytes=size).collect())
        for size in (4000, 8 << 20)
    ]
    assert best[0] == best[1] and len(best[0]) == 12
