"""Kept ids, numbers, pages and versions; whole texts in parts; ranks by leading bits; sketches."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from casewright import schemas
from casewright.catalog import adapters as A
from casewright.operators import bitmaps as B
from casewright.operators import metrics as M
from casewright.operators import registry, sketches
from casewright.operators.cohort import collect_history, collect_text
from casewright.operators.numbering import page
from casewright.plans import scoring_run
from casewright.sources import results as R

SF_DIR = "/root/testdata/sf0.001"


def ids_of(df, key="llm_caseID"):
    return sorted((r[key] for r in df.select(key).collect()), key=repr)


def test_bitmaps_equal_sets(spark, tmp_path):
    pick = random.Random(1)
    pool = [0, 1, -1, 32767, 32768, 32769, -32768, -32769, 10**12, 2**40, *range(60_000, 60_050), *(pick.randrange(-(10**6), 10**6) for _ in range(300))]
    held = pick.sample(pool, 200)
    cases = spark.createDataFrame([(i, n % 7) for n, i in enumerate([*pool, None, *pool[:5]])], "llm_caseID bigint, batch_no int")
    path = f"{tmp_path}/seen"
    assert B.read_bitmap(spark, path) is None
    for part in (held[:120], held[80:], []):
        B.add_to_bitmap(spark.createDataFrame([(i,) for i in [*part, None]], "llm_caseID bigint"), path)
    kept = B.read_bitmap(spark, path)
    assert kept.groupBy("bucket").count().filter("count > 1").isEmpty() and B.bitmap_size(kept).first()[0] == len(set(held))
    assert ids_of(B.pending_by_bitmap(cases, kept)) == sorted((i for i in [*pool, None, *pool[:5]] if i not in set(held)), key=repr)
    from casewright.operators.progress import completed_batches

    done = spark.createDataFrame([(i,) for i in held], "llm_caseID bigint")
    assert sorted(B.completed_by_bitmap(cases, kept).collect()) == sorted(completed_batches(cases, done).collect())


def test_rounds_read_no_results(spark, tmp_path, monkeypatch):
    """With kept ids only the first run reads the store before the end; a stop between the two writes asks again."""
    cases = A.document_cases(spark, SF_DIR).select(*schemas.CASE.fieldNames()).limit(40)
    reads, read = [], scoring_run.read_results
    monkeypatch.setattr(scoring_run, "read_results", lambda *a: reads.append(a) or read(*a))
    options = dict(provider="p", model_name="m", build_prompts=lambda s: s.withColumn("prompt", F.col("formatted_progress_text")), rounds=2)
    store, seen = f"{tmp_path}/store", f"{tmp_path}/seen"
    found = scoring_run.run_scoring(cases, store, A.respond, run_id="a", seen=seen, **options)
    assert found.count() == 40 and len(reads) == 2  # filling the set, and the result
    reads.clear()
    assert scoring_run.run_scoring(cases, store, A.respond, run_id="b", seen=seen, **options).filter("run_id = 'a'").count() == 40
    assert len(reads) == 1 and read(spark, store).filter("run_id = 'b'").count() == 0
    with pytest.raises(ValueError):
        scoring_run.run_scoring(cases, store, A.respond, run_id="c", seen=seen, retry_failed=True, **options)

    def stop(*args):
        raise RuntimeError("stopped")

    other = f"{tmp_path}/other"
    scoring_run.run_scoring(cases.limit(0), other, A.respond, run_id="a", seen=f"{other}_seen", **options)
    with monkeypatch.context() as m:
        m.setattr(scoring_run, "add_to_bitmap", stop)
        with pytest.raises(RuntimeError):
            scoring_run.run_scoring(cases, other, A.respond, run_id="b", seen=f"{other}_seen", **options)
    again = scoring_run.run_scoring(cases, other, A.respond, run_id="c", seen=f"{other}_seen", **options)
    assert again.count() == 40 and {r[0] for r in again.select("run_id").distinct().collect()} == {"b", "c"}


def test_registry(spark, tmp_path):
    path = f"{tmp_path}/registry"
    loads = [["b", "d", "d", None], [], ["a", "b", "e"], ["z", "c", "a"]]
    want = {}
    for load in loads:
        df = spark.createDataFrame([(i,) for i in load], "patient_id string")
        for new in sorted({i for i in load if i is not None} - set(want)):
            want[new] = len(want) + 1
        got = registry.number_with_registry(df, path).collect()
        assert sorted(map(tuple, got)) == sorted((i, want[i]) for i in load if i is not None)
    spark.createDataFrame([("q", 9)], "patient_id string, llm_caseID bigint").write.mode("append").parquet(path)
    with pytest.raises(ValueError, match="registry holds"):
        registry.number_with_registry(spark.createDataFrame([("r",)], "patient_id string"), path)


def test_page_index(spark, tmp_path):
    path = f"{tmp_path}/pages"
    ids = spark.range(0, 60_000, 3).select((F.col("id") * 7 % 60_000).alias("patient_id"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        registry.write_page_index(ids.union(ids.limit(10)), path)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert spark.read.parquet(f"{path}/bounds").count() > 3
    for size, no in ((10, 0), (100, 57), (7000, 1), (13, 1538), (10, 10_000)):
        got = registry.read_page(spark, path, size, no)
        assert [r[0] for r in got.collect()] == [r[0] for r in page(ids, size, no).collect()]
    deep = registry.read_page(spark, path, 2, 9_000)
    read = {f.split("_slot=")[1].split("/")[0] for f in deep.inputFiles() if "_slot=" in f}
    text = deep._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_slot" in text.replace("isnotnull(", "").replace("cast(", "") or len(read) <= 2
    assert deep._jdf.queryExecution().executedPlan().toString().count("Exchange rangepartitioning") <= 1


def test_versions(spark, tmp_path):
    store = f"{tmp_path}/store"
    blank = {f.name: F.lit(None).cast(f.dataType) for f in schemas.RESULT}

    def add(lo, hi, run):
        R.append_results(spark.range(lo, hi).select(*[F.col("id").alias(n) if n == "llm_caseID" else F.lit("p").alias(n) if n == "provider" else c.alias(n) for n, c in blank.items()]), store, run)

    assert R.read_version(spark, store).count() == 0 and R.latest_version(spark, store) == 0
    for n in range(4):
        add(n * 10, n * 10 + 12, f"r{n}")
    assert R.compact_results(spark, store) == 1
    add(40, 45, "r4")
    plain = R.read_results(spark, store)
    first = R.read_version(spark, store, 1)
    assert sorted(map(repr, first.collect())) == sorted(map(repr, plain.collect())) and first.count() == 53
    # a compaction that stops before its list of files leaves no version behind
    spark.read.parquet(f"{store}_compacted/rows").withColumn("version", F.lit(2)).write.mode("append").partitionBy("version").parquet(f"{store}_compacted/rows")
    assert R.latest_version(spark, store) == 1
    assert R.compact_results(spark, store, rows_per_file=20) == 3
    second = R.read_version(spark, store)
    assert sorted(map(repr, second.collect())) == sorted(map(repr, plain.collect()))
    assert sorted(map(repr, first.collect())) == sorted(map(repr, plain.collect()))  # the old reader still reads
    names = lambda df: {f for f in df.inputFiles()}
    assert all("_compacted" in f for f in names(second))


def test_compacted_files_are_bounded_in_bytes(spark, tmp_path):
    """Few rows of long texts, half of them of one case, are spread over files; nothing is lost."""
    store = f"{tmp_path}/store"
    given = {"llm_caseID": F.when(F.col("id") % 2 == 0, F.col("id")), "provider": F.lit("p"), "reasoning": F.repeat(F.md5(F.col("id").cast("string")), 300)}
    blank = {f.name: F.lit(None).cast(f.dataType) for f in schemas.RESULT}
    R.append_results(spark.range(200).select(*[given.get(n, c).alias(n) for n, c in blank.items()]), store, "r0")
    assert R.compact_results(spark, store, bytes_per_file=200_000) == 1
    kept = R.read_version(spark, store)
    sizes = [r["n"] for r in kept.groupBy(F.col("_metadata.file_name")).agg(F.sum(F.length("reasoning")).alias("n")).collect()]
    assert len(sizes) >= 8 and max(sizes) < 500_000
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, R.read_results(spark, store).collect()))


def test_unreadable_files(spark, tmp_path):
    store = f"{tmp_path}/store"
    assert R.unreadable_files(spark, store).count() == 0
    answers = spark.range(5).select(*[F.col("id").alias(f.name) if f.name == "llm_caseID" else F.lit("p" if f.name == "provider" else None).cast(f.dataType).alias(f.name) for f in schemas.RESULT])
    R.append_results(answers, store, "r")
    assert R.unreadable_files(spark, store).count() == 0
    (tmp_path / "store/provider=p/run_id=r/bad 1.parquet").write_bytes(b"PAR1 but no more")
    assert [tuple(r) for r in R.unreadable_files(spark, store).collect()] == [("bad 1.parquet", 16)]
    assert R.read_results(spark, store, skip_unreadable=True).count() == 5


def test_whole_values_of_large_keys(spark):
    """One patient with a third of the rows, cut in parts of few bytes, gives what one pass gives."""
    pick = random.Random(3)
    rows = [(pick.choice(["hot", f"p{pick.randrange(30)}", f"p{pick.randrange(30)}"]), i, f"2020-01-{pick.randrange(1, 28):02d} 00:00:00" if pick.random() < 0.9 else None, "t", "x", "é" * pick.randrange(9) if pick.random() < 0.9 else None) for i in range(900)]
    df = spark.createDataFrame(rows, "patient_id string, note_seq bigint, date string, type string, title string, text string").withColumn("date", F.col("date").cast("timestamp_ntz")).repartition(5)
    cutoffs = df.select("patient_id").distinct().select("patient_id", F.lit("2020-01-20").cast("timestamp_ntz"))
    for build in (
        lambda size: collect_text(df, "s", max_items=None, part_bytes=size),
        lambda size: collect_history(df, "s", max_items=None, part_bytes=size),
        lambda size: collect_history(df, "s", cutoffs=cutoffs, max_items=None, part_bytes=size),
    ):
        whole = sorted(map(repr, build(1 << 30).collect()))
        assert sorted(map(repr, build(64).collect())) == whole and len(whole) == len({r[0] for r in rows})
    text = collect_text(df, "s", max_items=None, part_bytes=64)._jdf.queryExecution().executedPlan().toString()
    assert "_part" in text and "hashpartitioning(patient_id" in text


def brute_auc(rows):
    pos, neg = [s for s, y in rows if y == 1], [s for s, y in rows if y == 0]
    order = lambda s: (-1, 0) if s is None else (1, 0) if math.isnan(s) else (0, s)
    wins = sum((order(a) > order(b)) + (order(a) == order(b)) / 2 for a in pos for b in neg)
    return wins / (len(pos) * len(neg)) if pos and neg else None


def test_auc_by_leading_bits(spark):
    pick = random.Random(7)
    draws = [lambda: pick.random(), lambda: pick.choice([0.0, -0.0, 1e-300, -1e-12, 1e-12, 5.0]), lambda: pick.gauss(0, 1e6), lambda: 1 + pick.randrange(40) * 1e-13,
             lambda: pick.choice([None, float("nan"), float("inf"), float("-inf"), 2.0**40, 2.0**40 + 1, -(2.0**33)]), lambda: float(pick.randrange(100_000))]
    rows = [(g, draw(), pick.randrange(2)) for g, draw in enumerate(draws) for _ in range(120)]
    df = spark.createDataFrame(rows, "g int, s double, actual_surgery int")
    spark.sparkContext.setJobGroup("auc", "auc")
    got = M.roc_auc(df, score="s", by=["g"])
    every = M.roc_auc(df, score="s")
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("auc")  # nothing runs until it is asked for
    for r in got.collect():
        assert r["auc_roc"] == pytest.approx(brute_auc([(s, y) for g, s, y in rows if g == r["g"]]), abs=1e-12), r
    assert every.first()[0] == pytest.approx(brute_auc([(s, y) for _, s, y in rows]), abs=1e-12)
    assert M.roc_auc(df.filter("false"), score="s").first()[0] is None
    scores = sorted(s for _, s, _ in rows if s is not None and not math.isnan(s))
    bits = spark.createDataFrame([(i, s) for i, s in enumerate(scores)], "i int, s double").select("i", M.leading_bits(F.col("s"), 10).alias("b")).orderBy("i").collect()
    assert all(a["b"] <= b["b"] for a, b in itertools.pairwise(bits))


def test_sketches_keep_their_bounds(spark):
    df = spark.range(300_000).select(F.pmod("id", F.lit(3)).alias("shard"), F.when(F.col("id") % 3 == 0, F.col("id") % 90_001).otherwise(F.col("id") % 120_007).alias("k"))
    made = sketches.shard_sketches(df, "shard", "k")
    exact = {r[0]: r[1] for r in df.groupBy("shard").agg(F.countDistinct("k")).collect()}
    for r in made.collect():
        assert abs(r["estimate"] - exact[r["shard"]]) < 0.03 * exact[r["shard"]]
    total = df.agg(F.countDistinct("k")).first()[0]
    assert abs(sketches.total_estimate(made).first()[0] - total) < 0.03 * total
    sets = {s: {r[0] for r in df.filter(F.col("shard") == s).select("k").distinct().collect()} for s in range(3)}
    pairs = spark.createDataFrame([(0, 1), (0, 2), (1, 2)], "a bigint, b bigint")
    for r in sketches.overlap_estimates(pairs, made, "shard").collect():
        assert abs(r["both"] - len(sets[r["a"]] & sets[r["b"]])) <= 2 * r["both_error"] and r["both_error"] > 0


def test_stream_state_keeps_seen_ids(spark, tmp_path, monkeypatch):
    """Files that bring old, repeated and new cases over several starts; later batches read no other results."""
    from casewright.streaming import pending as S

    docs = A.document_cases(spark, SF_DIR).select(*schemas.CASE.fieldNames())
    files, store = f"{tmp_path}/in", f"{tmp_path}/store"
    asked = []
    run = S.run_scoring
    monkeypatch.setattr(S, "run_scoring", lambda batch, *a, **k: asked.append((k["this_run_only"], k["run_id"])) or run(batch, *a, **k))
    options = dict(provider="p", model_name="m", build_prompts=lambda s: s.withColumn("prompt", F.col("formatted_progress_text")))
    run(docs.filter("llm_caseID < 20"), store, A.respond, run_id="a", **options)
    want = {i: "a" for i in range(20)}
    for n, (lo, hi) in enumerate([(10, 40), (30, 60), (0, 60), (55, 70)]):
        docs.filter((F.col("llm_caseID") >= lo) & (F.col("llm_caseID") < hi)).coalesce(1).write.mode("append").parquet(files)
        cases = S.read_case_stream(spark, files)
        S.score_stream(cases, store, f"{tmp_path}/checkpoint", A.respond, run_id="s", ids_in_state=True, **options).awaitTermination()
        want |= {i: f"s-{n:06d}" for i in range(lo, hi) if i not in want}
    stored = R.read_results(spark, store).select("llm_caseID", "run_id").collect()
    assert len(stored) == 70 and {r[0] for r in stored} == set(want)
    assert [only for only, _ in asked] == [False] + [True] * (len(asked) - 1) and len(asked) >= 4


def test_scoring_keeps_large_keys(spark):
    from casewright.operators.scoring import score

    df = spark.createDataFrame([(9007199254740993, "x"), (None, "y")], "llm_caseID bigint, prompt string").coalesce(1)
    got = {r["llm_caseID"]: r["api_response"] for r in score(df, lambda p: p, provider="p", model_name="m").collect()}
    assert got == {9007199254740993: "x", None: "y"}
