"""One query for each operator, over the whole of its table, with SQL where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.llm.contextual_pii import KINDS, contextual_pii, span_list
from casewright.llm.html_text import extract_pages
from casewright.llm.lexical_search import lexical_top_k
from casewright.llm.mixing import mix_sources
from casewright.llm.periodic_runs import periodic_runs
from casewright.llm.quality import quality_scores
from casewright.llm.quality_rules import LIMIT, RISK, RULES, quality_rules
from casewright.llm.search import bm25_top_k
from casewright.llm.simhash import simhash_groups
from casewright.llm.substring_dedup import substring_dedup
from casewright.llm.token_shards import pack_sequences, training_shards, write_shards
from casewright.llm.tokenizer import sentencepiece_encode
from casewright.llm.toxicity import toxicity_scores
from casewright.session import shared_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(_table(spark, sf_dir, "documents"))
    return found.select("row.doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.select("row.doc_id", "held_out", "score", "predicted")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = sentencepiece_encode(_table(spark, sf_dir, "documents"))
    return coded.select("row.doc_id", "ids", F.size("ids").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shards as read back from where they were written."""
    path = f"{shared_dir(spark).rstrip('/')}/casewright/{uuid.uuid4().hex}"
    shards = training_shards(pack_sequences(_table(spark, sf_dir, "documents")))
    write_shards(shards, path)
    return spark.read.schema(shards.schema).parquet(path)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_groups(_table(spark, sf_dir, "documents"))
    return found.select(
        "row.doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_pages(_table(spark, sf_dir, "pages"))
    return found.select("row.page_id", "row.url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.select("row.doc_id", "held_out", "score", "predicted")


def op8_bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose id is divisible by 50 is a query against all documents."""
    docs = _table(spark, sf_dir, "documents")
    return bm25_top_k(docs, docs.filter("doc_id % 50 = 0"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select(
        "row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return judged.select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _with_periods(text: str, key: str) -> F.Column:
    """The text, of which one in ten (by the key's checksum) goes on periodically from some word.

    Word i >= a is word a + (i - a) % p of the text, with a and p from the checksum.
    """
    h = F.crc32(F.col(key).cast("string").cast("binary"))
    g = F.floor(h / 10)

    def tail(words):
        n = F.size(words).cast("bigint")
        a = g % n
        p = F.floor((n - a) / (F.lit(3) + g % 8)) + 1
        places = F.sequence(F.lit(0).cast("bigint"), n - 1)
        at = F.transform(places, lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))
        return F.array_join(F.transform(at, lambda i: F.get(words, i)), " ")

    words = F.regexp_extract_all(F.col(text), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    changed = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, tail(w)).otherwise("")), F.lit(0))
    return F.when(F.col(key).isNotNull() & F.col(text).isNotNull() & (h % 10 == 0), changed).otherwise(F.col(text))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", _with_periods("text", "doc_id").alias("text"))
    found = periodic_runs(docs)
    # lengths below 2^26: a quotient in doubles is equal only where the fractions are
    score = F.transform(
        "runs",
        lambda r: F.struct((r["length"] / r["period"]).alias("e"), (-r["start"]).alias("s"), (-r["period"]).alias("p"), r["length"].alias("n")),
    )
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    best = F.array_max(score)
    return found.select(
        "row.doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        (-best["s"]).alias("start"),
        best["n"].alias("length"),
        (-best["p"]).alias("period"),
        F.floor(1000 * best["n"] / -best["p"]).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed_text", 256).alias("collapsed_sha256"),
    )


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_top_k(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contextual_pii(_table(spark, sf_dir, "documents"))
    of = F.transform("base", lambda b: b["kind"])
    counts = [F.size(F.filter(of, lambda k: k == number)).cast("bigint").alias(f"n_{kind}") for number, kind in enumerate(KINDS)]
    return found.select(
        "row.doc_id",
        *counts,
        F.sha2(span_list(F.col("base")), 256).alias("base_sha256"),
        span_list(F.concat("base", "added")).alias("spans"),
    )


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_token_shards": op4_token_shards,
    "op5_simhash": op5_simhash,
    "op6_main_text": op6_main_text,
    "op7_quality": op7_quality,
    "op8_bm25_search": op8_bm25_search,
    "op9_mix_sources": op9_mix_sources,
    "op10_quality_rules": op10_quality_rules,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_lexical_search": op12_lexical_search,
    "op13_contextual_pii": op13_contextual_pii,
}

_CUTS = ", ".join(
    f"('{rule}', {i}, {c})" for rule, cutoffs in RULES.items() for i, c in enumerate(sorted(cutoffs, reverse=True))
)
_METRICS = ", ".join(RULES)

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE = {
    "op1_substring_dedup": f"""
WITH docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
windows AS (
  SELECT doc_id, p, array_to_string(w[p:p+19], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM docs)),
later AS (
  SELECT doc_id, p FROM (
    SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM windows)
  WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, p + i AS p FROM later, (SELECT unnest(range(20)) AS i)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM docs),
kept AS (
  SELECT words.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY words.p) AS s
  FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.p = gone.p
  WHERE gone.p IS NULL GROUP BY words.doc_id)
SELECT docs.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(s, '')) AS kept_sha256
FROM docs LEFT JOIN kept ON docs.doc_id = kept.doc_id""",
    "op8_bm25_search": r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')) AS term
  FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
lengths AS (SELECT doc_id, count(*) AS dl FROM words GROUP BY doc_id),
stats AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM words) / (SELECT count(*) FROM documents) AS mean),
idf AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, stats GROUP BY term, n),
scores AS (
  SELECT q.doc_id AS qid, d.doc_id, round(sum(q.tf * idf * d.tf * 2.2 / (d.tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS score
  FROM tf q JOIN tf d ON q.term = d.term JOIN idf ON q.term = idf.term JOIN lengths ON d.doc_id = lengths.doc_id, stats
  WHERE q.doc_id % 50 = 0 GROUP BY q.doc_id, d.doc_id)
SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores QUALIFY rank <= 10""",
    "op9_mix_sources": f"""
WITH sized AS (
  SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size,
    CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS h
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    [5, 2, 1][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT] AS w
  FROM sized GROUP BY source),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER (
      ORDER BY source_size * 3 / w, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY source_size * 3 / w, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sources),
targets AS (
  SELECT source, source_size, CAST(least(source_size * 3, w * (
    SELECT arg_min(level, source_size * 3 / w) FROM levels WHERE source_size * 3 / w >= level)) AS DOUBLE) AS target
  FROM levels),
rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM targets),
ranked AS (
  SELECT doc_id, size, source_size, target, whole, target - whole * source_size AS budget,
    sum(size) OVER (PARTITION BY sized.source ORDER BY h) AS upto
  FROM sized JOIN rates ON sized.source IS NOT DISTINCT FROM rates.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (whole + CASE WHEN upto <= budget THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM ranked""",
    "op10_quality_rules": f"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t, {_WORDS} AS w,
    [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\\x20\\x09-\\x0D]')] AS l
  FROM documents),
windows AS (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS p FROM docs),
repeated AS (
  SELECT doc_id, p FROM (
    SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, w[p:p+4]) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT p + i) AS n FROM repeated, (SELECT unnest(range(5)) AS i) GROUP BY doc_id),
base AS (
  SELECT docs.doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, len(l) AS n_lines,
    CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
    length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS capitals,
    length(t) - length(translate(t, '!', '')) AS exclamations
  FROM docs LEFT JOIN covered ON docs.doc_id = covered.doc_id),
measured AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    n_symbols / greatest(word_chars, 1) AS symbol_share, n_dup_lines / greatest(n_lines, 1) AS dup_line_share,
    n_repeat_words / greatest(n_words, 1) AS repeat_share, capitals / greatest(word_chars, 1) AS capital_share,
    exclamations / greatest(n_words, 1) AS exclamation_share, word_chars / greatest(n_words, 1) AS mean_length
  FROM base),
long AS (UNPIVOT (SELECT doc_id, stratum, base_failed, {_METRICS} FROM measured) ON {_METRICS} INTO NAME rule VALUE x),
truth AS (SELECT doc_id, CASE WHEN avg(quality) >= 0.5 THEN 1 ELSE 0 END AS y FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
cuts AS (SELECT * FROM (VALUES {_CUTS}) AS c(rule, step, cutoff)),
counted AS (
  SELECT stratum, long.rule, step, cutoff, sum(y) AS good,
    sum(CASE WHEN x > cutoff THEN y ELSE 0 END) AS g, sum(CASE WHEN x > cutoff THEN 1 - y ELSE 0 END) AS b
  FROM long JOIN truth ON long.doc_id = truth.doc_id JOIN cuts ON long.rule = cuts.rule
  WHERE NOT base_failed GROUP BY stratum, long.rule, step, cutoff),
tested AS (
  SELECT *, CASE WHEN g > good * {LIMIT / len(RULES)} THEN 1.0 ELSE list_sum([exp(
      lgamma(good + 1) - lgamma(i + 1) - lgamma(good - i + 1) + i * ln({LIMIT / len(RULES)}) + (good - i) * ln(1 - {LIMIT / len(RULES)}))
      FOR i IN range(0, CAST(g AS BIGINT) + 1)]) END
    <= {RISK / len(RULES)} / (SELECT count(DISTINCT stratum) FROM counted) AS passes
  FROM counted),
allowed AS (
  SELECT * FROM (SELECT *, bool_and(passes) OVER (PARTITION BY stratum, rule ORDER BY step) AS ok FROM tested) WHERE ok AND b > g),
best AS (SELECT stratum, rule, arg_max(cutoff, (b - g) * 100 - step) AS cutoff FROM allowed GROUP BY stratum, rule),
failed AS (SELECT DISTINCT doc_id FROM long JOIN best ON long.stratum = best.stratum AND long.rule = best.rule WHERE x > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM failed) AS kept
FROM measured""",
    "op11_periodic_runs": f"""
WITH split AS (
  SELECT doc_id, {_WORDS} AS w, CAST(len({_WORDS}) AS BIGINT) AS n, list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda x: CAST(coalesce(ascii(x), 0) AS BIGINT))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), CAST(range(8) AS BIGINT[])), lambda r, s: xor(r >> 1, 3988292384 * (r & 1)))) AS r
  FROM documents),
hashed AS (SELECT doc_id, w, n, xor(r, 4294967295) AS h, xor(r, 4294967295) // 10 AS g FROM split),
placed AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM hashed),
docs AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END + 1]) ELSE w END AS w
  FROM placed),
words AS (SELECT doc_id, n, unnest(range(n)) AS p, unnest(w) AS word FROM docs),
same AS (
  SELECT x.doc_id, x.p, y.p - x.p AS q FROM words x JOIN words y
  ON x.doc_id = y.doc_id AND x.word = y.word AND y.p > x.p AND 3 * (y.p - x.p) <= x.n),
islands AS (
  SELECT doc_id, q, min(p) AS start, count(*) + q AS length
  FROM (SELECT *, p - row_number() OVER (PARTITION BY doc_id, q ORDER BY p) AS island FROM same) GROUP BY doc_id, q, island),
runs AS (
  SELECT doc_id, start, length, min(q) AS period FROM islands WHERE length >= greatest(24, 3 * q) GROUP BY doc_id, start, length),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS p FROM runs),
kept AS (
  SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.p) AS s FROM words ANTI JOIN gone ON words.doc_id = gone.doc_id AND words.p = gone.p GROUP BY words.doc_id),
listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY doc_id),
best AS (
  SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length / period DESC, start, period) = 1)
SELECT docs.doc_id, coalesce(n_runs, 0) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(period AS BIGINT) AS period,
  CAST(1000 * length // period AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(s, '')) AS collapsed_sha256
FROM docs LEFT JOIN listed ON docs.doc_id = listed.doc_id LEFT JOIN best ON docs.doc_id = best.doc_id LEFT JOIN kept ON docs.doc_id = kept.doc_id""",
    "op12_lexical_search": r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents),
asked AS (
  SELECT item_id, term, count(*) AS qtf FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark) GROUP BY item_id, term),
lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
stats AS (SELECT count(*) AS total, CAST(sum(n) AS BIGINT) AS length FROM lengths),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * total + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, stats GROUP BY term, total),
scores AS (
  SELECT item_id, tf.doc_id, CAST(sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * total) // length)))) AS BIGINT) AS score
  FROM asked JOIN tf ON asked.term = tf.term JOIN weights ON tf.term = weights.term JOIN lengths ON tf.doc_id = lengths.doc_id, stats
  GROUP BY item_id, tf.doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 10""",
}
