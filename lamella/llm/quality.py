"""Operator 2: quality rules with adaptive thresholds.

The base rule is fixed. Beyond it, each feature of a document is held against a
threshold that its own language and source set: features are counted in
logarithmic buckets (a quantile sketch of relative error ``ERROR``; two sketches
merge by adding their counts, so Spark builds them before the shuffle), quartiles
are read from the merged buckets, and a document fails if a feature lies more
than ``FENCE`` spreads outside the quartiles. The spread is the distance of the
quartiles, at least a least spread per feature, so that a uniform source keeps
its ordinary documents. A group of fewer than ``LEAST`` documents uses the
sketch of its language, and that one the sketch of all.

Defined cases: null or wordless text has counts of 0 and fails the base rule;
null language or source is a group of its own; rows sharing a doc_id are judged
each by its text; an empty table gives an empty result. Documents that fail the
base rule don't enter the sketches. Extra columns pass through ``keep_good`` whatever
their names; ``features`` and ``judge`` add q_counts, q_base_failed and q_kept in place of
columns with such a name, and ``judge`` leaves out columns named as its thresholds (q_lang and so on).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, packed, small_batches, table, tidy, unpacked

ERROR = 0.01
FENCE = 4.0
LEAST = 50
#: feature: (numerator, least spread, two-sided). Each is a ratio to n_words.
FEATURES = {"symbols": ("n_symbols", 0.02, False), "dup_lines": ("n_dup_lines", 0.01, False), "repeats": ("n_repeat_words", 0.1, False), "word_length": ("word_chars", 0.3, True)}
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
_GAMMA = math.log((1 + ERROR) / (1 - ERROR))
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = _WORD.findall(text)
    dup = 0
    if "\n" in text:
        lines = [x for x in text.split("\n") if _WORD.search(x)]
        dup = len(lines) - len(set(lines))
    repeated = 0
    three = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(three)) < len(three):
        often, until = Counter(three), 0
        for i, window in enumerate(three):
            if often[window] > 1:
                repeated += i + 3 - max(i, until)
                until = i + 3
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), dup, repeated


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _counts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for text in batches:
        yield pd.DataFrame([counts(x) for x in text], columns=NAMES, dtype="int64")
    tidy()


def features(docs: DataFrame) -> DataFrame:
    """``docs`` with q_counts (the five counts) and q_base_failed."""
    small_batches(docs.sparkSession)
    out = docs.withColumn("q_counts", F.pandas_udf(_counts, ", ".join(f"{x} long" for x in NAMES))("text"))
    return out.withColumn("q_base_failed", (F.col("q_counts.n_words") < MIN_WORDS) | (100 * F.col("q_counts.n_repeat_words") > MAX_REPEAT_PERCENT * F.col("q_counts.n_words")))


def sketches(scored: DataFrame) -> DataFrame:
    """Rows lang, source, feature, bucket, n: all sketches. Merging is adding n; the row of bucket null counts zeros."""
    each = [F.struct(F.lit(name).alias("feature"), (F.col(f"q_counts.{num}") / F.col("q_counts.n_words")).alias("v")) for name, (num, _, _) in FEATURES.items()]
    rows = scored.where(~F.col("q_base_failed")).select("lang", "source", F.explode(F.array(*each)).alias("x"))
    bucket = F.when(F.col("x.v") > 0, F.ceil(F.round(F.log("x.v") / F.lit(_GAMMA), 9)))
    return rows.groupBy("lang", "source", F.col("x.feature").alias("feature"), bucket.alias("bucket")).agg(F.count("*").alias("n"))


def _fences(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per group its number of documents and, by feature, the lowest and highest value that pass."""
    whole = Window.partitionBy(*keys, "feature")
    run = rows.withColumn("upto", F.sum("n").over(whole.orderBy(F.col("bucket").asc_nulls_first()))).withColumn("all", F.sum("n").over(whole))
    value = F.when(F.col("bucket").isNull(), F.lit(0.0)).otherwise(F.exp(F.col("bucket") * F.lit(_GAMMA)) * F.lit(1 - ERROR))
    quart = run.groupBy(*keys, "feature").agg(F.max("all").alias("all"), *[F.min(F.when(F.col("upto") > F.floor(F.lit(q) * (F.col("all") - 1)), value)).alias(f"q{int(100 * q)}") for q in (0.25, 0.75)])
    picks = [F.max("all").alias("docs")]
    for name, (_, least, both) in FEATURES.items():
        spread = F.lit(FENCE) * F.greatest(F.col("q75") - F.col("q25"), F.lit(least))
        here = F.col("feature") == name
        picks.append(F.max(F.when(here, F.col("q75") + spread)).alias(f"hi_{name}"))
        if both:
            picks.append(F.max(F.when(here, F.col("q25") - spread)).alias(f"lo_{name}"))
    return quart.groupBy(*keys).agg(*picks)


def thresholds(sketch: DataFrame) -> DataFrame:
    """q_lang, q_source and the fences that hold there. One row per language and source."""
    add = lambda keys: sketch.groupBy(*keys, "feature", "bucket").agg(F.sum("n").alias("n"))
    own = _fences(sketch, ["lang", "source"])
    by_lang = _fences(add(["lang"]), ["lang"])
    every = _fences(add([]).withColumn("one", F.lit(1)), ["one"])
    names = [c for c in own.columns if c[:3] in ("hi_", "lo_")]
    wider = by_lang.withColumn("one", F.lit(1)).join(every.select("one", *[F.col(c).alias(f"e_{c}") for c in names]), "one")
    wider = wider.select(F.col("lang").alias("l_lang"), *[F.when(F.col("docs") >= LEAST, F.col(c)).otherwise(F.col(f"e_{c}")).alias(f"w_{c}") for c in names])
    both = own.join(wider, F.col("lang").eqNullSafe(F.col("l_lang")))
    return both.select(F.col("lang").alias("q_lang"), F.col("source").alias("q_source"), *[F.when(F.col("docs") >= LEAST, F.col(c)).otherwise(F.col(f"w_{c}")).alias(f"q_{c}") for c in names])


def judge(scored: DataFrame, limits: DataFrame) -> DataFrame:
    """``scored`` with q_kept. limits has one row per language and source; the planner broadcasts it if it is small."""
    scored = scored.drop(*limits.columns)
    joined = scored.join(limits, scored["lang"].eqNullSafe(limits["q_lang"]) & scored["source"].eqNullSafe(limits["q_source"]), "left")
    good = ~F.col("q_base_failed")
    for name, (num, _, both) in FEATURES.items():
        v = F.col(f"q_counts.{num}") / F.col("q_counts.n_words")
        good &= v <= F.col(f"q_hi_{name}")
        if both:
            good &= v >= F.col(f"q_lo_{name}")
    return joined.withColumn("q_kept", F.coalesce(good, F.lit(False))).drop(*limits.columns)


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, unchanged. Counts are made once: what passes the base rule is written with them, so that no text is shuffled."""
    scored = features(packed(docs, lang=docs["lang"], source=docs["source"], text=docs["text"])).drop("text")
    scored = cut(scored.where(~F.col("q_base_failed")), "quality-counts")
    limits = cut(thresholds(sketches(scored)), "quality-limits")
    return unpacked(judge(scored, limits).where("q_kept"), docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    scored = cut(features(docs).drop("text"), "quality-counts")
    done = judge(scored, cut(thresholds(sketches(scored)), "quality-limits"))
    return done.select("doc_id", "q_counts.*", F.col("q_base_failed").alias("base_failed"), F.col("q_kept").alias("kept"))


def _oracle() -> str:
    ratios = ", ".join(f"{{'feature': '{name}', 'v': {num} / n_words}}" for name, (num, _, _) in FEATURES.items())
    cols = ", ".join([f"max(case when feature = '{n}' then q75 + {FENCE}::double * greatest(q75 - q25, {s}::double) end) hi_{n}" for n, (_, s, _) in FEATURES.items()] + [f"max(case when feature = '{n}' then q25 - {FENCE}::double * greatest(q75 - q25, {s}::double) end) lo_{n}" for n, (_, s, b) in FEATURES.items() if b])
    names = [f"hi_{n}" for n in FEATURES] + [f"lo_{n}" for n, x in FEATURES.items() if x[2]]
    fence = lambda t, keys: f"(select {keys}max(total) docs, {cols} from (select {keys}feature, max(total) total, min(case when upto > floor(0.25 * (total - 1)) then v end) q25, min(case when upto > floor(0.75 * (total - 1)) then v end) q75 from (select *, case when bucket is null then 0.0 else exp(bucket * {_GAMMA!r}::double) * {1 - ERROR}::double end v, sum(n) over (partition by {keys}feature order by bucket nulls first) upto, sum(n) over (partition by {keys}feature) total from {t}) group by all) {'group by ' + keys.rstrip(', ') if keys else ''})"
    pick = ", ".join(f"case when o.docs >= {LEAST} then o.{c} when l.docs >= {LEAST} then l.{c} else e.{c} end {c}" for c in names)
    good = " and ".join([f"{num} / n_words <= hi_{n}" for n, (num, _, _) in FEATURES.items()] + [f"{num} / n_words >= lo_{n}" for n, (num, _, b) in FEATURES.items() if b])
    return rf"""
with d as materialized (select row_number() over () rid, doc_id, lang, source, coalesce(text, '') text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
tri as (select rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] g from (select rid, w, unnest(range(1, len(w) - 1)) i from d)),
rep as (select rid, count(distinct p) n from (select rid, unnest([i, i + 1, i + 2]) p from (select *, count(*) over (partition by rid, g) c from tri) where c > 1) group by rid),
lines as (select rid, count(*) - count(distinct line) n from (select rid, unnest(string_split(text, chr(10))) line from d) where regexp_matches(line, '[^\x20\x09-\x0D]') group by rid),
c as materialized (select doc_id, lang, source, len(w)::bigint n_words, len(array_to_string(w, ''))::bigint word_chars, len(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint n_symbols, coalesce(lines.n, 0)::bigint n_dup_lines, coalesce(rep.n, 0)::bigint n_repeat_words
      from d left join rep using (rid) left join lines using (rid)),
b as materialized (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words base_failed from c),
f as (select lang, source, unnest([{ratios}]) x from b where not base_failed),
s as materialized (select lang, source, x.feature feature, case when x.v > 0 then ceil(round(ln(x.v) / {_GAMMA!r}::double, 9)) end bucket, count(*) n from f group by all),
sl as (select lang, feature, bucket, sum(n) n from s group by all), sa as (select feature, bucket, sum(n) n from s group by all),
o as {fence("s", "lang, source, ")}, l as {fence("sl", "lang, ")}, e as {fence("sa", "")},
t as (select o.lang, o.source, {pick} from o join l on o.lang is not distinct from l.lang cross join e)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(not base_failed and {good}, false) kept
from b left join t on b.lang is not distinct from t.lang and b.source is not distinct from t.source"""


ORACLE = _oracle()
