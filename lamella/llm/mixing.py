"""Operator 1: mixing sources to target weights (DataFrame functions only).

Words are counted per source; each source gets a share of the budget by its
weight, never more than ``cap`` times its own size (what is above is shared
again among the rest). rate = target / size. A document is emitted floor(rate)
times, plus once more if a hash-seeded uniform number is below the fraction of
the rate. Every source tries ``SEEDS`` seeds and keeps the one whose total is
nearest to its target, so that a source with few documents is near it too; given
the seed, each document is an independent Bernoulli draw.

Defined cases: null text has size 0 and is taken 0 words' worth of copies (its
copies follow the rate all the same); null source is a source of its own, the
last one; rows with the same doc_id get the same draw; an empty table gives an
empty mix; a source of size 0 has target 0 and no copies. Extra columns pass
through ``mix`` whatever their names; ``plan`` adds mix_size, mix_source_size, mix_target
and mix_copies, in place of columns of ``docs`` with such a name. There may be as many sources as
documents: they are ranked in ranges, with sums per range, not in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACES, cut, packed, table, unpacked

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
CAP = 2
SEEDS = 16


def word_count(text) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text; null: 0."""
    one = F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES))
    return F.size(F.array_remove(F.split(one, " "), "")).cast("long")


def draws(doc_id, seeds: int = SEEDS) -> list[Column]:
    """Uniform numbers in [0, 1) by the md5 of the document's id; two seeds from each digest."""
    out = []
    for k in range(0, seeds, 2):
        digest = F.md5(F.concat(F.lit(f"{k}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
        for at in (1, 17):
            out.append(F.conv(F.substring(digest, at, 12), 16, 10).cast("double") / F.lit(float(16**12)))
    return out[:seeds]


def running(df: DataFrame, order: list[Column], sums: list[str], name: str) -> DataFrame:
    """``df`` with its place in the order (from 1) and for each of ``sums`` before_<name>, the sum over all rows before it (0 for the first).

    Rows are dealt into ranges of the order and summed in each; one row per range is then summed up and joined back.
    """
    ranged = cut(df.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), name)
    here = Window.partitionBy("range").orderBy(*order)
    add = lambda x, over: F.coalesce(F.sum(x).over(over), F.lit(0))
    inner = ranged.withColumn("place", F.row_number().over(here)).select("*", *[add(x, here.rowsBetween(Window.unboundedPreceding, -1)).alias(f"i_{x}") for x in sums])
    total = ranged.groupBy(F.col("range").alias("of")).agg(F.count("*").alias("n"), *[F.sum(x).alias(f"t_{x}") for x in sums])
    earlier = Window.orderBy("of").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges
    total = total.select("of", add("n", earlier).alias("n"), *[add(f"t_{x}", earlier).alias(f"t_{x}") for x in sums])
    out = inner.join(F.broadcast(total), F.col("range") == F.col("of"))
    return out.select(*df.columns, (F.col("place") + F.col("n")).alias("place"), *[(F.col(f"i_{x}") + F.col(f"t_{x}")).alias(f"before_{x}") for x in sums])


def targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, cap: float = CAP) -> DataFrame:
    """One row per source: mix_source, mix_source_size, mix_target.

    With sources ordered by cap / weight, those up to some rank are at their cap and the others share the rest by weight: the first rank at
    which the share does not exceed the next cap is where sharing the excess again and again ends.
    """
    per = sizes.groupBy(F.col("source").alias("mix_source")).agg(F.sum("mix_size").alias("mix_source_size"))
    per = running(per, [F.col("mix_source").asc_nulls_last()], [], "mix-sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("w", weight).drop("place").withColumn("ceiling", F.col("mix_source_size") * F.lit(float(cap)))
    per = cut(running(per.withColumn("ratio", F.col("ceiling") / F.col("w")), [F.col("ratio"), F.col("mix_source").asc_nulls_last()], ["ceiling", "w"], "mix-ratios"), "mix-ranked")
    every = per.agg(F.sum("mix_source_size").alias("all_sizes"), F.sum("w").alias("all_w"))
    share = (F.col("all_sizes") * F.lit(float(budget)) - F.col("before_ceiling")) / (F.col("all_w") - F.col("before_w"))
    shared = per.join(F.broadcast(every)).withColumn("share", share).where(F.col("share") * F.col("w") <= F.col("ceiling"))
    level = shared.agg(F.min(F.struct("place", "share"))["share"].alias("level"))
    return per.join(F.broadcast(level)).select("mix_source", "mix_source_size", F.coalesce(F.least(F.col("ceiling"), F.col("level") * F.col("w")), F.col("ceiling")).alias("mix_target"))


def planned(rows: DataFrame, weights=WEIGHTS, budget: float = BUDGET, cap: float = CAP, seeds: int = SEEDS) -> DataFrame:
    """``rows`` (doc_id, source, mix_size and others) with mix_source_size, mix_target and mix_copies."""
    sizes = rows.select("doc_id", "source", "mix_size")
    goal = targets(sizes, weights, budget, cap).withColumn("mix_rate", F.when(F.col("mix_source_size") > 0, F.col("mix_target") / F.col("mix_source_size")).otherwise(F.lit(0.0)))
    goal = goal.withColumn("mix_whole", F.floor("mix_rate")).withColumn("mix_part", F.col("mix_rate") - F.col("mix_whole"))
    on = F.col("source").eqNullSafe(F.col("mix_source"))
    u = draws(F.col("doc_id"), seeds)
    tried = sizes.join(goal, on).groupBy("mix_source").agg(
        *[F.sum(F.when(u[k] < F.col("mix_part"), F.col("mix_size")).otherwise(F.lit(0))).alias(f"s{k}") for k in range(seeds)],
        F.first("mix_part").alias("p"), F.first("mix_source_size").alias("n"),
    )
    off = F.array(*[F.struct(F.abs(F.col(f"s{k}") - F.col("p") * F.col("n")).alias("off"), F.lit(k).alias("k")) for k in range(seeds)])
    best = tried.select(F.col("mix_source").alias("best_source"), F.array_min(off)["k"].alias("mix_seed"))
    goal = cut(goal.join(best, F.col("mix_source").eqNullSafe(F.col("best_source"))).drop("best_source"), "mix-goals")
    drawn = F.element_at(F.array(*u), F.col("mix_seed") + 1)
    out = rows.join(goal, on).withColumn("mix_copies", (F.col("mix_whole") + F.when(drawn < F.col("mix_part"), 1).otherwise(0)).cast("int"))
    return out.drop("mix_source", "mix_rate", "mix_whole", "mix_part", "mix_seed")


def _rows(docs: DataFrame) -> DataFrame:
    return packed(docs, doc_id=docs["doc_id"], source=docs["source"], mix_size=word_count(docs["text"]))


def plan(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with mix_size, mix_source_size, mix_target and mix_copies."""
    return unpacked(planned(_rows(docs), **options), docs, "mix_size", "mix_source_size", "mix_target", "mix_copies")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: every document as often as the plan says, with the columns of ``docs`` only."""
    taken = planned(_rows(docs), **options).where("mix_copies > 0")
    return unpacked(taken.select("row", F.explode(F.sequence(F.lit(1), F.col("mix_copies")))), docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sizes = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("mix_size")), "mix-sizes")
    return planned(sizes).select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"), F.col("mix_copies").alias("copies"))


def _oracle() -> str:
    u = [f"(('0x' || substr(md5('{k - k % 2}:' || coalesce(doc_id::varchar, 'null')), {1 + 16 * (k % 2)}, 12))::bigint / {16**12}.0::double)" for k in range(SEEDS)]
    sums = ", ".join(f"sum(case when u[{k + 1}] < part then size else 0 end) s{k}" for k in range(SEEDS))
    best = ", ".join(f"{{'off': abs(s{k} - part * source_size), 'k': {k}}}" for k in range(SEEDS))
    return f"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint size, [{", ".join(u)}] u from documents),
per as (select source, sum(size)::bigint source_size, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 3.0 when 1 then 1.0 else 2.0 end::double w from d group by source),
ord as (select *, source_size * {float(CAP)}::double ceiling from per),
lft as (select *, (sum(source_size) over ())::double * {BUDGET}::double - coalesce(sum(ceiling) over b, 0) rest, sum(w) over () - coalesce(sum(w) over b, 0) ws, row_number() over (order by ceiling / w, source nulls last) place from ord
        window b as (order by ceiling / w, source nulls last rows between unbounded preceding and 1 preceding)),
lev as (select arg_min(rest / ws, place) lvl from lft where rest / ws * w <= ceiling),
goal as (select source, source_size, coalesce(least(ceiling, lvl * w), ceiling) target from lft left join lev on true),
rates as (select *, floor(case when source_size > 0 then target / source_size else 0 end) whole, case when source_size > 0 then target / source_size else 0 end - floor(case when source_size > 0 then target / source_size else 0 end) part from goal),
tried as (select g.source, any_value(part) part, any_value(source_size) source_size, {sums} from d join rates g on d.source is not distinct from g.source group by g.source),
best as (select source, list_min([{best}]).k k from tried)
select d.doc_id, d.size, g.source_size, g.target, (d.size * (g.whole + case when d.u[best.k + 1] < g.part then 1 else 0 end))::bigint taken, (g.whole + case when d.u[best.k + 1] < g.part then 1 else 0 end)::int copies
from d join rates g on d.source is not distinct from g.source join best on best.source is not distinct from d.source"""


ORACLE = _oracle()
