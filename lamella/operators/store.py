"""The document store as DataFrame operators: latest-wins upserts, lookups, induced subgraphs, ordered children."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(base: DataFrame, delta: DataFrame, *keys: str) -> DataFrame:
    """Rows of ``delta`` replace those of ``base`` with the same key; within ``delta`` the row with the largest ``seq`` wins. One shuffle on the keys."""
    seen = base.withColumn("seq", F.lit(-1).cast("long")).unionByName(delta.withColumn("seq", F.col("seq").cast("long")))
    values = [c for c in base.columns if c not in keys]
    return seen.groupBy(*keys).agg(F.max_by(F.struct(*values), F.col("seq")).alias("v")).select(*[c if c in keys else F.col(f"v.{c}").alias(c) for c in base.columns])


def insert_absent(base: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """``base`` and those rows of ``new`` whose key it doesn't have."""
    return base.unionByName(new.join(base.select(*keys), list(keys), "left_anti"))


def append(base: DataFrame, rows: DataFrame, **defaults) -> DataFrame:
    """``base`` and ``rows``; columns that ``rows`` lacks, or holds as null, take the defaults."""
    filled = [F.coalesce(F.col(c), F.lit(defaults[c])) if c in rows.columns and c in defaults else F.col(c) if c in rows.columns else F.lit(defaults.get(c)) for c in base.columns]
    return base.unionByName(rows.select(*[x.cast(base.schema[c].dataType).alias(c) for c, x in zip(base.columns, filled, strict=True)]))


def allocate(base: DataFrame, rows: DataFrame, *order: str) -> DataFrame:
    """``base`` and ``rows`` with new ids (column id) after the largest, in the given order."""
    top = base.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    new = rows.withColumn("n", number(*order)).crossJoin(F.broadcast(top)).withColumn("id", F.col("top") + F.col("n"))
    return base.unionByName(new.select(*base.columns))


def create(base: DataFrame, rows: DataFrame, *keys: str) -> DataFrame:
    """``base`` and ``rows``; an error if a key is there already."""
    clash = rows.join(base.select(*keys), list(keys), "left_semi").select(*keys).first()
    if clash:
        raise ValueError(f"already exists: {', '.join(map(str, clash))}")
    return base.unionByName(rows.select(*base.columns))


def within(edges: DataFrame, ids: DataFrame, left: str, right: str) -> DataFrame:
    """The edges with both ends among ``ids`` (column id)."""
    return edges.join(ids.select(F.col("id").alias(left)), left, "left_semi").join(ids.select(F.col("id").alias(right)), right, "left_semi")


def ordered(group: Column, *by: str) -> Column:
    """The values of a group in the order of ``by``."""
    return F.transform(F.sort_array(F.collect_list(F.struct(*by, group.alias("value")))), lambda x: x["value"])


def number(*by, within: tuple[str, ...] = ()) -> Column:
    """1-based place in order, within a partition if one is given."""
    w = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    return F.row_number().over(w.orderBy(*by)).cast("long")
