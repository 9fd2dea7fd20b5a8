"""Ordered computations that never need a whole key in one task.

Window functions over ``PARTITION BY key`` put all rows of a key in one task.
The helpers here split each key by a bucket that follows the sort order, work
inside the buckets, and pass only one summary row per bucket across them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_rows(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column],
                out: str = "rn") -> DataFrame:
    """1-based row number per key; ``bucket`` must ascend with ``order``."""
    keys = list(keys)
    df = df.withColumn("_b", bucket)
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (df.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
               .withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
               .drop("_n"))
    local = Window.partitionBy(*keys, "_b").orderBy(*order)
    numbered = df.withColumn("_rn", F.row_number().over(local))
    return (numbered.join(offsets, [*keys, "_b"], "left")
            .withColumn(out, (F.col("_off") + F.col("_rn")).cast("bigint"))
            .drop("_b", "_rn", "_off"))


def carry(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[str], fields: dict[str, Column],
          known: Column | None = None, before: str | None = None, after: str | None = None,
          exclude_current: bool = False) -> DataFrame:
    """Adds the nearest known row at or before (``before``) and at or after (``after``) each row.

    Both are structs of ``fields``, null where there is none. ``bucket`` must
    ascend with ``order``, and known rows that agree in ``order[0]`` must agree
    in the fields. With ``exclude_current`` the row itself does not count.

    The sort puts only a bucket of a key in one task. Across buckets goes one
    row each, from a hash aggregation that combines before its shuffle, and it
    comes back by a join on the partitioning the sort already has.
    """
    keys, names = list(keys), list(fields)
    known = F.lit(True) if known is None else known
    df = df.withColumn("_b", bucket).withColumn("_k", known)
    at = F.when(F.col("_k"), F.col(order[0]))
    ends = df.groupBy(*keys, "_b").agg(*[
        c for i, n in enumerate(names) for c in (
            F.max_by(fields[n], at).alias(f"_l{i}"), F.min_by(fields[n], at).alias(f"_f{i}"))],
        F.bool_or("_k").alias("_any"))
    across = Window.partitionBy(*keys).orderBy("_b")
    inside = Window.partitionBy(*keys, "_b").orderBy(*[F.col(c) for c in order])
    value = F.when(F.col("_k"), F.struct(*[c.alias(n) for n, c in fields.items()]))
    edge = lambda side: F.when(F.col("_any"), F.struct(*[F.col(f"_{side}{i}").alias(n) for i, n in enumerate(names)]))
    near = 1 if exclude_current else 0
    local, summary = df, ends
    if before:
        summary = summary.withColumn("_cb", F.last(edge("l"), True).over(across.rowsBetween(Window.unboundedPreceding, -1)))
        local = local.withColumn("_lb", F.last(value, True).over(inside.rowsBetween(Window.unboundedPreceding, -near)))
    if after:
        # Looking ahead is looking back in descending order: a frame that ends unbounded would
        # be read again for every row, a running one is read once.
        ahead = Window.partitionBy(*keys).orderBy(F.col("_b").desc())
        onward = Window.partitionBy(*keys, "_b").orderBy(*[F.col(c).desc() for c in order])
        summary = summary.withColumn("_ca", F.last(edge("f"), True).over(ahead.rowsBetween(Window.unboundedPreceding, -1)))
        local = local.withColumn("_la", F.last(value, True).over(onward.rowsBetween(Window.unboundedPreceding, -near)))
    joined = local.join(summary.select(*keys, "_b", *[c for c, on in (("_cb", before), ("_ca", after)) if on]), [*keys, "_b"], "left")
    if before:
        joined = joined.withColumn(before, F.coalesce("_lb", "_cb")).drop("_lb", "_cb")
    if after:
        joined = joined.withColumn(after, F.coalesce("_la", "_ca")).drop("_la", "_ca")
    return joined.drop("_b", "_k")


def first_at_max(value: Column, ident: Column) -> Column:
    """Ordering whose maximum is the largest value and, among equals, the lowest id; NaN counts as missing."""
    return F.when(value.isNotNull() & ~F.isnan(value), F.struct(value.alias("v"), (-ident).alias("i")))


def first_at_min(value: Column, ident: Column) -> Column:
    """Ordering whose minimum is the smallest value and, among equals, the lowest id; NaN counts as missing."""
    return F.when(value.isNotNull() & ~F.isnan(value), F.struct(value.alias("v"), ident.alias("i")))


def row_at_extreme(df: DataFrame, keys: Sequence[str], value: str, ident: str, columns: Sequence[str], largest: bool) -> DataFrame:
    """Per key: ``columns`` of the row with the largest or smallest value, the lowest id among equals.

    The extreme is one fixed-width aggregation; only rows that reach it are
    then ordered by id, so the bulk of the rows is never sorted.
    """
    keys, columns = list(keys), list(columns)
    known = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*keys, value, ident, *columns)
    best = known.groupBy(*keys).agg((F.max if largest else F.min)(value).alias("_best"))
    tied = known.join(best, keys).where(F.col(value) == F.col("_best"))
    return tied.groupBy(*keys).agg(F.min_by(F.struct(*columns), F.col(ident)).alias("_at")).select(*keys, "_at.*")


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, fractions: dict[str, float],
                      accuracy: int = 10000) -> DataFrame:
    """Exact linear-interpolation percentiles per key, one row per key.

    A mergeable sketch brackets each wanted rank. One aggregation then counts
    the rows below every bracket, and only the values inside the brackets, a
    small fixed share of a key, are shuffled and ordered.
    """
    keys = list(keys)
    slack = 4.0 / accuracy
    edges = [e for p in fractions.values() for e in (max(0.0, p - slack), min(1.0, p + slack))]
    sketch = df.groupBy(*keys).agg(
        F.percentile_approx(value, edges, accuracy).alias("_e"), F.count(value).alias("_n"),
        F.min(value).alias("_min"), F.max(value).alias("_max"))
    small = F.col("_n") * slack < 4  # too few rows for the slack to hold a rank: take the whole range
    brackets = sketch.select(*keys, "_n", *[c for i, name in enumerate(fractions) for c in (
        F.when(small, F.col("_min")).otherwise(F.get("_e", F.lit(2 * i))).alias(f"_lo_{name}"),
        F.when(small, F.col("_max")).otherwise(F.get("_e", F.lit(2 * i + 1))).alias(f"_hi_{name}"))])
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v")).join(brackets, keys)
    below = rows.groupBy(*keys).agg(*[F.count_if(F.col("_v") < F.col(f"_lo_{name}")).alias(f"_b_{name}") for name in fractions])
    hits = F.array_compact(F.array(*[
        F.when(F.col("_v").between(F.col(f"_lo_{name}"), F.col(f"_hi_{name}")),
               F.struct(F.lit(name).alias("name"), F.lit(float(p)).alias("p"))) for name, p in fractions.items()]))
    inside = (rows.select(*keys, "_n", "_v", F.explode(hits).alias("_t")).groupBy(*keys, "_n", "_t.name", "_t.p", "_v")
              .agg(F.count(F.lit(1)).alias("_c")).join(below, keys))
    base = F.coalesce(*[F.when(F.col("name") == name, F.col(f"_b_{name}")) for name in fractions])
    run = Window.partitionBy(*keys, "name").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("_upto", base + F.sum("_c").over(run)).withColumn("_from", F.col("_upto") - F.col("_c"))
    rank = F.col("p") * (F.col("_n") - 1)

    def at(k: Column) -> Column:
        return F.max(F.when((F.col("_from") <= k) & (k < F.col("_upto")), F.col("_v")))

    picked = inside.groupBy(*keys, "name").agg(
        at(F.floor(rank)).alias("a"), at(F.floor(rank) + 1).alias("b"), F.max(rank - F.floor(rank)).alias("f"))
    picked = picked.withColumn("value", F.col("a") + (F.coalesce("b", "a") - F.col("a")) * F.col("f"))
    return picked.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in fractions])
