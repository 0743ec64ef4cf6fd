"""Ordered work on keys of any size: islands, positions and sliding counts over bins instead of whole keys.

A bin is a stretch of the order (a time, an id) between two quantiles of the whole table, so no bin holds much more than its share of the rows, whichever key they
have. Windows run inside (key, bin); what a bin has to know of those before it are one row a (key, bin): sums, or its last row,
carried over by a window over these rows alone. Quantiles (at most BINS) are all that reaches the driver; rows at one instant of one key stay together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 1024


def bin_of(rows: DataFrame, at: str, bins: int | None = None) -> Column:
    """The number of the bin that a long column's value lies in; nulls lie in the first one. As many bins as four times the shuffle partitions, by default."""
    bins = min(BINS, bins or 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = rows.select(F.percentile_approx(at, [i / bins for i in range(1, bins)], 10 * bins)).first()[0] if bins > 1 else None
    cuts = sorted(set(found or []))
    if not cuts:
        return F.lit(0)
    steps = [cuts[i : i + 32] for i in range(0, len(cuts), 32)]
    value = F.col(at)
    step = F.size(F.filter(F.array(*[F.lit(s[0]) for s in steps]), lambda c: c <= value))  # the stretch of cuts, then the place in it
    inside = F.element_at(F.array(*[F.array(*[F.lit(c) for c in s]) for s in steps]), step)
    return F.when(value.isNull() | (step == 0), 0).otherwise((step - 1) * 32 + F.size(F.filter(inside, lambda c: c <= value)))


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left joined with right on keys (null keys are one key); right's keys are dropped."""
    named = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(named, on, "left").drop(*[f"_r_{k}" for k in keys])


def islands(rows: DataFrame, keys: list[str], at: str, order: list[str], needs: list[str], opens: Callable[[Callable[[str], Column], Callable[[str], Column]], Column], to: str, bins: int | None = None) -> DataFrame:
    """rows with `to`: the number, from 1, of the island that each row of a key lies in.

    at: the long column that is cut into bins; order: what sorts rows, with `at` (or what it stands for) first. opens(before, here) tells whether a row starts an island, from the columns
    `needs` of the row before it and its own; the first row of a key always does.
    """
    rows = rows.withColumn("_bin", bin_of(rows, at, bins))
    inside = Window.partitionBy(*keys, "_bin").orderBy(*order)
    over = Window.partitionBy(*keys).orderBy("_bin")
    place = F.struct(*order)
    ends = rows.groupBy(*keys, "_bin").agg(*[F.max_by(c, place).alias(f"_last_{c}") for c in needs], *[F.min_by(c, place).alias(f"_first_{c}") for c in needs])
    # what the bins before ended with, and whether this one's first row opens an island
    carried = ends.withColumns({f"_before_{c}": F.lag(f"_last_{c}").over(over) for c in needs} | {"_is_first": F.row_number().over(over) == 1})
    first_opens = F.col("_is_first") | F.coalesce(opens(lambda c: F.col(f"_before_{c}"), lambda c: F.col(f"_first_{c}")), F.lit(False))
    lag = lambda c: F.lag(c).over(inside)
    inner = (F.row_number().over(inside) > 1) & F.coalesce(opens(lag, F.col), F.lit(False))
    local = rows.withColumn("_inner", inner.cast("long"))
    sums = local.groupBy(*keys, "_bin").agg(F.sum("_inner").alias("_opened"))
    starts = _same(carried.select(*keys, "_bin", first_opens.cast("long").alias("_first")), sums, [*keys, "_bin"])
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(*keys, "_bin", (F.coalesce(F.sum(F.col("_first") + F.col("_opened")).over(before), F.lit(0)) + F.col("_first")).alias("_base"))
    running = F.sum("_inner").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    out = _same(local.withColumn("_run", running), starts, [*keys, "_bin"])
    return out.withColumn(to, F.col("_base") + F.col("_run")).drop("_bin", "_inner", "_run", "_base")


def positions(rows: DataFrame, keys: list[str], at: str, order: list[str], to: str, bins: int | None = None) -> DataFrame:
    """rows with `to`: 0, 1 and on in the order of their key."""
    rows = rows.withColumn("_bin", bin_of(rows, at, bins))
    counts = rows.groupBy(*keys, "_bin").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "_bin", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_base"))
    place = F.row_number().over(Window.partitionBy(*keys, "_bin").orderBy(*order))
    out = _same(rows.withColumn("_place", place), starts, [*keys, "_bin"])
    return out.withColumn(to, F.col("_base") + F.col("_place") - 1).drop("_bin", "_base", "_place")


def counts_before(rows: DataFrame, keys: list[str], us: str, span: int, values: dict[str, Column], bins: int | None = None) -> DataFrame:
    """rows with the sums of integer `values` over the rows of the same key in the `span` microseconds before each, its own instant left out.

    Rows of one instant are added up first. A sum is the running sum before the row less that before the span's start: both are running sums inside a bin, and the
    sums of the bins before.
    """
    instants = rows.where(F.col(us).isNotNull()).groupBy(*keys, us).agg(*[F.coalesce(F.sum(v), F.lit(0)).alias(n) for n, v in values.items()])
    ends = instants.select(*keys, F.col(us).alias("_of"), F.col(us).alias("_at"), F.lit(1).alias("_sign"), *values)
    starts = instants.select(*keys, F.col(us).alias("_of"), (F.col(us) - span + 1).alias("_at"), F.lit(-1).alias("_sign"), *[F.lit(0).cast("long").alias(n) for n in values])
    number = bin_of(rows.select(F.col(us).alias("_at")), "_at", bins)
    marks = ends.unionByName(starts).withColumn("_bin", number)
    whole = marks.groupBy(*keys, "_bin").agg(*[F.sum(n).alias(f"_s_{n}") for n in values])
    over = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bases = whole.select(*keys, "_bin", *[F.coalesce(F.sum(f"_s_{n}").over(over), F.lit(0)).alias(f"_b_{n}") for n in values])
    inside = Window.partitionBy(*keys, "_bin").orderBy("_at").rangeBetween(Window.unboundedPreceding, -1)
    run = marks.select(*keys, "_bin", "_of", "_sign", *[F.coalesce(F.sum(n).over(inside), F.lit(0)).alias(f"_w_{n}") for n in values])
    met = _same(run, bases, [*keys, "_bin"])
    sums = met.groupBy(*keys, F.col("_of").alias(us)).agg(*[F.sum(F.col("_sign") * (F.col(f"_b_{n}") + F.col(f"_w_{n}"))).alias(n) for n in values])
    return _same(rows, sums, [*keys, us]).withColumns({n: F.coalesce(n, F.lit(0)) for n in values})
