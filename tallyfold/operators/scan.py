"""Ordered scans (running totals, carry-forward, exact quantiles) without one big sort task.

A plain ``Window.partitionBy(key)`` sends everything a key owns to one task,
so one key with a third of the rows stalls the job. Here rows are first cut into ordered
slices by split points taken from an approximate quantile sketch; the window runs
inside (key, slice), and a tiny per-slice total table supplies what came before.
Split points are a scalar subquery, so they never pass through the driver, and a
slice id is a pure function of the row, so a re-run task lands in the same slice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyfold.session import slice_count

SLICE = "_slice"


def _place(points: str, value: str, n: int) -> Column:
    """How many of the sorted points lie below the value, by binary steps."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(max(1, n.bit_length())))])
    return F.aggregate(
        steps,
        F.lit(0),
        lambda pos, s: F.when(
            (pos + s <= F.size(points)) & (F.try_element_at(F.col(points), pos + s) < F.col(value)), pos + s
        ).otherwise(pos),
    )


def add_slice(
    df: DataFrame, by: Column, slices: int | None = None, sketch_of: DataFrame | None = None, tie: Column | None = None
) -> DataFrame:
    """Tag each row with the ordered slice its ``by`` value (numeric) falls in.

    A value that fills two or more sketch intervals is hot; with a numeric ``tie`` (the next sort
    term) its rows are cut again by the tie, so a single repeated value cannot fill one slice.
    """
    n = slices or slice_count(df.sparkSession)
    probs = F.array(*[F.lit(i / n) for i in range(1, n)])
    src = sketch_of if sketch_of is not None else df
    second = (tie if tie is not None else F.lit(0)).cast("double")
    sketch = src.select(by.cast("double").alias("v"), second.alias("t")).agg(
        F.percentile_approx("v", probs, F.lit(20 * n)).alias("v"), F.percentile_approx("t", probs, F.lit(20 * n)).alias("t")
    )
    points = sketch.select(F.struct(
        F.array_distinct("v").alias("v"),
        F.array_distinct(F.filter("v", lambda x, i: (i > 0) & (x == F.try_element_at("v", i)))).alias("hot"),
        F.array_distinct("t").alias("t"),
    ).alias("p"))
    d = df.withColumn("_p", points.scalar()).withColumns({"_pv": F.col("_p.v"), "_pt": F.col("_p.t"), "_hot": F.col("_p.hot"), "_by": by.cast("double"), "_tie": second})
    sub = F.when(F.array_contains("_hot", F.col("_by")), _place("_pt", "_tie", n) + 1).otherwise(0) if tie is not None else F.lit(0)
    out = F.when(F.col("_pv").isNull(), 0).otherwise(_place("_pv", "_by", n) * (n + 1) + sub)
    return d.withColumn(SLICE, out).drop("_p", "_pv", "_pt", "_hot", "_by", "_tie")


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    sums: dict[str, Column],
    slice_by: Column,
    totals: bool = False,
    slices: int | None = None,
    sketch_of: DataFrame | None = None,
    tie: Column | None = None,
) -> DataFrame:
    """Inclusive running sums per key in the given order.

    ``slice_by`` must be a numeric column that sorts like the first order term, ``tie`` one that
    sorts like the second.
    With ``totals`` each sum's whole-key total is added as ``<name>_total``.
    """
    keys = list(keys)
    s = add_slice(df, slice_by, slices, sketch_of, tie)
    names = list(sums)
    for n in names:
        s = s.withColumn(f"_v_{n}", sums[n])
    local = Window.partitionBy(*keys, SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    part = s.groupBy(*keys, SLICE).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in names])
    prior = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    part = part.select(
        *keys,
        SLICE,
        *[F.coalesce(F.sum(f"_t_{n}").over(prior), F.lit(0)).alias(f"_o_{n}") for n in names],
        *([F.sum(f"_t_{n}").over(whole).alias(f"{n}_total") for n in names] if totals else []),
    )
    out = s.select("*", *[F.sum(f"_v_{n}").over(local).alias(f"_l_{n}") for n in names]).join(part, [*keys, SLICE])
    for n in names:
        out = out.withColumn(n, F.col(f"_l_{n}") + F.col(f"_o_{n}"))
    return out.drop(SLICE, *[f"_{p}_{n}" for n in names for p in ("v", "l", "o")])


def carry_forward(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: Sequence[str],
    slice_by: Column,
    slices: int | None = None,
    tie: Column | None = None,
) -> DataFrame:
    """Replace each column by its latest non-null value so far within the key."""
    keys = list(keys)
    s = add_slice(df, slice_by, slices, tie=tie)
    local = Window.partitionBy(*keys, SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    at = F.struct(*[F.col(o) for o in order])
    ends = s.groupBy(*keys, SLICE).agg(
        *[F.max_by(F.col(x), F.when(F.col(x).isNotNull(), at)).alias(f"_e_{x}") for x in columns]
    )
    prior = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(
        *keys, SLICE, *[F.last(f"_e_{x}", ignorenulls=True).over(prior).alias(f"_p_{x}") for x in columns]
    )
    out = s.select("*", *[F.last(x, ignorenulls=True).over(local).alias(f"_l_{x}") for x in columns])
    out = out.join(ends, [*keys, SLICE])
    for x in columns:
        out = out.withColumn(x, F.coalesce(f"_l_{x}", f"_p_{x}"))
    return out.drop(SLICE, *[f"_{p}_{x}" for x in columns for p in ("l", "p")])


def value_counts(df: DataFrame, keys: Sequence[str], value: Column, name: str = "v") -> DataFrame:
    """Distinct values per key with their counts: equal values collapse map-side."""
    return df.where(value.isNotNull()).groupBy(*keys, value.alias(name)).agg(F.count("*").alias("n"))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: Column, probs: dict[str, float]) -> DataFrame:
    """Linear-interpolated quantiles per key, exact, from a distributed running count."""
    keys = list(keys)
    h = value_counts(df, keys, value.cast("double"))
    r = running_totals(h, keys, [F.col("v")], {"cum": F.col("n")}, F.col("v"), totals=True)
    aggs, outs = [], []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("cum_total") - 1)
        for tag, idx in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            inside = (idx >= F.col("cum") - F.col("n")) & (idx < F.col("cum"))
            aggs.append(F.max(F.when(inside, F.col("v"))).alias(f"_{name}_{tag}"))
        frac = F.lit(float(p)) * (F.col("_n") - 1)
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        outs.append((lo + (hi - lo) * (frac - F.floor(frac))).alias(name))
    return r.groupBy(*keys).agg(F.max("cum_total").alias("_n"), *aggs).select(*keys, *outs)
