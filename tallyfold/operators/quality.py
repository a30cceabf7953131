"""Data-quality checks and dataset profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyfold.functions.numeric import count_where
from tallyfold.operators.scan import exact_quantiles

REQUIRED = ["id", "hand_id", "hero_position", "hero_stack_start", "big_blind", "hero_vpip", "hero_pfr", "hero_action_preflop", "won_cents", "hero_result"]
NUMERIC = ["hero_stack_start", "big_blind", "small_blind", "ante", "hero_vpip", "hero_pfr", "won_cents", "pot_final", "m_ratio"]


def issues(df: DataFrame, min_rows: int = 20) -> DataFrame:
    """One row per problem found, from one wide aggregate and one duplicate count."""
    f = F.col
    missing = [x for x in REQUIRED if x not in df.columns]
    have = [x for x in NUMERIC if x in df.columns]
    aggs: dict[str, Column] = {"n": F.count("*")}
    inf = F.lit(float("inf"))
    for x in have:
        v = f(x).try_cast("double")
        aggs[f"null_{x}"] = count_where(v.isNull() | F.isnan(v))
        aggs[f"inf_{x}"] = count_where(F.abs(v) == inf)
    ratio_cols = {"hero_stack_start", "big_blind"} <= set(df.columns)
    if ratio_cols:
        s, b = f("hero_stack_start").try_cast("double"), f("big_blind").try_cast("double")
        aggs["bad_ratio"] = count_where(F.coalesce((s <= 0) | (b <= 0), F.lit(True)) | s.isNull() | b.isNull())
    rates = {"hero_vpip", "hero_pfr"} <= set(df.columns)
    if rates:
        aggs["bad_rate"] = count_where(~f("hero_vpip").between(0, 1) | ~f("hero_pfr").between(0, 1))
    one = df.agg(*[v.alias(k) for k, v in aggs.items()])
    if "hand_id" in df.columns:
        dup = df.groupBy("hand_id").agg(F.count("*").alias("c")).agg(F.coalesce(F.sum(f("c") - 1), F.lit(0)).alias("d"))
        one = one.withColumn("dup", dup.scalar())

    def issue(level: str, code: str, column: str, n: Column, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"), F.lit(column).alias("column"), n.cast("long").alias("sample_size")))

    out = [issue("error", "empty_dataset", "", f("n"), f("n") == 0)]
    out += [issue("error", "missing_column", x, F.lit(0), F.lit(True)) for x in missing]
    if "hand_id" in df.columns:
        out.append(issue("error", "duplicate_hand_id", "hand_id", f("dup"), f("dup") > 0))
    out.append(issue("warning", "small_sample", "", f("n"), (f("n") < min_rows) & (f("n") > 0)))
    for x in have:
        out.append(issue("warning", "numeric_nulls", x, f(f"null_{x}"), f(f"null_{x}") > 0))
        out.append(issue("error", "numeric_infinite", x, f(f"inf_{x}"), f(f"inf_{x}") > 0))
    if ratio_cols:
        out.append(issue("error", "invalid_stack_bb", "hero_stack_start", f("bad_ratio"), f("bad_ratio") > 0))
    if rates:
        out.append(issue("warning", "rate_out_of_bounds", "hero_vpip", f("bad_rate"), f("bad_rate") > 0))
    return one.select(F.explode(F.array_compact(F.array(*out))).alias("i")).select("i.*")


def is_ok(found: DataFrame) -> DataFrame:
    return found.agg((F.count(F.when(F.col("level") == "error", 1)) == 0).alias("ok"), F.count("*").alias("issues"))


def numeric_long(df: DataFrame, columns: list[str], *keep: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(x).alias("feature"), F.col(x).cast("double").alias("v")) for x in columns])
    return df.select(*keep, F.explode(pairs).alias("p")).select(*keep, "p.*")


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, nulls, mean, std, min, quartiles and max per numeric column."""
    long = numeric_long(df, columns)
    q = exact_quantiles(long, ["feature"], F.col("v"), {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    m = long.groupBy("feature").agg(
        F.count("v").alias("count"), F.count(F.when(F.col("v").isNull(), 1)).alias("nulls"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"), F.max("v").alias("max"),
    )
    return m.join(q, "feature")


def histogram(df: DataFrame, columns: list[str], label: str, bins: int = 25) -> DataFrame:
    """Equal-width counts per feature and label, each over its own range; the top edge is closed."""
    f = F.col
    long = numeric_long(df, columns, label).where(f("v").isNotNull())
    ends = long.groupBy(label, "feature").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    j = long.join(ends, [label, "feature"])
    b = F.when(f("hi") == f("lo"), F.lit(bins // 2)).otherwise(F.least(F.floor((f("v") - f("lo")) / (f("hi") - f("lo")) * bins), F.lit(bins - 1)))
    return j.groupBy(label, "feature", b.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """All Pearson pairs in one aggregate, as (a, b, corr) rows."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    one = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)])).alias("r")).select("r.*")
