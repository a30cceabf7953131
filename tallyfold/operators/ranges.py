"""Hand-range dimensions and membership, nearest-key and nearest-centre joins.

The dimensions are constants (a few hundred rows at most), so broadcasting them is safe at any
input size; nearest lookups are array folds on the row, never a row-by-candidate join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyfold.functions import cards, fixed_values as fv
from tallyfold.functions.play import lookup


def label_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(cards.all_labels(), "label string, hi int, lo int, kind string").withColumn("tier", cards.tier_of(F.col("label")))


def expand_notation(spark: SparkSession, rows: list[tuple[str, str]], strict: bool = True) -> DataFrame:
    """(seat, notation) rows to (seat, label) rows.

    ``77+`` is the pair and all above; ``AJs+`` the kickers between the high card and the
    named one. With ``strict`` the named kicker itself is left out and ladders whose
    high card is below a ten expand to nothing, as the source charts do; otherwise both are kept.
    """
    ranks = cards.RANKS
    parsed = []
    for seat, note in rows:
        plus = note.endswith("+")
        body = note.rstrip("+")
        hi, lo = ranks.index(body[0]), ranks.index(body[1])
        kind = "p" if body[0] == body[1] else body[2]
        parsed.append((seat, note, plus, min(hi, lo), max(hi, lo), kind))
    n = spark.createDataFrame(parsed, "seat string, notation string, plus boolean, nhi int, nlo int, kind string")
    d = label_dimension(spark).withColumnRenamed("kind", "k")
    exact = ~F.col("plus") & (F.col("hi") == F.col("nhi")) & (F.col("lo") == F.col("nlo"))
    pair = F.col("plus") & (F.col("kind") == "p") & (F.col("hi") <= F.col("nhi"))
    kickers = (F.col("lo") < F.col("nlo")) if strict else (F.col("lo") <= F.col("nlo"))
    usable = (F.col("nhi") <= ranks.index("T")) if strict else F.lit(True)
    ladder = F.col("plus") & (F.col("kind") != "p") & (F.col("hi") == F.col("nhi")) & kickers & usable
    return n.join(F.broadcast(d), F.col("k") == F.col("kind")).where(exact | pair | ladder).select("seat", "label").distinct()


def opening_ranges(spark: SparkSession, strict: bool = True) -> DataFrame:
    return expand_notation(spark, [(s, n) for s, notes in fv.OPENING.items() for n in notes], strict)


def range_dimension(spark: SparkSession, strict: bool = True) -> DataFrame:
    """(seat, label) with flags for opening, value and bluff re-raise, and flat calls."""
    out = opening_ranges(spark, strict).withColumn("kind", F.lit("open"))
    exact = [
        (s, h, kind) for kind, table in (("value", fv.RERAISE_VALUE), ("bluff", fv.RERAISE_BLUFF), ("flat", fv.FLAT)) for s, hs in table.items() for h in hs.split()
    ]
    out = out.unionByName(spark.createDataFrame(exact, "seat string, label string, kind string"))
    return out.groupBy("seat", "label").agg(*[F.max(F.when(F.col("kind") == k, True)).alias(f"in_{k}") for k in ("open", "value", "bluff", "flat")])


def with_range_flags(rows: DataFrame, seat: str = "seat", label: str = "label", strict: bool = True) -> DataFrame:
    """Membership flags by a left join to the constant range dimension."""
    dim = range_dimension(rows.sparkSession, strict).withColumnsRenamed({"seat": "_s", "label": "_l"})
    j = rows.join(F.broadcast(dim), (F.col(seat) == F.col("_s")) & (F.col(label) == F.col("_l")), "left").drop("_s", "_l")
    return j.withColumns({f"in_{k}": F.coalesce(f"in_{k}", F.lit(False)) for k in ("open", "value", "bluff", "flat")})


def nearest_depth(position: Column, stack_bb: Column, depths: dict[str, list[float]]) -> Column:
    """The charted depth closest to the stack for the seat, first listed on ties; null without a chart."""
    table = F.create_map(*[x for k, v in depths.items() for x in (F.lit(k), F.array(*[F.lit(float(d)) for d in v]))])
    have = F.try_element_at(table, position)
    scored = F.transform(have, lambda d, i: F.struct(F.abs(d - stack_bb).alias("gap"), i.alias("i"), d.alias("depth")))
    return F.array_min(scored)["depth"]


def nearest_style(vpip: Column, pfr: Column) -> Column:
    """Closest play-style centre by Euclidean distance, first listed on ties."""
    best = [
        F.struct(
            F.sqrt(F.pow(vpip - (a + b) / 2, F.lit(2.0)) + F.pow(pfr - (lo + hi) / 2, F.lit(2.0))).alias("d"), F.lit(i).alias("i"), F.lit(name).alias("name")
        )
        for i, (name, (a, b, lo, hi)) in enumerate(fv.STYLES.items())
    ]
    return F.array_min(F.array(*best))["name"]


def profile_alert(position: Column, action: Column) -> Column:
    """Alert when an action feeds the seat's known tendency."""
    v, vt, p, pt = [lookup(position, {k: r[i] for k, r in fv.SEAT_PROFILE.items()}) for i in range(4)]
    lean = lookup(position, {k: r[4] for k, r in fv.SEAT_PROFILE.items()})
    a = F.upper(action)
    limit = fv.PROFILE_ALERT_AT
    tight = lean.isin("tight", "passive") & (F.abs(v - vt) >= limit) & a.contains("FOLD")
    loose = (lean == "loose") & (v - vt >= limit) & a.rlike("RFI|3-BET|FLAT|ALL-IN")
    low = (lean == "pfr_low") & (F.abs(p - pt) >= limit) & a.contains("FLAT")
    nums = F.concat(F.lit(" ("), F.format_string("%.0f", F.bround(v, 0)), F.lit("% vs GTO "), F.format_string("%.0f", F.bround(vt, 0)), F.lit("%)"))
    return (
        F.when(tight, F.concat(position, F.lit(" tight"), nums))
        .when(loose, F.concat(position, F.lit(" loose"), nums))
        .when(low, F.concat(F.lit("PFR baixo no "), position, F.lit(" — considere 3-bet")))
        .otherwise("")
    )
