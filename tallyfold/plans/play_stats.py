"""Play statistics: global, per seat, per zone, per session, and findings against targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyfold.functions import fixed_values as fv
from tallyfold.functions.numeric import c, count_where, ratio
from tallyfold.functions.play import m_zone

def N() -> Column:
    return F.count("*")


def _pct(col: str) -> Column:
    return F.avg(c(col)) * 100


def _pct_of(cond: Column) -> Column:
    return F.avg(F.when(cond, 1).otherwise(0)) * 100


def bb_per_100(rows: Column | None = None) -> Column:
    """Big blinds won per hundred rows; rows without a blind add nothing."""
    won = F.sum(F.try_divide(F.col("won_cents").cast("double"), F.nullif(F.col("big_blind"), F.lit(0))))
    return F.try_divide(won, (rows if rows is not None else N()).cast("double")) * 100


def seat_targets(spark: SparkSession) -> DataFrame:
    rows = [(s, i, *fv.SEAT_TARGETS[s]) for i, s in enumerate(fv.REPORT_SEATS)]
    return spark.createDataFrame(rows, "hero_position string, seat_order int, target_vpip double, target_pfr double")


def global_stats(hands: DataFrame, digits: int = 1) -> DataFrame:
    """One row of counts and rates over all play; one pass, no shuffle beyond the final merge."""
    seen_flop = (F.coalesce(F.col("board_flop"), F.lit("")) != "") & (
        F.coalesce(F.col("hero_action_preflop"), F.lit("")).rlike("calls|raises") | (F.col("hero_position") == "BB")
    )
    won = F.col("hero_result") == "win"
    sd = F.col("went_to_showdown") == 1
    t = hands.agg(
        N().alias("n"),
        F.sum("hero_vpip").alias("vpip"),
        F.sum("hero_pfr").alias("pfr"),
        F.sum("hero_aggressor").alias("agg"),
        count_where(F.col("hero_result") == "fold").alias("folds"),
        count_where(won).alias("wins"),
        F.sum("went_to_showdown").alias("sd"),
        count_where(sd & won).alias("sd_won"),
        F.sum("hero_went_allin").alias("allin"),
        count_where((F.col("hero_went_allin") == 1) & (F.col("hero_result") == "allin_loss")).alias("allin_lost"),
        count_where(seen_flop).alias("flop"),
        F.avg("m_ratio").alias("m"),
    )
    n = F.col("n")
    one = F.lit(1)

    def pct(num: str, den: Column) -> Column:
        return F.round(ratio(F.col(num), den) * 100, digits)

    return t.select(
        n.alias("total_hands"),
        pct("vpip", n).alias("vpip_pct"),
        pct("pfr", n).alias("pfr_pct"),
        F.round((ratio(F.col("vpip"), n) - ratio(F.col("pfr"), n)) * 100, digits).alias("vpip_pfr_gap"),
        F.round(F.col("agg") / F.greatest(F.col("vpip") - F.col("pfr"), one), 2).alias("aggression_factor"),
        pct("folds", n).alias("fold_pct"),
        pct("wins", n).alias("win_pct"),
        pct("sd", F.greatest(F.col("flop"), one)).alias("wtsd_pct"),
        pct("sd_won", F.greatest(F.col("sd"), one)).alias("w_at_sd_pct"),
        F.col("wins").alias("total_wins"),
        F.col("folds").alias("total_folds"),
        F.col("sd").alias("went_to_showdown"),
        F.col("allin").alias("allin_total"),
        pct("allin_lost", F.greatest(F.col("allin"), one)).alias("allin_loss_pct"),
        F.round("m", 2).alias("avg_m_ratio"),
    )


def by_seat(hands: DataFrame, digits: int = 1) -> DataFrame:
    """Rates per seat beside their targets, in seat order; unknown seats drop out."""
    g = hands.groupBy("hero_position").agg(
        N().alias("hands"),
        _pct("hero_vpip").alias("v"),
        _pct("hero_pfr").alias("p"),
        _pct("hero_aggressor").alias("a"),
        _pct_of(F.col("hero_result") == "fold").alias("f"),
        _pct_of(F.col("hero_result") == "win").alias("w"),
        _pct("went_to_showdown").alias("s"),
    )
    j = g.join(F.broadcast(seat_targets(hands.sparkSession)), "hero_position")
    tv, tp = F.col("target_vpip") * 100, F.col("target_pfr") * 100

    def r(x) -> Column:
        return F.round(x, digits)

    return j.select(
        "hero_position", "seat_order", "hands",
        r("v").alias("vpip_pct"), r("p").alias("pfr_pct"), r(F.col("v") - F.col("p")).alias("gap_vp_pfr"),
        r("a").alias("aggr_pct"), r("f").alias("fold_pct"), r("w").alias("win_pct"), r("s").alias("wtsd_pct"),
        r(tv).alias("gto_vpip_pct"), r(tp).alias("gto_pfr_pct"),
        r(F.col("v") - tv).alias("vpip_delta"), r(F.col("p") - tp).alias("pfr_delta"),
    ).orderBy("seat_order")


def by_zone(hands: DataFrame, digits: int = 1) -> DataFrame:
    order = [z for z, _, _ in fv.M_ZONES]
    g = hands.groupBy(m_zone("m_ratio").alias("m_zone")).agg(
        N().alias("hands"),
        F.round(_pct("hero_vpip"), digits).alias("vpip_pct"),
        F.round(_pct("hero_pfr"), digits).alias("pfr_pct"),
        F.round(_pct("hero_went_allin"), digits).alias("allin_pct"),
        F.round(_pct_of(F.col("hero_result") == "win"), digits).alias("win_pct"),
    )
    return g.orderBy(F.array_position(F.array(*[F.lit(z) for z in order]), F.col("m_zone")))


def by_tournament(hands: DataFrame, digits: int = 1) -> DataFrame:
    return hands.where(F.col("tournament_name").isNotNull()).groupBy("tournament_name").agg(
        N().alias("hands"),
        F.round(_pct("hero_vpip"), digits).alias("vpip_pct"),
        F.round(_pct("hero_pfr"), digits).alias("pfr_pct"),
        count_where(F.col("hero_result") == "win").alias("wins"),
        F.sum("hero_went_allin").alias("allins"),
        F.round(F.avg("m_ratio"), digits).alias("avg_m"),
    )


def daily_trend(hands: DataFrame, digits: int = 1) -> DataFrame:
    return hands.groupBy(F.to_date("date_utc").alias("date")).agg(
        F.count("hand_id").alias("hands"),
        F.round(_pct("hero_vpip"), digits).alias("vpip_pct"),
        F.round(_pct("hero_pfr"), digits).alias("pfr_pct"),
        count_where(F.col("hero_result") == "win").alias("wins"),
        F.sum("hero_went_allin").alias("allins"),
    )


def findings(hands: DataFrame) -> DataFrame:
    """Rule findings against seat targets plus two global rules, one row each."""
    s = by_seat(hands).where("hands >= 10").join(
        F.broadcast(seat_targets(hands.sparkSession).select("hero_position", "target_vpip", "target_pfr")), "hero_position"
    )
    tv, tp = F.col("target_vpip") * 100, F.col("target_pfr") * 100
    v, p, gap = F.col("vpip_pct"), F.col("pfr_pct"), F.col("gap_vp_pfr")

    def hit(cond, kind, value, target, severity):
        return F.when(
            cond,
            F.struct(F.lit(kind).alias("kind"), value.alias("value"), target.alias("target"), severity.alias("severity")),
        )

    seat_rules = F.array_compact(
        F.array(
            hit(v < tv * fv.TOO_TIGHT, "VPIP Baixo", v, tv, F.when(v < tv * 0.5, "ALTA").otherwise("MÉDIA")),
            hit(v > tv * fv.TOO_LOOSE, "VPIP Alto", v, tv, F.lit("ALTA")),
            hit(gap > fv.GAP_LIMIT * 100, "Call Station", gap, F.lit(fv.GAP_LIMIT * 100), F.lit("MÉDIA")),
            hit((p < tp * fv.PFR_TOO_LOW) & (v > 0), "PFR Baixo", p, tp, F.lit("MÉDIA")),
        )
    )
    per_seat = s.select("hero_position", F.explode(seat_rules).alias("r")).select("hero_position", "r.*")
    t = hands.agg(
        N().alias("n"),
        count_where(F.col("hero_result") == "fold").alias("folds"),
        F.sum("hero_went_allin").alias("allin"),
        count_where((F.col("hero_went_allin") == 1) & (F.col("hero_result") == "allin_loss")).alias("lost"),
    )
    fold, lost = ratio(F.col("folds"), F.col("n")), ratio(F.col("lost"), F.col("allin"))
    global_rules = F.array_compact(
        F.array(
            hit(fold > fv.FOLD_LIMIT, "Fold Rate Global", fold * 100, F.lit(90.0), F.lit("ALTA")),
            hit((F.col("allin") >= 3) & (lost > fv.ALLIN_LOSS_LIMIT), "All-In Bad Spots", lost * 100, F.lit(50.0), F.lit("ALTA")),
        )
    )
    overall = t.select(F.lit("GERAL").alias("hero_position"), F.explode(global_rules).alias("r")).select("hero_position", "r.*")
    return per_seat.unionByName(overall)


def stats_by_position(hands: DataFrame) -> DataFrame:
    """Reporting view: ten measures per seat, largest first."""
    named = hands.where(F.coalesce(F.col("hero_position"), F.lit("")) != "")
    return named.groupBy("hero_position").agg(
        N().alias("total_hands"),
        F.round(_pct("hero_vpip"), 1).alias("vpip_pct"),
        F.round(_pct("hero_pfr"), 1).alias("pfr_pct"),
        F.round(_pct("hero_aggressor"), 1).alias("aggression_pct"),
        F.round(_pct("hero_went_allin"), 1).alias("allin_pct"),
        F.round(_pct("went_to_showdown"), 1).alias("wtsd_pct"),
        F.sum("won_cents").alias("net_cents"),
        F.round(F.avg("won_cents"), 2).alias("avg_won_per_hand"),
        F.round(F.avg(F.try_divide(F.col("hero_stack_start").cast("double"), F.nullif(F.col("big_blind"), F.lit(0)))), 2).alias("avg_stack_bb"),
        F.round(bb_per_100(), 2).alias("bb_per_100"),
    ).orderBy(F.col("total_hands").desc(), "hero_position")


def stats_by_cards(hands: DataFrame, min_hands: int = 5) -> DataFrame:
    named = hands.where(F.coalesce(F.col("hero_cards"), F.lit("")) != "")
    return named.groupBy("hero_cards").agg(
        N().alias("total_hands"),
        F.sum("hero_vpip").alias("times_played"),
        F.sum("won_cents").alias("net_cents"),
        F.round(F.avg("won_cents"), 2).alias("avg_won"),
        F.round(_pct("went_to_showdown"), 1).alias("wtsd_pct"),
        count_where(F.col("hero_result") == "win").alias("wins"),
    ).where(F.col("total_hands") >= min_hands).orderBy(F.col("net_cents").desc(), "hero_cards")


def session_trend(sessions: DataFrame, hands: DataFrame) -> DataFrame:
    """Per-session rates. Play is reduced per session first, so the join moves one row per session."""
    per = hands.groupBy("session_id").agg(
        F.round(_pct("hero_vpip"), 1).alias("vpip_pct"),
        F.round(_pct("hero_pfr"), 1).alias("pfr_pct"),
        F.round(F.avg("m_ratio"), 1).alias("avg_m_ratio"),
    )
    return sessions.join(per, "session_id").select(
        "session_id", "source_file", F.to_date("ingested_at").alias("session_date"), "hands_count", "net_cents",
        "vpip_pct", "pfr_pct", "avg_m_ratio",
    )


def overall_summary(hands: DataFrame) -> DataFrame:
    return hands.where("big_blind > 0").agg(
        N().alias("total_maos"),
        F.round(_pct("hero_vpip"), 1).alias("vpip"),
        F.round(_pct("hero_pfr"), 1).alias("pfr"),
        F.round(_pct("hero_aggressor"), 1).alias("agg"),
        F.round(_pct("went_to_showdown"), 1).alias("wtsd"),
        F.round(bb_per_100(), 2).alias("bb_per_100"),
    )


def seat_summary(hands: DataFrame, only: str = "") -> DataFrame:
    """Per-seat summary; an empty ``only`` keeps every seat."""
    src = hands.where("big_blind > 0").where((F.lit(only.upper()) == "") | (F.col("hero_position") == only.upper()))
    return src.groupBy("hero_position").agg(
        N().alias("maos"),
        F.round(_pct("hero_vpip"), 1).alias("vpip"),
        F.round(_pct("hero_pfr"), 1).alias("pfr"),
        F.round(_pct("hero_aggressor"), 1).alias("agg"),
        F.round(_pct("went_to_showdown"), 1).alias("wtsd"),
        F.round(_pct_of(F.col("hero_vpip") == 0), 1).alias("fold_pct"),
        F.round(bb_per_100(), 2).alias("bb_per_100"),
    ).orderBy(F.col("maos").desc(), "hero_position")


def seat_flags(hands: DataFrame) -> DataFrame:
    bb, n = F.col("bb_per_100"), F.col("maos")
    flag = F.when(bb < 0, "DÉFICIT").when((bb >= 0) & (bb < 50) & (n >= 30), "ABAIXO DO ESPERADO").otherwise("")
    return seat_summary(hands).select("hero_position", "maos", "bb_per_100", flag.alias("flag"))


def newest_sessions(sessions: DataFrame, hands: DataFrame, n: int = 10) -> DataFrame:
    """Newest sessions with their rates; the session hands_count is the denominator."""
    per = hands.where("big_blind > 0").groupBy("session_id").agg(
        F.round(_pct("hero_vpip"), 1).alias("vpip"),
        F.round(_pct("hero_pfr"), 1).alias("pfr"),
        F.sum(F.col("won_cents").cast("double") / F.col("big_blind")).alias("won_bb"),
    )
    return (
        sessions.join(per, "session_id")
        .orderBy(F.col("ingested_at").desc(), F.col("session_id").desc())
        .limit(n)
        .select(
            "session_id", F.to_date("ingested_at").alias("data"), "hands_count", "net_cents", "vpip", "pfr",
            F.round(F.try_divide(F.col("won_bb"), F.col("hands_count").cast("double")) * 100, 1).alias("bb100"),
        )
    )


def recent_vs_overall(sessions: DataFrame, hands: DataFrame, n: int = 10) -> DataFrame:
    """Rates over the newest n sessions beside those over everything, in one pass over play."""
    newest = sessions.orderBy(F.col("ingested_at").desc(), F.col("session_id").desc()).limit(n).select("session_id")
    marked = hands.where("big_blind > 0").join(newest.withColumn("recent", F.lit(True)), "session_id", "left")
    won = F.try_divide(F.col("won_cents").cast("double"), F.col("big_blind"))
    new = F.coalesce(F.col("recent"), F.lit(False))
    return marked.agg(
        F.round(F.try_divide(F.sum(F.when(new, won)), F.count(F.when(new, 1)).cast("double")) * 100, 2).alias("bb100_recente"),
        F.round(F.avg(F.when(new, F.col("hero_vpip"))) * 100, 1).alias("vpip_recente"),
        F.round(F.sum(won) / N() * 100, 2).alias("bb100_geral"),
        F.round(F.avg("hero_vpip") * 100, 1).alias("vpip_geral"),
    )


def entry_patterns(hands: DataFrame) -> DataFrame:
    return hands.where("big_blind > 0").agg(
        F.round(_pct_of((F.col("hero_vpip") == 1) & (F.col("hero_pfr") == 0)), 1).alias("call_only_pct"),
        F.round(_pct_of(F.coalesce(F.col("hero_action_flop"), F.lit("")) != ""), 1).alias("viu_flop_pct"),
        F.round(_pct_of((F.col("went_to_showdown") == 1) & (F.col("hero_result") == "loss")), 1).alias("wtsd_loss_pct"),
    )


def file_rollup(hands: DataFrame) -> DataFrame:
    return hands.groupBy("source_file").agg(
        N().alias("hands_count"), count_where(F.col("hero_result") == "win").alias("hands_won"), F.sum("won_cents").alias("net_cents")
    )


def seat_profile_deviation(hands: DataFrame, min_hands: int = 10) -> DataFrame:
    t = seat_targets(hands.sparkSession)
    g = hands.groupBy("hero_position").agg(N().alias("n"), F.avg("hero_vpip").alias("v"), F.avg("hero_pfr").alias("p"))
    g = g.where(F.col("n") >= min_hands).join(F.broadcast(t), "hero_position")
    return g.select(
        "hero_position",
        F.round(F.col("v") * 100, 1).alias("vpip_real"), F.round(F.col("target_vpip") * 100, 1).alias("vpip_gto"),
        F.round((F.col("v") - F.col("target_vpip")) * 100, 1).alias("vpip_diff"),
        F.round(F.col("p") * 100, 1).alias("pfr_real"), F.round(F.col("target_pfr") * 100, 1).alias("pfr_gto"),
        F.round((F.col("p") - F.col("target_pfr")) * 100, 1).alias("pfr_diff"),
    )


def dataset_signature(hands: DataFrame, limit: int | None = None, min_hands: int | None = None) -> DataFrame:
    """Cheap fingerprint that changes when rows arrive."""
    return hands.agg(N().alias("n"), F.max("date_utc").alias("latest")).select(
        F.concat_ws(":", F.col("n"), F.date_format("latest", "yyyy-MM-dd HH:mm:ss"), F.lit(str(limit or "all")), F.lit(str(min_hands or "default"))).alias("signature")
    )


def sections(sessions: DataFrame, hands: DataFrame) -> dict[str, DataFrame]:
    """The statistics report: six named sections."""
    return {
        "summary": global_stats(hands),
        "by_position": by_seat(hands),
        "by_m_ratio": by_zone(hands),
        "by_tournament": by_tournament(hands),
        "leaks": findings(hands),
        "session_trend": daily_trend(hands),
    }
