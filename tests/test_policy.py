"""Rules, recommendations, interventions and the portfolio report on small hand-made rows."""

import json

import pytest
from pyspark.sql import functions as F

from tallyfold.functions import fixed_values as fv
from tallyfold.operators import policy
from tallyfold.plans import accounts as ac

CTX = ("account_id long, churn_risk double, mrr double, upsell_probability double, nps_score double, segment string, dias_sem_interacao int, "
       "dias_no_contrato int, trend_delta double, risk_level string")


def ctx(spark, **over):
    base = {"account_id": 1, "churn_risk": 0.1, "mrr": 1000.0, "upsell_probability": 0.1, "nps_score": 7.0, "segment": "SMB", "dias_sem_interacao": 1, "dias_no_contrato": 90, "trend_delta": None, "risk_level": "LOW"}
    base.update(over)
    return spark.createDataFrame([tuple(base.values())], CTX)


def codes(spark, **over):
    r = policy.evaluate(ctx(spark, **over)).first()
    return [a["code"] for a in r["actions"]], r["triggered_rules"], r["monitor_only"]


def test_stop_rule_cuts_the_rest(spark):
    c, rules, _ = codes(spark, churn_risk=0.9, mrr=9000.0)
    assert rules == ["critical_high_mrr"] and c == ["ESCALATE_TO_MANAGER", "SEND_SLACK_ALERT", "SEND_EMAIL"]


def test_actions_are_deduplicated_by_priority(spark):
    c, rules, _ = codes(spark, churn_risk=0.9, mrr=1000.0)
    assert rules[:2] == ["critical_any_mrr", "high_risk_action"] and c.count("CREATE_CRM_TASK") == 1
    assert c[:3] == ["ESCALATE_TO_MANAGER", "CREATE_CRM_TASK", "SCHEDULE_CALL"]


def test_null_field_does_not_match(spark):
    assert "sharp_score_drop" not in codes(spark)[1]
    assert "sharp_score_drop" in codes(spark, trend_delta=-6.0)[1]


def test_healthy_account_is_only_monitored(spark):
    assert codes(spark) == (["MONITOR_ONLY"], ["healthy_monitor"], True)


@pytest.mark.parametrize("spec,value,want", [
    ({"gt": 5}, 6, True), ({"gt": 5}, 5, False), ({"gte": 5}, 5, True), ({"lt": 5}, 4, True), ({"lte": 5}, 5, True), ({"gt": 1, "lt": 3}, 2, True), ({"gt": 1, "lt": 3}, 3, False),
    ({"bogus": 1}, 2, True), ({"gt": "x"}, 2, False), ({"in": [1, 2]}, 2, True), ({"not_in": [1, 2]}, 2, False), ({"gt": 1}, None, False), ({"not_in": [1]}, None, False),
])
def test_operators(spark, spec, value, want):
    d = spark.createDataFrame([(value,)], "x int")
    assert d.select(policy.condition(d, "x", spec).alias("b")).first()["b"] is want


def test_text_equality_ignores_case(spark):
    d = spark.createDataFrame([("enterprise",)], "s string")
    assert d.select(policy.condition(d, "s", {"eq": "ENTERPRISE"}).alias("a"), policy.condition(d, "s", {"ne": "ENTERPRISE"}).alias("b"), policy.condition(d, "t", {"eq": 1}).alias("c")).first()[:] == (True, False, False)


def test_rule_file_and_fallback(spark, tmp_path):
    p = tmp_path / "rules.json"
    p.write_text(json.dumps({"rules": [{"name": "b", "priority": 2, "actions": [{"code": "X"}]}, {"name": "a", "priority": 1, "conditions": {"mrr": {"gt": 1}}, "actions": [{"code": "Y", "channels": ["file"]}]}]}))
    assert [r["name"] for r in policy.load_rules(spark, str(p))] == ["a", "b"]
    (tmp_path / "more").mkdir()
    for n in "cd":  # a folder is read whole
        (tmp_path / "more" / f"{n}.json").write_text(json.dumps({"rules": [{"name": n}]}))
    assert sorted(r["name"] for r in policy.load_rules(spark, str(tmp_path / "more"))) == ["c", "d"]


@pytest.mark.parametrize("text", [None, "{", '{"rules": [{"priority": 1}]}'])
def test_a_bad_rule_file_raises(spark, tmp_path, text):
    if text:
        (tmp_path / "r.json").write_text(text)
    with pytest.raises(Exception):
        policy.load_rules(spark, str(tmp_path / "r.json"))


def test_yaml_rules(spark, tmp_path):
    (tmp_path / "r.yaml").write_text("rules:\n- name: b\n  priority: 2\n- name: a\n  priority: 1\n  conditions: {mrr: {gt: 1}}\n  actions:\n  - {code: X, channels: [file]}\n")
    got = policy.load_rules(spark, str(tmp_path / "r.yaml"))
    try:
        import yaml  # noqa: F401
    except ImportError:
        assert [r["name"] for r in got] == [r["name"] for r in fv.FALLBACK_RULES]
    else:
        assert [(r["name"], r["actions"]) for r in got] == [("a", [("X", ["file"])]), ("b", [])]


@pytest.mark.parametrize("risk,up,want", [
    (0.8, 0.0, ["ESCALATE", "SCHEDULE_CALL", "SEND_DISCOUNT"]), (0.5, 0.9, ["SCHEDULE_CALL", "SCHEDULE_QBR", "SEND_SURVEY"]),
    (0.1, 0.9, ["PROPOSE_UPSELL", "SHARE_ROADMAP", "SEND_CONTENT", "TRACK_ENGAGEMENT"]), (0.1, 0.1, ["SEND_CONTENT", "TRACK_ENGAGEMENT"]), (0.70, 0.0, ["SCHEDULE_CALL", "SCHEDULE_QBR", "SEND_SURVEY"]),
])
def test_recommendations(spark, risk, up, want):
    assert spark.range(1).select(ac.recommended_actions(F.lit(risk), F.lit(up)).alias("a")).first()["a"] == want


def test_console_is_always_used(spark):
    rules = [{"name": "r", "priority": 1, "stop": False, "conditions": {"churn_risk": {"gt": 0.0}}, "actions": [("SEND_EMAIL", ["email"]), ("SEND_SLACK_ALERT", ["slack"])], "reason": "same"}]
    r = ac.interventions(ctx(spark), rules).first()
    assert r["channels_used"] == ["console", "email", "slack"] and r["reasons"] == ["same"] and r["dispatched"] == 4


def test_portfolio_report(spark):
    p = spark.createDataFrame([(1, "ENTERPRISE", 600000, 90, "HIGH"), (2, "SMB", 100000, 80, "HIGH"), (3, "SMB", 200000, 50, "MEDIUM"), (4, "", 300000, 10, "LOW"), (5, "SMB", 400000, 5, "LOW")], "account_id long, segment string, mrr_cents long, risk_pct int, risk_level string")
    p = p.withColumn("mrr_at_risk_pc", F.col("mrr_cents") * F.col("risk_pct"))
    r = spark.createDataFrame([(1, 1, ["ESCALATE", "SEND_EMAIL"]), (2, 2, ["MONITOR_ONLY"]), (3, 3, []), (4, 4, ["MONITOR_ONLY"])], "record_id long, account_id long, actions_taken array<string>")
    k = ac.portfolio_kpis(p, r).first()
    assert (k["total_accounts"], k["accounts_at_risk"], k["critical_accounts"], k["recoverable_accounts"], k["safe_accounts"]) == (5, 2, 1, 1, 2)
    assert k["mrr_preserved_pc"] == 600000 * 90 + 200000 * 50  # an empty action list counts as acted
    assert {x["account_id"]: x["top_action"] for x in ac.top_risk_accounts(p, r).collect()} == {1: "ESCALATE", 2: "MONITOR_ONLY"}
    assert {x["segment"]: x["total"] for x in ac.segment_breakdown(p).collect()} == {"ENTERPRISE": 1, "SMB": 3, "UNKNOWN": 1}
    text = ac.executive_summary(ac.portfolio_kpis(p, r), ac.counts_of(r, "actions_taken", "action")).first()[0]
    assert text.startswith("No período analisado, 5 contas foram avaliadas. 2 (40.0%) estão em risco alto") and "A ação mais frequente foi: MONITOR_ONLY." in text


def test_trend_labels(spark):
    got = [spark.range(1).select(ac.trend_label(F.lit(v)).alias("t")).first()["t"] for v in (0.25, -0.25, 0.05)]
    assert got == ["↑ subindo (+25%)", "↓ caindo (-25%)", "→ estável (+5%)"]
