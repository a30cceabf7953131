"""User-editable intervention rules compiled to columns.

Rules are a short list held by the driver (a file or the built-in table). Each becomes one
boolean column, so scoring a row against every rule is a projection: no join, no expansion
of rows by rules.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyfold.functions import fixed_values as fv

Rule = dict


def _text(x: Column) -> Column:
    return F.upper(x.cast("string"))


def condition(df: DataFrame, field: str, spec: dict) -> Column:
    """AND of the operators of one field. A missing or null field never matches; an unknown
    operator is ignored; a comparison that cannot be made counts as false."""
    if field not in df.columns:
        return F.lit(False)
    col = F.col(field)
    numeric = dict(df.dtypes)[field] not in ("string", "boolean")
    out = col.isNotNull()
    for op, want in spec.items():
        if op in ("gt", "lt", "gte", "lte"):
            comparable = isinstance(want, (int, float)) == numeric
            if not comparable:
                return F.lit(False)
            w = F.lit(want)
            test = {"gt": col > w, "lt": col < w, "gte": col >= w, "lte": col <= w}[op]
        elif op == "eq":
            test = _text(col) == str(want).upper()
        elif op == "ne":
            test = _text(col) != str(want).upper()
        elif op == "in":
            test = col.isin(*want)
        elif op == "not_in":
            test = ~col.isin(*want)
        else:
            continue
        out = out & test
    return F.coalesce(out, F.lit(False))


def matches(df: DataFrame, rule: Rule) -> Column:
    out = F.lit(True)
    for field, spec in rule["conditions"].items():
        out = out & condition(df, field, spec)
    return out


def load_rules(spark: SparkSession, path: str | None = None) -> list[Rule]:
    """Rules in priority order from a JSON or YAML file, or from all files of a folder; without a path the built-in ones.

    A file that cannot be read or parsed raises. Only where the YAML library is absent does a YAML file give the
    fallback rules.
    """
    if path is None:
        return sorted(fv.RULES, key=lambda r: r["priority"])
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError:
            return sorted(fv.FALLBACK_RULES, key=lambda r: r["priority"])
        parse = yaml.safe_load
    else:
        parse = json.loads
    texts = [r.value for r in spark.read.text(path, wholetext=True).toLocalIterator()]  # rules are edited by hand
    return sorted((_rule(r) for text in texts for r in parse(text)["rules"]), key=lambda r: r["priority"])


def _rule(r: dict) -> Rule:
    return {
        "name": r["name"], "priority": int(r.get("priority", 99)), "stop": bool(r.get("stop", False)),
        "conditions": r.get("conditions", {}), "reason": r.get("reason", r["name"]),
        "actions": [(a["code"], a.get("channels", ["console"])) if isinstance(a, dict) else tuple(a) for a in r.get("actions", [])],
    }


def rules_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    rows = [
        (i, r["name"], r["priority"], bool(r["stop"]), json.dumps(r["conditions"], sort_keys=True), code, list(ch), r["reason"])
        for i, r in enumerate(rules)
        for code, ch in r["actions"]
    ]
    return spark.createDataFrame(
        rows, "seq int, name string, priority int, stop boolean, conditions string, code string, channels array<string>, reason string"
    )


def evaluate(df: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """Adds triggered_rules and actions: rules after the first matching stop rule are dropped,
    one action per code is kept (lowest priority number, first on ties), in priority order."""
    rules = list(rules if rules is not None else sorted(fv.RULES, key=lambda r: r["priority"]))
    hits = []
    for i, r in enumerate(rules):
        acts = F.array(*[
            F.struct(F.lit(r["priority"]).alias("priority"), F.lit(i * 100 + j).alias("seq"), F.lit(code).alias("code"),
                     F.lit(r["reason"]).alias("reason"), F.array(*[F.lit(x) for x in ch]).alias("channels"))
            for j, (code, ch) in enumerate(r["actions"])
        ])
        hits.append(F.when(matches(df, r), F.struct(F.lit(i).alias("i"), F.lit(r["name"]).alias("name"), F.lit(bool(r["stop"])).alias("stop"), acts.alias("acts"))))
    out = df.withColumn("_hits", F.array_compact(F.array(*hits)))
    first_stop = F.array_min(F.transform(F.filter("_hits", lambda h: h["stop"]), lambda h: h["i"]))
    out = out.withColumn("_cut", F.coalesce(first_stop, F.lit(len(rules))))
    out = out.withColumn("_kept", F.filter("_hits", lambda h: h["i"] <= F.col("_cut")))
    out = out.withColumn("_acts", F.array_sort(F.flatten(F.transform("_kept", lambda h: h["acts"]))))
    first = F.filter(
        F.col("_acts"),
        lambda a: ~F.exists(F.col("_acts"), lambda b: (b["code"] == a["code"]) & ((b["priority"] < a["priority"]) | ((b["priority"] == a["priority"]) & (b["seq"] < a["seq"])))),
    )
    out = out.withColumn("triggered_rules", F.transform("_kept", lambda h: h["name"])).withColumn("actions", first)
    mono = (F.size("actions") == 1) & (F.element_at("actions", 1)["code"] == "MONITOR_ONLY")
    return out.withColumn("monitor_only", F.when(F.size("actions") == 0, False).otherwise(F.coalesce(mono, F.lit(False)))).drop("_hits", "_cut", "_kept", "_acts")
