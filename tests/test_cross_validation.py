"""Cross-validation reads its rows from what was written once."""

from pyspark.sql import functions as F

from tallyfold.plans import models as md


def test_folds_do_not_repeat_what_is_behind_the_rows(spark, monkeypatch):
    """Every fold ran the joins behind the rows again, in as many tasks as a shuffle has partitions for each step of each fit."""
    seen = []
    fit = md.CrossValidator.fit
    monkeypatch.setattr(md.CrossValidator, "fit", lambda self, d, *a: seen.append(d) or fit(self, d, *a))
    n = F.xxhash64("id") % 7
    d = spark.range(90).withColumns({"a": n.cast("double"), "y": (n > 0).cast("int")}).join(spark.range(90).withColumn("b", F.col("id") % 5), "id")
    auc = md.cross_validated(d, ["a", "b", "missing"], "y")
    assert len(auc) == 2 and all(0.5 <= x <= 1 for x in auc)
    assert "Join" not in seen[0]._jdf.queryExecution().optimizedPlan().toString() and seen[0].count() == 90
    assert seen[0].columns == ["y", "a", "b", "missing"]
