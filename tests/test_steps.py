"""Steps put on DataFrames."""

from tideview.sources.snapshots import Step, apply_steps


def test_rows_of_the_only_step_are_not_compared_with_keys_it_removes(spark):
    stored = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, v string")
    step = Step(stored.where("k = 2 or k is null").select("k").union(stored.where("k = 2").select("k")), stored.where("k = 2"))
    out = apply_steps(stored, [step], ["k"])
    assert sorted(map(tuple, out.collect()), key=str) == [(1, "a"), (2, "b")]
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "Aggregate" not in plan and plan.index("Union") < plan.index("LeftAnti")
