from skein.plans import registry as R


def test_answered_keeps_all_conditions(spark, monkeypatch):
    long = "\n".join(f"line {k}" for k in range(1500))
    turns = spark.createDataFrame([("1-0", 1, 0, long, long), ("1-1", 1, 1, "one", None)], "id string, conv_id int, turn int, ref string, pred string")
    monkeypatch.setattr(R, "turns", lambda spark, sf_dir: turns)
    found = {r["id"]: r for r in R.answered(spark, "").collect()}
    assert found["1-0"]["p_conditions"] == found["1-0"]["conditions"] == long.split("\n")[1:]
    assert found["1-1"]["conditions"] == [] and found["1-1"]["p_conditions"] is None
