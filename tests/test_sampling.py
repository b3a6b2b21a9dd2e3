import hashlib
import random

from skein.operators import sampling as S


def _first(rows, shares):
    """The first rows of each stratum by their draws, all of a stratum at once."""
    out = []
    for stratum, share in shares.items():
        mine = sorted((hashlib.md5(f"1:{k}".encode()).hexdigest(), k) for k, s in rows if s == stratum)
        out += [(k, stratum) for _, k in mine[:share]]
    return sorted(out)


def test_shares_of_hot_and_small_strata(spark):
    draw = random.Random(3)
    rows = [(k, "hot" if k % 3 else draw.choice(["a", "b", "c"])) for k in range(9000)]
    df = spark.createDataFrame(rows, "id long, s string").repartition(7)
    for shares in ({"hot": 1234, "a": 1, "b": 0}, {"hot": 6000, "a": 10**9, "c": 17}):
        given = spark.createDataFrame(list(shares.items()), "s string, _share long")
        assert sorted(map(tuple, S.first_drawn(df, "s", given, "id").collect())) == _first(rows, shares)


def test_stratified_brings_no_stratum_together(spark):
    rows = [(k, "hot" if k % 9 else "cold") for k in range(20000)]
    found = S.stratified(spark.createDataFrame(rows, "id long, s string"), "s", 900, "id")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert all("_part" in line for line in plan.split("\n") if "row_number()" in line)
    assert sorted(map(tuple, found.collect())) == _first(rows, {"hot": 799, "cold": 100})


def test_large_groups_are_cut_before_they_meet(spark):
    rows = [(k, "hot") for k in range(5000)] + [(k, f"g{k % 40}") for k in range(5000, 5700)] + [(k, "few") for k in range(5700, 5719)]
    found = S.retain(spark.createDataFrame(rows, "id long, s string").repartition(5), "s", "id")
    assert "WindowGroupLimit" in found._jdf.queryExecution().optimizedPlan().toString()
    sizes = {}
    for _, s in rows:
        sizes[s] = sizes.get(s, 0) + 1
    assert sorted(map(tuple, found.collect())) == _first(rows, {s: n if n < 20 else 5 for s, n in sizes.items()})
