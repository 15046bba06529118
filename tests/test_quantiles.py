import math

import numpy as np
import pytest

from rubrica.operators.quantiles import nearest_rank


def ranked(values, share):
    """Sorted with NaN last, by rank."""
    own = sorted((v for v in values if v is not None), key=lambda v: (math.isnan(v), 0.0 if math.isnan(v) else v))
    return own[max(1, math.ceil(share * len(own))) - 1]


@pytest.mark.parametrize("share", [0.0, 0.5, 0.95, 1.0])
def test_ranks_of_all_kinds_of_groups(spark, share):
    rng = np.random.default_rng(2)
    groups = {
        "one": [3.5],
        "ties": [1.0] * 50 + [2.0] * 3,
        "hot": rng.normal(0, 1, 4000).tolist(),
        "outlier": [*rng.random(500).tolist(), 1e300, -1e300, 1.7e308, -1.7e308],
        "odd": [math.nan, math.inf, -math.inf, 0.0, 5.0, math.nan],
        "endless": [math.inf, -math.inf],
        "nulls": [None, None, 4.0],
    }
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("none", None)], "g string, v double")
    out = {r.g: (r.p, r.n) for r in nearest_rank(df, ["g"], "v", share).collect()}
    assert set(out) == set(groups)
    for g, values in groups.items():
        want = ranked(values, share)
        assert out[g][1] == sum(v is not None for v in values)
        assert out[g][0] == want or (math.isnan(out[g][0]) and math.isnan(want)), (g, out[g], want)


def test_whole_numbers_and_an_empty_table(spark):
    df = spark.range(2001).selectExpr("'a' AS g", "9007199254740992 + id AS v")
    assert nearest_rank(df, ["g"], "v", 0.5).first().p == 9007199254740992 + 1000
    assert nearest_rank(df.limit(0), ["g"], "v", 0.5).count() == 0
