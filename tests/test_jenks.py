import itertools
import math

import pytest

from dunegrid.operators import jenks


def brute_force(values, k):
    """Optimal partition of sorted distinct values (with multiplicity) into k
    contiguous classes; returns (ssd, upper bounds)."""
    xs = sorted(values)
    distinct = sorted(set(xs))
    best = (math.inf, None)
    for cuts in itertools.combinations(range(1, len(distinct)), k - 1):
        bounds = [0, *cuts, len(distinct)]
        ssd = 0.0
        for a, b in zip(bounds, bounds[1:]):
            group = [x for x in xs if distinct[a] <= x <= distinct[b - 1]]
            m = sum(group) / len(group)
            ssd += sum((x - m) ** 2 for x in group)
        if ssd < best[0] - 1e-9:
            best = (ssd, [distinct[b - 1] for b in bounds[1:]])
    return best


def _df(spark, values):
    return spark.createDataFrame([(float(v),) for v in values], "v double")


def test_golden_13_values(spark):
    vals = [4, 5, 9, 10, 11, 20, 22, 30, 31, 50, 51, 52, 70]
    assert jenks.jenks_breaks(_df(spark, vals), "v", 4) == [4, 11, 31, 52, 70]
    ssd, ub = brute_force(vals, 4)
    assert ub == [11, 31, 52, 70] and round(ssd, 2) == 133.55


def test_zero_rule_and_compat(spark):
    df = _df(spark, [1, 100, 101])
    assert jenks.jenks_breaks(df, "v", 2) == [0.0, 1.0, 101.0]
    assert jenks.jenks_breaks(df, "v", 2, compat_first_class=True) == [1.0, 100.0, 101.0]


@pytest.mark.parametrize("values,k", [([], 2), ([1, 2, 3], 1), ([1, 1, 2], 3)])
def test_errors(spark, values, k):
    with pytest.raises(ValueError):
        jenks.jenks_breaks(_df(spark, values) if values else spark.createDataFrame([], "v double"), "v", k)


def test_matches_brute_force_small_splits(spark):
    """Force the divide-and-conquer path with tiny leaf boxes."""
    import random
    rnd = random.Random(3)
    for trial in range(2):
        vals = [rnd.randint(0, 60) for _ in range(40)]
        k = 3 + trial
        got = jenks.jenks_breaks(_df(spark, vals), "v", k, leaf_pairs=40, fanout=3, chunk=4)
        exp = jenks.jenks_breaks(_df(spark, vals), "v", k)
        ssd, ub = brute_force(vals, k)
        assert got == exp
        assert got[1:] == ub


@pytest.mark.parametrize("leaf_pairs", [1 << 24, 4])
def test_breaks_by_group_against_brute_force(spark, leaf_pairs):
    """All groups in the same jobs; small groups, one value, no value, NULL keys."""
    import random

    rng = random.Random(leaf_pairs)
    groups = {("a", 1): [rng.randrange(60) for _ in range(40)], ("a", 2): [rng.randrange(1000) for _ in range(14)],
              ("b", 1): [5, 5, 9], ("b", 2): [7, 7, 7], (None, 1): [1, 100, 101, 1, 50, 51], ("c", None): [0.5, 2.25, 8, 9.75]}
    rows = [(a, b, float(v), "x") for (a, b), vs in groups.items() for v in vs] + [("n", 1, None, "x"), ("a", 1, None, "x")]
    df = spark.createDataFrame(rows, "a string, b int, v double, value string").repartition(3)
    got = {}
    for r in sorted(jenks.jenks_breaks_by(df, "v", 3, ["a", "b"], leaf_pairs=leaf_pairs, chunk=4, fanout=3).collect(),
                    key=lambda r: r.break_index):
        got.setdefault((r.a, r.b), []).append(r.break_value)
    assert set(got) == set(groups)
    for key, vs in groups.items():
        k = min(3, len(set(vs)))
        breaks = got[key]
        assert len(breaks) == k + 1 and breaks[-1] == max(vs)
        assert breaks[0] == (0.0 if breaks[1] == min(vs) else min(vs))
        best, _ = brute_force(vs, k)
        ssd, low = 0.0, -math.inf
        for high in breaks[1:]:
            part = [v for v in vs if low < v <= high]
            ssd += sum((v - sum(part) / len(part)) ** 2 for v in part)
            low = high
        assert math.isclose(ssd, best, abs_tol=1e-6)
    assert jenks.jenks_breaks_by(df.limit(0), "v", 3, ["a"]).collect() == []
