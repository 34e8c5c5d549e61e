"""Hand-computed series, and window forms against the steps."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tickgraph.errors import InvalidArgument
from tickgraph.operators import nodes as N
from tickgraph.operators import steps as S
from tickgraph.operators import timeseries as T
from tickgraph.operators.folds import fold_list
from tickgraph.operators.policies import AlwaysChanged, Epsilon, Predicate, TypedEquality
from tickgraph.plans.graph import Graph

close = lambda xs: pytest.approx(xs, abs=1e-5)


def test_zscore_and_gate_series():
    z = fold_list(S.ZScoreStep(5), [1, 2, 3, 4, 5, 6, 7, 100, 8, 9])
    assert z == close([0, 0, 2.12132, 2, 1.936492, 1.897367, 1.897367, 60.083276, -0.387923, -0.387287])
    gate = fold_list(S.OutlierGateStep(5, 2.5), [10, 11, 10.5, 9.8, 10.2, 9.9, 150, 10.1, 10.3])
    assert gate == close([10, 11, 10.5, 9.8, 10.2, 9.9, 38.08, 10.1, 10.3])


def test_recurrent_series():
    assert fold_list(S.EwmaStep(0.3), [0, 10, 0, 5]) == close([0, 3, 2.1, 2.97])
    assert fold_list(S.RateLimiterStep(2), [0, 0.5, 1, 1.5, 2, 2.3, 2.5, 4, 4.1]) == close([0, 0, 0, 0, 2, 2, 2, 4, 4])
    assert fold_list(S.TickRateStep(0.5), list(range(10))) == close([1 - 0.5**n for n in range(1, 11)])
    assert fold_list(S.RollingSumStep(4), [1e16, *range(1, 21)])[-1] == 74
    assert fold_list(S.RollingMinMaxStep(4), [5, 3, 8, 1, 7, 4, 9, 2]) == list(zip([5, 3, 3, 1, 1, 1, 1, 2], [5, 5, 8, 8, 8, 8, 9, 9], strict=True))
    assert fold_list(S.DeltaStep(), [5, 3, 8, 1, 7, 4, 9, 2]) == [0, -2, 5, -7, 6, -3, 5, -7]


def test_debounce_series():
    up = fold_list(S.ThresholdStep(50, hysteresis=2), [10, 20, 80, 20, 30, 55, 60, 65, 40, 55, 60, 65, 70])
    assert [k for k, v in enumerate(fold_list(S.DebounceStep(3), up)) if v] == [7, 11, 12]
    n, t, f = None, True, False
    assert fold_list(S.LatchedDebounceStep(2), [f, t, t, t, t, f, f, f]) == [n, n, t, n, n, f, n, n]
    assert all(fold_list(S.DebounceStep(0), [f, t, f]))


def test_time_delay_series():
    us = lambda rows: [(v, int(t * 1e6)) for t, v in rows]
    assert fold_list(S.TimeDelayStep(1_000_000), us([(0, 100), (0.4, 101), (0.9, 102), (1.2, 103)])) == [None, None, None, 100]
    assert fold_list(S.TimeDelayStep(5_000_000), us([(0, 100), (2, 110), (6, 120), (8, 130), (12, 140)])) == [None, None, 100, 110, 120]
    assert fold_list(S.TimeDelayStep(1_000_000), us([(0, 100), (40, 105), (41, 105)])) == [None, 100, 105]


def test_parameters_are_checked():
    x = N.Source("x", "v")
    for alpha in (0, -1, 1.5):
        with pytest.raises(InvalidArgument, match="level"):
            T.Ewma("level", x, alpha)
        with pytest.raises(InvalidArgument, match="rate"):
            T.EwmaTickRate("rate", x, alpha)
    T.Ewma("level", x, 1.0)
    for make in (T.RollingStats, T.RollingSum, T.RollingMinMax, T.WindowNode, T.ZScore):
        with pytest.raises(InvalidArgument):
            make("w", x, 0)


def rows_of(repeats: bool):
    rng = random.Random(11)
    values = [0.0, 1.0, 5.0, 20.0, 60.0]
    out = []
    for key in range(4):
        for seq in range(1, 60):
            v = rng.choice(values) if repeats else rng.uniform(0, 100)
            out.append((key, seq, v, seq * 700_000 + key))
    return out


def nodes_over(x, t):
    th = T.Threshold("th", x, 40.0, hysteresis=10.0)
    return [
        T.RollingStats("stats", x, 7), T.RollingSum("sum", x, 5), T.Ewma("ewma", x, 0.3), T.Ewma("fast", x, 0.97), T.Ewma("copy", x, 1.0), T.EwmaTickRate("rate", x, 0.2),
        T.Delta("delta", x), T.Delay("delay", x, 3, -1.0), T.Delay("nodelay", x, 0), T.TimeDelay("old", x, t, 2_000_000), th, T.Threshold("below", x, 10.0, below=True, hysteresis=3.0),
        T.Threshold("toggle", x, 40.0, hysteresis=-20.0), T.ZScore("z", x, 6), T.OutlierGate("gate", x, 6, 1.2), T.RateLimiter("limit", x, 15.0),
        T.DebounceCount("deb", th, 2), T.LatchedDebounce("latch", th, 2), T.WindowNode("win", x, 4),
    ]


@pytest.mark.parametrize("policy", [AlwaysChanged(), TypedEquality()])
def test_window_forms_equal_the_steps(spark, policy):
    rows = rows_of(repeats=not policy.always)
    df = spark.createDataFrame(rows, "k int, s long, v double, t long").repartition(3)
    x, t = N.Source("x", "v", policy), N.Source("t", "t", AlwaysChanged(), kind="long")
    if not policy.always:
        t = x  # time delay has two inputs; it is tested with every row a tick
    made = [n for n in nodes_over(x, t) if policy.always or n.name != "old"]
    compiled = Graph(df, "k", "s").compile(*made)
    got = {(r["k"], r["s"]): r for r in compiled.df.collect()}
    for key in range(4):
        own = [r for r in rows if r[0] == key]
        th = S.ThresholdStep(40.0, hysteresis=10.0)
        states = {n.name: (n.step(), None) for n in made}
        kept = {n.name: n.step().start() for n in made}
        held, up, th_state, last = {}, False, th.start(), None
        for k, (_, seq, v, ts) in enumerate(own):
            tick = policy.always or k == 0 or v != last
            last = v
            if tick:
                up = th.step(th_state, v)
                for n in made:
                    arg = up if n.name in ("deb", "latch") else (v, ts) if n.name == "old" else v
                    held[n.name] = states[n.name][0].step(kept[n.name], arg)
            row = got[key, seq]
            for n in made:
                want, have = held[n.name], row[n.name]
                if isinstance(want, float):
                    assert have == pytest.approx(want, abs=1e-9), (n.name, key, seq)
                else:
                    assert (list(have) if n.name == "win" else have) == want, (n.name, key, seq)


def test_policies_and_changes(spark):
    values = [1.0, 1.0, float("nan"), float("nan"), 1.4, 1.9, 3.0, 2.6, None, 2.6]
    df = spark.createDataFrame([(1, k, v) for k, v in enumerate(values, 1)], "k int, s long, v double")
    typed = N.Source("typed", "v", TypedEquality())
    seen = Graph(df, "k", "s").compile(typed)
    ticks = [r["s"] for r in seen.df.where("typed__tick").orderBy("s").collect()]
    assert ticks == [1, 3, 4, 5, 6, 7, 8]
    clean = df.where("not isnan(v)")
    eps = N.Source("eps", "v", Epsilon(0.5))
    assert [r["eps"] for r in Graph(clean, "k", "s").compile(eps).df.orderBy("s").collect()] == [1.0, 1.0, 1.0, 1.9, 3.0, 3.0, 3.0, 3.0]
    pred = N.Source("pred", "v", Predicate(lambda a, b: int(a) == int(b)))
    compiled = Graph(clean, "k", "s").compile(pred)
    assert [r["pred"] for r in compiled.changes(pred).orderBy("s").collect()] == [1.0, 3.0, 2.6]


def test_eager_nodes_advance_under_a_still_bool(spark):
    df = spark.createDataFrame([(1, k, v) for k, v in enumerate([50.0, 60.0, 70.0, 70.0, 80.0], 1)], "k int, s long, v double")
    node = T.DebounceCount("deb", T.Threshold("th", N.Source("x", "v"), 40.0), 4)
    got = [r["deb"] for r in Graph(df, "k", "s").compile(node).df.orderBy("s").collect()]
    assert got == [False, False, False, False, True]


def test_ieee_operators(spark):
    ops = N.scalar.OPS
    row = spark.range(1).select(
        *[ops["divide"].value(F.lit(a), F.lit(b)).alias(f"d{k}") for k, (a, b) in enumerate([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (1.0, -0.0)])],
        *[ops["ln"].value(F.lit(a)).alias(f"l{k}") for k, a in enumerate([1.0, 0.0, -1.0, float("nan")])],
        ops["sqrt"].value(F.lit(-1.0)).alias("s"), ops["asin"].value(F.lit(2.0)).alias("a"), ops["power"].value(F.lit(-8.0), F.lit(1 / 3)).alias("p"),
        ops["exp"].value(F.lit(1000.0)).alias("e"), ops["sum"].value().alias("none"), ops["product"].value().alias("one"), ops["tan"].value(F.lit(math.pi / 2)).alias("t"),
    ).first()
    inf = float("inf")
    assert row[:2] == (inf, -inf) and math.isnan(row[2]) and row[3] == -inf
    assert row[4:6] == (0.0, -inf) and math.isnan(row[6]) and math.isnan(row[7])
    assert math.isnan(row["s"]) and math.isnan(row["a"]) and math.isnan(row["p"]) and row["e"] == inf
    assert row["none"] == 0.0 and row["one"] == 1.0 and row["t"] == pytest.approx(1.633123935319537e16, rel=1e-3)


def test_erf(spark):
    from tickgraph.functions import ieee

    xs = [0.0, 0.1, -0.7, 1.3, 2.4, 2.6, -3.5, 6.0]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", ieee.erf("x").alias("a"), ieee.erfc("x").alias("b")).collect()
    for r in rows:
        assert r["a"] == pytest.approx(math.erf(r["x"]), abs=2e-15, rel=1e-13)
        assert r["b"] == pytest.approx(math.erfc(r["x"]), rel=1e-9)
