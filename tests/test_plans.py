"""Derivatives, reductions, graphs, feeds, state, streaming and golden rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickgraph.errors import DomainError, InvalidArgument, LogicError, StateError
from tickgraph.functions import dual
from tickgraph.operators import nodes as N
from tickgraph.operators import timeseries as T
from tickgraph.operators.policies import AlwaysChanged
from tickgraph.operators.steps import RateLimiterStep
from tickgraph.plans import aad, graph, reduction
from tickgraph.sources import feeds, state
from tickgraph.streaming.run import replay_stream

ALWAYS = AlwaysChanged()


def point(spark, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(f"in_{k}", F.lit(float(v)))
    return df, {k: N.Source(k, f"in_{k}", ALWAYS) for k in values}


def add(df, *outputs):
    for n in graph.topological(outputs):
        df = df.withColumn(n.name, F.col(n.source) if isinstance(n, N.Source) else n.apply(*[i.column for i in n.inputs]))
    return df


def op(name, kind, *inputs):
    return N.OpNode(name, kind, *inputs)


def black_scholes(s):
    half = N.Constant("half", 0.5)
    growth = op("growth", "sum", s["rate"], op("halfvar", "product", half, s["vol"], s["vol"]))
    dev = op("dev", "product", s["vol"], op("roott", "sqrt", s["expiry"]))
    d1 = op("d1", "divide", op("num", "sum", op("lm", "ln", op("m", "divide", s["spot"], s["strike"])), op("gt", "product", growth, s["expiry"])), dev)
    d2 = op("d2", "diff", d1, dev)
    cdf = lambda x: 0.5 * (1.0 + dual.erf(x * (1 / math.sqrt(2))))
    n1, n2 = N.DifferentiableNode("n1", [d1], cdf, eager=False), N.DifferentiableNode("n2", [d2], cdf, eager=False)
    disc = op("disc", "exp", op("neg", "negate", op("rt", "product", s["rate"], s["expiry"])))
    return op("price", "diff", op("a", "product", s["spot"], n1), op("b", "product", s["strike"], disc, n2))


BS = {"spot": 100, "strike": 95, "vol": 0.25, "expiry": 0.75, "rate": 0.03}


def test_black_scholes_gradient(spark):
    df, s = point(spark, **BS)
    price = black_scholes(s)
    by = aad.adjoints(price, list(s.values()))
    row = add(df, price).select(price.column.alias("p"), *[c.alias(f"g{k}") for k, c in enumerate(by)]).first()
    assert row["p"] == pytest.approx(12.346868637516806, rel=1e-13)
    want = [0.6733165618068093, -0.5787872372964645, 31.23532891424142, 6.855431778668494, 41.2385906573731]
    assert [row[f"g{k}"] for k in range(5)] == pytest.approx(want, rel=1e-12)


def test_newton_on_a_reduction(spark):
    df, s = point(spark, x=1.0)
    f = reduction.Reduction(op("r", "sum", op("e", "exp", s["x"]), s["x"]), [s["x"]])
    row = df.select(reduction.newton(f, 3.0, 0.5, 7).alias("x")).first()
    assert math.exp(row["x"]) + row["x"] == pytest.approx(3.0, abs=1e-12)


def test_analytic_gradients(spark):
    x, y, z = 3.5, 1.25, 1.8
    d = x - y
    cases = [
        (lambda s: op("r", "sum", op("a", "product", s["x"], s["y"]), op("b", "divide", op("c", "exp", s["x"]), s["y"])), [y + math.exp(x) / y, x - math.exp(x) / y**2, 0]),
        (lambda s: op("r", "product", op("a", "ln", s["x"]), op("b", "sqrt", s["y"])), [math.sqrt(y) / x, math.log(x) / (2 * math.sqrt(y)), 0]),
        (lambda s: op("r", "power", op("a", "diff", s["x"], s["y"]), s["z"]), [z * d ** (z - 1), -z * d ** (z - 1), d**z * math.log(d)]),
        (lambda s: op("r", "atan2", op("a", "product", s["x"], op("b", "sin", s["y"])), op("c", "product", s["x"], op("e", "cos", s["y"]))), [0, 1, 0]),
        (lambda s: op("r", "sum", op("a", "tan", op("b", "divide", s["y"], s["x"])), op("c", "atan", s["z"])), [-(1 + math.tan(y / x) ** 2) * y / x**2, (1 + math.tan(y / x) ** 2) / x, 1 / (1 + z * z)]),
    ]
    for make, want in cases:
        df, s = point(spark, x=x, y=y, z=z)
        root = make(s)
        row = add(df, root, *s.values()).select(*aad.adjoints(root, list(s.values()))).first()
        assert list(row) == pytest.approx(want, rel=1e-12, abs=1e-12)


def test_zero_rules_and_barriers(spark):
    df, s = point(spark, x=0.0, y=3.0, z=4.0)
    product = op("p", "product", s["x"], s["y"], s["z"])
    root = op("r", "product", s["x"], op("q", "sqrt", s["x"]))
    zero = op("k", "product", N.Constant("n", 0.0), root.inputs[1])
    row = add(df, product, root, zero).select(*aad.adjoints(product, list(s.values())), aad.adjoints(zero, [s["x"]])[0]).first()
    assert list(row) == [12.0, 0.0, 0.0, 0.0]
    opaque = N.ComputeNode("opaque", [s["x"]], lambda v: v * 2)
    with pytest.raises(DomainError, match="opaque"):
        aad.adjoints(op("s", "sum", opaque, s["y"]), [s["x"]])
    with pytest.raises(DomainError, match="opaque"):
        aad.tangents([op("s", "sum", opaque, s["y"])], [(s["x"], 1.0)])
    with pytest.raises(DomainError, match="opaque"):
        reduction.Reduction(op("s", "sum", opaque, s["y"]), [s["x"]])
    with pytest.raises(InvalidArgument):
        aad.GradientNode("g", product, [])
    with pytest.raises(InvalidArgument):
        reduction.Reduction(product, [s["x"], s["x"]])
    two = reduction.Reduction([product, root], [s["x"]])
    with pytest.raises(LogicError):
        two.gradient(F.lit(1.0))


def test_stateful_reduction(spark):
    rows = [(1, k, v) for k, v in enumerate([1.0, 1.1, 0.9, 1.05, 0.95, 1.02], 1)]
    df = spark.createDataFrame(rows, "k int, s long, v double")
    x = N.Source("x", "v", ALWAYS)
    nodes = [T.Ewma("e", x, 0.25), T.RollingStats("m", x, 4), T.RollingSum("t", x, 3), T.ZScore("z", x, 8), T.OutlierGate("o", x, 8, 2.0)]
    f = reduction.Reduction(nodes, [x])
    compiled = graph.Graph(df, "k", "s").compile(*nodes)
    row = compiled.df.where("s = 6").select(*[c.alias(f"c{k}") for k, c in enumerate(f(F.lit(50.0)))], F.col("o__prev_sd").alias("sd")).first()
    past = [1.0, 1.1, 0.9, 1.05, 0.95]
    e = past[0]
    for v in past[1:]:
        e = 0.25 * v + 0.75 * e
    want = [0.25 * 50 + 0.75 * e, (sum(past[-3:]) + 50) / 4, sum(past[-2:]) + 50, (50 - np.mean(past)) / np.std(past, ddof=1), (sum(past) + 50) / 6]
    assert list(row)[:5] == pytest.approx(want, rel=1e-12)


def test_line_fit_and_jacobian(spark):
    df, s = point(spark, y1=2.0, y2=5.0, y3=11.0)
    slope, intercept = N.Constant("slope", 0.0), N.Constant("intercept", 0.0)
    roots = [op(f"r{k}", "diff", op(f"l{k}", "sum", op(f"p{k}", "product", slope, N.Constant(f"t{k}", t)), intercept), s[f"y{k}"]) for k, t in ((1, 1.0), (2, 2.0), (3, 4.0))]
    f = reduction.Reduction(roots, [slope, intercept])
    a, b = reduction.gauss_newton(f, [F.lit(0.0), F.lit(0.0)])
    _, j = f.jacobian(F.lit(1.0), F.lit(2.0))
    row = add(df, *roots).select(a.alias("a"), b.alias("b"), *[c for r in j for c in r]).first()
    assert [row["a"], row["b"]] == pytest.approx(np.polyfit([1, 2, 4], [2, 5, 11], 1).tolist(), abs=1e-12)
    assert list(row)[2:] == [1, 1, 2, 1, 4, 1]


def test_graph_walks_and_dot(spark):
    x = N.Source("in.x", "v")
    z = T.ZScore("in.z", x, 4)
    out = N.OpNode('out"', "sum", z, x)
    assert [n.name for n in graph.bfs_upstream([out, None])] == ['out"', "in.z", "in.x"]
    text = graph.to_dot([out], "a/b")
    assert text.startswith('digraph "a_b" {') and 'subgraph "cluster_in"' in text and '"in.z" -> "out\\"";' in text
    assert text.index('"in.x" [') < text.index('"in.z" [') and "lightyellow" in text
    x.inputs.append(out)
    with pytest.raises(LogicError):
        graph.topological([out])
    with pytest.raises(InvalidArgument):
        graph.Graph(spark.range(1), "nokey", "id")
    with pytest.raises(InvalidArgument):
        graph.Graph(spark.range(1).withColumn("s", F.lit(1)), "id", "s").compile(N.Source("a.b", "s"), N.Source("a__b", "s"))


def test_engine_callbacks_and_feedback(spark):
    df = spark.createDataFrame([(1, k, v) for k, v in enumerate([5.0, 5.0, 7.0], 1)], "k int, s long, v double")
    seen = []
    engine = graph.Engine(graph.Graph(df, "k", "s"))
    engine.add_output(N.Source("x", "v"), lambda key, seq, v: seen.append((seq, v)))
    engine.step()
    assert seen == [(1, 5.0), (3, 7.0)] and engine.cycles == 3 and engine.fired == 2


def test_replay_alignment(spark):
    schedule = spark.createDataFrame([(1, 1000), (2, 2000), (3, 3500)], "seq long, ts_us long")
    price = spark.createDataFrame([(1, 100.0), (3, 101.0), (9, 7.0)], "seq long, value double")
    spread = spark.createDataFrame([(2, 0.5), (3, 0.6)], "seq long, value double")
    trades = spark.createDataFrame([(1, [10, 11, 12]), (2, [20])], "seq long, batch array<int>")
    out = feeds.replay_queue(feeds.replay_input(feeds.replay_input(feeds.replay_clock(schedule), price, "price"), spread, "spread"), trades, "trades")
    got = [tuple(r) for r in out.orderBy("seq").select("seq", "now_us", "price", "spread", "trades").collect()]
    assert got == [(1, 0, 100.0, 0.0, [10, 11, 12]), (2, 1000, 100.0, 0.5, [20]), (3, 2500, 101.0, 0.6, [])]
    assert [r["seq"] for r in feeds.drained(schedule, 2).orderBy("seq").collect()] == [1, 2, 3, 4, 5]
    with pytest.raises(InvalidArgument):
        feeds.check_schedule(schedule.union(schedule))


def test_state_stores(tmp_path):
    saved = {"a": {"ewma": 1.5, "initialized": True}, "b": {"buf": [1.0, 2.0]}}
    for store in (state.InMemoryStateStore(), state.JsonFileStateStore(tmp_path / "s.json")):
        fresh = {"a": {}, "c": {"count": 3}}
        assert not store.restore(fresh) and not store.has_saved_state()
        store.save(saved)
        with pytest.warns(UserWarning, match="c"):
            assert store.restore(fresh)
        assert fresh == {"a": saved["a"], "c": {"count": 3}}
        store.reset()
        assert not store.has_saved_state()
    (tmp_path / "s.json").write_text('{"version": 2, "nodes": {}}')
    with pytest.raises(StateError):
        state.JsonFileStateStore(tmp_path / "s.json").restore({})
    bag = state.Bag()
    bag.sub("inner").put("x", 1.0)
    assert bag.data == {"inner": {"x": 1.0}}
    with pytest.raises(StateError):
        bag.get("missing")


def test_stream_equals_steps(spark, tmp_path):
    rows = [(k % 3, k, float((k * 37) % 50)) for k in range(90)]
    path = str(tmp_path / "t")
    spark.createDataFrame(rows, "k int, s long, v double").repartition(4).write.parquet(path)
    step = RateLimiterStep(10.0)
    want = {}
    states = {k: step.start() for k in range(3)}
    for k, s, v in rows:
        want[k, s] = step.step(states[k], v)
    got = replay_stream(spark, path, "k", "s", "v", step).collect()
    assert {(r["k"], r["s"]): r["y"] for r in got} == want


def noise(i):
    x = i.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = x ^ (x >> np.uint64(31))
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-52 - 1


CYCLES = np.arange(201_000)


def stream_of(spark, tmp_path, **columns):
    import pyarrow as pa
    import pyarrow.parquet as pq

    path = str(tmp_path / "stream.parquet")
    pq.write_table(pa.table({"k": np.zeros(len(CYCLES), np.int32), "s": CYCLES, **columns}), path)
    return graph.Graph(spark.read.parquet(path), "k", "s")


def test_golden_chain(spark, tmp_path):
    spike = (CYCLES % 250 >= 125) & (CYCLES % 250 < 130)
    g = stream_of(spark, tmp_path, v=noise(CYCLES) + np.where(spike, 10.0, 0.0))
    x = N.Source("signal", "v")
    slope = T.Delta("slope", T.Ewma("level", x, 0.05))
    size = N.ComputeNode("abs_z", [T.ZScore("z", x, 64)], F.abs, eager=False)
    alert = T.Threshold("alert", size, 3.0, hysteresis=0.5)
    width = N.ComputeNode("width", [T.RollingMinMax("range", x, 64)], lambda r: r["max"] - r["min"], eager=False)
    drift = T.RollingSum("drift", N.OpNode("change", "diff", x, T.Delay("delayed", x, 16)), 64)
    compiled = g.compile(slope, alert, width, drift)
    fired, total = 0, 0.0
    for n in (slope, alert, width, drift):
        row = compiled.changes(n).where("s >= 1000").agg(F.count("*"), F.sum(n.column.cast("double"))).first()
        fired, total = fired + row[0], total + row[1]
    assert fired == 415725
    assert total == pytest.approx(69780.955311892729, rel=1e-9)


def test_golden_solve(spark, tmp_path):
    g = stream_of(spark, tmp_path, a=2.0 + CYCLES % 97)
    a, x = N.Source("a", "a"), N.Constant("x", 1.0)
    residual = N.OpNode("residual", "diff", N.OpNode("xx", "product", x, x), a)
    root = reduction.ReductionNode("root", residual, [x], [], lambda f: reduction.newton(f, 0.0, 1.0, 6))
    row = g.compile(root).changes(root).where("s >= 1000").agg(F.count("*"), F.sum("root")).first()
    assert row[0] == 200000 and row[1] == pytest.approx(1341290.0460180121, rel=1e-12)


def test_golden_gradient_and_tangent(spark, tmp_path):
    g = stream_of(spark, tmp_path, a=1.5 + 0.5 * noise(CYCLES), b=2.0 + 0.5 * noise(-CYCLES - 1))
    a, b = N.Source("a", "a"), N.Source("b", "b")
    level = T.Ewma("level", a, 0.25)
    blend = N.DifferentiableNode("blend", [level, b], lambda x, y: x * y + dual.sqrt(x) / y)
    root = N.OpNode("root", "diff", N.OpNode("area", "product", blend, level, b), N.OpNode("sq", "sqrt", blend))
    for node, want in ((aad.GradientNode("d", root, [a, b]), 2422144.5540557634), (aad.TangentNode("d", [root, blend], [(a, 1.0)]), 785635.84108931082)):
        row = g.compile(node).changes(node).where("s >= 1000").agg(F.count("*"), F.sum(F.col("d")[0] + F.col("d")[1])).first()
        assert row[0] == 200000 and row[1] == pytest.approx(want, rel=1e-11)
