"""Circuits and the live engine: feedback, sources, state; tables and streams against cycles by hand."""

import math

import pytest

from tickgraph.errors import InvalidArgument, LogicError
from tickgraph.operators import steps
from tickgraph.operators.policies import AlwaysChanged, Epsilon
from tickgraph.plans import circuit as C
from tickgraph.sources.state import InMemoryStateStore, JsonFileStateStore
from tickgraph.streaming.run import replayed


def test_feedback_comes_one_cycle_later():
    engine, seen = C.LiveEngine(), []
    source, fed = engine.make_input("source"), engine.make_input("fed", -1.0)
    twice = C.Apply("twice", lambda x: 2 * x, source)
    engine.add_feedback(twice, fed)
    engine.add_output(fed, seen.append)
    engine.set(source, 5.0)
    engine.step()
    engine.step()
    engine.step()
    assert seen == [-1.0, 10.0]


def test_only_what_changed_moves():
    calls = {"mid": 0, "down": 0}

    def counted(name, fn):
        def run(x):
            calls[name] += 1
            return fn(x)

        return run

    x = C.Input("x")
    mid = C.Apply("mid", counted("mid", lambda v: 1.0), x)
    down = C.Apply("down", counted("down", lambda v: v), mid)
    made = C.Circuit([down])
    state = made.start()
    fired = [made.step(state, {"x": float(k)})["down"][1] for k in range(1, 11)]
    assert calls == {"mid": 10, "down": 1} and fired == [True] + [False] * 9


def test_in_place_choose_and_null_inputs():
    n, flag = C.Input("n", 3.0), C.Input("flag", True)

    def ramp(out, count):
        out.clear()
        out.extend(2.0 * i for i in range(int(count)))

    steps_of = C.InPlace("ramp", ramp, [], n)
    chosen = C.Choose("chosen", flag, C.Apply("a", len, steps_of), C.Apply("b", lambda v: -v, n))
    made = C.Circuit([steps_of, chosen])
    state = made.start()
    assert made.step(state, {})["ramp"] == [[0.0, 2.0, 4.0], True]
    assert made.step(state, {"n": 5.0, "flag": None})["chosen"] == [5, True]
    assert made.step(state, {"flag": False})["chosen"] == [-5.0, True]
    with pytest.raises(InvalidArgument):
        C.Apply("z", abs, None)


def test_errors_of_a_circuit():
    x = C.Input("x")
    a = C.Apply("a", abs, x)
    with pytest.raises(InvalidArgument):
        C.Circuit([])
    with pytest.raises(InvalidArgument):
        C.Circuit([a, C.Apply("a", abs, x)])
    with pytest.raises(InvalidArgument):
        C.Circuit([a], [(x, a)])
    a.inputs.append(a)
    with pytest.raises(LogicError):
        C.Circuit([a])


def test_sources_of_an_engine():
    engine, latest, batches = C.LiveEngine(), [], []
    x, q = engine.make_input("x"), engine.make_input("q", [])
    one, two = C.Latest(x), C.Queue(q, capacity=2)
    inner = C.Registry("inner", one)
    outer = C.Registry("outer", inner, two)
    engine.add_source(outer)
    engine.add_source(one)  # it is flushed already
    engine.add_output(x, latest.append)
    engine.add_output(q, batches.append)
    one.post(1.0)
    one.post(2.0)
    for v in (1, 2, 3):
        two.post(v)
    assert outer.pending() == 3 and len(engine.sources) == 1
    engine.step()
    two.post(2)
    two.post(3)
    engine.step()
    engine.step()
    engine.step()
    assert latest == [2.0] and batches == [[2, 3], [2, 3], []] and one.skipped == 1 and two.dropped == 1
    with pytest.raises(InvalidArgument):
        inner.add(C.Registry("bad", inner))


def test_no_cycle_inside_a_cycle_and_run_until_stopped():
    engine, errors = C.LiveEngine(), []
    x = engine.make_input("x")

    def inside(_):
        for call in (engine.step, engine.run, lambda: engine.add_output(x, print)):
            with pytest.raises(LogicError):
                call()
            errors.append(1)
        engine.stop()

    engine.add_output(x, inside)
    engine.set(x, 1.0)
    engine.run()
    assert len(errors) == 3 and engine.cycles == 1


def ewma_engine(store):
    engine, seen = C.LiveEngine(), []
    x = C.Input("x", None, AlwaysChanged())
    engine.add_output(C.Series("ewma", steps.EwmaStep(0.3), x), seen.append)
    engine.add_output(C.Series("free", steps.DeltaStep(), x, persist=False), lambda v: None)
    engine.store = store
    return engine, x, seen


@pytest.mark.parametrize("kind", ["memory", "file"])
def test_state_goes_on_after_restore(kind, tmp_path):
    store = InMemoryStateStore() if kind == "memory" else JsonFileStateStore(tmp_path / "s.json")
    first, x, seen = ewma_engine(store)
    second, y, other = ewma_engine(store)
    assert not second.restore_state()
    for v in (10.0, 15.0, 12.0, 18.0, 11.0):
        first.set(x, v)
        first.step()
    first.save_state()
    assert [p.name for p in first.discover_stateful()] == ["ewma"] and second.restore_state()
    for v in (9.0, 14.0, 16.0):
        first.set(x, v)
        first.step()
        second.set(y, v)
        second.step()
    assert seen[-3:] == other[-3:] and len(other) == 3
    bare, _, _ = ewma_engine(None)
    bare.save_state()
    assert not bare.restore_state()


def mixed():
    x, back = C.Input("x", None, Epsilon(0.5)), C.Input("back")
    delta = C.Series("delta", steps.DeltaStep(), x)
    total = C.Apply("total", lambda d, b: (d or 0.0) + b, delta, back)
    return C.Circuit([delta, total], [(C.Apply("half", lambda v: v / 2, total), back)])


def test_table_and_stream_equal_cycles(spark, tmp_path):
    values = {1: [1.0, 1.2, None, 3.0, math.inf, 2.0], 2: [None, None, 5.0, 5.0], 3: [7.5]}
    rows = [(k, i, v) for k, vs in values.items() for i, v in enumerate(vs)]
    wanted = {}
    for k, vs in values.items():
        made = mixed()
        state = made.start()
        for i, v in enumerate(vs):
            out = made.step(state, {"x": v})
            wanted[k, i] = (*out["delta"], *out["total"])
    df = spark.createDataFrame(rows, "k long, s long, v double")
    path = str(tmp_path / "t.parquet")
    df.coalesce(1).write.parquet(path)
    batch = C.run_table(df, "k", "s", mixed(), {"x": "v"})
    stream = replayed(spark, path, lambda s: C.run_stream(s, "k", "s", mixed(), {"x": "v"}))
    for got in (batch, stream):
        assert got.columns == ["k", "s", "delta", "delta_fired", "total", "total_fired"]
        assert repr({(r[0], r[1]): tuple(r)[2:] for r in sorted(got.collect())}) == repr(wanted)
    assert C.run_table(df.limit(0), "k", "s", mixed(), {"x": "v"}).collect() == []
    with pytest.raises(InvalidArgument):
        C.run_table(df, "k", "s", mixed(), {"y": "v"})
