"""A query for each operator of the engine over the test tables, with the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dual, ieee
from ..operators import nodes as N
from ..operators import timeseries as T
from ..operators.policies import AlwaysChanged, Epsilon, Predicate, TypedEquality
from ..sources import feeds
from ..streaming import run
from . import aad, circuit, graph, reduction

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def take(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return take


MICROS = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))"
EPSILON = "2.5"
#: Added before rounding where values can lie half-way between two rounded ones, here and in the SQL.
TIE = 1e-9


def read(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark, sf_dir: str) -> graph.Graph:
    df = read(spark, sf_dir, "events").select("user_id", "event_id", "value", "event_type", F.expr(MICROS).alias("ts_us"))
    return graph.Graph(df, "user_id", "event_id")


def source(policy=None, name: str = "x", column: str = "value") -> N.Source:
    return N.Source(name, column, policy or AlwaysChanged())


def r(c: Column | str, digits: int = 6) -> Column:
    return F.round(ieee.col(c), digits)


def rounded(compiled: graph.Compiled, **columns) -> DataFrame:
    return compiled.df.select("user_id", "event_id", *[(r(v) if k not in PLAIN else ieee.col(v)).alias(k) for k, v in columns.items()])


PLAIN = {"state", "fired", "warm", "outlier", "filled", "capacity", "is_full", "n", "above", "below", "alert", "batch", "tweaked"}


def w(n: int | None = None, before: bool = False) -> str:
    frame = "" if n is None else f" ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING" if before else f" ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW"
    return f"OVER (PARTITION BY user_id ORDER BY event_id{frame})"


UP_TO_HERE = "OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def z_parts(n: int, sql: str = "events") -> str:
    return f"""SELECT *, coalesce(avg(value) {w(n, True)}, 0) AS pm, coalesce(stddev_samp(value) {w(n, True)}, 0) AS ps FROM {sql}"""


def recursive(first: str, step: str, source_sql: str = "SELECT user_id, event_id, value FROM events") -> str:
    """y by a recurrence: `first` over b, `step` over b and the row r before it."""
    return f"""WITH RECURSIVE b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM ({source_sql})),
    rec AS (SELECT user_id, rn, event_id, ({first})::DOUBLE AS y FROM b WHERE rn = 1
      UNION ALL SELECT b.user_id, b.rn, b.event_id, ({step})::DOUBLE FROM rec r JOIN b ON b.user_id = r.user_id AND b.rn = r.rn + 1)
    """


@query(f"SELECT user_id, event_id, array_to_string(list_transform(list(value) {w(5)}, lambda v: round(v, 2)::DECIMAL(18, 2)::VARCHAR), ',') AS win FROM events")
def ts_window_array(spark, sf_dir):
    g, x = events(spark, sf_dir), source()
    n = T.WindowNode("win", x, 5)
    text = F.array_join(F.transform(n.column, lambda v: F.round(v, 2).cast("decimal(18,2)").cast("string")), ",")
    return g.compile(n).df.select("user_id", "event_id", text.alias("win"))


@query(f"SELECT user_id, event_id, round(avg(value) {w(20)}, 6) AS mean, round(coalesce(var_samp(value) {w(20)}, 0) + 1e-9, 4) AS var, round(coalesce(stddev_samp(value) {w(20)}, 0), 6) AS sd, count(value) {w(20)} AS n FROM events")
def ts_rolling_stats(spark, sf_dir):
    g, s = events(spark, sf_dir), T.RollingStats("stats", source(), 20)
    df = g.compile(s).df
    return df.select("user_id", "event_id", r(s.column).alias("mean"), r(s.extra("var") + TIE, 4).alias("var"), r(s.extra("sd")).alias("sd"), s.extra("count").alias("n"))


@query(f"SELECT user_id, event_id, round(coalesce(avg(value) {w(20, True)}, 0), 6) AS prev_mean, round(coalesce(stddev_samp(value) {w(20, True)}, 0), 6) AS prev_sd FROM events")
def ts_rolling_prev(spark, sf_dir):
    s = T.RollingStats("stats", source(), 20)
    return rounded(events(spark, sf_dir).compile(s), prev_mean=s.extra("prev_mean"), prev_sd=s.extra("prev_sd"))


@query(f"SELECT user_id, event_id, round(sum(value) {w(16)}, 6) AS total FROM events")
def ts_rolling_sum(spark, sf_dir):
    s = T.RollingSum("total", source(), 16)
    return rounded(events(spark, sf_dir).compile(s), total=s.column)


@query(f"SELECT user_id, event_id, round(min(value) {w(16)}, 6) AS low, round(max(value) {w(16)}, 6) AS high FROM events")
def ts_rolling_minmax(spark, sf_dir):
    s = T.RollingMinMax("mm", source(), 16)
    return rounded(events(spark, sf_dir).compile(s), low=s.column["min"], high=s.column["max"])


@query(recursive("b.value", "0.3 * b.value + 0.7 * r.y") + "SELECT user_id, event_id, round(y + 1e-9, 6) AS ewma FROM rec")
def ts_ewma(spark, sf_dir):
    s = T.Ewma("ewma", source(), 0.3)
    return rounded(events(spark, sf_dir).compile(s), ewma=s.column + TIE)


@query(f"SELECT user_id, event_id, round(1 - pow(1 - 0.3, row_number() {w()}), 6) AS rate FROM events")
def ts_tick_rate(spark, sf_dir):
    s = T.EwmaTickRate("rate", source(), 0.3)
    return rounded(events(spark, sf_dir).compile(s), rate=s.column)


@query(f"SELECT user_id, event_id, round(coalesce(value - lag(value) {w()}, 0), 6) AS delta FROM events")
def ts_delta(spark, sf_dir):
    s = T.Delta("delta", source())
    return rounded(events(spark, sf_dir).compile(s), delta=s.column)


@query(f"SELECT user_id, event_id, round(lag(value, 3, -1) {w()}, 6) AS delayed, row_number() {w()} > 3 AS warm, least(row_number() {w()}, 3) AS filled FROM events")
def ts_delay(spark, sf_dir):
    s = T.Delay("delayed", source(), 3, -1.0)
    return rounded(events(spark, sf_dir).compile(s), delayed=s.column, warm=s.extra("warm"), filled=s.extra("filled"))


@query("""WITH e AS (SELECT user_id, event_id, value, epoch_us(ts) AS t FROM events)
SELECT user_id, event_id, round(arg_max(value, event_id) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 86400000000 PRECEDING), 6) AS delayed FROM e""")
def ts_time_delay(spark, sf_dir):
    s = T.TimeDelay("delayed", source(), source(name="t", column="ts_us"), 86_400_000_000)
    return rounded(events(spark, sf_dir).compile(s), delayed=s.column)


def _threshold_sql(on: str, off: str) -> str:
    return f"""SELECT user_id, event_id, coalesce(last_value(CASE WHEN {on} THEN true WHEN {off} THEN false END IGNORE NULLS) {UP_TO_HERE}, false) AS state FROM events"""


@query(_threshold_sql("value > 40", "value < 30"))
def ts_threshold_above(spark, sf_dir):
    s = T.Threshold("state", source(), 40.0, hysteresis=10.0)
    return rounded(events(spark, sf_dir).compile(s), state=s.column)


@query(_threshold_sql("value < 10", "value > 12"))
def ts_threshold_below(spark, sf_dir):
    s = T.Threshold("state", source(), 10.0, below=True, hysteresis=2.0)
    return rounded(events(spark, sf_dir).compile(s), state=s.column)


@query(recursive("CASE WHEN b.value > 40 THEN 1 ELSE 0 END", "CASE WHEN r.y = 1 THEN CASE WHEN b.value < 50 THEN 0 ELSE 1 END ELSE CASE WHEN b.value > 40 THEN 1 ELSE 0 END END") + "SELECT user_id, event_id, y = 1 AS state FROM rec")
def ts_threshold_negative_hysteresis(spark, sf_dir):
    s = T.Threshold("state", source(), 40.0, hysteresis=-10.0)
    return rounded(events(spark, sf_dir).compile(s), state=s.column)


@query(f"SELECT user_id, event_id, round(CASE WHEN ps < 1e-12 THEN 0 ELSE (value - pm) / ps END, 6) AS z FROM ({z_parts(20)})")
def ts_zscore(spark, sf_dir):
    s = T.ZScore("z", source(), 20)
    return rounded(events(spark, sf_dir).compile(s), z=s.column)


@query(f"""SELECT user_id, event_id, round(CASE WHEN out THEN m ELSE value END, 6) AS gated, out AS outlier FROM
(SELECT *, CASE WHEN ps < 1e-12 THEN false ELSE abs((value - pm) / ps) >= 2 END AS out FROM (SELECT *, avg(value) {w(20)} AS m FROM ({z_parts(20)})))""")
def ts_outlier_gate(spark, sf_dir):
    s = T.OutlierGate("gated", source(), 20, 2.0)
    return rounded(events(spark, sf_dir).compile(s), gated=s.column, outlier=s.extra("outlier"))


@query(recursive("b.value", "CASE WHEN abs(b.value - r.y) >= 25 THEN b.value ELSE r.y END") + "SELECT user_id, event_id, round(y, 6) AS limited FROM rec")
def ts_rate_limiter(spark, sf_dir):
    s = T.RateLimiter("limited", source(), 25.0)
    return rounded(events(spark, sf_dir).compile(s), limited=s.column)


_RUNS = f"""WITH th AS ({_threshold_sql("value > 40", "value < 30")}),
isl AS (SELECT *, count_if(NOT state) {UP_TO_HERE} AS grp FROM th),
run AS (SELECT *, sum(state::INT) OVER (PARTITION BY user_id, grp ORDER BY event_id) AS len FROM isl)"""


@query(_RUNS + " SELECT user_id, event_id, len >= 2 AS state FROM run")
def ts_debounce(spark, sf_dir):
    s = T.DebounceCount("state", T.Threshold("th", source(), 40.0, hysteresis=10.0), 2)
    return rounded(events(spark, sf_dir).compile(s), state=s.column)


@query(_RUNS + f" SELECT user_id, event_id, CASE WHEN state AND len = 2 THEN true WHEN NOT state AND lag(len) {w()} >= 2 THEN false END AS fired FROM run")
def ts_latched_debounce(spark, sf_dir):
    s = T.LatchedDebounce("fired", T.Threshold("th", source(), 40.0, hysteresis=10.0), 2)
    return rounded(events(spark, sf_dir).compile(s), fired=s.column)


@query(f"SELECT user_id, event_id, 20::BIGINT AS capacity, least(row_number() {w()}, 20) AS filled, row_number() {w()} >= 20 AS is_full, round(least(row_number() {w()}, 20) / 20, 6) AS fraction FROM events")
def ts_window_status(spark, sf_dir):
    s = T.RollingStats("stats", source(), 20)
    status = T.window_status(s, 20)
    return rounded(events(spark, sf_dir).compile(s), capacity=status["capacity"], filled=status["filled"], is_full=status["full"], fraction=status["fraction"])


def lineitem(spark, sf_dir, columns: dict[str, Column], extra=("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")) -> DataFrame:
    df = read(spark, sf_dir, "lineitem")
    return df.select(*extra, *[v.alias(k) for k, v in columns.items()])


def op(name: str, *xs: str | Column) -> Column:
    return N.scalar.OPS[name].value(*[ieee.col(x) for x in xs])


LINE = "l_orderkey, l_partkey, l_suppkey, l_linenumber"


@query(f"SELECT {LINE}, round(0.0 + l_quantity + l_extendedprice + l_tax, 6) AS total, round(l_quantity * l_extendedprice * l_tax, 4) AS product, round(l_extendedprice - l_quantity, 6) AS diff, -l_discount AS negated FROM lineitem")
def ops_arith(spark, sf_dir):
    return lineitem(spark, sf_dir, {
        "total": r(op("sum", "l_quantity", "l_extendedprice", "l_tax")), "product": r(op("product", "l_quantity", "l_extendedprice", "l_tax"), 4),
        "diff": r(op("diff", "l_extendedprice", "l_quantity")), "negated": op("negate", "l_discount"),
    })


@query(f"SELECT {LINE}, isinf(l_quantity / l_discount) AS is_inf, isnan((l_discount - l_discount) / l_discount) AS is_nan, round(CASE WHEN l_discount = 0 THEN 0 ELSE l_quantity / l_discount END, 4) AS finite FROM lineitem")
def ops_divide_ieee(spark, sf_dir):
    q = op("divide", "l_quantity", "l_discount")
    nan = op("divide", F.col("l_discount") - F.col("l_discount"), "l_discount")
    inf = q == F.lit(ieee.INF)
    return lineitem(spark, sf_dir, {"is_inf": inf, "is_nan": F.isnan(nan), "finite": r(F.when(inf, F.lit(0.0)).otherwise(q), 4)})


@query(f"SELECT {LINE}, round(exp(l_discount), 6) AS e, CASE WHEN l_tax > 0 THEN round(ln(l_tax), 6) ELSE -1e308 END AS l, round(sqrt(l_quantity), 6) AS s, round(pow(l_quantity, l_discount), 6) AS p FROM lineitem")
def ops_exp_ln_sqrt_pow(spark, sf_dir):
    log = F.when(F.col("l_tax") > 0, r(op("ln", "l_tax"))).otherwise(F.lit(-1e308))
    return lineitem(spark, sf_dir, {"e": r(op("exp", "l_discount")), "l": log, "s": r(op("sqrt", "l_quantity")), "p": r(op("power", "l_quantity", "l_discount"))})


@query(f"SELECT {LINE}, round(sin(l_quantity), 6) AS s, round(cos(l_quantity), 6) AS c, round(tan(l_discount), 6) AS t FROM lineitem")
def ops_trig(spark, sf_dir):
    return lineitem(spark, sf_dir, {"s": r(op("sin", "l_quantity")), "c": r(op("cos", "l_quantity")), "t": r(op("tan", "l_discount"))})


@query(f"SELECT {LINE}, round(asin(l_discount), 6) AS s, round(acos(l_discount), 6) AS c, round(atan(l_quantity), 6) AS t, l_quantity > 1 AS outside FROM lineitem")
def ops_inverse_trig(spark, sf_dir):
    return lineitem(spark, sf_dir, {"s": r(op("asin", "l_discount")), "c": r(op("acos", "l_discount")), "t": r(op("atan", "l_quantity")), "outside": F.isnan(op("asin", "l_quantity"))})


@query(f"SELECT {LINE}, round(atan2(l_discount, l_tax), 6) AS a FROM lineitem")
def ops_atan2(spark, sf_dir):
    return lineitem(spark, sf_dir, {"a": r(op("atan2", "l_discount", "l_tax"))})


@query(f"SELECT user_id, event_id, round(CASE WHEN value > 40 THEN coalesce(value - lag(value) {w()}, 0) ELSE value * 2 END, 6) AS chosen FROM events")
def cond_select(spark, sf_dir):
    x = source()
    c = N.ConditionNode("chosen", N.ComputeNode("big", [x], lambda v: ieee.gt(v, 40.0)), T.Delta("delta", x), N.ComputeNode("twice", [x], lambda v: v * 2))
    return rounded(events(spark, sf_dir).compile(c), chosen=c.column)


@query(f"""WITH taken AS (SELECT user_id, event_id, row_number() {w()} AS k FROM events WHERE value > 40),
up AS (SELECT e.user_id, e.event_id, e.value, t.k FROM events e LEFT JOIN taken t USING (user_id, event_id))
SELECT user_id, event_id, round(CASE WHEN value > 40 THEN 1 - pow(0.7, k) ELSE -1 END, 6) AS chosen FROM up""")
def cond_stateful_branch(spark, sf_dir):
    x = source()
    big = N.ComputeNode("big", [x], lambda v: ieee.gt(v, 40.0))
    rate = T.EwmaTickRate("rate", N.TakenWhen("seen", x, big, True), 0.3)
    c = N.ConditionNode("chosen", big, rate, N.Constant("none", -1.0))
    return rounded(events(spark, sf_dir).compile(c), chosen=c.column)


@query(f"""WITH a AS (SELECT *, CASE WHEN event_type = 'purchase' THEN 'tweak' WHEN event_type = 'signup' THEN 'clear' END AS act FROM events),
s AS (SELECT *, last_value(CASE WHEN act IS NOT NULL THEN struct_pack(o := act = 'tweak', v := value) END IGNORE NULLS) {UP_TO_HERE} AS st FROM a)
SELECT user_id, event_id, coalesce(st.o, false) AS tweaked, round(CASE WHEN coalesce(st.o, false) THEN st.v ELSE value * 2 END, 6) AS y FROM s""")
def tweak_override(spark, sf_dir):
    g = events(spark, sf_dir)
    act = F.when(F.col("event_type") == "purchase", "tweak").when(F.col("event_type") == "signup", "clear")
    g = graph.Graph(g.df.withColumn("act", act), "user_id", "event_id")
    n = N.TweakableNode("y", [source()], lambda v: v * 2, "act", "value")
    return rounded(g.compile(n), y=n.column, tweaked=F.col("y__tweaked"))


@query(f"""WITH e AS (SELECT user_id, event_id, floor(value / 10) AS v FROM events)
SELECT user_id, event_id, v AS x FROM (SELECT *, lag(v) {w()} AS p, row_number() {w()} AS n FROM e) WHERE n = 1 OR v IS DISTINCT FROM p""")
def policy_typed_changes(spark, sf_dir):
    g = events(spark, sf_dir)
    g = graph.Graph(g.df.withColumn("value", F.floor(F.col("value") / 10).cast("double")), "user_id", "event_id")
    x = source(TypedEquality())
    return g.compile(x).changes(x)


@query(recursive("b.value", f"CASE WHEN abs(b.value - r.y) < {EPSILON} THEN r.y ELSE b.value END") + "SELECT user_id, event_id, round(y, 6) AS held FROM rec")
def policy_epsilon(spark, sf_dir):
    x = N.Source("held", "value", Epsilon(float(EPSILON)))
    return rounded(events(spark, sf_dir).compile(x), held=x.column)


@query(recursive("b.value", f"CASE WHEN abs(b.value - r.y) < {EPSILON} THEN r.y ELSE b.value END") + f""",
t AS (SELECT user_id, event_id, y, NOT coalesce(abs(value - lag(y) {w()}) < {EPSILON}, false) AS tick FROM rec JOIN events USING (user_id, event_id)),
m AS (SELECT user_id, event_id, sum(y) {w(3)} AS s FROM t WHERE tick)
SELECT t.user_id, t.event_id, round(last_value(s IGNORE NULLS) {UP_TO_HERE.replace("user_id", "t.user_id").replace("event_id", "t.event_id")}, 6) AS total
FROM t LEFT JOIN m ON m.user_id = t.user_id AND m.event_id = t.event_id""")
def policy_epsilon_window(spark, sf_dir):
    total = T.RollingSum("total", N.Source("held", "value", Epsilon(float(EPSILON))), 3)
    return rounded(events(spark, sf_dir).compile(total), total=total.column)


@query(f"SELECT user_id, event_id, sum(floor(value / 50)) {w(3)} AS total FROM events")
def policy_predicate_window(spark, sf_dir):
    """A predicate that calls nothing equal: repeated values are ticks too."""
    g = events(spark, sf_dir)
    g = graph.Graph(g.df.withColumn("value", F.floor(F.col("value") / 50).cast("double")), "user_id", "event_id")
    total = T.RollingSum("total", N.Source("x", "value", Predicate(_never)), 3)
    return rounded(g.compile(total), total=total.column)


def _never(a, b) -> bool:
    return False


@query(f"""WITH e AS (SELECT user_id, event_id, floor(value / 10) AS v FROM events),
t AS (SELECT *, row_number() {w()} = 1 OR v IS DISTINCT FROM lag(v) {w()} AS tick FROM e),
m AS (SELECT user_id, event_id, avg(v) {w(5)} AS m, v - lag(v) {w()} AS d FROM t WHERE tick),
j AS (SELECT t.user_id, t.event_id, m.m, coalesce(m.d, CASE WHEN m.event_id IS NOT NULL THEN 0 END) AS d FROM t LEFT JOIN m USING (user_id, event_id))
SELECT user_id, event_id, round(last_value(m IGNORE NULLS) {UP_TO_HERE}, 6) AS mean, round(last_value(d IGNORE NULLS) {UP_TO_HERE}, 6) AS delta FROM j""")
def policy_ticks_gate_windows(spark, sf_dir):
    g = events(spark, sf_dir)
    g = graph.Graph(g.df.withColumn("value", F.floor(F.col("value") / 10).cast("double")), "user_id", "event_id")
    x = source(TypedEquality())
    s, d = T.RollingStats("stats", x, 5), T.Delta("delta", x)
    return rounded(g.compile(s, d), mean=s.column, delta=d.column)


def _hourly(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).df.withColumn("cycle", F.floor(F.col("ts_us") / 86_400_000_000).cast("long"))


_HOURLY = "(SELECT user_id, event_id, value, floor(epoch_us(ts) / 86400000000)::BIGINT AS cycle FROM events)"


@query(f"SELECT user_id, cycle, round(arg_max(value, event_id), 6) AS value, count(*) - 1 AS skipped FROM {_HOURLY} GROUP BY user_id, cycle")
def src_latest_wins(spark, sf_dir):
    return feeds.latest_wins(_hourly(spark, sf_dir), ["user_id", "cycle"], "event_id", "value").withColumn("value", r("value"))


def _batches(spark, sf_dir, capacity: int) -> DataFrame:
    out = feeds.queue_batches(_hourly(spark, sf_dir), ["user_id", "cycle"], "event_id", "event_id", capacity)
    return out.withColumn("batch", F.array_join(F.col("batch").cast("array<string>"), ","))


@query(f"SELECT user_id, cycle, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS batch, 0::BIGINT AS dropped FROM {_HOURLY} GROUP BY user_id, cycle")
def src_queue_batch(spark, sf_dir):
    return _batches(spark, sf_dir, 4096)


@query(f"""SELECT user_id, cycle, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) FILTER (k <= 2) AS batch, greatest(count(*) - 2, 0) AS dropped
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, cycle ORDER BY event_id DESC) AS k FROM {_HOURLY}) GROUP BY user_id, cycle""")
def src_queue_drop_oldest(spark, sf_dir):
    return _batches(spark, sf_dir, 2)


@query(f"""WITH p AS (SELECT user_id, cycle, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) FILTER (k <= 2) AS batch, greatest(count(*) - 2, 0) AS dropped
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id, cycle ORDER BY event_id DESC) AS k FROM {_HOURLY}) GROUP BY user_id, cycle),
c AS (SELECT user_id, unnest(range(min(cycle), max(cycle) + 2)) AS cycle FROM p GROUP BY user_id)
SELECT user_id, cycle, coalesce(batch, '') AS batch, (sum(coalesce(dropped, 0)) OVER (PARTITION BY user_id ORDER BY cycle))::BIGINT AS dropped_count FROM c LEFT JOIN p USING (user_id, cycle)""")
def src_queue_cycles(spark, sf_dir):
    posts = _hourly(spark, sf_dir)
    cycles = posts.groupBy("user_id").agg(F.explode(F.sequence(F.min("cycle"), F.max("cycle") + 1)).alias("cycle"))
    out = feeds.queue_cycles(cycles, posts, ["user_id"], "cycle", "event_id", "event_id", 2)
    return out.withColumn("batch", F.array_join(F.col("batch").cast("array<string>"), ","))


@query("""SELECT user_id, event_id AS seq, round(value, 6) AS value, 'events' AS source FROM events
UNION ALL SELECT o_custkey, o_orderkey, round(o_totalprice, 6), 'orders' FROM orders""")
def src_registry_union(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), r("value").alias("value"))
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("seq"), r("o_totalprice").alias("value"))
    return feeds.registry(("events", e), ("orders", o), ("events", e))


@query(f"""WITH s AS (SELECT user_id, event_id, epoch_us(ts) AS t, CASE WHEN event_id % 3 = 0 THEN value END AS p, CASE WHEN event_id % 5 = 0 THEN value * 2 END AS q FROM events)
SELECT user_id, event_id, t - first_value(t) {UP_TO_HERE} AS now_us, round(coalesce(last_value(p IGNORE NULLS) {UP_TO_HERE}, 0), 6) AS price, round(coalesce(last_value(q IGNORE NULLS) {UP_TO_HERE}, 0), 6) AS spread FROM s""")
def replay_align(spark, sf_dir):
    e = events(spark, sf_dir).df
    schedule = feeds.replay_clock(e.select("user_id", "event_id", "ts_us"), "event_id", "ts_us", key=["user_id"])
    price, spread = e.where("event_id % 3 = 0"), e.where("event_id % 5 = 0").withColumn("value", F.col("value") * 2)
    out = feeds.replay_input(schedule, price, "price", 0.0, "event_id", "value", ["user_id"])
    out = feeds.replay_input(out, spread, "spread", 0.0, "event_id", "value", ["user_id"])
    return out.select("user_id", "event_id", "now_us", r("price").alias("price"), r("spread").alias("spread"))


@query("""SELECT user_id, event_id, CASE WHEN event_id % 4 = 0 THEN event_id::VARCHAR || ',' || (event_id + 1)::VARCHAR ELSE '' END AS batch FROM events""")
def replay_queue(spark, sf_dir):
    e = events(spark, sf_dir).df
    batches = e.where("event_id % 4 = 0").select("user_id", "event_id", F.array("event_id", F.col("event_id") + 1).alias("batch"))
    out = feeds.replay_queue(e.select("user_id", "event_id"), batches, "b", "event_id", "batch", ["user_id"])
    return out.select("user_id", "event_id", F.array_join(F.col("b").cast("array<string>"), ",").alias("batch"))


@query("SELECT count(*) AS rows, count(DISTINCT (l_quantity, l_discount)) AS misses, count(*) - count(DISTINCT (l_quantity, l_discount)) AS hits FROM lineitem")
def memo_stats(spark, sf_dir):
    return graph.memo_stats(read(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"])


@query(f"SELECT {LINE}, round(sqrt(l_quantity) * (1 - l_discount), 6) AS y FROM lineitem")
def memo_compute(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem")
    fn = lambda d: d.withColumn("y", r(F.sqrt("l_quantity") * (1 - F.col("l_discount"))))
    return graph.memoized(df, ["l_quantity", "l_discount"], "y", fn).select(*LINE.split(", "), "y")


def _revenue():
    p, d, t = (N.Source(n, f"l_{c}", AlwaysChanged()) for n, c in (("p", "extendedprice"), ("d", "discount"), ("t", "tax")))
    one = N.Constant("one", 1.0)
    root = N.OpNode("revenue", "product", p, N.OpNode("kept", "diff", one, d), N.OpNode("taxed", "sum", one, t))
    return p, d, t, root


def _line_graph(spark, sf_dir, *outputs) -> DataFrame:
    """Row-wise operators need no order: nodes are added without a key."""
    df = read(spark, sf_dir, "lineitem")
    for n in graph.topological(outputs):
        source_column = getattr(n, "source", None)
        df = df.withColumn(N.column_name(n.name), F.col(source_column) if source_column else n.apply(*[i.column for i in n.inputs]))
    return df


@query(f"SELECT {LINE}, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS revenue, round((1 - l_discount) * (1 + l_tax), 6) AS by_price, round(-l_extendedprice * (1 + l_tax), 6) AS by_discount, round(l_extendedprice * (1 - l_discount), 6) AS by_tax FROM lineitem")
def aad_gradient_ops(spark, sf_dir):
    p, d, t, root = _revenue()
    g = aad.GradientNode("g", root, [p, d, t])
    df = _line_graph(spark, sf_dir, g)
    return df.select(*LINE.split(", "), r(root.column).alias("revenue"), *[r(g.column[k]).alias(n) for k, n in enumerate(("by_price", "by_discount", "by_tax"))])


@query(f"SELECT {LINE}, round(2 * (1 - l_discount) * (1 + l_tax) - 0.5 * l_extendedprice * (1 + l_tax), 6) AS slope FROM lineitem")
def aad_tangent_ops(spark, sf_dir):
    p, d, _, root = _revenue()
    t = aad.TangentNode("t", [root], [(p, 2.0), (d, 0.5)])
    return _line_graph(spark, sf_dir, t).select(*LINE.split(", "), r(t.column[0]).alias("slope"))


@query(f"""SELECT user_id, event_id, (CASE WHEN n = 1 THEN 1 ELSE 0.3 END)::DOUBLE AS ewma, round(CASE WHEN ps < 1e-12 THEN 0 ELSE 1 / ps END, 6) AS z,
round(CASE WHEN ps >= 1e-12 AND abs((value - pm) / ps) >= 2 THEN 1 / least(n, 20) ELSE 1 END, 6) AS gate, round(1 / least(n, 20), 6) AS mean
FROM (SELECT *, row_number() {w()} AS n FROM ({z_parts(20)}))""")
def aad_stateful_gradient(spark, sf_dir):
    x = source()
    e, z, o, m = T.Ewma("e", x, 0.3), T.ZScore("z", x, 20), T.OutlierGate("o", x, 20, 2.0), T.RollingStats("m", x, 20)
    by = {k: aad.adjoints(n, [x])[0] for k, n in (("ewma", e), ("z", z), ("gate", o), ("mean", m))}
    return rounded(events(spark, sf_dir).compile(e, z, o, m), **by)


@query(recursive("b.value", "CASE WHEN abs(b.value - r.y) >= 25 THEN b.value ELSE r.y END") + f"""SELECT user_id, event_id,
1.0::DOUBLE AS total, (CASE WHEN rn = 1 THEN 0 ELSE 1 END)::DOUBLE AS delta, 1.0::DOUBLE AS same, 0.0::DOUBLE AS later,
(CASE WHEN coalesce(abs(value - lag(y) {w()}) >= 25, true) THEN 1 ELSE 0 END)::DOUBLE AS limited FROM rec JOIN events USING (user_id, event_id)""")
def aad_stateful_gradient_2(spark, sf_dir):
    x = source()
    made = {"total": T.RollingSum("s", x, 16), "delta": T.Delta("d", x), "same": T.Delay("d0", x, 0), "later": T.Delay("d2", x, 2), "limited": T.RateLimiter("l", x, 25.0)}
    return rounded(events(spark, sf_dir).compile(*made.values()), **{k: aad.adjoints(n, [x])[0] for k, n in made.items()})


@query(f"SELECT {LINE}, round(CASE WHEN l_discount = 0 THEN 0 ELSE l_tax * 0.5 / sqrt(l_discount) END, 6) AS slope FROM lineitem WHERE l_discount > 0 OR l_tax = 0")
def aad_zero_rule(spark, sf_dir):
    z, d = N.Source("z", "l_tax", AlwaysChanged()), N.Source("d", "l_discount", AlwaysChanged())
    root = N.OpNode("root", "product", z, N.OpNode("s", "sqrt", d))
    slope = aad.adjoints(root, [d])[0]
    df = _line_graph(spark, sf_dir, root).where("l_discount > 0 OR l_tax = 0")
    return df.select(*LINE.split(", "), r(slope).alias("slope"))


@query(f"SELECT {LINE}, round(tanh(l_discount) * l_tax + exp(l_discount), 6) AS y, round(l_tax / (cosh(l_discount) * cosh(l_discount)) + exp(l_discount), 6) AS dy FROM lineitem")
def aad_dual_function(spark, sf_dir):
    d, t = N.Source("d", "l_discount", AlwaysChanged()), N.Source("t", "l_tax", AlwaysChanged())
    n = N.DifferentiableNode("y", [d, t], lambda a, b: dual.tanh(a) * b + dual.exp(a))
    df = _line_graph(spark, sf_dir, n)
    return df.select(*LINE.split(", "), r(n.column).alias("y"), r(aad.adjoints(n, [d])[0]).alias("dy"))


_TRIALS = "(VALUES (1, 0.0, 0.0), (2, 0.05, 0.1), (3, 0.5, 0.02)) AS trials(trial_id, d, t)"


def _trials(df: DataFrame) -> DataFrame:
    """Each row with the points of a small fixed grid, as an array in the row: no join."""
    points = F.array(*[F.struct(F.lit(i).alias("trial_id"), F.lit(d).alias("td"), F.lit(t).alias("tt")) for i, d, t in ((1, 0.0, 0.0), (2, 0.05, 0.1), (3, 0.5, 0.02))])
    return df.withColumn("trial", F.explode(points)).select("*", "trial.trial_id", "trial.td", "trial.tt")


@query(f"SELECT {LINE}, trial_id, round(l_extendedprice * (1 - d) * (1 + t), 6) AS y FROM lineitem, {_TRIALS}")
def reduce_whatif(spark, sf_dir):
    _, d, t, root = _revenue()
    f = reduction.Reduction(root, [d, t])
    return _trials(_line_graph(spark, sf_dir, root)).select(*LINE.split(", "), "trial_id", r(f(F.col("td"), F.col("tt"))).alias("y"))


@query(f"SELECT {LINE}, trial_id, round(-l_extendedprice * (1 + t), 4) AS by_discount, round(l_extendedprice * (1 - d), 4) AS by_tax FROM lineitem, {_TRIALS}")
def reduce_gradient(spark, sf_dir):
    _, d, t, root = _revenue()
    _, (a, b) = reduction.Reduction(root, [d, t]).gradient(F.col("td"), F.col("tt"))
    return _trials(_line_graph(spark, sf_dir, root)).select(*LINE.split(", "), "trial_id", r(a, 4).alias("by_discount"), r(b, 4).alias("by_tax"))


@query(f"SELECT {LINE}, trial_id, round(-l_extendedprice, 4) AS j00, 0.0::DOUBLE AS j01, round(-l_extendedprice * (1 + t), 4) AS j10, round(l_extendedprice * (1 - d), 4) AS j11 FROM lineitem, {_TRIALS}")
def reduce_jacobian(spark, sf_dir):
    p, d, t, root = _revenue()
    net = N.OpNode("net", "product", p, next(n for n in graph.bfs_upstream([root]) if n.name == "kept"))
    _, j = reduction.Reduction([net, root], [d, t]).jacobian(F.col("td"), F.col("tt"))
    df = _trials(_line_graph(spark, sf_dir, net, root))
    return df.select(*LINE.split(", "), "trial_id", *[r(j[a][b], 4).alias(f"j{a}{b}") for a in (0, 1) for b in (0, 1)])


@query("SELECT o_orderkey, round(sqrt(o_totalprice), 6) AS root FROM orders")
def reduce_newton_sqrt(spark, sf_dir):
    x = N.Constant("x", 1.0)
    f = reduction.Reduction(N.OpNode("square", "product", x, x), [x])
    solved = reduction.newton(f, F.col("o_totalprice"), F.sqrt(F.col("o_totalprice")) * 0.7 + 1.0, 7)
    return read(spark, sf_dir, "orders").withColumn("x", F.lit(1.0)).select("o_orderkey", r(solved).alias("root"))


@query("SELECT o_orderkey, round(sqrt(o_totalprice), 6) AS root FROM orders")
def reduce_node_newton(spark, sf_dir):
    """The solver as a node of the graph, fed by a source."""
    x, y = N.Constant("x", 1.0), N.Source("y", "o_totalprice", AlwaysChanged())
    solve = lambda f, target: reduction.newton(f, target, F.sqrt(target) * 0.7 + 1.0, 7)
    node = reduction.ReductionNode("root", N.OpNode("square", "product", x, x), [x], [y], solve)
    df = read(spark, sf_dir, "orders")
    for n in graph.topological([node]):
        df = df.withColumn(n.name, F.col(n.source) if isinstance(n, N.Source) else n.apply(*[i.column for i in n.inputs]))
    return df.select("o_orderkey", r(node.column).alias("root"))


@query(f"""WITH p AS (SELECT user_id, event_id, lag(value, 2) {w()} AS a, lag(value) {w()} AS b, value AS c FROM events)
SELECT user_id, event_id, round((-4 * a - b + 5 * c) / 14, 6) AS slope, round((14 * a + 7 * b - 7 * c) / 14, 6) AS intercept FROM p WHERE a IS NOT NULL""")
def reduce_linefit(spark, sf_dir):
    """The line through the latest three values of a key at t = 1, 2 and 4, fitted anew at each event."""
    e = events(spark, sf_dir)
    own = graph.Builder(e.df, "user_id", "event_id").window()
    df = e.df.select("user_id", "event_id", F.lag("value", 2).over(own).alias("1"), F.lag("value").over(own).alias("2"), F.col("value").alias("3"))
    df = df.where("`1` is not null")
    slope, intercept = N.Constant("slope", 0.0), N.Constant("intercept", 0.0)
    roots = []
    for k, t in ((1, 1.0), (2, 2.0), (3, 4.0)):
        y, at = N.Source(f"y{k}", str(k), AlwaysChanged()), N.Constant(f"t{k}", t)
        line = N.OpNode(f"line{k}", "sum", N.OpNode(f"rise{k}", "product", slope, at), intercept)
        roots.append(N.OpNode(f"res{k}", "diff", line, y))
    f = reduction.Reduction(roots, [slope, intercept])
    for n in graph.topological(roots):
        df = df.withColumn(n.name, F.col(f"`{n.source}`") if isinstance(n, N.Source) else n.apply(*[i.column for i in n.inputs]))
    a, b = reduction.gauss_newton(f, [F.lit(0.0), F.lit(0.0)])
    return df.select("user_id", "event_id", r(a).alias("slope"), r(b).alias("intercept"))


@query(recursive("b.value", "b.value + 0.5 * r.y") + "SELECT user_id, event_id, round(y + 1e-9, 6) AS y FROM rec")
def engine_feedback(spark, sf_dir):
    n = N.FeedbackNode("y", source(), _half_back, 0.0)
    return rounded(events(spark, sf_dir).compile(n), y=n.column + TIE)


def feedback_circuit() -> circuit.Circuit:
    """total = x + back, and a quarter of it goes back through a node of its own."""
    x, back = circuit.Input("x", 0.0, AlwaysChanged()), circuit.Input("back")
    total = circuit.Apply("total", lambda a, b: a + b, x, back, policy=AlwaysChanged())
    damped = circuit.Apply("damped", lambda v: 0.25 * v, total)
    return circuit.Circuit([total, damped], [(damped, back)])


FEEDBACK_SQL = recursive("b.value", "b.value + 0.25 * r.y") + """SELECT user_id, event_id, round(y + 1e-9, 6) AS total,
round(0.25 * y + 1e-9, 6) AS damped FROM rec"""


def _of_feedback(df: DataFrame) -> DataFrame:
    return df.select("user_id", "event_id", *[r(F.col(c) + TIE).alias(c) for c in ("total", "damped")])


@query(FEEDBACK_SQL)
def engine_feedback_graph(spark, sf_dir):
    """An output fed back to an input through a graph, on the whole table."""
    df = read(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return _of_feedback(circuit.run_table(df, "user_id", "event_id", feedback_circuit(), {"x": "value"}))


@query(FEEDBACK_SQL)
def stream_graph_equals_batch(spark, sf_dir):
    """The same graph over the table as a stream."""
    made = feedback_circuit()
    out = run.replayed(spark, f"{sf_dir}/events.parquet", lambda s: circuit.run_stream(s, "user_id", "event_id", made, {"x": "value"}))
    return _of_feedback(out)


def _half_back(x: float, last: float) -> float:
    return x + 0.5 * last


class ZAlert(graph.Module):
    """Rolling z-score, its size, a threshold with hysteresis once the window is full, and a latched debounce."""

    name = "zalert"

    def __init__(self, window: int = 20, level: float = 1.5, hysteresis: float = 0.5, required: int = 2):
        self.window, self.level, self.hysteresis, self.required = window, level, hysteresis, required

    def wire(self, inputs):
        x = inputs["x"]
        z = T.ZScore("alert.z", x, self.window)
        size = N.ComputeNode("alert.size", [z], F.abs, eager=False)
        above = T.Threshold("alert.above", size, self.level, hysteresis=self.hysteresis)
        stats = T.RollingStats("alert.stats", x, self.window)
        full = N.ComputeNode("alert.full", [stats], lambda _: stats.extra("filled") >= self.window)
        gated = N.ComputeNode("alert.gated", [above, full], lambda a, f: a & f)
        return {"z": z, "above": above, "alert": T.LatchedDebounce("alert.fired", gated, self.required)}


@query(f"""WITH z AS (SELECT user_id, event_id, CASE WHEN ps < 1e-12 THEN 0 ELSE (value - pm) / ps END AS z, row_number() {w()} AS n FROM ({z_parts(20)})),
th AS (SELECT *, coalesce(last_value(CASE WHEN abs(z) > 1.5 THEN true WHEN abs(z) < 1.0 THEN false END IGNORE NULLS) {UP_TO_HERE}, false) AS above FROM z),
g AS (SELECT *, above AND n >= 20 AS gated FROM th),
isl AS (SELECT *, count_if(NOT gated) {UP_TO_HERE} AS grp FROM g),
run AS (SELECT *, sum(gated::INT) OVER (PARTITION BY user_id, grp ORDER BY event_id) AS len FROM isl)
SELECT user_id, event_id, round(z, 6) AS z, above, CASE WHEN gated AND len = 2 THEN true WHEN NOT gated AND lag(len) {w()} >= 2 THEN false END AS alert FROM run""")
def alert_pipeline(spark, sf_dir):
    made = ZAlert().wire({"x": source()})
    compiled = events(spark, sf_dir).compile(*made.values())
    return rounded(compiled, z=made["z"].column, above=made["above"].column, alert=made["alert"].column)


@query("SELECT * FROM (VALUES ('alert.size', 'alert.above'), ('alert.z', 'alert.size'), ('x', 'alert.z'), ('x', 'alert.stats'), ('alert.stats', 'alert.full'), ('alert.above', 'alert.gated'), ('alert.full', 'alert.gated'), ('alert.gated', 'alert.fired')) AS t(src, dst)")
def graph_edges(spark, sf_dir):
    made = ZAlert().wire({"x": source()})
    return graph.edges(made.values(), spark).select("src", "dst")


@query(recursive("b.value", "CASE WHEN abs(b.value - r.y) >= 25 THEN b.value ELSE r.y END") + "SELECT user_id, event_id, round(y, 6) AS limited FROM rec")
def stream_equals_batch(spark, sf_dir):
    from ..streaming.run import replay_stream

    out = replay_stream(spark, f"{sf_dir}/events.parquet", "user_id", "event_id", "value", T.RateLimiter("limited", source(), 25.0).step())
    return out.select("user_id", "event_id", r("y").alias("limited"))
