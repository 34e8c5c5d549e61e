"""A graph of nodes compiled to one DataFrame plan: a column per node, a row per cycle of a key."""

from __future__ import annotations

import os
import subprocess
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidArgument, LogicError
from ..operators.nodes import Builder, Node, column_name


def bfs_upstream(roots: Iterable[Node | None]) -> Iterator[Node]:
    """The roots and all that is above them, each once, nearest first."""
    seen: set[int] = set()
    todo = deque(r for r in roots if r is not None)
    while todo:
        node = todo.popleft()
        if id(node) not in seen:
            seen.add(id(node))
            yield node
            todo.extend(i for i in node.inputs if i is not None)


def topological(roots: Iterable[Node]) -> list[Node]:
    """Inputs before their consumers; LogicError on a cycle."""
    state: dict[int, int] = {}
    out: list[Node] = []
    for root in roots:
        stack = [(root, False)]
        while stack:
            node, done = stack.pop()
            if done:
                state[id(node)] = 2
                out.append(node)
            elif state.get(id(node)) == 1:
                raise LogicError(f"cycle through {node.name}")
            elif id(node) not in state:
                state[id(node)] = 1
                stack.append((node, True))
                stack.extend((i, False) for i in reversed(node.inputs) if state.get(id(i)) != 2)
    return out


class Graph:
    """compile(outputs) over a stream with a key and an order; only what an output needs is built.

    Rows of a key are its cycles in order of seq, which must be unique in it. A key is needed: without one all rows
    would be one sequence on one task.
    """

    def __init__(self, df: DataFrame, key: str, seq: str):
        for c in (key, seq):
            if c not in df.columns:
                raise InvalidArgument(f"no column {c}")
        self.df, self.key, self.seq = df, key, seq

    def compile(self, *outputs: Node) -> Compiled:
        nodes = topological(outputs)
        names: dict[str, Node] = {}
        for n in nodes:
            if names.setdefault(column_name(n.name), n) is not n:
                raise InvalidArgument(f"two nodes are named {n.name}")
        b = Builder(self.df, self.key, self.seq)
        for n in nodes:
            n.build(b)
        return Compiled(b, list(outputs))


class Compiled:
    """df holds all node columns; values() the outputs on every cycle, changes() only the cycles that publish."""

    def __init__(self, b: Builder, outputs: list[Node]):
        self.b, self.outputs, self.df = b, outputs, b.df

    def values(self, **columns: Column) -> DataFrame:
        chosen = [o.column.alias(column_name(o.name)) for o in self.outputs]
        return self.df.select(self.b.key, self.b.seq, *chosen, *[v.alias(k) for k, v in columns.items()])

    def changes(self, node: Node) -> DataFrame:
        """The cycles at which an output's callback would fire: the first, then where it ticks and its value differs."""
        w = self.b.window()
        value = node.column
        before = F.lag(F.struct(value.alias("v"))).over(w)
        tick = self.b.ticks[node]
        fired = before.isNull() | ((F.col(tick) if tick else F.lit(True)) & _differs(value, before["v"]))
        rows = self.df.withColumn("__fired", fired).where("__fired")
        return rows.select(self.b.key, self.b.seq, value.alias(column_name(node.name)))


def _differs(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


_STYLES = {"Input": ("ellipse", "lightblue"), "TimeSeries": ("box", "lightyellow"), "Compute": ("box", "white")}


def _cluster(name: str) -> str:
    return name.split(".", 1)[0] if "." in name else ""


def edges(outputs: Iterable[Node], spark=None) -> list[tuple] | DataFrame:
    """(src, dst, kind, cluster) of every edge above the outputs, sorted; as a DataFrame with a session."""
    rows = sorted({(i.name, n.name, n.kind, _cluster(n.name)) for n in bfs_upstream(outputs) for i in n.inputs})
    return spark.createDataFrame(rows, "src string, dst string, kind string, cluster string") if spark else rows


def to_dot(outputs: Iterable[Node], title: str = "graph") -> str:
    """Graphviz text: clusters by the part of a name before its first dot, all in sorted order."""

    def quoted(s: str) -> str:
        return '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'

    outputs = list(outputs)
    nodes = {n.name: n for n in bfs_upstream(outputs)}
    lines = [f"digraph {quoted(title.replace('/', '_'))} {{", "  rankdir=LR;"]
    for cluster in sorted({_cluster(n) for n in nodes}):
        inside = "    " if cluster else "  "
        if cluster:
            lines += [f"  subgraph {quoted('cluster_' + cluster.replace('/', '_'))} {{", f"    label={quoted(cluster)};"]
        for name in sorted(n for n in nodes if _cluster(n) == cluster):
            shape, fill = _STYLES.get(nodes[name].kind, _STYLES["Compute"])
            lines.append(f"{inside}{quoted(name)} [shape={shape}, style=filled, fillcolor={fill}];")
        lines += ["  }"] if cluster else []
    lines += [f"  {quoted(a)} -> {quoted(b)};" for a, b, _, _ in edges(outputs)]
    return "\n".join([*lines, "}", ""])


def to_svg(outputs: Iterable[Node], path: str | os.PathLike, title: str = "graph") -> bool:
    """Writes path by the program dot, if it is there; the text stays beside it as .dot where that fails."""
    text = Path(path).with_suffix(".dot")
    text.write_text(to_dot(outputs, title))
    try:
        subprocess.run(["dot", "-Tsvg", str(text), "-o", str(path)], check=True, capture_output=True)
    except (OSError, subprocess.CalledProcessError):
        return False
    text.unlink()
    return True


class Module:
    """A composable part of a graph: wire() takes what it reads and returns its nodes by name; install() runs it once."""

    name = "module"

    def wire(self, inputs: dict[str, Node]) -> dict[str, Node]:
        raise NotImplementedError


class Engine:
    """Outputs with callbacks over a graph: step() runs a recorded stream, one cycle after another, in key order.

    The callbacks run on the driver over streamed rows (toLocalIterator), for small results and tests; a pipeline writes
    Compiled.changes() or uses streaming instead.
    """

    def __init__(self, graph: Graph):
        self.graph = graph
        self.outputs: list[tuple[Node, Callable]] = []
        self.installed: dict[str, dict[str, Node]] = {}
        self.cycles = self.fired = 0

    def install(self, module: Module, inputs: dict[str, Node]) -> dict[str, Node]:
        if module.name not in self.installed:
            self.installed[module.name] = module.wire(inputs)
        return self.installed[module.name]

    def add_output(self, node: Node, callback: Callable) -> None:
        self.outputs.append((node, callback))

    def step(self) -> None:
        compiled = self.graph.compile(*[n for n, _ in self.outputs])
        self.cycles += compiled.df.count()
        for node, callback in self.outputs:
            for row in compiled.changes(node).orderBy(self.graph.key, self.graph.seq).toLocalIterator():
                callback(*row)
                self.fired += 1


def memoized(df: DataFrame, inputs: list[str], name: str, fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """df with a column that fn adds to the distinct inputs only: computed once for each, then joined back by value."""
    distinct = df.select(*inputs).distinct()
    cached = fn(distinct).select(*[F.col(c).alias(f"__{c}") for c in inputs], name)
    test = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in inputs]
    joined = df.join(cached, test, "left")
    return joined.select(*df.columns, name)


def memo_stats(df: DataFrame, inputs: list[str]) -> DataFrame:
    """(rows, misses, hits) of a cache over the inputs."""
    groups = df.groupBy(*inputs).agg(F.count("*").alias("n"))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.count("*").alias("misses"),
        F.coalesce(F.sum("n") - F.count("*"), F.lit(0)).alias("hits"),
    )
