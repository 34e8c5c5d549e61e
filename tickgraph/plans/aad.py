"""Algorithmic differentiation: adjoints and tangents as generated columns of a compiled graph."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import DomainError, InvalidArgument
from ..functions.ieee import zmul
from ..operators.nodes import Node
from .graph import bfs_upstream, topological


def _partials(node: Node) -> list[Column | None] | None:
    return node.partials(*[i.column for i in node.inputs])


def _below(nodes: list[Node], targets: Sequence[Node]) -> set[int]:
    """Ids of nodes that a target reaches."""
    moved = {id(t) for t in targets}
    for n in nodes:
        if any(id(i) in moved for i in n.inputs):
            moved.add(id(n))
    return moved


def adjoints(root: Node, wrt: Sequence[Node]) -> list[Column]:
    """d root / d w for each w, by one reverse sweep; 0 where the root does not depend on it.

    DomainError if the only way to a w leads through a node without derivative, whatever its value: never a silent 0.
    """
    if root is None or not wrt or any(w is None for w in wrt):
        raise InvalidArgument("a root and at least one node to differentiate by are needed")
    order = topological([root])
    moved = _below(order, wrt)
    wanted = {id(w) for w in wrt}
    adjoint: dict[int, Column] = {id(root): F.lit(1.0)}
    for node in reversed(order):
        if id(node) not in adjoint or (id(node) in wanted and not _through(node, wrt)):
            continue
        slopes = _partials(node) if node.inputs else []
        if slopes is None:
            reached = [i for i in node.inputs if id(i) in moved]
            if reached:
                raise DomainError(f"{node.name} has no derivative and lies between {root.name} and {reached[0].name}")
            continue
        for i, slope in zip(node.inputs, slopes, strict=True):
            if slope is not None and id(i) in moved:
                term = zmul(slope, adjoint[id(node)])
                adjoint[id(i)] = adjoint[id(i)] + term if id(i) in adjoint else term
    return [adjoint.get(id(w), F.lit(0.0)) for w in wrt]


def _through(node: Node, wrt: Sequence[Node]) -> bool:
    """Whether another w lies above this one."""
    above = {id(n) for n in bfs_upstream(node.inputs)}
    return any(id(w) in above for w in wrt)


def tangents(roots: Sequence[Node], seeds: Sequence[tuple[Node, float | Column]]) -> list[Column]:
    """Sum over seeds of d root / d s * t for each root, by one forward sweep. A seed on an inner node adds to it."""
    if not roots or not seeds or any(s is None for s, _ in seeds):
        raise InvalidArgument("at least one root and one seed are needed")
    order = topological(roots)
    moved = _below(order, [s for s, _ in seeds])
    given: dict[int, Column] = {}
    for s, t in seeds:
        t = t if isinstance(t, Column) else F.lit(float(t))
        given[id(s)] = given[id(s)] + t if id(s) in given else t
    tangent: dict[int, Column] = {}
    for node in order:
        total = given.get(id(node))
        above = [i for i in node.inputs if id(i) in moved]
        if above:
            slopes = _partials(node)
            if slopes is None:
                raise DomainError(f"{node.name} has no derivative and lies below {above[0].name}")
            for i, slope in zip(node.inputs, slopes, strict=True):
                if slope is not None and id(i) in tangent:
                    term = zmul(slope, tangent[id(i)])
                    total = term if total is None else total + term
        if total is not None:
            tangent[id(node)] = total
    return [tangent.get(id(r), F.lit(0.0)) for r in roots]


class GradientNode(Node):
    """An array of d root / d w: it moves with everything above, even while the root stands still. A barrier itself."""

    eager = True

    def __init__(self, name: str, root: Node, wrt: Sequence[Node]):
        super().__init__(name, [root, *wrt])
        self.columns = adjoints(root, wrt)

    def apply(self, *xs):
        return F.array(*self.columns)


class TangentNode(Node):
    """An array of one tangent for each root."""

    eager = True

    def __init__(self, name: str, roots: Sequence[Node], seeds: Sequence[tuple[Node, float]]):
        super().__init__(name, [*roots, *[s for s, _ in seeds]])
        self.columns = tangents(roots, seeds)

    def apply(self, *xs):
        return F.array(*self.columns)
