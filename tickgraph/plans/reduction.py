"""A part of a graph as a function: values, gradients and Jacobians at trial points, and solvers over it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import DomainError, InvalidArgument, LogicError
from ..functions.ieee import div, zmul
from ..operators.nodes import Node
from .graph import topological


class Reduction:
    """f(args) = roots, where all that no argument reaches is a constant: the row's own column.

    A stateful node on the way is its last update with another sample. Nothing in the stream moves.
    """

    def __init__(self, roots: Node | Sequence[Node], args: Sequence[Node]):
        self.roots = [roots] if isinstance(roots, Node) else list(roots)
        self.args = list(args)
        if not self.roots or not self.args or any(n is None for n in [*self.roots, *self.args]):
            raise InvalidArgument("at least one root and one argument are needed")
        if len({id(a) for a in self.args}) < len(self.args):
            raise InvalidArgument("an argument is given twice")
        order = topological(self.roots)
        moved = {id(a) for a in self.args}
        self.steps: list[Node] = []
        for n in order:
            if id(n) not in moved and any(id(i) in moved for i in n.inputs):
                if n.partials(*[i.column for i in n.inputs]) is not None and all(
                    p is None for i, p in zip(n.inputs, n.partials(*[i.column for i in n.inputs]), strict=True) if id(i) in moved
                ) and not n.as_step():
                    continue
                if not n.as_step():
                    raise DomainError(f"{n.name} cannot be called and lies between {self.roots[0].name} and an argument")
                moved.add(id(n))
                self.steps.append(n)

    @property
    def arity(self) -> int:
        return len(self.args)

    def argument(self, i: int) -> Column:
        """The value that argument i has in the row."""
        return self.args[i].column

    def _run(self, xs: Sequence[Column]) -> dict[int, Column]:
        if len(xs) != len(self.args):
            raise LogicError(f"{len(self.args)} values are needed, not {len(xs)}")
        at = {id(a): x for a, x in zip(self.args, xs, strict=True)}
        for n in self.steps:
            at[id(n)] = n.apply(*[at.get(id(i), i.column) for i in n.inputs])
        return at

    def __call__(self, *xs: Column) -> Column | list[Column]:
        at = self._run(xs)
        out = [at.get(id(r), r.column) for r in self.roots]
        return out[0] if len(out) == 1 else out

    def _local(self, at: dict[int, Column], node: Node) -> list[Column | None]:
        slopes = node.partials(*[at.get(id(i), i.column) for i in node.inputs])
        if slopes is None:
            raise DomainError(f"{node.name} has no derivative")
        return slopes

    def _reverse(self, at: dict[int, Column], root: Node) -> list[Column]:
        adjoint = {id(root): F.lit(1.0)}
        for n in reversed(self.steps):
            if id(n) in adjoint:
                for i, slope in zip(n.inputs, self._local(at, n), strict=True):
                    if slope is not None and id(i) in at:
                        term = zmul(slope, adjoint[id(n)])
                        adjoint[id(i)] = adjoint[id(i)] + term if id(i) in adjoint else term
        return [adjoint.get(id(a), F.lit(0.0)) for a in self.args]

    def _forward(self, at: dict[int, Column], arg: Node) -> list[Column]:
        tangent = {id(arg): F.lit(1.0)}
        for n in self.steps:
            total = None
            for i, slope in zip(n.inputs, self._local(at, n), strict=True):
                if slope is not None and id(i) in tangent:
                    term = zmul(slope, tangent[id(i)])
                    total = term if total is None else total + term
            if total is not None:
                tangent[id(n)] = total
        return [tangent.get(id(r), F.lit(0.0)) for r in self.roots]

    def gradient(self, *xs: Column) -> tuple[Column, list[Column]]:
        """Value and gradient of the one root."""
        if len(self.roots) != 1:
            raise LogicError("a gradient has one root; use jacobian")
        at = self._run(xs)
        return at.get(id(self.roots[0]), self.roots[0].column), self._reverse(at, self.roots[0])

    def jacobian(self, *xs: Column) -> tuple[list[Column], list[list[Column]]]:
        """Values, and a row of derivatives for each root; swept forwards if there are fewer arguments than roots."""
        at = self._run(xs)
        values = [at.get(id(r), r.column) for r in self.roots]
        if len(self.args) < len(self.roots):
            by_arg = [self._forward(at, a) for a in self.args]
            return values, [list(row) for row in zip(*by_arg, strict=True)]
        return values, [self._reverse(at, r) for r in self.roots]


def newton(f: Reduction, target, start, steps: int) -> Column:
    """The argument at which f is the target, after so many Newton steps from the start: one loop inside the row."""
    target = target if isinstance(target, Column) else F.lit(float(target))
    start = start if isinstance(start, Column) else F.lit(float(start))

    def step(x: Column, _: Column) -> Column:
        value, (slope,) = f.gradient(x)
        return x - div(value - target, slope)

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start.cast("double"), step)


def gauss_newton(residuals: Reduction, start: Sequence[Column], steps: int = 1) -> list[Column]:
    """Two arguments that make the sum of squared residuals least; exact after one step where they are linear."""
    if residuals.arity != 2:
        raise LogicError("two arguments are supported")
    xs = [s.cast("double") for s in start]
    for _ in range(steps):
        r, j = residuals.jacobian(*xs)

        def dot(a: list[Column], b: list[Column]) -> Column:
            total = F.lit(0.0)
            for p, q in zip(a, b, strict=True):
                total = total + p * q
            return total

        u, v = [row[0] for row in j], [row[1] for row in j]
        uu, uv, vv, ur, vr = dot(u, u), dot(u, v), dot(v, v), dot(u, r), dot(v, r)
        det = uu * vv - uv * uv
        xs = [xs[0] - div(vv * ur - uv * vr, det), xs[1] - div(uu * vr - uv * ur, det)]
    return xs


class ReductionNode(Node):
    """A solver as a node: fn(reduction, *inputs) gives its column. A barrier for derivatives."""

    eager = True

    def __init__(self, name: str, roots, args: Sequence[Node], inputs: Sequence[Node], fn: Callable):
        self.reduction = Reduction(roots, args)
        super().__init__(name, [*self.reduction.roots, *self.reduction.args, *inputs])
        self.skip, self.fn = len(self.reduction.roots) + len(args), fn

    def apply(self, *xs):
        return self.fn(self.reduction, *xs[self.skip :])
