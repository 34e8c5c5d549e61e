"""Errors of graph building, derivatives and state."""


class InvalidArgument(ValueError):
    """A node was given a parameter outside its domain."""


class DomainError(ArithmeticError):
    """A derivative or a call was asked across a node that has none (a barrier)."""


class LogicError(RuntimeError):
    """Misuse of an object, such as a cycle in a graph or a call with the wrong number of roots."""


class StateError(RuntimeError):
    """A state snapshot that is malformed, of another version or lacks a key."""
