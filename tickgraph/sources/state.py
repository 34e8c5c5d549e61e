"""Snapshots of the state of stateful nodes: in memory, or a JSON file {version, saved_at, nodes}."""

from __future__ import annotations

import json
import os
import warnings
from datetime import datetime, timezone
from pathlib import Path
from typing import Any

from ..errors import StateError

VERSION = 1
_SCALARS = (bool, int, float)


class Bag:
    """Typed values of one node by name; sub() nests. Only numbers, booleans and lists of numbers are kept."""

    def __init__(self, data: dict[str, Any] | None = None):
        self.data = {} if data is None else data

    def put(self, name: str, value) -> None:
        if not (value is None or isinstance(value, _SCALARS) or isinstance(value, list)):
            raise StateError(f"{name}: {type(value).__name__} cannot be kept")
        self.data[name] = value

    def get(self, name: str):
        if name not in self.data:
            raise StateError(f"no value {name}")
        return self.data[name]

    def sub(self, name: str, make: bool = True) -> Bag:
        if name not in self.data:
            if not make:
                raise StateError(f"no part {name}")
            self.data[name] = {}
        return Bag(self.data[name])


class InMemoryStateStore:
    def __init__(self):
        self.nodes: dict[str, dict[str, Any]] | None = None

    def save(self, states: dict[str, dict[str, Any]]) -> None:
        self.nodes = json.loads(json.dumps(states))

    def restore(self, states: dict[str, dict[str, Any]]) -> bool:
        """Puts what was saved into the states of the same names; a node that was not saved stays as it is."""
        if self.nodes is None:
            return False
        for name, state in states.items():
            if name in self.nodes:
                state.clear()
                state.update(json.loads(json.dumps(self.nodes[name])))
            else:
                warnings.warn(f"no saved state of {name}", stacklevel=2)
        return True

    def has_saved_state(self) -> bool:
        return self.nodes is not None

    def reset(self) -> None:
        self.nodes = None


class JsonFileStateStore(InMemoryStateStore):
    """The same in a file that is replaced at once. Engine states of a driver; streams keep theirs in checkpoints."""

    def __init__(self, path: str | os.PathLike):
        super().__init__()
        self.path = Path(path)

    def save(self, states):
        text = json.dumps({"version": VERSION, "saved_at": datetime.now(timezone.utc).isoformat(), "nodes": states})
        other = self.path.with_suffix(self.path.suffix + ".tmp")
        other.write_text(text)
        os.replace(other, self.path)

    def restore(self, states):
        if not self.path.exists():
            return False
        try:
            saved = json.loads(self.path.read_text())
            version, self.nodes = saved["version"], saved["nodes"]
        except (ValueError, KeyError, TypeError) as e:
            raise StateError(f"{self.path} is no state file") from e
        if version != VERSION:
            raise StateError(f"version {version} is not {VERSION}")
        return super().restore(states)

    def has_saved_state(self):
        return self.path.exists()

    def reset(self):
        self.path.unlink(missing_ok=True)
