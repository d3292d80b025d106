"""Pipelines of named stages with conditional edges, run on a state that holds lazy DataFrames."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

log = logging.getLogger("lectern")


@dataclass
class State:
    """Tables by name, and errors; a stage that adds an error ends the run."""

    tables: dict[str, Any] = field(default_factory=dict)
    errors: list[str] = field(default_factory=list)


@dataclass
class Result:
    state: State
    status: dict[str, str]  # pending, running, completed, failed
    path: list[str]
    error: str | None = None


Stage = Callable[[State], State]
Condition = Callable[[State], bool]


class Pipeline:
    def __init__(self, name: str) -> None:
        self.name, self.stages, self.edges = name, {}, []  # type: ignore[var-annotated]
        self.first: str | None = None
        self.last: set[str] = set()
        self.status: dict[str, str] = {}

    def _known(self, name: str) -> str:
        if name not in self.stages:
            raise ValueError(f"no stage named {name}")
        return name

    def stage(self, name: str, function: Stage) -> Pipeline:
        self.stages[name], self.status[name] = function, "pending"
        return self

    def edge(self, source: str, target: str, condition: Condition | None = None) -> Pipeline:
        self.edges.append((self._known(source), self._known(target), condition))
        return self

    def start(self, name: str) -> Pipeline:
        self.first = self._known(name)
        return self

    def end(self, name: str) -> Pipeline:
        self.last.add(self._known(name))
        return self

    def following(self, name: str, state: State) -> list[str]:
        """Stages after name whose condition holds, in the order in which edges were added."""
        return [t for s, t, c in self.edges if s == name and (c is None or c(state))]

    def run(self, state: State, start: str | None = None) -> Result:
        """Runs from the start; of several following stages the first is taken."""
        name = start or self.first
        if name is None:
            raise ValueError("no start")
        path: list[str] = []
        while name is not None:
            self.status[self._known(name)] = "running"
            path.append(name)
            try:
                state = self.stages[name](state)
            except Exception as e:
                log.exception("stage %s", name)
                state.errors.append(f"{name} failed: {e}")
            if state.errors:
                self.status[name] = "failed"
                return Result(state, dict(self.status), path, state.errors[-1])
            self.status[name] = "completed"
            name = None if name in self.last else next(iter(self.following(name, state)), None)
        return Result(state, dict(self.status), path)

    def reset(self) -> None:
        self.status = dict.fromkeys(self.stages, "pending")

    def render(self) -> str:
        """Stages, their status and edges as text."""
        out = [f"Pipeline: {self.name}"]
        for n in self.stages:
            to = ", ".join(t + ("?" if c else "") for s, t, c in self.edges if s == n)
            out.append(f"  [{self.status[n]}] {n}" + (f" -> {to}" if to else "") + " (start)" * (n == self.first) + " (end)" * (n in self.last))
        return "\n".join(out)


def chain(name: str, stages: list[tuple[str, Stage]]) -> Pipeline:
    """A pipeline of stages one after the other."""
    p = Pipeline(name)
    for n, f in stages:
        p.stage(n, f)
    for (a, _), (b, _) in zip(stages[:-1], stages[1:], strict=True):
        p.edge(a, b)
    return p.start(stages[0][0]).end(stages[-1][0])
