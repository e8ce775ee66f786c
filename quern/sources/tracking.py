"""Trackers that runs report to; the default does nothing."""

from __future__ import annotations

import functools
import json
from collections.abc import Callable, Mapping
from typing import Any, Protocol

from pyspark.sql import SparkSession

from quern.runtime import write_text


class Tracker(Protocol):
    def start(self, name: str, config: Mapping[str, Any]) -> None: ...

    def log(self, metrics: Mapping[str, Any], step: int | None = None) -> None: ...

    def artifact(self, path: str, kind: str) -> None: ...

    def finish(self) -> None: ...


class NoTracker:
    def start(self, name: str, config: Mapping[str, Any]) -> None: ...

    def log(self, metrics: Mapping[str, Any], step: int | None = None) -> None: ...

    def artifact(self, path: str, kind: str) -> None: ...

    def finish(self) -> None: ...


class FolderTracker:
    """Writes what a run reports as JSON Lines to a folder, when it ends."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder, self.lines = spark, folder, []

    def _say(self, kind: str, **what: Any) -> None:
        self.lines.append(json.dumps({"kind": kind} | what, ensure_ascii=False, default=str))

    def start(self, name: str, config: Mapping[str, Any]) -> None:
        self._say("start", name=name, config=dict(config))

    def log(self, metrics: Mapping[str, Any], step: int | None = None) -> None:
        self._say("metrics", step=step, metrics=dict(metrics))

    def artifact(self, path: str, kind: str) -> None:
        self._say("artifact", path=path, type=kind)

    def finish(self) -> None:
        write_text(self.spark, f"{self.folder}/tracking.jsonl", "".join(f"{x}\n" for x in self.lines))


class ServiceTracker:
    """A tracking service's client module, which must be installed: it has init, log, Artifact and finish, as wandb has."""

    def __init__(self, project: str, module: str = "wandb") -> None:
        self.project, self.module, self.run = project, module, None

    def start(self, name: str, config: Mapping[str, Any]) -> None:
        import importlib

        self.service = importlib.import_module(self.module)
        self.run = self.service.init(project=self.project, name=name, config=dict(config))

    def log(self, metrics: Mapping[str, Any], step: int | None = None) -> None:
        self.run.log(dict(metrics), step=step)

    def artifact(self, path: str, kind: str) -> None:
        item = self.service.Artifact(path.rsplit("/", 1)[-1], type=kind)
        item.add_file(path)
        self.run.log_artifact(item)

    def finish(self) -> None:
        if self.run is not None:
            self.run.finish()


def traced(begin: Callable[[], Callable[[Callable], Callable]]) -> Callable[[Callable], Callable]:
    """A decorator that wraps a function by what ``begin`` gives, which is called once, when the function is called first."""

    def decorate(function: Callable) -> Callable:
        held: list[Callable] = []

        @functools.wraps(function)
        def call(*args: Any, **more: Any) -> Any:
            if not held:
                held.append(begin()(function))
            return held[0](*args, **more)

        return call

    return decorate
