"""Times of stages and counters of one run, kept on the driver."""

from __future__ import annotations

import logging
import time
from collections.abc import Iterator
from contextlib import contextmanager

log = logging.getLogger("segmill")


class Run:
    """``with run.stage("fit"): ...`` adds the seconds to a stage; ``run.count("models", n)`` adds to a counter."""

    def __init__(self) -> None:
        self.seconds: dict[str, float] = {}
        self.counters: dict[str, int] = {}

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - began

    def count(self, name: str, n: int = 1) -> None:
        self.counters[name] = self.counters.get(name, 0) + n

    def rows(self) -> list[tuple[str, float]]:
        """Stages in the order in which they began, with their seconds, and the total."""
        return [*self.seconds.items(), ("total", sum(self.seconds.values()))]

    def report(self) -> str:
        text = "; ".join([*(f"{k} {v:.2f} s" for k, v in self.rows()), *(f"{k} {n}" for k, n in self.counters.items())])
        log.info(text)
        return text
