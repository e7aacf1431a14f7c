"""A day's steps in order, each tried again after transient failures only."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from millrace.sources.files import PermanentError


@dataclass
class Run:
    """What became of a day: the steps' results and attempts, and the error that ended it."""

    ds: str
    results: dict[str, Any] = field(default_factory=dict)
    attempts: dict[str, int] = field(default_factory=dict)
    error: Exception | None = None

    @property
    def exit_code(self) -> int:
        return 0 if self.error is None else 2 if isinstance(self.error, PermanentError) else 1


def run_day(ds: str, steps: list[tuple[str, Callable[[str, dict], Any]]], retries: int = 2, wait: float = 10.0, sleep: Callable[[float], None] = time.sleep) -> Run:
    """Runs ``steps``, pairs of a name and a function of the day and the results so far. A :class:`PermanentError` ends the day at once; any other failure is tried again ``retries`` times."""
    run = Run(ds)
    for name, step in steps:
        for attempt in range(retries + 1):
            run.attempts[name] = attempt + 1
            try:
                run.results[name] = step(ds, run.results)
                break
            except PermanentError as e:
                run.error = e
                return run
            except Exception as e:  # noqa: BLE001
                if attempt == retries:
                    run.error = e
                    return run
                sleep(wait)
    return run
