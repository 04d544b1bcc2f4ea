"""Consolidation by the clock: an interval's name, and a loop that outlives a failed run."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable

#: Seconds of the schedules that a configuration can name.
INTERVALS = {"hourly": 3600.0, "daily": 86_400.0, "weekly": 604_800.0}


def interval(schedule: str) -> float:
    """Seconds between runs; an unknown name is an error that lists the known ones."""
    name = schedule.strip().lower()
    if name not in INTERVALS:
        raise ValueError(f"schedule {schedule!r} is not one of {', '.join(INTERVALS)}")
    return INTERVALS[name]


def run_every(schedule: str, run: Callable[[], None], sleep: Callable[[float], bool], enabled: bool = True) -> int:
    """Call ``run`` once a period, the first time a period from now, until ``sleep`` gives False; a failed run is logged and the next one tried.

    Gives the number of runs. A run is never broken off: the loop ends between runs.
    """
    done = 0
    if not enabled:
        return done
    while sleep(interval(schedule)):
        try:
            run()
        except Exception:
            logging.getLogger(__name__).exception("a scheduled run failed")
        done += 1
    return done


def in_batches(batches: list, apply: Callable[[object], None], seconds: float, clock: Callable[[], float] = time.monotonic) -> tuple[int, str | None]:
    """(how many batches were done, why it stopped): batches in order until ``seconds`` have passed; 0 means no limit. The time is looked at after each batch."""
    began = clock()
    for i, batch in enumerate(batches):
        if seconds and i and clock() - began >= seconds:
            return i, "seconds"
        apply(batch)
    return len(batches), None
