"""Catching up day by day: which days of a calendar a table lacks, computed in short runs, each committed once.

The table's ledger is the memory: a run of days is a batch named by its first and last day, so a job that was killed goes on behind its last
commit, and a day that is computed again changes nothing.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame

from .versioned import VersionedTable

DAY = datetime.timedelta(days=1)


def done_days(table: VersionedTable) -> set[datetime.date]:
    out: set[datetime.date] = set()
    for _, batch, _ in table.history():
        if batch.startswith("days:"):
            a, b = (datetime.date.fromisoformat(x) for x in batch.split(":")[1:])
            out.update(a + k * DAY for k in range((b - a).days + 1))
    return out


def missing_runs(table: VersionedTable, first: datetime.date, last: datetime.date, step: int) -> list[tuple[datetime.date, datetime.date]]:
    """The days from first to last that the ledger lacks, as runs of at most step neighbouring days."""
    done, runs = done_days(table), []
    for k in range((last - first).days + 1):
        day = first + k * DAY
        if day in done:
            continue
        if runs and runs[-1][1] == day - DAY and (day - runs[-1][0]).days < step:
            runs[-1] = (runs[-1][0], day)
        else:
            runs.append((day, day))
    return runs


def catch_up(table: VersionedTable, compute: Callable[[datetime.date, datetime.date], DataFrame], first: datetime.date, last: datetime.date, step: int = 30, most: int | None = None) -> int:
    """Appends compute(a, b), the rows of days a to b, for each missing run, oldest first; most: only so many runs now. How many runs were committed."""
    runs = missing_runs(table, first, last, step)[:most]
    for a, b in runs:
        table.append(compute(a, b), f"days:{a}:{b}")
    return len(runs)
