"""Sizes at which an operator changes its way of working.

None of them changes a result: beyond a limit the same rows are computed by a
plan that needs no broadcast and puts no unbounded group into one task.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Limits:
    # rows a broadcast side may have; checked by a count before every broadcast
    broadcast_rows: int = 100_000
    # time buckets a timeline is cut into at most
    buckets: int = 100_000
    # intervals that may share one time bucket of a broadcast range join
    candidates: int = 256
    # rows of one ordered group that a single task may walk through
    rows_per_task: int = 5_000_000
    # scores of one window that may be sorted as an array in memory
    rows_in_memory: int = 1_000_000
    # pieces a key is spread over when its partner is too large to broadcast
    salts: int = 256
    # common steps in the shortest window up to which rows are summed per step
    steps_per_window: int = 32


DEFAULT_LIMITS = Limits()
