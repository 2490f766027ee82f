"""Independent driver-side jobs side by side."""
from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

WORKERS = 5


def ordered_map(f: Callable, items: Iterable, workers: int = WORKERS) -> list:
    """f of each item, in the order of the items, so many at a time; the first error is raised."""
    with ThreadPoolExecutor(workers) as pool:
        return list(pool.map(f, items))
