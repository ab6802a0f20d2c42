"""What a Python worker keeps between batches: one operator's model and word cache at a time.

Workers outlive stages. If every operator kept its own caches, a worker that has run several stages would hold all of
them; here the next operator's object takes the place of the last one's.
"""

from __future__ import annotations

import gc
from collections.abc import Callable
from typing import Any

_held: list[tuple[str, Any]] = []


def held(key: str, make: Callable[[], Any]) -> Any:
    if not _held or _held[0][0] != key:
        _held.clear()
        gc.collect()
        _held.append((key, make()))
    return _held[0][1]
