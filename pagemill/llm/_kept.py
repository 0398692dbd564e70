"""Objects that a Python worker keeps from task to task, and lets go of when it has been idle for a while."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import threading
import time
from collections.abc import Callable, Iterator

_KEPT: dict[tuple, object] = {}
_USED = [0.0, 0]
IDLE_S = 2.0
_LOCK = threading.Lock()


def _release(at: float) -> None:
    time.sleep(IDLE_S)
    with _LOCK:
        idle = _USED == [at, 0]
        if idle:
            _KEPT.clear()
    if idle:
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL("libc.so.6").malloc_trim(0)


@contextlib.contextmanager
def kept(key: tuple, make: Callable[[], object]) -> Iterator[object]:
    """The object of ``key``, made if there is none; it replaces those of other keys. One task uses it at a time."""
    with _LOCK:
        if key not in _KEPT:
            _KEPT.clear()
            _KEPT[key] = make()
        own = _KEPT[key]
        _USED[1] += 1
    try:
        yield own
    finally:
        with _LOCK:
            _USED[:] = time.monotonic(), _USED[1] - 1
        threading.Thread(target=_release, args=(_USED[0],), daemon=True).start()
