"""Workers outlive their tasks; what these have freed goes back to the system, so that it doesn't add up beside later stages."""

from __future__ import annotations

import ctypes
import inspect
from collections.abc import Callable
from functools import wraps

import pyarrow as pa

#: Bytes by which a worker may grow before it gives back what it has freed.
SLACK = 128 << 20
_least = [1 << 62]


def _resident() -> int:
    try:
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096
    except OSError:  # not everywhere
        return 0


def release() -> None:
    """Gives freed memory back to the system if the worker has grown since it did so."""
    now = _resident()
    _least[0] = min(_least[0], now)
    if now < _least[0] + SLACK:
        return
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library may have none
    if trim is not None:
        trim(0)
    _least[0] = _resident()


def tidy(f: Callable) -> Callable:
    """A function of batches or groups that gives memory back once it is done."""
    if inspect.isgeneratorfunction(f):

        @wraps(f)
        def run(*args):
            try:
                yield from f(*args)
            finally:
                release()
    else:

        @wraps(f)
        def run(*args):
            try:
                return f(*args)
            finally:
                release()

    run.__signature__ = inspect.signature(f)  # Spark looks at the number of arguments
    return run
