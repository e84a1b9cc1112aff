"""Memory of Python workers, which stay alive between tasks and stages of one executor."""

from __future__ import annotations

import ctypes
import inspect

import pyarrow as pa


def release() -> None:
    """Returns freed memory to the system, as far as the platform's allocator offers it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(fn):
    """The function of one, two or three arguments, with ``release`` after each call (Spark counts the arguments)."""
    def after(*args):
        try:
            return fn(*args)
        finally:
            release()

    n = len(inspect.signature(fn).parameters)
    return {1: lambda a: after(a), 2: lambda a, b: after(a, b), 3: lambda a, b, c: after(a, b, c)}[n]
