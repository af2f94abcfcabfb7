"""Python workers give freed memory back to the system.

Spark keeps its workers from stage to stage. The C library raises the size from which it maps
blocks on their own whenever such a block is freed, so that numpy columns soon live in a heap that
only grows, and Arrow's own pool holds on to what it had. Both count against the executor
while another stage runs.
"""

from __future__ import annotations

import ctypes

#: Blocks from this size on are mapped on their own and unmapped when freed. The codes are the C library's.
MAPPED_BYTES = 2 << 20
_TRIM_THRESHOLD, _MMAP_THRESHOLD = -1, -3
_done: list[bool] = []


def give_back() -> None:
    """Sets the thresholds of this process, once; without effect where the C library has no such call."""
    if _done:
        return
    _done.append(True)
    import pyarrow as pa

    pa.set_memory_pool(pa.system_memory_pool())
    mallopt = getattr(ctypes.CDLL(None), "mallopt", None)
    if mallopt is not None:
        mallopt(_MMAP_THRESHOLD, MAPPED_BYTES)
        mallopt(_TRIM_THRESHOLD, MAPPED_BYTES)


def trim() -> None:
    """Gives back what is free in the heap too, after large things were dropped."""
    import gc

    gc.collect()
    malloc_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if malloc_trim is not None:
        malloc_trim(0)
