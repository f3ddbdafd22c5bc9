"""Peak memory of a stage: what the workers of its jobs note into an accumulator, and what the driver's Python allocates.

Inside `watched`, folds and predictions that are built note the memory of their process after every batch or state;
outside of it nothing is noted. Threads watch their own stages.
"""

import os
import threading
import tracemalloc
from contextlib import contextmanager

from pyspark.accumulators import AccumulatorParam

class _Stage(threading.local):
    """What the thread is watching. Worker code carries this module along, and begins with nothing."""

    accumulator = None

    def __reduce__(self):
        return _Stage, ()


class _Tracing:
    """Tracing allocations is one switch for the whole driver: stages that need it."""

    def __init__(self):
        self.lock, self.stages = threading.Lock(), 0

    def __reduce__(self):
        return _Tracing, ()


_STAGE, _TRACED = _Stage(), _Tracing()


class Largest(AccumulatorParam):
    def zero(self, value):
        return 0.0

    def addInPlace(self, one, other):
        return max(one, other)


def resident_mb():
    """Memory of this process as the system counts it, or 0 where it does not say."""
    try:
        with open("/proc/self/statm") as file:
            return int(file.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / (1 << 20)
    except OSError:
        return 0.0


def watcher():
    """A function for worker code that notes the memory of its process for the stage being watched."""
    accumulator = _STAGE.accumulator

    def note():
        if accumulator is not None:
            accumulator.add(resident_mb())

    return note


@contextmanager
def watched(spark):
    """Gives a function that returns the MB of the largest worker, or of the driver's Python if that was more, so far."""
    outer, own = _STAGE.accumulator, spark.sparkContext.accumulator(0.0, Largest())
    _STAGE.accumulator = own
    with _TRACED.lock:
        _TRACED.stages += 1
        if not tracemalloc.is_tracing():
            tracemalloc.start()
        elif _TRACED.stages == 1:
            tracemalloc.reset_peak()
    try:
        yield lambda: max(own.value, tracemalloc.get_traced_memory()[1] / (1 << 20))
    finally:
        _STAGE.accumulator = outer
        with _TRACED.lock:
            _TRACED.stages -= 1
            if not _TRACED.stages:
                tracemalloc.stop()
