"""What several operators share: word counts, and tables kept between jobs."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ledgerleaf.session import shared_dir

SPACE = r"\x20\x09-\x0D"
WORD = f"[^{SPACE}]+"
T = TypeVar("T")


def stored(rows: DataFrame, name: str) -> DataFrame:
    """Write rows to a fresh folder below `spark.checkpoint.dir` and read them from there. What
    follows no longer depends on any executor, and reads only the columns it needs."""
    folder = shared_dir(rows.sparkSession, name)
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int]:
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda _: 0


def frugal(task: Callable) -> Callable:
    """A function for mapInArrow or applyInArrow that gives free memory back to the system at its end: worker processes
    wait for further tasks, and what one operator needed is not the next one's."""
    def give_back() -> None:
        pa.default_memory_pool().release_unused()
        _trim()(0)

    def done(out):
        if isinstance(out, Iterator):
            return then(out)
        give_back()
        return out

    def then(out: Iterator) -> Iterator:
        yield from out
        give_back()

    if task.__code__.co_argcount == 2:
        return lambda left, right: done(task(left, right))
    return lambda given: done(task(given))


_REMEMBERED: dict = {}


def remembered(key: tuple, make: Callable[[], T]) -> T:
    """What a worker process keeps between tasks, for one operator at a time: asking for another drops it, so
    workers that serve several stages hold the memory of one."""
    if key not in _REMEMBERED:
        _REMEMBERED.clear()
        _REMEMBERED[key] = make()
    return _REMEMBERED[key]


def word_count(text: Column) -> Column:
    """Words of a text as long; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
