"""Looking for many words in many texts.

One text after the other, every word costs a walk over the text byte by byte. A batch of texts as one run of bytes is
searched word by word instead, with steps as long as the word.
"""

from __future__ import annotations

from collections.abc import Collection, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F


def _finder(words: Collection[str]):
    """A function that tells of a batch of texts how often every word stands in each, without overlaps. It is sent to the
    workers with all it needs. A line break ends each text, so words must hold none."""
    assert all(word.isascii() and "\n" not in word for word in words)
    asked = [word.encode() for word in words]

    def times(texts: pa.Array):
        none, end = (pa.scalar(x, pa.large_string()) for x in ("", "\n"))
        rows = pc.binary_join_element_wise(pc.fill_null(texts.cast(pa.large_string()), none), none, end)
        ends = np.cumsum(pc.binary_length(rows).to_numpy(zero_copy_only=False))
        run = rows.buffers()[2].to_pybytes() if len(rows) else b""
        for word in asked:
            places, at = [], run.find(word)
            while at >= 0:
                places.append(at)
                at = run.find(word, at + len(word))
            yield np.bincount(np.searchsorted(ends, places, "right"), minlength=len(ends)) if places else None

    return times


def _named(what: str, words: Collection[str]) -> str:
    """A name that tells in a plan which words are looked for, and so how often."""
    return f"{what} of {', '.join(words)}"


def word_points(text: Column, groups: Mapping[str, Collection[str]], points: int, ceiling: int) -> Column:
    """A struct with the points of each group of ASCII words: so many a place, up to a ceiling for each word."""
    sizes = {name: len(words) for name, words in groups.items()}
    times = _finder([word for words in groups.values() for word in words])

    def total(texts: pa.Array) -> pa.Array:
        counts, columns = times(texts), []
        for size in sizes.values():
            column = np.zeros(len(texts), np.int32)
            for _ in range(size):
                found = next(counts)
                if found is not None:
                    column += np.minimum(found * points, ceiling).astype(np.int32)
            columns.append(pa.array(column))
        return pa.StructArray.from_arrays(columns, list(sizes))

    total.__name__ = _named("points", [word for words in groups.values() for word in words])
    return F.arrow_udf(total, ", ".join(f"{name} int" for name in sizes))(text)


def words_within(text: Column, bits: Mapping[str, int]) -> Column:
    """A long whose bits tell which of the ASCII words stand in the text."""
    places, times = list(bits.values()), _finder(bits)

    def within(texts: pa.Array) -> pa.Array:
        column = np.zeros(len(texts), np.int64)
        for place, found in zip(places, times(texts)):
            if found is not None:
                column |= (found > 0).astype(np.int64) << place
        return pa.array(column)

    within.__name__ = _named("within", bits)
    return F.arrow_udf(within, "long")(text)
