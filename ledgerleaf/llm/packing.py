"""Packing pieces of documents into sequences under several limits at once.

Vector bin packing by the dot-product heuristic: one sequence is open at a time; of the pieces that still
fit under every limit, the one goes in whose needs point most towards the room that is left (needs and
room as shares of the limits, limits weighted by how much of them all pieces need). When none fits, the
next sequence opens. Pieces are dealt out evenly to groups of about GROUP pieces, each packed by one task.

Documents are cut so that a piece keeps below the limits of length and of loss: the first `masked` ids of a document
(its prompt, in instruction data) bear no loss, nor does the first id of a piece, which nothing in it precedes.

Defined cases: a null text is an empty document, which still has its end token; a piece that alone is
above a limit gets a sequence of its own, nothing is dropped; repeated rows are packed each; an empty
table gives an empty result; columns other than the named ones play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerleaf.llm.common import frugal, stored
from ledgerleaf.llm.tokens import chunk_ids, in_portions, vocabulary

#: Pieces that one task packs at a time.
GROUP = 1_000


def cuts(n: int, length: int, masked: int = 0, loss: int | None = None) -> list[tuple[int, int, int]]:
    """Start, length and loss-bearing ids of the pieces of n ids: each as long as `length` and `loss` allow."""
    out, at = [], 0
    while at < n:
        free = max(masked - at, 1)  # at the head of the piece, without loss
        size = min(length, n - at, length if loss is None else free + loss)
        out.append((at, size, max(size - free, 0)))
        at += size
    return out


def cut_documents(docs: DataFrame, path: str, length: int, end_id: int, masked: int = 0, loss: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of every text, then `end_id`, cut into pieces. One row per piece: doc_id, start,
    length, ids_crc32 (of its ids as little-endian unsigned 32-bit numbers), doc_tokens, segments (1) and loss_tokens."""
    spec = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    end = int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = chunk_ids(spec.value)
        for batch in batches:
            at, rows = [], []
            done = 0
            for portion in in_portions(x.as_py() for x in batch.column(1)):
                for text_ids in encoder.encode(portion):
                    ids = text_ids + end
                    for start, size, bears in cuts(len(ids) // 4, length, masked, loss):
                        at.append(done)
                        rows.append((start, size, zlib.crc32(ids[4 * start:4 * (start + size)]), len(ids) // 4, 1, bears))
                    done += 1
            if rows:
                columns = [pa.array(x, pa.int64()) for x in zip(*rows)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *columns], names=names)

    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "segments", "loss_tokens"]
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{name} long" for name in names[1:])
    return docs.select(id_col, text_col).mapInArrow(frugal(cut), schema)


def pack_group(needs: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence of each piece and its place in the order of filling."""
    n = len(needs)
    shares = needs / limits
    weight = shares.mean(axis=0)
    rest = np.lexsort(tuple(-shares.T[::-1]))
    sequence, place = np.zeros(n, "int64"), np.zeros(n, "int64")
    room, now, filled = limits.astype("int64").copy(), 0, 0
    for step in range(n):
        fits = (needs[rest] <= room).all(axis=1)
        if not fits.any():
            if filled:
                room, now, filled = limits.astype("int64").copy(), now + 1, 0
                fits = (needs[rest] <= room).all(axis=1)
            if not fits.any():  # alone above a limit
                fits[0] = True
        score = np.where(fits, shares[rest] @ (weight * np.maximum(room, 0) / limits), -1.0)
        best = int(score.argmax())
        piece = rest[best]
        rest = np.delete(rest, best)
        sequence[piece], place[piece] = now, step
        room, filled = room - needs[piece], filled + 1
    return sequence, place


def pack(pieces: DataFrame, limits: dict[str, int], size: str) -> DataFrame:
    """Add sequence_id and offset (gapless within the sequence, in units of `size`) to every piece.

    `limits` gives the most of each numeric column in one sequence, `size` is one of them.
    """
    names = list(limits)
    pieces = stored(pieces.withColumn("_row", F.monotonically_increasing_id()), "pack-pieces")
    groups = -(-pieces.count() // GROUP) or 1
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups)).cast("long"))
    kept = [c for c in pieces.columns if c != "_row"]

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_row", ignore_index=True)
        sequence, place = pack_group(rows[names].to_numpy("int64"), np.array([limits[x] for x in names], "int64"))
        rows["sequence_id"] = rows["_group"] * (1 << 24) + sequence
        rows = rows.assign(_place=place).sort_values("_place", ignore_index=True)
        rows["offset"] = rows.groupby("sequence_id")[size].cumsum() - rows[size]
        return rows[[*kept, "sequence_id", "offset"]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name in kept)
    return dealt.groupBy("_group").applyInPandas(fill, schema + ", sequence_id long, offset long")
