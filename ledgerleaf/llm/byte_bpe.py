"""Byte-level BPE over ranks: texts to token ids, ids back to bytes.

A text is cut by the pattern into matches; a match that is a token is that token, any other is merged from
its bytes: always the neighbours whose joined bytes have the lowest rank, leftmost first. The next merge
comes from a rank queue. Every rank has a bucket of positions of a doubly linked list of parts; a hierarchy of
bitmaps (256 bits a word, each level saying which words below are not zero) says which buckets hold something, and
find-first-set on one word a level gives the lowest; its bucket is emptied from left to right unless a merge brings a lower
rank. Merging leaves the entries of its neighbours behind; an entry whose position no longer has a pair of that rank is
stale and skipped. Each merge adds two entries at most, so n bytes cost O(n log n) (the log for the order of positions
within a bucket), however long the match is. Many short matches go through one queue together.

No match goes on beyond the end of a run of characters that are no white space, so texts are cut there first and the ids of short
runs are remembered, up to a fixed number.

Defined cases: a null text is empty and has no ids; null ids decode to no bytes; an id that is not in the vocabulary
is an error; repeated rows are encoded each; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from ledgerleaf.llm.common import frugal, remembered
from ledgerleaf.llm.tokens import in_portions

#: Runs, and matches, whose ids a worker remembers at most, and the longest of them.
REMEMBERED = 500_000
LONGEST = 64
#: Characters of matches that go through one queue, but for a single longer match.
TOGETHER = 500_000

_RUN = regex.compile(r"\s*\S+|\s+")
_BITS = 8
_LOW = (1 << _BITS) - 1


class RankQueue:
    """Buckets of positions by rank, the lowest rank first."""

    def __init__(self, ranks: int):
        self.levels = []
        while True:
            ranks = (ranks >> _BITS) + 1
            self.levels.append([0] * ranks)
            if ranks == 1:
                break
        self.buckets: dict[int, list[int]] = {}

    def open(self, rank: int, positions: list[int]) -> None:
        """A bucket for a rank that has none."""
        self.buckets[rank] = positions
        for level in self.levels:
            word = rank >> _BITS
            before = level[word]
            level[word] = before | 1 << (rank & _LOW)
            if before:  # the levels above know of this word
                break
            rank = word

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.open(rank, [position])
        else:
            bucket.append(position)

    def lowest(self) -> int:
        """The lowest rank with a bucket; -1 if there is none."""
        if not self.levels[-1][0]:
            return -1
        at = 0
        for level in reversed(self.levels):
            word = level[at]
            at = at << _BITS | (word & -word).bit_length() - 1
        return at

    def take(self, rank: int) -> list[int]:
        """The positions of a rank from left to right; its bucket is gone."""
        positions = self.buckets.pop(rank)
        positions.sort()
        for level in self.levels:
            word = rank >> _BITS
            level[word] &= ~(1 << (rank & _LOW))
            if level[word]:
                break
            rank = word
        return positions


class Encoder:
    """Ids of texts for one table of ranks and one pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.two = np.full(1 << 16, -1, "int64")
        for token, rank in ranks.items():
            if len(token) == 2:
                self.two[token[0] << 8 | token[1]] = rank
        self.most = max(ranks.values())
        self.runs: dict[str, bytes] = {}
        self.matches: dict[str, bytes] = {}

    def merged(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of matches that are no tokens of their own. All go through one queue: what is lowest in the queue is, of
        each match, what is lowest in it."""
        blob, ranks, two, queue = b"".join(pieces), self.ranks, self.two, RankQueue(self.most)
        n, buckets, push = len(blob), queue.buckets, queue.open
        end = array("q", range(1, n + 1))  # of the part that starts at each position; the next part starts there
        before = array("q", range(-1, n))  # the start of the part before
        edge = bytearray(n + 1)  # where a match begins
        for at in accumulate(map(len, pieces), initial=0):
            edge[at] = 1
        values = np.frombuffer(blob, "uint8").astype("int64")
        first = np.where(np.frombuffer(edge, "uint8")[1:n] > 0, -1, two[values[:-1] << 8 | values[1:]])
        pair = array("q", first.tobytes() + np.full(min(n, 1), -1, "int64").tobytes())  # rank of the pair whose left part starts here
        places = np.flatnonzero(first >= 0)
        places = places[np.argsort(first[places], kind="stable")]
        cuts = np.flatnonzero(np.diff(first[places])) + 1
        for positions in np.split(places, cuts) if len(places) else ():
            push(int(first[positions[0]]), positions.tolist())
        while (rank := queue.lowest()) >= 0:
            positions = queue.take(rank)
            for done, at in enumerate(positions, 1):
                if pair[at] != rank:
                    continue  # stale
                lower = False
                middle = end[at]
                last = end[at] = end[middle]
                pair[middle] = pair[at] = -1
                if not edge[last]:
                    before[last] = at
                    new = ranks.get(blob[at:end[last]])
                    if new is not None:
                        pair[at] = new
                        lower = new < rank
                        if (bucket := buckets.get(new)) is None:
                            push(new, [at])
                        else:
                            bucket.append(at)
                if not edge[at]:
                    left = before[at]
                    new = ranks.get(blob[left:last])
                    if new is None:
                        pair[left] = -1
                    else:
                        pair[left] = new
                        lower = lower or new < rank
                        if (bucket := buckets.get(new)) is None:
                            push(new, [left])
                        else:
                            bucket.append(left)
                if lower and done < len(positions):  # that goes first
                    push(rank, positions[done:])
                    break
        out, at = [], 0
        for piece in pieces:
            ids, stop = array("I"), at + len(piece)
            while at < stop:
                ids.append(ranks[blob[at:end[at]]])
                at = end[at]
            out.append(ids.tobytes())
        return out

    def _learn(self, runs: list[str]) -> dict[str, bytes]:
        """Ids of runs, as little-endian numbers of 32 bits."""
        split = [self.find(run) for run in runs]
        known: dict[str, bytes] = {}
        new, held = [], 0

        def merge() -> None:
            known.update(zip(new, self.merged([match.encode() for match in new])))
            new.clear()

        for match in set().union(*split):
            ids = self.matches.get(match)
            if ids is None:
                whole = self.ranks.get(match.encode())
                if whole is None:
                    new.append(match)
                    held += len(match)
                    if held >= TOGETHER:
                        merge()
                        held = 0
                    continue
                ids = whole.to_bytes(4, "little")
            known[match] = ids
        merge()
        if len(self.matches) + len(known) > REMEMBERED:
            self.matches.clear()
        self.matches.update((match, ids) for match, ids in known.items() if len(match) <= LONGEST)
        return {run: b"".join(map(known.__getitem__, matches)) for run, matches in zip(runs, split)}

    def texts(self, texts: list[str]) -> list[bytes]:
        """Ids of many texts."""
        split = [_RUN.findall(text) for text in texts]
        flat = list(chain.from_iterable(split))
        found = list(map(self.runs.get, flat))
        new = {run for run, ids in zip(flat, found) if ids is None}
        if new:
            fresh = self._learn(list(new))
            found = [fresh[run] if ids is None else ids for run, ids in zip(flat, found)]
            if len(self.runs) + len(fresh) > REMEMBERED:
                self.runs.clear()
            self.runs.update((run, ids) for run, ids in fresh.items() if len(run) <= LONGEST)
        ends = list(accumulate(map(len, split)))
        return [b"".join(found[end - len(part):end]) for part, end in zip(split, ends)]


def vocabulary(path: str) -> bytes:
    """A vocabulary file as it is: its size is fixed, so it may be sent to every worker."""
    with open(path, "rb") as file:
        return file.read()


def read_ranks(lines: bytes) -> dict[bytes, int]:
    """One token in base64 and its rank a line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines.splitlines())}


def _encoder(lines: bytes, pattern: str) -> Encoder:
    return remembered(("byte bpe", lines, pattern), lambda: Encoder(read_ranks(lines), pattern))


@lru_cache(maxsize=2)
def _tokens(lines: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens one after another, and where each id starts and how long it is (-1: no such id)."""
    ranks = read_ranks(lines)
    starts, sizes = np.zeros(max(ranks.values()) + 1, "int64"), np.full(max(ranks.values()) + 1, -1, "int64")
    at = 0
    for token, rank in ranks.items():
        starts[rank], sizes[rank] = at, len(token)
        at += len(token)
    return np.frombuffer(b"".join(ranks), "uint8"), starts, sizes


def decoded(ids: np.ndarray, tokens: tuple[np.ndarray, np.ndarray, np.ndarray]) -> bytes:
    """The bytes of ids."""
    blob, starts, sizes = tokens
    if len(ids) and (ids.min() < 0 or ids.max() >= len(sizes)):
        raise ValueError("an id is not in the vocabulary")
    lengths = sizes[ids]
    if (lengths < 0).any():
        raise ValueError("an id is not in the vocabulary")
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ids) else 0
    return blob[np.repeat(starts[ids] - ends + lengths, lengths) + np.arange(total)].tobytes()


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id and `ids`, the token ids of its text in order."""
    ranks = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks.value, pattern)
        for batch in batches:
            first = 0
            for texts in in_portions(x.as_py() for x in batch.column(1)):
                out = encoder.texts(texts)
                offsets = np.cumsum([0, *map(len, out)]) // 4
                values = pa.array(np.frombuffer(b"".join(out), "int32"))
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype("int32")), values)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(out)), lists], names=[id_col, "ids"])
                first += len(out)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(frugal(run), f"`{id_col}` {kind}, ids array<int>")


def decode(rows: DataFrame, path: str, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """The same rows and columns, with the bytes that the ids stand for; a column of that name is replaced."""
    ranks = rows.sparkSession.sparkContext.broadcast(vocabulary(path))
    rows = rows.select(*[F.col(f"`{c}`") for c in rows.columns if c != into])
    at, names = rows.columns.index(ids_col), [*rows.columns, into]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(ranks.value)
        for batch in batches:
            column = batch.column(at)
            out = [decoded(x.values.to_numpy(zero_copy_only=False), tokens) if x.is_valid else b"" for x in column]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=names)

    return rows.mapInArrow(frugal(run), StructType([*rows.schema.fields, StructField(into, BinaryType())]))


def digests(rows: DataFrame) -> DataFrame:
    """doc_id, n_tokens and SHA-256 of the ids in decimal, joined by commas, and of the decoded bytes."""
    decimal = F.array_join(F.col("ids").cast("array<string>"), ",")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(decimal, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
