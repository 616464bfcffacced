"""Similarity join on word n-grams by prefix filters under several global token orders.

A text becomes the set of the 64-bit hashes of its distinct n-grams; texts of one set are one class. Two sets
of Jaccard similarity t or more share a token among the first n - ceil(t * n) + 1 of each, whatever the
global order of tokens. Several orders are laid down: in each, tokens come by how common they are (the order of
magnitude of the number of sets that hold them) and then by a hash of that order's own. Candidates must share a prefix token
under every order; what is left is verified on the whole sets.

Tokens that one set alone holds come first in every order and meet nobody, so they are not indexed, and a set with
as many of them as its prefix is long is done. To know them, tokens are counted, in two rounds. The first looks at all
documents and at tokens whose hash lies in a fixed share of the hash space (LOOKED_UP times as many as similar sets may
differ in); all others come last, by their hash. It leaves the sets that meet another under its one order. The second
looks at all tokens of these sets, and only these sets: what a token shares with a set that is done is of no use. Sets are
stored in blocks; a block sends each of its tokens once, in packed parts dealt by hash, and is told which of them
others hold too. A frequent token is one entry a block.

The first shared token also bounds the overlap: what stands before it, i tokens of one set and j of the
other, is not shared. With slack = n * (1 - t) / (1 + t) - i, two sets that link have slacks whose sum is not
negative, so one of any two has slack, and the rows of a bucket need only be met by those that have.

Links are asked for as components, so a group of copies need not be expanded into all its pairs. First,
every class meets the classes of the most slack in its buckets, if that is the same class under every order. The
links found make components; then all pairs of *different* components that the filters leave are verified. Buckets
that lie in one component are never expanded, and no link between components is missed. Within a bucket, members of two
components are compared by sketches first: SKETCH words of 64 bits, each bit the parity of the tokens that fall on it. As
many bits as two sketches differ in, the sets differ in tokens at least, so no pair is lost by it.

Defined cases: a null or empty text, or one without words, has the empty set and is linked with nothing (its
component is itself); a text of fewer than n words is one n-gram; rows that repeat an id are
documents of their own; rows without an id take part, a component without any id has none; an empty
table gives an empty result; columns other than the id and the text play no part. Hashes of 64 bits stand for n-grams and
sets: among 10 ** 6 different sets two agree by chance once in 10 ** 7 corpora. Two tokens that are counted as one (32 bits
and the number of their part are compared) are more common than they are, which costs an index row and loses nothing.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ledgerleaf.llm.common import frugal, remembered, stored

ORDERS = 3
#: Tokens are counted in this many times the share that similar sets may differ in.
LOOKED_UP = 2.5
#: Words of 64 bits in the sketch of a set.
SKETCH = 8
#: Words whose hashes a worker remembers at most.
REMEMBERED = 200_000
#: Tokens that are given back at once; tokens of a stored block; tokens counted in one part, by expectation.
AT_ONCE, BLOCK, PART = 200_000, 1_000_000, 1_000_000
#: Bytes of a token in blocks and in the index, its upper ones (little-endian machines). Tokens that agree in them count as one,
#: which costs an index row and loses nothing: verification is on whole tokens.
KEPT = 7
#: Hashes below this are all there are; class of a token that is not counted.
EVERY = np.uint64(2 ** 64 - 1)
UNKNOWN = 63


def mixed_bits(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Well-mixed 64 bits of 64 bits, one to one."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Sets:
    """The token sets of texts, as sorted arrays."""

    def __init__(self, width: int):
        self.width, self.known = width, {}

    def of(self, text: bytes | None) -> np.ndarray:
        words = text.lower().split() if text else []  # of bytes: A-Z only, and white space of ASCII only
        if not words:
            return np.empty(0, "uint64")
        if len(self.known) > REMEMBERED:
            self.known.clear()
        for word in set(words).difference(self.known):
            self.known[word] = xxhash.xxh3_64_intdigest(word)
        hashes = np.fromiter(map(self.known.__getitem__, words), "uint64", len(words))
        size = min(self.width, len(words))
        tokens = np.full(len(words) - size + 1, size, "uint64")
        for k in range(size):
            tokens = mixed_bits(tokens, k) ^ hashes[k:len(words) - size + 1 + k]
        return np.unique(mixed_bits(tokens, size))


def sketch(tokens: np.ndarray) -> np.ndarray:
    """Parities of the number of tokens on each of 64 * SKETCH places, as signed numbers."""
    odd = np.bincount((tokens >> np.uint64(20)).astype("int64") % (64 * SKETCH), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype("uint8")).view("int64")


def set_id(tokens: np.ndarray) -> int:
    """A number of 64 bits for a set."""
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def packed(tokens: np.ndarray) -> bytes:
    """The upper KEPT bytes of each token."""
    return tokens.view("uint8").reshape(-1, 8)[:, 8 - KEPT:].tobytes()


def unpacked(content: bytes) -> np.ndarray:
    """Packed tokens, the bytes that were left out as zeros."""
    out = np.zeros((len(content) // KEPT, 8), "uint8")
    out[:, 8 - KEPT:] = np.frombuffer(content, "uint8").reshape(-1, KEPT)
    return out.view("uint64").ravel()


def _each(docs: DataFrame, width: int, schema: str, rows_of: Callable, columns: list[str]) -> DataFrame:
    """Rows made of (id, set) of every document; `rows_of` gives a list of rows and how much they hold."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = remembered(("sets", width), lambda: Sets(width))
        types = None
        for batch in batches:
            out, held = [], 0
            ids, texts = batch.column(0), batch.column(1).cast(pa.large_binary())
            types = types or [ids.type if n == "doc_id" else pa.list_(pa.int64()) if t == "array<long>" else pa.list_(pa.list_(pa.int64())) if t == "array<array<long>>" else pa.int64() for n, t in (part.split() for part in schema.split(", "))]
            for i in range(batch.num_rows):
                row, holds = rows_of(ids[i].as_py(), sets.of(texts[i].as_py()))
                out.append(row)
                held += holds
                if held > AT_ONCE:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return docs.select(*columns).mapInArrow(frugal(run), schema)


def set_ids(docs: DataFrame, width: int = 3, text_col: str = "text", into: tuple[str, str] = ("_set", "_size")) -> DataFrame:
    """The same rows and columns, with the id and size of every row's set."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = remembered(("sets", width), lambda: Sets(width))
        for batch in batches:
            found = [(set_id(s), len(s)) for s in (sets.of(x.as_py()) for x in batch.column(at).cast(pa.large_binary()))]
            ids, sizes = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.int64()), pa.array(sizes, pa.int64())], names=[*batch.schema.names, *into])

    return docs.mapInArrow(frugal(run), StructType([*docs.schema.fields, StructField(into[0], LongType()), StructField(into[1], LongType())]))


class Block:
    """Documents as they gather for one row: block, ids, sets and sizes, how many tokens each has in `tokens` (none if its set
    is there already), and these: the counted ones of its set by their hash, and as many more as a prefix needs."""

    def __init__(self, percent: int, limit: np.uint64):
        self.percent, self.limit = percent, limit
        self.ids, self.rows, self.parts, self.seen, self.held = [], [], [], set(), 0

    def add(self, doc_id, tokens: np.ndarray) -> bool:
        """Whether the block is full now."""
        one = set_id(tokens)
        n = 0 if one in self.seen else max(int(np.searchsorted(tokens, self.limit)), prefix_length(len(tokens), self.percent))
        self.seen.add(one)
        self.ids.append(doc_id)
        self.rows.append((one, len(tokens), n))
        self.parts.append(tokens[:n])
        self.held += n + 1
        return self.held >= BLOCK

    def batch(self, id_type: pa.DataType) -> pa.RecordBatch:
        def one(values, of):
            return pa.array([values], pa.list_(of))

        number = int.from_bytes(os.urandom(8), "little") >> 1
        columns = [one(np.array(x, "int64"), pa.int64()) for x in zip(*self.rows)]
        tokens = pa.array([packed(np.concatenate(self.parts))], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([number]), one(self.ids, id_type), *columns, tokens], names=["block", "ids", "sets", "sizes", "counts", "tokens"])


def _in_blocks(rows: DataFrame, read: Callable[[], Callable], percent: int, limit: np.uint64, name: str) -> DataFrame:
    """Rows of an id and what `read()` turns into its tokens, stored in blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens_of, block = read(), Block(percent, limit)
        for batch in batches:
            for i in range(batch.num_rows):
                if block.add(batch.column(0)[i].as_py(), tokens_of(batch.column(1)[i])):
                    yield block.batch(batch.column(0).type)
                    block = Block(percent, limit)
        if block.rows:
            yield block.batch(batch.column(0).type)

    kind = rows.schema[0].dataType.simpleString()
    schema = f"block long, ids array<{kind}>, sets array<long>, sizes array<long>, counts array<long>, tokens binary"
    return stored(rows.mapInArrow(frugal(run), schema), name)


def document_blocks(docs: DataFrame, width: int, percent: int, limit: np.uint64) -> DataFrame:
    def read() -> Callable:
        sets = remembered(("sets", width), lambda: Sets(width))
        return lambda text: sets.of(text.cast(pa.large_binary()).as_py())

    return _in_blocks(docs.select("doc_id", "text"), read, percent, limit, "join-blocks")


def set_blocks(sets: DataFrame, percent: int) -> DataFrame:
    def read() -> Callable:
        return lambda tokens: tokens.values.to_numpy().view("uint64")

    return _in_blocks(sets.select("set", "tokens"), read, percent, EVERY, "join-set-blocks")


def prefix_length(n: int, percent: int) -> int:
    return n - -(-n * percent // 100) + 1 if n else 0


def counted_share(percent: int) -> np.uint64:
    """Hashes below this are counted."""
    return np.uint64(min(LOOKED_UP * (100 - percent) / 100, 1) * (2 ** 64 - 2048))


def _part_and_mark(tokens: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    tokens = tokens >> np.uint64(8 * (8 - KEPT))
    return (tokens >> np.uint64(32)) % np.uint64(parts), (tokens & np.uint64(0xFFFFFFFF)).astype("uint32")


def shared_tokens(blocks: DataFrame, limit: np.uint64, parts: int) -> DataFrame:
    """block, part, marks and classes: which of the counted tokens of a block are in more than one set."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, tokens in zip(batch.column(0).to_pylist(), batch.column(1)):
                tokens = unpacked(tokens.as_py())
                distinct, times = np.unique(tokens[tokens < limit], return_counts=True)
                part, mark = _part_and_mark(distinct, parts)
                order = np.argsort(part, kind="stable")
                which, starts = np.unique(part[order], return_index=True)
                marks, times = np.split(mark[order], starts[1:]), np.split(np.minimum(times[order], 255).astype("uint8"), starts[1:])
                if len(which):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(which.astype("int64")), pa.array([block] * len(which), pa.int64()), pa.array([x.tobytes() for x in marks], pa.binary()), pa.array([x.tobytes() for x in times], pa.binary())],
                        names=["part", "block", "marks", "times"])

    def count(table: pa.Table) -> pa.Table:
        marks = [np.frombuffer(x, "uint32") for x in table["marks"].to_pylist()]
        sizes = np.array([len(x) for x in marks])
        marks, row = np.concatenate(marks), np.repeat(np.arange(len(sizes)), sizes)
        times = np.concatenate([np.frombuffer(x, "uint8") for x in table["times"].to_pylist()]).astype("int64")
        order = np.argsort(marks, kind="stable")
        starts = np.flatnonzero(np.concatenate([[True], marks[order[1:]] != marks[order[:-1]]]))
        total = np.repeat(np.add.reduceat(times[order], starts), np.diff(np.append(starts, len(order))))
        several = order[total > 1]
        kinds = np.zeros(len(marks), "uint8")
        kinds[order] = np.log2(total).astype("uint8")
        several.sort()  # by row again
        ends = np.searchsorted(row[several], np.arange(1, len(sizes)))
        return pa.table({
            "block": table["block"], "part": table["part"],
            "marks": pa.array([x.tobytes() for x in np.split(marks[several], ends)], pa.binary()),
            "classes": pa.array([x.tobytes() for x in np.split(kinds[several], ends)], pa.binary())})

    sent = blocks.select("block", "tokens").mapInArrow(frugal(send), "part long, block long, marks binary, times binary")
    return sent.groupBy("part").applyInArrow(frugal(count), "block long, part long, marks binary, classes binary")


def index_rows(blocks: DataFrame, percent: int, limit: np.uint64, orders: int) -> DataFrame:
    """ord, token, set, size and slack: the prefixes of all sets under so many orders, without tokens of one set alone."""
    parts = 1 + (blocks.agg(F.sum(F.length("tokens"))).first()[0] or 0) // KEPT // PART
    shared = shared_tokens(blocks, limit, parts)

    def rows_of(left: pa.Table, right: pa.Table) -> pa.Table:
        columns = [[], [], [], [], []]
        known = np.concatenate([np.zeros(0, "uint64")] + [np.frombuffer(m, "uint32").astype("uint64") | np.uint64(p << 32) for m, p in zip(right["marks"].to_pylist(), right["part"].to_pylist())])
        classes = np.concatenate([np.zeros(0, "uint8")] + [np.frombuffer(x, "uint8") for x in right["classes"].to_pylist()])
        order = np.argsort(known)
        known, classes = known[order], classes[order]
        for sets, sizes, counts, tokens in zip(*(left[c].to_pylist() for c in ("sets", "sizes", "counts", "tokens"))):
            tokens = unpacked(tokens)
            part, mark = _part_and_mark(tokens, parts)
            kind = np.zeros(len(tokens), "uint64")
            if len(known):
                key = part << np.uint64(32) | mark
                at = np.minimum(np.searchsorted(known, key), len(known) - 1)
                kind = np.where(known[at] == key, classes[at], 0).astype("uint64")
            kind[tokens >= limit] = UNKNOWN
            end = 0
            for one, size, count in zip(sets, sizes, counts):
                begin, end = end, end + count
                length = prefix_length(size, percent)
                own, of = tokens[begin:end], kind[begin:end]
                alone = int((of == 0).sum())
                if alone >= length or not count:  # done, or its tokens stand with an earlier copy
                    continue
                for k in range(orders):
                    within = np.where(of == UNKNOWN, own, mixed_bits(own, 100 + k)) >> np.uint64(6)
                    first = own[np.argsort(of << np.uint64(58) | within)[alone:length]]
                    n = len(first)
                    columns[0].append(np.full(n, k))
                    columns[1].append(first.view("int64"))
                    columns[2].append(np.full(n, one))
                    columns[3].append(np.full(n, size))
                    columns[4].append(size * (100 - percent) - np.arange(alone, length) * (100 + percent))
        whole = [np.concatenate(c) if c else np.zeros(0, "int64") for c in columns]
        return pa.table({name: pa.array(c.astype("int64"), pa.int64()) for name, c in zip(("ord", "token", "set", "size", "slack"), whole)})

    left = blocks.select("block", "sets", "sizes", "counts", "tokens").groupBy("block")
    return left.cogroup(shared.groupBy("block")).applyInArrow(frugal(rows_of), "ord long, token long, set long, size long, slack long")


def components(edges: DataFrame) -> DataFrame:
    """set and component (the least set that links reach) of every set on an edge (columns a and b)."""
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "join-edges")
    labels = stored(both.groupBy(F.col("a").alias("set")).agg(F.least(F.min("b"), F.min("a")).alias("component")), "join-labels")
    while True:
        near = both.join(labels.toDF("b", "component"), "b").groupBy(F.col("a").alias("set")).agg(F.min("component").alias("near"))
        step = labels.join(near, "set").select("set", "component", F.least("component", "near").alias("next"))
        jump = labels.toDF("next", "further")
        moved = stored(step.join(jump, "next").select("set", F.least("next", "further").alias("component"), (F.least("next", "further") < F.col("component")).alias("moved")), "join-labels")
        labels = moved.select("set", "component")
        if moved.where("moved").isEmpty():
            return labels


def whole_sets(docs: DataFrame, ids: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """set, its tokens and its sketch, of the sets in `wanted`. Their texts are read again: of one document for each."""
    holders = ids.join(wanted, "set", "left_semi").groupBy("set").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()
    texts = docs.join(holders, docs.doc_id.eqNullSafe(holders.doc_id), "left_semi")

    def row(_, tokens: np.ndarray):
        return (set_id(tokens), tokens.view("int64").tolist(), sketch(tokens).tolist()), len(tokens)

    return stored(_each(texts, width, "set long, tokens array<long>, sketch array<long>", row, ["doc_id", "text"]).join(wanted, "set", "left_semi").dropDuplicates(["set"]), "join-sets")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) of sets, those whose whole sets are similar enough."""
    rows = pairs.join(sets.select(F.col("set").alias("a"), F.col("tokens").alias("tokens_a")), "a").join(sets.select(F.col("set").alias("b"), F.col("tokens").alias("tokens_b")), "b")
    shared, both = F.size(F.array_intersect("tokens_a", "tokens_b")), F.size("tokens_a") + F.size("tokens_b")
    return stored(rows.where(shared * (100 + percent) >= both * percent).select("a", "b"), "join-links")


def _close(percent: int, left: str, right: str) -> F.Column:
    return (F.col(left) * 100 >= F.col(right) * percent) & (F.col(right) * 100 >= F.col(left) * percent)


def classes_of(docs: DataFrame, width: int = 3, percent: int = 90) -> tuple[DataFrame, DataFrame]:
    """Two tables: doc_id, set and size of every document; and, for every set, component (the least set of its
    component), component_id (the least doc_id in it) and keeper (the set of that document)."""
    docs = docs.select("doc_id", "text")
    limit = counted_share(percent)
    blocks = document_blocks(docs, width, percent, limit)
    ids = blocks.select(F.explode(F.arrays_zip("ids", "sets", "sizes")).alias("x")).select(F.col("x.ids").alias("doc_id"), F.col("x.sets").alias("set"), F.col("x.sizes").alias("size"))

    def meeting(rows: DataFrame) -> DataFrame:
        sums = rows.groupBy("ord", "token").agg(F.min("set").alias("least"), F.max("set").alias("most"), F.max("slack").alias("hub_slack"))
        sums = sums.where("least < most and hub_slack >= 0").select("ord", "token", "hub_slack")
        return rows.join(sums, ["ord", "token"]).where("slack + hub_slack >= 0")

    alive = stored(meeting(stored(index_rows(blocks, percent, limit, 1), "join-prefixes")).select("set").distinct(), "join-alive")
    sets = whole_sets(docs, ids, alive, width)
    rows = stored(meeting(stored(index_rows(set_blocks(sets, percent), percent, EVERY, ORDERS), "join-prefixes")), "join-index")

    everywhere = F.col("bits") == (1 << ORDERS) - 1
    bit = F.expr("shiftleft(1, cast(ord as int))").alias("bit")
    hubs = rows.where("slack = hub_slack").groupBy("ord", "token").agg(F.min(F.struct("set", "size")).alias("hub")).select("ord", "token", F.col("hub.set").alias("hub"), F.col("hub.size").alias("hub_size"))
    near = rows.join(hubs, ["ord", "token"]).where("hub <> set").where(_close(percent, "size", "hub_size"))
    first = near.select(F.least("set", "hub").alias("a"), F.greatest("set", "hub").alias("b"), bit).groupBy("a", "b").agg(F.bit_or("bit").alias("bits")).where(everywhere).select("a", "b")
    links = verified(first, sets, percent)
    labels = components(links)

    known = rows.join(labels, "set", "left").withColumn("component", F.coalesce("component", "set"))
    groups = known.groupBy("ord", "token", "component").agg(F.count("*").alias("n"), F.min("size").alias("low"), F.max("size").alias("high"), F.max("slack").alias("best"))
    several = groups.groupBy("ord", "token").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("ord", "token")
    groups = stored(groups.join(several, ["ord", "token"], "left_semi"), "join-groups")
    # Of two sets that link, at least one has slack: only groups with slack look for others.
    left = groups.where("best >= 0").toDF("ord", "token", "c_a", "n_a", "low_a", "high_a", "best_a")
    right = groups.toDF("ord", "token", "c_b", "n_b", "low_b", "high_b", "best_b")
    meet = left.join(right, ["ord", "token"]).where("best_a + best_b >= 0 and (c_a < c_b or best_b < 0 and c_a <> c_b)")
    meet = meet.where(f"high_a * 100 >= low_b * {percent} and high_b * 100 >= low_a * {percent}")
    # The members of the smaller component come first, then those of the larger one that may link with them.
    fewer = F.col("n_a") <= F.col("n_b")
    meet = meet.select("ord", "token", F.when(fewer, F.col("c_a")).otherwise(F.col("c_b")).alias("c_a"), F.when(fewer, F.col("c_b")).otherwise(F.col("c_a")).alias("c_b"),
                       F.when(fewer, F.col("best_b")).otherwise(F.col("best_a")).alias("best"))
    words = [F.get("sketch", F.lit(i)).alias(f"w{i}") for i in range(SKETCH)]
    member = known.join(sets.select("set", *words), "set").select("ord", "token", "component", "set", "size", "slack", *(f"w{i}" for i in range(SKETCH)))
    one = member.toDF("ord", "token", "c_a", "a", "size_a", "slack_a", *(f"a{i}" for i in range(SKETCH)))
    other = member.toDF("ord", "token", "c_b", "b", "size_b", "slack_b", *(f"b{i}" for i in range(SKETCH)))
    # Sets that link differ in so many tokens at most: what is not shared of both, 1 - t parts of 1 + t.
    differ = sum((F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in range(SKETCH)), F.lit(0))
    alike = differ * (100 + percent) <= (F.col("size_a") + F.col("size_b")) * (100 - percent)
    pairs = meet.join(one, ["ord", "token", "c_a"]).where("slack_a + best >= 0").join(other, ["ord", "token", "c_b"])
    pairs = pairs.where("slack_a + slack_b >= 0").where(_close(percent, "size_a", "size_b")).where(alike)
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), bit)
    pairs = pairs.groupBy("a", "b").agg(F.bit_or("bit").alias("bits")).where(everywhere).select("a", "b")
    more = verified(pairs, sets, percent)
    if not more.isEmpty():
        labels = components(links.union(more))

    sets = ids.where("size > 0").groupBy("set").agg(F.min("doc_id").alias("least_id"))
    sets = stored(sets.join(labels, "set", "left").withColumn("component", F.coalesce("component", "set")), "join-sets")
    best = sets.groupBy("component").agg(F.min("least_id").alias("component_id"), F.min(F.struct(F.col("least_id").isNull(), "least_id", "set"))["set"].alias("keeper"))
    return ids, stored(sets.join(best, "component").select("set", "component", "component_id", "keeper"), "join-classes")


def linked(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    ids, sets = classes_of(docs, width, percent)
    alone = ids.where("size = 0").select("doc_id", F.col("size").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    rows = ids.where("size > 0").join(sets, "set").select("doc_id", F.col("size").alias("n_shingles"), "component_id")
    return rows.unionByName(alone)


def one_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents, one of each component: that of the least doc_id. Documents without words all stay."""
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    _, sets = classes_of(docs, width, percent)
    rows = set_ids(docs.select(own, F.col("text").alias("_text"), F.col("doc_id").alias("_id")), width, "_text").drop("_text")
    alone = rows.where("_size = 0")
    kept = rows.where("_size > 0").join(sets.where("set = keeper").select(F.col("set").alias("_set"), "component_id"), "_set")
    kept = kept.where(F.col("_id").eqNullSafe(F.col("component_id"))).dropDuplicates(["_set"])
    return alone.select("_doc.*").unionByName(kept.select("_doc.*"))
