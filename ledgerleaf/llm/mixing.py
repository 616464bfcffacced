"""Mixing sources to target weights by weighted fair queueing.

Every document gets a virtual finish time: the words its source has handed out up to and including
it, divided by the source's target. Entries of all sources are taken in the order of these times
until the budget is used up, so that each source advances in proportion to its target.

Running sums are taken in two steps, so that no source and no range of finish times becomes one task:
sums of fixed cells first, then the rows inside a cell.

Defined cases: a null or empty text has size 0 and takes nothing; a null source is a source of its
own, last in order; documents of one source are shuffled by a hash of their id, ties (repeated rows)
by size; an empty table gives an empty result; columns other than doc_id, text and source play no part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerleaf.llm.common import stored, word_count

#: Cells of one source, by the top bits of the shuffle hash.
CELL_BITS = 10
#: Cells of finish times up to 1, and as many beyond.
TIME_CELLS = 4096


def source_targets(sized: DataFrame, weights: Sequence[float], budget: float, max_epochs: float) -> DataFrame:
    """One row per source (`key`, `source_size`, `target`). Weights go to the sources by code point,
    null last, in turn. A target stops at `max_epochs` times the size; what is above is shared again.

    The level that all other targets share is found from running sums over the sources, ordered by
    the level at which each of them is full.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    sums = sized.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    full = F.col("source_size") * F.lit(float(max_epochs))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "key")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onwards = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.orderBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = (
        sums.withColumn("weight", weight)
        .withColumn("cap", full)
        .withColumn("total", F.sum("source_size").over(every) * F.lit(float(budget)))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onwards))
        .withColumn("open", F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "key", "level")))
        .withColumn("level", F.min("open").over(every)["level"])
    )
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return levels.select("key", "source_size", target.alias("target"), "total")


def fair_queue(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), budget: float = 1.5, max_epochs: int = 2, seed: int = 7) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, finish (of its first pass),
    epochs (passes that the mix takes) and taken (words, repeats counted).

    `budget` is a share of all words. Later passes of a source follow its earlier ones in the queue.
    """
    shuffle = F.xxhash64(F.lit(seed), "doc_id")
    sized = stored(
        docs.select(
            "doc_id", "source", word_count(F.col("text")).alias("size"),
            F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("key"),
            shuffle.alias("turn"), F.shiftright(shuffle, 64 - CELL_BITS).alias("cell"),
        ),
        "mix-sizes",
    )
    targets = stored(source_targets(sized, weights, budget, max_epochs), "mix-targets")
    cells = sized.groupBy("key", "cell").agg(F.sum("size").alias("cell_size"))
    earlier = Window.partitionBy("key").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("earlier", F.coalesce(F.sum("cell_size").over(earlier), F.lit(0)))
    inside = Window.partitionBy("key", "cell").orderBy("turn", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        sized.withColumn("inside", F.sum("size").over(inside))
        .join(cells, ["key", "cell"])
        .join(targets, "key")
        .withColumn("so_far", F.col("earlier") + F.col("inside"))
    )
    placed = stored(placed.select("doc_id", "source", "key", "size", "source_size", "target", "so_far", "total"), "mix-queue")
    times = [_finish(epoch) for epoch in range(max_epochs)]
    cut, last = _cut(placed, times)
    epochs = sum((F.when((time < cut) | ((time == cut) & (F.col("key") <= last)), 1).otherwise(0) for time in times), F.lit(0))
    return placed.select(
        "doc_id", "source", "size", "source_size", "target", times[0].alias("finish"),
        epochs.alias("epochs"), (F.col("size") * epochs).cast("long").alias("taken"),
    )


def _finish(epoch: int) -> Column:
    done = F.col("so_far") + F.col("source_size") * F.lit(epoch)
    return F.when(F.col("size") > 0, done / F.col("target")).otherwise(F.lit(float("inf")))


def _cut(placed: DataFrame, times: list[Column]) -> tuple[Column, Column]:
    """Finish time and source key of the last entry within the budget, as literals."""
    entries = placed.where("size > 0").select("key", "size", "total", F.explode(F.array(*times)).alias("finish"))
    cell = F.least(F.floor(F.col("finish") * TIME_CELLS), F.lit(2 * TIME_CELLS)).cast("long")
    entries = entries.withColumn("time_cell", cell)
    upto = Window.orderBy("time_cell").rowsBetween(Window.unboundedPreceding, 0)
    sums = entries.groupBy("time_cell").agg(F.sum("size").alias("words"), F.max("total").alias("total"))
    first = (
        sums.withColumn("upto", F.sum("words").over(upto))
        .where("upto > total").orderBy("time_cell").limit(1).first()
    )
    if first is None:
        return F.lit(float("inf")), F.lit(None).cast("string")
    here = Window.orderBy("finish", "key").rowsBetween(Window.unboundedPreceding, 0)
    last = (
        entries.where(F.col("time_cell") == first.time_cell)
        .withColumn("upto", F.sum("size").over(here) + F.lit(first.upto - first.words))
        .where("upto <= total")
        .agg(F.max(F.struct("finish", "key")).alias("last")).first().last
    )
    if last is None:
        return F.lit(first.time_cell / TIME_CELLS), F.lit(None).cast("string")
    return F.lit(last.finish), F.lit(last.key)


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The documents of the mix: a document that is taken twice is there twice. Documents without words
    are not taken. Rows that agree in doc_id, source and size are taken together."""
    queue = fair_queue(docs, **settings).where("taken > 0")
    taken = queue.groupBy("doc_id", "source", "size").agg(F.max("epochs").alias("epochs"))
    taken = taken.toDF("mix_doc", "mix_source", "mix_size", "mix_epochs")
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own_row")
    rows = docs.select(own, F.col("doc_id").alias("own_doc"), F.col("source").alias("own_source"), word_count(F.col("text")).alias("own_size"))
    same = rows.own_doc.eqNullSafe(taken.mix_doc) & rows.own_source.eqNullSafe(taken.mix_source) & (rows.own_size == taken.mix_size)
    return rows.join(taken, same).select("own_row", F.explode(F.sequence(F.lit(1), "mix_epochs"))).select("own_row.*")
