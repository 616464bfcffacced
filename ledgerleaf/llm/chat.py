"""Logged conversations: collapse of cumulative snapshots, then rendering.

A log often holds a conversation after every turn, each snapshot a prefix of the next. A turn's hash takes
in its place; the hash of a prefix rolls the hashes of its turns together. Where a whole conversation has
the hash of a proper prefix of another one, an anti-join drops it; of equal conversations the one of the
smallest id stays. Places and rolling hashes are found in blocks of turn numbers first and across the
blocks of a conversation then, so a conversation of any length is not one task.

Defined cases: turns stand in order of number, role and text (nulls first); rows that agree in all of
conversation, turn, role and text are one turn; rows without a conversation id belong to none and are left out; a null
role is rendered as `unknown`, a null text as empty; a conversation of more than PART turns is
rendered in several rows; an empty table gives an empty result; further columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerleaf.llm.common import stored

#: Turn numbers of a block.
BLOCK = 256
#: Turns of a rendered row.
PART = 256


def _two(*parts: Column) -> list[Column]:
    """Two 64-bit hashes that do not depend on each other."""
    return [F.xxhash64(F.lit(seed), *[F.coalesce(F.isnull(p).cast("int"), F.lit(0)) for p in parts], *parts) for seed in (11, 12)]


def prefixes(turns: DataFrame) -> DataFrame:
    """One row per turn: conv_id, k (its place, from 1), n (turns of the conversation), role, text, p1 and
    p2 (rolling hash of the turns 1 to k)."""
    rows = turns.select("conv_id", F.floor(F.col("turn") / BLOCK).cast("long").alias("block"), "turn", "role", "text").where("conv_id is not null").distinct()
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    rows = rows.withColumn("k", F.row_number().over(inside).cast("long"))
    running = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id")
    counts = rows.groupBy("conv_id", "block").count().select(
        "conv_id", "block", F.coalesce(F.sum("count").over(running), F.lit(0)).alias("before"), F.sum("count").over(whole).alias("n"))
    t1, t2 = _two(F.col("k"), F.col("role"), F.col("text"))
    rows = _by_block(rows, counts).withColumn("k", F.col("k") + F.col("before")).drop("before").withColumns({"t1": t1, "t2": t2})
    order = Window.partitionBy("conv_id", "block").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.groupBy("conv_id", "block").agg(F.bit_xor("t1").alias("b1"), F.bit_xor("t2").alias("b2")).select(
        "conv_id", "block", *[F.coalesce(F.bit_xor(b).over(running), F.lit(0)).alias(b) for b in ("b1", "b2")])
    rows = rows.withColumns({p: F.bit_xor(t).over(order) for p, t in (("p1", "t1"), ("p2", "t2"))})
    return _by_block(rows, sums).select("conv_id", "k", "n", "role", "text", F.col("p1").bitwiseXOR(F.col("b1")).alias("p1"), F.col("p2").bitwiseXOR(F.col("b2")).alias("p2"))


def _by_block(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Join on conversation and block; turns without a number are a block of their own."""
    other = blocks.withColumnsRenamed({"conv_id": "_conv", "block": "_block"})
    return rows.join(other, (F.col("conv_id") == F.col("_conv")) & F.col("block").eqNullSafe(F.col("_block"))).drop("_conv", "_block")


def maximal(turns_by_place: DataFrame) -> DataFrame:
    """conv_id, n and copies (equal conversations) of those that no other conversation goes on from."""
    whole = turns_by_place.where("k = n").groupBy("n", "p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    shorter = turns_by_place.where("k < n").select(F.col("k").alias("n"), "p1", "p2").distinct()
    return whole.join(shorter, ["n", "p1", "p2"], "left_anti").select("conv_id", "n", "copies")


def rendered(turns: DataFrame) -> DataFrame:
    """The conversations that stay, as text: conv_id, n_turns, copies, part (from 0), first_turn and last_turn (places) and text."""
    placed = stored(prefixes(turns), "chat-turns")
    stay = maximal(placed)
    line = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("<|end|>\n"))
    parts = placed.select("conv_id", "k", line.alias("line")).join(stay, "conv_id").groupBy("conv_id", F.floor((F.col("k") - 1) / PART).cast("long").alias("part")).agg(
        F.first("n").alias("n_turns"), F.first("copies").alias("copies"), F.min("k").alias("first_turn"), F.max("k").alias("last_turn"),
        F.sort_array(F.collect_list(F.struct("k", "line"))).alias("lines"),
    )
    return parts.select("conv_id", "n_turns", "copies", "part", "first_turn", "last_turn", F.array_join("lines.line", "").alias("text"))


ORACLE = """
WITH t AS (
    SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL
), c AS (
    SELECT conv_id, list(struct_pack(r := role, t := text) ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS turns FROM t GROUP BY conv_id
), u AS (
    SELECT turns, min(conv_id) AS conv_id, count(*) AS copies, len(turns) AS n FROM c GROUP BY turns
), p AS (
    SELECT DISTINCT turns[1:k] AS turns FROM (SELECT turns, unnest(range(1, n)) AS k FROM u)
), m AS (
    SELECT * FROM u ANTI JOIN p USING (turns)
), l AS (
    SELECT conv_id, n, copies, unnest(turns) AS x, unnest(range(1, n + 1)) AS k FROM m
)
SELECT conv_id, CAST(n AS BIGINT) AS n_turns, copies, CAST((k - 1) // 256 AS BIGINT) AS part, CAST(min(k) AS BIGINT) AS first_turn, CAST(max(k) AS BIGINT) AS last_turn,
    string_agg('<|' || coalesce(x.r, 'unknown') || '|>' || chr(10) || coalesce(x.t, '') || '<|end|>' || chr(10), '' ORDER BY k) AS text
FROM l GROUP BY conv_id, n, copies, (k - 1) // 256
"""
