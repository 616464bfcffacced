"""How far the sources of a language stand apart in their words.

Every (lang, source) group gives each kept term of its language a share of 10 ** 9 (`share`); a group is
priced against another by the sum over terms of (p - q) ** 2 // q. Terms are dealt out to blocks by hash,
and a group's counts in a block are the leaves of a segment tree over the block's terms, the most frequent first. Trees are
hash-consed: on every level, equal pairs of children are one node, whichever group they come from, so
groups that agree on a stretch of terms (most often that they lack it) share its node. Two groups are
priced by going down both trees at once: of the node pairs of a level, equal ones are met once and carry how
often they occur; only what is left at the leaves, distinct pairs of counts, is priced. All sums are whole numbers.

Blocks hold about BLOCK terms, fewer when a language has many groups, so a task sees a bounded table. Words are
counted inside the scan, so a frequent word or a hot source costs a row a task.

Defined cases: a null text, lang or source is an empty one; a group without terms is a group; a language
without kept terms has pairs of value 0 and no terms; rows that repeat an id are documents of their own;
an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerleaf.llm.common import stored

#: Terms of a block, and leaves of all trees of a block, at most (by expectation: terms are dealt by hash).
BLOCK, LEAVES = 4096, 1 << 22
#: Distinct words a worker counts before it passes them on.
AT_ONCE = 400_000
SCALE = 1_000_000_000

#: Bytes of a word as they are but for A-Z; all others become spaces.
_WORDS = bytes(c | 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (times) and docs (documents), several rows of one key; term null: documents in all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0

        def out() -> pa.RecordBatch:
            columns = [], [], [], [], []
            for (lang, source), (times, within) in groups.items():
                terms = list(times)
                for column, more in zip(columns, ([lang] * len(terms), [source] * len(terms), terms, times.values(), map(within.__getitem__, terms))):
                    column += more
            terms = pa.array(columns[2], pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), terms, pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.int64())],
                names=["lang", "source", "term", "n", "docs"])

        for batch in batches:
            texts = batch.column(0).cast(pa.large_binary())
            for text, lang, source in zip(texts, batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                times, within = groups.setdefault((lang or "", source or ""), (Counter(), Counter()))
                before = len(times)
                words = (text.as_py() or b"").translate(_WORDS).split()
                times[None] += 0
                within[None] += 1
                times.update(words)
                within.update(set(words))
                held += len(times) - before
                if held >= AT_ONCE:
                    yield out()
                    groups, held = {}, 0
        if groups:
            yield out()

    return docs.select("text", "lang", "source").mapInArrow(count, "lang string, source string, term string, n long, docs long")


def share(n: Column, total: Column, kept: Column) -> Column:
    """Of 10 ** 9, one more than what falls on a term that occurs n times in a group of `total`, of `kept` terms."""
    above = F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)")
    return 1 + F.call_function("div", above, (total + kept).cast("decimal(20,0)"))


def priced(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _consed(leaves: np.ndarray) -> list[np.ndarray]:
    """Node numbers by level, leaves first: equal pairs of children have one number. Rows are groups."""
    levels = [leaves]
    while levels[-1].shape[1] > 1:
        below = levels[-1]
        pairs = below[:, ::2] << np.int64(32) | below[:, 1::2]
        levels.append(np.unique(pairs, return_inverse=True)[1].reshape(pairs.shape))
    return levels


def _children(levels: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each level above the leaves: left and right child of every node number."""
    out = []
    for below, level in zip(levels, levels[1:]):
        left, right = np.zeros(level.max() + 1, "int64"), np.zeros(level.max() + 1, "int64")
        left[level], right[level] = below[:, ::2], below[:, 1::2]
        out.append((left, right))
    return out


def _meeting(a: int, b: int, children: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of leaves under two roots, and how often each occurs."""
    x, y, times = np.array([a]), np.array([b]), np.array([1])
    for left, right in reversed(children):
        pairs, where = np.unique(np.concatenate([left[x] << np.int64(32) | left[y], right[x] << np.int64(32) | right[y]]), return_inverse=True)
        times = np.bincount(where, np.concatenate([times, times]), len(pairs)).astype("int64")
        x, y = pairs >> np.int64(32), pairs & np.int64(0xFFFFFFFF)
    return x, y, times


def block_prices(sources: list[str], totals: np.ndarray, kept: int, groups: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one block: groups i and j, and the price of i against j, for all i != j. `groups`, `terms`, `counts`:
    which group has which of the block's terms (numbered from 0) how often."""
    n_terms = int(terms.max()) + 1
    by_total = np.argsort(-np.bincount(terms, counts, n_terms), kind="stable")
    place = np.empty(n_terms, "int64")
    place[by_total] = np.arange(n_terms)
    width = 1 << (n_terms - 1).bit_length()
    values, numbers = np.unique(np.concatenate([[-1, 0], counts]), return_inverse=True)  # leaf 0: no term, leaf 1: none of it
    leaves = np.zeros((len(sources), width), "int64")
    leaves[:, :n_terms] = 1
    leaves[groups, place[terms]] = numbers[2:]
    levels = _consed(leaves)
    children, roots = _children(levels), levels[-1][:, 0]

    def shares(leaf: np.ndarray, group: int) -> np.ndarray:
        numbers, where = np.unique(leaf, return_inverse=True)
        whole = int(totals[group]) + kept
        return np.array([1 + SCALE * (int(values[x]) + 1) // whole for x in numbers], "int64")[where]

    i_s, j_s, prices = [], [], []
    for i in range(len(sources)):
        for j in range(i):
            x, y, times = _meeting(roots[i], roots[j], children)
            real = x > 0
            p, q, times = shares(x[real], i), shares(y[real], j), times[real]
            square = (p - q) * (p - q)
            i_s += [i, j]
            j_s += [j, i]
            prices += [int((square // q * times).sum()), int((square // p * times).sum())]
    return np.array(i_s, "int64"), np.array(j_s, "int64"), np.array(prices, "int64")


def pair_prices(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item and value of every two sources of a language. `rows`: lang, source, term, n of kept
    terms; `groups`: lang, source, total, kept of all."""
    langs = groups.groupBy("lang").agg(F.count("*").alias("groups"), F.max("kept").alias("kept"))
    blocks = langs.select("lang", F.ceil(F.col("kept") / F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.lit(LEAVES) / F.col("groups")))).alias("blocks")).where("blocks > 0")
    dealt = rows.join(blocks, "lang").select("lang", F.pmod(F.xxhash64("term"), "blocks").alias("block"), "source", "term", "n")
    members = groups.join(blocks, "lang").select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "source", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"), "total", "kept")
    no = F.lit(None).cast("long")
    every = dealt.select("*", no.alias("total"), no.alias("kept")).unionByName(members)

    def price(table: pa.Table) -> pa.Table:
        heads = table.filter(table["term"].is_null()).sort_by("source")
        body = table.filter(table["term"].is_valid())
        empty = pa.table({"lang": pa.array([], pa.string()), "source": pa.array([], pa.string()), "item": pa.array([], pa.string()), "value": pa.array([], pa.int64())})
        if not body.num_rows or heads.num_rows < 2:
            return empty
        sources = heads["source"].to_pylist()
        number = {source: i for i, source in enumerate(sources)}
        terms = body["term"].combine_chunks().dictionary_encode().indices.to_numpy()
        of = np.array([number[x] for x in body["source"].to_pylist()])
        i, j, value = block_prices(sources, heads["total"].to_numpy(), heads["kept"][0].as_py(), of, terms.astype("int64"), body["n"].to_numpy())
        names = pa.array(sources, pa.string())
        return pa.table({"lang": pa.array([heads["lang"][0].as_py()] * len(i), pa.string()), "source": names.take(pa.array(i)), "item": names.take(pa.array(j)), "value": pa.array(value)})

    return every.groupBy("lang", "block").applyInArrow(price, "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least_docs: int = 3, top: int = 200) -> DataFrame:
    """Rows of two parts. `pair`: each group against every other source of its language; `term`: the `top` terms by
    which a group stands out from its language. Columns: lang, source, part, item, value, rank."""
    partial = stored(counted(docs), "audit-partial")
    groups = partial.where("term is null").select("lang", "source").distinct()

    # One shuffle serves the sums by source and those by language; a term has a row a source at most then.
    by_source = partial.where("term is not null").repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    rows = by_source.withColumns({"all_docs": F.sum("docs").over(of_term), "all_n": F.sum("n").over(of_term)})
    rows = stored(rows.where(F.col("all_docs") >= least_docs).select("lang", "source", "term", "n", "all_n"), "audit-rows")

    sums = rows.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    # A term's total stands in a row of each of its sources; a share of one for each adds up to one a term.
    kept = rows.groupBy("lang", "term").agg(F.max("all_n").alias("n")).groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("lang_total"))
    groups = groups.join(sums, ["lang", "source"], "left").join(kept, "lang", "left")
    groups = stored(groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "kept", "lang_total")]), "audit-groups")

    # Without kept terms a language has no block, and its pairs are worth nothing.
    bare = groups.where("kept = 0").select("lang", "source")
    bare = bare.join(bare.withColumnRenamed("source", "item"), "lang").where("source <> item").withColumn("value", F.lit(0).cast("long"))
    pairs = pair_prices(rows.drop("all_n"), groups).unionByName(bare).select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    p, q = share(F.col("n"), F.col("total"), F.col("kept")), share(F.col("all_n"), F.col("lang_total"), F.col("kept"))
    terms = rows.join(groups, ["lang", "source"]).select("lang", "source", "term", p.alias("p"), q.alias("q")).where("p > q")
    terms = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), priced(F.col("p"), F.col("q")).alias("value"))

    def ranked(rows: DataFrame) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))

    return ranked(pairs).unionByName(ranked(terms).where(F.col("rank") <= top))


#: The same for documents with terms in DuckDB.
ORACLE = r"""
WITH d AS (
    SELECT row_number() OVER () AS row_no, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
), w AS (
    SELECT row_no, lang, source, unnest(terms) AS term FROM d
), kept AS (
    SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY ALL HAVING count(DISTINCT row_no) >= 3
), langs AS (
    SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY ALL
), counts AS (
    SELECT w.lang, w.source, w.term, count(*)::HUGEINT AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL
), g AS (
    SELECT x.lang, x.source, coalesce(t.total, 0) AS total, coalesce(l.v, 0) AS v FROM (SELECT DISTINCT lang, source FROM d) x
    LEFT JOIN (SELECT lang, source, sum(n)::HUGEINT AS total FROM counts GROUP BY ALL) t USING (lang, source) LEFT JOIN langs l USING (lang)
), p AS (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.total + g.v) AS p,
        1 + (1000000000::HUGEINT * (k.n + 1)) // (l.total + l.v) AS q
    FROM g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), prices AS (
    SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN prices x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
), terms AS (
    SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM p WHERE n > 0 AND p > q
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank
    FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
