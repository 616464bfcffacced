"""Quality rules: a decision list learned from labelled documents by sequential covering.

Every text is measured by column expressions. A rule is a conjunction of thresholds on whole-number
measures; it is grown on two thirds of the labelled documents, one condition at a time, each the one of
the highest information gain over all thresholds of all measures, and pruned on the last third. Documents
that a rule covers are set aside before the next one is grown. What is learned is an ordered CASE
expression. Each step counts labels by measure and value in one job over all labelled rows; the driver
sees the best condition only.

Defined cases: a null or empty text has no words and fails the base rules; a label that is null says
nothing; a document with several labels is good if most of them say so; rows that repeat a doc_id
are measured and judged each; without labels of both kinds the list is empty and base rules alone decide;
columns of the input keep their names and values whatever they are called.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerleaf.functions.stages import evaluated
from ledgerleaf.llm.common import SPACE, WORD, stored

#: Words of a window whose repetition counts.
WINDOW = 5
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Whole-number measures that conditions are about: shares in thousandths, sizes in steps of an eighth of a doubling.
MEASURES = ("size_step", "line_step", "mean_word_10", "symbols_1000", "dup_lines_1000", "repeats_1000", "distinct_1000")


@dataclass(frozen=True)
class Condition:
    measure: str
    at_least: bool
    value: int

    def column(self) -> Column:
        return F.col(self.measure) >= self.value if self.at_least else F.col(self.measure) <= self.value

    def __str__(self) -> str:
        return f"{self.measure} {'>=' if self.at_least else '<='} {self.value}"


Rule = tuple[Condition, ...]


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`_doc`, the row as it is, and `_quality`, the counts and measures of its text. What is worked out on the way stands
    beside the row, not in it, so no column of it is touched. Repeated windows are found by sorting the
    hashes of a text's windows, and only where there are any."""
    text = F.col("_text")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))
    rows = evaluated(rows, _words=F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), _lines=F.filter(F.split(text, "\n"), lambda line: F.regexp_like(line, F.lit(f"[^{SPACE}]"))))
    rows = evaluated(
        rows,
        _hashes=F.transform("_words", lambda w: F.xxhash64(w)), _n=F.size("_words").cast("long"),
        _distinct=F.size(F.array_distinct("_words")).cast("long"),
        _chars=F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long"),
        _symbols=(F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        _n_lines=F.size("_lines").cast("long"), _dups=(F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
    ).drop("_words", "_lines")
    starts = F.sequence(F.lit(0), F.greatest(F.size("_hashes") - WINDOW, F.lit(0)))
    window = F.transform(starts, lambda i: F.xxhash64(*[F.get("_hashes", i + k) for k in range(WINDOW)]))
    rows = evaluated(rows, _windows=F.when(F.size("_hashes") >= WINDOW, window)).drop("_hashes")
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    sorted_windows = F.when(repeats, F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    rows = evaluated(rows, _sorted=sorted_windows).drop("_windows")
    twice = F.filter("_sorted", lambda x, j: (x["h"] == F.get("_sorted", j - 1)["h"]) | (x["h"] == F.get("_sorted", j + 1)["h"]))
    places = F.sort_array(F.transform(twice, lambda x: x["i"]))
    covered = F.aggregate(
        places, F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda done, i: F.struct(i.alias("last"), (done["n"] + F.least(F.lit(WINDOW), i - done["last"])).alias("n")), lambda done: done["n"],
    )
    rows = evaluated(rows, _covered=F.coalesce(covered, F.lit(0)).cast("long")).drop("_sorted")

    def share(part: str, whole: str, scale: int) -> Column:
        return F.when(F.col(whole) > 0, F.floor(F.col(part) * scale / F.col(whole))).otherwise(F.lit(0)).cast("long")

    def step(count: str) -> Column:
        return F.floor(F.log2(F.col(count) + 1) * 8).cast("long")

    parts = {
        "n_words": F.col("_n"), "word_chars": F.col("_chars"), "n_symbols": F.col("_symbols"), "n_dup_lines": F.col("_dups"), "n_repeat_words": F.col("_covered"),
        "size_step": step("_n"), "line_step": step("_n_lines"), "mean_word_10": share("_chars", "_n", 10), "symbols_1000": share("_symbols", "_chars", 1000),
        "dup_lines_1000": share("_dups", "_n_lines", 1000), "repeats_1000": share("_covered", "_n", 1000), "distinct_1000": share("_distinct", "_n", 1000),
    }
    return rows.select("_doc", F.struct(*(c.alias(name) for name, c in parts.items())).alias("_quality"))


def base_failed() -> Column:
    """Too few words, or more than a fifth of them in repeated windows."""
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def learn(measures: DataFrame, labels: DataFrame, max_rules: int = 8, max_conditions: int = 4, min_precision: float = 0.9, min_covered: int = 5) -> list[Rule]:
    """Rules that cover bad documents, in order. `measures` has doc_id and MEASURES, `labels` doc_id and quality."""
    votes = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("quality").alias("vote"))
    rows = measures.where(~base_failed()).select("doc_id", *MEASURES).join(votes, "doc_id").select(
        *MEASURES, (F.col("vote") < 0.5).cast("long").alias("bad"), (F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(3)) > 0).alias("grow"))
    rows = stored(rows, "quality-labelled")
    rules: list[Rule] = []
    while len(rules) < max_rules:
        rule = _grown(rows.where("grow"), max_conditions)
        rule = _pruned(rows.where("not grow"), rule)
        bad, covered = _covered(rows, rule) if rule else (0, 0)
        if covered < min_covered or bad < min_precision * covered:
            break
        rules.append(rule)
        rows = rows.where(~_holds(rule))
    return rules


def _holds(rule: Rule) -> Column:
    out = F.lit(True)
    for condition in rule:
        out = out & condition.column()
    return out


def _covered(rows: DataFrame, rule: Rule) -> tuple[int, int]:
    found = rows.where(_holds(rule)).agg(F.coalesce(F.sum("bad"), F.lit(0)), F.count("*")).first()
    return found[0], found[1]


def _grown(rows: DataFrame, max_conditions: int) -> Rule:
    """Add the condition of the highest gain until all that is covered is bad."""
    rule: Rule = ()
    while len(rule) < max_conditions:
        best = _best(rows.where(_holds(rule)))
        if best is None or best.gain <= 1e-9:
            break
        rule += (Condition(best.measure, best.at_least, best.value),)
        if best.bad == best.n:
            break
    return rule


def _best(rows: DataFrame):
    """The threshold of the highest gain, from the label counts of every value of every measure."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in MEASURES]))
    counts = rows.select(pairs.alias("x"), "bad").select("x.*", "bad").groupBy("measure", "value").agg(F.sum("bad").alias("bad"), F.count("*").alias("n"))
    up = Window.partitionBy("measure").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("measure").orderBy("value").rowsBetween(0, Window.unboundedFollowing)
    both = Window.partitionBy("measure")
    names = [f"{x}_{side}" for side in ("up", "down") for x in ("bad", "n")]
    sums = counts.select(
        "measure", "value", F.sum("bad").over(both).alias("all_bad"), F.sum("n").over(both).alias("all_n"),
        *[F.sum(name.split("_")[0]).over(up if name.endswith("_up") else down).alias(name) for name in names],
    )
    sides = F.array(*[F.struct(F.lit(side == "down").alias("at_least"), F.col(f"bad_{side}").alias("bad"), F.col(f"n_{side}").alias("n")) for side in ("up", "down")])
    sums = sums.select("measure", "value", "all_bad", "all_n", F.inline(sides)).where("bad > 0 and n < all_n")
    gain = F.col("bad") * (F.log2(F.col("bad") / F.col("n")) - F.log2(F.col("all_bad") / F.col("all_n")))
    return sums.withColumn("gain", F.round(gain, 9)).orderBy(F.desc("gain"), "n", "measure", "at_least", "value").limit(1).first()


def _pruned(rows: DataFrame, rule: Rule) -> Rule:
    """The first conditions that do best on held-out rows; all of them if none of those rows is covered."""
    if not rule:
        return rule
    heads = [rule[:size] for size in range(1, len(rule) + 1)]
    sums = [F.coalesce(F.sum(F.when(_holds(head), x)), F.lit(0)) for head in heads for x in (F.col("bad"), F.lit(1))]
    found = rows.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()
    worth = [(2 * bad - n) / n if n else -2.0 for bad, n in zip(found[::2], found[1::2])]
    return heads[worth.index(max(worth))] if max(worth) > -2 else rule


def first_rule(rules: list[Rule]) -> Column:
    """Number, from 1, of the first rule that covers a row; null if none does."""
    out = F.lit(None).cast("int")
    for number in range(len(rules), 0, -1):
        out = F.when(_holds(rules[number - 1]), F.lit(number)).otherwise(out)
    return out


def judged(measures: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add base_failed, rule (number of the learned rule that rejects the row) and kept."""
    return measures.withColumns({"base_failed": base_failed(), "rule": first_rule(rules)}).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def measures_of(docs: DataFrame) -> DataFrame:
    return stored(measured(docs.select("doc_id", "text")).select("_doc.doc_id", "_quality.*"), "quality-measures")


def kept(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """The documents that pass the base rules and the list learned from their labelled rows."""
    rules = learn(measures_of(docs), labels, **settings)
    return judged(measured(docs).select("_doc", "_quality.*"), rules).where("kept").select("_doc.*")
