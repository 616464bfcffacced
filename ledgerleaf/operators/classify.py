"""Classification by weighted keyword and pattern scores."""

from __future__ import annotations

from collections.abc import Collection
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ledgerleaf.functions.patterns import leading_literal, spell
from ledgerleaf.functions.stages import evaluated
from ledgerleaf.functions.text import contains_any
from ledgerleaf.functions.values import round_exact
from ledgerleaf.functions.words import word_points, words_within
from ledgerleaf.rules import categories as C


READINGS = ("haystack", "keywords", "heads")
#: Every pattern's leading literal has a bit of its own.
HEADS = {head: i for i, head in enumerate(dict.fromkeys(leading_literal(p) for c in C.CATEGORIES for p in c.patterns))}


def with_haystack(docs: DataFrame, categories: Collection[C.Category] = C.CATEGORIES) -> DataFrame:
    """Add the lowered text and what it holds of some categories' words: points of keywords, leading literals of patterns."""
    hay = F.col("haystack")
    heads = {leading_literal(p): HEADS[leading_literal(p)] for c in categories for p in c.patterns}
    return docs.withColumn(
        "haystack", F.lower(F.concat_ws(" ", F.col("text"), F.col("original_name")))
    ).withColumns({
        "keywords": word_points(hay, {c.slug: c.keywords for c in categories}, C.KEYWORD_POINTS, C.KEYWORD_CEILING),
        "heads": words_within(hay, heads),
    })


def pattern_points(pattern: str) -> Column:
    hits = F.regexp_count(F.col("haystack"), F.lit(spell(pattern)))
    points = F.least(C.PATTERN_POINTS * hits, F.lit(C.PATTERN_CEILING))
    return F.when(F.col("heads").bitwiseAND(1 << HEADS[leading_literal(pattern)]) != 0, points).otherwise(0)


def keyword_total(category: C.Category) -> Column:
    return F.col("keywords")[category.slug]


def pattern_total(category: C.Category) -> Column:
    return reduce(lambda a, b: a + b, (pattern_points(p) for p in category.patterns))


def weighted(points: Column, category: C.Category) -> Column:
    """Points are whole numbers, so hundredths are exact."""
    return points * category.weight_pct / F.lit(100.0)


def score_column(category: C.Category) -> str:
    return f"score_{category.slug}"


def score(category: C.Category) -> Column:
    return weighted(keyword_total(category) + pattern_total(category), category)


def scores(docs: DataFrame) -> DataFrame:
    """Add one score column per category, but those that are there. The text is lowered once, in its own projection."""
    missing = [c for c in C.CATEGORIES if score_column(c) not in docs.columns]
    staged = with_haystack(docs, missing)
    return staged.withColumns({score_column(c): score(c) for c in missing}).drop(*READINGS)


def filename_hint() -> Column:
    """What the file name says, for documents whose scores are weak."""
    name, hint = F.lower(F.col("original_name")), F
    for words, category in C.FILENAME_HINTS:
        hint = hint.when(contains_any(name, words), category)
    return hint.otherwise(C.REPORT)


def candidates(docs: DataFrame, category: str) -> DataFrame:
    """The documents that classify() can put into a category, with their score of it: that score is not weak, or the file
    name speaks for it. All others need no other category's words looked for."""
    mine = next(c for c in C.CATEGORIES if c.name == category)
    column = score_column(mine)
    own = evaluated(with_haystack(docs, [mine]), **{column: score(mine)}).drop(*READINGS)
    return own.where((F.col(column) >= C.WEAK_SCORE) | (filename_hint() == category))


def scores_long(docs: DataFrame) -> DataFrame:
    """One row per document and category."""
    pairs = F.array(*(
        F.struct(
            F.lit(c.name).alias("category"),
            F.lit(i).alias("ord"),
            F.col(score_column(c)).alias("score"),
        )
        for i, c in enumerate(C.CATEGORIES)
    ))
    return scores(docs).select("doc_id", F.inline(pairs))


def classify(docs: DataFrame) -> DataFrame:
    """Add category, category_confidence and best_score; the first declared category wins ties."""
    columns = [score_column(c) for c in C.CATEGORIES]
    ranked = scores(docs).withColumn("best_score", F.greatest(*columns))
    best = F.col("best_score")

    winner = F
    for column, category in zip(columns, C.CATEGORIES):
        winner = winner.when(F.col(column) == best, category.name)
    hint = filename_hint()

    weak = best < C.WEAK_SCORE
    confidence = F.least(
        F.lit(C.CONFIDENCE_CEILING),
        F.greatest(
            F.lit(C.CONFIDENCE_FLOOR),
            C.CONFIDENCE_BASE + best / (best + C.CONFIDENCE_HALF) * C.CONFIDENCE_SPAN,
        ),
    )
    return evaluated(
        ranked,
        category=F.when(weak, hint).otherwise(winner),
        category_confidence=F.when(~weak, round_exact(confidence))
        .when(hint == C.REPORT, C.NO_HINT_CONFIDENCE)
        .otherwise(C.HINT_CONFIDENCE),
    ).drop(*columns)
