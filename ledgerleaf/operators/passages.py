"""Entities and sections, worked out per row without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerleaf.functions.offsets import with_running_sums
from ledgerleaf.functions.patterns import jvm, jvm_words
from ledgerleaf.functions.stages import evaluated
from ledgerleaf.functions.text import matches, stripped_lines
from ledgerleaf.rules import passages as R

ENTITY_TYPE = "array<struct<type:string,value:string,span:array<int>>>"


# Two noncharacters. The first marks the matches in a copy of the text; should a text hold it,
# the second takes its place, which no pattern can tell apart.
MARK, STAND_IN = chr(0xFDD0), chr(0xFDD1)
LOCAL_PART = "[A-Za-z0-9._%+-]"
# More than any list holds.
ALL = 2**31 - 1


def most(caps: str | None, limit: int) -> int:
    """How many to keep: `caps` is 'reference' for the reference's number, None for all."""
    return ALL if caps is None else limit


def entity_pattern(rule: R.Entity) -> str:
    """An address starts with a run of letters that an @ ends; that is looked for before the dearer word boundary."""
    pattern = (jvm_words if rule.whole_words else jvm)(rule.pattern, rule.ignore_case)
    return f"(?={LOCAL_PART}++@){pattern}" if rule.type == "EMAIL" else pattern


def marked_parts(text: Column, rule: R.Entity) -> Column:
    """The text cut at its matches: gap, match, gap, match, ..., gap. One scan finds values and
    offsets alike; an address needs an @, so most texts skip that scan."""
    marked = F.regexp_replace(
        F.replace(text, F.lit(MARK), F.lit(STAND_IN)), entity_pattern(rule), f"{MARK}$0{MARK}"
    )
    parts = F.split(marked, MARK)
    if rule.type == "EMAIL":
        return F.when(F.contains(text, F.lit("@")), parts).otherwise(F.array(F.lit("")))
    return parts


def hits(parts: Column) -> Column:
    return F.filter(parts, lambda _, i: i % 2 == 1)


def found(text: Column, rule: R.Entity) -> Column:
    """All matches in order; an address needs an @, so most texts skip that scan."""
    values = F.regexp_extract_all(text, F.lit(entity_pattern(rule)), 0)
    if rule.type == "EMAIL":
        return F.when(F.contains(text, F.lit("@")), values).otherwise(F.array().cast("array<string>"))
    return values


def _entries(rule: R.Entity, values: Column, lengths: Column, limit: int) -> Column:
    """The first distinct values with the span of their first occurrence, in code points."""
    def entry(value: Column) -> Column:
        nth = F.array_position(values, value).cast("int")
        start = F.aggregate(
            F.slice(lengths, F.lit(1), 2 * nth - 1), F.lit(0), lambda at, length: at + length
        )
        return F.struct(
            F.lit(rule.type).alias("type"),
            value.alias("value"),
            F.array(start, start + F.length(value)).alias("span"),
        )

    return F.transform(F.slice(F.array_distinct(values), 1, limit), entry)


def _all_entities(docs: DataFrame) -> DataFrame:
    """Add all distinct entities. A text of n matches costs n to the power of 1.5: offsets are running sums, and first
    occurrences come from sorting by value and place."""
    count = range(len(R.ENTITIES))
    rows = evaluated(docs, **{f"parts_{i}": marked_parts(F.col("text"), r) for i, r in enumerate(R.ENTITIES)})

    def lengths(parts: Column) -> Column:
        """Of every match, with what lies before it since the match before."""
        return F.transform(hits(parts), lambda value, j: F.length(F.get(parts, 2 * j)) + F.length(value))

    rows = evaluated(rows, **{f"lengths_{i}": lengths(F.col(f"parts_{i}")) for i in count})
    for i in count:
        rows = with_running_sums(rows, f"lengths_{i}", f"ends_{i}")

    def placed(parts: Column, ends: Column) -> Column:
        return F.array_sort(F.transform(hits(parts), lambda value, j: F.struct(value.alias("value"), (F.get(ends, j) - F.length(value)).alias("start"))))

    rows = evaluated(rows, **{f"placed_{i}": placed(F.col(f"parts_{i}"), F.col(f"ends_{i}")) for i in count}).drop(
        *(f"{name}_{i}" for i in count for name in ("parts", "lengths", "ends")))

    def entries(rule: R.Entity, all_placed: Column) -> Column:
        first = F.filter(all_placed, lambda x, j: (j == 0) | (x["value"] != F.get(all_placed, j - 1)["value"]))
        by_place = F.array_sort(F.transform(first, lambda x: F.struct(x["start"].alias("start"), x["value"].alias("value"))))
        return F.transform(by_place, lambda x: F.struct(
            F.lit(rule.type).alias("type"), x["value"].alias("value"), F.array(x["start"], x["start"] + F.length(x["value"])).alias("span")))

    found = F.concat(*(entries(rule, F.col(f"placed_{i}")) for i, rule in enumerate(R.ENTITIES)))
    return evaluated(rows, entities=found.cast(ENTITY_TYPE)).drop(*(f"placed_{i}" for i in count))


def extract_entities(docs: DataFrame, caps: str | None = "reference") -> DataFrame:
    """Add ``entities``: the first distinct (type, value) pairs, type by type; all with caps=None."""
    if caps is None:
        return _all_entities(docs)
    limit = most(caps, R.MAX_ENTITIES)
    parts = {f"parts_{i}": marked_parts(F.col("text"), r) for i, r in enumerate(R.ENTITIES)}
    values = {f"values_{i}": hits(F.col(f"parts_{i}")) for i in range(len(R.ENTITIES))}
    lengths = {f"lengths_{i}": F.transform(F.col(f"parts_{i}"), F.length) for i in range(len(R.ENTITIES))}
    entries = F.concat(*(
        _entries(rule, F.col(f"values_{i}"), F.col(f"lengths_{i}"), limit)
        for i, rule in enumerate(R.ENTITIES)
    ))
    return (
        docs.withColumns(parts).withColumns(values | lengths)
        .withColumn("entities", F.slice(entries, 1, limit).cast(ENTITY_TYPE))
        .drop(*parts, *values, *lengths)
    )


# The slices below change nothing. A bare column would make the optimizer derive a filter on its
# size and compute the column a second time for it.

def entities_long(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.slice("entities", 1, ALL)).alias("entity_ord", "e")).select(
        "doc_id", "entity_ord", "e.type", "e.value", "e.span"
    )


def entity_totals(docs: DataFrame) -> DataFrame:
    """Documents per entity, over all entities of each document."""
    return distinct_entities(all_matches(docs)).groupBy("type", "value").agg(
        F.count("*").alias("documents"))


def is_heading(line: Column) -> Column:
    return (F.length(line) < R.HEADING_LENGTH) & (
        matches(line, R.HEADINGS[0]) | matches(line, R.HEADINGS[1])
    )


def extract_sections(docs: DataFrame, caps: str | None = "reference") -> DataFrame:
    """Add ``sections``: the runs of lines between headings; a heading without lines is dropped.
    The first ones with their first lines, all with caps=None."""
    rows = F.col("text_lines")
    count = F.size(rows)
    heads = F.col("heads")
    staged = docs.withColumn("text_lines", stripped_lines(F.col("text"))).withColumn(
        "heads",
        F.filter(
            F.transform(rows, lambda line, i: F.when(is_heading(line), i + 1)),
            lambda at: at.isNotNull(),
        ),
    )

    def section(start: Column, end: Column) -> Column:
        return F.struct(
            F.when(start == 0, F.lit(R.FIRST_SECTION))
            .otherwise(F.get(rows, start - 1)).alias("title"),
            F.slice(rows, start + 1, F.least(end - start - 1, F.lit(most(caps, R.MAX_SECTION_LINES))))
            .alias("content"),
        )

    # A run starts after heading number `start` (0 stands for the top) and ends before `end`.
    runs = F.zip_with(
        F.concat(F.array(F.lit(0)), heads), F.concat(heads, F.array(count + 1)),
        lambda start, end: F.struct(start.alias("start"), end.alias("end")),
    )
    kept = F.slice(
        F.filter(runs, lambda run: run["end"] - run["start"] > 1), 1, most(caps, R.MAX_SECTIONS))
    built = F.transform(kept, lambda run: section(run["start"], run["end"]))
    return staged.withColumn(
        "sections",
        F.transform(
            built,
            lambda s: F.struct(
                s["title"].alias("title"), F.array_join(s["content"], "\n").alias("content")),
        ),
    ).drop("text_lines", "heads")


def sections_long(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.slice("sections", 1, ALL)).alias("section_ord", "s")).select(
        "doc_id", "section_ord", "s.title", "s.content"
    )


def doc_lines(docs: DataFrame) -> DataFrame:
    """Non-blank lines with their heading flag."""
    return docs.select(
        "doc_id", F.posexplode(stripped_lines(F.col("text"))).alias("line_no", "line")
    ).withColumn("is_heading", is_heading(F.col("line")))


def all_matches(docs: DataFrame) -> DataFrame:
    """Every entity match of every document, in type order, then position."""
    def tagged(rule: R.Entity, order: int) -> Column:
        def entry(value: Column, at: Column) -> Column:
            return F.struct(
                F.lit(rule.type).alias("type"), F.lit(order).alias("type_ord"),
                at.alias("match_ord"), value.alias("value"),
            )

        return F.transform(found(F.col("text"), rule), entry)

    streams = F.concat(*(tagged(rule, i) for i, rule in enumerate(R.ENTITIES)))
    return docs.select("doc_id", F.inline(streams))


def distinct_entities(matches_long: DataFrame) -> DataFrame:
    """First occurrence of each (document, type, value); a minimum merges before the shuffle."""
    return matches_long.groupBy("doc_id", "type", "value").agg(
        F.min("match_ord").alias("first_ord"), F.count("*").alias("times")
    )
