"""Numbers, dates and rounded figures read from text, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ledgerleaf.functions.text import strip

# Month names in calendar order.
MONTH_NAMES = ("January", "February", "March", "April", "May", "June", "July", "August",
               "September", "October", "November", "December")

_YEAR, _DAY = r"(?!0000)\d{4}", r"(?: [1-9]|\d{1,2})"
_ISO = rf"\A{_YEAR}-\d{{1,2}}-{_DAY}\z"
_SLASHES = rf"\A{_DAY}/{_DAY}/{_YEAR}\z"
_DASHES = rf"\A{_DAY}-\d{{1,2}}-{_YEAR}\z"
_NAMED = rf"(?i)\A({'|'.join(f'{m}|{m[:3]}' for m in MONTH_NAMES)})\s+({_DAY}),?\s+({_YEAR})\z"


def parse_num(col: Column) -> Column:
    """Digits and points only; anything unreadable is 0. A sign is not kept."""
    digits = F.regexp_replace(col, r"[^\d.]", "")
    return F.coalesce(digits.try_cast("double"), F.lit(0.0))


def _date(year: Column, month: Column, day: Column) -> Column:
    return F.replace(F.concat_ws("-", year, month, day), F.lit(" "), F.lit("")).try_cast("date")


def parse_date(col: Column) -> Column:
    """Year-month-day; day-first with slashes (month-first if that fails) or dashes; or a month
    name in full or by its first three letters. Null when there is no such day."""
    # The lambda gives the stripped text a name, so it is worked out once.
    return F.get(F.transform(F.array(strip(col)), _read_date), F.lit(0))


def _read_date(text: Column) -> Column:
    slash, dash = F.split(text, "/"), F.split(text, "-")
    month_at = F.instr(
        F.lit("".join(m[:3].lower() for m in MONTH_NAMES)),
        F.lower(F.substring(text, 1, 3)),
    )
    return (
        F.when(F.rlike(text, F.lit(_ISO)), _date(dash[0], dash[1], dash[2]))
        .when(
            F.rlike(text, F.lit(_SLASHES)),
            F.coalesce(_date(slash[2], slash[1], slash[0]), _date(slash[2], slash[0], slash[1])),
        )
        .when(F.rlike(text, F.lit(_DASHES)), _date(dash[2], dash[1], dash[0]))
        .when(
            F.rlike(text, F.lit(_NAMED)),
            _date(
                F.regexp_extract(text, _NAMED, 3),
                ((month_at + 2) / 3).cast("int").cast("string"),
                F.regexp_extract(text, _NAMED, 2),
            ),
        )
    )


def round_exact(col: Column, digits: int = 2) -> Column:
    """Round the binary value itself, ties to even; round() would round its decimal print."""
    shape = F.lit("0." + "0" * digits)
    return F.call_function("format_number", col, shape).cast("double")


def money(col: Column) -> Column:
    return F.format_number(col, 2)


def percent(confidence: Column) -> Column:
    """Whole percent, cut off rather than rounded."""
    return (confidence * 100).cast("int")


def plain_number(col: Column) -> Column:
    """A double in plain digits with at least one decimal."""
    return F.call_function("format_number", col, F.lit("0.0################"))
