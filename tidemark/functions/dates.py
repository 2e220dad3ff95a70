"""Dates from the forms in which corpora hold them."""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def strict_date(c: Column) -> Column:
    """year-month-day, padded or not; anything else is null."""
    return F.try_to_date(c, "yyyy-M-d")


def iso_timestamp(c: Column) -> Column:
    return F.try_to_timestamp(F.regexp_replace(c, "Z$", "+00:00"))


def underscored(c: Column) -> Column:
    """YYYY_MM_DD with hyphens; fewer than three parts stay as they are."""
    parts = F.split(c, "_")
    return F.when(F.size(parts) >= 3, F.concat_ws("-", F.slice(parts, 1, 3))).otherwise(c)


def month_number(name: Column) -> Column:
    """1 to 12 from a month's name or its first three letters, else null."""
    short = F.substring(F.lower(name), 1, 3)
    at = F.array_position(F.array(*[F.lit(m[:3]) for m in MONTHS]), short)
    whole = F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.greatest(at, F.lit(1)).cast("int"))
    return F.when((at > 0) & F.startswith(whole, F.regexp_replace(F.lower(name), r"\.$", "")), at.cast("int"))


def heading_date(c: Column) -> Column:
    """2024_March_7 as 2024_03_07."""
    part = lambda i: F.regexp_extract(c, r"^(\d{4})_([A-Za-z]+)_(\d{1,2})$", i)
    month = month_number(part(2))
    return F.when(month.isNotNull(), F.concat_ws("_", part(1), F.lpad(month.cast("string"), 2, "0"), F.lpad(part(3), 2, "0")))


def free_date(c: Column) -> Column:
    """The first date in free text: numeric year first, or with a month's name; a missing day is the first."""
    number = r"((?:19|20)\d{2})[-./](\d{1,2})[-./](\d{1,2})"
    name = r"(?i)\b(Jan[a-z]*|Feb[a-z]*|Mar[a-z]*|Apr[a-z]*|May|Jun[a-z]*|Jul[a-z]*|Aug[a-z]*|Sep[a-z]*|Oct[a-z]*|Nov[a-z]*|Dec[a-z]*)\.?"
    md, dm, my = name + r"\s+(\d{1,2}),?\s+(\d{4})", r"\b(\d{1,2})\s+" + name.replace("(?i)", "(?i:") .replace(r"\.?", r")\.?") + r",?\s+(\d{4})", name + r",?\s+(\d{4})"

    def made(y: Column, m: Column, d: Column) -> Column:
        whole = lambda x: F.nullif(x, F.lit("")).try_cast("int")
        text = F.concat_ws("-", F.nullif(y, F.lit("")), m.cast("string"), whole(d).cast("string"))
        return F.when(m.isNotNull() & whole(d).isNotNull(), F.try_to_date(text, "yyyy-M-d"))

    get = lambda p, i: F.regexp_extract(c, p, i)
    return F.coalesce(
        made(get(number, 1), F.nullif(get(number, 2), F.lit("")).try_cast("int"), get(number, 3)),
        made(get(md, 3), month_number(get(md, 1)), get(md, 2)),
        made(get(dm, 3), month_number(get(dm, 2)), get(dm, 1)),
        made(get(my, 2), month_number(get(my, 1)), F.lit("1")),
    )


def first_date(text: str) -> date | None:
    """The first date in a text: one with the year in front in numbers, or else one with a month's name and the year behind it.

    The text is read as its numbers and names with what stands between them, from year to year; a missing day is the first."""
    words = [(m[0], m.start(), m.end()) for m in re.finditer(r"[0-9]+|[A-Za-z]+", text)]
    between = lambda i: text[words[i][2] : words[i + 1][1]] if 0 <= i < len(words) - 1 else None  # noqa: E731  behind word i
    number = lambda i: int(words[i][0]) if 0 <= i < len(words) and words[i][0].isdigit() and len(words[i][0]) <= 2 else 0
    years = [i for i, (w, _, _) in enumerate(words) if len(w) == 4 and w.isdigit() and 1900 <= int(w) < 2100]

    def month(i: int) -> int:
        name = words[i][0].lower() if 0 <= i < len(words) else ""
        return next((k + 1 for k, m in enumerate(MONTHS) if len(name) >= 3 and m.startswith(name)), 0)

    def loose(i: int) -> bool:
        return between(i) is not None and not between(i).strip(" ,.\n\t\xa0")

    def numbers() -> list[tuple[int, int, int]]:
        return [(i, number(i + 1), number(i + 2)) for i in years if between(i) in tuple("-./") and between(i + 1) in tuple("-./")]

    def names() -> list[tuple[int, int, int]]:
        found = []
        for i in years:
            day_behind = number(i - 1) if loose(i - 1) and loose(i - 2) else 0
            at = i - 2 if day_behind else i - 1
            if month(at) and loose(i - 1):
                found.append((i, month(at), day_behind or (number(at - 1) if loose(at - 1) else 0) or 1))
        return found

    for i, m, d in [*numbers(), *names()]:
        try:
            return date(int(words[i][0]), m, d)
        except ValueError:
            continue
    return None
