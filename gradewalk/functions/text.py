"""Text, number and label functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# How places, stations and districts are written in the published tables.
NUMBERED, DOTS = r"제(\d+)", "[·ㆍ・.,]"
BRACKETED, STATION = r"\(.*?\)", "역"
CITY_DISTRICT = r"서울(?:특별시)?\s+(\S+구)"


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def place_name(c: Column) -> Column:
    """A place's name without white space, with 제N as N and one kind of middle dot."""
    bare = F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"(?U)\s+", "")
    return F.regexp_replace(F.regexp_replace(bare, NUMBERED, "$1"), DOTS, ".")


def station_key(c: Column) -> Column:
    """A station's name without brackets, spaces and a final 역."""
    bare = F.replace(F.regexp_replace(c, BRACKETED, ""), F.lit(" "), F.lit(""))
    return F.when(bare.endswith(STATION) & (F.length(bare) > 2), F.regexp_replace(bare, f"{STATION}$", "")).otherwise(bare)


def district_of_address(c: Column) -> Column:
    found = F.regexp_extract(c, CITY_DISTRICT, 1)
    return F.when(found != "", found)


#: Texts that stand for no number in statistics tables.
NO_NUMBER = ("", "-", "…", "X", "x")


def number(c: Column, missing: tuple[str, ...] = ("",)) -> Column:
    """A number with thousands separators; null if it isn't one or stands for none."""
    bare = F.trim(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit(","), F.lit("")))
    value = bare.try_cast("double")
    return F.when(~bare.isin(*missing) & ~F.isnan(value), value)


def truth(c: Column) -> Column:
    return F.lower(F.trim(c)).isin("true", "1", "yes", "y")


def minutes(c: Column) -> Column:
    """Whole minutes from a list by commas, semicolons or spaces; 5, 10 and 15 if there are none."""
    parts = F.filter(F.split(F.coalesce(c, F.lit("")), r"[;,\s]+"), lambda p: p != "")
    found = F.transform(parts, lambda p: p.try_cast("double").cast("int"))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(5), F.lit(10), F.lit(15)))


def file_name(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), r"[\\/:*?\"<>|\s]+", "_")


def three_digits(c: Column) -> Column:
    """Numbers of 1000 and over rounded half to even to three significant digits, smaller ones to whole numbers."""
    scale = F.pow(F.lit(10.0), F.floor(F.log10(c)) - 2)
    return F.when(c >= 1000, F.rint(c / scale) * scale).otherwise(F.rint(c)).cast("long")


def day_label(c: Column) -> Column:
    """A date as YYYY.MM.DD (weekday)."""
    names = F.array(*[F.lit(x) for x in "월화수목금토일"])
    return F.concat(F.date_format(c, "yyyy.MM.dd"), F.lit(" ("), F.element_at(names, F.weekday(c) + 1), F.lit(")"))


def use_class(use: Column, kind: Column, classes: dict[str, tuple], residential_kind: tuple, rest: str = "other") -> Column:
    """A building's class by its use code; without a use code a residential kind makes it a home."""
    use, kind = (F.upper(F.coalesce(c, F.lit(""))) for c in (use, kind))
    found = F.coalesce(*[F.when(use.isin(*codes), F.lit(name)) for name, codes in classes.items()])
    return F.coalesce(found, F.when(~use.startswith("BDU") & kind.isin(*residential_kind), F.lit("home")), F.lit(rest))


def is_home(use: Column, kind: Column, residential_use: tuple, residential_kind: tuple) -> Column:
    use, kind = (F.upper(F.coalesce(c, F.lit(""))) for c in (use, kind))
    return use.isin(*residential_use) | (~use.startswith("BDU") & kind.isin(*residential_kind))


def floors(c: Column) -> Column:
    """Floors between 1 and 60; blank or bad counts as 1."""
    return F.least(F.greatest(F.coalesce(c.try_cast("double"), F.lit(1.0)), F.lit(1.0)), F.lit(60.0))
