"""Date metadata: validation, updates, and the interval predicates as Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.plans.query import Dates, interval

FIELDS = ("date", "start_date", "end_date")


def date_range(low: str, high: str) -> Column:
    return interval(Dates("DATE", low, high))


def appeared(low: str, high: str) -> Column:
    return interval(Dates("APPEARED", low, high))


def valid(low: str, high: str) -> Column:
    return interval(Dates("VALID", low, high))


def previous_day(day: Column) -> Column:
    """The day before, both as YYYYMMDD."""
    return F.date_format(F.date_sub(F.to_date(day, "yyyyMMdd"), 1), "yyyyMMdd")


def checked(**values: str | None) -> dict[str, str | None]:
    """The given fields, or ValueError: 8 digits or None, and start not after end."""
    for k, v in values.items():
        if k not in FIELDS:
            raise ValueError(f"unknown field {k}")
        if v is not None and not re.fullmatch(r"\d{8}", v):
            raise ValueError(f"{k} must be 8 digits or None")
    if values.get("start_date") and values.get("end_date") and values["start_date"] > values["end_date"]:
        raise ValueError("start_date is after end_date")
    return values


def parse_assignments(text: str) -> dict[str, str | None]:
    """``date=20240101 start=... end=null`` as fields; null clears."""
    names, out = {"date": "date", "start": "start_date", "end": "end_date"}, {}
    for part in text.split():
        key, _, value = part.partition("=")
        if key not in names or not value:
            raise ValueError(f"can't read {part!r}")
        out[names[key]] = None if value.lower() == "null" else value
    return checked(**out)


def set_meta(docs: DataFrame, doc_id: int, **values: str | None) -> DataFrame:
    """docs with the fields of one document replaced; fields not named stay.

    The document's whole metadata, old and new fields together, must be valid; an unknown document
    is a KeyError.
    """
    row = F.col("doc_id") == doc_id
    held = docs.filter(row).select(*FIELDS).first()
    if held is None:
        raise KeyError(doc_id)
    checked(**{**held.asDict(), **checked(**values)})
    return docs.withColumns({k: F.when(row, F.lit(v).cast("string")).otherwise(F.col(k)) for k, v in values.items()})


def violations(docs: DataFrame) -> DataFrame:
    """Rows whose metadata breaks the rules."""
    bad = F.lit(False)
    for k in FIELDS:
        bad = bad | (F.col(k).isNotNull() & ~F.col(k).rlike(r"^\d{8}$"))
    return docs.filter(bad | F.coalesce(F.col("start_date") > F.col("end_date"), F.lit(False)))
