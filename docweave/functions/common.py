"""Small helpers shared by the column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times.

    Lambdas of array functions evaluate every outer expression once per element, so a value that is used
    inside one is bound through a one-element array first.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def empty(kind: str) -> Column:
    """An empty array of the given DDL type, e.g. ``array<string>``."""
    return F.expr(f"cast(array() as {kind})")


def is_json(text: Column) -> Column:
    """Whether a text is exactly one JSON value; parsers alone let trailing characters pass."""
    return F.coalesce(F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1, F.lit(False))


def append(items: Column, item: Column) -> Column:
    return F.concat(items, F.array(item))
