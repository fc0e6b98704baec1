"""Helpers for expressions over arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once a row.

    A column alias is no such binding: the optimizer may put its expression
    back into a lambda, where it is evaluated for each element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fresh(name: str, taken: list[str]) -> str:
    """``name``, with underscores behind it until no column of ``taken`` has it."""
    names = {c.lower() for c in taken}
    while name.lower() in names:
        name += "_"
    return name
