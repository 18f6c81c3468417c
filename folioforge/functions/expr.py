"""Helpers for large column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value written, and evaluated, once: it is the variable of a lambda over an array of one."""
    return F.element_at(F.transform(F.array(value), body), 1)


def chain(value: Column, *steps: Callable[[Column], Column]) -> Column:
    """Each step of the step before, every intermediate evaluated once."""
    first, *rest = steps
    return let(value, (lambda x: chain(first(x), *rest)) if rest else first)
