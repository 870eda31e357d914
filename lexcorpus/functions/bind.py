"""Bind an intermediate value inside one column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    Writing an expensive expression twice into a column makes Spark compute it
    twice inside ``when`` branches and lets the expression tree grow with every
    nesting. A one-element ``transform`` names the value instead.
    """
    return F.transform(F.array(value), body).getItem(0)
