"""Column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEED = "42"


def coin(*parts: Column | str, seed: str = SEED) -> Column:
    """A repeatable uniform draw in [0, 1) from a hash of ``seed`` and ``parts``.

    Unlike ``rand()`` it gives the same draw when a task is retried or the data is partitioned anew.
    """
    columns = [F.col(p) if isinstance(p, str) else p for p in parts]
    digest = F.md5(F.concat_ws("|", F.lit(seed), *[c.cast("string") for c in columns]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def hours_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(3.6e9)


def ratio(numerator: Column, denominator: Column, otherwise: float | None = None) -> Column:
    """Division that gives ``otherwise`` instead of an error where the denominator is 0."""
    quotient = numerator / F.nullif(denominator.cast("double"), F.lit(0.0))
    return quotient if otherwise is None else F.coalesce(quotient, F.lit(otherwise))


def not_nan(value: Column | str) -> Column:
    """Null for NaN: a NaN would otherwise win every maximum and spoil every sum."""
    value = F.col(value) if isinstance(value, str) else value
    return F.when(~F.isnan(value), value)


def literal_count(text: Column, token: str) -> Column:
    """Non-overlapping occurrences of a literal token."""
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(token), F.lit("")))) / F.lit(len(token)))
