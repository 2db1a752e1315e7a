"""Column helpers for rates, conditional counts and shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def n_if(condition: Column) -> Column:
    """Rows for which the condition holds."""
    return F.count_if(condition)


def is_type(*types: str) -> Column:
    return F.col("type").isin(*types) if len(types) > 1 else F.col("type") == types[0]


def pct(part: Column | str, whole: Column | str, digits: int = 2) -> Column:
    """100 * part / whole, rounded; null for an empty whole."""
    part, whole = (F.col(c) if isinstance(c, str) else c for c in (part, whole))
    return F.round(F.lit(100.0) * part / F.nullif(whole, F.lit(0)), digits)


def ratio(part: Column, whole: Column, digits: int = 2) -> Column:
    """part / whole of whole numbers, rounded half away from zero without going through a fraction; null for an empty whole."""
    whole = F.nullif(whole.cast("long"), F.lit(0).cast("long"))
    scaled = F.abs(part.cast("long")) * F.lit(2 * 10**digits) + whole
    return F.signum(part.cast("double")) * F.call_function("div", scaled, 2 * whole) / F.lit(float(10**digits))


def ctr(digits: int = 2) -> Column:
    """Click-through rate of the grouped events in per cent."""
    return pct(n_if(is_type("click")), n_if(is_type("pageview")), digits)


def with_total(df: DataFrame, column: str, total: str, few: bool = False) -> DataFrame:
    """Add the sum of a column over all rows: one row, joined to each. No window over everything, so nothing meets in one task.

    The aggregation below is run once if the sum uses the same columns of it (Spark reuses the exchange); a table of few rows, as one for each bucket of a fixed list, takes a window instead.
    """
    if few:
        return df.withColumn(total, F.sum(column).over(W.partitionBy()))
    return df.crossJoin(F.broadcast(df.agg(F.sum(column).alias(total))))


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def seconds(a: Column, b: Column) -> Column:
    """Seconds from a to b with fractions."""
    return F.timestamp_diff("MICROSECOND", a, b) / F.lit(1e6)


def days(a: Column, b: Column) -> Column:
    """Whole periods of 24 hours from a to b."""
    return F.floor(F.timestamp_diff("MICROSECOND", a, b) / F.lit(86_400_000_000.0)).cast("long")


def rank_in(column: Column | str, labels: list[str]) -> Column:
    """The place of a label in a list, to sort by; others come last."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(*[F.when(column == label, i) for i, label in enumerate(labels)], F.lit(len(labels)))


def bucket(value: Column, edges: list[tuple[float, str]], last: str) -> Column:
    """The label of the first edge above the value, else the last label."""
    out = None
    for edge, label in edges:
        out = F.when(value < edge, label) if out is None else out.when(value < edge, label)
    return out.otherwise(last)
