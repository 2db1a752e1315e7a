"""Named SQL views with declared dependencies, built in their order and built again after a change below them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame, SparkSession

from ..schema import evolved
from ..sources.lake import Source, report_view
from .catalog import REPORTS


@dataclass(frozen=True)
class View:
    """A view over others: from their DataFrames in the order of `needs`."""

    name: str
    needs: tuple[str, ...]
    build: Callable[..., DataFrame]


class Views:
    """A set of views. A name that is needed but not declared is a table that is there already."""

    def __init__(self, spark: SparkSession, views: list[View]):
        self.spark, self.views = spark, {v.name: v for v in views}

    def order(self) -> list[str]:
        """All names, each after those that it needs; a cycle is a ValueError."""
        return [n for n in TopologicalSorter({v.name: v.needs for v in self.views.values()}).static_order() if n in self.views]

    def above(self, changed: set[str]) -> list[str]:
        """The views that are changed or stand above something changed, in order."""
        found = set(changed)
        for name in self.order():
            if found & set(self.views[name].needs):
                found.add(name)
        return [n for n in self.order() if n in found]

    def rebuild(self, changed: set[str] | None = None) -> list[str]:
        """Build all views, or those above what has changed."""
        built = self.order() if changed is None else self.above(changed)
        for name in built:
            view = self.views[name]
            view.build(*map(self.spark.table, view.needs)).createOrReplaceTempView(name)
        return built

    def drop(self) -> None:
        for name in reversed(self.order()):
            self.spark.catalog.dropTempView(name)


def over(spark: SparkSession, source: Source, names: list[str] | None = None) -> Views:
    """`raw_events` as a lake has them, `events` with all columns of the schema and of the reports, and a view for each report of the kind `view` (or the named ones)."""
    reports = [r for r in REPORTS.values() if r.name in names or r.category == "view"] if names else [r for r in REPORTS.values() if r.category == "view"]
    base = [View("raw_events", (), lambda: source.raw(spark)), View("events", ("raw_events",), lambda raw: report_view(evolved(raw)))]
    dimensions = [View(n, ("events",), lambda e, n=n: source.dimension(spark, n, e)) for n in ("campaigns", "creatives")]
    return Views(spark, [*base, *dimensions, *[View(r.name, ("events",), r.over) for r in reports]])
