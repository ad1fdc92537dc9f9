"""Trailing windows over an entity's own rows.

All windows of one ``Trail`` share partitioning and order, so a pipeline of them costs one exchange and one
sort. A window function can't hold another, so builders that need an intermediate series put it in a column:
``Trail.series`` names it, and ``result`` removes what was named. Columns are gathered until the result is asked
for and then made by depth: all that need no other one first, then all that need only those, so that a whole matrix
has as many window nodes as its longest chain.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import count

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from marlstone.functions.nulls import ratio

Aggregate = Callable[[Column], Column]
_names = count()
_WORD = re.compile(r"\w+")


class Trail:
    """A panel with windows over ``entity`` ordered by ``time``."""

    def __init__(self, df: DataFrame, entity: str = "ticker", time: str = "date"):
        self.df, self.entity, self.time, self.own = df, entity, time, []
        self.rows: WindowSpec = Window.partitionBy(entity).orderBy(time)
        self.waiting: dict[str, tuple[int, Column]] = {}

    def last(self, n: int) -> WindowSpec:
        return self.rows.rowsBetween(-(n - 1), 0)

    def so_far(self) -> WindowSpec:
        return self.rows.rowsBetween(Window.unboundedPreceding, 0)

    def _add(self, name: str, x: Column) -> None:
        needs = [self.waiting[w][0] for w in set(_WORD.findall(str(x))) if w in self.waiting]
        self.waiting[name] = (max(needs) + 1 if needs else 0, x)

    def series(self, x: Column) -> Column:
        """Hold an expression in a column, so that windows can read it."""
        name = f"__s{next(_names)}"
        self._add(name, x)
        self.own.append(name)
        return F.col(name)

    def put(self, **columns: Column) -> Trail:
        if (set(columns) & (set(self.df.columns) | set(self.waiting))) or any(n in str(x) for n in columns for x in columns.values()):
            self._flush()  # what came before reads the columns as they were
            self.df = self.df.withColumns(columns)
        else:
            for name, x in columns.items():
                self._add(name, x)
        return self

    def _flush(self) -> None:
        for depth in sorted({d for d, _ in self.waiting.values()}):
            self.df = self.df.withColumns({name: x for name, (d, x) in self.waiting.items() if d == depth})
        self.waiting = {}

    def result_so_far(self) -> DataFrame:
        """All columns up to now, with the held ones."""
        self._flush()
        return self.df

    def result(self) -> DataFrame:
        return self.result_so_far().drop(*self.own)

    def lag(self, x: Column, k: int = 1) -> Column:
        return F.lag(x, k).over(self.rows)

    def lead(self, x: Column, k: int = 1) -> Column:
        return F.lead(x, k).over(self.rows)

    def number(self) -> Column:
        return F.row_number().over(self.rows)

    def over(self, agg: Aggregate, x: Column, n: int, least: int | None = None) -> Column:
        """An aggregate of the last ``n`` rows, null where fewer than ``least`` of them (default all) have a value."""
        w = self.last(n)
        return F.when(F.count(x).over(w) >= (n if least is None else least), agg(x).over(w))

    def mean(self, x: Column, n: int, least: int | None = None) -> Column:
        return self.over(F.avg, x, n, least)

    def std(self, x: Column, n: int, least: int | None = None) -> Column:
        return self.over(F.stddev_samp, x, n, least)

    def sum(self, x: Column, n: int, least: int | None = None) -> Column:
        return self.over(F.sum, x, n, least)

    def covariance(self, a: Column, b: Column, n: int, least: int | None = None) -> Column:
        """Sample covariance of the complete pairs in the window."""
        w = self.last(n)
        both = F.count(F.when(a.isNotNull() & b.isNotNull(), 1)).over(w)
        return F.when(both >= (n if least is None else least), F.covar_samp(a, b).over(w))

    def correlation(self, a: Column, b: Column, n: int) -> Column:
        """Pearson correlation with each series' own spread, within -1 and 1."""
        spread = self.std(a, n) * self.std(b, n)
        raw = ratio(self.covariance(a, b, n), spread)
        return F.when(raw.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw)))
