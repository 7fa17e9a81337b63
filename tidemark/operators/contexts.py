"""Measures in changed contexts: filters, ALL, shifted and trailing periods.

A model names base totals of its fact tables, filters, and measures written over
them. A measure asks for other measures, or for base totals, in its own context
or in a changed one:

    nrr_pct=lambda m: pct(m["total_mrr"] - m["new_mrr"], m.shift(1)["total_mrr"])

All totals a report needs are found first. Each fact is then read once, into one
aggregate at the grain of the report with a conditional total for every filter;
ALL contexts roll this small table up, and periods are range windows over the
calendar index, so that a month missing from the data shifts nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import safe_div
from tidemark.runtime import stage

_MERGE = {"sum": F.sum, "min": F.min, "max": F.max}


@dataclass(frozen=True)
class Base:
    """A total that parts of the rows add up to: sum, min or max of a value of one fact."""

    fact: str
    value: Callable[[], Column]
    kind: str = "sum"


def row_count(fact: str) -> Base:
    return Base(fact, lambda: F.lit(1))


@dataclass(frozen=True)
class Context:
    """Filters by name, slices ignored, and the periods `shift + span - 1` to `shift` back."""

    where: frozenset[str] = frozenset()
    all_of: frozenset[str] = frozenset()
    shift: int = 0
    span: int = 1

    @property
    def here(self) -> bool:
        return self.shift == 0 and self.span == 1


@dataclass
class _Needs:
    """Totals asked for, each with the column that will hold it."""

    columns: dict[tuple[str, Context], str] = field(default_factory=dict)

    def column(self, base: str, context: Context) -> Column:
        return F.col(self.columns.setdefault((base, context), f"_total_{len(self.columns)}"))


class Scope:
    """A model seen from one context; measures are functions of it."""

    def __init__(self, model: Model, needs: _Needs, by: Sequence[str], context: Context):
        self._model, self._needs, self._by, self._context = model, needs, by, context

    def _with(self, **change) -> Scope:
        return Scope(self._model, self._needs, self._by, replace(self._context, **change))

    def __getitem__(self, measure: str) -> Column:
        return self._model.measures[measure](self)

    def total(self, base: str) -> Column:
        """A base total in this context; NULL where no row counts."""
        return self._needs.column(base, self._context)

    def where(self, *filters: str) -> Scope:
        """Only rows that meet the named filters, besides those of this context."""
        return self._with(where=self._context.where | set(filters))

    def all(self, *slices: str) -> Scope:
        """Over all values of the named slicing columns; without names, of all but the period."""
        return self._with(all_of=self._context.all_of | set(slices or [b for b in self._by if b != self._model.period]))

    def shift(self, periods: int) -> Scope:
        """So many periods earlier; shifts add up."""
        return self._with(shift=self._context.shift + periods)

    def last_year(self) -> Scope:
        """The same period of the year before."""
        return self.shift(self._model.per_year)

    def trailing(self, periods: int) -> Scope:
        """Totals over the last periods up to this one; of a trailing span, spans join."""
        return self._with(span=self._context.span + periods - 1)

    def trailing_mean(self, measure: str, periods: int, weight: Column | None = None) -> Column:
        """Mean of a measure's values in the last periods; those without a value do not count."""
        value, weight = self[measure], F.lit(1) if weight is None else weight
        keys = [b for b in self._by if b != self._model.period]
        frame = Window.partitionBy(*keys).orderBy(self._model.period).rangeBetween(1 - periods, 0)
        return safe_div(F.sum(value * weight).over(frame), F.sum(F.when(value.isNotNull(), weight)).over(frame))


class Model:
    """Base totals, named filters and measures over one or more facts.

    `period` is an integer column whose consecutive values are consecutive
    periods, `per_year` of them a year.
    """

    def __init__(self, bases: Mapping[str, Base], measures: Mapping[str, Callable[[Scope], Column]],
                 filters: Mapping[str, Callable[[], Column]] | None = None, period: str = "month_no", per_year: int = 12):
        self.bases, self.measures, self.filters = dict(bases), dict(measures), dict(filters or {})
        self.period, self.per_year = period, per_year

    def evaluate(self, facts: Mapping[str, DataFrame], names: Sequence[str] | None = None, by: Sequence[str] = (),
                 spine: DataFrame | None = None) -> DataFrame:
        """One row per slice `by`, with the named measures.

        Slices are the combinations found in the facts that have all columns of
        `by`, or the rows of `spine`. A fact without one of these columns is not
        sliced by it. NULL is a slice of its own. Periods that no row has are NULL
        in shifts and add nothing to spans. Each fact is read once.
        """
        by, needs = list(by), _Needs()
        scope = Scope(self, needs, by, Context())
        out = {n: self.measures[n](scope) for n in names or self.measures}
        moved = [c for _, c in needs.columns if not c.here]
        if moved and self.period not in by:
            raise ValueError(f"shifted and trailing measures need {self.period} among the slices")
        fine = {f: self._fine(f, facts[f], needs, by) for f in {self.bases[b].fact for b, _ in needs.columns}}
        slices = spine.select(*by).distinct() if spine is not None else self._slices(fine.values(), by)
        for (fact, kept), wanted in self._grains(fine, needs).items():
            part = self._part(fine[fact], kept, wanted, slices)
            slices = _null_safe(slices, part, kept, "left") if kept else slices.crossJoin(F.broadcast(part))
        return slices.select(*by, *[c.alias(n) for n, c in out.items()])

    def _cell(self, base: str, where: frozenset[str]) -> str:
        return "_".join(["_cell", base, *sorted(where)])

    def _fine(self, fact: str, rows: DataFrame, needs: _Needs, by: list[str]) -> DataFrame:
        """The fact at the grain of the report: a conditional total for every base and filter."""
        cells = {}
        for base, context in needs.columns:
            b = self.bases[base]
            if b.fact == fact:
                tests = [self.filters[f]() for f in sorted(context.where)]
                value = F.when(reduce(lambda x, y: x & y, tests), b.value()) if tests else b.value()
                cells[self._cell(base, context.where)] = _MERGE[b.kind](value)
        return stage(rows.groupBy(*[b for b in by if b in rows.columns]).agg(*[v.alias(n) for n, v in cells.items()]))

    def _slices(self, fine, by: list[str]) -> DataFrame:
        whole = [f.select(*by) for f in fine if set(by) <= set(f.columns)]
        if not whole:
            raise ValueError(f"no fact has all of {by}")
        if not by:
            return whole[0].sparkSession.range(1).select()
        return reduce(DataFrame.unionByName, whole).distinct()

    def _grains(self, fine: Mapping[str, DataFrame], needs: _Needs) -> dict[tuple, list[tuple[str, Context, str]]]:
        """Totals by the fact and the slices that they keep."""
        out: dict[tuple, list] = {}
        for (base, context), name in needs.columns.items():
            fact = self.bases[base].fact
            kept = tuple(c for c in fine[fact].columns if not c.startswith("_cell_") and c not in context.all_of)
            out.setdefault((fact, kept), []).append((base, context, name))
        return out

    def _part(self, fine: DataFrame, kept: tuple[str, ...], wanted: list, slices: DataFrame) -> DataFrame:
        """(kept slices, totals) of one grain."""
        if any(not c.here for _, c, _ in wanted) and self.period not in kept:
            raise ValueError(f"a shifted or trailing total cannot ignore {self.period}")
        cells = {self._cell(b, c.where): _MERGE[self.bases[b].kind] for b, c, _ in wanted}
        part = fine.groupBy(*kept).agg(*[merge(n).alias(n) for n, merge in cells.items()])
        if any(not c.here for _, c, _ in wanted):  # a value at each slice, found in the data or not
            part = _null_safe(slices.select(*kept).distinct(), part, kept, "full")
        keys = [k for k in kept if k != self.period]
        totals = []
        for base, context, name in wanted:
            total = F.col(self._cell(base, context.where))
            if not context.here:
                frame = (Window.partitionBy(*keys).orderBy(self.period)
                         .rangeBetween(1 - context.shift - context.span, -context.shift))
                total = _MERGE[self.bases[base].kind](total).over(frame)
            totals.append(total.alias(name))
        return part.select(*kept, *totals)


def _null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join on keys where NULL equals NULL; the keys appear once."""
    right = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    out = left.join(right, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]), how)
    if how == "full":
        out = out.withColumns({k: F.coalesce(k, f"_right_{k}") for k in keys})
    return out.drop(*[f"_right_{k}" for k in keys])


def subtotals(rows: DataFrame, by: Sequence[str], aggs: Sequence[Column], sets: Sequence[Sequence[str]] | None = None,
              everything: str = "(all)", missing: str = "(none)") -> DataFrame:
    """Totals and subtotals in one pass: every combination of `by` (a cube), or the given grouping sets.

    Slices become text: `everything` where a column is totalled over, `missing`
    for a NULL of the data. `level` counts the columns that still slice.
    """
    cols = [F.col(b) for b in by]
    grouped = rows.cube(*cols) if sets is None else rows.groupingSets([[F.col(c) for c in s] for s in sets], *cols)
    over = {b: F.grouping(b) == 1 for b in by}
    names = [F.when(over[b], everything).otherwise(F.coalesce(F.col(b).cast("string"), F.lit(missing))).alias(f"_{b}") for b in by]
    level = reduce(lambda x, y: x + y, [F.when(o, 0).otherwise(1) for o in over.values()])
    out = grouped.agg(*names, level.alias("level"), *aggs)
    return out.drop(*by).withColumnsRenamed({f"_{b}": b for b in by})
